"""Document fingerprints from closed syncmers over words.

A window of K words is chosen when the least of its inner S-word hashes is the first
or the last of them. The choice looks at the window's own words only, so an edit
moves no anchor outside the windows it touches. A fingerprint has all anchors of a
text with their places. Two texts are matched by position: neighbouring anchors of
equal values at an equal distance lie on one diagonal. Likeness is the share of such
pairs; ``aligned`` matches tables of texts and tells the diagonals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, let, read, words

K, S = 6, 2
#: Buckets of neighbouring ids: at most so many, of about so many documents each; documents of a task; buckets of rows that share an id.
MAX_BUCKETS, BUCKET_DOCS, TASK_DOCS, SHARED_BITS = 32_768, 2_000, 4_000, 6


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<value, word>>: closed syncmers with the place of their first word, in order of place.

    A text of fewer than ``k`` words has one anchor of all its words; a text without
    words has none. Null counts as empty.
    """
    inner = k - s + 1

    def value(parts: Column) -> Column:
        return F.shiftrightunsigned(parts, 33)

    def chosen(h: Column) -> Column:
        n = F.size(h)
        pairs = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))

        def windows(p: Column) -> Column:
            def edge(i: Column) -> Column:
                return let(F.array_min(F.slice(p, i + 1, F.lit(inner))), lambda least: (least == F.get(p, i)) | (least == F.get(p, i + inner - 1)))

            at = F.filter(F.sequence(F.lit(0), n - k), edge)
            return F.transform(at, lambda i: F.struct(value(F.xxhash64(*[F.get(h, i + j) for j in range(k)])).alias("value"), i.alias("word")))

        whole = F.transform(F.array(h), lambda x: F.struct(value(F.xxhash64(x)).alias("value"), F.lit(0).alias("word")))
        return F.when(n >= k, let(pairs, windows)).when(n > 0, whole).otherwise(F.array().cast("array<struct<value:bigint,word:int>>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), chosen)


def matches(found: Column) -> Column:
    """From anchors: the different hashes of neighbouring anchors' values and distance; of a single anchor its value."""

    def pairs(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(a) - 2)
        both = F.transform(at, lambda i: F.xxhash64(F.get(a, i)["value"], F.get(a, i + 1)["value"], F.get(a, i + 1)["word"] - F.get(a, i)["word"]))
        return F.when(F.size(a) > 1, F.array_distinct(both)).otherwise(F.transform(a, lambda x: x["value"]))

    return let(found, pairs)


def packed(found: Column) -> Column:
    """One number for each anchor: its value, then its place in 28 bits. A quarter of the structs' bytes in a shuffle."""
    return F.transform(found, lambda a: a["value"] * (1 << 28) + a["word"])


def unpacked(numbers: Column) -> Column:
    return F.transform(numbers, lambda x: F.struct(F.shiftright(x, 28).alias("value"), x.bitwiseAND((1 << 28) - 1).cast("int").alias("word")))


def spelled(found: Column) -> Column:
    """Sixteen lower-case hex digits for each anchor: its value, then its place (7 digits)."""
    return F.lower(F.array_join(F.transform(packed(found), lambda a: F.lpad(F.hex(a), 16, "0")), ""))


def likeness(left: Column, right: Column) -> Column:
    """Shared part of two texts' matches, 0 to 1 (Dice); two empty ones are alike."""
    n = F.size(left) + F.size(right)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / n)


def aligned(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Positional matching of two tables (key, anchors): pairs with their anchors on each diagonal.

    Returns left_key, right_key, shift (right word less left word) and n_anchors. The
    join is on anchor values; a value that stands in very many texts makes that many
    matches, so callers drop values of boilerplate first.
    """
    lhs = left.select(F.col(key).alias("left_key"), F.inline("anchors")).withColumnRenamed("word", "left_word")
    rhs = right.select(F.col(key).alias("right_key"), F.inline("anchors")).withColumnRenamed("word", "right_word")
    return lhs.join(rhs, "value").groupBy("left_key", "right_key", (F.col("right_word") - F.col("left_word")).alias("shift")).agg(F.count("*").alias("n_anchors"))


def with_next(docs: DataFrame, columns: list[str], text: str, key: str = "doc_id") -> DataFrame:
    """Adds next_<column>: the value in the row of the next smaller key; after the least comes the greatest.

    Rows of equal or null keys follow one another by a hash of ``text``; null keys come
    last. Rows go by ranges of about BUCKET_DOCS, whose edges are quantiles of the keys
    and stay in Spark; rows that share an edge's key, or have none, go by ranges of
    their hashes. Each range is ordered by itself, and the first row of each is dealt to
    the range before it too, so texts are shuffled once.
    """
    keyed = docs.withColumns({"_k": F.col(key).cast("long"), "_h": F.bitwise_not(F.xxhash64(text))})
    n = keyed.count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_DOCS))
    steps = [1 << i for i in reversed(range(buckets.bit_length()))]
    # One row with at most MAX_BUCKETS numbers.
    edges = keyed.agg(F.percentile_approx("_k", [i / buckets for i in range(1, buckets)] or [0.5], max(10_000, 4 * buckets)).alias("_edges"))
    keyed = keyed.crossJoin(F.broadcast(edges))
    # How many edges are not greater than the key, by halving steps.
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get("_edges", at + step - 1) <= F.col("_k"), at + step).otherwise(at))
    own = F.shiftright("_h", 64 - SHARED_BITS) + (1 << (SHARED_BITS - 1))

    def bucket(at: Column) -> Column:
        shared = F.col("_k").isNull() | (F.get("_edges", at - 1) == F.col("_k"))
        level = F.when(F.col("_k").isNull(), -1).otherwise(2 * at + F.when(F.coalesce(shared, F.lit(False)), 0).otherwise(1))
        return level.cast("long") * (1 << SHARED_BITS) + F.when(F.coalesce(shared, F.lit(False)), own).otherwise(0)

    keyed = keyed.withColumn("_bucket", let(below, bucket)).drop("_edges")
    # Bounded: at most 2 * MAX_BUCKETS ranges, and 64 for each edge that rows share.
    heads = keyed.groupBy("_bucket").agg(F.max(F.struct("_k", "_h")).alias("_head"))
    around = Window.partitionBy(F.lit(1)).orderBy("_bucket")
    to = heads.select(F.col("_bucket").alias("_b"), "_head", F.coalesce(F.lead("_bucket").over(around), F.min("_bucket").over(Window.partitionBy(F.lit(1)))).alias("_to"))
    placed = keyed.join(bounded(cut(to), 4 * MAX_BUCKETS), F.col("_bucket") == F.col("_b"))
    is_head = F.struct("_k", "_h").eqNullSafe(F.col("_head"))
    dealt = placed.withColumn("_ghost", F.explode(F.when(is_head, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    dealt = dealt.withColumn("_bucket", F.when(F.col("_ghost"), F.col("_to")).otherwise(F.col("_bucket"))).drop("_to", "_head", "_b")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_DOCS)
    # Guests stand behind the range's own rows.
    within = Window.partitionBy("_bucket").orderBy("_ghost", F.col("_k").desc_nulls_last(), F.col("_h").desc())
    nexts = dealt.repartition(tasks, "_bucket").withColumns({f"next_{c}": F.lead(c).over(within) for c in columns})
    return nexts.where(~F.col("_ghost")).drop("_ghost", "_bucket", "_k", "_h")


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited form (see op10); one row for each row of ``docs``.

    Null texts count as empty. A text without words has an empty fingerprint. Texts of
    any length are taken whole; repeated rows and equal or null keys follow one another
    by a hash of the text (see ``with_next``).
    """
    own = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body"))
    own = own.withColumn("anchors", packed(anchors(F.col("body"))))
    n = F.length("body")
    rows = with_next(own, ["body", "anchors"], "body", key).withColumn("n", n).withColumn("cut", F.floor(n / 3).cast("int"))
    edited = F.concat(F.substring(F.col("body"), F.lit(1), F.col("n") - F.col("cut")), F.substring(F.col("next_body"), F.lit(1), F.col("cut")))

    def compared(own: Column) -> Column:
        return F.struct(
            spelled(F.col("found")).alias("fingerprint"), spelled(own["anchors"]).alias("edited_fingerprint"),
            let(matches(F.col("found")), lambda m: F.struct(likeness(m, matches(own["anchors"])).alias("edited"), likeness(m, matches(unpacked(F.col("next_anchors")))).alias("next"))).alias("near"),
        )

    rows = rows.withColumns({"edited": edited, "found": unpacked(F.col("anchors"))}).select(key, F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), let(F.struct(anchors(F.col("edited")).alias("anchors")), compared).alias("c"))
    return rows.select(key, "n_chars", "edited_sha256", "c.fingerprint", "c.edited_fingerprint", F.col("c.near.edited").alias("near_edited"), F.col("c.near.next").alias("near_next"))


def op10_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))
