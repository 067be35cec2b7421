"""SimHash near-duplicates with deletion-variant signatures.

Fingerprints are cut into so few segments that of two alike ones a segment differs in
one bit at most. The index has every segment without each of its bits, so equality
joins find such segments; candidates are compared in full. Only different fingerprints
are indexed, so copies, however many, are one entry.

There are two forms. ``near_duplicates`` links 64-bit fingerprints within ``max_bits``:
(max_bits + 2) // 2 segments lose no link. ``drop_near_duplicates`` links texts whose
sets of shingles have a Jaccard similarity of ``least`` or more. These differ in about
15 of 100 bits, so no few segments of one fingerprint do; it takes as many segments of
``width`` bits from a longer fingerprint as find a pair of just that similarity with
the probability ``recall``, and exact similarities decide. Only texts whose mark of the
segment is equal meet (two shingles that stand first and last in an order of their
own), so unlike texts don't meet by chance, however many there are; bits alone would
let them, as often as there are pairs. Members of a bucket meet a
few leaders first, and in the end all those of other components, so large groups of
near copies don't make all their pairs. Candidates of two components whose bits are
``DEVIATIONS`` or more too far apart are not compared by text; all others are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import bounded, byte_words, collect_shuffles, cut, dealt, numbered_columns, read, shuffled, small_batches, tidy, written
from .components import label_components
from .suffix_dedup import mixed, rolled

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Shingles whose bits are summed at a time.
BLOCK = 65_536
#: Of the stage on texts: words of a shingle, similarity, bits of a segment without a mark, share of pairs of just that similarity to be found.
WORDS, LEAST, WIDTH, RECALL = 5, 0.8, 23, 0.91
#: Bits of a segment whose buckets have its mark, shingles in a mark, bits that are compared where texts meet.
MARKED, SHARED, BITS = 16, 2, 1280
#: The tag of buckets of single shingles, in the low 16 bits; others have their segment and bit there.
SINGLE = (1 << 16) - 1
#: Sets of at most so many shingles are compared exactly, by a prefix filter: their bits are tied to each other.
SHORT = 50
#: Leaders that members of a bucket meet before all others.
LEADERS = 2
#: Deviations from the expected number of differing bits up to which larger texts are compared; under 1 in 10,000 of pairs at the least similarity has more.
DEVIATIONS = 4.0


def simhash(text: str | None, n: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    ws = byte_words(text, lower=True)
    if not ws:
        return 0
    count = max(1, len(ws) - n + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, BLOCK):
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(ws[i : i + n]), SEED) for i in range(at, min(count, at + BLOCK))), np.uint64)
        ones += ones_by_bit(hashes.astype(">u8").view(np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def ones_by_bit(rows: np.ndarray) -> np.ndarray:
    """How many rows of bytes have each bit; sums of at most 255 rows fit in a byte."""
    bits = np.unpackbits(rows, axis=1)
    return sum((bits[i : i + 255].sum(0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255)), np.zeros(bits.shape[1], np.int64))


@pandas_udf(LongType())
@tidy
def simhash_long(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint's 64 bits as a signed number."""
    for batch in texts:
        yield pd.Series(np.array([simhash(t) for t in batch], dtype=np.uint64).view(np.int64), index=batch.index)


def segment_bounds(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    n = (max_bits + 2) // 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _long(bits: int) -> Column:
    """The literal of a 64-bit mask, with its sign."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _segment(bits: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, low).bitwiseAND(_long((1 << width) - 1))


def link_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """From different fingerprints (bits: long): links (left, right, distance), each at least once.

    Segments and variants are equality keys, so the work is a shuffle of 64 + the
    number of segments rows for each fingerprint; they are never broadcast.
    """
    prints = dealt(prints, "bits")
    whole, variants = [], []
    for k, (low, width) in enumerate(segment_bounds(max_bits)):
        value = _segment(F.col("bits"), low, width)
        whole.append(F.struct(F.lit(k).alias("segment"), value.alias("value")))
        for b in range(width):
            one = value.bitwiseAND(_long(1 << b)) != 0
            variants.append(F.struct(F.lit(k * 64 + b).alias("segment"), value.bitwiseAND(_long(((1 << width) - 1) & ~(1 << b))).alias("value"), one.alias("one")))
    same = prints.select("bits", F.inline(F.array(*whole)))
    other = same.withColumnRenamed("bits", "right")
    equal = same.withColumnRenamed("bits", "left").join(shuffled(other), ["segment", "value"]).where("left < right").select("left", "right")
    index = prints.select("bits", F.inline(F.array(*variants)))
    zeros = index.where(~F.col("one")).select(F.col("bits").alias("left"), "segment", "value")
    ones = index.where("one").select(F.col("bits").alias("right"), "segment", "value")
    near = zeros.join(shuffled(ones), ["segment", "value"]).select("left", "right")
    distance = F.bit_count(F.col("left").bitwiseXOR(F.col("right")))
    return equal.unionByName(near).withColumn("distance", distance).where(F.col("distance") <= max_bits)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: key, bits (long), component_id (least key that links reach) and n_links.

    Null and wordless texts have fingerprint 0 and link like any other. n_links counts
    the different fingerprints linked to the row's own. Null keys are never the least
    key of a component that has another; a component of null keys alone has a null id.
    """
    slim, known = _linked(docs.select(F.col(key), F.col(text).alias("_text")), key, max_bits)
    return slim.join(known, "bits", "left").select(key, "bits", "component_id", "n_links")


def row_hash(key: str, text: str) -> Column:
    """Tells rows apart by key, null or not, and text."""
    return F.xxhash64(F.col(key).isNull(), F.col(key), F.col(text).isNull(), F.col(text))


def _linked(docs: DataFrame, key: str, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows of key, bits; what is known of each fingerprint: component, number of links)."""
    small_batches(docs.sparkSession)
    slim = cut(docs.select(F.col(key), simhash_long(F.col("_text")).alias("bits")))
    prints = cut(slim.groupBy("bits").agg(F.min(key).cast("long").alias("least")))
    links = cut(link_fingerprints(prints.select("bits"), max_bits).distinct())
    parts = label_components(prints.select(F.col("bits").alias("node"), "least"), links)
    ends = links.select(F.explode(F.array("left", "right")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    # Cut, so that both sides of the last join are plain shuffles, whose skewed partitions Spark splits.
    known = parts.join(ends, "node", "left")
    return slim, cut(known.select(F.col("node").alias("bits"), F.col("least").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


# Texts by the similarity of their shingles.


def differing_share(similarity: float) -> float:
    """Share of bits in which fingerprints of two sets of that Jaccard similarity (and like size) differ: their angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def segment_count(width: int = WIDTH, least: float = LEAST, recall: float = RECALL, shared: int = 0) -> int:
    """Segments so that of two texts of that similarity one segment differs in one bit at most, and its ``shared`` shingles are equal, with the probability ``recall``."""
    p = differing_share(least)
    one = ((1 - p) ** width + width * p * (1 - p) ** (width - 1)) * least**shared
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def shingle_hashes(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """The different hashes of all shingles of ``n`` words; fewer words are one shingle, no words have none."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64)
    return np.unique(rolled(own, min(n, len(own)))) if len(own) else own


def bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A fingerprint as an array of booleans; mixtures of the hashes give as many bits as it takes."""
    odd = np.arange(1, 2 * -(-bits // 64), 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    ones = np.zeros(64 * len(odd), np.int64)
    for at in range(0, len(hashes), BLOCK // 8):
        ones += ones_by_bit(mixed((hashes[at : at + BLOCK // 8, None] ^ (hashes[at : at + BLOCK // 8, None] >> np.uint64(31))) * odd).view(np.uint8))
    return (2 * ones > len(hashes))[:bits]


def numbers(bits: np.ndarray, count: int, width: int) -> np.ndarray:
    """The first count * width bits as ``count`` numbers."""
    return bits[: count * width].reshape(count, width) @ (1 << np.arange(width, dtype=np.int64))


def segments_of(hashes: np.ndarray, count: int, width: int) -> np.ndarray:
    """A fingerprint of count * width bits as ``count`` numbers."""
    return numbers(bits_of(hashes, count * width), count, width)


def marks_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` numbers, each made of the least and the greatest of the hashes in an order of its own (two sets have equal ones with about the square of their similarity)."""
    odd = np.arange(1, 2 * count, 2, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
    low, high = np.full(count, np.iinfo(np.uint64).max), np.zeros(count, np.uint64)
    for at in range(0, len(hashes), BLOCK // 8):
        held = mixed((hashes[at : at + BLOCK // 8, None] ^ (hashes[at : at + BLOCK // 8, None] >> np.uint64(29))) * odd)
        low, high = np.minimum(low, held.min(0)), np.maximum(high, held.max(0))
    return (low * np.uint64(0x9E3779B97F4A7C15) ^ high).view(np.int64)


def prefix_length(size: int, least: float = LEAST) -> int:
    """How many of the first of ``size`` ordered shingles a set as similar as ``least`` must share one of."""
    return size - math.ceil(least * size - 1e-9) + 1


def _segments(n: int, count: int, width: int, bits: int):
    number = IntegerType() if width <= 31 else LongType()

    @pandas_udf(StructType([StructField("node", LongType()), StructField("segments", ArrayType(number)), StructField("marks", ArrayType(LongType())), StructField("bits", ArrayType(LongType())), StructField("size", IntegerType()), StructField("shingles", ArrayType(LongType()))]))
    @tidy
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            nodes, rows, marked, whole, sizes, short = [], [], [], [], [], []
            for text in batch:
                words = byte_words(text, lower=True)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                hashes = shingle_hashes(words, n)
                own = bits_of(hashes, bits)
                rows.append(numbers(own, count, width))
                marked.append(marks_of(hashes, count))
                whole.append(numbers(own, bits // 64, 64))
                sizes.append(len(hashes))
                short.append(hashes.view(np.int64) if len(hashes) <= SHORT else None)
            yield pd.DataFrame({"node": np.array(nodes, np.uint64).view(np.int64), "segments": rows, "marks": marked, "bits": whole, "size": np.array(sizes, np.int32), "shingles": short}, index=batch.index)

    return made


def _similarity(n: int):
    @pandas_udf(DoubleType())
    @tidy
    def jaccard(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            out = []
            # Texts of large groups come many times in a batch.
            known = {t: shingle_hashes(byte_words(t, lower=True), n) for t in {*left, *right}}
            for a, b in zip(left, right):
                x, y = known[a], known[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
            yield pd.Series(out, index=left.index, dtype="float64")

    return jaccard


#: Nodes whose texts may be asked for by a broadcast: two numbers each.
ASKED = 500_000


def _near(a: str, b: str, bits: int, least: float) -> Column:
    """Whether two structs (bits, size, shingles) may have a similarity of ``least``: sizes at that ratio, and exactly so for two short sets; else differing bits by their expected number and some deviations."""
    p = differing_share(least)
    most = int(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))
    x, y = F.col(a), F.col(b)
    small, large = F.least(x["size"], y["size"]), F.greatest(x["size"], y["size"])
    apart = reduce(add, (F.bit_count(F.get(x["bits"], F.lit(k)).bitwiseXOR(F.get(y["bits"], F.lit(k)))) for k in range(bits // 64)))
    both = F.size(F.array_intersect(x["shingles"], y["shingles"]))
    exact = both >= least * (x["size"] + y["size"] - both) - 1e-9
    return (small >= least * large) & F.when(large <= SHORT, exact).otherwise(apart <= most)


def _alike(near: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, least: float) -> DataFrame:
    """Of candidates (left, right), each once: those whose texts have a similarity of ``least``; a written table."""
    ends = near.select(F.col("left").alias("node")).distinct().unionByName(near.select(F.col("right").alias("node")).distinct())
    asked = nodes.join(ends, "node", "left_semi").select("node", F.col("first_row").alias("row"))
    asked, drop_asked = written(asked)
    texts, drop_texts = written(docs.join(bounded(asked, ASKED), "row").dropDuplicates(["node"]).select("node", "_text"))
    found, _ = written(near.join(texts.toDF("left", "a"), "left").join(texts.toDF("right", "b"), "right").where(_similarity(n)("a", "b") >= least).select("left", "right"))
    drop_asked()
    drop_texts()
    return found


def rarest_shingles(nodes: DataFrame, least: float) -> DataFrame:
    """(node, s): of the shingles of each short set those that stand first in an order of all shingles, the rarest first; two sets alike share one of theirs (``prefix_length``).

    So sets do not meet by a common line, in however many texts it stands, unless they have little else. A shingle
    of one set only takes its place in the order and is no row.
    """
    held = nodes.where("shingles is not null").select("node", "size", F.explode("shingles").alias("s"))
    counts = held.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    rare = held.join(shuffled(counts), "s").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "s"))).alias("found"))
    prefix = F.greatest(F.lit(1), F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1)
    firsts = F.slice("found", F.lit(1), F.greatest(F.lit(0), prefix - F.col("size") + F.size("found")).cast("int"))
    return rare.select("node", F.explode(firsts).alias("first")).select("node", "first.s")


def similar_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = WORDS, least: float = LEAST, width: int = MARKED, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows of key, row, node; for each node, a text up to case and white space: component_id, root, first_row, n_rows, linked).

    ``row`` hashes key and text. Texts without words are one node, linked to no other.
    """
    count = segment_count(width, least, recall, SHARED)
    if width > 31 or count * width > SINGLE:
        raise ValueError(f"{count} segments of {width} bits are too many or too wide for a bucket's tag")
    bits = max(BITS, -(-count * width // 64) * 64)
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key), F.col(text).alias("_text"))
    slim = cut(own.select(F.col(key), row_hash(key, "_text").alias("row"), _segments(n, count, width, bits)("_text").alias("s")).select(key, "row", "s.*"))
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "row"))["row"]
    # Equal nodes have equal segments and sizes.
    nodes = cut(dealt(slim.groupBy("node").agg(F.min(key).cast("long").alias("least"), first.alias("first_row"), F.count("*").alias("n_rows"), F.first("segments").alias("segments"), F.first("marks").alias("marks"), F.first("bits").alias("bits"), F.first("size").alias("size"), F.first("shingles").alias("shingles")), "node"))

    # A bucket's number hashes the mark and the segment without one bit; its tag tells which. Equal segments count at bit 0 only, others where they differ.
    # Sets so short that no partner is larger than SHORT meet by their shingles alone.
    parted = nodes.where(F.col("size") >= least * (SHORT + 1) - 1e-9).select("node", "marks", F.posexplode("segments").alias("k", "v"))
    keys = F.array(*[F.shiftleft(F.xxhash64(F.get("marks", F.col("k")), F.col("v").bitwiseAND(~(1 << b))), 16).bitwiseOR((F.col("k") * width + b).cast("long")) for b in range(width)])
    tag = F.col("bucket").bitwiseAND(F.lit(SINGLE)).cast("int")
    one = F.call_function("shiftright", F.col("v"), tag % width).bitwiseAND(1) != 0
    index = parted.select("node", "v", F.explode(keys).alias("bucket")).select("node", "bucket", one.alias("one"))
    index = index.unionByName(rarest_shingles(nodes, least).select("node", F.shiftleft(F.xxhash64("s"), 16).bitwiseOR(F.lit(SINGLE)).alias("bucket"), F.lit(False).alias("one")))
    whole = Window.partitionBy("bucket")
    b = F.when(tag == SINGLE, 0).otherwise(tag % width).alias("b")
    # Where all have the bit, or none, no two differ in it: equal segments would be in all buckets but the first for nothing.
    spread = {"low": F.min("node").over(whole), "high": F.max("node").over(whole), "none": F.min("one").over(whole), "any": F.max("one").over(whole)}
    shared = index.withColumns(spread).select("node", "bucket", b, "one", "low", "high", "none", "any").where("low <> high and (b = 0 or none <> any)")
    member, drop_member = written(shared.select("node", "bucket", "b", "one"))
    collect_shuffles(docs.sparkSession)
    texts = own.withColumn("row", row_hash(key, "_text"))
    plain = nodes.select("node", "least")
    seen = nodes.select("node", F.struct("bits", "size", "shingles").alias("seen"))
    # Members first meet some leaders of their bucket, so that most of a large group is one component.
    order = F.struct(F.xxhash64("node", F.pmod(F.shiftright("bucket", 16), F.lit(LEADERS))).alias("h"), F.col("node").alias("lead"), F.col("one").alias("lead_one"))
    led = member.groupBy("bucket").agg(F.min(order).alias("m")).select("bucket", "m.*")
    met = member.join(led, "bucket").where("node <> lead and (b = 0 or one <> lead_one)")
    chosen = met.select(F.least("node", "lead").alias("left"), F.greatest("node", "lead").alias("right")).distinct()
    wide = chosen.join(seen.toDF("left", "a"), "left").join(seen.toDF("right", "b"), "right")
    near, drop_near = written(wide.where(_near("a", "b", bits, least)).select("left", "right"))
    links = _alike(near, nodes, texts, n, least)
    drop_near()
    roots, drop_roots = written(label_components(plain, links).select("node", "root"))
    # The others of different components meet all; components of most members of a bucket are on one side only.
    placed, drop = written(member.join(roots, "node"))
    drop_member()
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("major"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    # The bits are part of the join's condition: pairs that are too far apart are no rows.
    mixed = placed.join(sizes, "bucket").withColumn("minor", F.col("root") != F.col("major")).join(seen, "node")
    minor = mixed.where("minor").select("bucket", F.col("node").alias("left"), F.col("root").alias("left_root"), F.col("one").alias("left_one"), F.col("seen").alias("a"))
    other = mixed.select("bucket", "b", F.col("node").alias("right"), F.col("root").alias("right_root"), F.col("one").alias("right_one"), F.col("minor").alias("too"), F.col("seen").alias("c"))
    met = (minor["bucket"] == other["bucket"]) & F.expr("left_root <> right_root and (b = 0 or left_one <> right_one) and (not too or left < right)") & _near("a", "c", bits, least)
    near, drop_near = written(minor.join(other, met).select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct())
    links = links.unionByName(_alike(near, nodes, texts, n, least))
    drop_near()
    drop()
    drop_roots()
    known = label_components(plain, links).join(nodes.select("node", "first_row", "n_rows"), "node")
    return slim.select(key, "row", "node"), cut(known.select("node", F.col("least").alias("component_id"), "root", "first_row", "n_rows"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = WORDS, least: float = LEAST, width: int = MARKED, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each component of texts alike, that of the least key.

    Null keys come last; of equal keys in a component the least hash of key and text
    decides, and of rows that repeat both any one stays. Rows of equal or null keys in
    different components are different documents. Null, empty and wordless texts are
    copies of one another.
    """
    columns = docs.columns
    docs, names = numbered_columns(docs)
    text, key = names[text], names[key]
    slim, known = similar_texts(docs, text, key, n, least, width, recall)
    # The root has the component's least key, so the first of its rows is the one that stays.
    parts = slim.join(known, "node").withColumn("stays", (F.col("node") == F.col("root")) & (F.col("row") == F.col("first_row")))
    touched = cut(parts.where("not stays or n_rows > 1").groupBy(F.col("row").alias("_row")).agg(F.max("stays").alias("_stays")))
    held = docs.withColumn("_own", row_hash(key, text))
    met = held.join(touched, F.col("_own") == F.col("_row"), "left")
    # Rows that repeat key and text have one hash; one of them stays.
    alone = met.where(F.col("_row").isNull())
    one = met.where("_stays").dropDuplicates(["_own"])
    return alone.select(*docs.columns).unionByName(one.select(*docs.columns)).toDF(*columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
