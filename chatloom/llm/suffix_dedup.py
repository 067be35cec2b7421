"""Suffix-array dedup on a sparse suffix array.

Suffixes are kept only where content selects them: for a passage of LEAST words the
start of its minimiser, the word run of the least hash among the passage's first
WINDOW runs. Equal passages select the same suffix, and its next CORE words lie in
the passage. Suffixes are not sorted: grouping by a hash of those words brings equal
ones together (the runs of the suffix array with that long a common prefix); only
those that have an equal one go on. A hash of their extension, left as far as the
passages that select the suffix reach and right to LEAST words, is compared. Where all neighbours have the same extension,
that is one row; elsewhere every passage of LEAST words is compared by itself. So
exactly the passages of LEAST words that stand at two or more places are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import byte_words, cut, maybe_among, numbered_columns, read, small_batches, tidy, written, WORD

LEAST, WINDOW, RUN = 50, 40, 4
LAST = 9223372036854775807
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SUFFIXES = ArrayType(StructType([StructField(n, LongType()) for n in ("core", "extended", "pos", "first", "last")]))


def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, byte_words(text)), np.uint64)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` successive words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out = out * _MULTIPLIER + hashes[i : i + len(out)]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def selected(hashes: np.ndarray, least: int = LEAST, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first passage, last passage): passages by start, and each that they share."""
    n = len(hashes) - least + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3
    runs = rolled(hashes, run)
    at = np.empty(n, np.int64)
    for begin in range(0, n, 65_536):  # bounded memory for very long texts
        end = min(n, begin + 65_536)
        at[begin:end] = np.lib.stride_tricks.sliding_window_view(runs[begin : end + window - 1], window).argmin(1) + np.arange(begin, end)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[starts], starts, np.r_[starts[1:], n] - 1


def suffixes_of(text: str | None, least: int = LEAST, window: int = WINDOW, run: int = RUN) -> list[tuple]:
    """(core, extended, pos, first, last) of each selected suffix.

    ``core`` hashes the least - window + 1 words from the suffix on; ``extended`` all
    words of the passages that select it and where the suffix lies in them.
    """
    hashes = word_hashes(text)
    pos, first, last = selected(hashes, least, window, run)
    if not len(pos):
        return []
    core = rolled(hashes, least - window + 1)[pos]
    one = rolled(hashes, least)
    # Passages overlap, so a hash of the first, the last and the number of them, and those between in strides, has all words.
    extended = one[first] * _MULTIPLIER + one[last]
    extended = mixed(extended + ((pos - first) * (window + 1) + (last - first)).astype(np.uint64) * _MIX)
    return list(zip(core.view(np.int64).tolist(), extended.view(np.int64).tolist(), pos.tolist(), first.tolist(), last.tolist()))


def _suffixes(least: int, window: int, run: int):
    @pandas_udf(SUFFIXES)
    @tidy
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([suffixes_of(t, least, window, run) for t in batch], index=batch.index)

    return find


def _passages(least: int):
    @pandas_udf(ArrayType(StructType([StructField("passage", LongType()), StructField("first", LongType())])))
    @tidy
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            rows = []
            for text, asked in zip(texts, spans):
                one = rolled(word_hashes(text), least).view(np.int64)
                starts = np.unique(np.concatenate([np.arange(s["first"], s["last"] + 1) for s in asked]))
                rows.append(list(zip(one[starts].tolist(), starts.tolist())))
            yield pd.Series(rows, index=texts.index)

    return of


def numbered(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds ``_row``, another number for each row: a hash of key and text, and of the copy where rows repeat both."""
    named = docs.withColumn("_row", F.xxhash64(F.col(key).isNull(), F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))))
    twice = cut(named.groupBy("_row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_row").alias("_twice")))
    if twice.isEmpty():
        return named
    held = named.withColumn("_held", maybe_among(twice, "_twice")(F.col("_row")))
    met = held.where("_held").join(twice, F.col("_row") == F.col("_twice"), "left")
    copy = F.when(F.col("_twice").isNotNull(), F.xxhash64("_row", F.monotonically_increasing_id())).otherwise(F.col("_row"))
    # Cut, as the numbers of copies are not the same when they are computed again.
    copies = cut(met.select(*docs.columns, copy.alias("_row")))
    return held.where("not _held").select(*docs.columns, "_row").unionByName(copies)


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """Rows (key, row, first, last, again): passages of ``least`` words, by the first word of the first and of the last of them, that stand elsewhere too.

    ``again`` is false at the least place, by key, row and position; null keys come
    last. Every row is a document of its own, whatever its key; rows that repeat key
    and text as well, in any order.
    """
    return _repeated(numbered(docs.select(key, text), text, key), text, key, least, window, run)


def _repeated(rows: DataFrame, text: str, key: str, least: int, window: int = WINDOW, run: int = RUN) -> DataFrame:
    small_batches(rows.sparkSession)
    own = rows.select(F.col(key).cast("long").alias("doc"), F.col("_row").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    place = F.struct(F.coalesce("doc", F.lit(LAST)).alias("doc"), F.col("doc").isNull().alias("none"), "row", "pos")
    found, drop_found = written(own.select("doc", "row", F.inline(_suffixes(least, window, run)("body"))))
    groups = found.groupBy("core").agg(F.count("*").alias("n"), F.min("extended").alias("low"), F.max("extended").alias("high"), F.min(place).alias("least"))
    # Written, so that both sides of the join are plain shuffles, whose skewed partitions Spark splits.
    groups, drop_groups = written(groups.where("n > 1").select("core", (F.col("low") == F.col("high")).alias("alike"), "least"))
    shared, drop_shared = written(found.join(groups, "core").select("doc", "row", "first", "last", "alike", (place != F.col("least")).alias("again")))
    drop_found()
    drop_groups()
    asked = shared.where("not alike").groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans")).withColumnRenamed("row", "_asked")
    meant = own.where(maybe_among(shared.where("not alike"), "row")(F.col("row")))
    hashed = meant.join(asked, F.col("row") == F.col("_asked")).select("doc", "row", F.inline(_passages(least)("body", "spans")))
    passages, drop_passages = written(hashed.withColumnRenamed("first", "pos"))
    counted, drop_counted = written(passages.groupBy("passage").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1").drop("n"))
    single = passages.join(counted, "passage").select("doc", "row", F.col("pos").alias("first"), F.col("pos").alias("last"), (place != F.col("least")).alias("again"))
    whole = shared.where("alike").select("doc", "row", "first", "last", "again")
    result = written(whole.unionByName(single).withColumnRenamed("doc", key))[0]
    drop_shared()
    drop_passages()
    drop_counted()
    return result


def spans(passages: DataFrame, key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Unites overlapping and touching passages of each row: key, row, start, stop (words from 0, stop excluded)."""
    within = Window.partitionBy("row").orderBy("first", "last")
    reach = F.max(F.col("last") + least).over(within.rowsBetween(Window.unboundedPreceding, -1))
    opened = passages.withColumn("opens", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("island", F.sum("opens").over(within))
    return opened.groupBy("row", "island").agg(F.first(key).alias(key), F.min("first").alias("start"), (F.max("last") + least).alias("stop")).drop("island")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """One row for each document with a repeated passage: key, spans and cut_spans (arrays of start, stop).

    ``spans`` are all words in repeated passages; ``cut_spans`` those in passages that
    stand at an earlier place too. Texts of fewer than ``least`` words, empty and null
    ones have none. Whole documents that repeat are passages like others, and rows of
    equal or null keys are documents like others.
    """
    return _spans_of(numbered(docs.select(key, text), text, key), text, key, least).drop("row")


def _spans_of(rows: DataFrame, text: str, key: str, least: int) -> DataFrame:
    found = _repeated(rows, text, key, least)
    listed = F.sort_array(F.collect_list(F.struct("start", "stop")))
    every = spans(found, key, least).groupBy("row").agg(F.first(key).alias(key), listed.alias("spans"))
    later = spans(found.where("again"), key, least).groupBy("row").agg(listed.alias("cut_spans"))
    return every.join(later, "row", "left").withColumn("cut_spans", F.coalesce("cut_spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")))


@pandas_udf(StringType())
def without_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words of the spans and the white space behind each."""

    def one(text: str | None, asked) -> str | None:
        if text is None or asked is None or not len(asked):
            return text
        at = [(m.start(), m.end()) for m in WORD.finditer(text)]
        out, done = [], 0
        for s in asked:
            start, stop = s["start"], s["stop"]
            out.append(text[done : at[start][0]])
            done = at[stop][0] if stop < len(at) else len(text)
        return "".join(out) + text[done:]

    return pd.Series([one(t, s) for t, s in zip(texts, spans)], index=texts.index)


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut from the texts.

    A document of which no word is left goes; one that had no words stays. An integer
    column n_chars, where there is one, gets the new length.
    """
    originals = docs.columns
    docs, names = numbered_columns(docs)
    text, key, size = names[text], names[key], names.get("n_chars")
    rows = numbered(docs, text, key)
    found = cut(_spans_of(rows, text, key, least).select(F.col("row").alias("_found"), F.col("cut_spans").alias("_cut")).where(F.size("_cut") > 0))
    held = rows.withColumn("_held", maybe_among(found, "_found")(F.col("_row")))
    joined = held.where("_held").join(found, F.col("_row") == F.col("_found"), "left")
    changed = joined.withColumn("_new", F.when(F.col("_cut").isNotNull(), without_spans(F.col(text), F.col("_cut"))))
    kept = changed.where(F.col("_cut").isNull() | F.rlike("_new", F.lit(r"[^\x20\x09-\x0D]")))
    columns = [F.coalesce("_new", text).alias(text) if c == text else F.when(F.col("_new").isNotNull(), F.length("_new").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == size else F.col(c) for c in docs.columns]
    return kept.select(*columns).unionByName(held.where("not _held").select(*docs.columns)).toDF(*originals)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), words(F.col("spans")).alias("n_repeat_words"), words(F.col("cut_spans")).alias("n_cut_words"), text.alias("spans"))


def op8_sql() -> str:
    def islands(name: str, where: str) -> str:
        return f"""
o_{name} as (
  select doc_id, i, case when i <= max(i + {LEAST}) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens
  from p where c > 1 {where}),
g_{name} as (select doc_id, i, sum(opens) over (partition by doc_id order by i) as g from o_{name}),
s_{name} as (select doc_id, min(i) as a, max(i) + {LEAST} as b from g_{name} group by doc_id, g)"""

    return rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
q as (
  select doc_id, i, md5(array_to_string(ws[i + 1:i + {LEAST}], ' ')) as h
  from (select doc_id, ws, unnest(range(len(ws) - {LEAST - 1})) as i from w where len(ws) >= {LEAST})),
p as (select doc_id, i, count(*) over (partition by h) as c, row_number() over (partition by h order by doc_id, i) as nth from q),
{islands('every', '').strip()},{islands('later', 'and nth > 1')},
e as (select doc_id, count(*) as n_spans, cast(sum(b - a) as bigint) as n_repeat_words, string_agg(a || '-' || b, ',' order by a) as spans from s_every group by doc_id),
l as (select doc_id, cast(sum(b - a) as bigint) as n from s_later group by doc_id)
select doc_id, n_spans, n_repeat_words, coalesce(n, 0) as n_cut_words, spans from e left join l using (doc_id)"""
