"""Quality classifier by compression: dictionaries of good and of bad labelled text.

A text that a dictionary of good text compresses better than one of bad text is
likely good. The text is compressed in short pieces, so that the dictionaries and not
the text itself explain it; the difference of the summed sizes over their sum goes
through a monotone curve fitted on labelled documents that made no dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .calibration import Curve, fit_curve
from .common import fold, read, small_batches, tidy

#: Bytes of a piece; size of a dictionary; compression level.
PIECE, DICTIONARY, LEVEL = 512, 112_640, 3
#: Bound of the sample of labelled rows for each label; characters of the pieces, of all their text, that train a dictionary.
SAMPLE_ROWS, PIECE_CHARS = 4_000, 512
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: Curve


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    def of(raw: bytes) -> zstandard.ZstdCompressor:
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        made = zstandard.ZstdCompressionDict(raw, dict_type=kind)
        made.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=made)

    return of(good), of(bad)


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """(bad - good) / (bad + good) of the compressed sizes, -1 to 1; 0 for null and empty texts."""
    raw = (text or "").encode("utf-8", "replace")
    with_good, with_bad = _compressors(good, bad)
    a = b = 0
    for at in range(0, len(raw), PIECE):
        piece = raw[at : at + PIECE]
        a += len(with_good.compress(piece))
        b += len(with_bad.compress(piece))
    return (b - a) / (b + a) if a + b else 0.0


def _differ(good: bytes, bad: bytes):
    @pandas_udf(DoubleType())
    @tidy
    def differ(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([difference(t, good, bad) for t in batch], index=batch.index, dtype="float64")

    return differ


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` documents of each label that are not held out: doc_id, text, y, part (0 or 1).

    Taken in the order of a hash of doc_id. Only rows with a label take part; of a
    doc_id labelled twice the greater label counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ordered = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    picked = None
    for y in (0, 1):
        some = ordered.where(F.col("y") == y).orderBy("h", "doc_id").limit(rows)
        picked = some if picked is None else picked.unionByName(some)
    # Bounded by 2 * rows.
    chosen = F.broadcast(picked.select(F.col("doc_id").alias("_id"), "y", (F.col("h").bitwiseAND(F.lit(1 << 20)) != 0).cast("int").alias("part")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(chosen, F.col("doc_id") == F.col("_id")).drop("_id")


def label_weights(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> dict[int, float]:
    """How many labelled rows one row of ``labelled_sample`` stands for, by label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return {r["y"]: r["count"] / min(r["count"], rows) for r in known.where("y in (0, 1)").groupBy("y").count().collect()}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Dictionaries from one part of the labelled sample, the curve from the other.

    All text of the sample's rows takes part, so only their number is bounded. Rows that
    repeat a doc_id are all of its label. With too little labelled text for a trained dictionary its raw bytes serve; without
    labels of both kinds the score is the share of label 1, or 0.5 without labels.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(length(text) - 1) div {PIECE_CHARS}"))), lambda i: F.struct(i.alias("i"), F.substring(F.col("text"), i * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("piece")))
    cut = sample.where("part = 1").select("doc_id", "y", F.inline(pieces)).withColumn("h", F.xxhash64("doc_id", "i"))
    raw = {}
    for y in (0, 1):
        got = [r["piece"].encode("utf-8", "replace") for r in cut.where(F.col("y") == y).orderBy("h", "doc_id", "i").select("piece").collect()]
        try:
            raw[y] = zstandard.train_dictionary(DICTIONARY, [p for p in got if p]).as_bytes()
        except (zstandard.ZstdError, ValueError):
            raw[y] = b"".join(got)[-DICTIONARY:] or b"\n"
    good, bad = raw[1], raw[0]
    fitted = sample.where("part = 0").select("y", _differ(good, bad)("text").alias("x")).toPandas()
    return Model(good, bad, fit_curve(fitted["x"].to_numpy(float), fitted["y"].to_numpy(float), label_weights(labels, label)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds size_difference and score (0 to 1) to ``docs``; null and empty texts have the difference 0."""
    curve = model.curve

    @pandas_udf(DoubleType())
    def calibrated(x: pd.Series) -> pd.Series:
        return pd.Series(curve(x.to_numpy(float)), index=x.index)

    return docs.withColumn("size_difference", _differ(model.good, model.bad)(F.col(text))).withColumn("score", calibrated("size_difference"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "size_difference")
