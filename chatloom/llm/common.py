"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of the six ASCII white-space characters part words.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master (tests) and an error on a cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="chatloom-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows and bytes of texts that go to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches, where they are larger: whole texts, some very long, go to Python."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Gives freed memory of a Python worker back to the system (where the C library can), as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(function):
    """Makes an iterator function give memory back at the end of its partition."""

    @wraps(function)
    def run(batches):
        yield from function(batches)
        gc.collect()
        give_back()

    return run


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and cuts its lineage; the files stay unless spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a compressed table in the shared folder, and a function that removes it once no plan reads it any more.

    A table that is not removed before goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(path)
    files.deleteOnExit(place)

    def drop() -> None:
        files.delete(place, True)

    return spark.read.schema(df.schema).parquet(path), drop


def collect_shuffles(spark: SparkSession) -> None:
    """Lets the driver see which shuffles no plan needs any more, so that Spark removes their files after a large step."""
    gc.collect()
    spark._jvm.System.gc()


#: Bits of the filter of ``maybe_among``: 1 MB, however many keys there are.
FILTER_BITS = 23


def maybe_among(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that all of ``keys`` pass and few others do, as long as they are not very many.

    It spares rows without a partner the shuffle of a join; the join itself decides.
    At most 256 rows of 4 KB come to the driver.
    """
    at = F.xxhash64(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    parts = keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts.collect():
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    packed = bits.tobytes()

    @pandas_udf(BooleanType())
    def held(at: pd.Series) -> pd.Series:
        x = at.to_numpy(np.int64)
        return pd.Series((np.frombuffer(packed, np.uint8)[x >> 3] >> (x & 7)) & 1 == 1, index=at.index)

    return lambda column: held(F.xxhash64(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)))


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named in0, in1, ..., that no inner name clashes with, and the new name of each."""
    names = {c: f"in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all cores, where its bytes alone would let Spark read it in too few tasks for the rows it is about to make."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only when ``df`` was counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """Hints a join that shuffles ``df``: where rows are exploded after a shuffle, Spark takes the bytes before the explode for their size, and the compressed files of a written table for its rows."""
    return df.hint("merge")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys of both sides where null meets null; the result has the left side's keys."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, on=on, how=how).drop(*[f"_right_{k}" for k in keys])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, even where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, without empty ones; of null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words in UTF-8 (bytes are split at the same six characters); ``lower`` lower-cases A-Z only."""
    raw = (text or "").encode("utf-8", "replace")
    return (raw.lower() if lower else raw).split()


def fold(doc_id: Column) -> Column:
    """The remainder that holds rows out: of 0..3, 2 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
