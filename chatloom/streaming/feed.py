"""The message feed: new messages once, revokes with what they revoke, unread counts, periods, replay."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import model

#: How long a message may be seen again, and how far back a revoke may reach.
LOOK_BACK, REVOKE_BACK = "10 minutes", "150 seconds"
#: Seconds of event time that a read may come late.
READ_DELAY = 86400
KEY = ("session_id", "local_id", "create_time")


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msg_events`` as a stream with its event time ``ts``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    kinds = model._event_type()
    return found.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("local_id"), F.unix_timestamp("ts").alias("create_time"), kinds.alias("local_type"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(0).alias("is_send"), F.col("ts").cast("timestamp").alias("ts"))


def new_messages(stream: DataFrame, delay: str = LOOK_BACK) -> DataFrame:
    """Each message once, however often it is seen within ``delay``; older state goes."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*KEY])


def revokes(stream: DataFrame, is_revoke: str, delay: str = REVOKE_BACK) -> DataFrame:
    """Revokes (with ``revoked_id``) joined with their originals of at most ``delay`` before; without one after that time."""
    asked = stream.where(is_revoke).select("session_id", F.col("local_id").alias("revoke_id"), "revoked_id", F.col("ts").alias("revoke_ts")).withWatermark("revoke_ts", delay)
    others = stream.where(f"not ({is_revoke})").select(F.col("session_id").alias("s"), F.col("local_id").alias("original_id"), "content", "ts").withWatermark("ts", delay)
    on = (F.col("s") == F.col("session_id")) & (F.col("original_id") == F.col("revoked_id")) & F.col("ts").between(F.col("revoke_ts") - F.expr(f"interval {delay}"), F.col("revoke_ts"))
    return asked.join(others, on, "leftOuter").drop("s")


def period_counts(stream: DataFrame, period: str, delay: str = LOOK_BACK) -> DataFrame:
    counted = stream.withWatermark("ts", delay).groupBy("session_id", F.window("ts", period).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("session_id", F.unix_timestamp("w.start").alias("period_start"), "n")


def unread(stream: DataFrame) -> DataFrame:
    return stream.groupBy("session_id").agg(F.count_if(F.col("is_send") == 0).alias("unread"))


def unread_since_read(stream: DataFrame, delay: int = READ_DELAY) -> DataFrame:
    """Running unread counts where rows of ``kind`` 'read' reset a session up to their time.

    State of a session: the last read time, the latest time seen, the count of unread
    messages older than ``delay`` seconds before that, and counts by second of newer
    ones, so it holds at most ``delay`` numbers. A read may come ``delay`` seconds of
    event time late; one of an older time than that leaves counts as they are, and a
    message of a time already read counts as read. Rows without a time are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        read_time, latest, settled, seconds, counts = state.get if state.exists else (0, 0, 0, [], [])
        recent, known = Counter(dict(zip(seconds, counts))), latest - delay
        for batch in batches:
            rows = batch[batch["create_time"].notna()]
            latest = max([latest, *map(int, rows["create_time"])])
            read_time = max([read_time, *map(int, rows.loc[rows["kind"] == "read", "create_time"])])
            recent.update(map(int, rows.loc[(rows["kind"] != "read") & (rows["is_send"] == 0), "create_time"]))
        # What is settled lies before the horizon that was known before these rows.
        settled = 0 if read_time >= known else settled
        recent = {t: n for t, n in recent.items() if t > read_time}
        settled += sum(n for t, n in recent.items() if t <= latest - delay)
        recent = {t: n for t, n in recent.items() if t > latest - delay}
        state.update((read_time, latest, settled, list(recent), list(recent.values())))
        yield pd.DataFrame({"session_id": [key[0]], "unread": [settled + sum(recent.values())]})

    kept = "read_time bigint, latest bigint, settled bigint, seconds array<bigint>, counts array<bigint>"
    return stream.groupBy("session_id").applyInPandasWithState(step, "session_id string, unread bigint", kept, "update", "NoTimeout")


def message_events(rows: DataFrame) -> DataFrame:
    """Payloads of the push feed."""
    return rows.select(F.lit("message.new").alias("event"), "session_id", F.concat_ws(":", *[F.col(k).cast("string") for k in KEY]).alias("raw_id"), F.col("content"), F.col("create_time").alias("timestamp"))


def replay(log: DataFrame, last_id: int, now: int, most: int = 1000, seconds: int = 600) -> DataFrame:
    """Logged events after ``last_id`` (0: all) that are among the last ``most`` and not older than ``seconds``."""
    recent = log.where(F.col("timestamp") >= now - seconds).orderBy(F.desc("event_id")).limit(most)
    return recent.where(F.col("event_id") > last_id).orderBy("event_id")


def changed_sessions(changes: DataFrame, tables: DataFrame) -> DataFrame:
    """Sessions whose message tables a batch of changes names; statistics of these are computed anew."""
    return changes.join(tables, "table_name").select("session_id").distinct()


def merge_stats(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Statistics of changed sessions replace the old ones."""
    return old.join(fresh.select("session_id"), "session_id", "left_anti").unionByName(fresh)


def _folder(spark: SparkSession) -> str:
    """A new folder that executors and driver share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="chatloom-")
    return f"{top}/feed-{uuid.uuid4().hex}"


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows, which tasks write as Parquet to the shared folder.

    In complete mode these are the rows of the last batch, in update mode of all.
    """
    spark, top = stream.sparkSession, _folder(stream.sparkSession)
    written: list[str] = []

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{top}/out/{batch}")
        written[:] = [*(written if mode == "update" else []), f"{top}/out/{batch}"]

    sink = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True)
    run = sink.format("parquet").start(f"{top}/out") if mode == "append" else sink.foreachBatch(put).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    if mode == "append" and run.lastProgress is not None:
        written = [f"{top}/out"]
    return spark.read.schema(stream.schema).parquet(*written) if written else spark.createDataFrame([], stream.schema)
