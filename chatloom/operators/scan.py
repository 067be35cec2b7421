"""Scans, pages and lookups of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, time

#: The total order of a session's messages; columns that a table lacks are left out.
TIMELINE = ("create_time", "sort_seq", "local_id", "server_id")


def timeline(df: DataFrame, descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in TIMELINE if c in df.columns]


def scan(msgs: DataFrame, session: str | None = None, begin: int = 0, end: int = 0, ascending: bool = True, local_type: int | None = None) -> DataFrame:
    """Messages of a session, range and type in timeline order; the filters reach the files."""
    out = msgs.where(time.in_range(F.col("create_time"), begin, end))
    if session is not None:
        out = out.where(F.col("session_id") == session)
    if local_type is not None:
        out = out.where(F.col("local_type") == local_type)
    return out.orderBy(*timeline(out, not ascending))


def page(msgs: DataFrame, session: str, limit: int, offset: int = 0, begin: int = 0, end: int = 0, ascending: bool = False) -> DataFrame:
    """One page; sorting stops at limit + offset rows."""
    return scan(msgs, session, begin, end, ascending).offset(offset).limit(limit)


def latest(msgs: DataFrame, session: str, limit: int) -> DataFrame:
    return page(msgs, session, limit)


def after(msgs: DataFrame, session: str, cursor: dict[str, int], limit: int) -> DataFrame:
    """Messages strictly behind a cursor of timeline fields; keyset paging does not slow down with depth."""
    names = [c for c in TIMELINE if c in msgs.columns and c in cursor]
    here = F.struct(*names)
    there = F.struct(*[F.lit(cursor[c]).cast(msgs.schema[c].dataType).alias(c) for c in names])
    return msgs.where((F.col("session_id") == session) & (F.col("create_time") >= cursor["create_time"]) & (here > there)).orderBy(*timeline(msgs)).limit(limit)


def around(msgs: DataFrame, session: str, create_time: int, local_id: int, total: int = 50) -> DataFrame:
    """``total`` messages around one, half of them before it; what one side lacks the other gives."""
    before_wanted, after_wanted = total // 2, total - total // 2
    mine = msgs.where(F.col("session_id") == session)
    key = F.struct("create_time", "local_id")
    target = F.struct(F.lit(create_time).cast("bigint").alias("create_time"), F.lit(local_id).cast("bigint").alias("local_id"))
    older = mine.where(key < target).orderBy(*timeline(mine, True)).limit(total)
    newer = mine.where(key > target).orderBy(*timeline(mine)).limit(total)
    one = Window.partitionBy(F.lit(1))
    rank = lambda df, down: df.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy(*timeline(df, down))))
    # At most 2 * total rows from here on.
    both = rank(older, True).withColumn("side", F.lit("before")).unionByName(rank(newer, False).withColumn("side", F.lit("after")))
    both = both.withColumn("n_before", F.count_if(F.col("side") == "before").over(one)).withColumn("n_after", F.count_if(F.col("side") == "after").over(one))
    before = F.least(F.col("n_before"), before_wanted + F.greatest(F.lit(0), after_wanted - F.col("n_after")))
    behind = F.least(F.col("n_after"), after_wanted + F.greatest(F.lit(0), before_wanted - F.col("n_before")))
    kept = both.where(F.when(F.col("side") == "before", F.col("nth") <= before).otherwise(F.col("nth") <= behind)).select(*msgs.columns, "side")
    return kept.unionByName(mine.where(key == target).withColumn("side", F.lit("target")))


def by_id(msgs: DataFrame, session: str, local_id: int) -> DataFrame:
    return msgs.where((F.col("session_id") == session) & (F.col("local_id") == local_id))


def by_server_id(msgs: DataFrame, session: str, server_id: str) -> DataFrame:
    """Server ids are texts, for they pass 2^63."""
    return msgs.where((F.col("session_id") == session) & (F.col("server_id") == server_id))


def search(msgs: DataFrame, keyword: str, session: str | None = None, begin: int = 0, end: int = 0, limit: int = 50, offset: int = 0) -> DataFrame:
    """Messages with the keyword, letters of either case alike, latest first."""
    out = msgs.where(time.in_range(F.col("create_time"), begin, end) & F.contains(F.lower("content"), F.lit(keyword.lower())))
    if session is not None:
        out = out.where(F.col("session_id") == session)
    return out.orderBy(*[F.col(c).desc() for c in ("create_time", "local_id")], "session_id").offset(offset).limit(limit)


def hydrate(hits: DataFrame, msgs: DataFrame, seconds: int = 1) -> DataFrame:
    """Hits with the detail row of the same local id within ``seconds``: an equality join on buckets of time."""
    width = seconds + 1
    near = hits.withColumn("bucket", F.explode(F.array_distinct(F.array(F.expr(f"(create_time - {seconds}) div {width}"), F.expr(f"(create_time + {seconds}) div {width}")))))
    detail = msgs.select("session_id", "local_id", F.col("create_time").alias("detail_time"), F.col("sender").alias("detail_sender"), F.expr(f"create_time div {width}").alias("bucket"))
    return near.join(detail, ["session_id", "local_id", "bucket"], "left").where(F.col("detail_time").isNull() | (F.abs(F.col("detail_time") - F.col("create_time")) <= seconds)).drop("bucket").dropDuplicates(["session_id", "local_id", "create_time"])


def media(msgs: DataFrame, kinds: tuple[str, ...] = ("image", "video"), begin: int = 0, end: int = 0, limit: int = 100, offset: int = 0) -> DataFrame:
    """Media of all sessions, latest first."""
    content = F.col("content") if "content" in msgs.columns else F.lit(None).cast("string")
    found = msgs.where(time.in_range(F.col("create_time"), begin, end)).withColumn("kind", labels.resource_kind(F.col("local_type"), content)).where(F.col("kind").isin(*kinds))
    return found.orderBy(F.desc("create_time"), F.desc("local_id"), "session_id").offset(offset).limit(limit)


def visible(msgs: DataFrame) -> Column:
    """Groups show all; private sessions what the other or oneself sent."""
    return F.contains("session_id", F.lit("@chatroom")) | F.col("sender").isNull() | (F.col("sender") == F.col("session_id")) | (F.col("is_send") == 1)


def shard_stats(msgs: DataFrame) -> DataFrame:
    """Rows and times of each file."""
    return msgs.select("create_time", F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("n"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))


def same_second_index(msgs: DataFrame, local_type: int) -> DataFrame:
    """Position, from 0, of a message among those of its type and second."""
    within = Window.partitionBy("session_id", "create_time").orderBy("local_id")
    return msgs.where(F.col("local_type") == local_type).withColumn("nth", F.dense_rank().over(within) - 1)


def run_sql(spark: SparkSession, views: dict[str, DataFrame], text: str, args: dict | None = None) -> DataFrame:
    """SQL over named frames with bound parameters."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})


def message_key() -> Column:
    return F.concat_ws(":", "session_id", F.col("create_time").cast("string"), F.col("local_id").cast("string"))
