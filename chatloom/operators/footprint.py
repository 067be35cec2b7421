"""What concerned me in a period: private sessions, exchanges, mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import at_users, reply_rate
from .stats import in_time, sent


def private_rows(msgs: DataFrame, begin: int = 0, end: int = 0) -> DataFrame:
    kept = in_time(msgs, begin, end).where(~F.contains("session_id", F.lit("@chatroom")))
    return kept.groupBy("session_id").agg(F.count_if(~sent()).alias("incoming"), F.count_if(sent()).alias("outgoing"), F.max("create_time").alias("latest"), F.min(F.when(~sent(), F.col("create_time"))).alias("first_incoming"), F.max(F.when(sent(), F.col("create_time"))).alias("last_reply"))


def mentions(msgs: DataFrame, me: list[str], begin: int = 0, end: int = 0, limit: int = 1000) -> DataFrame:
    """Group messages of others whose at-list names me, latest first; a cheap look goes before the list is read."""
    ids = F.array(*[F.lit(x.lower()) for x in me])
    kept = in_time(msgs, begin, end).where(F.contains("session_id", F.lit("@chatroom")) & ~sent() & F.contains("source", F.lit("atuserlist")))
    named = kept.where(F.arrays_overlap(F.transform(at_users(F.col("source")), lambda x: F.lower(x)), ids))
    return named.orderBy(F.desc("create_time"), F.desc("local_id"), "session_id").limit(limit)


def mention_groups(found: DataFrame) -> DataFrame:
    return found.groupBy("session_id").agg(F.count("*").alias("n"), F.max("create_time").alias("latest"))


def summary(msgs: DataFrame, begin: int = 0, end: int = 0) -> DataFrame:
    rows = private_rows(msgs, begin, end)
    people = rows.agg(F.count_if(F.col("incoming") > 0).alias("inbound"), F.count_if((F.col("incoming") > 0) & (F.col("outgoing") > 0)).alias("replied"), F.count_if(F.col("outgoing") > 0).alias("outbound"))
    return people.withColumn("reply_rate", reply_rate(F.col("replied"), F.col("inbound")))


def merged_mentions(base: DataFrame, more: DataFrame) -> DataFrame:
    return base.unionByName(more).dropDuplicates(["session_id", "local_id", "create_time"])
