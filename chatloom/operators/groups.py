"""Groups: rankings, hours, media, members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time
from ..functions.text import emoji_tokens, js_length, strip_sender
from ..sources import model as m
from .stats import in_time

MEMBER = ("session_id", "sender")
# Types of messages that are text, and units of a text that counts as a phrase.
TEXTS, PHRASE_UNITS = (m.TEXT, m.QUOTE), 20
# End of fixed values.


def rankings(msgs: DataFrame, begin: int = 0, end: int = 0) -> DataFrame:
    """Messages of each sender of each group."""
    return in_time(msgs, begin, end).groupBy("session_id", "sender").agg(F.count("*").alias("n"))


def ranking(msgs: DataFrame, group: str, limit: int = 20, begin: int = 0, end: int = 0) -> DataFrame:
    return rankings(msgs.where(F.col("session_id") == group), begin, end).orderBy(F.desc("n"), "sender").limit(limit)


def active_hours(msgs: DataFrame) -> DataFrame:
    """All 24 hours of each group."""
    found = msgs.groupBy("session_id", time.hour(F.col("create_time")).alias("hour")).agg(F.count("*").alias("n"))
    every = msgs.select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return every.join(found, ["session_id", "hour"], "left").select("session_id", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def media(msgs: DataFrame) -> DataFrame:
    """Types of each group; all but six of them are -1."""
    kind = F.when(F.col("local_type").isin(1, 3, 34, 43, 47, 49), F.col("local_type")).otherwise(-1).cast("bigint")
    return msgs.groupBy("session_id", kind.alias("local_type")).agg(F.count("*").alias("n"))


def member_stats(msgs: DataFrame) -> DataFrame:
    """Each member of each group: messages, exact active days, first and last time, busiest hour."""
    base = msgs.groupBy("session_id", "sender").agg(F.count("*").alias("n"), F.count_distinct(time.day(F.col("create_time"))).alias("active_days"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))
    by_hour = msgs.groupBy("session_id", "sender", time.hour(F.col("create_time")).alias("hour")).agg(F.count("*").alias("k"))
    busiest = by_hour.groupBy("session_id", "sender").agg(F.max(F.struct("k", (-F.col("hour")).alias("h"))).alias("b")).select("session_id", "sender", (-F.col("b.h")).alias("busiest_hour"))
    return base.join(busiest, ["session_id", "sender"])


def member_phrases(msgs: DataFrame, limit: int = 10, by: tuple[str, ...] = MEMBER) -> DataFrame:
    """A member's most frequent texts of up to 20 units (UTF-16), with their counts; of equally frequent ones the least text."""
    said = _said(msgs, by).where(js_length(F.col("text")).between(1, PHRASE_UNITS))
    return _top(said.groupBy(*by, F.col("text").alias("phrase")).agg(F.count("*").alias("n")), "phrase", limit, by)


def member_emoji(msgs: DataFrame, limit: int = 10, by: tuple[str, ...] = MEMBER) -> DataFrame:
    """A member's most frequent bracketed tokens in texts; each time counts."""
    found = _said(msgs, by).select(*by, F.explode(emoji_tokens(F.col("text"))).alias("token"))
    return _top(found.groupBy(*by, "token").agg(F.count("*").alias("n")), "token", limit, by)


def member_profiles(msgs: DataFrame) -> DataFrame:
    """Each member of each group: messages by kind, active days, first and last time, and the 24 counts of hours, comma-joined. Messages without a time count in the kinds only."""
    kind, at = F.col("local_type"), F.when(F.col("create_time") > 0, F.col("create_time"))
    own = {"text": kind.isin(*TEXTS), "image": kind == m.IMAGE, "voice": kind == m.VOICE, "video": kind == m.VIDEO, "emoji": kind == m.EMOJI}
    counts = [F.count_if(c).alias(k) for k, c in own.items()]
    # Sums by hour and day first, so that exact days need no set of all of a member's messages.
    slim = msgs.groupBy(*MEMBER, F.expr("create_time > 0").alias("_timed"), time.day(at).alias("_day"), time.hour(at).alias("_hour")).agg(F.count("*").alias("total"), *counts, F.min(at).alias("first_time"), F.max(at).alias("last_time"))
    hours = [F.coalesce(F.sum(F.when(F.col("_hour") == h, F.col("total"))), F.lit(0)).cast("string") for h in range(24)]
    whole = slim.groupBy(*MEMBER).agg(*[F.sum(k).alias(k) for k in ("total", *own)], F.count_distinct("_day").alias("active_days"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.concat_ws(",", *hours).alias("hours"))
    return whole.withColumn("other", F.col("total") - sum((F.col(k) for k in own), F.lit(0)))


def _said(msgs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Texts and quoting texts, without a line head that names the sender, trimmed."""
    return msgs.where(F.col("local_type").isin(*TEXTS)).select(*by, F.trim(F.regexp_replace(strip_sender(F.coalesce("content", F.lit(""))), r"^\s+|\s+$", "")).alias("text"))


def _top(counted: DataFrame, what: str, limit: int, by: tuple[str, ...]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), what))
    return counted.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def member_panel(members: DataFrame, names: DataFrame, friends: DataFrame, counts: DataFrame) -> DataFrame:
    """Members with name, owner, friend and count, in no order (see ``member_order``)."""
    known = friends.select("username", F.lit(True).alias("is_friend")).distinct()
    said = counts.select(F.col("session_id").alias("chatroom_id"), F.col("sender").alias("username"), "n")
    joined = members.join(names, "username", "left").join(known, "username", "left").join(said, ["chatroom_id", "username"], "left")
    return joined.select("chatroom_id", "username", F.coalesce("display_name", "username").alias("display_name"), "is_owner", F.coalesce("is_friend", F.lit(False)).alias("is_friend"), F.coalesce("n", F.lit(0)).alias("n"))


def member_order() -> list:
    """Sort keys of a panel: owners, then friends, then who says most, then by name."""
    return [F.desc("is_owner"), F.desc("is_friend"), F.desc("n"), F.asc("display_name"), F.asc("username")]


def group_list(members: DataFrame, sessions: DataFrame) -> DataFrame:
    size = members.groupBy("chatroom_id").agg(F.count("*").alias("members"), F.max(F.when(F.col("is_owner"), F.col("username"))).alias("owner"))
    return size.join(sessions.select(F.col("username").alias("chatroom_id"), "last_timestamp"), "chatroom_id", "left")


def member_page(msgs: DataFrame, group: str, sender: str, limit: int, before: int | None = None) -> DataFrame:
    """A member's messages, latest first, below a local id."""
    mine = msgs.where((F.col("session_id") == group) & (F.col("sender") == sender))
    if before is not None:
        mine = mine.where(F.col("local_id") < before)
    return mine.orderBy(F.desc("local_id")).limit(limit)


def merged_members(members: DataFrame, msgs: DataFrame) -> DataFrame:
    """Listed members and senders together."""
    said = msgs.groupBy(F.col("session_id").alias("chatroom_id"), F.col("sender").alias("username")).agg(F.count("*").alias("n"))
    return members.join(said, ["chatroom_id", "username"], "full").select("chatroom_id", "username", F.coalesce("is_owner", F.lit(False)).alias("is_owner"), F.coalesce("n", F.lit(0)).alias("n"))
