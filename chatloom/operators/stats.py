"""Counts of messages by session, type and time. Every function is one aggregation with map-side sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, time
from ..functions.text import percent
from ..sources import model as m



def sent() -> Column:
    return F.col("is_send") == 1


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), F.count_if(sent()).alias("sent"), F.count_if(~sent()).alias("received")]


def in_time(msgs: DataFrame, begin: int = 0, end: int = 0) -> DataFrame:
    return msgs.where(time.in_range(F.col("create_time"), begin, end))


def by_session(msgs: DataFrame, begin: int = 0, end: int = 0) -> DataFrame:
    return in_time(msgs, begin, end).groupBy("session_id").agg(*_counts(), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))


def contact_ranking(msgs: DataFrame, names: DataFrame, limit: int = 20, begin: int = 0, end: int = 0) -> DataFrame:
    """Sessions of most messages with their display names; the top is cut before names are looked up."""
    top = by_session(msgs, begin, end).orderBy(F.desc("total"), "session_id").limit(limit)
    named = top.join(names.select(F.col("username").alias("session_id"), "display_name"), "session_id", "left")
    return named.withColumn("display_name", F.coalesce("display_name", "session_id")).select("session_id", "display_name", "total", "sent", "received", "last_time").orderBy(F.desc("total"), "session_id")


def overall(msgs: DataFrame, begin: int = 0, end: int = 0) -> DataFrame:
    """One row; active days are exact, and the estimate of 20 days a month is a column of its own."""
    kind = F.col("local_type")
    day = time.day(F.col("create_time"))
    return in_time(msgs, begin, end).agg(
        *_counts(), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"),
        F.count_if(kind.isin(m.TEXT, m.QUOTE)).alias("text"), F.count_if(kind == m.IMAGE).alias("image"), F.count_if(kind == m.VOICE).alias("voice"), F.count_if(kind == m.VIDEO).alias("video"), F.count_if(kind == m.EMOJI).alias("emoji"),
        F.count_if(~kind.isin(m.TEXT, m.QUOTE, m.IMAGE, m.VOICE, m.VIDEO, m.EMOJI)).alias("other"),
        F.count_distinct(day).alias("active_days"), (F.count_distinct(time.month_key(F.col("create_time"))) * 20).alias("active_days_estimate"), F.count_distinct("session_id").alias("sessions"),
    ).withColumn("duration_days", F.expr("(last_time - first_time) div 86400 + 1")).withColumn("per_day", F.floor(F.col("total") / F.col("duration_days") * 10 + 0.5) / 10)


def type_distribution(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("local_type").agg(F.count("*").alias("n")).withColumn("label", labels.type_name(F.col("local_type")))


def _filled(msgs: DataFrame, key: Column, first: int, last: int, name: str) -> DataFrame:
    found = msgs.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    every = msgs.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(name))
    return every.join(found, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def hours(msgs: DataFrame) -> DataFrame:
    return _filled(msgs, time.hour(F.col("create_time")), 0, 23, "hour")


def weekdays(msgs: DataFrame) -> DataFrame:
    return _filled(msgs, time.weekday(F.col("create_time")), 1, 7, "weekday")


def months(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy(time.month_key(F.col("create_time")).alias("month")).agg(F.count("*").alias("n"))


def days(msgs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return msgs.groupBy(*by, time.day_key(F.col("create_time")).alias("day")).agg(F.count("*").alias("n"))


def self_sent_days(msgs: DataFrame) -> DataFrame:
    return msgs.where(sent()).groupBy(time.day_key(F.col("create_time")).alias("day")).agg(F.count("*").alias("n"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))


def days_filled(msgs: DataFrame, most: int = 5000) -> DataFrame:
    """Days from first to last, silent ones with 0; beyond ``most`` days only those with messages."""
    found = msgs.groupBy(time.day(F.col("create_time")).alias("d")).agg(F.count("*").alias("n"))
    ends = found.agg(F.min("d").alias("a"), F.max("d").alias("b")).where(F.date_diff("b", "a") < most)
    gaps = ends.select(F.explode(F.sequence("a", "b")).alias("d"), F.lit(0).cast("bigint").alias("n"))
    return found.unionByName(gaps).groupBy("d").agg(F.sum("n").alias("n")).select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n")


def session_types(msgs: DataFrame, begin: int = 0, end: int = 0) -> DataFrame:
    """Counts by type for each session; distinct senders where the table has them."""
    kind, content = F.col("local_type"), F.col("content") if "content" in msgs.columns else F.lit(None).cast("string")
    extra = [F.count_distinct("sender").alias("senders")] if "sender" in msgs.columns else []
    app = labels.app_type(content)
    return in_time(msgs, begin, end).groupBy("session_id").agg(
        F.count("*").alias("total"), F.count_if(sent()).alias("mine"), F.count_if(kind == m.VOICE).alias("voice"), F.count_if(kind == m.IMAGE).alias("image"), F.count_if(kind == m.VIDEO).alias("video"), F.count_if(kind == m.EMOJI).alias("emoji"),
        F.count_if(labels.is_file(kind, content)).alias("file"), F.count_if(kind == m.CALL).alias("call"), F.count_if((kind == m.TRANSFER) | ((kind == m.APP) & (app == 2000))).alias("transfer"), F.count_if((kind == m.RED_PACKET) | ((kind == m.APP) & (app == 2001))).alias("red_packet"),
        F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"), *extra,
    )


def years(msgs: DataFrame) -> DataFrame:
    """Years with messages."""
    return msgs.select(F.year(time.moment(F.col("create_time"))).alias("year")).distinct()


def years_spanned(msgs: DataFrame, first: int = 2010, last: int = 2100) -> DataFrame:
    """Every year from the first message's to the last's, within bounds."""
    y = F.year(time.moment(F.col("create_time")))
    ends = msgs.agg(F.greatest(F.min(y), F.lit(first)).alias("a"), F.least(F.max(y), F.lit(last)).alias("b")).where("a <= b")
    return ends.select(F.explode(F.sequence("a", "b")).alias("year"))


def export_estimate(msgs: DataFrame, transcribed: DataFrame, seconds_each: int = 2) -> DataFrame:
    """What an export holds and how long its transcriptions take; ``transcribed`` has session_id and local_id."""
    voice = F.col("local_type") == m.VOICE
    done = msgs.where(voice).join(transcribed.select("session_id", "local_id").distinct(), ["session_id", "local_id"], "left_semi").agg(F.count("*").alias("cached"))
    kinds = msgs.agg(F.count("*").alias("total"), F.count_if(voice).alias("voice"), F.count_if(F.col("local_type").isin(m.VOICE, m.IMAGE, m.VIDEO, m.EMOJI)).alias("media"))
    return kinds.crossJoin(done).select("total", "voice", "media", "cached", (F.col("voice") - F.col("cached")).alias("to_transcribe"), ((F.col("voice") - F.col("cached")) * seconds_each).alias("seconds"))


def share(part: Column, whole: Column) -> Column:
    return percent(part, whole)
