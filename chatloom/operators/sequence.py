"""What needs the order of a session's messages: gaps, answers, streaks, phrases, friends.

A session may hold a third of all messages, so neighbours are found in windows of a
session's time buckets, and what crosses a bucket's edge is carried by a table of one
row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time
from ..functions.text import is_phrase, percent
from .stats import sent

GAP, SEGMENT_GAP, HOUR, DAY, BUCKET = 3600, 300, 3600, 86400, 30 * 86400
ORDER = ("create_time", "local_id")


def with_previous(msgs: DataFrame, columns: tuple[str, ...] = ("create_time", "is_send"), bucket: int = BUCKET) -> DataFrame:
    """Adds struct ``prev`` of the session's message before, null for the first."""
    cut = msgs.withColumn("_bucket", F.expr(f"create_time div {bucket}"))
    within = Window.partitionBy("session_id", "_bucket").orderBy(*ORDER)
    near = cut.withColumn("_near", F.lag(F.struct(*columns)).over(within))
    tails = cut.groupBy("session_id", "_bucket").agg(F.max(F.struct(*ORDER, *[F.col(c).alias(f"v_{c}") for c in columns])).alias("_tail"))
    carried = tails.withColumn("_before", F.lag("_tail").over(Window.partitionBy("session_id").orderBy("_bucket"))).where("_before is not null")
    carried = carried.select("session_id", "_bucket", F.struct(*[F.col(f"_before.v_{c}").alias(c) for c in columns]).alias("_far"))
    return near.join(carried, ["session_id", "_bucket"], "left").withColumn("prev", F.coalesce("_near", "_far")).drop("_near", "_far", "_bucket")


def with_opening(msgs: DataFrame, gap: int, bucket: int = BUCKET) -> DataFrame:
    """Adds ``opening``: the time of the latest message that came more than ``gap`` seconds after its predecessor."""
    opens = with_previous(msgs, ("create_time",), bucket).withColumn("_open", F.when(F.col("prev").isNull() | (F.col("create_time") - F.col("prev.create_time") > gap), F.col("create_time"))).drop("prev")
    opens = opens.withColumn("_bucket", F.expr(f"create_time div {bucket}"))
    within = Window.partitionBy("session_id", "_bucket").orderBy("create_time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = opens.withColumn("_near", F.max("_open").over(within))
    tails = opens.groupBy("session_id", "_bucket").agg(F.max("_open").alias("_top"))
    earlier = Window.partitionBy("session_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("session_id", "_bucket", F.max("_top").over(earlier).alias("_far"))
    return near.join(carried, ["session_id", "_bucket"], "left").withColumn("opening", F.coalesce("_near", "_far")).drop("_near", "_far", "_open", "_bucket")


def conversation_starts(msgs: DataFrame, gap: int = GAP) -> DataFrame:
    """Conversations that each side began: after no message, or more than ``gap`` seconds of silence."""
    begins = with_previous(msgs).where(F.col("prev").isNull() | (F.col("create_time") - F.col("prev.create_time") > gap))
    return begins.groupBy("session_id").agg(F.count_if(sent()).alias("initiated"), F.count_if(~sent()).alias("received"))


def social_initiative(msgs: DataFrame, gap: int = GAP) -> DataFrame:
    """One row: who begins how often, and the session that one begins most."""
    starts = conversation_starts(msgs, gap)
    best = starts.where("initiated > 0").orderBy(F.desc("initiated"), "session_id").limit(1).select(F.col("session_id").alias("top_session"), F.col("initiated").alias("top_initiated"))
    whole = starts.agg(F.coalesce(F.sum("initiated"), F.lit(0)).alias("initiated"), F.coalesce(F.sum("received"), F.lit(0)).alias("received"))
    return whole.join(best, F.lit(True), "left").withColumn("initiative", percent(F.col("initiated"), F.col("initiated") + F.col("received")))


def response_times(msgs: DataFrame, gap: int = GAP, least: int = 10) -> DataFrame:
    """Average seconds that one takes to answer, for sessions with ``least`` answers within ``gap``."""
    wait = F.col("create_time") - F.col("prev.create_time")
    answers = with_previous(msgs).where(sent() & (F.col("prev.is_send") == 0) & (wait > 0) & (wait <= gap) & (wait < DAY))
    return answers.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(wait).alias("seconds")).where(F.col("n") >= least).withColumn("average", F.col("seconds") / F.col("n"))


def heatmap(msgs: DataFrame) -> DataFrame:
    """All 7 x 24 cells, Monday 0."""
    t = time.moment(F.col("create_time"))
    found = msgs.groupBy(F.weekday(t).alias("weekday"), F.hour(t).alias("hour")).agg(F.count("*").alias("n"))
    every = msgs.sparkSession.range(168).select(F.expr("cast(id div 24 as int)").alias("weekday"), F.expr("cast(id % 24 as int)").alias("hour"))
    return every.join(found, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def midnight_king(msgs: DataFrame) -> DataFrame:
    """The session of most messages from 0 to 6, with its share of all such messages."""
    found = msgs.where(time.hour(F.col("create_time")) < 6).groupBy("session_id").agg(F.count("*").alias("n"))
    whole = found.agg(F.sum("n").alias("all_n"))
    return found.orderBy(F.desc("n"), "session_id").limit(1).crossJoin(whole).select("session_id", "n", percent(F.col("n"), F.col("all_n")).alias("share"))


def streaks(msgs: DataFrame) -> DataFrame:
    """Every run of successive days of a session: first and last day, and days. At most one row a day reaches the window."""
    active = msgs.select("session_id", time.day(F.col("create_time")).alias("d")).distinct()
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("d"))
    runs = active.withColumn("run", F.date_sub("d", nth)).groupBy("session_id", "run").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("days"))
    return runs.drop("run")


def longest_streaks(msgs: DataFrame) -> DataFrame:
    """The longest run of each session, the first of equals."""
    best = F.max(F.struct("days", F.date_diff(F.lit("2200-01-01").cast("date"), "first_day").alias("early"), "first_day", "last_day")).alias("b")
    return streaks(msgs).groupBy("session_id").agg(best).select("session_id", F.col("b.days").alias("days"), F.date_format("b.first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("b.last_day", "yyyy-MM-dd").alias("last_day"))


def peak_day(msgs: DataFrame) -> DataFrame:
    """The day of most messages, the first of equals, and its top session."""
    by = msgs.groupBy(time.day_key(F.col("create_time")).alias("day"), "session_id").agg(F.count("*").alias("n"))
    top = by.groupBy("day").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "day").limit(1)
    return by.join(F.broadcast(top), "day").orderBy(F.desc("n"), "session_id").limit(1).select("day", "total", F.col("session_id").alias("top_session"), F.col("n").alias("top_n"))


def core_friends(msgs: DataFrame, limit: int = 3) -> DataFrame:
    return msgs.groupBy("session_id").agg(F.count("*").alias("total"), F.count_if(sent()).alias("sent"), F.count_if(~sent()).alias("received")).orderBy(F.desc("total"), "session_id").limit(limit)


def monthly_top(msgs: DataFrame) -> DataFrame:
    """The top session of each calendar month; years are taken together."""
    by = msgs.groupBy(F.month(time.moment(F.col("create_time"))).alias("month"), "session_id").agg(F.count("*").alias("n"))
    first = by.groupBy("month").agg(F.max("n").alias("n"))
    return by.join(first, ["month", "n"]).groupBy("month").agg(F.min("session_id").alias("session_id"), F.first("n").alias("n"))


def mutual_friend(msgs: DataFrame, least: int = 50) -> DataFrame:
    """The most even exchange of at least so many messages each way."""
    by = msgs.groupBy("session_id").agg(F.count_if(sent()).alias("sent"), F.count_if(~sent()).alias("received")).where((F.col("sent") >= least) & (F.col("received") >= least))
    return by.withColumn("ratio", F.col("sent") / F.col("received")).withColumn("off", F.abs(F.col("ratio") - 1)).orderBy("off", "session_id").limit(1).drop("off")


def lost_friend(msgs: DataFrame, begin: int, middle: int, end: int, least: int, fall: int = 5) -> DataFrame:
    """Most messages early and over ``fall`` times as many as late; both halves include the middle."""
    t = F.col("create_time")
    by = msgs.groupBy("session_id").agg(F.count_if(t.between(begin, middle)).alias("early"), F.count_if(t.between(middle, end)).alias("late"))
    return by.where((F.col("early") > least) & (F.col("early") > fall * F.col("late"))).orderBy(F.desc("early"), "session_id").limit(1)


def phrases(msgs: DataFrame, least: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    text = F.trim("content")
    return msgs.where((F.col("local_type") == 1) & is_phrase(F.col("content"))).groupBy(*by, text.alias("phrase")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def top_phrases(msgs: DataFrame, limit: int = 32) -> DataFrame:
    return phrases(msgs.where(sent())).orderBy(F.desc("n"), "phrase").limit(limit)


def exclusive_phrases(msgs: DataFrame, limit: int = 20, least: int = 2, part: float = 0.75, without: tuple[str, ...] = ()) -> DataFrame:
    """Phrases that one side of all sessions says almost alone: side, phrase, own and other count."""
    text = F.trim("content")
    by = msgs.where((F.col("local_type") == 1) & is_phrase(F.col("content"))).groupBy(text.alias("phrase")).agg(F.count_if(sent()).alias("mine"), F.count_if(~sent()).alias("theirs"))
    if without:
        by = by.where(~F.col("phrase").isin(*without))
    sides = []
    for side, own, other in (("mine", "mine", "theirs"), ("theirs", "theirs", "mine")):
        one = by.where((F.col(own) >= least) & (F.col(own) >= part * (F.col(own) + F.col(other))))
        sides.append(one.orderBy(F.desc(own), "phrase").limit(limit).select(F.lit(side).alias("side"), "phrase", F.col(own).alias("own"), F.col(other).alias("other")))
    return sides[0].unionByName(sides[1])


def first_messages(msgs: DataFrame, limit: int = 10, begin: int = 0, end: int = 0) -> DataFrame:
    """The first messages of each session; a window with this filter keeps only so many rows of a task's input."""
    kept = msgs.where(time.in_range(F.col("create_time"), begin, end))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(*ORDER))
    return kept.withColumn("nth", nth).where(F.col("nth") <= limit)


def segments(msgs: DataFrame, begin: int = 0, end: int = 0, gap: int = SEGMENT_GAP) -> DataFrame:
    """Exchanges without a silence of more than ``gap`` seconds: counts, first incoming message, first reply behind it.

    An exchange may last for years, so its messages are summed up by the hour first
    (with at most as many different times as an hour has seconds); what follows sees
    one slim row for each of its hours.
    """
    kept = msgs.where(time.in_range(F.col("create_time"), begin, end))
    marked = with_opening(kept, gap)
    hours = marked.groupBy("session_id", "opening", F.expr(f"create_time div {HOUR}").alias("_hour")).agg(
        F.count("*").alias("total"), F.count_if(sent()).alias("sent"), F.count_if(~sent()).alias("received"), F.max("create_time").alias("last_time"),
        F.min(F.when(~sent(), F.col("create_time"))).alias("_in"), F.min(F.when(sent(), F.col("create_time"))).alias("_out"), F.collect_set(F.when(sent(), F.col("create_time"))).alias("_outs"),
    )
    answered = F.array_min(F.filter("_outs", lambda t: t >= F.col("_in")))
    slim = hours.withColumn("_answer", answered).drop("_outs")
    slim = slim.withColumn("_first", F.min("_in").over(Window.partitionBy("session_id", "opening")))
    reply = F.when(F.col("_in") == F.col("_first"), F.col("_answer")).when(F.col("_out") > F.col("_first"), F.col("_out"))
    outline = slim.withColumn("_reply", reply).groupBy("session_id", "opening").agg(
        F.max("last_time").alias("last_time"), *[F.sum(c).alias(c) for c in ("total", "sent", "received")], F.min("_first").alias("first_incoming"), F.min("_reply").alias("first_reply")
    )
    return outline.select("session_id", F.col("opening").alias("first_time"), "last_time", "total", "sent", "received", "first_incoming", "first_reply", (F.col("last_time") - F.col("opening")).alias("duration"))


def silent_sessions(msgs: DataFrame, now: int, days: int) -> DataFrame:
    last = msgs.where(~F.contains("session_id", F.lit("@chatroom"))).groupBy("session_id").agg(F.max("create_time").alias("last_time"))
    return last.where(F.col("last_time") <= now - days * DAY).withColumn("silent_days", F.expr(f"({now} - last_time) div {DAY}"))


def month_stats(msgs: DataFrame) -> DataFrame:
    """For each session and month: counts, active days, longest streak and longest silence between active days, busiest hours."""
    month = time.month_key(F.col("create_time"))
    by_day = msgs.groupBy("session_id", month.alias("month"), time.day(F.col("create_time")).alias("d")).agg(F.count("*").alias("n"), F.count_if(sent()).alias("mine"), F.min("create_time").alias("a"), F.max("create_time").alias("b"))
    w = Window.partitionBy("session_id", "month").orderBy("d")
    marked = by_day.withColumn("run", F.date_sub("d", F.row_number().over(w))).withColumn("silence", F.date_diff("d", F.lag("d").over(w)) - 1)
    marked = marked.withColumn("in_run", F.count("*").over(Window.partitionBy("session_id", "month", "run")))
    days = marked.groupBy("session_id", "month").agg(F.sum("n").alias("total"), F.sum("mine").alias("mine"), F.count("*").alias("active_days"), F.max("in_run").alias("longest_streak"), F.coalesce(F.max("silence"), F.lit(0)).alias("longest_silence"), F.min("a").alias("first_time"), F.max("b").alias("last_time"))
    by_hour = msgs.groupBy("session_id", month.alias("month"), time.hour(F.col("create_time")).alias("hour")).agg(F.count("*").alias("n"))
    busy = by_hour.groupBy("session_id", "month").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "hour"))), 1, 3).alias("h"))
    return days.join(busy, ["session_id", "month"]).withColumn("busiest_hours", F.array_join(F.transform("h", lambda x: x["hour"].cast("string")), ",")).drop("h").withColumn("theirs", F.col("total") - F.col("mine"))


def fixed_periods(msgs: DataFrame, hours: int) -> DataFrame:
    """Messages of each session in periods of so many hours from midnight."""
    width = hours * 3600
    start = F.expr(f"create_time - create_time % {DAY} + (create_time % {DAY}) div {width} * {width}")
    day_end = F.col("period_start") - F.col("period_start") % DAY + DAY
    return msgs.groupBy("session_id", start.alias("period_start")).agg(F.count("*").alias("n")).withColumn("period_end", F.least(F.col("period_start") + width, day_end))


def due_periods(periods: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """Ended periods that no record has yet."""
    return periods.where(F.col("period_end") <= now).join(done, ["session_id", "period_start", "period_end"], "left_anti")


#: Words of feeling and of meeting, each of which tells more of a message.
FEELING = "谢谢 感谢 抱歉 对不起 开心 高兴 难过 委屈 生气 焦虑 压力 累 想你 喜欢 爱 在乎 担心 害怕 烦 崩溃 见面 一起 约 陪 帮".split()
MARKUP = r"(?i)^(<\?xml|<msg\b|<appmsg\b|<img\b|<emoji\b|<voip\b|<sysmsg\b|&lt;)"


def profile_score(content: Column, quoted: Column | None = None) -> Column:
    """How telling a message is: length to 80, question, exclamation, words of feeling, a quotation, long text; 0 without plain text."""
    c = F.substring(F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", ""), 1, 600)
    # In UTF-16 units, as the reference counts.
    n = F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))
    score = F.least(n, F.lit(80)) + F.when(F.rlike(c, F.lit("[?\\uFF1F]")), 18).otherwise(0) + F.when(F.rlike(c, F.lit("[!\\uFF01]")), 8).otherwise(0)
    for word in FEELING:
        score = score + F.when(F.contains(c, F.lit(word)), 24).otherwise(0)
    if quoted is not None:
        score = score + F.when(F.coalesce(quoted, F.lit("")) != "", 12).otherwise(0)
    score = score + F.when(n >= 80, 16).otherwise(0)
    return F.when((c == "") | F.startswith(c, F.lit("[")) | F.rlike(c, F.lit(MARKUP)), 0).otherwise(score)


def with_place(msgs: DataFrame, bucket: int = DAY, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds ``i``, the place from 0 in the session, and ``size``, its number of messages; ordered bucket by bucket. ``order`` begins with the time."""
    dealt = msgs.withColumn("_bucket", F.expr(f"create_time div {bucket}"))
    counts = dealt.groupBy("session_id", "_bucket").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("session_id")
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select(F.col("session_id").alias("_s"), F.col("_bucket").alias("_b"), (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("size"))
    ranked = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("session_id", "_bucket").orderBy(*order)) - 1)
    placed = ranked.join(before, F.col("session_id").eqNullSafe(F.col("_s")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return placed.withColumn("i", F.col("_before") + F.col("_i")).drop("_s", "_b", "_i", "_before")


def representative(msgs: DataFrame, top: int = 120, bucket: int = DAY) -> DataFrame:
    """For each session: its ends and middle, the edges and middles of 6 to 24 equal parts, and the ``top`` most telling messages, with neighbours."""
    quoted = F.col("quoted_content") if "quoted_content" in msgs.columns else None
    placed = with_place(msgs, bucket).withColumn("score", profile_score(F.col("content"), quoted))
    order = (F.desc("score"), "i")
    # The best of a session are among the best of its buckets.
    some = placed.where("score > 0").select("session_id", "_bucket", "i", "score").withColumn("s", F.row_number().over(Window.partitionBy("session_id", "_bucket").orderBy(*order))).where(F.col("s") <= top)
    best = some.withColumn("s", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where(F.col("s") <= top)
    near = best.select(F.col("session_id").alias("_s"), F.explode(F.sequence(F.col("i") - 2, F.col("i") + 2)).alias("_near")).distinct()
    parts = placed.withColumn("_parts", F.least(F.lit(24), F.greatest(F.lit(6), F.ceil(F.col("size") / 250))).cast("long"))
    around = """exists(sequence(0L, _parts - 1), b -> abs(i - size * b div _parts) <= 1
      or abs(i - greatest(size * b div _parts, size * (b + 1) div _parts - 1)) <= 1
      or abs(i - (size * b div _parts + greatest(size * b div _parts, size * (b + 1) div _parts - 1)) div 2) <= 1)"""
    fixed = (F.col("i") <= 3) | (F.col("i") >= F.col("size") - 4) | (F.abs(F.col("i") - F.expr("size div 2")) <= 3) | F.expr(around)
    joined = parts.join(near, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("i") == F.col("_near")), "left")
    return joined.where(fixed | F.col("_near").isNotNull()).drop("_bucket", "_parts", "_s", "_near")


def within_budget(lines: DataFrame, budget: int, bucket: int = DAY) -> DataFrame:
    """A session's first lines as long as they fit, line ends counted; a null line takes no room.

    Adds ``run``, the room taken so far. Sums of time buckets are carried over, and
    buckets behind the budget go before any of their lines is ordered.
    """
    cost = F.coalesce(F.length("line") + 1, F.lit(0)).cast("long")
    dealt = lines.withColumn("_bucket", F.expr(f"create_time div {bucket}"))
    sums = dealt.groupBy("session_id", "_bucket").agg(F.sum(cost).alias("_cost"))
    upto = Window.partitionBy("session_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sums.withColumn("_before", F.sum("_cost").over(upto) - F.col("_cost")).where(F.col("_before") <= budget)
    before = before.select(F.col("session_id").alias("_s"), F.col("_bucket").alias("_b"), "_before")
    near = dealt.join(before, F.col("session_id").eqNullSafe(F.col("_s")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    within = Window.partitionBy("session_id", "_bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.col("_before") + F.sum(cost).over(within)
    return near.withColumn("run", run).where(F.col("run") <= budget).drop("_s", "_b", "_before", "_bucket")


def transcript(msgs: DataFrame, names: DataFrame) -> DataFrame:
    """Readable lines with display names; one row for each message, so no session is gathered."""
    named = msgs.join(names.select(F.col("username").alias("sender"), "display_name"), "sender", "left")
    return named.select("session_id", *ORDER, F.concat_ws(" ", time.clock(F.col("create_time")), F.concat(F.coalesce("display_name", "sender", "session_id"), F.lit(":")), "content").alias("line"))
