"""Reports: small frames composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time
from ..operators import footprint, sequence, stats


def annual(msgs: DataFrame, begin: int = 0, end: int = 0) -> dict[str, DataFrame]:
    """Every metric of a year (or of all time) by name; each is lazy and small."""
    kept = msgs.where(time.in_range(F.col("create_time"), begin, end))
    out = {
        "overall": stats.overall(kept), "core_friends": sequence.core_friends(kept), "monthly_top": sequence.monthly_top(kept), "peak_day": sequence.peak_day(kept),
        "longest_streaks": sequence.longest_streaks(kept).orderBy(F.desc("days"), "session_id").limit(1), "heatmap": sequence.heatmap(kept), "midnight_king": sequence.midnight_king(kept),
        "mutual_friend": sequence.mutual_friend(kept), "initiative": sequence.social_initiative(kept), "response_times": sequence.response_times(kept),
    }
    if "content" in msgs.columns:
        out["phrases"] = sequence.top_phrases(kept)
    return out


def pair(msgs: DataFrame, session: str, begin: int = 0, end: int = 0) -> dict[str, DataFrame]:
    """The same for one session, with first messages and phrases of either side."""
    mine = msgs.where(F.col("session_id") == session)
    kept = mine.where(time.in_range(F.col("create_time"), begin, end))
    out = {"counts": stats.session_types(kept), "first_ever": sequence.first_messages(mine), "first_in_range": sequence.first_messages(kept), "heatmap": sequence.heatmap(kept), "streak": sequence.longest_streaks(kept), "months": stats.months(kept), "starts": sequence.conversation_starts(kept), "response": sequence.response_times(kept, least=1)}
    if "content" in msgs.columns:
        out["exclusive"] = sequence.exclusive_phrases(kept)
    return out


def my_footprint(msgs: DataFrame, me: list[str], begin: int = 0, end: int = 0) -> dict[str, DataFrame]:
    found = {"summary": footprint.summary(msgs, begin, end), "sessions": footprint.private_rows(msgs, begin, end), "segments": sequence.segments(msgs.where(~F.contains("session_id", F.lit("@chatroom"))), begin, end)}
    if "source" in msgs.columns:
        found["mentions"] = footprint.mentions(msgs, me, begin, end)
        found["groups"] = footprint.mention_groups(found["mentions"])
    return found


def annual_row(msgs: DataFrame) -> DataFrame:
    """One row of the scalar metrics of a report."""
    core = stats.overall(msgs).select("total", "sent", "received", "active_days", "sessions")
    peak = sequence.peak_day(msgs).select(F.col("day").alias("peak_day"), F.col("total").alias("peak_total"))
    streak = sequence.longest_streaks(msgs).orderBy(F.desc("days"), "session_id").limit(1).select(F.col("session_id").alias("streak_session"), F.col("days").alias("streak_days"))
    begin = sequence.social_initiative(msgs).select("initiated", "initiative")
    return core.crossJoin(peak).crossJoin(streak).crossJoin(begin)
