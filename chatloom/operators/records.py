"""Records that were made of sessions: filters, facets, and which periods overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a page at most.
PAGE = 200


def page_bounds(limit: int | None, offset: int | None) -> tuple[int, int]:
    return min(PAGE, max(1, int(limit or 100))), max(0, int(offset or 0))


def period_records(records: DataFrame, session_id: str = "", begin: int = 0, end: int = 0, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the records (session_id, period_start, period_end, created_at, record_id) whose period overlaps begin to end, both included; 0 is open. The latest first, by id where equal."""
    out = records.where(F.col("session_id") == session_id) if session_id else records
    if begin > 0:
        out = out.where(F.coalesce("period_end", F.lit(0)) >= begin)
    if end > 0:
        out = out.where(F.coalesce("period_start", F.lit(0)) <= end)
    most, skip = page_bounds(limit, offset)
    at = F.coalesce(F.nullif(F.col("period_start"), F.lit(0)), F.col("created_at"))
    return out.orderBy(F.desc(at), "record_id").offset(skip).limit(most)


#: Texts of an insight in which a keyword is sought.
SOUGHT = ("display_name", "session_id", "insight", "sender_name", "preview", "explicit_text", "emotion", "intent", "topic")


def insight_records(records: DataFrame, session_id: str = "", source_type: str = "all", begin: int = 0, end: int = 0, keyword: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the insights of a session, a source (null is ``insight``), a time and with a keyword in any case; the latest first."""
    out = records.where(F.col("session_id") == session_id) if session_id else records
    if source_type and source_type != "all":
        out = out.where(F.coalesce(F.nullif(F.col("source_type"), F.lit("")), F.lit("insight")) == source_type)
    if begin > 0:
        out = out.where(F.col("created_at") >= begin)
    if end > 0:
        out = out.where(F.col("created_at") <= end)
    if word := keyword.strip().lower():
        text = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SOUGHT if c in records.columns])
        out = out.where(F.contains(F.lower(text), F.lit(word)))
    most, skip = page_bounds(limit, offset)
    return out.orderBy(F.desc("created_at"), "record_id").offset(skip).limit(most)


def contact_facets(records: DataFrame) -> DataFrame:
    """How many records each session has, with the name in its first; most first."""
    return records.groupBy("session_id").agg(F.min_by("display_name", F.struct("created_at", "record_id")).alias("display_name"), F.count("*").alias("n")).orderBy(F.desc("n"), "session_id")


def record_counts(records: DataFrame, today: int) -> DataFrame:
    """One row: all records, those of today, and unread ones."""
    return records.agg(F.count("*").alias("total"), F.count_if(F.col("created_at") >= today).alias("today"), F.count_if(~F.coalesce(F.col("is_read"), F.lit(False))).alias("unread"))


#: Sizes of bins grow by this power of two from level to level; the last level holds all times.
SHIFT, LEVELS = 2, 24


def overlaps(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("session_id",), begin: str = "period_start", end: str = "period_end") -> DataFrame:
    """Every pair of rows of equal keys whose periods share a time (ends included): the keys, structs ``l`` and ``r``. Each pair once.

    Periods are seconds from 0; those without a begin or end, or that end before they
    begin, overlap nothing. An interval lies in at most two bins of the level whose bins
    are as long as itself, and of every coarser one. Two meet on the level of the longer
    one, in the first bin that both have; so the join is on equal keys, and neither long
    nor short periods make many rows.
    """

    def binned(df: DataFrame, name: str) -> DataFrame:
        a, b = F.col(begin), F.col(end)
        row = df.where((a >= 0) & (b >= a)).select(*keys, F.struct(*df.columns).alias(name), a.cast("bigint").alias(f"{name}a"), b.cast("bigint").alias(f"{name}b"))
        level = F.ceil(F.length(F.bin(F.col(f"{name}b") - F.col(f"{name}a") + 1)) / SHIFT).cast("int")
        row = row.withColumn(f"{name}own", level).withColumn("level", F.explode(F.sequence(level, F.lit(LEVELS))))
        first, last = (F.call_function("shiftright", F.col(f"{name}{e}"), F.col("level") * SHIFT) for e in "ab")
        return row.withColumn(f"{name}first", first).withColumn("bin", F.explode(F.array_distinct(F.array(first, last))))

    one, other = binned(left, "l"), binned(right, "r")
    met = one.join(other, [*keys, "level", "bin"])
    longer = (F.col("level") == F.greatest("lown", "rown")) & (F.col("bin") == F.greatest("lfirst", "rfirst"))
    return met.where(longer & (F.col("la") <= F.col("rb")) & (F.col("ra") <= F.col("lb"))).select(*keys, "l", "r")
