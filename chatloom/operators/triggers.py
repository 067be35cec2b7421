"""What sets something off: activity with a cooldown, and recurring schedules.

An activity trigger takes a session's first message and from then on the first one that
comes at least ``cooldown`` seconds after the last taken. What is taken in a span of time
depends on all before only through the last one taken before. So each span is summed up
as a step function, from the time at which messages count again to the last one that the
span then takes. The steps of a session's spans are composed in order, and each span is
walked by itself from what that gives; a hot session is as many tasks as it has spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

COOLDOWN, SPAN = 7200, 86400
STEPS = ArrayType(StructType([StructField("upto", LongType()), StructField("last", LongType())]))
NEVER = -(1 << 62)
#: Bytes of spans or sessions that go to a Python worker at a time, save for a single larger one.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bytes of an Arrow batch, where they are more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).strip().lower()
    # Without a unit, or in bytes as the default is; others are not compared but set.
    if not now.removesuffix("b").isdigit() or not 0 < int(now.removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def steps_of(times: np.ndarray, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, last): a walk that may begin at any time behind the step before, ``upto`` at the latest, takes ``last`` last. ``times`` ascend."""
    follow = np.searchsorted(times, times + cooldown)
    at = np.arange(len(times))
    while True:
        further = follow[at]
        going = further < len(times)
        if not going.any():
            break
        at = np.where(going, np.minimum(further, len(times) - 1), at)
    ends = np.flatnonzero(np.r_[at[1:] != at[:-1], True])
    return times[ends], times[at[ends]]


# Lists stay flat Arrow arrays: a Python object for each number would take many times the bytes.


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins, and in the end ends, among all values, and the values."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.flatten()


def _lists(parts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)].astype(np.int32)), np.concatenate(parts) if parts else np.empty(0, np.int64)


def _steps(cooldown: int):
    @arrow_udf(STEPS)
    def steps(spans: pa.Array) -> pa.Array:
        at, values = _flat(spans)
        times = values.to_numpy()
        found = [steps_of(times[a:b], cooldown) for a, b in zip(at, at[1:])]
        offsets, upto = _lists([u for u, _ in found])
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(upto), pa.array(_lists([x for _, x in found])[1])], ["upto", "last"]))

    return steps


def _composed(cooldown: int):
    @arrow_udf(ArrayType(LongType()))
    def composed(sessions: pa.Array) -> pa.Array:
        """For each span of a session, in order, the last message taken before it."""
        at, spans = _flat(sessions)
        begins, steps = _flat(spans.flatten()[1])
        upto, lasts = (f.to_numpy() for f in steps.flatten())
        before = np.empty(len(spans), np.int64)
        for a, b in zip(at, at[1:]):
            last = NEVER
            for i in range(a, b):
                before[i] = last
                own = upto[begins[i] : begins[i + 1]]
                step = int(np.searchsorted(own, last + cooldown))
                last = int(lasts[begins[i] + step]) if step < len(own) else last
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(before))

    return composed


def _walked(cooldown: int):
    @arrow_udf(ArrayType(LongType()))
    def walked(spans: pa.Array, befores: pa.Array) -> pa.Array:
        at, values = _flat(spans)
        times = values.to_numpy()

        def one(own: np.ndarray, last: int) -> np.ndarray:
            taken, i = [], int(np.searchsorted(own, last + cooldown))
            while i < len(own):
                taken.append(i)
                i = int(np.searchsorted(own, own[i] + cooldown))
            return own[taken] if taken else own[:0]

        return pa.ListArray.from_arrays(*map(pa.array, _lists([one(times[a:b], x) for a, b, x in zip(at, at[1:], befores.to_numpy())])))

    return walked


def activity_triggers(msgs: DataFrame, cooldown: int = COOLDOWN, span: int = SPAN) -> DataFrame:
    """(session_id, create_time, local_id) of the messages that set something off; of equal times the least id.

    Messages without a time or session set nothing off. A cooldown of 0 or less takes
    every time. A span's times are distinct seconds, so its array is bounded by ``span``,
    and a session's by its days and steps.
    """
    cooldown = max(1, cooldown)
    small_batches(msgs.sparkSession)
    own = msgs.where("session_id is not null and create_time is not null").groupBy("session_id", "create_time").agg(F.min("local_id").alias("local_id"))
    cut = own.withColumn("span", F.expr(f"create_time div {span}"))
    spans = cut.groupBy("session_id", "span").agg(F.sort_array(F.collect_list("create_time")).alias("times"))
    summed = spans.select("session_id", "span", _steps(cooldown)("times").alias("steps"))
    sessions = summed.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("span", "steps"))).alias("spans"))
    before = sessions.withColumn("before", _composed(cooldown)("spans")).select("session_id", F.inline(F.arrays_zip(F.col("spans.span").alias("span"), "before")))
    taken = spans.join(before, ["session_id", "span"]).select("session_id", F.explode(_walked(cooldown)("times", "before")).alias("create_time"))
    return own.join(taken, ["session_id", "create_time"])


# Recurring schedules. Times are in milliseconds, as tasks store them.

HOUR_MS = 3_600_000


def _whole(value: Column, most: int | None = None) -> Column:
    number = F.greatest(F.lit(0), F.coalesce(F.floor(value.try_cast("double")), F.lit(0)).cast("bigint"))
    return F.least(number, F.lit(most)) if most is not None else number


def interval(days: Column, hours: Column) -> Column:
    """Milliseconds of so many days and, 23 at most, hours; 0 for none."""
    return (_whole(days) * 24 + _whole(hours, 23)) * HOUR_MS


def initial_trigger(days: Column, hours: Column, first: Column, created: Column) -> Column:
    """The first time as told, else one interval after the task was made; null without interval or time."""
    made = F.when(_whole(created) > 0, _whole(created) + interval(days, hours))
    return F.when(interval(days, hours) > 0, F.when(_whole(first) > 0, _whole(first)).otherwise(made))


def next_trigger(days: Column, hours: Column, first: Column, created: Column, last: Column) -> Column:
    """An interval after the last run, or the first time."""
    return F.when(interval(days, hours) > 0, F.when(_whole(last) > 0, _whole(last) + interval(days, hours)).otherwise(initial_trigger(days, hours, first, created)))


def due_key(days: Column, hours: Column, first: Column, created: Column, last: Column, now: Column) -> Column:
    """Names the run that is due at ``now``, so that one is not begun twice; null where none is."""
    step, ran, begin = interval(days, hours), _whole(last), initial_trigger(days, hours, first, created)
    again = F.when(now >= ran + step, F.concat_ws(":", F.lit("interval"), ran.cast("string"), F.floor((now - ran) / step).cast("string")))
    start = F.when(now >= begin, F.concat_ws(":", F.lit("first"), begin.cast("string")))
    return F.when(step > 0, F.when(ran > 0, again).otherwise(start))
