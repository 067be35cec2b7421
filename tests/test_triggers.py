"""Activity triggers against a plain walk, schedules and stored ranges against cases."""

import random

import pytest
from pyspark.sql import functions as F

from chatloom.functions import time
from chatloom.operators import triggers


def walked(rows, cooldown):
    out = []
    for s in {r[0] for r in rows if r[0] is not None}:
        last = None
        for t, i in sorted((r[1], r[2]) for r in rows if r[0] == s and r[1] is not None):
            if last is None or t >= last + cooldown:
                out.append((s, t, i))
                last = t
    return sorted(out)


@pytest.mark.parametrize("cooldown", [1, 7, 100, 5000, 90_000])
def test_triggers_same_as_a_walk(spark, cooldown):
    draw = random.Random(cooldown)
    rows = [("s", draw.randrange(20_000), i) for i in range(800)] + [("hot", 1000 + i // 3, i) for i in range(900)] + [("gap", t, t) for t in (-5, 0, 99, 100, 199, 200, 250_000)] + [("one", 5, 1), (None, 1, 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "session_id string, create_time bigint, local_id bigint").withColumn("steps", F.lit("clash"))
    for span in (500, 3600, 86400):
        got = triggers.activity_triggers(df, cooldown, span).collect()
        assert sorted(tuple(r[c] for c in ("session_id", "create_time", "local_id")) for r in got) == walked(rows, cooldown)


def test_no_messages_no_triggers(spark):
    df = spark.createDataFrame([], "session_id string, create_time bigint, local_id bigint")
    assert triggers.activity_triggers(df).count() == 0
    some = spark.createDataFrame([("s", 1, 1), ("s", 1, 2), ("s", 2, 3)], df.schema)
    assert triggers.activity_triggers(some, 0).count() == 2


def test_due_keys(spark):
    day, made = 86_400_000, 1_000_000_000_000
    cases = [  # days, hours, first, created, last, now: next, due
        (1, 0, 0, made, 0, made, made + day, None),
        (1, 0, 0, made, 0, made + day, made + day, f"first:{made + day}"),
        (1, 30, 0, made, 0, made + day, made + day + 23 * 3_600_000, None),
        (0, 0, made, made, 0, made + day, None, None),
        (2, 0, made + 5, made, 0, made + 5, made + 5, f"first:{made + 5}"),
        (1, 0, 0, made, made, made + day - 1, made + day, None),
        (1, 0, 0, made, made, made + 3 * day + 1, made + day, f"interval:{made}:3"),
        (1, 0, None, None, None, made, None, None),
        (-1, -5, 0, made, 0, made, None, None),
    ]
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], "i int, days int, hours int, first bigint, created bigint, last bigint, now bigint")
    c = [F.col(n) for n in ("days", "hours", "first", "created", "last")]
    got = df.select("i", triggers.next_trigger(*c).alias("next_at"), triggers.due_key(*c, F.col("now")).alias("due")).collect()
    assert [(r["next_at"], r["due"]) for r in sorted(got)] == [x[6:] for x in cases]


def test_stored_ranges(spark):
    now = 1_709_294_400  # 2024-03-01 12:00:00
    d0 = now // 86400 * 86400
    cases = [
        ("last1year", False, None, None, "last1year", 1_677_628_800, now),  # 2023-03-01
        ("30d", False, None, None, "last30days", d0 - 29 * 86400, now),
        ("custom", True, None, None, "all", None, None),
        ("custom", False, "2024-02-30", "2024-03-01", "today", d0, now),
        ("custom", False, "2024-02-28 10:30", "2024-02-29", "custom", 1_709_116_200, 1_709_164_800),
        ("custom", False, "2024-02-29", "2024-02-28", "custom", 1_709_164_800, 1_709_164_800),
        (None, None, "1709116200000", "2024-02-29T00:00:00Z", "custom", 1_709_116_200, 1_709_164_800),
        ("", False, "x", "y", "today", d0, now),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, preset string, whole boolean, a string, b string")
    got = df.select("i", time.stored_range(F.col("preset"), F.col("whole"), F.col("a"), F.col("b"), F.lit(now)).alias("r")).orderBy("i").collect()
    assert [(r["r"]["preset"], r["r"]["begin"], r["r"]["end"]) for r in got] == [c[4:] for c in cases]
    assert [r["r"]["all_time"] for r in got] == [c[4] == "all" for c in cases]


def test_batches_of_spans_are_flat_and_bounded(spark):
    """Numbers of a batch are no Python objects: 400,000 steps of one session, as where the cooldown exceeds the span, take less than 80 MB."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    times = np.arange(400_000, dtype=np.int64)
    spans = pa.ListArray.from_arrays(pa.array(np.arange(0, 400_001, 1000, dtype=np.int32)), pa.array(times))
    tracemalloc.start()
    steps = triggers._steps(5000).func(spans)
    whole = pa.ListArray.from_arrays(pa.array([0, 400], pa.int32()), pa.StructArray.from_arrays([pa.array(np.arange(400)), steps], ["span", "steps"]))
    before = triggers._composed(5000).func(whole)
    taken = triggers._walked(5000).func(spans, before.flatten())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken.flatten().to_pylist() == list(range(0, 400_000, 5000)) and peak < 80e6
    # Slices of batches count from their own first row.
    assert triggers._walked(5000).func(spans.slice(5, 2), before.flatten().slice(5, 2)).to_pylist() == [[5000], []]
    triggers.activity_triggers(spark.createDataFrame([], "session_id string, create_time bigint, local_id bigint"))
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= triggers.BATCH_BYTES
