"""The feed over small files."""

from pyspark.sql import functions as F

from chatloom.streaming import feed

T = 1704067200
SCHEMA = "session_id string, local_id bigint, create_time bigint, local_type bigint, is_send int, content string, revoked_id bigint, kind string, ts timestamp"


def put(spark, folder, rows):
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumn("ts", F.timestamp_seconds("create_time"))
    df.coalesce(1).write.mode("append").parquet(folder)


def test_repeats_come_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("s", 1, T, 1, 0, "a", None, "m"), ("s", 1, T, 1, 0, "a", None, "m"), ("s", 2, T, 1, 0, "b", None, "m")])
    put(spark, folder, [("s", 1, T, 1, 0, "a", None, "m"), ("s", 3, T + 1, 1, 0, "c", None, "m")])
    rows = feed.drained(feed.new_messages(feed.file_stream(spark, folder, SCHEMA, 1)), "once").collect()
    assert sorted(r["local_id"] for r in rows) == [1, 2, 3]


def test_revokes_meet_originals(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("s", 1, T, 1, 0, "gone", None, "m"), ("s", 2, T + 100, 10002, 0, None, 1, "m"), ("s", 3, T + 900, 10002, 0, None, 1, "m"), ("s", 9, T + 90000, 1, 0, "late", None, "m")])
    put(spark, folder, [("s", 10, T + 90001, 1, 0, "x", None, "m"), ("s", 11, T + 90002, 10002, 0, None, 10, "m")])
    put(spark, folder, [("s", 12, T + 900000, 1, 0, "x", None, "m"), ("s", 13, T + 900002, 10002, 0, None, 12, "m")])
    found = {r["revoke_id"]: r["content"] for r in feed.drained(feed.revokes(feed.file_stream(spark, folder, SCHEMA, 1), "local_type = 10002"), "revoked").collect()}
    assert found[2] == "gone"
    assert found.get(3) is None


def test_unread_counts_reset(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("s", 1, T, 1, 0, "", None, "m"), ("s", 2, T + 1, 1, 0, "", None, "m"), ("s", 3, T + 1, 1, 0, "", None, "read"), ("s", 4, T + 2, 1, 0, "", None, "m")])
    rows = feed.drained(feed.unread_since_read(feed.file_stream(spark, folder, SCHEMA)), "unread_reset", "update").collect()
    assert [r["unread"] for r in rows] == [1]


def test_replay(spark):
    log = spark.createDataFrame([(i, T + i) for i in range(1, 6)], "event_id bigint, timestamp bigint")
    assert [r["event_id"] for r in feed.replay(log, 2, T + 5).collect()] == [3, 4, 5]
    assert feed.replay(log, 0, T + 5, most=2).count() == 2


def test_drained_rows_stay_out_of_the_driver(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("s", 1, T, 1, 0, "a", None, "m"), ("s", 2, T + 1, 1, 0, "b", None, "m")])
    put(spark, folder, [("s", 3, T + 3601, 1, 0, "c", None, "m"), ("t", 4, T + 3602, 1, 0, "d", None, "m")])
    stream = lambda: feed.file_stream(spark, folder, SCHEMA, 1)
    once = feed.drained(feed.new_messages(stream()), "kept_new")
    hours = feed.drained(feed.period_counts(stream(), "1 hour"), "kept_hours", "complete")
    assert sorted(r["local_id"] for r in once.collect()) == [1, 2, 3, 4]
    assert sorted((r["session_id"], r["period_start"] - T, r["n"]) for r in hours.collect()) == [("s", 0, 2), ("s", 3600, 1), ("t", 3600, 1)]
    assert once.inputFiles() and hours.inputFiles() and not spark.catalog.tableExists("kept_new")
