"""Changes of messages: latest update, final deletion, compaction that may be begun again."""

import pytest
from pyspark.sql import functions as F

from chatloom.streaming import changes

DAY = 86400
MSGS = "session_id string, local_id bigint, create_time bigint, content string, extra string"


def rows_of(df):
    return sorted((r["session_id"] or "", r["local_id"] or 0, r["content"]) for r in df.collect())


@pytest.fixture
def msgs(spark):
    return spark.createDataFrame([("s", i, i * DAY // 2, f"text {i}", "x") for i in range(6)] + [(None, None, None, "no key", "x")], MSGS)


def changed(spark, *rows):
    return spark.createDataFrame([(s, i, i * DAY // 2 if i is not None else None, v, op, c) for s, i, v, op, c in rows], changes.CHANGES)


def test_latest_update_and_final_delete(spark, msgs):
    log = changed(spark, ("s", 1, 2, "update", "second"), ("s", 1, 1, "update", "first"), ("s", 2, 1, "delete", None), ("s", 2, 9, "update", "too late"), ("s", 3, 1, "update", None), ("s", 4, 1, "other", "x"), ("t", 1, 5, "update", "nobody"), (None, None, 1, "update", "found"))
    assert rows_of(changes.with_changes(msgs, log)) == sorted([("s", 0, "text 0"), ("s", 1, "second"), ("s", 3, None), ("s", 4, "text 4"), ("s", 5, "text 5"), ("", 0, "found")], key=lambda x: x[:2])
    assert rows_of(changes.with_changes(msgs, log.limit(0))) == rows_of(msgs) and changes.with_changes(msgs.limit(0), log).count() == 0


def test_compaction_changes_nothing(spark, msgs, tmp_path):
    log = changes.ChangeLog(spark, str(tmp_path))
    with pytest.raises(ValueError):
        log.read()
    log.write(msgs)
    log.append(changed(spark, ("s", 1, 1, "update", "new"), ("s", 4, 1, "delete", None), ("s", 5, 1, "delete", None)))  # all of a day
    before = rows_of(log.read())
    assert len(before) == 5
    log.compact()
    assert rows_of(log.read()) == before
    assert log.read().where("session_id = 's'").select("extra").distinct().count() == 1
    log.append(changed(spark, ("s", 1, 1, "update", "newer than new"), ("s", 0, 5, "delete", None)))
    after = rows_of(log.read())
    assert ("s", 1, "newer than new") in after and len(after) == 4
    log.compact()
    log.compact()
    assert rows_of(log.read()) == after


def test_compaction_that_broke_off(spark, msgs, tmp_path, monkeypatch):
    log = changes.ChangeLog(spark, str(tmp_path))
    log.write(msgs)
    log.append(changed(spark, ("s", 1, 1, "update", "new"), ("s", 2, 1, "delete", None)))
    want = rows_of(log.read())
    write = changes.ChangeLog.write

    def broken(self, rows):
        write(self, rows)
        raise OSError("lost")

    monkeypatch.setattr(changes.ChangeLog, "write", broken)
    with pytest.raises(OSError):
        log.compact()
    # Half-written generations have no mark of success and do not count.
    msgs.where("local_id = 3").withColumn("content", F.lit("half")).withColumn("_day", F.lit(1)).write.partitionBy("_day").parquet(f"{tmp_path}/messages/000000099-half")
    (tmp_path / "messages" / "000000099-half" / "_SUCCESS").unlink()
    monkeypatch.undo()
    again = changes.ChangeLog(spark, str(tmp_path))
    assert rows_of(again.read()) == want
    again.compact()
    assert rows_of(again.read()) == want and not again._parts("changes")


def test_no_messages_at_all(spark, msgs, tmp_path):
    log = changes.ChangeLog(spark, str(tmp_path))
    log.write(msgs.limit(0))
    log.append(changed(spark, ("s", 1, 1, "update", "new")))
    log.compact()
    assert log.read().count() == 0 and log.read().columns == msgs.columns


def test_files_do_not_grow_with_days(spark, tmp_path):
    """A message a day for 300 days: few files in each generation and batch, and a hot day among them is whole."""
    days = spark.range(300).selectExpr("'s' as session_id", "id as local_id", f"id * {DAY} as create_time", "concat('text ', id) as content")
    hot = spark.range(1000).selectExpr("'hot' as session_id", "id as local_id", f"{DAY} + id as create_time", "'x' as content")
    log = changes.ChangeLog(spark, str(tmp_path))
    log.write(days.unionByName(hot))
    edit = F.struct(F.lit(1).alias("version"), F.when(F.col("local_id") % 2 == 0, "update").otherwise("delete").alias("op"), F.lit("new").alias("content"))
    log.append(days.drop("content").where("local_id >= 100").select(*changes.KEY, F.inline(F.array(edit))))
    assert len(list((tmp_path / "changes").rglob("*.parquet"))) < 40
    want = rows_of(log.read())
    assert len(want) == 1200 and sum(c == "new" for _, _, c in want) == 100
    log.compact()
    assert len(list((tmp_path / "messages").rglob("*.parquet"))) < 40
    assert rows_of(log.read()) == want
