"""Boundaries and ties of the operators, on hand-made rows."""

from pyspark.sql import functions as F

from chatloom.operators import footprint, lookups, scan, sequence, social, stats
from chatloom.sources import model, sinks

T = 1704067200


def msgs(spark, rows):
    return spark.createDataFrame(rows, "session_id string, local_id bigint, create_time bigint, local_type bigint, is_send int, content string")


def at(spark, times, side=None, session="s"):
    return msgs(spark, [(session, i, T + t, 1, (side or [0] * len(times))[i], f"m{i}") for i, t in enumerate(times)])


def test_conversation_gap_is_strict(spark):
    row = sequence.conversation_starts(at(spark, [0, 3600, 7201], [1, 1, 0])).first()
    assert (row["initiated"], row["received"]) == (1, 1)


def test_buckets_do_not_change_gaps(spark):
    df = at(spark, [0, 100, 4000, 90000, 90001, 400000])
    for bucket in (50, 3000, sequence.BUCKET):
        rows = sequence.with_previous(df, ("create_time",), bucket).orderBy("create_time").collect()
        assert [r["prev"]["create_time"] - T if r["prev"] else None for r in rows] == [None, 0, 100, 4000, 90000, 90001]
        opened = sequence.with_opening(df, 300, bucket).orderBy("create_time").collect()
        assert [r["opening"] - T for r in opened] == [0, 0, 4000, 90000, 90000, 400000]


def test_segments_split_above_300(spark):
    rows = sequence.segments(at(spark, [0, 299, 599, 900], [0, 1, 0, 1])).orderBy("first_time").collect()
    assert (rows[0]["total"], rows[0]["duration"], rows[0]["first_reply"] - T) == (3, 599, 299)
    assert len(rows) == 2 and rows[1]["first_incoming"] is None and rows[1]["first_reply"] is None


def test_response_needs_samples(spark):
    df = at(spark, [0, 10, 20, 30], [0, 1, 0, 1])
    assert sequence.response_times(df).count() == 0
    row = sequence.response_times(df, least=1).first()
    assert (row["n"], row["average"]) == (2, 10.0)


def test_streak_over_leap_day_keeps_first(spark):
    day = 86400
    feb28 = 1709078400 - T
    row = sequence.longest_streaks(at(spark, [feb28, feb28 + day, feb28 + 2 * day, feb28 + 5 * day, feb28 + 6 * day, feb28 + 7 * day])).first()
    assert (row["days"], row["first_day"], row["last_day"]) == (3, "2024-02-28", "2024-03-01")


def test_ranking_ties_by_id(spark):
    df = msgs(spark, [(s, i, T + i, 1, 0, "") for i, s in enumerate("bbaac")])
    assert [r["session_id"] for r in sequence.core_friends(df).collect()] == ["a", "b", "c"]


def test_times_of_zero_do_not_count(spark):
    df = msgs(spark, [("s", 1, 0, 1, 0, ""), ("s", 2, -5, 1, 0, ""), ("s", 3, T, 1, 1, "")])
    assert stats.overall(df).first()["total"] == 1


def test_days_filled(spark):
    rows = {r["day"]: r["n"] for r in stats.days_filled(at(spark, [0, 3 * 86400])).collect()}
    assert rows == {"2024-01-01": 1, "2024-01-02": 0, "2024-01-03": 0, "2024-01-04": 1}
    assert stats.days_filled(at(spark, [0, 9000 * 86400])).count() == 2


def test_around_borrows(spark):
    df = at(spark, [i * 10 for i in range(10)])
    rows = scan.around(df, "s", T + 10, 1, 6).orderBy("create_time").collect()
    assert [r["local_id"] for r in rows] == [0, 1, 2, 3, 4, 5, 6]


def test_revoke_nearest(spark):
    rows = [("s", 1, T, 1, 0, ""), ("s", 2, T + 5, 1, 1, ""), ("s", 3, T + 6, 10000, 0, ""), ("s", 4, T + 1000, 10000, 0, "")]
    found = lookups.revoked_nearest(msgs(spark, rows), "local_type = 10000", 300).collect()
    assert [(r["revoke_id"], r["original_id"]) for r in found] == [(3, 1)]


def test_nicknames_in_conflict_are_empty(spark):
    df = spark.createDataFrame([("g", "a", "x"), ("g", "a", "y"), ("g", "b", " z ")], "chatroom_id string, username string, nickname string")
    assert {r["username"]: r["nickname"] for r in lookups.nickname_consensus(df).collect()} == {"a": "", "b": "z"}


def test_comment_names(spark):
    comments = [("7", "u1", "Ann", "hi", "0"), ("8", "u2", "Bob", "yo", "7"), ("9", "u3", "Cy", "hm", "2")]
    df = spark.createDataFrame([("p", comments)], "id string, comments array<struct<id:string,username:string,nickname:string,content:string,ref:string>>")
    assert [c["reply_to"] for c in social.with_reply_names(df).first()["comments"]] == [None, "Ann", "Bob"]


def test_mentions_need_identity(spark):
    df = spark.createDataFrame([("g@chatroom", 1, T, 1, 0, "<atuserlist>u1,u2</atuserlist>"), ("g@chatroom", 2, T, 1, 0, "<atuserlist>u12</atuserlist>")], "session_id string, local_id bigint, create_time bigint, local_type bigint, is_send int, source string")
    assert [r["local_id"] for r in footprint.mentions(df, ["U1"]).collect()] == [1]


def test_export_and_snapshot(spark, tmp_path):
    df = at(spark, [0, 40 * 86400], [0, 1])
    sinks.export(df, "txt", str(tmp_path / "out"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["2024-01-01 00:00:00 's' m0", "2024-02-10 00:00:00 'me' m1"]
    sinks.snapshot(df, str(tmp_path / "snap"))
    new, counts = sinks.import_snapshot(df.where("local_id = 0"), spark.read.parquet(str(tmp_path / "snap")), ["session_id", "local_id"])
    assert new.count() == 1 and tuple(counts.first()) == (1, 1, 0)


def test_sql_text_is_escaped(spark):
    df = msgs(spark, [("s'x", 1, T, 244813135921, 0, "")])
    assert "'s''x'" in sinks.sql(df).first()["line"] and "BIGINT" in sinks.sql_head()


def test_pick_takes_what_is_there(spark):
    df = spark.createDataFrame([(None, 5)], "a int, b int")
    assert df.select(model.pick(df, ["missing", "a", "b"], 9).alias("x")).first()["x"] == 5


def test_empty_tables(spark):
    empty = msgs(spark, [])
    assert sequence.segments(empty).count() == 0
    assert stats.overall(empty).first()["total"] == 0
    assert sequence.longest_streaks(empty).count() == 0


def brute_representative(texts):
    n, chosen = len(texts), set()

    def window(center, radius):
        chosen.update(range(max(0, center - radius), min(n - 1, center + radius) + 1))

    def score(c):
        if not c or c.startswith("["):
            return 0
        return min(80, len(c)) + 18 * any(x in c for x in "?？") + 8 * any(x in c for x in "!！") + 24 * sum(w in c for w in sequence.FEELING) + 16 * (len(c) >= 80)

    parts = min(24, max(6, -(-n // 250)))
    for b in range(parts):
        start = n * b // parts
        end = max(start, n * (b + 1) // parts - 1)
        for center in (start, (start + end) // 2, end):
            window(center, 1)
    scores = [score(t) for t in texts]
    for i in sorted((i for i in range(n) if scores[i] > 0), key=lambda i: -scores[i])[:120]:
        window(i, 2)
    for center in (0, n // 2, n - 1):
        window(center, 3)
    return chosen


def test_representative_is_the_references(spark):
    sessions = {"one": 1, "few": 9, "some": 700, "many": 4000}
    text = lambda i: ["", "[图片]", "短", "喜欢你吗？", "x" * (i * 37 % 120), "谢谢！ 一起 见面"][i * 7919 % 1013 % 6] if i % 5 == 0 else ""
    rows = [(s, i, T + i * 900, 1, 0, text(i)) for s, n in sessions.items() for i in range(n)]
    got = {}
    for r in sequence.representative(msgs(spark, rows)).collect():
        assert r["local_id"] == r["i"] and r["size"] == sessions[r["session_id"]]
        got.setdefault(r["session_id"], []).append(r["i"])
    assert {s: sorted(x) for s, x in got.items()} == {s: sorted(brute_representative([text(i) for i in range(n)])) for s, n in sessions.items()}
