"""Exchange documents written and read again, members of groups, and what replaced unbounded rows."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chatloom.operators import groups, sequence
from chatloom.sources import exchange
from chatloom.streaming import feed

from test_streaming import SCHEMA, T, put

MSGS = "session_id string, local_id bigint, create_time bigint, local_type bigint, is_send int, sender string, content string, server_id string"
QUOTE = "<msg><appmsg><type>57</type><title>yes</title><refermsg><svrid>18446744073709551615</svrid><content>hi</content></refermsg></appmsg></msg>"
FORWARD = "<msg><appmsg><type>19</type><title>log</title><recorditem><dataitem datatype='1'><sourcename>Zoe</sourcename><sourcetime>2024-01-02 03:04:05</sourcetime><datadesc>one</datadesc></dataitem><dataitem datatype='8'><datatitle>a.pdf</datatitle></dataitem><dataitem datatype='3'><sourcename>u1</sourcename></dataitem></recorditem></appmsg></msg>"
ROWS = [
    ("g@chatroom", 3, T + 90000, 1, 0, "u2", 'line one\nline "two" \u2028 end', "7"),
    ("g@chatroom", 1, T, 1, 0, "u1", "u1:\nhello", "0"),
    ("g@chatroom", 2, T, 49, 0, "u1", QUOTE, None),
    ("g@chatroom", 4, T + 200000, 49, 1, None, FORWARD, "-9223372036854775808"),
    ("p", 1, T, 3, 0, None, None, None),
    ("p", 1, T, 3, 0, None, None, None),
    (None, 1, T, 1, 0, "x", "lost", None),
]
NAMES = [("u1", "Ann", "a.png"), ("u1", "Bob", None), ("p", "Pat", None), ("g@chatroom", "The group", None)]


def made(spark, form="jsonl", **given):
    msgs = spark.createDataFrame(ROWS, MSGS)
    names = spark.createDataFrame(NAMES, "username string, display_name string, avatar string")
    listed = spark.createDataFrame([("g@chatroom", "u9"), ("g@chatroom", "u2"), ("g@chatroom", None), ("other@chatroom", "u5")], "chatroom_id string, username string")
    nicknames = spark.createDataFrame([("g@chatroom", "u1", " captain "), ("g@chatroom", "u2", " ")], "chatroom_id string, username string, nickname string")
    return exchange.documents(msgs, names, "me", 99, listed, nicknames, form, records=True, **given)


def written(path, session):
    return [line for part in sorted(Path(path, f"session_id={session}").glob("part=*")) for f in sorted(part.glob("*.txt")) for line in f.read_text("utf-8").split("\n") if line]


@pytest.mark.parametrize("part_lines", [1, 2, 1000])
def test_document_of_lines(spark, tmp_path, part_lines):
    exchange.write_documents(made(spark), str(tmp_path / "out"), part_lines=part_lines)
    head, *rest = [json.loads(x) for x in written(tmp_path / "out", "g%40chatroom") or written(tmp_path / "out", "g@chatroom")]
    assert head == {"_type": "header", "chatlab": {"version": "0.0.2", "exportedAt": 99, "generator": "chatloom"}, "meta": {"name": "The group", "platform": "wechat", "type": "group", "groupId": "g@chatroom"}}
    members = [m for m in rest if m["_type"] == "member"]
    assert members == rest[: len(members)]
    assert [m["platformId"] for m in members] == ["u1", "u2", "me", "u9", "Zoe"]
    assert members[0] == {"_type": "member", "platformId": "u1", "accountName": "Ann", "groupNickname": "captain", "avatar": "a.png"}
    assert members[1] == {"_type": "member", "platformId": "u2", "accountName": "u2"}
    one, two, three, four = rest[len(members) :]
    assert one == {"_type": "message", "sender": "u1", "accountName": "Ann", "groupNickname": "captain", "timestamp": T, "type": 0, "content": "hello"}
    assert two["replyToMessageId"] == "18446744073709551615" and "platformMessageId" not in two
    assert three["content"] == 'line one\nline "two" \u2028 end' and three["platformMessageId"] == "7"
    assert [(r["sender"], r["type"], r["content"]) for r in four["chatRecords"]] == [("Zoe", 0, "one"), ("unknown", 4, "[文件] a.pdf"), ("u1", 1, "[图片]")]
    assert [r["timestamp"] for r in four["chatRecords"]] == [1704164645, T + 200000, T + 200000] and four["sender"] == "me"
    private = [json.loads(x) for x in written(tmp_path / "out", "p")]
    assert [x["_type"] for x in private] == ["header", "member", "message", "message"] and private[0]["meta"] == {"name": "Pat", "platform": "wechat", "type": "private"}
    again = exchange.read_documents(spark, str(tmp_path / "out"))
    assert again.where("_type is null").count() == 0 and again.groupBy("session_id", "_type").count().count() == 6
    assert again.where("content like 'line%'").first()["platformMessageId"] == "7"


def test_document_as_one_object(spark, tmp_path):
    exchange.write_documents(made(spark, "json"), str(tmp_path / "out"), part_lines=2)
    whole = json.loads("\n".join(written(tmp_path / "out", "g%40chatroom") or written(tmp_path / "out", "g@chatroom")))
    assert list(whole) == ["chatlab", "meta", "members", "messages"] and len(whole["members"]) == 5 and [m["timestamp"] for m in whole["messages"]] == [T, T, T + 90000, T + 200000]
    assert len(json.loads("\n".join(written(tmp_path / "out", "p")))["messages"]) == 2


def test_documents_of_nothing(spark):
    none = spark.createDataFrame([], MSGS)
    assert exchange.documents(none, spark.createDataFrame([], "username string, display_name string"), "me", 1).count() == 0
    with pytest.raises(ValueError, match="form"):
        made(spark, "xml")


def test_places_have_no_gap(spark):
    rows = [("s", i % 7, T + (i * 7919) % 400000, 1, i % 2, f"u{i % 23}", "x", None) for i in range(500)]
    lines = exchange.documents(spark.createDataFrame(rows, MSGS), spark.createDataFrame([], "username string, display_name string"), "me", 1).orderBy("place").collect()
    assert [r["place"] for r in lines] == list(range(len(lines)))
    times = [json.loads(r["line"]).get("timestamp") for r in lines if '"message"' in r["line"]]
    assert times == sorted(times) and len(times) == 500


def test_phrases_and_emoji_are_a_members(spark):
    texts = [("g", "a", 1, "a:\n ok "), ("g", "a", 1, "ok"), ("g", "b", 1, "ok"), ("g", "b", 244813135921, "[x][y] [x]"), ("g", "b", 3, "[x]"), ("g", "a", 1, "  "), ("g", "a", 1, None), ("g", "b", 1, "x" * 21), ("g", "b", 1, "\U0001f600" * 11)]
    msgs = spark.createDataFrame(texts, "session_id string, sender string, local_type bigint, content string")
    assert {(r["sender"], r["phrase"], r["n"]) for r in groups.member_phrases(msgs).collect()} == {("a", "ok", 2), ("b", "ok", 1), ("b", "[x][y] [x]", 1)}
    assert {(r["sender"], r["token"], r["n"]) for r in groups.member_emoji(msgs).collect()} == {("b", "[x]", 2), ("b", "[y]", 1)}
    assert [r["token"] for r in groups.member_emoji(msgs, 1).collect()] == ["[x]"]


def test_profiles_without_times(spark):
    rows = [("g", "a", 1, 0), ("g", "a", 3, T + 3600), ("g", "a", 99, T + 86400), ("g", "b", 47, None)]
    found = {r["sender"]: r for r in groups.member_profiles(spark.createDataFrame(rows, "session_id string, sender string, local_type bigint, create_time bigint")).collect()}
    a, b = found["a"], found["b"]
    assert (a["total"], a["text"], a["image"], a["other"], a["active_days"], a["first_time"], a["last_time"]) == (3, 1, 1, 1, 2, T + 3600, T + 86400)
    assert a["hours"] == "1,1" + ",0" * 22 and (b["emoji"], b["active_days"], b["first_time"], b["hours"]) == (1, 0, None, ",".join("0" * 24))


def brute_segments(rows, gap=300):
    runs = []
    for s, i, t, mine in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if not runs or runs[-1][0][0] != s or t - runs[-1][-1][1] > gap:
            runs.append([])
        runs[-1].append((s, t, mine))
    out = set()
    for run in runs:
        first = min((t for _, t, mine in run if not mine), default=None)
        reply = min((t for _, t, mine in run if mine and first is not None and t >= first), default=None)
        out.add((run[0][0], run[0][1], run[-1][1], len(run), first, reply))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_segments_over_hours_are_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = [(s, i, T + draw.randrange(40 * 3600), int(draw.random() < draw.choice([0.02, 0.5]))) for s in "ab" for i in range(700)]
    rows += [("c", i, T + i * 290, int(i > 60)) for i in range(80)] + [("d", i, T + i * 290, int(i < 30)) for i in range(40)]
    found = sequence.segments(spark.createDataFrame(rows, "session_id string, local_id bigint, create_time bigint, is_send int")).collect()
    assert {(r["session_id"], r["first_time"], r["last_time"], r["total"], r["first_incoming"], r["first_reply"]) for r in found} == brute_segments(rows)


@pytest.mark.parametrize("bucket", [1, 500, 10**9])
def test_budget_over_buckets_is_brute_force(spark, bucket):
    draw = random.Random(bucket)
    rows = [(s, i, T + draw.randrange(5000), draw.choice([None, "", "abc", "x" * 30])) for s in "ab" for i in range(300)]
    want = set()
    for s in "ab":
        room = 0
        for _, i, _t, line in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            room += 0 if line is None else len(line) + 1
            if room <= 777:
                want.add((s, i, room))
    lines = spark.createDataFrame(rows, "session_id string, local_id bigint, create_time bigint, line string")
    assert {(r["session_id"], r["local_id"], r["run"]) for r in sequence.within_budget(lines, 777, bucket).collect()} == want


def test_unread_state_is_bounded_and_exact(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("s", i, T + i, 1, 0, "", None, "m") for i in range(50)] + [("s", 99, T + 3, 1, 1, "", None, "m"), ("t", 1, None, 1, 0, "", None, "m")])
    put(spark, folder, [("s", 100, T + 500, 1, 0, "", None, "m")])
    put(spark, folder, [("s", 101, T + 490, 1, 0, "", None, "read")])
    put(spark, folder, [("s", 102, T + 480, 1, 0, "", None, "m"), ("s", 103, T + 501, 1, 0, "", None, "m")])
    put(spark, folder, [("s", 104, T + 100, 1, 0, "", None, "read")])
    stream = feed.unread_since_read(feed.file_stream(spark, folder, SCHEMA, 1), delay=100)
    rows = feed.drained(stream.where(F.col("session_id") == "s"), "unread_bounded", "update").collect()
    assert sorted(r["unread"] for r in rows) == [1, 2, 2, 50, 51]
