"""Rounds of pushes: a stream over batches with a restart, and one round over tables."""

import pytest
from pyspark.sql import functions as F

from chatloom.streaming import feed, push

T = 1704067200
SCHEMA = "session_id string, local_id bigint, server_id string, sort_seq bigint, create_time bigint, local_type bigint, is_send int, content string, kind string, unread_count bigint, ts timestamp"
REVOKE = "<sysmsg type='revokemsg'><newmsgid>%s</newmsgid></sysmsg>"


def rows_of(*messages):
    """(session, id, seconds, text or None) and, for session rows, (session, None, seconds, unread)."""
    out = []
    for s, i, t, what in messages:
        if i is None:
            out.append((s, 0, None, 0, T + t, 0, 0, None, "session", what))
        else:
            out.append((s, i, str(9000 + i), 0, T + t, 10002 if what and "revoke" in what or what and "撤回" in what else 1, int(bool(what) and what.startswith("mine")), what, "message", None))
    return out


def put(spark, folder, *messages):
    df = spark.createDataFrame([(*r, None) for r in rows_of(*messages)], SCHEMA).withColumn("ts", F.timestamp_seconds("create_time"))
    df.coalesce(1).write.mode("append").parquet(folder)


def run(spark, top):
    """One run over what is there, from the checkpoint of the last one; new rows."""
    stream = push.pushes(feed.file_stream(spark, f"{top}/in", SCHEMA, 1))
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{top}/out")
    q.awaitTermination()
    return {(r["message_key"].split(":")[-1], r["event"]): (r["raw_id"], r["content"]) for r in spark.read.schema(stream.schema).parquet(f"{top}/out").collect()}


def test_rounds_of_a_stream(spark, tmp_path):
    top = str(tmp_path)
    # A session that was there before: its messages up to the baseline are no news.
    put(spark, f"{top}/in", ("s", None, 100, 1), ("t@chatroom", 1, 0, "first"), ("t@chatroom", 2, 5, "gone at once"), ("t@chatroom", 3, 6, REVOKE % 9002))
    assert run(spark, top) == {("1", "message.new"): ("9001", "first"), ("3", "message.revoke"): ("9002", push.REVOKE_TEXT % ("9002", "gone at once"))}
    # Restarted: two came in the second of the baseline, of which one is unread; an old one and one's own are no news, a repeat neither.
    put(spark, f"{top}/in", ("s", None, 101, 2), ("s", 4, 90, "old"), ("s", 5, 100, "read"), ("s", 6, 100, "unread"), ("s", 7, 101, "mine"), ("t@chatroom", 1, 0, "first"), ("t@chatroom", 8, 20, "stays"))
    second = run(spark, top)
    assert {k for k in second if k[1] == "message.new"} == {("1", "message.new"), ("6", "message.new"), ("8", "message.new")}
    # Restarted again: a revoke finds its original in the state; its id is remembered, so that a late copy is no news. Own revokes tell nothing.
    put(spark, f"{top}/in", ("t@chatroom", 9, 30, "撤回了一条消息"), ("t@chatroom", 10, 31, "你撤回了一条消息"), ("s", 11, 110, REVOKE % "00123456"))
    third = run(spark, top)
    assert third[("9", "message.revoke")] == ("9008", push.REVOKE_TEXT % ("9008", "stays")) and ("10", "message.revoke") not in third
    assert third[("11", "message.revoke")][0] == "9006"  # no such id: the nearest incoming message before
    put(spark, f"{top}/in", ("s", 123456, 112, "late original"), ("s", 13, 113, "another"))
    put(spark, f"{top}/in", ("s", 14, 100_000, "next day"), ("t@chatroom", 15, 100_000, "next day"))
    put(spark, f"{top}/in", ("s", 123456, 100_001, "the id is forgotten"))
    last = run(spark, top)
    assert last[("13", "message.new")][1] == "another" and ("14", "message.new") in last and len(last) == 10
    assert last[("123456", "message.new")][1] == "the id is forgotten" and spark.read.parquet(f"{top}/out").where("content = 'late original'").isEmpty()


@pytest.fixture(scope="module")
def messages(spark):
    def make(*rows):
        return spark.createDataFrame([(*r, None) for r in rows_of(*rows)], SCHEMA).drop("kind", "unread_count", "ts")

    return make


def baselines(spark, *rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "username string, last_timestamp bigint, unread_count bigint, last_msg_type int")


def test_one_round(spark, messages):
    before, now = baselines(spark, ("a", T + 10, 1), ("b", T + 10, 5), ("c", T + 10, 0)), baselines(spark, ("a", T + 20, 2), ("b", T + 10, 5), ("c", T + 9, 0), ("d", T + 5, 0), ("e", T + 5, 1), ("placeholder_foldgroup", T + 99, 9))
    assert sorted(r["username"] for r in push.inspected(now, before).collect()) == ["a", "e"]
    rows = messages(("a", 1, 10, "same second"), ("a", 2, 20, "later"), ("a", 2, 20, "later"), ("b", 3, 10, "not asked"), ("e", 4, 1, "all are new"), ("d", 5, 5, "read"), ("a", 6, 15, None), ("e", 7, 3, "撤回了一条消息"))
    got = {(r["message_key"].split(":")[-1], r["event"]): r["content"] for r in push.round_of_pushes(rows, now, before).collect()}
    assert got == {("2", "message.new"): "later", ("6", "message.new"): None, ("7", "message.revoke"): push.REVOKE_TEXT % ("9004", "all are new")}
    remembered = spark.createDataFrame([("a", "9002", T + 1), ("a", "9006", T - 3600)], "session_id string, token string, time bigint")
    late = push.round_of_pushes(rows, now, before, remembered)
    assert sorted(r["message_key"].split(":")[-1] for r in late.collect()) == ["6", "7"]
    assert push.round_of_pushes(rows.limit(0), now, before).count() == 0 and push.round_of_pushes(rows, now.limit(0), before).count() == 0


def test_baselines_never_go_back(spark):
    now = baselines(spark, ("a", 50, 3), ("b", 0, 1), ("c", 7, 0), ("", 9, 9))
    first = {r["username"]: tuple(r)[1:] for r in push.next_baselines(now, None, 1000).collect()}
    assert first == {"a": (50, 3), "b": (1000, 1), "c": (7, 0)}
    then = {r["username"]: tuple(r)[1:] for r in push.next_baselines(now, baselines(spark, ("a", 80, 0), ("c", 5, 2)), 1000).collect()}
    assert then == {"a": (80, 3), "b": (1000, 1), "c": (7, 0)}


def test_lookup_merge_first_wins(spark):
    a = spark.createDataFrame([("k1", "first"), ("", "x"), (None, "y")], "message_key string, content string")
    b = spark.createDataFrame([("k1", "second"), ("k2", "other"), ("", "z")], "message_key string, content string")
    assert sorted((r["message_key"] or "", r["content"]) for r in push.merged_for_lookup(a, b).collect()) == [("", "x"), ("", "y"), ("", "z"), ("k1", "first"), ("k2", "other")]


def test_id_tokens(spark):
    got = spark.createDataFrame([("007",), ("-12",), ("0",), ("",), (None,), (" x1 ",), ("000",)], "v string").select(push.id_token(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == ["7", "12", None, None, None, "x1", None]


def test_nearest_crosses_buckets(spark):
    rows = [("s", i, i * 1000, 0, i % 4 == 0) for i in range(60)] + [("r", 1, 5, 0, True)]
    df = spark.createDataFrame(rows, "session_id string, local_id bigint, create_time bigint, sort_seq bigint, revoke boolean").withColumn("message_key", F.col("local_id").cast("string"))
    for bucket in (700, 5000, 10**9):
        got = push.nearest_before(df, ~F.col("revoke"), ["local_id"], bucket).where("session_id = 's'").collect()
        assert all((r["nearest"]["local_id"] if r["nearest"] else None) == max((i for i in range(r["local_id"]) if i % 4), default=None) for r in got)


class Held:
    """A state variable that counts calls."""

    calls = 0

    def __init__(self):
        self.held = {}

    def __getattr__(self, name):
        def call(*args):
            Held.calls += 1
            if name in ("update", "updateValue"):
                self.held[args[0] if name == "updateValue" else 0] = args[-1]
            if name == "removeKey":
                self.held.pop(args[0], None)
            return {"get": self.held.get(0), "getValue": self.held.get(*args[:1] or [0]) if name == "getValue" else None, "exists": bool(self.held), "containsKey": bool(args) and args[0] in self.held, "iterator": iter(list(self.held.items()))}.get(name)

        return call


def test_state_keeps_what_later_rounds_ask_for():
    """Calls and entries of the state do not grow with a long history; what is near the baseline is kept, late rows too."""
    import pandas as pd

    states = {}

    class Handle:
        registerTimer = staticmethod(lambda time: None)  # noqa: N815

        def _state(self, name, *schema):
            return states.setdefault(name, Held())

        getValueState = getMapState = _state  # noqa: N815

    rounds = push.PushRounds()
    rounds.init(Handle())

    def go(*messages):
        rows = [{"session_id": "s", "message_key": f"s:{T + t}:{i}", "create_time": T + t, "sort_seq": 0, "local_id": i, "mine": False, "revoke": what == "revoke", "own": False, "revoked_id": None, "raw_id": str(i), "tokens": [str(i)], "content": what, "ts": None, "unread_count": 0, "kind": "message", "session_type": "other", "replaced": None} for i, t, what in messages]
        return [tuple(r) for out in rounds.handleInputRows(("s",), iter([pd.DataFrame(rows)]), None) for r in out.itertuples(index=False)]

    Held.calls = 0
    assert len(go(*[(i, 1000 * i, "text") for i in range(1, 501)])) == 500
    assert Held.calls < 20 and len(states["messages"].held) == 1
    # Late, behind the baseline: no news, but a revoke may mean it.
    assert not go((501, 499_900, "late"))
    revoked = go((502, 500_001, "revoke"))
    assert [r[0] for r in revoked] == ["message.revoke"] and revoked[0][3] == "500"
    assert not go((500, 500_000, "text")) and set(states["messages"].held) == {(f"s:{T + t}:{i}",) for i, t in ((500, 500_000), (501, 499_900), (502, 500_001))}
    assert go((500, 500_100, "same id again")) == [] and len(go((503, 501_000, "new"))) == 1
