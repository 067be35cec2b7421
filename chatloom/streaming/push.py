"""The push of new and of revoked messages, and what is remembered of a session from one round to the next.

A round sees what came since the last one. ``round_of_pushes`` is one round over whole
tables; ``pushes`` is the same as a stream, whose state holds each session's baseline,
the messages seen and of late, and the ids of messages that were revoked.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import identity
from ..functions.text import xml_value
from ..operators.lookups import small

# By what a revoke is known, how it is told, where its id stands; seconds that a round looks back, that a
# revoke's original may be back where it was not fetched, and that ids are remembered.
REVOKE_MARKS = ("revokemsg", "<replacemsg", "撤回了一条消息", "尝试撤回此消息")
REVOKE_WORD, OWN_REVOKE, UNKNOWN_ID, UNKNOWN_TEXT = "撤回", "你撤回", "未知", "未知内容"
REVOKE_TEXT = "对方撤回了一条消息（rawid：%s） 内容为“%s”"
ID_TAGS = ("newmsgid", "msgid", "oldmsgid", "svrid")
FOLDED = "placeholder_foldgroup"
LOOK_BACK, REVOKE_BACK, REMEMBERED = 2, 300, 600
# End of fixed values.

POSITION = ("create_time", "sort_seq", "local_id", "message_key")
PAYLOAD = "event string, session_id string, session_type string, raw_id string, message_key string, content string, timestamp bigint"


def id_token(raw: Column) -> Column:
    """A message id without sign and leading zeros; null for none and zero."""
    t = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    bare = F.when(F.rlike(t, F.lit("^-?[0-9]+$")), F.regexp_replace(t, "^-?0*(?=[0-9])", "")).otherwise(t)
    return F.when(~bare.isin("", "0"), bare)


def is_revoke(local_type: Column, content: Column) -> Column:
    c = F.coalesce(content, F.lit(""))
    marked = F.lit(False)
    for mark in REVOKE_MARKS:
        marked |= F.contains(c, F.lit(mark))
    return marked | (local_type.isin(10000, 10002) & F.contains(c, F.lit(REVOKE_WORD)))


def prepared(msgs: DataFrame) -> DataFrame:
    """Messages (session_id, local_id, server_id, sort_seq, create_time, local_type, is_send, content) with what a round asks of them."""
    tags = [id_token(xml_value(F.col("content"), t)) for t in ID_TAGS]
    server, c = id_token(F.col("server_id")), F.coalesce(F.col("content"), F.lit(""))
    revoke = F.coalesce(is_revoke(F.col("local_type"), F.col("content")), F.lit(False))
    return msgs.select(
        "session_id", F.concat_ws(":", "session_id", F.col("create_time").cast("string"), F.col("local_id").cast("string")).alias("message_key"), "create_time", F.coalesce("sort_seq", F.lit(0)).cast("bigint").alias("sort_seq"), "local_id",
        (F.coalesce("is_send", F.lit(0)) == 1).alias("mine"), revoke.alias("revoke"), F.contains(c, F.lit(OWN_REVOKE)).alias("own"), F.when(revoke, F.coalesce(*tags, server)).alias("revoked_id"), server.alias("raw_id"),
        F.array_distinct(F.array_compact(F.array(server, id_token(F.col("local_id")), *tags))).alias("tokens"), F.col("content"), *[c for c in ("ts", "unread_count", "kind") if c in msgs.columns],
    )


def session_type(session_id: Column, kind: Column | None = None) -> Column:
    kind = F.lit(None) if kind is None else kind
    return F.when(F.endswith(session_id, F.lit(identity.GROUP_MARK)), "group").when(F.startswith(session_id, F.lit(identity.OFFICIAL_PREFIX)) | (kind == "official"), "official").when(kind == "friend", "private").otherwise("other")


def next_baselines(sessions: DataFrame, baselines: DataFrame | None, now: int) -> DataFrame:
    """(username, last_timestamp, unread_count) to compare the next round with: times never go back, a session without one begins now."""
    own = sessions.where(F.trim("username") != "")
    t = F.coalesce("last_timestamp", F.lit(0))
    first = F.when(t > 0, t).otherwise(now)
    if baselines is None:
        return own.select("username", first.alias("last_timestamp"), F.coalesce("unread_count", F.lit(0)).alias("unread_count"))
    known = baselines.select("username", F.col("last_timestamp").alias("_then"))
    return own.join(known, "username", "left").select("username", F.when(F.col("_then").isNull(), first).otherwise(F.greatest(t, F.col("_then"))).alias("last_timestamp"), F.coalesce("unread_count", F.lit(0)).alias("unread_count"))


def inspected(sessions: DataFrame, baselines: DataFrame) -> DataFrame:
    """Sessions to look into, with ``base_time`` and ``base_unread``: time went on, unread changed, or the summary tells of a revoke; new ones where something is unread."""
    u, t, n = F.col("username"), F.coalesce("last_timestamp", F.lit(0)), F.coalesce("unread_count", F.lit(0))
    joined = sessions.join(baselines.select("username", F.col("last_timestamp").alias("base_time"), F.col("unread_count").alias("base_unread")), "username", "left")
    summary = F.col("summary") if "summary" in sessions.columns else F.lit("")
    revoked = (F.col("last_msg_type") == 10002) | F.contains(F.coalesce(summary, F.lit("")), F.lit(REVOKE_MARKS[2])) | F.contains(F.coalesce(summary, F.lit("")), F.lit(REVOKE_MARKS[3]))
    changed = (F.coalesce(revoked, F.lit(False)) & (t >= F.col("base_time"))) | (t > F.col("base_time")) | (n != F.col("base_unread"))
    asked = F.when(F.col("base_time").isNull(), (n > 0) & (t > 0)).otherwise(changed)
    return joined.where((F.trim(u) != "") & ~F.contains(F.lower(u), F.lit(FOLDED)) & asked)


def merged_for_lookup(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both, rows of a message_key once and those of ``first`` before others; rows without a key all."""
    both = first.withColumn("_n", F.lit(0)).unionByName(second.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    keyed = both.where(F.trim("message_key") != "")
    kept = keyed.groupBy("message_key").agg(F.min_by(F.struct(*[c for c in keyed.columns if c not in ("_n", "message_key")]), "_n").alias("_r")).select("message_key", "_r.*")
    return kept.unionByName(both.where(F.coalesce(F.trim("message_key"), F.lit("")) == "").drop("_n"))


def nearest_before(msgs: DataFrame, wanted: Column, columns: list[str], bucket: int = 86400) -> DataFrame:
    """Adds struct ``nearest`` of the session's last ``wanted`` message before each one; buckets of time carry it on, so a session is never sorted as a whole."""
    cut = msgs.withColumn("_bucket", F.expr(f"create_time div {bucket}")).withColumn("_own", F.when(wanted, F.struct(*POSITION, *[F.col(c).alias(f"v_{c}") for c in columns])))
    within = Window.partitionBy("session_id", "_bucket").orderBy(*POSITION).rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("_near", F.max("_own").over(within))
    tails = cut.groupBy("session_id", "_bucket").agg(F.max("_own").alias("_tail"))
    earlier = Window.partitionBy("session_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("session_id", "_bucket", F.max("_tail").over(earlier).alias("_far"))
    found = near.join(carried, ["session_id", "_bucket"], "left").withColumn("_found", F.coalesce("_near", "_far"))
    value = F.struct(F.col("_found.create_time").alias("create_time"), *[F.col(f"_found.v_{c}").alias(c) for c in columns])
    return found.withColumn("nearest", F.when(F.col("_found").isNotNull(), value)).drop("_bucket", "_own", "_near", "_far", "_found")


def candidates(fetched: DataFrame) -> DataFrame:
    """Of a round's messages (with base_time, base_unread, unread_count) those to push: incoming ones behind the baseline, revokes, and of its very second as many of the last as the unread count tells of."""
    t, base = F.col("create_time"), F.col("base_time")
    sure = F.when(base.isNotNull() & (t < base), F.col("revoke")).otherwise(~F.col("mine") & (F.coalesce(t != base, F.lit(True)) | F.col("revoke")))
    known = fetched.where(sure)
    later = known.where(base.isNull() | (t > base)).groupBy("session_id").agg(F.count("*").alias("_later"))
    same = fetched.where((t == base) & ~F.col("mine") & ~F.col("revoke")).join(later, "session_id", "left")
    allowed = F.greatest(F.lit(0), F.col("unread_count") - F.col("base_unread")) - F.coalesce("_later", F.lit(0))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(*[F.desc(c) for c in POSITION]))
    return known.unionByName(same.where(allowed > 0).withColumn("_nth", nth).where(F.col("_nth") <= allowed).drop("_nth", "_later"))


def originals(messages: DataFrame, revokes: DataFrame) -> DataFrame:
    """Each of ``revokes`` (rows of ``messages``) with the struct ``original``: the message of its id, else the nearest incoming one before that was fetched or is at most REVOKE_BACK seconds back."""
    told = ["message_key", "raw_id", "content"]
    ids = messages.where("not revoke").select("session_id", F.explode("tokens").alias("revoked_id"), F.struct(*POSITION).alias("_at"), F.struct("create_time", *told).alias("_o"))
    by_id = revokes.where("revoked_id is not null").select("session_id", F.col("message_key").alias("_revoke"), "revoked_id").join(ids, ["session_id", "revoked_id"])
    by_id = by_id.groupBy("session_id", "_revoke").agg(F.min_by("_o", "_at").alias("by_id"))
    near = nearest_before(messages, ~F.col("mine") & ~F.col("revoke"), told).where("revoke").select("session_id", F.col("message_key").alias("_revoke"), F.col("nearest"), F.col("create_time").alias("_t"))
    since = F.coalesce(F.greatest(F.lit(0), F.col("base_time") - LOOK_BACK), F.lit(0))
    found = revokes.join(by_id.withColumnRenamed("session_id", "_s"), (F.col("_s") == F.col("session_id")) & (F.col("_revoke") == F.col("message_key")), "left").drop("_s", "_revoke")
    found = found.join(near.withColumnRenamed("session_id", "_s"), (F.col("_s") == F.col("session_id")) & (F.col("_revoke") == F.col("message_key")), "left").drop("_s", "_revoke")
    close = (F.col("nearest.create_time") >= since) | (F.col("nearest.create_time") >= F.col("_t") - REVOKE_BACK)
    return found.withColumn("original", F.coalesce("by_id", F.when(close, F.col("nearest")))).drop("by_id", "nearest", "_t")


def revoke_text(raw_id: Column, content: Column, own_text: Column) -> Column:
    """The sentence that tells of a revoke: with the original's text, else the revoke's own replacement where it tells more."""
    instead = F.when((own_text != "") & ~F.contains(own_text, F.lit(REVOKE_MARKS[2])), own_text)
    text = F.trim(F.coalesce(F.nullif(F.trim(content), F.lit("")), instead, F.lit("")))
    return F.format_string(REVOKE_TEXT, F.coalesce(raw_id, F.lit(UNKNOWN_ID)), F.when(text == "", UNKNOWN_TEXT).otherwise(text))


def round_of_pushes(msgs: DataFrame, sessions: DataFrame, baselines: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """Payloads of one round: message.new and message.revoke, the latter also without an original.

    A message that is revoked in the same round, or whose id ``remembered`` (session_id,
    token, time) has for at most REMEMBERED seconds, is not pushed; own revokes tell
    nothing. Empty tables give no rows; rows of a message that repeat count once.
    """
    asked = small(inspected(sessions, baselines).select(F.col("username").alias("session_id"), "base_time", "base_unread", F.coalesce("unread_count", F.lit(0)).alias("unread_count")))
    every = prepared(msgs).dropDuplicates(["message_key"]).join(asked, "session_id")
    fetched = every.where(F.col("base_time").isNull() | (F.col("create_time") >= F.greatest(F.lit(0), F.col("base_time") - LOOK_BACK)))
    chosen = candidates(fetched)
    revokes = originals(every, chosen.where("revoke"))
    since = F.coalesce(F.greatest(F.lit(0), F.col("base_time") - LOOK_BACK), F.lit(0))
    suppressed = revokes.where(F.col("original").isNotNull() & (F.col("original.create_time") >= since)).select(F.col("original.message_key").alias("message_key")).distinct()
    new = chosen.where("not revoke").join(suppressed, "message_key", "left_anti")
    if remembered is not None:
        late = new.select("session_id", "message_key", "create_time", F.explode("tokens").alias("token")).join(remembered.select("session_id", "token", "time"), ["session_id", "token"])
        new = new.join(late.where(F.col("create_time") - F.col("time") <= REMEMBERED).select("message_key").distinct(), "message_key", "left_anti")
    kind, content = session_type(F.col("session_id")), F.col("content")
    raw = F.coalesce("original.raw_id", "revoked_id", F.when(F.col("original").isNull(), F.col("raw_id")))
    told = revokes.where("not own").select(F.lit("message.revoke").alias("event"), "session_id", kind.alias("session_type"), F.coalesce(raw, F.lit(UNKNOWN_ID)).alias("raw_id"), "message_key", revoke_text(raw, F.col("original.content"), xml_value(content, "replacemsg")).alias("content"), F.col("create_time").alias("timestamp"))
    return new.select(F.lit("message.new").alias("event"), "session_id", kind.alias("session_type"), F.coalesce("raw_id", F.lit("")).alias("raw_id"), "message_key", "content", F.col("create_time").alias("timestamp")).unionByName(told)


class Originals:
    """Finds what revokes mean among messages: by a token, else the last incoming one before."""

    def __init__(self, messages: Iterable[dict]) -> None:
        held = [m for m in messages if not m["revoke"]]
        self.by_token: dict[str, list[dict]] = {}
        for m in held:
            for t in m["tokens"]:
                self.by_token.setdefault(t, []).append(m)
        self.incoming = sorted(((tuple(m[c] for c in POSITION), m) for m in held if not m["mine"]), key=lambda x: x[0])

    def of(self, revoke: dict, since: int | None = None) -> dict | None:
        """Among the messages from ``since`` on."""
        told = self.by_token.get(revoke["revoked_id"], ()) if revoke["revoked_id"] else ()
        found = next((m for m in told if since is None or m["create_time"] >= since), None)
        at = bisect_left(self.incoming, tuple(revoke[c] for c in POSITION), key=lambda x: x[0])
        near = self.incoming[at - 1][1] if at else None
        return found or (near if near and (since is None or near["create_time"] >= since) else None)


def _in_order(frames: Iterable[pd.DataFrame]) -> list[dict]:
    """Rows of each message_key once, by POSITION, nulls last; plain rows, as most sessions have few."""

    def at(row: dict) -> list[tuple]:
        return [(v is None or v != v, 0 if v is None or v != v else v) for v in map(row.get, POSITION)]

    rows = [dict(zip(f.columns, values)) for f in frames for values in zip(*(s.tolist() for _, s in f.items()))]
    first: dict[str, dict] = {}
    for r in sorted(rows, key=at):
        first.setdefault(r["message_key"], r)
    return list(first.values())


class PushRounds(StatefulProcessor):
    """State of one session; a micro-batch is a round.

    Rows of ``kind`` 'session' tell the session's time and unread count, others are
    messages. A round looks at messages from LOOK_BACK before the baseline on, and for
    originals REVOKE_BACK further; baselines never go back, so older messages, and ids
    of messages revoked over REMEMBERED before, are not put into the state. Timers of
    event time empty it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.baseline = handle.getValueState("baseline", "last_timestamp bigint, unread_count bigint, primed boolean")
        self.messages = handle.getMapState("messages", "message_key string", "create_time bigint, sort_seq bigint, local_id bigint, mine boolean, revoke boolean, raw_id string, tokens string, content string, pushed boolean")
        self.revoked = handle.getMapState("revoked", "token string", "time bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = _in_order(rows)
        told, found = [r for r in batch if r["kind"] == "session"], [r for r in batch if r["kind"] != "session"]
        before = self.baseline.get()
        time, unread, primed = before or (0, 0, False)
        now_unread = int(told[-1]["unread_count"]) if told else unread
        expected = max(0, now_unread - unread) if before else 0
        since = max(0, time - LOOK_BACK) if before else 0
        out, chosen, same, observed = [], [], [], 0
        fetched = [r for r in found if r["create_time"] >= since]
        # A session that was never seen has nothing in the state.
        kept = {r["message_key"]: self.messages.getValue((r["message_key"],)) for r in found if r["create_time"] >= since - REVOKE_BACK} if before else {}
        for r in fetched:
            known = kept.get(r["message_key"])
            seen, recent, t = known is not None, known is not None and known[-1], r["create_time"]
            if not r["mine"] and (not before or t > time or (primed and t == time)):
                observed += 1
            if before and not primed and t < time:
                chosen += [r] * bool(r["revoke"] and not recent)
            elif seen:
                chosen += [r] * bool(r["revoke"] and not recent)
            elif not r["mine"]:
                (same if before and not primed and t == time and not r["revoke"] else chosen).append(r)
        later = sum(not before or primed or r["create_time"] > time for r in chosen)
        allowed = max(0, expected - later) if before and not primed else 0
        push = [*(same[-allowed:] if allowed else []), *chosen]
        keys, near, held = {r["message_key"] for r in push}, Originals(fetched if any(r["revoke"] for r in push) else ()), None
        gone = {o["message_key"] for o in (near.of(r) for r in push if r["revoke"]) if o and o["message_key"] in keys}
        pushed, revoked, remembers = set(), {}, bool(before) and self.revoked.exists()
        for r in push:
            if r["revoke"]:
                if not r["own"]:
                    o = near.of(r)
                    if o is None and before:
                        held = held or Originals(self._held(since - REVOKE_BACK))
                        o = held.of(r, r["create_time"] - REVOKE_BACK)
                    revoked |= dict.fromkeys(filter(None, [*((o["raw_id"],) if o else ()), r["revoked_id"], r["raw_id"]]), r["create_time"])
                    raw = (o["raw_id"] if o else None) or r["revoked_id"] or (None if o else r["raw_id"]) or UNKNOWN_ID
                    instead = r["replaced"] if r["replaced"] and REVOKE_MARKS[2] not in r["replaced"] else ""
                    text = (((o["content"] or "").strip() if o else "") or instead).strip()
                    out.append(("message.revoke", r["session_type"], raw, r["message_key"], REVOKE_TEXT % (raw, text or UNKNOWN_TEXT), r["create_time"]))
                    pushed.add(r["message_key"])
                continue
            pushed.add(r["message_key"])
            if r["message_key"] not in gone and not self._was_revoked(r, revoked, remembers):
                out.append(("message.new", r["session_type"], r["raw_id"] or "", r["message_key"], r["content"], r["create_time"]))
        waits = expected > 0 and observed < expected
        newest = max((int(r["create_time"]) for r in batch if r["create_time"] == r["create_time"] and r["create_time"] is not None), default=time)
        last = max(time, newest)
        baseline = time if waits else last
        for r in found:
            if r["create_time"] >= baseline - LOOK_BACK - REVOKE_BACK:
                known = kept.get(r["message_key"])
                self.messages.updateValue((r["message_key"],), (r["create_time"], r["sort_seq"], r["local_id"], r["mine"], r["revoke"], r["raw_id"], "\n".join(r["tokens"]), r["content"], bool(known and known[-1] or r["message_key"] in pushed)))
        for token, then in revoked.items():
            if then >= baseline - LOOK_BACK - REMEMBERED:
                self.revoked.updateValue((token,), (then,))
            elif remembers and self.revoked.containsKey((token,)):
                self.revoked.removeKey((token,))
        self.baseline.update((baseline, unread if waits else now_unread, primed or len(found) > 0))
        self.handle.registerTimer((newest + REMEMBERED) * 1000)
        if out:
            yield pd.DataFrame([(e, key[0], *rest) for e, *rest in out], columns=["event", "session_id", "session_type", "raw_id", "message_key", "content", "timestamp"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        least = timerValues.getCurrentWatermarkInMs() // 1000 - REMEMBERED
        for old in [k for k, v in self.messages.iterator() if v[0] < least]:
            self.messages.removeKey(old)
        for old in [k for k, v in self.revoked.iterator() if v[0] < least]:
            self.revoked.removeKey(old)
        return iter(())

    def close(self) -> None:
        pass

    def _held(self, since: int) -> Iterator[dict]:
        names = ("create_time", "sort_seq", "local_id", "mine", "revoke", "raw_id", "tokens", "content")
        for k, v in self.messages.iterator():
            if v[0] >= since:
                yield {"message_key": k[0], **dict(zip(names, v)), "tokens": v[6].split("\n")}

    def _was_revoked(self, message: dict, revoked: dict[str, int], remembers: bool) -> bool:
        """Whether an id is among those ``revoked`` in this round or, where the state ``remembers`` any, before."""

        def time_of(token: str) -> int | None:
            known = self.revoked.getValue((token,)) if remembers and token not in revoked else None
            return known[0] if known else revoked.get(token)

        return any(then is not None and message["create_time"] - then <= REMEMBERED for then in map(time_of, message["tokens"]))


def pushes(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Payloads of a stream of messages and session rows (``kind`` 'session', with unread_count); ``ts`` is the event time.

    State is kept by the RocksDB provider, which this sets for the session. A
    micro-batch's rows of one session are in one task, so the source's rate bounds them.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = prepared(stream).withColumns({"session_type": session_type(F.col("session_id")), "replaced": xml_value(F.col("content"), "replacemsg"), "unread_count": F.coalesce("unread_count", F.lit(0))})
    rows = rows.withColumn("message_key", F.when(F.col("kind") == "session", F.concat_ws(":", F.lit("session"), F.col("create_time").cast("string"), F.col("unread_count").cast("string"))).otherwise(F.col("message_key")))
    return rows.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(PushRounds(), PAYLOAD, "append", "EventTime")
