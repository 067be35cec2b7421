"""Registered queries of what goes on in rounds: pushes, triggers, changes, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time
from ..operators import triggers
from ..sources import model as m
from ..streaming import changes, feed, push
from .queries import query

#: The round before, by its time; what came later is new.
THEN = 1705708800


def _with_text(events: DataFrame) -> DataFrame:
    """Events as messages whose system lines are revokes: of an id, own ones, or of what came before."""
    i, other = F.col("local_id"), F.col("local_type") != m.SYSTEM
    content = F.when(other, F.concat(F.lit("text "), i.cast("string"))).when((i % 3 == 0) & (i > 150), F.format_string("<sysmsg type=\"revokemsg\"><newmsgid>00%s</newmsgid></sysmsg>", (i - 150).cast("string"))).when((i % 3 != 0) & (i % 7 == 0), "你撤回了一条消息").otherwise("撤回了一条消息")
    return events.withColumns({"content": content, "server_id": F.when(other, (i + 5_000_000).cast("string")), "sort_seq": F.lit(0).cast("bigint")})


TOLD_SQL = "told as (select session_id, local_id, create_time, is_send, session_id || ':' || create_time || ':' || local_id as k, local_type = 10000 as revoke, case when local_type <> 10000 then 'text ' || local_id end as content, local_type = 10000 and local_id % 3 <> 0 and local_id % 7 = 0 as own, case when local_type = 10000 and local_id % 3 = 0 and local_id > 150 then cast(local_id - 150 as varchar) end as rid, case when local_type <> 10000 then cast(local_id + 5000000 as varchar) end as raw from msg_events)"
BASE_SQL = f"base as (select session_id, max(create_time) as bt, count(*) filter (where is_send = 0) as bn from told where create_time <= {THEN} and session_id <> 'u5' group by 1)"


def _round_sql(base: str) -> str:
    return f"""
with {TOLD_SQL}, {base},
now as (select session_id, max(create_time) as t, count(*) filter (where is_send = 0) as n from told group by 1),
asked as (select session_id, bt, bn, n from now left join base using (session_id) where case when bt is null then n > 0 else t > bt or n <> bn end),
e as (select told.*, bt, bn, n, greatest(0, coalesce(bt, 0) - 2) as since from told join asked using (session_id)),
sure as (select * from e where create_time >= since and case when bt is not null and create_time < bt then revoke else is_send = 0 and (bt is null or create_time <> bt or revoke) end),
later as (select session_id, count(*) as c from sure where bt is null or create_time > bt group by 1),
same as (select e.*, row_number() over (partition by session_id order by create_time desc, local_id desc) as nth, greatest(0, n - bn) - coalesce(c, 0) as allowed from e left join later using (session_id) where create_time = bt and is_send = 0 and not revoke),
chosen as (select session_id, local_id, create_time, k, revoke, own, rid, raw, content, since from sure union all select session_id, local_id, create_time, k, revoke, own, rid, raw, content, since from same where nth <= allowed),
by_id as (select r.k, arg_min(o.k, (o.create_time, o.local_id)) as ok from chosen r join e o on o.session_id = r.session_id and not o.revoke and (cast(o.local_id as varchar) = r.rid or o.raw = r.rid) where r.revoke group by 1),
near as (select r.k, arg_max(o.k, (o.create_time, o.local_id)) as ok from chosen r join e o on o.session_id = r.session_id and not o.revoke and o.is_send = 0 and (o.create_time, o.local_id) < (r.create_time, r.local_id) where r.revoke group by 1),
revokes as (
  select c.*, o.k as ok, o.raw as oraw, o.content as ocontent, o.create_time as ot
  from chosen c left join by_id on by_id.k = c.k left join near on near.k = c.k left join e n on n.k = near.ok
  left join e o on o.k = coalesce(by_id.ok, case when n.create_time >= c.since or n.create_time >= c.create_time - 300 then near.ok end)
  where c.revoke)
select 'message.new' as event, session_id, 'other' as session_type, raw as raw_id, k as message_key, content, create_time as timestamp
from chosen where not revoke and k not in (select ok from revokes where ok is not null and ot >= since)
union all
select 'message.revoke', session_id, 'other', coalesce(oraw, rid, '未知'), k, '对方撤回了一条消息（rawid：' || coalesce(oraw, rid, '未知') || '） 内容为“' || coalesce(ocontent, '未知内容') || '”', create_time
from revokes where not own"""


@query("push_round", _round_sql(BASE_SQL))
def push_round(spark: SparkSession, d: str) -> DataFrame:
    """One round after the messages up to THEN, of which session u5 was not known."""
    told = _with_text(m.msg_events(spark, d))

    def known(msgs: DataFrame) -> DataFrame:
        return msgs.groupBy(F.col("session_id").alias("username")).agg(F.max("create_time").alias("last_timestamp"), F.count_if(F.col("is_send") == 0).alias("unread_count"), F.lit(0).alias("last_msg_type"))

    return push.round_of_pushes(told, known(told), known(told.where(f"create_time <= {THEN} and session_id <> 'u5'")))


@query("stream_pushes", _round_sql("base as (select null::varchar as session_id, null::bigint as bt, null::bigint as bn where false)"))
def stream_pushes(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream from its beginning, when no session is known; the files are one round."""
    told = _with_text(feed.event_stream(spark, d)).withColumns({"kind": F.lit("message"), "unread_count": F.lit(None).cast("bigint")})
    return feed.drained(push.pushes(told), "pushes")


def _triggers_sql(table: str, cooldown: int) -> str:
    return f"""
with recursive e as (select session_id, create_time, min(local_id) as local_id from {table} group by 1, 2),
t as (
  select session_id, min(create_time) as create_time from e group by 1
  union all
  select t.session_id, min(e.create_time) from t join e on e.session_id = t.session_id and e.create_time >= t.create_time + {cooldown} group by t.session_id)
select session_id, create_time, local_id from e join t using (session_id, create_time)"""


@query("activity_triggers", _triggers_sql("msg_events", 36 * 3600))
def activity_triggers(spark: SparkSession, d: str) -> DataFrame:
    return triggers.activity_triggers(m.msg_events(spark, d), 36 * 3600)


@query("group_activity_triggers", _triggers_sql("msg_group", 7200))
def group_activity_triggers(spark: SparkSession, d: str) -> DataFrame:
    return triggers.activity_triggers(m.msg_group(spark, d).drop("sender", "source"), 7200)


@query("due_schedules", """
with s as (select o_orderkey as task, o_orderkey % 4 as days, o_orderkey % 26 as hours, epoch_ms(o_orderdate) as created, case when o_orderkey % 3 = 0 then epoch_ms(o_orderdate) + 5000 else 0 end as first_at, case when o_orderkey % 5 < 2 then epoch_ms(o_orderdate) + 86400000 * (o_orderkey % 11) end as ran from orders),
i as (select *, (days * 24 + least(hours, 23)) * 3600000 as step from s),
b as (select *, case when step > 0 then case when first_at > 0 then first_at else created + step end end as initial, coalesce(ran, 0) as last from i)
select task, case when step > 0 then case when last > 0 then last + step else initial end end as next_at,
       case when step > 0 then case when last > 0 then case when 900000000000 >= last + step then 'interval:' || last || ':' || (900000000000 - last) // step end when 900000000000 >= initial then 'first:' || initial end end as due
from b""")
def due_schedules(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks that recur every 0 to 3 days and 0 to 25 hours."""
    k, created = F.col("o_orderkey"), F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    first, ran = F.when(k % 3 == 0, created + 5000).otherwise(0), F.when(k % 5 < 2, created + 86400000 * (k % 11))
    return m.table(spark, d, "orders").select(k.alias("task"), triggers.next_trigger(k % 4, k % 26, first, created, ran).alias("next_at"), triggers.due_key(k % 4, k % 26, first, created, ran, F.lit(900_000_000_000)).alias("due"))


@query("stored_ranges", """
with s as (select local_id, create_time, local_id % 9 as k, create_time // 86400 * 86400 as d0 from msg_events)
select local_id,
  case k when 1 then 'last7days' when 3 then 'custom' when 4 then 'all' when 5 then 'yesterday' when 6 then 'custom' when 7 then 'custom' else 'today' end as preset, k = 4 as all_time,
  case k when 1 then d0 - 6 * 86400 when 3 then d0 - 89 * 86400 when 4 then null when 5 then d0 - 86400 when 6 then create_time - 1000 when 7 then d0 else d0 end as range_begin,
  case k when 1 then create_time when 3 then create_time when 4 then null when 5 then d0 - 1 when 6 then create_time when 7 then d0 else create_time end as range_end
from s""")
def stored_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Stored export ranges of all forms, resolved at each message's time: names of now and of old, dates, numbers, an end before its start."""
    k, t = F.col("local_id") % 9, F.col("create_time")
    preset = F.when(k == 1, "7d").when(k == 2, " last3days ").when(k == 3, "90d").when(k == 4, "all").when(k == 5, "yesterday").when(k.isin(6, 7), "custom").when(k == 8, "nothing")
    start = F.when(k == 6, ((t - 1000) * 1000).cast("string")).when(k == 7, time.day_key(t))
    end = F.when(k == 6, (t * 1000).cast("string")).when(k == 7, time.day_key(t - 86400))
    found = time.stored_range(preset, F.lit(False), start, end, t)
    return m.msg_events(spark, d).select("local_id", found["preset"].alias("preset"), found["all_time"].alias("all_time"), found["begin"].alias("range_begin"), found["end"].alias("range_end"))


def _edits(msgs: DataFrame, first: bool) -> DataFrame:
    """Changes of some messages: two updates each, of which the later one came first, deletions, and one of no message."""
    i, s = F.col("local_id"), F.col("session_id")
    number = F.substring(s, 2, 9).cast("bigint") + i
    own = msgs.withColumn("number", number).where(number % 2 == (0 if first else 1))
    made = own.select(*changes.KEY, F.inline(F.when(number % 5 == 0, F.array(F.struct(F.lit(9).alias("version"), F.lit("update").alias("op"), F.concat(F.lit("new "), i.cast("string")).alias("content")), F.struct(F.lit(3).alias("version"), F.lit("update").alias("op"), F.lit("old").alias("content")))).when(number % 7 == 0, F.array(F.struct(F.lit(1).alias("version"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("content"))))))
    return made.unionByName(made.limit(1).select(F.lit("nobody").alias("session_id"), *[c for c in made.columns if c != "session_id"]))


@query("changed_messages", """
with e as (select *, cast(substr(session_id, 2, 9) as bigint) + local_id as number from msg_conv)
select session_id, local_id, create_time, local_type, is_send, case when number % 5 = 0 then concat('new ', local_id) else content end as content from e where number % 5 = 0 or number % 7 <> 0""")
def changed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages after two batches of changes, one of them compacted into the tables, one still in the log."""
    msgs = m.msg_conv(spark, d)
    log = changes.ChangeLog(spark, feed._folder(spark))
    log.write(msgs)
    log.append(_edits(msgs, True))
    log.compact()
    log.append(_edits(msgs, False))
    return log.read()
