"""Registered queries of nested values, records, identities and raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode
from ..operators import identities, records, social
from ..sources import model as m
from ..sources import rows
from .queries import query


@query("buffer_nicknames", """
with u as (select distinct user_id % 10 as g, user_id as n from events)
select concat('g', g, '@chatroom') as chatroom_id, concat('user_', n) as username, case when n % 6 = 1 then '名' else concat('Nick ', n) end as nickname
from u where n % 6 not in (2, 3, 4)""")
def buffer_nicknames(spark: SparkSession, d: str) -> DataFrame:
    """Members and nicknames found in a group's bytes, in which pairs stand between others: nameless ids, lengths beyond the end, names that are none."""
    n = F.col("user_id")
    member, name = F.concat(F.lit("user_"), n.cast("string")), F.when(n % 6 == 1, "名").when(n % 6 == 4, '"@').otherwise(F.concat(F.lit("Nick "), n.cast("string")))

    def piece(mark: str, text) -> F.Column:  # noqa: ANN001
        return F.concat(F.lit(mark), F.lpad(F.hex(F.octet_length(text)), 2, "0"), F.hex(text.cast("binary")))

    # A length of 255 ends nowhere, and a zero byte is no mark.
    second = F.when(n % 6 == 2, "00").when(n % 6 == 3, F.concat(F.lit("12FF01"), F.hex(name.cast("binary")))).otherwise(piece("12", name))
    pair = F.concat(F.when(n % 4 == 0, "0A0312").otherwise("08011A02"), piece("0A", member), second, F.lit("1801"))
    groups = m.table(spark, d, "events").select("user_id").distinct().groupBy(F.concat(F.lit("g"), (n % 10).cast("string"), F.lit("@chatroom")).alias("chatroom_id")).agg(F.unhex(F.array_join(F.sort_array(F.collect_list(pair)), "")).alias("buffer"))
    return groups.select("chatroom_id", F.inline(decode.buffer_nicknames("buffer")))


@query("post_comments", """
with c as (select page_id, i, page_id % 4 as style from (select page_id, unnest(range(1, page_id % 5 + 1)) as i from pages))
select page_id, concat(page_id, '-', i) as comment_id, concat('Name ', i) as nickname, case when i <> 3 then concat('u', i) end as username,
  case when i % 4 = 2 then '' else concat('text ', i) end as content, case when i > 1 then concat(page_id, '-', i - 1) end as ref,
  case when i > 1 then case when style = 1 then 'told' when i <> 4 then concat('Name ', i - 1) end end as ref_nickname,
  case when i % 4 = 2 then 1 else 0 end as pictures, case when i % 4 = 2 then concat('http://e/?a=1&b=', page_id) end as picture, case when i % 4 = 2 then 120 end as width
from c""")
def post_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of pages as posts, in four forms of markup: answers, pictures, names to be found."""
    p, style = F.col("page_id"), F.col("page_id") % 4
    number = lambda i: F.concat(p.cast("string"), F.lit("-"), i.cast("string"))

    def tagged(name, value):  # noqa: ANN001, ANN202
        name = name if not isinstance(name, str) else F.lit(name)
        return F.concat(F.lit("<"), name, F.lit(">"), value, F.lit("</"), name, F.lit(">"))

    def comment(i):  # noqa: ANN001, ANN202
        own = F.when(style == 0, "CommentUser").when(style == 1, "commentUser").when(style == 2, "comment").otherwise("user_comment")
        name = F.concat(F.lit("Name "), i.cast("string"))
        answer = F.when(i > 1, F.concat(tagged(F.when(style == 3, "ref_comment_id").otherwise("refCommentId"), number(i - 1)), tagged("ref_username", F.concat(F.lit("u"), (i - 1).cast("string"))), F.when(style == 1, "<refNickname>told</refNickname>").otherwise(""))).otherwise("<refCommentId>0</refCommentId>")
        picture = F.when(i % 4 == 2, F.concat(F.lit("<emojiinfo><cdn_url>http://e/?a=1&amp;b="), p.cast("string"), F.lit("</cdn_url><width>120px</width></emojiinfo><emojiinfo><md5>0</md5></emojiinfo>"))).otherwise(tagged("content", F.concat(F.lit(" text "), i.cast("string"))))
        return tagged(own, F.concat(tagged(F.when(style == 2, "id").otherwise("cmtid"), number(i)), F.when(i != 3, tagged("username", F.concat(F.lit("u"), i.cast("string")))).otherwise(""), tagged("nickName", name), answer, picture))

    every = F.array_join(F.transform(F.when(p % 5 > 0, F.sequence(F.lit(1), (p % 5).cast("int"))).otherwise(F.array().cast("array<int>")), comment), "\n")
    xml = F.concat(F.lit("<TimelineObject>"), tagged(F.when(style == 2, "commentList").when(style == 3, "comment_user_list").otherwise("CommentUserList"), every), F.lit("</TimelineObject>"))
    found = m.table(spark, d, "pages").select("page_id", F.inline(social.comments_of(xml)))
    first = F.get("emojis", F.lit(0))
    return found.select("page_id", F.col("id").alias("comment_id"), "nickname", "username", "content", "ref", "ref_nickname", F.size("emojis").alias("pictures"), first["url"].alias("picture"), first["width"].alias("width"))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    """Orders as summaries of periods of 1 to 90 days."""
    k = F.col("o_orderkey")
    return m.msg_orders(spark, d).select(F.col("session_id"), F.col("local_id").alias("record_id"), F.col("create_time").alias("period_start"), (F.col("create_time") + (F.col("local_id") % 90 + 1) * 86400).alias("period_end"), (F.col("create_time") + 7).alias("created_at"))


SUMMARIES_SQL = "s as (select session_id, local_id as record_id, create_time as period_start, create_time + (local_id % 90 + 1) * 86400 as period_end, create_time + 7 as created_at from msg_orders)"


@query("summary_records", f"with {SUMMARIES_SQL} select * from s where period_end >= 820000000 and period_start <= 825000000 order by period_start desc, record_id limit 50 offset 20")
def summary_records(spark: SparkSession, d: str) -> DataFrame:
    return records.period_records(_summaries(spark, d), begin=820_000_000, end=825_000_000, limit=50, offset=20)


@query("overlapping_summaries", f"with {SUMMARIES_SQL} select a.session_id, a.record_id as one, b.record_id as other from s a join s b on a.session_id = b.session_id and a.record_id < b.record_id and a.period_start <= b.period_end and b.period_start <= a.period_end")
def overlapping_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a session's summaries that tell of the same time."""
    s = _summaries(spark, d)
    return records.overlaps(s, s).where("l.record_id < r.record_id").select("session_id", F.col("l.record_id").alias("one"), F.col("r.record_id").alias("other"))


def _insights(spark: SparkSession, d: str) -> DataFrame:
    return m.msg_conv(spark, d).select("session_id", (F.col("create_time") * 1000 + F.col("local_id")).alias("record_id"), F.concat(F.lit("Name "), "session_id").alias("display_name"), F.when(F.col("local_id") % 3 == 0, "message_insight").alias("source_type"), F.col("create_time").alias("created_at"), F.col("content").alias("insight"), (F.col("local_id") % 2 == 0).alias("is_read"))


INSIGHTS_SQL = "i as (select session_id, create_time * 1000 + local_id as record_id, concat('Name ', session_id) as display_name, case when local_id % 3 = 0 then 'message_insight' end as source_type, create_time as created_at, content as insight, local_id % 2 = 0 as is_read from msg_conv)"


@query("insight_records", f"with {INSIGHTS_SQL} select * from i where coalesce(source_type, 'insight') = 'insight' and created_at between 1704500000 and 1709000000 and contains(lower(concat_ws(chr(10), display_name, session_id, coalesce(insight, ''))), 'name c1') order by created_at desc, record_id limit 200")
def insight_records(spark: SparkSession, d: str) -> DataFrame:
    return records.insight_records(_insights(spark, d), source_type="insight", begin=1_704_500_000, end=1_709_000_000, keyword=" NAME c1", limit=999)


@query("insight_facets", f"with {INSIGHTS_SQL} select session_id, arg_min(display_name, created_at) as display_name, count(*) as n from i group by 1")
def insight_facets(spark: SparkSession, d: str) -> DataFrame:
    return records.contact_facets(_insights(spark, d))


@query("insight_counts", f"with {INSIGHTS_SQL} select count(*) as total, count(*) filter (where created_at >= 1708000000) as today, count(*) filter (where not is_read) as unread from i")
def insight_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.record_counts(_insights(spark, d), 1_708_000_000)


@query("account_identities", """
with recursive a as (select concat('u', c_custkey) as username, unnest([concat('k', c_custkey), concat('k', case when c_custkey % 7 = 0 then c_custkey else c_custkey + 1 end)]) as key from customer),
links as (select distinct x.username as a, y.username as b from a x join a y using (key)),
reach as (select username, username as near from a union select r.username, l.b from reach r join links l on l.a = r.near)
select username, min(near) as identity from reach group by 1""")
def account_identities(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose keys form chains of seven: accounts that share a key with a neighbour are one identity."""
    k = F.col("c_custkey")
    key = lambda n: F.concat(F.lit("k"), n.cast("string"))
    return identities.joined_keys(m.table(spark, d, "customer").select(F.concat(F.lit("u"), k.cast("string")).alias("username"), F.array(key(k), key(F.when(k % 7 == 0, k).otherwise(k + 1))).alias("keys")))


@query("sender_counts_by_identity", """
with c as (select case when user_id % 2 = 0 then concat('U', user_id) else concat(' u', user_id, ' ') end as sender, count(*) as n from events group by 1),
i as (select concat('u', user_id) as username, concat('u', user_id - user_id % 5) as identity from (select distinct user_id from events) where user_id % 11 <> 0)
select coalesce(identity, lower(trim(sender))) as identity, cast(sum(n) as bigint) as n, count(distinct lower(trim(sender))) as ids from c left join i on username = lower(trim(sender)) group by 1""")
def sender_counts_by_identity(spark: SparkSession, d: str) -> DataFrame:
    """Messages by sender, summed over the ids of one account; ids differ in case and blanks."""
    n = F.col("user_id")
    text = lambda x: F.concat(F.lit("u"), x.cast("string"))
    events = m.table(spark, d, "events")
    counts = events.groupBy(F.when(n % 2 == 0, F.upper(text(n))).otherwise(F.concat(F.lit(" "), text(n), F.lit(" "))).alias("sender")).agg(F.count("*").alias("n"))
    known = events.where(n % 11 != 0).select(text(n).alias("username"), text(n - n % 5).alias("identity")).distinct()
    return identities.counts_by_identity(counts, known)


@query("greatest_candidate_counts", """
with c as (select concat('u', user_id) as sender, count(*) as n from events group by 1)
select concat('m', user_id) as username, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) as n from (select distinct user_id from events) left join c a on a.sender = concat('u', user_id) left join c b on b.sender = concat('u', user_id + 1)""")
def greatest_candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of two ids that a member may go by, one with a tail, the greater count."""
    n = F.col("user_id")
    events = m.table(spark, d, "events")
    counts = events.groupBy(F.concat(F.lit("u"), n.cast("string")).alias("sender")).agg(F.count("*").alias("n"))
    asked = events.select(n).distinct().select(F.concat(F.lit("m"), n.cast("string")).alias("username"), F.array(F.concat(F.lit("U"), n.cast("string"), F.lit("_ab12")), F.concat(F.lit("u"), (n + 1).cast("string")), F.lit(None).cast("string")).alias("candidates"))
    return identities.greatest_count(asked, counts)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Events as raw rows of four forms: names of three kinds, times in seconds, milliseconds and dates, ids as numbers, texts and halves."""
    i, t = F.col("event_id"), F.unix_timestamp("ts")
    big = (F.lit(1 << 62).cast("decimal(20,0)") * 2 + i).cast("decimal(20,0)")
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    plain = F.struct(i.alias("local_id"), big.alias("server_id"), F.lit(1).alias("local_type"), t.alias("create_time"), (i % 2).cast("string").alias("is_send"), user.alias("sender_username"), F.col("event_type").alias("message_content"), F.lit("db one").alias("db_name"), F.lit("Msg_1").alias("table_name"))
    camel = F.struct(i.cast("string").alias("msgLocalId"), F.struct(i.cast("int").alias("low"), F.lit(-2147483648).alias("high")).alias("MsgSvrId"), F.lit("34").alias("msgType"), (t * 1000 + 7).alias("msgTime"), (i % 2).alias("computed_is_send"), F.concat(user, F.lit(":\n"), F.col("event_type")).alias("message_content"), F.lit("/a/b (1).db").alias("_db_path"))
    other = F.struct(F.lit(None).cast("int").alias("local_id"), F.struct(F.lit("18446744073709551615").alias("value")).alias("SERVER_ID"), F.date_format("ts", "yyyyMMddHHmmss").alias("Create_Time"), F.lit(None).cast("int").alias("is_send"), F.lit("me_abcd").alias("sender_username"), (t * 1000 + i).alias("SORT_SEQ"), F.hex(F.concat(F.lit("content of event "), i.cast("string")).cast("binary")).alias("compress_content"))
    none = F.struct(F.lit("1.5e3").alias("svrId"), F.lit("x").alias("local_type"), F.lit(1).alias("is_send"))
    form = F.when(i % 4 == 0, F.to_json(plain)).when(i % 4 == 1, F.to_json(camel)).when(i % 4 == 2, F.to_json(other)).otherwise(F.to_json(none))
    return m.table(spark, d, "events").select(i.alias("event"), F.parse_json(form).alias("row"))


@query("raw_messages", """
with e as (select event_id as event, event_id % 4 as k, cast(floor(epoch(ts)) as bigint) as t, user_id, event_type from events),
m as (select event, k,
  case k when 0 then event when 1 then event else 0 end as local_id,
  case k when 0 then cast(cast(9223372036854775808 as hugeint) + event as varchar) when 1 then cast(cast(9223372036854775808 as hugeint) + event as varchar) when 2 then '18446744073709551615' else '1500' end as server_id,
  case k when 1 then 34 else 1 end::bigint as local_type, case k when 3 then 0 else t end as create_time,
  case k when 0 then t * 1000 when 1 then t * 1000 when 2 then t * 1000 + event else 0 end as sort_seq,
  case k when 2 then 1 when 3 then 1 else cast(event % 2 as integer) end as is_send,
  case k when 2 then 'me_abcd' when 3 then 'me' else concat('user_', user_id) end as sender,
  case k when 0 then event_type when 1 then concat('user_', user_id, ':', chr(10), event_type) when 2 then concat('content of event ', event) else '' end as content from e)
select *, case when k = 0 and local_id > 0 then concat('db%20one:Msg_1:', local_id) when k = 0 then concat('server:db%20one:', server_id, ':', create_time, ':', sort_seq, ':0:', sender, ':1') when k = 1 then concat('local:%2Fa%2Fb%20(1).db:', local_id, ':', create_time, ':', sort_seq, ':', sender, ':34') else concat('server:', server_id, ':', create_time, ':', sort_seq, ':0:', sender, ':1') end as message_key from m""")
def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    found = rows.messages_of(_raw(spark, d), "me")
    return found.select("event", (F.col("event") % 4).alias("k"), *[c for c in found.columns if c != "event"])


def _shards(spark: SparkSession, d: str) -> list[DataFrame]:
    """A group's messages in two shards of different columns that both have some of them, each with other text."""
    g = m.msg_group(spark, d).where("session_id = 'g3@chatroom'")
    i, kind = F.col("local_id"), F.col("local_type")
    system = F.when(i % 3 == 0, "<sysmsg><revokemsg><session>u3</session></revokemsg></sysmsg>").when(i % 3 == 1, "你撤回了一条消息").otherwise("joined")
    content = F.when(kind == m.SYSTEM, system).otherwise("first")
    one = g.where(i % 10 < 7).select("local_id", (i + 5).alias("server_id"), "local_type", "create_time", "is_send", F.col("sender").alias("sender_username"), content.alias("message_content"))
    other = g.where(i % 10 > 4).select(i.cast("string").alias("MsgLocalId"), F.format_string("00%d", i + 5).alias("svrId"), kind.cast("string").alias("type"), (F.col("create_time") * 1000).alias("msgTime"), F.col("is_send").cast("string").alias("computed_is_send"), F.col("sender").alias("sender_username"), F.when(kind == m.SYSTEM, system).otherwise("second").alias("message_content"), F.lit("x").alias("extra"))
    return [one, other]


COLLECTED_SQL = "c as (select concat(local_id, ':', create_time, ':', local_id + 5) as export_key, create_time, local_type, case when local_id % 10 < 7 then 0 else 1 end as shard, case when local_type = 10000 then case local_id % 3 when 0 then 'u3' when 1 then 'me' else session_id end when is_send = 1 then 'me' else sender end as sender, case when local_type = 10000 then null when local_id % 10 < 7 then 'first' else 'second' end as content from msg_group where session_id = 'g3@chatroom')"


@query("collected_shards", f"with {COLLECTED_SQL} select export_key, create_time, shard, sender, content from c where create_time between 1704499200 and 1705708800 and local_type in (1, 3, 10000)")
def collected_shards(spark: SparkSession, d: str) -> DataFrame:
    found = rows.collected(_shards(spark, d), "g3@chatroom", "me", 1_704_499_200, 1_705_708_800, types=(1, 3, 10000))
    return found.select("export_key", "create_time", "shard", "sender", F.when(F.col("local_type") != m.SYSTEM, F.col("content")).alias("content"))


@query("collected_of_sender", f"with {COLLECTED_SQL} select export_key, shard from c where sender = 'u3'")
def collected_of_sender(spark: SparkSession, d: str) -> DataFrame:
    return rows.collected(_shards(spark, d), "g3@chatroom", "me", sender=" U3 ").select("export_key", "shard")


@query("collected_members", f"with {COLLECTED_SQL} select sender, count(*) as n, min(create_time) as first_time, max(create_time) as last_time from c group by 1")
def collected_members(spark: SparkSession, d: str) -> DataFrame:
    return rows.outline(rows.collected(_shards(spark, d), "g3@chatroom", "me"))
