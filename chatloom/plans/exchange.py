"""Registered queries of exchange documents and of members of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups, lookups
from ..sources import exchange
from ..sources import model as m
from ..streaming import feed
from .queries import NAME_SQL, NOW, SHOWN_SQL, query

#: Two lines of text for each event, with a head that names the sender.
SAID_SQL = "(select * replace (case when local_type = 10000 then 1 else local_type end as local_type), concat(sender, ':', chr(10), 'hello ', local_id % 17, ' [smile', local_id % 3, '][', local_id % 5, ']') as content from msg_group)"
HEAD_SQL = "concat('{\"_type\":\"header\",\"chatlab\":{\"version\":\"0.0.2\",\"exportedAt\":%d,\"generator\":\"chatloom\"},\"meta\":{\"name\":', to_json(session_id), ',\"platform\":\"wechat\",\"type\":\"%s\"%s}}')"


def _said(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("local_id")
    text = F.concat(F.col("sender"), F.lit(":\nhello "), (k % 17).cast("string"), F.lit(" [smile"), (k % 3).cast("string"), F.lit("]["), (k % 5).cast("string"), F.lit("]"))
    return m.msg_group(spark, d).withColumns({"content": text, "local_type": F.when(F.col("local_type") == m.SYSTEM, m.TEXT).otherwise(F.col("local_type"))})


@query("member_phrases", f"with s as (select session_id, sender, regexp_replace(content, '^[^:]*:\\n', '') as phrase, count(*) as n from {SAID_SQL} where local_type = 1 group by 1, 2, 3) select * from s where length(phrase) <= 20 qualify row_number() over (partition by session_id, sender order by n desc, phrase) <= 10")
def member_phrases(spark: SparkSession, d: str) -> DataFrame:
    return groups.member_phrases(_said(spark, d))


@query("member_emoji", f"with t as (select session_id, sender, unnest(regexp_extract_all(content, '\\[.*?\\]')) as token from {SAID_SQL} where local_type = 1), s as (select session_id, sender, token, count(*) as n from t group by 1, 2, 3) select * from s qualify row_number() over (partition by session_id, sender order by n desc, token) <= 3")
def member_emoji(spark: SparkSession, d: str) -> DataFrame:
    return groups.member_emoji(_said(spark, d), 3)


_HOURS = ", ".join(f"count(*) filter (where (create_time % 86400) // 3600 = {h})" for h in range(24))


@query("member_profiles", f"""
select session_id, sender, count(*) as total, count(*) filter (where local_type in (1, {m.QUOTE})) as text, count(*) filter (where local_type = 3) as image, count(*) filter (where local_type = 34) as voice,
count(*) filter (where local_type = 43) as video, count(*) filter (where local_type = 47) as emoji, count(*) filter (where local_type not in (1, {m.QUOTE}, 3, 34, 43, 47)) as other,
count(distinct create_time // 86400) as active_days, min(create_time) as first_time, max(create_time) as last_time, concat_ws(',', {_HOURS}) as hours from msg_group group by 1, 2""")
def member_profiles(spark: SparkSession, d: str) -> DataFrame:
    return groups.member_profiles(m.msg_group(spark, d))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return lookups.names(m.contacts(spark, d))


@query("exchange_documents", f"""
with p as (select *, case when is_send = 1 then 'u0' else session_id end as who from msg_conv),
f as (select session_id, who, min((create_time, local_id)) as first from p group by 1, 2),
b as (select *, row_number() over (partition by session_id order by first) as place, count(*) over (partition by session_id) as members from f),
n as (select username, {NAME_SQL} as name from contacts),
k as (select b.*, coalesce(name, who) as name from b left join n on username = who)
select session_id, 0 as place, {HEAD_SQL % (NOW, "private", "")} as line from b where place = 1
union all select session_id, place, concat('{{"_type":"member","platformId":', to_json(who), ',"accountName":', to_json(name), '}}') from k
union all select session_id, members + row_number() over (partition by session_id order by create_time, local_id), concat('{{"_type":"message","sender":', to_json(who), ',"accountName":', to_json(name), ',"timestamp":', create_time, ',"type":', case local_type when 1 then 0 else 80 end, ',"content":', to_json({SHOWN_SQL}), '}}')
from p join k using (session_id, who)""")
def exchange_documents(spark: SparkSession, d: str) -> DataFrame:
    return exchange.documents(m.msg_conv(spark, d), _names(spark, d), "u0", NOW)


@query("exchange_group_members", f"""
with p as (select session_id, case when is_send = 1 then 'u0' else sender end as who, create_time, local_id from msg_group where local_id % 3 = 0),
f as (select session_id, who, 0 as c, min((create_time, local_id)) as first from p group by 1, 2
  union all select chatroom_id, username, 1, (0, 0) from group_members where chatroom_id in (select session_id from p)),
o as (select session_id, who, min((c, first[1], first[2])) as first from f group by 1, 2),
n as (select username, {NAME_SQL} as name from contacts)
select session_id, who as platform_id, coalesce(name, who) as account_name, concat('nick ', substr(who, 2)) as group_nickname, row_number() over (partition by session_id order by first, who) - 1 as i, count(*) over (partition by session_id) as size
from o left join n on username = who""")
def exchange_group_members(spark: SparkSession, d: str) -> DataFrame:
    members = m.group_members(spark, d)
    every = members.select("chatroom_id", "username").unionByName(members.select("chatroom_id", F.lit("u0").alias("username")).distinct())
    nicknames = every.withColumn("nickname", F.concat(F.lit("nick "), F.substring("username", 2, 99)))
    msgs = exchange.prepared(m.msg_group(spark, d).where("local_id % 3 = 0"), "u0")
    return exchange.document_members(msgs, _names(spark, d), members, nicknames).drop("avatar")


@query("exchange_reread", """
select session_id, case when is_send = 1 then 'u0' else sender end as sender, create_time as timestamp, case local_type when 1 then 0 when 3 then 1 when 34 then 2 when 49 then 7 else 80 end as type, cast(local_id + 9223372036854775807 as varchar) as message_id from (select * replace (cast(local_id as hugeint) as local_id) from msg_group)""")
def exchange_reread(spark: SparkSession, d: str) -> DataFrame:
    """Documents of groups, written to the shared folder in parts and read again."""
    path = feed._folder(spark)
    msgs = m.msg_group(spark, d).withColumn("server_id", (F.col("local_id").cast("decimal(20,0)") + F.lit("9223372036854775807").cast("decimal(20,0)")).cast("string"))
    exchange.write_documents(exchange.documents(msgs, _names(spark, d), "u0", NOW, m.group_members(spark, d)), path, part_lines=1000)
    return exchange.read_documents(spark, path).where("_type = 'message'").select("session_id", "sender", "timestamp", "type", F.col("platformMessageId").alias("message_id"))
