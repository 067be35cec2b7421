"""The registered chat queries: a Spark callable and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, labels, text, time
from ..operators import footprint, groups, lookups, scan, sequence, social, stats
from ..sources import model as m
from ..sources import sinks
from ..streaming import feed
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A moment in the driver's data, an hour range of it, and one session of each kind.
NOW, BEGIN, END = 1706745600, 1704499200, 1705708800
SESSION, CHAT, GROUP = "u7", "c7", "g3@chatroom"
DAY_SQL = "strftime(make_timestamp(create_time * 1000000), '%Y-%m-%d')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = m.with_views(sql) if any(v in sql for v in m.SQL) else sql
        return f

    return add


COUNTS = "count(*) as total, count(*) filter (where is_send = 1) as sent, count(*) filter (where is_send <> 1) as received"
NAME_SQL = "coalesce(case when trim(remark) <> '' then remark end, case when trim(nick_name) <> '' then nick_name end, case when trim(alias) <> '' then alias end, username)"


@query("contact_ranking", f"select t.*, coalesce({NAME_SQL}, session_id) as display_name from (select session_id, {COUNTS}, max(create_time) as last_time from msg_events where create_time > 0 group by 1 order by total desc, session_id limit 20) t left join contacts on username = session_id")
def contact_ranking(spark: SparkSession, d: str) -> DataFrame:
    return stats.contact_ranking(m.msg_events(spark, d), lookups.names(m.contacts(spark, d)))


@query("overall_stats", f"""
select *, (last_time - first_time) // 86400 + 1 as duration_days, floor(total / ((last_time - first_time) // 86400 + 1) * 10 + 0.5) / 10 as per_day from (
select {COUNTS}, min(create_time) as first_time, max(create_time) as last_time, count(*) filter (where local_type in (1, 244813135921)) as text, count(*) filter (where local_type = 3) as image, count(*) filter (where local_type = 34) as voice, count(*) filter (where local_type = 43) as video, count(*) filter (where local_type = 47) as emoji, count(*) filter (where local_type not in (1, 244813135921, 3, 34, 43, 47)) as other,
count(distinct {DAY_SQL}) as active_days, count(distinct substr({DAY_SQL}, 1, 7)) * 20 as active_days_estimate, count(distinct session_id) as sessions from msg_events where create_time > 0)""")
def overall_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.overall(m.msg_events(spark, d))


@query("hour_distribution", "with h as (select cast(i as integer) as hour from range(24) r(i)), c as (select cast((create_time % 86400) // 3600 as integer) as hour, count(*) as n from msg_events group by 1) select hour, coalesce(n, 0) as n from h left join c using (hour)")
def hour_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.hours(m.msg_events(spark, d))


@query("weekday_distribution", "with w as (select cast(i as integer) as weekday from range(1, 8) r(i)), c as (select cast(isodow(make_timestamp(create_time * 1000000)) as integer) as weekday, count(*) as n from msg_events group by 1) select weekday, coalesce(n, 0) as n from w left join c using (weekday)")
def weekday_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.weekdays(m.msg_events(spark, d))


@query("month_distribution", f"select substr({DAY_SQL}, 1, 7) as month, count(*) as n from msg_orders group by 1")
def month_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.months(m.msg_orders(spark, d))


@query("self_sent_daily", f"select {DAY_SQL} as day, count(*) as n, min(create_time) as first_time, max(create_time) as last_time from msg_events where is_send = 1 group by 1")
def self_sent_daily(spark: SparkSession, d: str) -> DataFrame:
    return stats.self_sent_days(m.msg_events(spark, d))


@query("daily_filled", "with c as (select cast(make_timestamp(create_time * 1000000) as date) as d, count(*) as n from msg_conv group by 1), s as (select unnest(generate_series((select min(d) from c), (select max(d) from c), interval 1 day))::date as d) select strftime(d, '%Y-%m-%d') as day, coalesce(n, 0) as n from s left join c using (d)")
def daily_filled(spark: SparkSession, d: str) -> DataFrame:
    return stats.days_filled(m.msg_conv(spark, d))


@query("type_distribution", "select local_type, count(*) as n, case local_type when 1 then 'text' when 3 then 'image' when 34 then 'voice' when 49 then 'link' else 'system' end as label from msg_events group by 1")
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.type_distribution(m.msg_events(spark, d))


TYPES_SQL = "count(*) as total, count(*) filter (where is_send = 1) as mine, count(*) filter (where local_type = 34) as voice, count(*) filter (where local_type = 3) as image, count(*) filter (where local_type = 43) as video, count(*) filter (where local_type = 47) as emoji, 0::bigint as file, count(*) filter (where local_type = 50) as call, 0::bigint as transfer, 0::bigint as red_packet, min(create_time) as first_time, max(create_time) as last_time"


@query("session_type_stats", f"select session_id, {TYPES_SQL} from msg_events where create_time between {BEGIN} and {END} group by 1")
def session_type_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.session_types(m.msg_events(spark, d), BEGIN, END)


@query("group_type_stats", f"select session_id, {TYPES_SQL}, count(distinct sender) as senders from msg_group where create_time > 0 group by 1")
def group_type_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.session_types(m.msg_group(spark, d))


@query("session_counts", f"select session_id, {COUNTS}, min(create_time) as first_time, max(create_time) as last_time from msg_orders where create_time > 0 group by 1")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_session(m.msg_orders(spark, d))


@query("session_date_counts", f"select session_id, {DAY_SQL} as day, count(*) as n from msg_events group by 1, 2")
def session_date_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.days(m.msg_events(spark, d), ("session_id",))


@query("message_dates", f"select distinct {DAY_SQL} as day from msg_events where session_id = '{SESSION}'")
def message_dates(spark: SparkSession, d: str) -> DataFrame:
    return stats.days(m.msg_events(spark, d).where(F.col("session_id") == SESSION)).select("day")


@query("available_years", "select distinct cast(year(make_timestamp(create_time * 1000000)) as integer) as year from msg_orders")
def available_years(spark: SparkSession, d: str) -> DataFrame:
    return stats.years(m.msg_orders(spark, d))


@query("years_spanned", "select cast(unnest(range(greatest(2010, min(year(make_timestamp(create_time * 1000000)))), least(2100, max(year(make_timestamp(create_time * 1000000)))) + 1)) as integer) as year from msg_orders")
def years_spanned(spark: SparkSession, d: str) -> DataFrame:
    return stats.years_spanned(m.msg_orders(spark, d))


@query("export_estimate", "select count(*) as total, count(*) filter (where local_type = 34) as voice, count(*) filter (where local_type in (34, 3, 43, 47)) as media, count(*) filter (where local_type = 34 and local_id % 5 = 0) as cached, count(*) filter (where local_type = 34 and local_id % 5 <> 0) as to_transcribe, 2 * count(*) filter (where local_type = 34 and local_id % 5 <> 0) as seconds from msg_events")
def export_estimate(spark: SparkSession, d: str) -> DataFrame:
    msgs = m.msg_events(spark, d)
    return stats.export_estimate(msgs, msgs.where((F.col("local_type") == m.VOICE) & (F.col("local_id") % 5 == 0)))


# Sequences.

PREV = "select *, lag(create_time) over w as pt, lag(is_send) over w as ps from {t} window w as (partition by session_id order by create_time, local_id)"


@query("conversation_starts", f"with p as ({PREV.format(t='msg_events')}) select session_id, count(*) filter (where is_send = 1) as initiated, count(*) filter (where is_send <> 1) as received from p where pt is null or create_time - pt > 3600 group by 1")
def conversation_starts(spark: SparkSession, d: str) -> DataFrame:
    return sequence.conversation_starts(m.msg_events(spark, d))


@query("social_initiative", f"""
with p as ({PREV.format(t='msg_events')}),
s as (select session_id, count(*) filter (where is_send = 1) as i, count(*) filter (where is_send <> 1) as r from p where pt is null or create_time - pt > 3600 group by 1),
b as (select session_id as top_session, i as top_initiated from s where i > 0 order by i desc, session_id limit 1)
select cast(sum(i) as bigint) as initiated, cast(sum(r) as bigint) as received, any_value(top_session) as top_session, any_value(top_initiated) as top_initiated, floor(sum(i) / (sum(i) + sum(r)) * 1000 + 0.5) / 10 as initiative from s, b""")
def social_initiative(spark: SparkSession, d: str) -> DataFrame:
    return sequence.social_initiative(m.msg_events(spark, d))


@query("response_time", f"with p as ({PREV.format(t='msg_conv')}) select session_id, count(*) as n, cast(sum(create_time - pt) as bigint) as seconds, sum(create_time - pt) / count(*) as average from p where is_send = 1 and ps = 0 and create_time - pt > 0 and create_time - pt <= 3600 group by 1 having count(*) >= 2")
def response_time(spark: SparkSession, d: str) -> DataFrame:
    return sequence.response_times(m.msg_conv(spark, d), least=2)


@query("heatmap", "with e as (select cast(i // 24 as integer) as weekday, cast(i % 24 as integer) as hour from range(168) r(i)), c as (select cast(isodow(make_timestamp(create_time * 1000000)) - 1 as integer) as weekday, cast((create_time % 86400) // 3600 as integer) as hour, count(*) as n from msg_events group by 1, 2) select weekday, hour, coalesce(n, 0) as n from e left join c using (weekday, hour)")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return sequence.heatmap(m.msg_events(spark, d))


@query("midnight_king", "with c as (select session_id, count(*) as n from msg_events where (create_time % 86400) // 3600 < 6 group by 1) select session_id, n, floor(n / (select sum(n) from c) * 1000 + 0.5) / 10 as share from c order by n desc, session_id limit 1")
def midnight_king(spark: SparkSession, d: str) -> DataFrame:
    return sequence.midnight_king(m.msg_events(spark, d))


STREAKS = "a as (select distinct session_id, create_time // 86400 as d from {t}), b as (select *, d - row_number() over (partition by session_id order by d) as run from a), r as (select session_id, count(*) as days, min(d) as a, max(d) as b from b group by session_id, run)"


@query("longest_streak", f"with {STREAKS.format(t='msg_events')} select session_id, days, strftime(make_timestamp(a * 86400000000), '%Y-%m-%d') as first_day, strftime(make_timestamp(b * 86400000000), '%Y-%m-%d') as last_day from r qualify row_number() over (partition by session_id order by days desc, a) = 1")
def longest_streak(spark: SparkSession, d: str) -> DataFrame:
    return sequence.longest_streaks(m.msg_events(spark, d))


@query("peak_day", f"with c as (select {DAY_SQL} as day, session_id, count(*) as n from msg_events group by 1, 2), t as (select day, cast(sum(n) as bigint) as total from c group by 1 order by 2 desc, 1 limit 1) select day, total, session_id as top_session, n as top_n from c join t using (day) order by n desc, session_id limit 1")
def peak_day(spark: SparkSession, d: str) -> DataFrame:
    return sequence.peak_day(m.msg_events(spark, d))


@query("core_friends", f"select session_id, {COUNTS} from msg_events group by 1 order by total desc, session_id limit 3")
def core_friends(spark: SparkSession, d: str) -> DataFrame:
    return sequence.core_friends(m.msg_events(spark, d))


@query("monthly_top_friend", "with c as (select cast(month(make_timestamp(create_time * 1000000)) as integer) as month, session_id, count(*) as n from msg_orders group by 1, 2) select month, session_id, n from c qualify row_number() over (partition by month order by n desc, session_id) = 1")
def monthly_top_friend(spark: SparkSession, d: str) -> DataFrame:
    return sequence.monthly_top(m.msg_orders(spark, d))


@query("mutual_friend", "select session_id, count(*) filter (where is_send = 1) as sent, count(*) filter (where is_send <> 1) as received, count(*) filter (where is_send = 1) / count(*) filter (where is_send <> 1) as ratio from msg_events group by 1 having sent >= 5 and received >= 5 order by abs(ratio - 1), session_id limit 1")
def mutual_friend(spark: SparkSession, d: str) -> DataFrame:
    return sequence.mutual_friend(m.msg_events(spark, d), least=5)


@query("lost_friend", "select session_id, count(*) filter (where create_time between 694224000 and 852076800) as early, count(*) filter (where create_time between 852076800 and 867715200) as late from msg_orders group by 1 having early > 2 and early > 2 * late order by early desc, session_id limit 1")
def lost_friend(spark: SparkSession, d: str) -> DataFrame:
    return sequence.lost_friend(m.msg_orders(spark, d), 694224000, 852076800, 867715200, least=2, fall=2)


PHRASE_SQL = "local_type = 1 and length(trim(content)) between 2 and {most} and not contains(trim(content), 'http') and not contains(trim(content), '<') and not starts_with(trim(content), '[')"


def _two_words(spark: SparkSession, d: str) -> DataFrame:
    return m.msg_conv(spark, d).withColumn("content", F.substring_index("content", " ", 2))


TWO_WORDS_SQL = "select * replace (array_to_string(string_split(content, ' ')[1:2], ' ') as content) from msg_conv"


@query("top_phrases", f"with w as ({TWO_WORDS_SQL}) select trim(content) as phrase, count(*) as n from w where is_send = 1 and {PHRASE_SQL.format(most=20)} group by 1 having n >= 2 order by n desc, phrase limit 32")
def top_phrases(spark: SparkSession, d: str) -> DataFrame:
    return sequence.top_phrases(_two_words(spark, d))


@query("exclusive_phrases", f"""
with w as ({TWO_WORDS_SQL}),
c as (select trim(content) as phrase, count(*) filter (where is_send = 1) as a, count(*) filter (where is_send <> 1) as b from w where {PHRASE_SQL.format(most=20)} group by 1)
(select 'mine' as side, phrase, a as own, b as other from c where a >= 2 and a >= 0.75 * (a + b) order by a desc, phrase limit 20)
union all (select 'theirs', phrase, b, a from c where b >= 2 and b >= 0.75 * (a + b) order by b desc, phrase limit 20)""")
def exclusive_phrases(spark: SparkSession, d: str) -> DataFrame:
    return sequence.exclusive_phrases(_two_words(spark, d))


@query("first_messages", "select session_id, local_id, create_time, local_type, is_send, content, row_number() over (partition by session_id order by create_time, local_id) as nth from msg_conv qualify nth <= 10")
def first_messages(spark: SparkSession, d: str) -> DataFrame:
    return sequence.first_messages(m.msg_conv(spark, d))


@query("segments", f"""
with p as ({PREV.format(t='msg_conv')}),
o as (select *, sum(case when pt is null or create_time - pt > 300 then 1 else 0 end) over (partition by session_id order by create_time, local_id) as g from p),
s as (select session_id, g, min(create_time) as first_time, max(create_time) as last_time, {COUNTS}, min(create_time) filter (where is_send <> 1) as first_incoming from o group by 1, 2)
select session_id, first_time, last_time, total, sent, received, first_incoming, (select min(create_time) from o where o.session_id = s.session_id and o.g = s.g and is_send = 1 and create_time >= s.first_incoming) as first_reply, last_time - first_time as duration from s""")
def segments(spark: SparkSession, d: str) -> DataFrame:
    return sequence.segments(m.msg_conv(spark, d))


@query("segments_10_min", f"""
with p as ({PREV.format(t='msg_events')}),
o as (select *, sum(case when pt is null or create_time - pt > 600 then 1 else 0 end) over (partition by session_id order by create_time, local_id) as g from p)
select session_id, min(create_time) as first_time, max(create_time) as last_time, {COUNTS} from o group by session_id, g""")
def segments_10_min(spark: SparkSession, d: str) -> DataFrame:
    return sequence.segments(m.msg_events(spark, d), gap=600).select("session_id", "first_time", "last_time", "total", "sent", "received")


@query("silent_sessions", f"select session_id, max(create_time) as last_time, ({NOW} - max(create_time)) // 86400 as silent_days from msg_events group by 1 having max(create_time) <= {NOW} - 3 * 86400")
def silent_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sequence.silent_sessions(m.msg_events(spark, d), NOW, 3)


@query("month_stats", """
with d as (select session_id, strftime(make_timestamp(create_time * 1000000), '%Y-%m') as month, create_time // 86400 as d, count(*) as n, count(*) filter (where is_send = 1) as mine, min(create_time) as a, max(create_time) as b from msg_events group by 1, 2, 3),
r as (select *, d - row_number() over w as run, d - lag(d) over w - 1 as silence from d window w as (partition by session_id, month order by d)),
c as (select *, count(*) over (partition by session_id, month, run) as k from r),
s as (select session_id, month, cast(sum(n) as bigint) as total, cast(sum(mine) as bigint) as mine, count(*) as active_days, max(k) as longest_streak, cast(coalesce(max(silence), 0) as integer) as longest_silence, min(a) as first_time, max(b) as last_time from c group by 1, 2),
h as (select session_id, strftime(make_timestamp(create_time * 1000000), '%Y-%m') as month, (create_time % 86400) // 3600 as hour, count(*) as n from msg_events group by 1, 2, 3),
t as (select session_id, month, string_agg(hour, ',' order by n desc, hour) as busiest_hours from (select * from h qualify row_number() over (partition by session_id, month order by n desc, hour) <= 3) group by 1, 2)
select s.*, total - mine as theirs, busiest_hours from s join t using (session_id, month)""")
def month_stats(spark: SparkSession, d: str) -> DataFrame:
    return sequence.month_stats(m.msg_events(spark, d))


@query("fixed_periods", "select session_id, create_time - create_time % 21600 as period_start, count(*) as n, create_time - create_time % 21600 + 21600 as period_end from msg_group group by 1, 2, 4")
def fixed_periods(spark: SparkSession, d: str) -> DataFrame:
    return sequence.fixed_periods(m.msg_group(spark, d), 6)


@query("due_periods", f"with p as (select session_id, create_time - create_time % 21600 as period_start, count(*) as n from msg_group group by 1, 2) select session_id, period_start, period_start + 21600 as period_end, n from p where period_start + 21600 <= {END} and (period_start // 21600) % 3 <> 0")
def due_periods(spark: SparkSession, d: str) -> DataFrame:
    periods = sequence.fixed_periods(m.msg_group(spark, d), 6)
    return sequence.due_periods(periods, periods.where(F.expr("(period_start div 21600) % 3 = 0")).select("session_id", "period_start", "period_end"), END)


@query("within_budget", "select session_id, local_id, content from (select *, sum(length(content) + 1) over (partition by session_id order by create_time, local_id) as run from msg_conv) where run <= 2000")
def within_budget(spark: SparkSession, d: str) -> DataFrame:
    return sequence.within_budget(m.msg_conv(spark, d).withColumn("line", F.col("content")), 2000).select("session_id", "local_id", "content")


@query("representative_sample")
def representative_sample(spark: SparkSession, d: str) -> DataFrame:
    return sequence.representative(m.msg_conv(spark, d))


@query("same_second_index", "select session_id, local_id, create_time, local_type, is_send, dense_rank() over (partition by session_id, create_time order by local_id) - 1 as nth from msg_events where local_type = 34")
def same_second_index(spark: SparkSession, d: str) -> DataFrame:
    return scan.same_second_index(m.msg_events(spark, d), m.VOICE)


# Footprint.

@query("footprint_sessions", f"select session_id, count(*) filter (where is_send <> 1) as incoming, count(*) filter (where is_send = 1) as outgoing, max(create_time) as latest, min(create_time) filter (where is_send <> 1) as first_incoming, max(create_time) filter (where is_send = 1) as last_reply from msg_events where create_time between {BEGIN} and {END} group by 1")
def footprint_sessions(spark: SparkSession, d: str) -> DataFrame:
    return footprint.private_rows(m.msg_events(spark, d), BEGIN, END)


@query("footprint_summary", f"with s as (select session_id, count(*) filter (where is_send <> 1) as i, count(*) filter (where is_send = 1) as o from msg_events where create_time between {BEGIN} and {BEGIN + 86400} group by 1) select count(*) filter (where i > 0) as inbound, count(*) filter (where i > 0 and o > 0) as replied, count(*) filter (where o > 0) as outbound, count(*) filter (where i > 0 and o > 0) / count(*) filter (where i > 0) as reply_rate from s")
def footprint_summary(spark: SparkSession, d: str) -> DataFrame:
    return footprint.summary(m.msg_events(spark, d), BEGIN, BEGIN + 86400)


def _with_mentions(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("source", "$.k")
    listed = F.concat(F.lit("<msgsource><atuserlist><![CDATA[,u"), k, F.lit(",@u"), F.col("local_id") % 9, F.lit("]]></atuserlist></msgsource>"))
    return m.msg_group(spark, d).withColumn("source", listed)


MENTIONS = f"select session_id, sender, local_id, create_time, local_type, is_send from msg_group where is_send = 0 and create_time between {BEGIN} and {END} and ('u' || json_extract_string(source, '$.k') = 'u3' or local_id % 9 = 3) order by create_time desc, local_id desc, session_id limit 1000"


@query("mentions", MENTIONS)
def mentions(spark: SparkSession, d: str) -> DataFrame:
    return footprint.mentions(_with_mentions(spark, d), ["U3"], BEGIN, END).drop("source")


@query("mention_groups", f"select session_id, count(*) as n, max(create_time) as latest from ({MENTIONS}) group by 1")
def mention_groups(spark: SparkSession, d: str) -> DataFrame:
    return footprint.mention_groups(footprint.mentions(_with_mentions(spark, d), ["u3"], BEGIN, END))


# Groups.

@query("group_ranking", f"select session_id, sender, count(*) as n from msg_group where session_id = '{GROUP}' and create_time > 0 group by 1, 2 order by n desc, sender limit 20")
def group_ranking(spark: SparkSession, d: str) -> DataFrame:
    return groups.ranking(m.msg_group(spark, d), GROUP)


@query("group_active_hours", "with g as (select distinct session_id, cast(i as integer) as hour from msg_group, range(24) r(i)), c as (select session_id, cast((create_time % 86400) // 3600 as integer) as hour, count(*) as n from msg_group group by 1, 2) select session_id, hour, coalesce(n, 0) as n from g left join c using (session_id, hour)")
def group_active_hours(spark: SparkSession, d: str) -> DataFrame:
    return groups.active_hours(m.msg_group(spark, d))


@query("group_media_stats", "select session_id, cast(case when local_type in (1, 3, 34, 43, 47, 49) then local_type else -1 end as bigint) as local_type, count(*) as n from msg_group group by 1, 2")
def group_media_stats(spark: SparkSession, d: str) -> DataFrame:
    return groups.media(m.msg_group(spark, d))


@query("group_member_stats", "with b as (select session_id, sender, count(*) as n, count(distinct create_time // 86400) as active_days, min(create_time) as first_time, max(create_time) as last_time from msg_group group by 1, 2), h as (select session_id, sender, cast((create_time % 86400) // 3600 as integer) as busiest_hour, count(*) as k from msg_group group by 1, 2, 3), t as (select * from h qualify row_number() over (partition by session_id, sender order by k desc, busiest_hour) = 1) select b.*, busiest_hour from b join t using (session_id, sender)")
def group_member_stats(spark: SparkSession, d: str) -> DataFrame:
    return groups.member_stats(m.msg_group(spark, d))


@query("member_panel", f"with f as (select username from contacts where local_type = 1 and flag = 0), c as (select session_id, sender, count(*) as n from msg_group where create_time > 0 group by 1, 2) select chatroom_id, g.username, coalesce({NAME_SQL.replace('username', 'g.username')}, g.username) as display_name, is_owner, f.username is not null as is_friend, coalesce(n, 0) as n from group_members g left join contacts k on k.username = g.username left join f on f.username = g.username left join c on session_id = chatroom_id and sender = g.username")
def member_panel(spark: SparkSession, d: str) -> DataFrame:
    contacts = m.contacts(spark, d)
    return groups.member_panel(m.group_members(spark, d), lookups.names(contacts), contacts.where("local_type = 1 and flag = 0"), groups.rankings(m.msg_group(spark, d)))


@query("group_list", "select chatroom_id, count(*) as members, max(case when is_owner then g.username end) as owner, any_value(last_timestamp) as last_timestamp from group_members g left join sessions s on s.username = chatroom_id group by 1")
def group_list(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_list(m.group_members(spark, d), m.sessions(spark, d))


@query("merged_members", "with s as (select session_id, sender, count(*) as n from msg_group group by 1, 2) select coalesce(chatroom_id, session_id) as chatroom_id, coalesce(username, sender) as username, coalesce(is_owner, false) as is_owner, coalesce(n, 0) as n from (select * from group_members where username <> 'u1') full join s on session_id = chatroom_id and sender = username")
def merged_members(spark: SparkSession, d: str) -> DataFrame:
    return groups.merged_members(m.group_members(spark, d).where("username <> 'u1'"), m.msg_group(spark, d))


@query("mutual_groups", "select username, count(distinct chatroom_id) as groups from (select chatroom_id, username from group_members) join (select username from contacts where local_type = 1) using (username) group by 1")
def mutual_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookups.mutual_groups(m.group_members(spark, d), m.contacts(spark, d).where("local_type = 1"))


@query("group_friends", "select chatroom_id, count(distinct username) as friends from (select chatroom_id, username from group_members) join (select username from contacts where local_type = 1) using (username) group by 1")
def group_friends(spark: SparkSession, d: str) -> DataFrame:
    return lookups.group_friends(m.group_members(spark, d), m.contacts(spark, d).where("local_type = 1"))


@query("nickname_consensus", "select session_id as chatroom_id, sender as username, case when min(local_type) = max(local_type) then concat('n', min(local_type)) else '' end as nickname from msg_group where local_type <> 10000 group by 1, 2")
def nickname_consensus(spark: SparkSession, d: str) -> DataFrame:
    given = m.msg_group(spark, d).where("local_type <> 10000").select(F.col("session_id").alias("chatroom_id"), F.col("sender").alias("username"), F.concat(F.lit("n"), F.col("local_type").cast("string")).alias("nickname"))
    return lookups.nickname_consensus(given)


@query("emoji_tokens", "with t as (select session_id, unnest(regexp_extract_all(translate(content, 'ae', '[]'), '\\[.*?\\]')) as token from msg_conv where local_type = 1), c as (select session_id, token, count(*) as n from t group by 1, 2) select * from c qualify row_number() over (partition by session_id order by n desc, token) <= 10")
def emoji_tokens(spark: SparkSession, d: str) -> DataFrame:
    return groups.member_emoji(m.msg_conv(spark, d).withColumn("content", F.translate("content", "ae", "[]")), by=("session_id",))


# Scans and pages.

@query("keyword_search", "select session_id, local_id, create_time, local_type, is_send, content from msg_conv where create_time > 0 and contains(lower(content), 'the') order by create_time desc, local_id desc, session_id limit 50")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return scan.search(m.msg_conv(spark, d), "The")


@query("context_around", f"""
with e as (select *, row_number() over (order by create_time, local_id) as i, count(*) over () as size from msg_events where session_id = '{SESSION}'),
t as (select i as ti, size from e order by i limit 1 offset 5),
q as (select ti, size, least(ti - 1, 10 + greatest(0, 10 - (size - ti))) as b, least(size - ti, 10 + greatest(0, 10 - (ti - 1))) as a from t)
select session_id, local_id, create_time, local_type, is_send, case when i < ti then 'before' when i > ti then 'after' else 'target' end as side from e, q where i between ti - b and ti + a""")
def context_around(spark: SparkSession, d: str) -> DataFrame:
    msgs = m.msg_events(spark, d)
    row = scan.page(msgs, SESSION, 1, 5, ascending=True).first()
    return scan.around(msgs, SESSION, row["create_time"], row["local_id"], 20) if row else msgs.limit(0).withColumn("side", F.lit(""))


@query("keyset_page", f"with e as (select * from msg_events where session_id = '{SESSION}'), c as (select create_time as t, local_id as l from e order by create_time, local_id limit 1 offset 9) select e.* from e, c where (create_time, local_id) > (t, l) order by create_time, local_id limit 20")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    msgs = m.msg_events(spark, d)
    row = scan.page(msgs, SESSION, 1, 9, ascending=True).first()
    return scan.after(msgs, SESSION, row.asDict(), 20) if row else msgs.limit(0)


@query("offset_page", f"select * from msg_events where session_id = '{SESSION}' and create_time > 0 order by create_time desc, local_id desc limit 10 offset 5")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return scan.page(m.msg_events(spark, d), SESSION, 10, 5)


@query("range_scan", f"select * from msg_events where session_id = '{SESSION}' and create_time between {BEGIN} and {END}")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(m.msg_events(spark, d), SESSION, BEGIN, END)


@query("message_by_type", f"select * from msg_events where session_id = '{SESSION}' and local_type = 34")
def message_by_type(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(m.msg_events(spark, d), SESSION, local_type=m.VOICE)


@query("message_by_id", f"select * from msg_events where session_id = 'u1' and local_id = (select min(local_id) from msg_events where session_id = 'u1')")
def message_by_id(spark: SparkSession, d: str) -> DataFrame:
    msgs = m.msg_events(spark, d)
    return scan.by_id(msgs, "u1", msgs.where("session_id = 'u1'").agg(F.min("local_id")).first()[0] or 0)


@query("media_stream", f"select *, 'image' as kind from msg_events where local_type = 3 and create_time between {BEGIN} and {END} order by create_time desc, local_id desc, session_id limit 100")
def media_stream(spark: SparkSession, d: str) -> DataFrame:
    return scan.media(m.msg_events(spark, d), begin=BEGIN, end=END)


@query("resource_listing", "select *, case local_type when 3 then 'image' else 'voice' end as kind from msg_events where local_type in (3, 34) order by create_time desc, local_id desc, session_id limit 60 offset 20")
def resource_listing(spark: SparkSession, d: str) -> DataFrame:
    return scan.media(m.msg_events(spark, d), ("image", "video", "voice", "file"), limit=60, offset=20)


@query("table_time_range", "select count(*) as n, min(create_time) as first_time, max(create_time) as last_time from msg_orders")
def table_time_range(spark: SparkSession, d: str) -> DataFrame:
    return m.msg_orders(spark, d).agg(F.count("*").alias("n"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))


@query("shard_stats")
def shard_stats(spark: SparkSession, d: str) -> DataFrame:
    return m.table(spark, d, "events").select(F.unix_timestamp("ts").alias("create_time"), "_metadata").transform(scan.shard_stats)


@query("ad_hoc_sql", "select session_id, count(*) as n from msg_events where create_time >= 1704499200 group by 1")
def ad_hoc_sql(spark: SparkSession, d: str) -> DataFrame:
    return scan.run_sql(spark, {"chat_messages": m.msg_events(spark, d)}, "select session_id, count(*) as n from chat_messages where create_time >= :since group by session_id", {"since": BEGIN})


@query("sync_page", f"select * from msg_events where create_time >= {BEGIN} order by create_time, local_id, session_id limit 101")
def sync_page(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sync_page(m.msg_events(spark, d), BEGIN, 100)


# Lookups.

TYPE_SQL = "case when contains(username, '@chatroom') then 'group' when starts_with(username, 'gh_') then 'official' when flag & 8 <> 0 then 'blocked' when local_type = 0 and coalesce(quan_pin, '') <> '' then 'former_friend' when local_type = 1 then 'friend' else 'other' end"


@query("contact_types", f"select username, {TYPE_SQL} as type from contacts")
def contact_types(spark: SparkSession, d: str) -> DataFrame:
    return lookups.contact_types(m.contacts(spark, d))


@query("contact_type_counts", f"select {TYPE_SQL} as type, count(*) as n from contacts group by 1")
def contact_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookups.contact_types(m.contacts(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@query("classified_contacts", f"select c.username, {NAME_SQL.replace('username', 'c.username')} as display_name, {TYPE_SQL.replace('username', 'c.username')} as type, coalesce(last_timestamp, 0) as last_contact from contacts c left join sessions s on s.username = c.username")
def classified_contacts(spark: SparkSession, d: str) -> DataFrame:
    return lookups.classified_contacts(m.contacts(spark, d), m.sessions(spark, d))


@query("private_sessions", "select username, last_timestamp, last_msg_type, unread_count from sessions where not contains(username, '@chatroom') and username not in ('u1', 'u2')")
def private_sessions(spark: SparkSession, d: str) -> DataFrame:
    return lookups.private_sessions(m.sessions(spark, d), excluded=spark.createDataFrame([(" U1 ",), ("u2",)], "username string"))


@query("session_rows", f"select c.username, {NAME_SQL.replace('username', 'c.username')} as display_name, {TYPE_SQL.replace('username', 'c.username')} as type, coalesce(last_timestamp, 0) as last_contact from contacts c left join sessions s on s.username = c.username where {TYPE_SQL.replace('username', 'c.username')} in ('friend', 'group', 'official', 'former_friend')")
def session_rows(spark: SparkSession, d: str) -> DataFrame:
    return lookups.session_rows(m.contacts(spark, d), m.sessions(spark, d))


@query("identity_keys", "select username, case when regexp_matches(username, '^.+_[a-zA-Z0-9]{4}$') then regexp_extract(lower(username), '^(.+)_[a-zA-Z0-9]{4}$', 1) || ',' || lower(username) else lower(username) end as keys from (select concat('User', c_custkey, case c_custkey % 3 when 0 then '_ab1X' when 1 then '_abc' else '' end) as username from customer)")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, "_ab1X").when(k % 3 == 1, "_abc").otherwise("")
    return lookups.identity_table(m.table(spark, d, "customer").select(F.concat(F.lit("User"), k.cast("string"), tail).alias("username")))


REVOKE = "local_type = 10000"


@query("revoke_nearest", """
with r as (select session_id, local_id as revoke_id, create_time as t from msg_events where local_type = 10000),
o as (select session_id, local_id, create_time from msg_events where local_type <> 10000 and is_send = 0)
select r.session_id, revoke_id, arg_max(o.local_id, (o.create_time, o.local_id)) as original_id, arg_max(o.create_time, (o.create_time, o.local_id)) as original_time
from r join o on o.session_id = r.session_id and o.create_time >= t - 7200 and (o.create_time, o.local_id) < (t, revoke_id) group by 1, 2""")
def revoke_nearest(spark: SparkSession, d: str) -> DataFrame:
    return lookups.revoked_nearest(m.msg_events(spark, d), REVOKE, 7200)


@query("revoke_by_id", "with r as (select session_id, local_id as revoke_id, local_id - 150 as target from msg_events where local_type = 10000) select r.session_id, revoke_id, o.local_id as original_id from r join msg_events o on o.session_id = r.session_id and o.local_id = target")
def revoke_by_id(spark: SparkSession, d: str) -> DataFrame:
    msgs = m.msg_events(spark, d).withColumn("server_id", F.concat(F.lit("s"), F.col("local_id").cast("string")))
    revokes = msgs.where(REVOKE).select("session_id", F.col("local_id").alias("revoke_id"), F.array(F.concat(F.lit("s"), (F.col("local_id") - 150).cast("string"))).alias("tokens"))
    return lookups.revoked_by_id(msgs, revokes)


@query("quotes", "select a.session_id, a.local_id, cast(a.local_id - 1 as varchar) as reply_to, case when b.local_id is null then '[message]' when b.local_type = 1 then 'text ' || b.local_id else '[image]' end as quoted from msg_conv a left join (select session_id, local_id, case when local_id % 2 = 0 then 1 else 3 end as local_type from msg_conv) b on b.session_id = a.session_id and b.local_id = a.local_id - 1")
def quotes(spark: SparkSession, d: str) -> DataFrame:
    msgs = m.msg_conv(spark, d).select("session_id", "local_id", F.col("local_id").cast("string").alias("server_id"), (F.col("local_id") - 1).cast("string").alias("reply_to"), F.when(F.col("local_id") % 2 == 0, 1).otherwise(3).cast("bigint").alias("local_type"), F.concat(F.lit("text "), F.col("local_id").cast("string")).alias("content"))
    return lookups.quotes(msgs)


@query("table_hash", "select 'Msg_' || md5(username) as table_name, username as session_id from sessions")
def table_hash(spark: SparkSession, d: str) -> DataFrame:
    sessions = m.sessions(spark, d)
    return lookups.session_of_table(sessions.select(F.concat(F.lit("Msg_"), F.md5(F.col("username").cast("binary"))).alias("table_name")), sessions)


# Text.

@query("xml_value", r"""select page_id, trim(regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title>', 1)) as title, regexp_extract(html, '(?is)<html\b[^>]*?\slang\s*=\s*[''"]([^''"]*)[''"]', 1) as lang, len(regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1)) as items from pages""")
def xml_value(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return m.table(spark, d, "pages").select("page_id", text.xml_value(html, "title").alias("title"), text.xml_attribute(html, "html", "lang").alias("lang"), F.size(text.xml_values(html, "li")).cast("bigint").alias("items"))


@query("entities", "select page_id, replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''') as plain from pages")
def entities(spark: SparkSession, d: str) -> DataFrame:
    return m.table(spark, d, "pages").select("page_id", text.decode_entities(F.col("html")).alias("plain"))


@query("json_value", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_value(spark: SparkSession, d: str) -> DataFrame:
    return m.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("day_keys", "select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month, cast(hour(ts) as integer) as hour, cast(isodow(ts) as integer) as weekday, strftime(ts, '%Y-%m-%d %H:%M:%S') as clock from events")
def day_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_timestamp("ts")
    return m.table(spark, d, "events").select("event_id", time.day_key(t).alias("day"), time.month_key(t).alias("month"), time.hour(t).alias("hour"), time.weekday(t).alias("weekday"), time.clock(t).alias("clock"))


@query("type_names", "select distinct local_type, case local_type when 1 then 'text' when 3 then 'image' when 34 then 'voice' when 49 then 'link' else 'system' end as name, case local_type when 1 then 0 when 3 then 1 when 34 then 2 when 49 then 99 else 80 end as code from msg_events")
def type_names(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("local_type")
    return m.msg_events(spark, d).select("local_type").distinct().select("local_type", labels.type_name(kind).alias("name"), labels.api_code(kind, F.lit(None).cast("string")).alias("code"))


# Posts and accounts.

@query("post_types", "select type, count(*) as n from posts group by 1")
def post_types(spark: SparkSession, d: str) -> DataFrame:
    return social.post_types(m.posts(spark, d))


@query("post_stats", "select count(*) as posts, count(distinct username) as authors, count(*) filter (where username = 'u7') as mine from posts")
def post_stats(spark: SparkSession, d: str) -> DataFrame:
    return social.post_stats(m.posts(spark, d), "u7")


@query("post_counts", "select username, count(*) as posts from posts group by 1")
def post_counts(spark: SparkSession, d: str) -> DataFrame:
    return social.post_counts(m.posts(spark, d))


@query("post_likers", "select username, count(*) as n from (select unnest(likes) as username from posts) group by 1 order by n desc, username limit 10")
def post_likers(spark: SparkSession, d: str) -> DataFrame:
    return social.likers(m.posts(spark, d))


@query("post_liked", "select username, cast(sum(len(likes)) as bigint) as n from posts group by 1 order by n desc, username limit 10")
def post_liked(spark: SparkSession, d: str) -> DataFrame:
    return social.liked(m.posts(spark, d))


@query("post_timeline", "select id, username, create_time, type from posts where contains(lower(content), 'the') order by create_time desc, id limit 20 offset 5")
def post_timeline(spark: SparkSession, d: str) -> DataFrame:
    return social.posts_page(m.posts(spark, d), 20, 5, keyword="the").select("id", "username", "create_time", "type")


HEALTH_NOW = 970000000


@query("account_health", f"select username, case type when 0 then 'subscription' when 1 then 'service' else 'enterprise' end as kind, last_time, case when coalesce(last_time, 0) <= 0 then 'unknown' when {HEALTH_NOW} - last_time >= 63072000 then 'two_year' when {HEALTH_NOW} - last_time >= 31536000 then 'one_year' else 'active' end as level from accounts")
def account_health(spark: SparkSession, d: str) -> DataFrame:
    return social.account_health(m.accounts(spark, d), HEALTH_NOW)


@query("account_summary", f"with l as (select {HEALTH_NOW} - last_time as s, last_time from accounts) select count(*) as total, count(*) filter (where last_time > 0 and s < 31536000) as active, count(*) filter (where last_time > 0 and s >= 31536000) as one_year, count(*) filter (where last_time > 0 and s >= 63072000) as two_year, count(*) filter (where coalesce(last_time, 0) <= 0) as unknown from l")
def account_summary(spark: SparkSession, d: str) -> DataFrame:
    return social.health_summary(m.accounts(spark, d), HEALTH_NOW)


# Exports.

CLOCK_SQL = "strftime(make_timestamp(create_time * 1000000), '%Y-%m-%d %H:%M:%S')"


@query("export_sql", f"select session_id, create_time, local_id, 'INSERT INTO messages (session_id, local_id, create_time, sender, is_send, local_type, content) VALUES (''' || session_id || ''', ' || local_id || ', ' || create_time || ', ''' || case when is_send = 1 then 'me' else session_id end || ''', ' || is_send || ', ' || local_type || ', ''' || case local_type when 1 then '' when 3 then '[image]' when 34 then '[voice]' when 49 then '[app] ' else '' end || ''');' as line from msg_events")
def export_sql(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sql(m.msg_events(spark, d))


@query("export_txt", f"select session_id, create_time, local_id, {CLOCK_SQL} || ' ''' || case when is_send = 1 then 'me' else session_id end || ''' ' || case local_type when 1 then '' when 3 then '[image]' when 34 then '[voice]' when 49 then '[app] ' else '' end as line from msg_events")
def export_txt(spark: SparkSession, d: str) -> DataFrame:
    return sinks.txt(m.msg_events(spark, d))


@query("export_csv", f"select session_id, create_time, local_id, concat_ws(',', local_id, case local_type when 1 then 'text' when 3 then 'image' when 34 then 'voice' when 49 then 'link' else 'system' end, is_send, case when is_send = 1 then 'me' else session_id end, case local_type when 1 then '' when 3 then '[image]' when 34 then '[voice]' when 49 then '[app] ' else '' end, session_id, {CLOCK_SQL}) as line from msg_events")
def export_csv(spark: SparkSession, d: str) -> DataFrame:
    return sinks.csv(m.msg_events(spark, d))


SHOWN_SQL = "case when local_type = 10000 then trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')) else coalesce(content, '') end"
TALKER_SQL = "case when is_send = 1 then 'me' else session_id end"


@query("export_markdown", f"select session_id, create_time, local_id, concat('**', {TALKER_SQL}, '** ', {CLOCK_SQL}, '  ', chr(10), {SHOWN_SQL}, chr(10)) as line from msg_conv")
def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    return sinks.markdown(m.msg_conv(spark, d))


ESCAPED_SQL = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


@query("export_html", f"select session_id, create_time, local_id, concat('<div class=\"', case when is_send = 1 then 'mine' else 'theirs' end, '\"><time>', {CLOCK_SQL}, '</time><b>', {TALKER_SQL}, '</b><p>', {ESCAPED_SQL.format(SHOWN_SQL)}, '</p></div>') as line from msg_conv")
def export_html(spark: SparkSession, d: str) -> DataFrame:
    return sinks.html(m.msg_conv(spark, d))


@query("export_document", f"select session_id, create_time, local_id, concat('{{\"_type\":\"message\",\"sender\":', to_json({TALKER_SQL}), ',\"timestamp\":', create_time, ',\"type\":', case local_type when 1 then 0 else 80 end, ',\"content\":', to_json({SHOWN_SQL}), '}}') as line from msg_conv")
def export_document(spark: SparkSession, d: str) -> DataFrame:
    return sinks.document_lines(m.msg_conv(spark, d))


@query("document_members", "select session_id, case when is_send = 1 then 'me' else session_id end as platform_id, min(create_time) as first_time from msg_conv group by 1, 2")
def document_members(spark: SparkSession, d: str) -> DataFrame:
    return sinks.document_members(m.msg_conv(spark, d))


@query("vcards", "select username, 'BEGIN:VCARD' || chr(10) || 'VERSION:3.0' || chr(10) || 'FN:' || coalesce(remark, nick_name) || chr(10) || 'UID:' || username || chr(10) || 'END:VCARD' as card from contacts where flag = 0 and local_type = 1")
def vcards(spark: SparkSession, d: str) -> DataFrame:
    return sinks.vcards(lookups.classified_contacts(m.contacts(spark, d), m.sessions(spark, d)))


@query("import_snapshot", "select count(*) filter (where event_id % 3 <> 0 and event_id % 7 <> 0) as inserted, count(*) filter (where event_id % 3 = 0 and event_id % 7 <> 0) as ignored, count(*) filter (where event_id % 7 = 0) as malformed from events")
def import_snapshot(spark: SparkSession, d: str) -> DataFrame:
    events = m.table(spark, d, "events").select("event_id", "user_id")
    incoming = events.withColumn("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id")))
    return sinks.import_snapshot(events.where("event_id % 3 = 0"), incoming, ["event_id"])[1]


# Reports and streams.

@query("annual_report", f"""
with o as (select {COUNTS}, count(distinct create_time // 86400) as active_days, count(distinct session_id) as sessions from msg_events),
k as (select {DAY_SQL} as peak_day, count(*) as peak_total from msg_events group by 1 order by 2 desc, 1 limit 1),
{STREAKS.format(t='msg_events')}, t as (select session_id as streak_session, days as streak_days from r order by days desc, session_id limit 1),
p as ({PREV.format(t='msg_events')}), i as (select count(*) filter (where is_send = 1) as initiated, floor(count(*) filter (where is_send = 1) / count(*) * 1000 + 0.5) / 10 as initiative from p where pt is null or create_time - pt > 3600)
select total, sent, received, active_days, sessions, peak_day, peak_total, streak_session, streak_days, initiated, initiative from o, k, t, i""")
def annual_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.annual_row(m.msg_events(spark, d))


@query("pair_report", f"select session_id, {TYPES_SQL} from msg_events where session_id = '{SESSION}' group by 1")
def pair_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.pair(m.msg_events(spark, d), SESSION)["counts"]


@query("stream_hourly_counts", "select session_id, create_time - create_time % 3600 as period_start, count(*) as n from msg_events group by 1, 2")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    return feed.drained(feed.period_counts(feed.event_stream(spark, d), "1 hour"), "stream_hourly_counts", "complete")


@query("stream_new_messages", "select session_id, local_id, create_time, local_type, is_send from msg_events")
def stream_new_messages(spark: SparkSession, d: str) -> DataFrame:
    return feed.drained(feed.new_messages(feed.event_stream(spark, d)), "stream_new_messages").drop("ts")


@query("stream_unread", "select session_id, count(*) filter (where is_send = 0) as unread from msg_events group by 1")
def stream_unread(spark: SparkSession, d: str) -> DataFrame:
    return feed.drained(feed.unread(feed.event_stream(spark, d)), "stream_unread", "complete")


# Predicates and codes, over ids and types made of customers and events.

#: Type codes that a message may have, and app types in its markup.
CODES_SQL = "[1, 3, 34, 42, 43, 47, 48, 49, 50, 10000, 244813135921, 266287972401, 8594229559345, 8589934592049, 34359738417, 77][event_id % 16 + 1]"
APPS_SQL = "[5, 6, 19, 33, 36, 49, 57, 62, 2000, 2001, 7][event_id % 11 + 1]"
TYPED_SQL = f"select event_id, {CODES_SQL} as t, case when {CODES_SQL} = 49 or event_id % 7 = 0 then {APPS_SQL} end as app from events"


def _typed(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    codes = F.array(*[F.lit(c).cast("bigint") for c in (m.TEXT, m.IMAGE, m.VOICE, m.CARD, m.VIDEO, m.EMOJI, m.LOCATION, m.APP, m.CALL, m.SYSTEM, m.QUOTE, m.PAT, m.RED_PACKET, m.TRANSFER, m.FILES[0], 77)])
    apps = F.array(*[F.lit(a) for a in (5, 6, 19, 33, 36, 49, 57, 62, 2000, 2001, 7)])
    typed = m.table(spark, d, "events").select("event_id", F.get(codes, (e % 16).cast("int")).alias("t"), F.get(apps, (e % 11).cast("int")).alias("app"))
    return typed.withColumn("content", F.when((F.col("t") == m.APP) | (e % 7 == 0), F.concat(F.lit("<appmsg><type>"), F.col("app").cast("string"), F.lit("</type></appmsg>"))))


@query("api_codes", f"""
select event_id, case t when 49 then case app when 5 then 7 when 49 then 7 when 6 then 4 when 19 then 26 when 33 then 24 when 36 then 24 when 57 then 25 when 2000 then 21 when 2001 then 20 else 99 end
  when 1 then 0 when 3 then 1 when 34 then 2 when 43 then 3 when 47 then 5 when 48 then 8 when 42 then 27 when 50 then 23 when 10000 then 80
  when 244813135921 then 25 when 266287972401 then 22 when 8594229559345 then 20 when 8589934592049 then 21 else 99 end as code from ({TYPED_SQL})""")
def api_codes(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("event_id", labels.api_code(F.col("t"), F.col("content")).alias("code"))


@query("export_codes", f"""
select event_id, case when t = 10000 then 80 when app is not null then case app when 6 then 4 when 33 then 24 when 36 then 24 when 57 then 25 when 2000 then 99 else 7 end
  else case t when 1 then 0 when 3 then 1 when 34 then 2 when 43 then 3 when 47 then 5 when 48 then 8 when 42 then 27 when 50 then 23 when 34359738417 then 7 else 99 end end as code from ({TYPED_SQL})""")
def export_codes(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("event_id", labels.export_code(F.col("t"), F.col("content")).alias("code"))


IDS_SQL = "select c_custkey, concat(['wxid_', 'gh_', 'Weixin', 'fmessage', 'brandsessionholder_', '@helper_folders', 'service_', 'name'][c_custkey % 8 + 1], case when c_custkey % 8 = 2 then '' else cast(c_custkey as varchar) end, ['', '', '@chatroom', '@openim', '@kefu.openim'][c_custkey % 5 + 1]) as id from customer"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    head = F.get(F.array(*map(F.lit, ("wxid_", "gh_", "Weixin", "fmessage", "brandsessionholder_", "@helper_folders", "service_", "name"))), (k % 8).cast("int"))
    tail = F.get(F.array(*map(F.lit, ("", "", "@chatroom", "@openim", "@kefu.openim"))), (k % 5).cast("int"))
    return m.table(spark, d, "customer").select("c_custkey", F.concat(head, F.when(k % 8 == 2, "").otherwise(k.cast("string")), tail).alias("id"))


@query("private_ids", f"""
select c_custkey, id, not (contains(id, '@chatroom') or starts_with(id, 'gh_') or lower(id) = 'weixin' or starts_with(id, 'fmessage') or starts_with(id, 'brandsessionholder') or starts_with(id, '@helper_folders')
  or contains(id, '@openim') or contains(id, '@kefu.openim') or contains(id, 'service_') or lower(id) = 'wxid_16') as is_private from ({IDS_SQL})""")
def private_ids(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("c_custkey", "id", identity.is_private(F.col("id"), "wxid_16_ab12").alias("is_private"))


@query("sent_by_me", """
select event_id, (user_id % 4 <> 3 and user_id % 3 = 0) or event_id % 5 = 0 as mine from events""")
def sent_by_me(spark: SparkSession, d: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    own = F.get(F.array(*map(F.lit, ("wxid_me", "WXID_ME_9f2d", "wxid_me_old_phone", "other"))), (u % 4).cast("int"))
    sender = F.when(u % 3 == 0, own).otherwise(F.concat(F.lit("u"), u.cast("string")))
    return m.table(spark, d, "events").select("event_id", identity.sent_by_me(F.when(e % 5 == 0, "true").otherwise("0"), sender, "wxid_me_ab12").alias("mine"))


@query("revoke_original", """
with r as (select session_id, local_id as revoke_id, create_time as t, local_id - 150 as target from msg_events where local_type = 10000),
b as (select r.session_id, revoke_id, o.local_id as by_id from r join msg_events o on o.session_id = r.session_id and o.local_id = target),
n as (
  select r.session_id, revoke_id, arg_max(o.local_id, (o.create_time, o.local_id)) as nearest
  from r join msg_events o on o.session_id = r.session_id and o.local_type <> 10000 and o.is_send = 0 and o.create_time >= t - 7200 and (o.create_time, o.local_id) < (t, revoke_id) group by 1, 2)
select session_id, revoke_id, coalesce(by_id, nearest) as original_id, case when by_id is not null then 'id' when nearest is not null then 'nearest' else 'none' end as how
from r left join b using (session_id, revoke_id) left join n using (session_id, revoke_id)""")
def revoke_original(spark: SparkSession, d: str) -> DataFrame:
    msgs = m.msg_events(spark, d).withColumn("server_id", F.concat(F.lit("s"), F.col("local_id").cast("string")))
    revokes = msgs.where(REVOKE).select("session_id", F.col("local_id").alias("revoke_id"), F.array(F.concat(F.lit("s"), (F.col("local_id") - 150).cast("string"))).alias("tokens"))
    return lookups.revoked_original(msgs, revokes, REVOKE, 7200)


@query("month_windows", "select distinct cast(epoch(date_trunc('month', ts)) as bigint) as month_begin, cast(epoch(date_trunc('month', ts) + interval 1 month) as bigint) as month_end from events")
def month_windows(spark: SparkSession, d: str) -> DataFrame:
    return m.msg_events(spark, d).select(time.month_window(F.col("create_time")).alias("w")).distinct().select(F.col("w.begin").alias("month_begin"), F.col("w.end").alias("month_end"))


@query("last_days", "select local_id, create_time // 86400 * 86400 - 6 * 86400 as first_second, create_time as last_second from msg_events")
def last_days(spark: SparkSession, d: str) -> DataFrame:
    w = time.last_days_range(F.col("create_time"), 7)
    return m.msg_events(spark, d).select("local_id", w["begin"].alias("first_second"), w["end"].alias("last_second"))


@query("day_ranges", "select distinct day, cast(epoch(cast(day as timestamp)) as bigint) as day_begin, cast(epoch(cast(day as timestamp)) as bigint) + 86400 as day_end from (select strftime(ts, '%Y-%m-%d') as day from events)")
def day_ranges(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("day")
    return m.msg_events(spark, d).select(time.day_key(F.col("create_time")).alias("day")).distinct().select("day", time.day_range(day)["begin"].alias("day_begin"), time.day_range(day)["end"].alias("day_end"))


@query("parsed_times", "select local_id, create_time as of_number, create_time as of_millis, create_time as of_digits, create_time // 86400 * 86400 as of_day from msg_events")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("create_time")
    forms = {"of_number": t.cast("string"), "of_millis": (t * 1000 + 7).cast("string"), "of_digits": F.date_format(time.moment(t), "yyyyMMddHHmmss"), "of_day": F.date_format(time.moment(t), "yyyyMMdd")}
    return m.msg_events(spark, d).select("local_id", *[time.parse_seconds(f).alias(n) for n, f in forms.items()])


@query("by_server_id", "select session_id, local_id, create_time from msg_events where session_id = 'u7' and local_id % 10 = 3")
def by_server_id(spark: SparkSession, d: str) -> DataFrame:
    msgs = m.msg_events(spark, d).withColumn("server_id", F.concat(F.lit("18446744073709551"), (F.col("local_id") % 10).cast("string")))
    return scan.by_server_id(msgs, SESSION, "184467440737095513").select("session_id", "local_id", "create_time")


@query("filled_senders", "select local_id, case when local_id % 3 = 0 then sender else concat('name', right(sender, 1)) end as sender from msg_group where right(sender, 1) <> '9' or local_id % 3 = 0 union all select local_id, null from msg_group where right(sender, 1) = '9' and local_id % 3 <> 0")
def filled_senders(spark: SparkSession, d: str) -> DataFrame:
    last = F.right(F.col("sender"), F.lit(1))
    msgs = m.msg_group(spark, d).select("local_id", last.alias("sender_id"), F.when(F.col("local_id") % 3 == 0, F.col("sender")).alias("sender"))
    known = spark.range(9).select(F.col("id").cast("string").alias("sender_id"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("username"))
    return lookups.with_senders(msgs, known).select("local_id", "sender")


@query("member_page", "select local_id, create_time from msg_group where session_id = 'g3@chatroom' and sender = 'u3' and local_id < 400 order by local_id desc limit 20")
def member_page(spark: SparkSession, d: str) -> DataFrame:
    return groups.member_page(m.msg_group(spark, d), GROUP, "u3", 20, 400).select("local_id", "create_time")


@query("display_texts", "select local_id, case local_type when 1 then 'hello ' || local_id when 3 then '[image]' when 34 then '[voice ' || (local_id % 60 + 1) || 's]' when 49 then '[link] T&' || local_id else 'note ' || local_id || ' seen' end as shown from msg_events")
def display_texts(spark: SparkSession, d: str) -> DataFrame:
    i, kind = F.col("local_id").cast("string"), F.col("local_type")
    content = (
        F.when(kind == m.TEXT, F.concat(F.lit("hello "), i)).when(kind == m.VOICE, F.concat(F.lit('<voicemsg voicelength="'), ((F.col("local_id") % 60 + 1) * 1000).cast("string"), F.lit('"/>')))
        .when(kind == m.APP, F.concat(F.lit("<msg><appmsg><title>T&amp;"), i, F.lit("</title><type>5</type></appmsg></msg>"))).when(kind == m.SYSTEM, F.concat(F.lit("note "), i, F.lit(" seen")))
    )
    return m.msg_events(spark, d).select("local_id", labels.display_text(kind, content).alias("shown"))
