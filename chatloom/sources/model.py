"""The chat model: schemas, and views that give the driver's tables its shape.

Times are epoch seconds; calendar fields need ``spark.sql.session.timeZone`` = UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "session_id string, local_id bigint, server_id string, local_type bigint, create_time bigint, sort_seq bigint, sender string, is_send int, content string, source string"
SESSIONS = "username string, type int, unread_count int, summary string, sort_timestamp bigint, last_timestamp bigint, last_msg_type bigint"
CONTACTS = "username string, alias string, remark string, nick_name string, local_type int, flag int, quan_pin string, labels array<string>"
MEMBERS = "chatroom_id string, username string, group_nickname string, is_owner boolean"
POSTS = "id string, username string, create_time bigint, content string, type int, likes array<string>, comments array<struct<id:string,username:string,nickname:string,content:string,ref:string>>, media array<struct<url:string,thumb:string,md5:string>>"

# Codes of message types.
TEXT, IMAGE, VOICE, CARD, VIDEO, EMOJI, LOCATION, APP, CALL, SYSTEM, REVOKE = 1, 3, 34, 42, 43, 47, 48, 49, 50, 10000, 10002
QUOTE, PAT, CHAT_RECORD, MINI_PROGRAM, RED_PACKET, TRANSFER = 244813135921, 266287972401, 81604378673, 154618822705, 8594229559345, 8589934592049
FILES = (34359738417, 103079215153, 25769803825)
# End of fixed values.

#: 2024-01-01 00:00:00 UTC, from which tables without times count.
EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_type() -> Column:
    return F.when(F.col("event_type") == "click", TEXT).when(F.col("event_type") == "view", IMAGE).when(F.col("event_type") == "signup", VOICE).when(F.col("event_type") == "purchase", APP).otherwise(SYSTEM).cast("bigint")


def msg_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One private session for each user of ``events``."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("local_id"), F.unix_timestamp("ts").alias("create_time"),
        _event_type().alias("local_type"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(0).alias("is_send"),
    )


def msg_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with text; neighbouring turns are 300 s apart."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("local_id"), (F.lit(EPOCH) + F.col("conv_id") * 86400 + F.col("turn") * 300).alias("create_time"),
        F.when(role == "system", SYSTEM).otherwise(TEXT).cast("bigint").alias("local_type"), F.when(role == "assistant", 1).otherwise(0).alias("is_send"), F.col("text").alias("content"),
    )


def msg_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten group sessions with the users of ``events`` as senders."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("g"), (F.col("user_id") % 10).cast("string"), F.lit("@chatroom")).alias("session_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sender"),
        F.col("event_id").alias("local_id"), F.unix_timestamp("ts").alias("create_time"), _event_type().alias("local_type"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(0).alias("is_send"), F.col("props").alias("source"),
    )


def msg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that last for years: customers as sessions, orders as messages."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("session_id"), F.col("o_orderkey").alias("local_id"), F.unix_timestamp("o_orderdate").alias("create_time"),
        F.lit(TEXT).cast("bigint").alias("local_type"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0).alias("is_send"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), k.cast("string")).alias("username"), F.lower("c_name").alias("alias"), F.when(k % 3 != 0, F.col("c_name")).alias("remark"), F.col("c_name").alias("nick_name"),
        F.when(k % 4 == 0, 0).when(k % 4 == 1, 1).when(k % 4 == 2, 3).otherwise(5).alias("local_type"), F.when(k % 11 == 0, 8).otherwise(0).alias("flag"),
        F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("quan_pin"),
    )


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members are the senders; the member of the least id owns the group."""
    members = msg_group(spark, sf_dir).select(F.col("session_id").alias("chatroom_id"), F.col("sender").alias("username")).distinct()
    owner = members.groupBy("chatroom_id").agg(F.min("username").alias("owner"))
    return members.join(owner, "chatroom_id").select("chatroom_id", "username", (F.col("username") == F.col("owner")).alias("is_owner"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private and group sessions with their last message."""
    both = msg_events(spark, sf_dir).unionByName(msg_group(spark, sf_dir).drop("sender", "source"))
    last = F.max_by(F.struct("create_time", "local_type"), F.struct("create_time", "local_id"))
    return both.groupBy(F.col("session_id").alias("username")).agg(last.alias("last"), F.count_if(F.col("is_send") == 0).alias("unread_count")).select("username", F.col("last.create_time").alias("last_timestamp"), F.col("last.local_type").alias("last_msg_type"), "unread_count")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts; users whose number is near like them."""
    author = F.col("doc_id") % 150
    likes = F.transform(F.sequence(F.lit(1), F.col("doc_id") % 4), lambda i: F.concat(F.lit("u"), ((author + i * 7) % 150).cast("string")))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("u"), author.cast("string")).alias("username"), (F.lit(EPOCH) + F.col("doc_id") * 600).alias("create_time"), F.col("text").alias("content"),
        F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3).otherwise(15).alias("type"), F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(likes).alias("likes"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as official accounts, last heard of at their last shipment."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max(F.unix_timestamp("l_shipdate")).alias("last_time"))
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.concat(F.lit("gh_"), F.col("s_suppkey").cast("string")).alias("username"), (F.col("s_suppkey") % 4).cast("int").alias("type"), "last_time")


def pick(df: DataFrame, names: list[str], default: object = None) -> Column:
    """The first non-null of those of ``names`` that ``df`` has."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(default))


#: The views as DuckDB CTEs.
SQL = {
    "msg_events": "select concat('u', user_id) as session_id, event_id as local_id, cast(floor(epoch(ts)) as bigint) as create_time, cast(case event_type when 'click' then 1 when 'view' then 3 when 'signup' then 34 when 'purchase' then 49 else 10000 end as bigint) as local_type, case when event_id % 2 = 0 then 1 else 0 end as is_send from events",
    "msg_conv": f"select concat('c', conv_id) as session_id, turn as local_id, {EPOCH} + conv_id * 86400 + turn * 300 as create_time, cast(case when role = 'system' then 10000 else 1 end as bigint) as local_type, case when role = 'assistant' then 1 else 0 end as is_send, text as content from conversations",
    "msg_group": "select concat('g', user_id % 10, '@chatroom') as session_id, concat('u', user_id) as sender, event_id as local_id, cast(floor(epoch(ts)) as bigint) as create_time, cast(case event_type when 'click' then 1 when 'view' then 3 when 'signup' then 34 when 'purchase' then 49 else 10000 end as bigint) as local_type, case when event_id % 2 = 0 then 1 else 0 end as is_send, props as source from events",
    "msg_orders": "select concat('u', o_custkey) as session_id, o_orderkey as local_id, cast(floor(epoch(o_orderdate)) as bigint) as create_time, cast(1 as bigint) as local_type, case when o_orderkey % 2 = 0 then 1 else 0 end as is_send from orders",
    "contacts": "select concat('u', c_custkey) as username, lower(c_name) as alias, case when c_custkey % 3 <> 0 then c_name end as remark, c_name as nick_name, case c_custkey % 4 when 0 then 0 when 1 then 1 when 2 then 3 else 5 end as local_type, case when c_custkey % 11 = 0 then 8 else 0 end as flag, case when c_custkey % 5 = 0 then '' else c_mktsegment end as quan_pin from customer",
    "group_members": "select session_id as chatroom_id, sender as username, sender = min(sender) over (partition by session_id) as is_owner from (select distinct session_id, sender from msg_group)",
    "sessions": "select session_id as username, arg_max(create_time, (create_time, local_id)) as last_timestamp, arg_max(local_type, (create_time, local_id)) as last_msg_type, count(*) filter (where is_send = 0) as unread_count from (select session_id, create_time, local_id, local_type, is_send from msg_events union all select session_id, create_time, local_id, local_type, is_send from msg_group) group by 1",
    "posts": f"select cast(doc_id as varchar) as id, concat('u', doc_id % 150) as username, {EPOCH} + doc_id * 600 as create_time, text as content, case lang when 'en' then 1 when 'de' then 2 when 'fr' then 3 else 15 end as type, [concat('u', (doc_id % 150 + i * 7) % 150) for i in range(1, doc_id % 4 + 1)] as likes from documents",
    "accounts": "select concat('gh_', s_suppkey) as username, cast(s_suppkey % 4 as integer) as type, last_time from supplier left join (select l_suppkey, max(cast(floor(epoch(l_shipdate)) as bigint)) as last_time from lineitem group by 1) on s_suppkey = l_suppkey",
}


def with_views(sql: str) -> str:
    """Puts the CTEs before a DuckDB query that uses them by name."""
    needed = [n for n in SQL if n in sql or (n == "msg_group" and ("group_members" in sql or "sessions" in sql)) or (n == "msg_events" and "sessions" in sql)]
    ctes = ", ".join(f"{n} as ({SQL[n]})" for n in SQL if n in needed)
    body = sql.strip()
    if body.startswith("with recursive "):
        return f"with recursive {ctes}, {body.removeprefix('with recursive ')}"
    return f"with {ctes}, {body.removeprefix('with ')}" if body.startswith("with ") else f"with {ctes} {body}"
