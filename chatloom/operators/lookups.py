"""Lookups and joins: names, contacts, quotes, revokes, mutual groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, labels
from ..functions.text import decode_entities, is_hex

SMALL_ROWS = 500_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Hints a broadcast only when a count shows at most ``rows`` rows; a larger side is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def names(contacts: DataFrame) -> DataFrame:
    """username, display_name: remark, nickname, alias or the id, the first that is filled."""
    return contacts.select("username", identity.display_name(F.col("remark"), F.col("nick_name"), F.col("alias"), F.col("username")).alias("display_name"))


def with_names(df: DataFrame, key: str, contacts: DataFrame) -> DataFrame:
    found = names(contacts).withColumnRenamed("username", key)
    return df.join(found, key, "left").withColumn("display_name", F.coalesce("display_name", key))


def with_senders(msgs: DataFrame, senders: DataFrame) -> DataFrame:
    """Fills missing senders from a dictionary (sender_id, username)."""
    known = senders.select(F.col("sender_id"), F.col("username").alias("_name"))
    return msgs.join(known, "sender_id", "left").withColumn("sender", F.coalesce("sender", "_name")).drop("_name")


def backfill_senders(msgs: DataFrame, details: DataFrame) -> DataFrame:
    """Fills missing senders from rows of the same session, id and time."""
    keys = ["session_id", "local_id", "create_time"]
    known = details.where("sender is not null").groupBy(*keys).agg(F.min("sender").alias("_name"))
    return msgs.join(known, keys, "left").withColumn("sender", F.coalesce("sender", "_name")).drop("_name")


def contact_types(contacts: DataFrame) -> DataFrame:
    return contacts.select("username", identity.contact_type(F.col("username"), F.col("local_type"), F.col("flag"), F.col("quan_pin")).alias("type"))


def classified_contacts(contacts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Contacts with type, display name and last contact, latest first."""
    last = sessions.select("username", "last_timestamp")
    typed = contacts.withColumn("type", identity.contact_type(F.col("username"), F.col("local_type"), F.col("flag"), F.col("quan_pin")))
    named = typed.withColumn("display_name", identity.display_name(F.col("remark"), F.col("nick_name"), F.col("alias"), F.col("username")))
    return named.join(last, "username", "left").select("username", "display_name", "type", F.coalesce("last_timestamp", F.lit(0)).alias("last_contact"))


def private_sessions(sessions: DataFrame, me: str = "", excluded: DataFrame | None = None) -> DataFrame:
    kept = sessions.where(identity.is_private(F.col("username"), me))
    if excluded is None:
        return kept
    return kept.join(excluded.select(F.lower(F.trim("username")).alias("_x")).distinct(), F.lower("username") == F.col("_x"), "left_anti")


def missing_officials(contacts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Official contacts that have no session yet, as sessions."""
    official = contacts.where(F.startswith("username", F.lit(identity.OFFICIAL_PREFIX)))
    return official.join(sessions.select("username"), "username", "left_anti").select("username")


def quotes(msgs: DataFrame, placeholder: str = "[message]") -> DataFrame:
    """Messages (session_id, local_id, reply_to) with the text of what they answer, by server id in the session."""
    first = msgs.where("server_id is not null").groupBy("session_id", "server_id").agg(F.min_by(F.struct("local_type", "content"), "local_id").alias("q"))
    asked = msgs.where("reply_to is not null").select("session_id", "local_id", "reply_to")
    text = labels.display_text(F.col("q.local_type"), decode_entities(F.col("q.content")))
    return asked.join(first.withColumnRenamed("server_id", "reply_to"), ["session_id", "reply_to"], "left").select("session_id", "local_id", "reply_to", F.when(F.col("q").isNull(), placeholder).otherwise(text).alias("quoted"))


def revoked_by_id(msgs: DataFrame, revokes: DataFrame) -> DataFrame:
    """Revokes (session_id, revoke_id, tokens) with the message that has one of their id tokens."""
    ids = msgs.select("session_id", F.col("local_id").alias("original_id"), F.explode(F.array_compact(F.array(F.col("local_id").cast("string"), F.col("server_id")))).alias("token"))
    asked = revokes.select("session_id", "revoke_id", F.explode("tokens").alias("token"))
    return asked.join(ids, ["session_id", "token"]).groupBy("session_id", "revoke_id").agg(F.min("original_id").alias("original_id"))


def revoked_nearest(msgs: DataFrame, is_revoke: str, seconds: int = 300) -> DataFrame:
    """Each revoke with the latest incoming, not revoking message of at most ``seconds`` before.

    An as-of join bounded in time: both sides meet on buckets of ``seconds`` (a revoke
    in its own and the bucket before), so no session is ordered as a whole.
    """
    key = F.struct("create_time", "local_id")
    revokes = msgs.where(is_revoke).select("session_id", F.col("local_id").alias("revoke_id"), F.col("create_time").alias("revoke_time"), key.alias("r"))
    revokes = revokes.withColumn("bucket", F.explode(F.array(F.expr(f"revoke_time div {seconds}"), F.expr(f"revoke_time div {seconds} - 1"))))
    others = msgs.where(f"not ({is_revoke}) and is_send = 0").groupBy("session_id", F.expr(f"create_time div {seconds}").alias("bucket"), "create_time").agg(F.max("local_id").alias("original_id"), F.min("local_id").alias("least_id"))
    near = revokes.join(others, ["session_id", "bucket"]).where((F.col("create_time") >= F.col("revoke_time") - seconds) & ((F.col("create_time") < F.col("revoke_time")) | ((F.col("create_time") == F.col("revoke_time")) & (F.col("original_id") < F.col("revoke_id")))))
    return near.groupBy("session_id", "revoke_id").agg(F.max(F.struct("create_time", "original_id")).alias("o")).select("session_id", "revoke_id", F.col("o.original_id").alias("original_id"), F.col("o.create_time").alias("original_time"))


def revoked_original(msgs: DataFrame, revokes: DataFrame, is_revoke: str, seconds: int = 300) -> DataFrame:
    """Each revoke (session_id, revoke_id, tokens) with its message: by id where a token is one, else the nearest before. ``how`` tells which."""
    by_id = revoked_by_id(msgs, revokes).withColumnRenamed("original_id", "by_id")
    nearest = revoked_nearest(msgs, is_revoke, seconds).select("session_id", "revoke_id", F.col("original_id").alias("nearest"))
    both = revokes.select("session_id", "revoke_id").join(by_id, ["session_id", "revoke_id"], "left").join(nearest, ["session_id", "revoke_id"], "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("nearest").isNotNull(), "nearest").otherwise("none")
    return both.select("session_id", "revoke_id", F.coalesce("by_id", "nearest").alias("original_id"), how.alias("how"))


def hash_lookup(sessions: DataFrame) -> DataFrame:
    """Message tables are named by the md5 of their session: full and, where unambiguous, 16 digits."""
    full = sessions.select("username", F.md5(F.col("username").cast("binary")).alias("hash"))
    short = full.groupBy(F.substring("hash", 1, 16).alias("hash")).agg(F.min("username").alias("username"), F.count("*").alias("n")).where("n = 1").select("username", "hash")
    return full.unionByName(short)


def session_of_table(tables: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tables (table_name) with their sessions."""
    token = F.lower(F.regexp_extract("table_name", "([0-9a-fA-F]{32}|[0-9a-fA-F]{16})$", 1))
    return tables.withColumn("hash", token).where(is_hex(F.col("hash"))).join(hash_lookup(sessions), "hash").select("table_name", F.col("username").alias("session_id"))


def mutual_groups(members: DataFrame, friends: DataFrame) -> DataFrame:
    """Friends with the number of groups that they share with oneself: an equality join on identity keys."""
    seen = members.select("chatroom_id", F.explode(identity.identity_keys(F.col("username"))).alias("key")).distinct()
    mine = friends.select("username", F.explode(identity.identity_keys(F.col("username"))).alias("key")).distinct()
    return mine.join(seen, "key").select("username", "chatroom_id").distinct().groupBy("username").agg(F.count("*").alias("groups"))


def group_friends(members: DataFrame, friends: DataFrame) -> DataFrame:
    seen = members.select("chatroom_id", "username", F.explode(identity.identity_keys(F.col("username"))).alias("key"))
    mine = friends.select(F.explode(identity.identity_keys(F.col("username"))).alias("key")).distinct()
    return seen.join(mine, "key", "left_semi").select("chatroom_id", "username").distinct().groupBy("chatroom_id").agg(F.count("*").alias("friends"))


def nickname_consensus(nicknames: DataFrame) -> DataFrame:
    """(chatroom_id, username, nickname): the nickname where all sources agree, else empty."""
    clean = F.trim("nickname")
    return nicknames.where(clean != "").groupBy("chatroom_id", "username").agg(F.min(clean).alias("low"), F.max(clean).alias("high")).select("chatroom_id", "username", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("").alias("nickname"))


def session_rows(contacts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Contacts that matter with their sessions, latest first; sessions alone where there are no contacts."""
    kept = classified_contacts(contacts, sessions).where(F.col("type").isin("friend", "group", "official", "former_friend"))
    if kept.limit(1).count() == 0:
        return sessions.select("username", F.col("username").alias("display_name"), identity.session_kind(F.col("username")).alias("type"), F.col("last_timestamp").alias("last_contact"))
    return kept


def identity_table(contacts: DataFrame) -> DataFrame:
    return contacts.select("username", F.array_join(identity.identity_keys(F.col("username")), ",").alias("keys"))


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, that of the greatest ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
