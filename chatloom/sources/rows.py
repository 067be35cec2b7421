"""Raw rows of message shards as messages: fields under many names, numbers in many forms, senders by rule.

Shards have schemas of their own, so their rows are VARIANT objects first; a message's
fields are then picked by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode, identity, time
from ..functions.text import sender_of

# Names under which a field may stand in a row; the first that holds a value counts, then any that differ in case only.
NAMES = {
    "local_type": ("local_type", "localType", "type", "msg_type", "msgType", "WCDB_CT_local_type"),
    "create_time": ("create_time", "createTime", "msg_create_time", "msgCreateTime", "msg_time", "msgTime", "time", "WCDB_CT_create_time"),
    "sort_seq": ("sort_seq", "sortSeq", "WCDB_CT_sort_seq"),
    "local_id": ("local_id", "localId", "LocalId", "msg_local_id", "msgLocalId", "MsgLocalId", "msg_id", "msgId", "MsgId", "id", "WCDB_CT_local_id"),
    "server_id": ("server_id", "serverId", "ServerId", "msg_server_id", "msgServerId", "MsgServerId", "svr_id", "svrId", "msg_svr_id", "msgSvrId", "MsgSvrId", "WCDB_CT_server_id"),
    "is_send": ("computed_is_send", "is_send"),
    "sender": ("sender_username",),
    "content": ("message_content",),
    "compressed": ("compress_content",),
    "db_path": ("_db_path", "db_path"),
    "db_name": ("db_name",),
    "table_name": ("table_name",),
}
#: Types of lines that the system wrote: their sender is the session.
SYSTEM_LINES = (10000, 266287972401)
# End of fixed values.


def as_objects(rows: DataFrame) -> DataFrame:
    """Rows of any schema as one VARIANT column ``row``."""
    return rows.select(F.to_variant_object(F.struct("*")).alias("row"))


def picked(keys: Column, lower: Column, values: Column, names: tuple[str, ...]) -> Column:
    """The value of the first of ``names`` among ``keys``; then of names that are equal but for case."""

    def value(among: Column, name: str) -> Column:
        return F.try_element_at(values, F.nullif(F.array_position(among, name), F.lit(0)).cast("int"))

    return F.coalesce(*[value(keys, n) for n in names], *[value(lower, n) for n in dict.fromkeys(n.lower() for n in names)])


def whole(text: Column) -> Column:
    """A number in any form, its fraction cut, as bigint; null where it is none or too large."""
    t = F.trim(text)
    return F.coalesce(t.try_cast("bigint"), F.floor(t.try_cast("decimal(38,6)")).try_cast("bigint"))


def unsigned_token(text: Column) -> Column:
    """An unsigned id as decimal digits without leading zeros, exact to 2^64 and beyond; null where there is none.

    Takes digits, numbers with sign, fraction or exponent (negative ones are 0), and
    objects with ``value``, ``intValue`` or two 32-bit halves ``low`` and ``high``.
    """

    def plain(value: Column) -> Column:
        t = F.trim(value)
        number = t.try_cast("decimal(38,6)")
        return F.when(F.rlike(t, F.lit("^[0-9]+$")), F.regexp_replace(t, "^0+(?=[0-9])", "")).when(number < 0, "0").otherwise(F.floor(number).cast("decimal(32,0)").cast("string"))

    def half(name: str) -> Column:
        return F.pmod(F.get_json_object(text, f"$.{name}").try_cast("bigint"), F.lit(1 << 32)).cast("decimal(20,0)")

    halves = (half("high") * F.lit(1 << 32).cast("decimal(20,0)") + half("low")).cast("decimal(20,0)").cast("string")
    inner = F.coalesce(plain(F.get_json_object(text, "$.value")), plain(F.get_json_object(text, "$.intValue")), halves)
    return F.when(F.startswith(F.trim(text), F.lit("{")), inner).otherwise(plain(text))


def key_part(value: Column) -> Column:
    """A part of a message key: escaped as in addresses, a blank as %20."""
    out = F.url_encode(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    for escaped, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(escaped), F.lit(sign))
    return out


def message_key(local_id: Column, server_id: Column, create_time: Column, sort_seq: Column, sender: Column, local_type: Column, db_path: Column, db_name: Column, table_name: Column) -> Column:
    """Shard, table and local id where they are known; else what else tells a message from others."""
    number = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0))).cast("string")
    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    base = F.regexp_replace(F.regexp_extract(filled(db_path), r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    scope = F.coalesce(filled(db_path), filled(db_name), F.nullif(base, F.lit("")))
    server, local = F.coalesce(server_id, F.lit("0")), F.coalesce(local_id, F.lit(0))
    rest = [key_part(sender), F.coalesce(local_type, F.lit(0)).cast("string")]
    return (
        F.when((local > 0) & scope.isNotNull() & filled(table_name).isNotNull(), F.concat_ws(":", key_part(scope), key_part(table_name), number(local)))
        .when((local > 0) & scope.isNotNull(), F.concat_ws(":", F.lit("local"), key_part(scope), number(local), number(create_time), number(sort_seq), *rest))
        .when(server != "0", F.concat_ws(":", F.lit("server"), F.when(scope.isNotNull(), key_part(scope)), server, number(create_time), number(sort_seq), number(local), *rest))
        .otherwise(F.concat_ws(":", F.lit("fallback"), key_part(scope), number(create_time), number(sort_seq), number(local), *rest))
    )


def stable_key(local_id: Column, create_time: Column, server_id: Column) -> Column:
    """The same for a message in whichever shard it is: local id, time, server id; 0 for missing ones."""
    return F.concat_ws(":", *[F.coalesce(unsigned_token(c.cast("string")), F.lit("0")) for c in (local_id, create_time, server_id)])


def messages_of(rows: DataFrame, me: str = "", row: str = "row") -> DataFrame:
    """Messages of VARIANT rows; all other columns stay.

    Defaults: type 1, ids and times 0, sort_seq the time in milliseconds; times may be
    seconds, milliseconds, microseconds or dates. Content is the compressed one where it
    has any. The sender is the row's, else the one that heads the content, else ``me``
    of a message one sent; a sender that is ``me`` makes it sent, whatever the flag says,
    and another one without a flag received.
    A row that is no object is a message of defaults.
    """
    held = F.coalesce(F.try_variant_get(F.col(row), "$", "map<string,string>"), F.create_map().cast("map<string,string>"))
    found = rows.withColumn("_held", F.map_filter(held, lambda _, value: value.isNotNull()))
    found = found.withColumns({"_keys": F.map_keys("_held"), "_values": F.map_values("_held")}).withColumn("_lower", F.transform("_keys", F.lower))
    found = found.withColumns({f"_{n}": picked(F.col("_keys"), F.col("_lower"), F.col("_values"), alternatives) for n, alternatives in NAMES.items()})
    t = F.greatest(F.lit(0), F.coalesce(time.parse_seconds(F.col("_create_time")), F.lit(0)))
    content = F.coalesce(F.nullif(decode.decoded(F.col("_compressed")), F.lit("")), decode.decoded(F.col("_content")), F.lit(""))
    found = found.withColumns({
        "_t": t, "_l": F.coalesce(whole(F.col("_local_id")), F.lit(0)), "_k": F.coalesce(whole(F.col("_local_type")), F.lit(1)), "_s": unsigned_token(F.col("_server_id")), "_c": content,
        "_flag": whole(F.regexp_extract(F.coalesce("_is_send", F.lit("")), r"^\s*([+-]?[0-9]+)", 1)).cast("int"),
    })
    head = F.coalesce(F.nullif(F.trim("_sender"), F.lit("")), F.nullif(sender_of(F.col("_c")), F.lit("")))
    found = found.withColumns({"_q": F.coalesce(whole(F.col("_sort_seq")), F.col("_t") * 1000), "_head": head})
    told = F.when(F.col("_head").isNull(), F.col("_flag")).when(identity.same_account(F.col("_head"), F.lit(me)), 1).otherwise(F.coalesce("_flag", F.lit(0)))
    found = found.withColumn("_mine", told if me else F.col("_flag"))
    found = found.withColumn("_by", F.coalesce("_head", F.when((F.col("_mine") == 1) & F.lit(bool(me)), me)))
    key = message_key(F.col("_l"), F.col("_s"), F.col("_t"), F.col("_q"), F.col("_by"), F.col("_k"), F.col("_db_path"), F.col("_db_name"), F.col("_table_name"))
    made = {"message_key": key, "local_id": F.col("_l"), "server_id": F.col("_s"), "local_type": F.col("_k"), "create_time": F.col("_t"), "sort_seq": F.col("_q"), "is_send": F.col("_mine"), "sender": F.col("_by"), "content": F.col("_c")}
    # Made by a generator of one row, so that a filter on a field is no copy of all that the field was made of.
    return found.select(*[c for c in rows.columns if c != row and c not in made], F.inline(F.array(F.struct(*[v.alias(n) for n, v in made.items()]))))


def collected(shards: list[DataFrame], session_id: str, me: str, begin: int = 0, end: int = 0, sender: str = "", types: tuple[int, ...] = ()) -> DataFrame:
    """A session's messages for an export from all its shards, whose rows may have different schemas.

    A message that is in several shards comes once, from the first. Times from begin to
    end, both included (0 is open; messages without a time stay); ``types`` and, by
    account, ``sender`` select. Lines of the system are the session's, its revokes those
    of who revoked.
    """
    rows = [as_objects(s).withColumn("shard", F.lit(i)) for i, s in enumerate(shards)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    found = messages_of(every, me)
    t = F.col("create_time")
    if begin:
        found = found.where((t <= 0) | (t >= begin))
    if end:
        found = found.where((t <= 0) | (t <= end))
    if types:
        found = found.where(F.col("local_type").isin(*types))
    c = F.col("content")
    revoker = F.regexp_extract(c, r"(?is)<(?:fromusername|session)>\s*([^<\s]+)\s*</", 1)
    revoked = F.contains(c, F.lit("revokemsg")) | F.contains(c, F.lit("撤回"))
    by_system = F.when(revoked & F.contains(c, F.lit("你撤回")), me).when(revoked & (revoker != ""), revoker).otherwise(session_id)
    found = found.withColumn("sender", F.when(F.col("local_type").isin(*SYSTEM_LINES), by_system).when(F.col("is_send") == 1, me).otherwise(F.coalesce("sender", F.lit(session_id))))
    if sender.strip():
        found = found.where(F.lower(F.trim("sender")) == sender.strip().lower())
    key = stable_key(F.col("local_id"), t, F.col("server_id"))
    columns = found.columns
    once = found.groupBy(key.alias("export_key")).agg(F.min_by(F.struct(*columns), F.struct("shard", "message_key")).alias("m"))
    return once.select("export_key", *[F.col(f"m.{n}").alias(n) for n in columns])


def outline(messages: DataFrame) -> DataFrame:
    """(sender, n, first_time, last_time): the members of an export."""
    return messages.groupBy("sender").agg(F.count("*").alias("n"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))
