"""Whole exchange documents: a head, the members in the order of their first message, the messages in order.

A document is a table of lines with their places, so one of any length is made and
written by many tasks: places come from counts of time buckets, parts are ranges of
places, and the parts of a session one after another are its document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.decode import forwarded_records
from ..functions.text import app_type, decode_entities, quote_of
from ..operators.lookups import small
from ..operators.sequence import ORDER, with_place
from ..streaming.push import id_token

# The format's version and platform, types and texts of forwarded records by their kind (8 and 49 are files).
VERSION, PLATFORM = "0.0.2", "wechat"
RECORD_TYPES = {"3": 1, "8": 4, "34": 2, "43": 3, "47": 5, "49": 4}
RECORD_TEXTS = {"3": "[图片]", "34": "[语音消息]", "43": "[视频]", "47": "[表情包]"}
FILE_RECORD, ANY_RECORD = "[文件]", "[消息]"
# End of fixed values.

FORMS = ("jsonl", "json")
#: Places of members: senders first, then listed members who sent nothing, then names in forwarded records.
SENDER, LISTED, QUOTED = 0, 1 << 40, 1 << 41
PART_LINES = 1_000_000
HEAD = "struct<version:string,exportedAt:bigint,generator:string>"
META = "struct<name:string,platform:string,type:string,groupId:string>"
RECORDS = "array<struct<sender:string,accountName:string,timestamp:bigint,type:int,content:string>>"
LINE = (
    f"_type string, chatlab {HEAD}, meta {META}, platformId string, sender string, accountName string, groupNickname string, avatar string, "
    f"timestamp bigint, type int, content string, platformMessageId string, replyToMessageId string, chatRecords {RECORDS}"
)


def _optional(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _records(msgs: DataFrame) -> Column:
    """Forwarded records of a message: names without one are 'unknown', times without one are the message's."""

    def one(r: Column) -> Column:
        who = F.coalesce(_optional(r["sender"]), F.lit("unknown"))
        at = F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.nullif(F.regexp_extract(F.coalesce(r["time"], F.lit("")), r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", 0), F.lit("")))), F.col("create_time"))
        said = _optional(r["text"])
        kind = reduce(lambda c, k: c.when(r["kind"] == k, RECORD_TYPES[k]), list(RECORD_TYPES)[1:], F.when(r["kind"] == "3", RECORD_TYPES["3"])).otherwise(0)
        text = F.when(r["kind"].isin("8", "49"), F.concat_ws(" ", F.lit(FILE_RECORD), said)).when(r["kind"] == "1", F.coalesce(said, F.lit("")))
        for k, shown in RECORD_TEXTS.items():
            text = text.when(r["kind"] == k, shown)
        return F.struct(who.alias("sender"), who.alias("accountName"), at.alias("timestamp"), kind.alias("type"), text.otherwise(F.coalesce(said, F.lit(ANY_RECORD))).alias("content"))

    return F.transform(forwarded_records(F.when(F.coalesce(app_type(F.col("content")) == 19, F.lit(False)), decode_entities(F.col("content")))), one)


def prepared(msgs: DataFrame, me: str, records: bool = False) -> DataFrame:
    """Messages with the columns a document needs; those that ``msgs`` lacks are null."""
    for name in ("sender", "content", "server_id"):
        if name not in msgs.columns:
            msgs = msgs.withColumn(name, F.lit(None).cast("string"))
    who = F.when(F.col("is_send") == 1, F.lit(me)).otherwise(F.coalesce(_optional(F.col("sender")), "session_id"))
    found = _records(msgs) if records else F.lit(None).cast(RECORDS)
    return msgs.select(
        "session_id", *ORDER, who.alias("platform_id"), labels.export_code(F.col("local_type"), F.col("content")).cast("int").alias("type"), labels.display_text(F.col("local_type"), F.col("content")).alias("text"),
        id_token(F.col("server_id")).alias("message_id"), id_token(quote_of(decode_entities(F.col("content")))["server_id"]).alias("reply_to"), found.alias("records"),
    )


def document_members(msgs: DataFrame, names: DataFrame, listed: DataFrame | None = None, nicknames: DataFrame | None = None) -> DataFrame:
    """Members of the documents of ``prepared`` messages: session, platform_id, account_name, group_nickname, avatar, place ``i`` and ``size``.

    ``names``: username, display_name and, if any, avatar. ``listed``: chatroom_id and
    username of all members. ``nicknames``: chatroom_id, username, nickname. Where
    names or nicknames hold one member several times, the least counts.
    """
    first = F.min(F.struct(*ORDER))
    said = msgs.groupBy("session_id", "platform_id").agg(first.alias("_first")).select("session_id", "platform_id", F.lit(SENDER).cast("bigint").alias("_class"), "_first.*")
    every = said
    if listed is not None:
        groups = msgs.select("session_id").distinct()
        quiet = listed.where("username is not null").select(F.col("chatroom_id").alias("session_id"), F.col("username").alias("platform_id"), F.lit(LISTED).cast("bigint").alias("_class"), F.lit(0).cast("bigint").alias("create_time"), F.lit(0).cast("bigint").alias("local_id"))
        every = every.unionByName(quiet.join(groups, "session_id", "left_semi"))
    if "records" in msgs.columns:
        told = msgs.where("records is not null").select("session_id", *ORDER, F.explode("records").alias("_r"))
        # A record without a name brings no member.
        named = told.where("_r.sender <> 'unknown'").groupBy("session_id", F.col("_r.sender").alias("platform_id")).agg(first.alias("_first"))
        every = every.unionByName(named.select("session_id", "platform_id", F.lit(QUOTED).cast("bigint").alias("_class"), "_first.*"))
    one = every.groupBy("session_id", "platform_id").agg(F.min(F.struct("_class", *ORDER)).alias("_first"))
    # The class is part of the time, so places keep senders, listed and quoted members apart.
    timed = one.select("session_id", "platform_id", (F.col("_first._class") + F.col("_first.create_time")).alias("create_time"), F.col("_first.local_id").alias("local_id"))
    avatar = F.min("avatar") if "avatar" in names.columns else F.lit(None).cast("string")
    known = names.groupBy(F.col("username").alias("platform_id")).agg(F.min("display_name").alias("account_name"), avatar.alias("avatar"))
    joined = timed.join(known, "platform_id", "left")
    if nicknames is None:
        joined = joined.withColumn("group_nickname", F.lit(None).cast("string"))
    else:
        given = nicknames.groupBy(F.col("chatroom_id").alias("session_id"), F.col("username").alias("platform_id")).agg(F.min(_optional(F.col("nickname"))).alias("group_nickname"))
        joined = joined.join(given, ["session_id", "platform_id"], "left")
    named = joined.withColumn("account_name", F.coalesce("account_name", "platform_id"))
    return with_place(named, order=(*ORDER, "platform_id")).select("session_id", "platform_id", "account_name", "group_nickname", "avatar", "i", "size")


def documents(
    msgs: DataFrame, names: DataFrame, me: str, exported_at: int, listed: DataFrame | None = None, nicknames: DataFrame | None = None,
    form: str = "jsonl", records: bool = False, generator: str = "chatloom",
) -> DataFrame:
    """(session_id, place, line): the document of every session of ``msgs``, places from 0 without a gap.

    ``form`` 'jsonl': one JSON object in each line. 'json': the lines together are one
    JSON object. A session without messages has no document. Null contents and names
    are left out or stand as the id; repeated rows stay repeated; texts are whole.
    Sessions need an id: messages without one are left out.
    """
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    own = prepared(msgs.where("session_id is not null"), me, records)
    members = document_members(own, names, listed, nicknames)
    title = names.groupBy(F.col("username").alias("session_id")).agg(F.min("display_name").alias("_name"))
    heads = members.where("i = 0").select("session_id", F.col("size").alias("members")).join(title, "session_id", "left")
    is_group = F.contains("session_id", F.lit("@chatroom"))
    head = F.struct(F.lit(VERSION).alias("version"), F.lit(exported_at).cast("bigint").alias("exportedAt"), F.lit(generator).alias("generator"))
    meta = F.struct(F.coalesce("_name", "session_id").alias("name"), F.lit(PLATFORM).alias("platform"), F.when(is_group, "group").otherwise("private").alias("type"), F.when(is_group, F.col("session_id")).alias("groupId"))
    member = [F.col("platform_id").alias("platformId"), F.col("account_name").alias("accountName"), F.col("group_nickname").alias("groupNickname"), "avatar"]
    message = [
        F.col("platform_id").alias("sender"), F.col("account_name").alias("accountName"), F.col("group_nickname").alias("groupNickname"), F.col("create_time").alias("timestamp"), "type", F.col("text").alias("content"),
        F.col("message_id").alias("platformMessageId"), F.col("reply_to").alias("replyToMessageId"), F.when(F.size("records") > 0, F.col("records")).alias("chatRecords"),
    ]
    placed = with_place(own).join(small(members.select("session_id", "platform_id", "account_name", "group_nickname")), ["session_id", "platform_id"]).join(small(heads.select("session_id", "members")), "session_id")

    def line(kind: str, fields: list) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("_type"), *fields) if form == "jsonl" else F.struct(*fields))

    comma = F.when(F.col("i") < F.col("size") - 1, ",").otherwise("")
    top, one, each = line("header", [head.alias("chatlab"), meta.alias("meta")]), line("member", member), line("message", message)
    if form == "json":
        top = F.concat(F.substring(top, F.lit(1), F.length(top) - 1), F.lit(',"members":['))
        one = F.concat(one, comma)
        each = F.concat(F.when(F.col("i") == 0, '],"messages":[').otherwise(""), each, F.when(F.col("i") < F.col("size") - 1, ",").otherwise("]}"))
    parts = [
        heads.select("session_id", F.lit(0).cast("bigint").alias("place"), top.alias("line")),
        members.select("session_id", (F.col("i") + 1).alias("place"), one.alias("line")),
        placed.select("session_id", (F.col("members") + F.col("i") + 1).alias("place"), each.alias("line")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_documents(lines: DataFrame, path: str, mode: str = "errorifexists", part_lines: int = PART_LINES) -> None:
    """One folder for each session, in it one file of at most ``part_lines`` lines for each range of places; names ascend with places."""
    parted = lines.withColumn("part", F.lpad(F.expr(f"place div {part_lines}").cast("string"), 9, "0"))
    # The sort begins with the columns of folders, so that writing needs no other that might mix up places.
    ordered = parted.repartition("session_id", "part").sortWithinPartitions("session_id", "part", "place")
    ordered.select("session_id", "part", F.col("line").alias("value")).write.partitionBy("session_id", "part").mode(mode).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Lines of written 'jsonl' documents as columns of heads, members and messages (``_type`` tells which), with session_id and part; a line that is no JSON has nulls."""
    lines = spark.read.schema("value string, session_id string, part string").text(path)
    return lines.select("session_id", "part", F.from_json("value", LINE).alias("_l")).select("session_id", "part", "_l.*")
