"""Text of messages: cleaning, escaping, tokens, and markup by regular expressions (it is often no valid XML)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_length(text: Column) -> Column:
    """UTF-16 code units."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2)


def strip_sender(content: Column) -> Column:
    """Without an ``id:`` line head, unless it is the head of an address."""
    return F.regexp_replace(content, r"(?i)^[\s]*([a-zA-Z0-9_@\-]+):(?!//)(?:\s*(?:\r?\n|<br\s*/?>))?\s*", "")


def sender_of(content: Column) -> Column:
    """The id of such a head, of at least four characters; else empty. Entities are read as what they stand for."""
    return F.regexp_extract(clean_controls(decode_entities(content)), r"(?i)^\s*([a-zA-Z0-9_@\-]{4,}):(?!//)\s*(?:\r?\n|<br\s*/?>)", 1)


def decode_entities(text: Column) -> Column:
    """Five entities; ``&amp;`` first, so ``&amp;lt;`` becomes ``<``."""
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def clean_controls(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]", "")


def clean_system(text: Column, empty: str = "") -> Column:
    """Readable text of a system line: the plain text or the text of its markup, else what is left without markup and trailing digits; ``empty`` where nothing is."""
    t = clean_controls(decode_entities(F.coalesce(text, F.lit(""))))
    inside = F.regexp_extract(t, r"(?is)<sysmsg\b[^>]*>(.*?)</sysmsg>", 1)
    source = F.when(inside != "", inside).otherwise(t)
    tidy = lambda c: F.trim(F.regexp_replace(strip_sender(c), "\\s+", " "))
    told = tidy(F.coalesce(F.nullif(xml_value(source, "plain"), F.lit("")), xml_value(source, "text")))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)<\?xml[^?]*\?>", ""), "<[^>]+>", ""), "[0-9]+\\s*$", "")
    return F.coalesce(F.nullif(told, F.lit("")), F.nullif(tidy(bare), F.lit("")), F.lit(empty))


def clamp(text: Column, most: int) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def csv_cell(value: Column) -> Column:
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.rlike(v, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def file_name_part(value: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(value, '[\\\\/:*?"<>|\\x00-\\x1F]', "_"), "\\.+$", ""))
    return F.when(clean == "", "unnamed").otherwise(F.substring(clean, 1, 120))


def sql_literal(value: Column) -> Column:
    return F.when(value.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")))


def split_at_list(raw: Column) -> Column:
    """Ids of a list separated by commas, semicolons, bars or spaces, without @ and quotes."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), "[,;|\\s]+"), lambda x: F.regexp_replace(x, "^[@\"']+|[\"']+$", ""))
    return F.array_remove(F.array_distinct(parts), "")


def emoji_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\\[.*?\\]"), F.lit(0))


def is_hex(text: Column) -> Column:
    return F.rlike(text, F.lit("^[0-9a-fA-F]+$")) & (F.length(text) % 2 == 0)


def is_phrase(text: Column, least: int = 2, most: int = 20) -> Column:
    t = F.trim(text)
    return F.length(t).between(least, most) & ~F.contains(t, F.lit("http")) & ~F.contains(t, F.lit("<")) & ~F.startswith(t, F.lit("["))


def xml_value(xml: Column, tag: str) -> Column:
    """Text of the first such element, CDATA unwrapped; empty without one."""
    inner = F.regexp_extract(F.coalesce(xml, F.lit("")), f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(inner, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1"))


def xml_values(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def xml_attribute(xml: Column, tag: str, name: str) -> Column:
    return F.regexp_extract(F.coalesce(xml, F.lit("")), f"(?is)<{tag}\\b[^>]*?\\s{name}\\s*=\\s*['\"]([^'\"]*)['\"]", 1)


def app_type(xml: Column, own: bool = True) -> Column:
    """The number in the first <type>; with ``own`` quoted messages are taken out first."""
    t = F.coalesce(xml, F.lit(""))
    if own:
        t = F.regexp_replace(F.regexp_replace(t, "(?is)<refermsg>.*?</refermsg>", ""), "(?is)<patmsg>.*?</patmsg>", "")
    return F.regexp_extract(t, "(?is)<type>\\s*([0-9]+)\\s*</type>", 1).try_cast("int")


def quote_of(xml: Column) -> Column:
    """struct<server_id, sender, content> of a quoted message, null without one."""
    part = F.regexp_extract(F.coalesce(xml, F.lit("")), "(?is)<refermsg>(.*?)</refermsg>", 1)
    sender = F.coalesce(F.nullif(xml_value(part, "displayname"), F.lit("")), xml_value(part, "fromusr"))
    return F.when(part != "", F.struct(xml_value(part, "svrid").alias("server_id"), sender.alias("sender"), decode_entities(xml_value(part, "content")).alias("content")))


def image_of(xml: Column) -> Column:
    return F.struct(xml_attribute(xml, "img", "md5").alias("md5"), xml_attribute(xml, "img", "aeskey").alias("aes_key"), xml_attribute(xml, "img", "cdnthumburl").alias("thumb"))


def emoji_of(xml: Column) -> Column:
    return F.struct(F.lower(xml_attribute(xml, "emoji", "md5")).alias("md5"), decode_entities(xml_attribute(xml, "emoji", "cdnurl")).alias("url"))


def card_of(xml: Column) -> Column:
    return F.struct(xml_attribute(xml, "msg", "username").alias("username"), xml_attribute(xml, "msg", "nickname").alias("nickname"))


def location_of(xml: Column) -> Column:
    return F.struct(xml_attribute(xml, "location", "x").try_cast("double").alias("latitude"), xml_attribute(xml, "location", "y").try_cast("double").alias("longitude"), xml_attribute(xml, "location", "label").alias("label"), xml_attribute(xml, "location", "poiname").alias("name"))


def file_of(xml: Column) -> Column:
    return F.struct(xml_value(xml, "title").alias("name"), xml_value(xml, "totallen").try_cast("bigint").alias("size"), F.lower(xml_value(xml, "fileext")).alias("extension"), F.lower(xml_value(xml, "md5")).alias("md5"))


def voice_seconds(xml: Column) -> Column:
    ms = xml_attribute(xml, "voicemsg", "voicelength").try_cast("bigint")
    return F.when(ms > 0, F.greatest(F.lit(1), F.floor(ms / 1000 + 0.5)))


def transfer_of(xml: Column) -> Column:
    return F.struct(xml_value(xml, "feedesc").alias("amount"), xml_value(xml, "pay_memo").alias("memo"), xml_value(xml, "payer_username").alias("payer"), xml_value(xml, "receiver_username").alias("receiver"))


def call_text(xml: Column) -> Column:
    """Text of a call message and, where it tells one, its length."""
    said = F.coalesce(F.nullif(xml_value(xml, "msg"), F.lit("")), xml_value(xml, "display_content"))
    kind = F.when(F.regexp_extract(F.coalesce(xml, F.lit("")), "(?is)<room_type>\\s*([0-9]+)", 1) == "1", "voice call").otherwise("video call")
    return F.when(said != "", F.concat(F.lit("["), kind, F.lit("] "), said)).otherwise(F.concat(F.lit("["), kind, F.lit("]")))


def at_users(source: Column) -> Column:
    """Ids of the at-list in markup or JSON."""
    listed = F.coalesce(F.nullif(xml_value(source, "atuserlist"), F.lit("")), F.get_json_object(source, "$.atuserlist"), F.lit(""))
    return split_at_list(listed)


def reply_rate(replied: Column, asked: Column) -> Column:
    return F.coalesce(F.try_divide(replied, asked), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Per cent with one decimal, halves up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10).otherwise(0.0)


def safe_int(value: Column, default: int = 0) -> Column:
    """Whole numbers of 64 bits stay exact; others lose their fraction."""
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"), F.lit(default))
