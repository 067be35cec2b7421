"""Names of message types, and readable text of messages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import model as m
from .text import app_type, call_text, clean_system, decode_entities, strip_sender, voice_seconds, xml_value

# Names and exchange codes of types.
NAMES = {m.TEXT: "text", m.IMAGE: "image", m.VOICE: "voice", m.CARD: "card", m.VIDEO: "video", m.EMOJI: "emoji", m.LOCATION: "location", m.APP: "link", m.CALL: "call", m.SYSTEM: "system", m.QUOTE: "quote", m.PAT: "pat", m.CHAT_RECORD: "chat record", m.MINI_PROGRAM: "mini program", m.RED_PACKET: "red packet", m.TRANSFER: "transfer", **{f: "file" for f in m.FILES}}
API_CODES = {m.TEXT: 0, m.IMAGE: 1, m.VOICE: 2, m.VIDEO: 3, m.EMOJI: 5, m.LOCATION: 8, m.CARD: 27, m.CALL: 23, m.SYSTEM: 80}
API_ONLY_CODES = {m.QUOTE: 25, m.PAT: 22, m.RED_PACKET: 20, m.TRANSFER: 21}
API_APP_CODES = {5: 7, 6: 4, 19: 26, 33: 24, 36: 24, 49: 7, 57: 25, 2000: 21, 2001: 20}
EXPORT_APP_CODES = {6: 4, 33: 24, 36: 24, 57: 25, 2000: 99}
# End of fixed values.


def _of(table: dict, key: Column, default: object) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key], F.lit(default))


def type_name(local_type: Column) -> Column:
    return _of(NAMES, local_type.cast("bigint"), "other")


def api_code(local_type: Column, content: Column) -> Column:
    """Exchange code of the service; app messages go by the type in their markup, 99 for others."""
    app = _of(API_APP_CODES, F.coalesce(app_type(content), F.lit(-1)), 99)
    return F.when(local_type == m.APP, app).otherwise(_of(API_CODES | API_ONLY_CODES, local_type.cast("bigint"), 99))


def export_code(local_type: Column, content: Column) -> Column:
    """Exchange code of exported files: whatever has app markup goes by its type, a link where that is not told apart."""
    c = F.coalesce(content, F.lit(""))
    kind = F.coalesce(app_type(c), F.lit(0))
    app = (local_type == m.APP) | F.contains(c, F.lit("<appmsg")) | F.contains(c, F.lit("<msg>")) | (kind != 0)
    plain = _of(API_CODES | dict.fromkeys(m.FILES, 7), local_type.cast("bigint"), 99)
    return F.when(local_type.isin(m.SYSTEM, m.REVOKE), 80).when(app, _of(EXPORT_APP_CODES, kind, 7)).otherwise(plain)


def is_file(local_type: Column, content: Column) -> Column:
    return local_type.isin(*m.FILES) | ((local_type == m.APP) & F.coalesce(app_type(content) == 6, F.lit(False)))


def resource_kind(local_type: Column, content: Column) -> Column:
    return F.when(local_type == m.IMAGE, "image").when(local_type == m.VIDEO, "video").when(local_type == m.VOICE, "voice").when(is_file(local_type, content), "file")


def is_revoke(local_type: Column, content: Column) -> Column:
    text = F.lower(F.coalesce(content, F.lit("")))
    return (local_type == m.REVOKE) | F.contains(text, F.lit("revokemsg")) | F.contains(text, F.lit("recalled a message"))


def app_text(content: Column) -> Column:
    title = decode_entities(xml_value(content, "title"))
    head = _of({3: "[music] ", 5: "[link] ", 6: "[file] ", 19: "[chat record] ", 33: "[mini program] ", 36: "[mini program] ", 57: "", 62: "[pat] ", 2000: "[transfer] ", 2001: "[red packet] "}, F.coalesce(app_type(content), F.lit(-1)), "[app] ")
    return F.concat(head, title)


def display_text(local_type: Column, content: Column) -> Column:
    """What a reader sees: the text, or a placeholder with what the markup tells."""
    c = F.coalesce(content, F.lit(""))
    seconds = voice_seconds(c)
    return (
        F.when(local_type == m.TEXT, strip_sender(c)).when(local_type == m.IMAGE, "[image]")
        .when(local_type == m.VOICE, F.when(seconds.isNotNull(), F.concat(F.lit("[voice "), seconds.cast("string"), F.lit("s]"))).otherwise("[voice]"))
        .when(local_type == m.VIDEO, "[video]").when(local_type == m.EMOJI, "[emoji]").when(local_type == m.CARD, "[card]").when(local_type == m.LOCATION, "[location]")
        .when(local_type.isin(m.APP, m.QUOTE), app_text(c)).when(local_type == m.CALL, call_text(c)).when(local_type.isin(m.SYSTEM, m.REVOKE), clean_system(c))
        .otherwise(F.concat(F.lit("["), type_name(local_type), F.lit("]")))
    )
