"""Decoding of binary and nested values, by Arrow batches; nothing here is needed for plain text columns."""

from __future__ import annotations

import base64
import binascii
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# The head of a zstd frame, and the share of unreadable characters from which bytes are no UTF-8.
ZSTD_MAGIC, UNREADABLE = b"\x28\xb5\x2f\xfd", 0.2
# End of fixed values.
_HEX, _BASE64 = re.compile(r"^[0-9a-fA-F]+$"), re.compile(r"^[A-Za-z0-9+/=]+$")


def decode_bytes(raw: bytes, fallback: str = "") -> str:
    """Unpacks a zstd frame; reads UTF-8 without unreadable characters unless a fifth are; then the fallback, else Latin-1. A broken frame is read as it is."""
    if raw[:4] in (ZSTD_MAGIC, ZSTD_MAGIC[::-1]):
        import zstandard

        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(raw).decode("utf-8", "replace")
        except zstandard.ZstdError:
            pass
    text = raw.decode("utf-8", "replace")
    bad = text.count("\ufffd")
    if bad < UNREADABLE * len(text):
        return text.replace("\ufffd", "")
    return fallback if fallback and bad else raw.decode("latin-1")


def decode_text(value: str | None) -> str | None:
    """Long hex or base64 text is decoded as bytes; any other text stays."""
    if value is None or len(value) <= 16:
        return value
    try:
        if len(value) % 2 == 0 and _HEX.match(value):
            return decode_bytes(bytes.fromhex(value), value) or value
        if len(value) % 4 == 0 and _BASE64.match(value):
            raw = base64.b64decode(value, validate=True)
            return decode_bytes(raw, value) if raw[:4] == ZSTD_MAGIC else value
    except (ValueError, binascii.Error):
        pass
    return value


@pandas_udf(StringType())
def decoded(values: pd.Series) -> pd.Series:
    return pd.Series([decode_text(v) if not isinstance(v, (bytes, bytearray)) else decode_bytes(bytes(v)) for v in values], index=values.index)


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while at < len(raw) and shift < 64:
        value |= (raw[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 0x80:
            return value, at
    raise ValueError("no varint")


def field_strings(raw: bytes | None, field: int) -> list[str]:
    """Texts of a field of a protobuf message without its description; unreadable rests are left out."""
    found, at = [], 0
    raw = raw or b""
    try:
        while at < len(raw):
            key, at = varint(raw, at)
            kind = key & 7
            if kind == 0:
                _, at = varint(raw, at)
            elif kind in (1, 5):
                at += 8 if kind == 1 else 4
            elif kind == 2:
                size, at = varint(raw, at)
                if at + size > len(raw):
                    break
                if key >> 3 == field:
                    found.append(raw[at : at + size].decode("utf-8", "replace"))
                at += size
            else:
                break
    except ValueError:
        pass
    return found


# Marks before a member's id and its nickname in a group's extra bytes, their greatest lengths, and what an id and a nickname look like.
ID_MARK, NICKNAME_MARK, ID_BYTES, NICKNAME_BYTES = 0x0A, 0x12, 96, 128
MEMBER_ID, OWN_ID = re.compile(r"[A-Za-z][A-Za-z0-9_.@-]{3,79}", re.A), re.compile(r"wxid_[a-z0-9_]+", re.A | re.I)
NO_NAME, NAME_SIGN, ONE_SIGN = re.compile("[\"'@]+"), re.compile("[\u4e00-\u9fff\u3400-\u4dbfA-Za-z0-9_]"), re.compile("[\u3400-\u9fff]")
# End of fixed values.


def likely_nickname(text: str) -> str:
    """The cleaned nickname, or nothing where it can be none."""
    name = re.sub(r"[\x00-\x1f\x7f]", "", text).strip()
    fits = name and not NO_NAME.fullmatch(name) and not OWN_ID.fullmatch(name) and "@chatroom" not in name and NAME_SIGN.search(name)
    return name if fits and (len(name) > 1 or ONE_SIGN.fullmatch(name)) else ""


def piece(raw: bytes, at: int, mark: int, most: int) -> tuple[bytes, int] | None:
    """The bytes behind ``mark`` and their length at ``at``, and where they end; None where that is no such piece."""
    if at >= len(raw) or raw[at] != mark:
        return None
    try:
        size, start = varint(raw, at + 1)
    except ValueError:
        return None
    return (raw[start : start + size], start + size) if 0 < size <= most and start + size <= len(raw) else None


def nickname_pairs(raw: bytes | None, among: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(member, nickname) of pairs that stand anywhere in bytes without a frame; a member's first one counts.

    From a mark that begins no pair the search goes on at the next byte; behind an id
    without a nickname, at the id's end. ``among``: only these ids, in lower case.
    """
    found: dict[str, str] = {}
    raw, at = raw or b"", 0
    while (at := raw.find(ID_MARK, at)) >= 0 and at < len(raw) - 2:
        head = piece(raw, at, ID_MARK, ID_BYTES)
        member = head[0].decode("utf-8", "replace").strip() if head else ""
        if not MEMBER_ID.fullmatch(member) or "@chatroom" in member:
            at += 1
            continue
        at = head[1]
        tail = piece(raw, at, NICKNAME_MARK, NICKNAME_BYTES) if not among or member.lower() in among else None
        if tail:
            at = tail[1]
            if name := likely_nickname(tail[0].decode("utf-8", "replace")):
                found.setdefault(member, name)
    return list(found.items())


@pandas_udf(ArrayType(StructType([StructField("username", StringType()), StructField("nickname", StringType())])))
def buffer_nicknames(blobs: pd.Series) -> pd.Series:
    """The pairs of ``nickname_pairs`` of each blob."""
    return pd.Series([nickname_pairs(bytes(b) if b is not None else None) for b in blobs], index=blobs.index)


def protobuf_strings(field: int):
    @pandas_udf(ArrayType(StringType()))
    def strings(blobs: pd.Series) -> pd.Series:
        return pd.Series([field_strings(bytes(b) if b is not None else None, field) for b in blobs], index=blobs.index)

    return strings


def top_level(xml: str | None, tag: str) -> list[str]:
    """Inner texts of such elements that lie in no other such element."""
    found, depth, start = [], 0, 0
    for m in re.finditer(rf"(?i)<(/?){re.escape(tag)}\b[^>]*?(/?)>", xml or ""):
        if m[1]:
            depth -= 1
            if depth == 0:
                found.append(xml[start : m.start()])
            depth = max(depth, 0)
        elif not m[2]:
            if depth == 0:
                start = m.end()
            depth += 1
    return found


RECORD = StructType([StructField("depth", IntegerType()), StructField("kind", StringType()), StructField("sender", StringType()), StructField("time", StringType()), StructField("text", StringType())])


def records_of(xml: str | None, depth: int = 0, most: int = 4) -> list[tuple]:
    """Items of a forwarded record, those of nested records behind their parent, to a fixed depth."""

    def value(item: str, tag: str) -> str:
        m = re.search(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", item)
        return re.sub(r"(?s)<!\[CDATA\[(.*?)\]\]>", r"\1", m[1]).strip() if m else ""

    out = []
    for element, item in zip(re.findall(r"(?i)<dataitem\b[^>]*>", xml or ""), top_level(xml, "dataitem")):
        kind = re.search(r"(?i)datatype\s*=\s*['\"](\d+)", element)
        nested = top_level(item, "recordxml")
        own = item
        for n in nested:
            own = own.replace(n, "")
        out.append((depth, kind[1] if kind else "", value(own, "sourcename"), value(own, "sourcetime"), value(own, "datadesc") or value(own, "datatitle")))
        if depth + 1 < most:
            for n in nested:
                out += records_of(n, depth + 1, most)
    return out


@pandas_udf(ArrayType(RECORD))
def forwarded_records(xml: pd.Series) -> pd.Series:
    return pd.Series([records_of(x) for x in xml], index=xml.index)


@pandas_udf(ArrayType(StringType()))
def top_level_items(xml: pd.Series) -> pd.Series:
    return pd.Series([top_level(x, "item") for x in xml], index=xml.index)
