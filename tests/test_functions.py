"""Edge cases of the column functions."""

import base64

import pytest
import zstandard
from pyspark.sql import functions as F

from chatloom.functions import decode, identity, labels, text, time


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", bytes: "binary"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [("1700000000", 1700000000), ("1700000000123", 1700000000), (None, 0), ("x", 0), ("-5", -5)])
def test_seconds(spark, raw, want):
    assert one(spark, time.seconds(F.col("v")), v=raw) == want


@pytest.mark.parametrize("raw, want", [(1700000000, 1700000000), (1700000000123, 1700000000), (1700000000123456, 1700000000), (1700000000123456789, 1700000000)])
def test_seconds_of_any(spark, raw, want):
    assert one(spark, time.seconds_of_any(F.col("v")), v=raw) == want


@pytest.mark.parametrize("raw, want", [("20240101000000", 1704067200), ("20240101", 1704067200), ("1704067200", 1704067200), ("2024-01-01 00:00:01", 1704067201), ("nonsense", None)])
def test_parse_seconds(spark, raw, want):
    assert one(spark, time.parse_seconds(F.col("v")), v=raw) == want


def test_range_rules():
    assert time.export_range(5, 3) == (3, 5)
    assert time.export_range(0, None) is None
    with pytest.raises(ValueError):
        time.in_range(F.lit(1), 5, 3)


@pytest.mark.parametrize("raw, want", [("wxid_abc_9f2d", "wxid_abc"), ("someone_ab1X", "someone"), ("someone_abc", "someone_abc"), (" x ", "x"), (None, "")])
def test_clean_id(spark, raw, want):
    assert one(spark, identity.clean_id(F.col("v")), v=raw) == want


@pytest.mark.parametrize("raw, want", [("12@chatroom", False), ("gh_1", False), ("filehelper", False), ("u1", True), ("", False), (None, False), ("x@kefu.openim", False), ("a@openim", False), ("service_9", False), ("fmessage_2", False), ("Weixin", False), ("WEIXINS", True)])
def test_private(spark, raw, want):
    assert one(spark, identity.is_private(F.col("v")), v=raw) is want


def test_sent_by_me_variants(spark):
    both = F.struct(identity.sent_by_me(F.col("f"), F.col("s"), "wxid_me_ab12"), identity.sent_by_me_explicit(F.col("f"), F.col("s"), "wxid_me"))
    assert tuple(one(spark, both, f="0", s="WXID_ME")) == (True, False)
    assert tuple(one(spark, both, f="true", s="other")) == (True, True)


def test_markup(spark):
    xml = "<msg><appmsg><title><![CDATA[a &amp;lt; b]]></title><type>57</type><refermsg><type>1</type><svrid>99999999999999999999</svrid><fromusr>u2</fromusr><content>old</content></refermsg></appmsg></msg>"
    assert one(spark, text.xml_value(F.col("v"), "title"), v=xml) == "a &amp;lt; b"
    assert one(spark, text.decode_entities(F.col("v")), v="a &amp;lt; b") == "a < b"
    assert one(spark, text.app_type(F.col("v")), v=xml) == 57
    quote = one(spark, text.quote_of(F.col("v")), v=xml)
    assert (quote["server_id"], quote["sender"], quote["content"]) == ("99999999999999999999", "u2", "old")
    assert one(spark, text.quote_of(F.col("v")), v="<msg>") is None
    assert one(spark, text.app_type(F.col("v"), own=False), v="<refermsg><type>1</type></refermsg><type>6</type>") == 1
    assert one(spark, text.at_users(F.col("v")), v="<atuserlist><![CDATA[,u1,@u2;u1]]></atuserlist>") == ["u1", "u2"]
    assert one(spark, text.at_users(F.col("v")), v='{"atuserlist": "u3|u4"}') == ["u3", "u4"]
    assert one(spark, text.voice_seconds(F.col("v")), v='<voicemsg voicelength="2499" />') == 2


def test_plain_text(spark):
    assert one(spark, text.js_length(F.col("v")), v="a😀") == 3
    assert one(spark, text.strip_sender(F.col("v")), v="user_1:\nhello") == "hello"
    assert one(spark, text.strip_sender(F.col("v")), v="https://x") == "https://x"
    assert one(spark, text.csv_cell(F.col("v")), v='a"b,c') == '"a""b,c"'
    assert one(spark, text.emoji_tokens(F.col("v")), v="[ok] no [x][y]") == ["[ok]", "[x]", "[y]"]
    assert one(spark, text.clamp(F.col("v"), 3), v="abcdef") == "abc..."
    assert one(spark, text.percent(F.lit(1), F.lit(3))) == 33.3
    assert one(spark, text.reply_rate(F.lit(1), F.lit(0))) == 0.0


def test_labels(spark):
    assert one(spark, labels.display_text(F.lit(3), F.lit(None).cast("string"))) == "[image]"
    assert one(spark, labels.display_text(F.lit(49), F.col("v")), v="<title>T</title><type>6</type>") == "[file] T"
    assert one(spark, labels.resource_kind(F.lit(49), F.col("v")), v="<type>6</type>") == "file"
    assert one(spark, labels.type_name(F.lit(244813135921))) == "quote"


def test_decode(spark):
    packed = zstandard.ZstdCompressor().compress("grüße and more text".encode())
    assert one(spark, decode.decoded(F.col("v")), v=packed.hex()) == "grüße and more text"
    assert one(spark, decode.decoded(F.col("v")), v=base64.b64encode(packed).decode()) == "grüße and more text"
    assert one(spark, decode.decoded(F.col("v")), v="just a plain sentence") == "just a plain sentence"
    blob = b"\x08\x96\x01\x12\x03abc\x12\x02de\x1a\x01z\x12\x7f"
    assert one(spark, decode.protobuf_strings(2)(F.col("v")), v=blob) == ["abc", "de"]


def test_nested_records(spark):
    inner = '<dataitem datatype="1"><sourcename>B</sourcename><datadesc>in</datadesc></dataitem>'
    xml = f'<recordinfo><dataitem datatype="17"><sourcename>A</sourcename><datadesc>out</datadesc><recordxml>{inner}</recordxml></dataitem></recordinfo>'
    rows = one(spark, decode.forwarded_records(F.col("v")), v=xml)
    assert [(r["depth"], r["kind"], r["sender"], r["text"]) for r in rows] == [(0, "17", "A", "out"), (1, "1", "B", "in")]
    assert one(spark, decode.forwarded_records(F.col("v")), v="<dataitem") == []


def test_decoded_bytes_drop_what_is_unreadable():
    import zstandard

    frame = zstandard.ZstdCompressor().compress("grüße".encode())
    assert decode.decode_bytes(frame) == "grüße"
    assert decode.decode_bytes(b"plain text here \xff end") == "plain text here  end"
    assert decode.decode_bytes(b"\xff\xfe\xfd", "given") == "given" and decode.decode_bytes(b"\xff\xfe\xfd") == "\xff\xfe\xfd"
    assert decode.decode_bytes(decode.ZSTD_MAGIC + b"broken frame with text") != ""


def test_whole_numbers_stay_exact(spark):
    assert one(spark, text.safe_int(F.col("v")), v="9007199254740993") == 9007199254740993
    assert one(spark, text.safe_int(F.col("v")), v="12.7") == 12 and one(spark, text.safe_int(F.col("v")), v="x") == 0


def test_sender_heads_and_system_lines(spark):
    v = F.col("v")
    assert one(spark, text.strip_sender(v), v="user_1:<BR/>hello") == "hello" and one(spark, text.strip_sender(v), v=" ab: x") == "x"
    assert one(spark, text.sender_of(v), v="user_1:&lt;BR&gt;hello") == "user_1" and one(spark, text.sender_of(v), v="abc:\nx") == ""
    cases = {
        "<sysmsg type='x'><sysmsgtemplate><plain><![CDATA[user_1:\n A  joined ]]></plain></sysmsgtemplate></sysmsg>": "A joined",
        "<sysmsg><text>told</text></sysmsg> <plain>outside</plain>": "told",
        "&lt;b&gt;A&lt;/b&gt; recalled 1700000000 ": "A recalled",
        '<?xml version="1.0"?><x>note</x>': "note",
        "<x/> 12 ": "[system]",
        "": "[system]",
    }
    for raw, want in cases.items():
        assert one(spark, text.clean_system(v, "[system]"), v=raw) == want
    assert one(spark, text.clean_system(v), v="<x/>") == ""
