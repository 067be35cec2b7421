"""Nicknames in broken bytes, comments in markup, overlapping periods, identities."""

import random

import pytest
from pyspark.sql import functions as F

from chatloom.functions import decode
from chatloom.operators import identities, records, social


def pair(member: bytes, name: bytes | None) -> bytes:
    return b"\x0a" + bytes([len(member)]) + member + (b"\x12" + bytes([len(name)]) + name if name is not None else b"")


@pytest.mark.parametrize("raw, want", [
    (None, []),
    (b"", []),
    (b"\x0a", []),
    (pair(b"member1", "小明".encode()), [("member1", "小明")]),
    (pair(b"member1", b"One") + pair(b"member1", b"Two"), [("member1", "One")]),
    (b"\x08\x01\x0a\x02\x0a" + pair(b"member1", b"One"), [("member1", "One")]),  # marks that begin no pair
    (pair(b"member1", None) + pair(b"member2", b"Two"), [("member2", "Two")]),  # an id without a name
    (pair(b"member1", None) + b"\x12\xff\x01abc" + pair(b"member2", b"Two"), [("member2", "Two")]),  # a name too long
    (pair(b"member1", b"One")[:-1], []),  # cut off
    (b"\x0a\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff" + pair(b"member2", b"Two"), [("member2", "Two")]),  # a number without end
    (pair(b"abc", b"short id") + pair(b"1member", b"no letter") + pair(b"123@chatroom", b"a group") + pair(b"room1@chatroom", b"a group"), []),
    (pair(b"member1", b'"\'@') + pair(b"member2", b"wxid_abc") + pair(b"member3", b"x") + pair(b"member4", "名".encode()) + pair(b"member5", "🎉".encode()), [("member4", "名")]),
    (pair(b"member1", b"\x01A\x1fb\x7f "), [("member1", "Ab")]),
    (pair(b"member1", b"\xff\xfename"), [("member1", "��name")]),
    (pair(b"m" * 80, b"N" * 128) + pair(b"m" * 81, b"long id"), []),  # 128 takes two bytes
])
def test_nickname_pairs(raw, want):
    assert decode.nickname_pairs(raw) == want


def test_nicknames_among_candidates(spark):
    raw = pair(b"Member1", b"One") + pair(b"member2", b"Two")
    assert decode.nickname_pairs(raw, frozenset({"member1"})) == [("Member1", "One")]
    df = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "i int, buffer binary")
    assert {r["i"]: [tuple(p) for p in r["n"]] for r in df.select("i", decode.buffer_nicknames("buffer").alias("n")).collect()} == {1: [("Member1", "One"), ("member2", "Two")], 2: []}


def test_nicknames_survive_any_bytes():
    draw = random.Random(7)
    for _ in range(300):
        noise = [bytes(draw.choice([0x0A, 0x12, 0x05, 0x61, 0x80, 0xFF]) for _ in range(draw.randrange(12))) for _ in range(4)]
        decode.nickname_pairs(pair(b"member1", b"One").join(noise))


def test_comments(spark):
    one = "<commentUserList><CommentUser><cmtid> 7 </cmtid><username>u1</username><nickname>A &amp; B</nickname><content></content><refCommentId>0</refCommentId></CommentUser>"
    two = "<comment><comment_id>8</comment_id><nickName>B</nickName><emojiinfo><extern_url></extern_url><url>x&amp;y</url><encrypt_url>e&amp;f</encrypt_url><height>9</height><aes_key>k</aes_key></emojiinfo><replyCommentId>7</replyCommentId><ref_username>u1</ref_username></comment>"
    no = "<comment><content>no name</content></comment><comment><nickname>nothing</nickname></comment><comment><nickname>N</nickname><content><b>nested</b></content></comment>"
    df = spark.createDataFrame([(1, one + two + no + "</commentUserList>"), (2, None), (3, ""), (4, "<CommentUserList><CommentUser>"), (5, "<x><comment><nickname>a</nickname><content>out of a list</content></comment></x>"), (6, "<commentlist>" + one.replace("<commentUserList>", "") + "</commentlist>")], "i int, xml string")
    got = {r["i"]: r["c"] for r in df.select("i", social.comments_of(F.col("xml")).alias("c")).collect()}
    assert [tuple(c) for c in got[1]] == [("7", "A &amp; B", "u1", "", None, None, None, []), ("8", "B", None, "", "7", "u1", "A &amp; B", got[1][1]["emojis"])]
    assert [tuple(e) for e in got[1][1]["emojis"]] == [("", "", 0, 9, "e&f", "k")]
    assert got[2] == got[3] == got[4] == got[5] == [] and len(got[6]) == 1


def test_overlaps_same_as_all_pairs(spark):
    draw = random.Random(3)
    rows = []
    for i in range(250):
        a = draw.choice([0, 5, 10**6, draw.randrange(2000), draw.randrange(2_000_000_000)])
        rows.append((draw.choice("ab"), i, a, a + draw.choice([0, 1, 7, 300, 100_000, 10**9, -1])))
    rows += [("a", 900, None, 5), ("a", 901, 5, None), ("a", 902, -5, 5), (None, 903, 1, 2)]
    df = spark.createDataFrame(rows, "session_id string, id int, period_start bigint, period_end bigint").withColumns({n: F.lit("clash") for n in ("l", "bin", "level")})
    got = sorted((r["l"]["id"], r["r"]["id"]) for r in records.overlaps(df, df).collect())
    ok = [r for r in rows if r[0] and None not in r and 0 <= r[2] <= r[3]]
    assert got == sorted((x[1], y[1]) for x in ok for y in ok if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    assert records.overlaps(df.limit(0), df).count() == 0


def test_record_pages(spark):
    df = spark.createDataFrame([(f"s{i % 2}", i, i * 10 if i else 0, i * 10 + 5, 3) for i in range(300)], "session_id string, record_id int, period_start bigint, period_end bigint, created_at bigint")
    assert [r["record_id"] for r in records.period_records(df, begin=25, end=30).collect()] == [3, 2]
    assert records.period_records(df, limit=999).count() == 200 and records.period_records(df, limit=0).count() == 100
    assert [r["record_id"] for r in records.period_records(df, "s1", limit=2, offset=1).collect()] == [297, 295]
    assert records.period_records(df, end=1).first()["record_id"] == 0  # no start: by its making


def test_identities_of_chains_and_stars(spark):
    chain = [(f"c{i:03}", [f"k{i}", f"k{i + 1}"]) for i in range(90)]
    star = [(f"s{i:03}", ["shared", f"x{i}"]) for i in range(60)]
    alone = [("alone", ["z"]), ("none", []), ("null", None), (None, ["shared"]), ("blank", ["", None])]
    df = spark.createDataFrame(chain[::-1] + star + alone + chain[:3], "username string, keys array<string>")
    got = {r["username"]: r["identity"] for r in identities.joined_keys(df).collect()}
    want = {u: "c000" for u, _ in chain} | {u: "s000" for u, _ in star} | {u: u for u in ("alone", "none", "null", "blank")}
    assert got == want
    assert identities.joined_keys(df.limit(0)).count() == 0


def test_aliases_make_one_account(spark):
    contacts = spark.createDataFrame([("wxid_abc_12", "Nick"), ("nick", None), ("other", "WXID_abc"), ("apart", "")], "username string, alias string")
    found = identities.joined_keys(identities.account_keys(contacts))
    assert {r["username"]: r["identity"] for r in found.collect()} == {"wxid_abc_12": "nick", "nick": "nick", "other": "nick", "apart": "apart"}
    counts = spark.createDataFrame([("NICK", 3), (" other ", 4), ("stranger", 2), ("", 9), (None, 9), ("nick", -1), ("apart", None)], "sender string, n bigint")
    assert {r["identity"]: (r["n"], r["ids"]) for r in identities.counts_by_identity(counts, found).collect()} == {"nick": (7, 2), "stranger": (2, 1)}
    asked = spark.createDataFrame([("m", ["OTHER", "Stranger"]), ("n", ["x"]), ("o", None)], "username string, candidates array<string>")
    assert {r["username"]: r["n"] for r in identities.greatest_count(asked, counts).collect()} == {"m": 4, "n": 0, "o": 0}
