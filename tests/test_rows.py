"""Raw rows as messages and the collection of shards, against cases."""

import pytest
from pyspark.sql import functions as F

from chatloom.sources import rows


def messages(spark, *jsons, me="me"):
    df = spark.createDataFrame([(i, j) for i, j in enumerate(jsons)], "i int, j string").select("i", F.try_parse_json("j").alias("row"))
    return [r.asDict() for r in rows.messages_of(df, me).orderBy("i").collect()]


@pytest.mark.parametrize("value, want", [
    ("0", "0"), ("007", "7"), ("18446744073709551615", "18446744073709551615"), ("-5", "0"), ("+5", "5"), ("2.9", "2"), ("1e3", "1000"), ("1.8446744073709551615E19", "18446744073709551615"), ("", None), (" ", None), (None, None), ("x", None), ("NaN", None),
    ('{"low": -1, "high": -1}', "18446744073709551615"), ('{"low": 1, "high": 0}', "1"), ('{"low": 0, "high": -2147483648}', "9223372036854775808"), ('{"value": "12"}', "12"), ('{"intValue": 3.7}', "3"), ('{"other": 1}', None),
])
def test_unsigned_tokens(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(rows.unsigned_token(F.col("v"))).first()[0] == want


def test_fields_and_defaults(spark):
    got = messages(
        spark,
        '{"local_id": 5, "LocalId": 6, "localId": null, "server_id": null, "svr_id": "9", "create_time": 1704067200, "sender_username": " u1 ", "message_content": "hi", "is_send": 0}',
        '{"LOCAL_ID": "5", "MSGTIME": "1704067200000", "message_content": "user_2:\\nhello", "sort_seq": 3}',
        '{"is_send": "1", "message_content": "mine", "local_type": "49"}',
        '{"sender_username": "me_ab12", "is_send": 0, "create_time": "bad", "local_id": -4}',
        '[1, 2]',
        "no json",
        None,
        '{"compress_content": "", "message_content": null, "computed_is_send": null, "is_send": "yes"}',
    )
    a, b, c, d, *rest = got
    assert (a["local_id"], a["server_id"], a["create_time"], a["sort_seq"], a["sender"], a["is_send"], a["content"]) == (5, "9", 1704067200, 1704067200000, "u1", 0, "hi")
    assert (b["local_id"], b["create_time"], b["sort_seq"], b["sender"], b["is_send"]) == (5, 1704067200, 3, "user_2", 0)
    assert (c["sender"], c["is_send"], c["local_type"], c["message_key"]) == ("me", 1, 49, "fallback::0:0:0:me:49")
    assert (d["sender"], d["is_send"], d["create_time"], d["local_id"]) == ("me_ab12", 1, 0, -4)
    assert all((r["local_type"], r["local_id"], r["create_time"], r["sender"], r["is_send"], r["content"]) == (1, 0, 0, None, None, "") for r in rest) and len(rest) == 4
    assert messages(spark, '{"is_send": 1, "sender_username": "me"}', me="")[0]["is_send"] == 1


def test_message_keys(spark):
    got = [r["message_key"] for r in messages(
        spark,
        '{"local_id": 1, "_db_path": "/a/b c.db", "table_name": "Msg_x"}', '{"local_id": 1, "db_name": "n", "table_name": " "}', '{"server_id": 7, "create_time": 5, "sender_username": "a:b"}', '{"server_id": 7, "db_name": "n"}', '{"local_id": 1}',
    )]
    assert got == ["%2Fa%2Fb%20c.db:Msg_x:1", "local:n:1:0:0::1", "server:7:5:5000:0:a%3Ab:1", "server:n:7:0:0:0::1", "fallback::0:0:1::1"]


def test_other_columns_stay(spark):
    df = spark.createDataFrame([("keep", 1, '{"local_id": 2}')], "_held string, extra int, j string").select("_held", "extra", F.parse_json("j").alias("raw"))
    r = rows.messages_of(df.withColumnRenamed("_held", "x_held"), row="raw").first()
    assert (r["x_held"], r["extra"], r["local_id"]) == ("keep", 1, 2)


def test_first_shard_wins(spark):
    one = spark.createDataFrame([(1, 10, "a"), (1, 10, "a again"), (2, 20, "b"), (3, 0, "no time")], "local_id bigint, create_time bigint, message_content string")
    two = spark.createDataFrame([("1", "10", "other", "x"), ("4", "30", "d", "y")], "msgId string, msgTime string, message_content string, sender_username string")
    got = {r["export_key"]: (r["shard"], r["sender"]) for r in rows.collected([one, two], "s", "me").collect()}
    assert got == {"1:10:0": (0, "s"), "2:20:0": (0, "s"), "3:0:0": (0, "s"), "4:30:0": (1, "y")}
    assert {r["export_key"] for r in rows.collected([one, two], "s", "me", begin=15, end=25).collect()} == {"2:20:0", "3:0:0"}
    assert rows.collected([one.limit(0), two.limit(0)], "s", "me").count() == 0
