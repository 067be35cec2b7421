"""Exports: each form is a DataFrame of text lines, so it is made and written by partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, time
from ..functions.text import csv_cell, escape_html, sql_literal

#: Order of lines within a session.
ORDER = ("create_time", "local_id")


def readable(msgs: DataFrame) -> DataFrame:
    """Messages with ``clock``, ``who`` and ``text``."""
    who = F.when(F.col("is_send") == 1, "me").otherwise(F.coalesce(F.col("sender") if "sender" in msgs.columns else F.lit(None), "session_id"))
    text = labels.display_text(F.col("local_type"), F.col("content") if "content" in msgs.columns else F.lit(None).cast("string"))
    return msgs.withColumns({"clock": time.clock(F.col("create_time")), "who": who, "text": text})


def txt(msgs: DataFrame) -> DataFrame:
    return _lines(msgs, F.concat(F.col("clock"), F.lit(" '"), F.col("who"), F.lit("' "), F.col("text")))


def markdown(msgs: DataFrame) -> DataFrame:
    return _lines(msgs, F.concat(F.lit("**"), F.col("who"), F.lit("** "), F.col("clock"), F.lit("  \n"), F.col("text"), F.lit("\n")))


def html(msgs: DataFrame) -> DataFrame:
    side = F.when(F.col("is_send") == 1, "mine").otherwise("theirs")
    return _lines(msgs, F.concat(F.lit('<div class="'), side, F.lit('"><time>'), F.col("clock"), F.lit("</time><b>"), escape_html(F.col("who")), F.lit("</b><p>"), escape_html(F.col("text")), F.lit("</p></div>")))


def csv(msgs: DataFrame) -> DataFrame:
    """Rows for training: id, type name, sender side, talker, text, source."""
    cells = [F.col("local_id"), labels.type_name(F.col("local_type")), F.col("is_send"), F.col("who"), F.col("text"), F.col("session_id"), F.col("clock")]
    return _lines(msgs, F.concat_ws(",", *[csv_cell(c) for c in cells]))


def sql(msgs: DataFrame, table: str = "messages") -> DataFrame:
    """INSERT statements; numbers of types need BIGINT."""
    cells = [sql_literal(F.col("session_id")), F.col("local_id").cast("string"), F.col("create_time").cast("string"), sql_literal(F.col("who")), F.col("is_send").cast("string"), F.col("local_type").cast("string"), sql_literal(F.col("text"))]
    return _lines(msgs, F.concat(F.lit(f"INSERT INTO {table} (session_id, local_id, create_time, sender, is_send, local_type, content) VALUES ("), F.concat_ws(", ", *cells), F.lit(");")))


def sql_head(table: str = "messages") -> str:
    return f"CREATE TABLE IF NOT EXISTS {table} (session_id TEXT, local_id BIGINT, create_time BIGINT, sender TEXT, is_send INTEGER, local_type BIGINT, content TEXT);\nCREATE INDEX IF NOT EXISTS {table}_by_time ON {table} (session_id, create_time);"


def document_lines(msgs: DataFrame) -> DataFrame:
    """The exchange document as JSON lines: one row for each message."""
    content = F.col("content") if "content" in msgs.columns else F.lit(None).cast("string")
    body = F.to_json(F.struct(F.lit("message").alias("_type"), F.col("who").alias("sender"), F.col("create_time").alias("timestamp"), labels.api_code(F.col("local_type"), content).alias("type"), F.col("text").alias("content")))
    return _lines(msgs, body)


def document_members(msgs: DataFrame) -> DataFrame:
    """Senders of each session in the order of their first message."""
    return readable(msgs).groupBy("session_id", "who").agg(F.min(F.struct(*ORDER)).alias("first")).select("session_id", F.col("who").alias("platform_id"), F.col("first.create_time").alias("first_time"))


def _lines(msgs: DataFrame, line: Column) -> DataFrame:
    return readable(msgs).select("session_id", *ORDER, line.alias("line"))


FORMS = {"txt": txt, "markdown": markdown, "html": html, "csv": csv, "sql": sql, "jsonl": document_lines}


def export(msgs: DataFrame, form: str, path: str, mode: str = "errorifexists") -> None:
    """Writes one folder of lines for each session, in order within files. A hot session is written in several files."""
    lines = FORMS[form](msgs).withColumn("month", F.date_format(time.moment(F.col("create_time")), "yyyy-MM"))
    ordered = lines.repartition("session_id", "month").sortWithinPartitions("session_id", "month", *ORDER)
    ordered.select("session_id", "month", F.col("line").alias("value")).write.partitionBy("session_id", "month").mode(mode).text(path)


def vcards(contacts: DataFrame) -> DataFrame:
    """A card for each friend."""
    return contacts.where("type = 'friend'").select("username", F.concat(F.lit("BEGIN:VCARD\nVERSION:3.0\nFN:"), "display_name", F.lit("\nUID:"), "username", F.lit("\nEND:VCARD")).alias("card"))


def contact_csv(contacts: DataFrame) -> DataFrame:
    return contacts.select("username", F.concat_ws(",", csv_cell(F.col("username")), csv_cell(F.col("display_name")), csv_cell(F.col("type"))).alias("line"))


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def import_snapshot(current: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to append (keys filled, unknown so far, one for each key), and one row of counts."""
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    good = incoming.where(whole)
    new = good.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    counts = incoming.agg(F.count("*").alias("rows"), F.count_if(~whole).alias("malformed")).crossJoin(new.agg(F.count("*").alias("inserted")))
    return new, counts.select("inserted", (F.col("rows") - F.col("malformed") - F.col("inserted")).alias("ignored"), "malformed")


def sync_page(msgs: DataFrame, since: int, limit: int) -> DataFrame:
    """An ascending page of messages from ``since`` on, one more than asked tells that there is more."""
    return msgs.where(F.col("create_time") >= since).orderBy("create_time", "local_id", "session_id").limit(limit + 1)
