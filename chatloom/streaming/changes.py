"""Updated and deleted messages: an append-only log of changes over tables that are never written in place.

Files hold ranges of days of the messages' times, so their number grows with the rows
and not with the days. A generation holds some days anew; of a day the latest
generation counts. Changes lie in batches. Compaction writes the days that
have changes as a new generation, and then removes the batches that went into it. To
apply a change twice changes nothing, so it may end at any place and be begun again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import small

KEY = ("session_id", "local_id", "create_time")
CHANGES = "session_id string, local_id bigint, create_time bigint, version bigint, op string, content string"
DAY = 86400


def with_changes(msgs: DataFrame, changes: DataFrame) -> DataFrame:
    """Messages without those that a change deleted, with the content of their latest update (by version, then the greatest content).

    Changes (KEY, version, op: update or delete, content) of no message and of other
    ``op`` change nothing; a deleted message stays deleted. Null keys are equal to nulls.
    """
    order = F.struct("version", "content")
    latest = changes.groupBy(*KEY).agg(
        F.coalesce(F.bool_or(F.col("op") == "delete"), F.lit(False)).alias("_gone"), F.max(F.when(F.col("op") == "update", order)).alias("_last")
    ).withColumnsRenamed({k: f"_{k}" for k in KEY})
    joined = msgs.join(small(latest), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY], "left").where(~F.coalesce("_gone", F.lit(False)))
    return joined.select(*[F.when(F.col("_last").isNotNull(), F.col("_last.content")).otherwise(F.col(c)).alias(c) if c == "content" else F.col(c) for c in msgs.columns])


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_day", F.coalesce(F.expr(f"create_time div {DAY}"), F.lit(-1)))


class ChangeLog:
    """Messages with a change log in ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, name: str):  # noqa: ANN202
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self, name: str) -> list[str]:
        """Names of the finished parts below: those whose writing succeeded."""
        place, files = self._path(name)
        if not files.exists(place):
            return []
        found = [s.getPath().getName() for s in files.listStatus(place)]
        return sorted(p for p in found if files.exists(self._path(f"{name}/{p}/_SUCCESS")[0]))

    def write(self, msgs: DataFrame) -> None:
        """The days of ``msgs`` as a new generation."""
        generations = self._parts("messages")
        nth = int(generations[-1].split("-")[0]) + 1 if generations else 0
        # Ranges by the keys too, so that a day of very many messages is many tasks; the order lets a filter on days skip parts of files.
        ranged = with_day(msgs).repartitionByRange("_day", *KEY).sortWithinPartitions("_day")
        ranged.write.parquet(f"{self.folder}/messages/{nth:09}-{uuid.uuid4().hex[:8]}")

    def append(self, changes: DataFrame) -> None:
        """A batch of changes."""
        own = changes.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in CHANGES.split(", ")])
        with_day(own).write.parquet(f"{self.folder}/changes/{uuid.uuid4().hex}")

    def _messages(self) -> DataFrame:
        """The rows of each day's latest generation."""
        found = None
        for name in self._parts("messages"):
            part = self.spark.read.parquet(f"{self.folder}/messages/{name}")
            found = part if found is None else found.join(small(part.select("_day").distinct()), "_day", "left_anti").unionByName(part)
        if found is None:
            raise ValueError(f"no messages in {self.folder}")
        return found

    def _changes(self, batches: list[str]) -> DataFrame:
        schema = f"{CHANGES}, _day bigint"
        out = self.spark.createDataFrame([], schema)
        for b in batches:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/changes/{b}"))
        return out

    def read(self) -> DataFrame:
        """The messages as they are now."""
        return with_changes(self._messages(), self._changes(self._parts("changes")).drop("_day")).drop("_day")

    def compact(self) -> None:
        """Puts the changes so far into the days that they change, and forgets them; days without changes stay as they are.

        A day of which nothing is left is written as before and stays in the log, as an
        empty day has no row that could hide the older one.
        """
        batches = self._parts("changes")
        if not batches:
            return
        changes = self._changes(batches)
        days = changes.select("_day").distinct()
        first, last = changes.agg(F.min("_day"), F.max("_day")).first()
        touched = self._messages().where(F.col("_day").between(first, last)).join(small(days), "_day", "left_semi")
        kept = with_changes(touched, changes.drop("_day"))
        empty = touched.select("_day").distinct().join(kept.select("_day").distinct(), "_day", "left_anti")
        if kept.isEmpty():
            return
        lost = changes.join(small(empty), "_day", "left_semi").drop("_day")
        if not lost.isEmpty():
            self.append(lost)
        self.write(kept.drop("_day"))
        for b in batches:
            place, files = self._path(f"changes/{b}")
            files.delete(place, True)
