"""One account under several ids: which ids belong together, and counts by account."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import identity_keys


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder: ``spark.checkpoint.dir``, or on a local master a temporary one where that is unset."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chatloom-"))
    return df.checkpoint()


def joined_keys(accounts: DataFrame) -> DataFrame:
    """From accounts (username, keys: the ids it goes by) rows (username, identity): accounts that share a key, also through others, are one identity, named by its least username.

    Every round each account hears the least name of those it shares a key with, and then
    the name that its new name itself has, so chains end in rounds that grow with the
    logarithm of their length. A key that very many share is summed up before it is told.
    """
    own = checkpointed(accounts.where("username is not null").select("username", F.explode_outer("keys").alias("key")).distinct())
    pairs = own.where("key is not null and key <> ''")
    labels = checkpointed(own.select("username", F.col("username").alias("identity")).distinct())
    while True:
        told = pairs.join(labels, "username").groupBy("key").agg(F.min("identity").alias("told"))
        heard = pairs.join(told, "key").groupBy("username").agg(F.min("told").alias("told"))
        least = labels.join(heard, "username", "left").select("username", F.col("identity").alias("old"), F.least("identity", "told").alias("identity"))
        # Whoever an account was named by learns of the better name too.
        back = least.where("identity <> old").groupBy(F.col("old").alias("username")).agg(F.min("identity").alias("back"))
        least = least.join(back, "username", "left").select("username", "old", F.least("identity", "back").alias("identity"))
        up = least.select(F.col("username").alias("identity"), F.col("identity").alias("up"))
        moved = checkpointed(least.join(up, "identity", "left").select("username", "old", F.least("identity", "up").alias("identity")))
        labels = moved.drop("old")
        if moved.where("old <> identity").isEmpty():
            return labels


def account_keys(contacts: DataFrame) -> DataFrame:
    """(username, keys): an account's own id, raw and cleaned, and its alias, in lower case."""
    return contacts.select("username", F.array_distinct(F.concat(identity_keys(F.col("username")), identity_keys(F.col("alias")))).alias("keys"))


def counts_by_identity(counts: DataFrame, identities: DataFrame) -> DataFrame:
    """(identity, n, ids): messages counted by sender (sender, n) summed over the ids of each account; senders that are no account count by themselves. Negative and null counts are none."""
    known = identities.select(F.lower(F.trim("username")).alias("_id"), "identity").groupBy("_id").agg(F.min("identity").alias("identity"))
    own = counts.where("n > 0").withColumn("_id", F.lower(F.trim("sender"))).where("_id <> ''")
    return own.join(known, "_id", "left").groupBy(F.coalesce("identity", "_id").alias("identity")).agg(F.sum("n").alias("n"), F.count_distinct("_id").alias("ids"))


def greatest_count(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """From (username, candidates: array of ids) the greatest count that any of them has, raw or cleaned, in any case; 0 without one."""
    asked = candidates.select("username", F.explode_outer(F.flatten(F.transform("candidates", identity_keys))).alias("_id"))
    known = counts.select(F.lower(F.trim("sender")).alias("_id"), "n").groupBy("_id").agg(F.max("n").alias("n"))
    return asked.join(known, "_id", "left").groupBy("username").agg(F.greatest(F.lit(0), F.coalesce(F.max("n"), F.lit(0))).cast("bigint").alias("n"))
