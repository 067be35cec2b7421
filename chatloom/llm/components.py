"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shuffled, written

LAST, ROWS_A_FILE = 9223372036854775807, 100_000


def label_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """From nodes (node, least) and links (left, right): (node, least, root) with the least of each node's component and the least node that has it.

    ``least`` is a long (null counts as the greatest). In every round a node hears the
    least label of its neighbours, takes it, tells it to the node its own label comes
    from, and takes that node's label; so labels reach the ends of long chains in
    rounds that grow with the logarithm. Nodes without links take no part. Each round is
    a table in the shared folder, the last one of which stays; nothing is collected, and
    nothing is broadcast if there are more than BROADCAST_ROWS ends of links.
    """
    both = links.select(F.col("left").alias("node"), F.col("right").alias("other")).unionByName(links.select(F.col("right").alias("node"), F.col("left").alias("other")))
    both, drop_both = written(both.distinct())
    # Small tables go to few files, however many partitions the session's shuffles have.
    ends = both.count()
    files = ends // ROWS_A_FILE + 1
    held = shuffled if ends > BROADCAST_ROWS else lambda df: df
    own = nodes.select("node", F.struct(F.coalesce("least", F.lit(LAST)).alias("least"), F.col("node").alias("at")).alias("label"))
    linked, drop = written(own.join(held(both.select("node").distinct()), "node", "left_semi").coalesce(files))
    while True:
        heard = both.join(held(linked.select(F.col("node").alias("other"), F.col("label").alias("said"))), "other").groupBy("node").agg(F.min("said").alias("said"))
        known = linked.join(held(heard), "node")
        further = linked.select(F.col("node").alias("at"), F.col("label").alias("said"))
        told = known.select("node", "said").unionByName(known.select(F.col("label.at").alias("node"), "said")).unionByName(linked.select("node", F.col("label.at").alias("at")).join(held(further), "at").select("node", "said"))
        best = told.groupBy("node").agg(F.min("said").alias("said"))
        moved, drop_moved = written(linked.join(held(best), "node").select("node", F.col("label").alias("old"), F.least("label", "said").alias("label")).coalesce(files))
        drop()
        changed = moved.where(F.col("old") != F.col("label")).limit(1).count()
        linked, drop = moved.drop("old"), drop_moved
        if not changed:
            break
    drop_both()
    found = own.join(held(linked.select("node", F.col("label").alias("best"))), "node", "left").select("node", F.coalesce("best", "label")["least"].alias("least"), F.coalesce("best", "label")["at"].alias("root"))
    return found.withColumn("least", F.when(F.col("least") != LAST, F.col("least")))
