"""Centroid clustering by filtering over kd-trees.

Vectors are whole numbers. Every task builds kd-trees over blocks of its vectors, each
node with the number, the sum and the box of its vectors, and writes them to the shared
folder once. A round passes all centroids down each tree: at a node a centroid goes
that is farther from every place of the box than another one; where a single one is
left it takes the whole node, and a leaf compares its vectors with those that are left.
Only sums by centroid leave a task. Numbers are whole all the way, so the result does
not depend on how vectors are dealt.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, tidy, written

CENTROIDS, ROUNDS, SEED, SCALE = 40, 5, 2, 256
#: Vectors of one tree and, at most, different ones in a leaf.
BLOCK, LEAF = 4_096, 16
#: Components beyond count as this, so that squared distances fit in 64 bits.
BOUND = 1 << 27
#: Nodes looked at together.
FRONT = 512


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, within BOUND."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int"))


def usable(vector: Column, size: int | None) -> Column:
    """Whether a vector has ``size`` components, none of them null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def grown(ids: np.ndarray, present: np.ndarray, points: np.ndarray) -> bytes:
    """A kd-tree over ``points``: arrays of different points in tree order, the rows that have each, and nodes with box, number and sum.

    Nodes are split at the middle of the widest side; nodes of LEAF points or fewer are
    leaves. Equal points are one point of more weight, so they never deepen a tree.
    """
    unique, which, weight = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    which = which.reshape(-1)
    order, nodes = np.arange(len(unique)), []
    todo = [(0, len(unique), -1)]
    while todo:
        start, stop, parent = todo.pop()
        held = unique[order[start:stop]]
        low, high = held.min(0), held.max(0)
        if parent >= 0:
            nodes[parent][4].append(len(nodes))
        nodes.append((start, stop, low, high, []))
        if stop - start > LEAF:
            middle, axis = (start + stop) // 2, int((high - low).argmax())
            order[start:stop] = order[start:stop][np.argpartition(held[:, axis], middle - start, kind="introselect")]
            todo += [(start, middle, len(nodes) - 1), (middle, stop, len(nodes) - 1)]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    weight = weight[order]
    summed = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(unique[order] * weight[:, None], 0)])
    counted = np.r_[0, np.cumsum(weight)]
    start, stop = (np.array([n[i] for n in nodes]) for i in (0, 1))
    kind = np.int16 if np.abs(unique).max() < 1 << 15 else np.int32
    arrays = {
        "ids": ids, "present": present, "place": place[which].astype(np.int32), "points": unique[order].astype(kind), "weight": weight, "start": start.astype(np.int32), "stop": stop.astype(np.int32),
        "low": np.array([n[2] for n in nodes], kind), "high": np.array([n[3] for n in nodes], kind), "sums": summed[stop] - summed[start], "counts": counted[stop] - counted[start],
        "children": np.array([n[4] or (-1, -1) for n in nodes], np.int32),
    }
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def filtered(tree: dict[str, np.ndarray], centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """Passes ``centroids`` down a tree: (nodes, None, centroid of each) for nodes taken whole, (points, [], centroid of each) for points of leaves.

    Of centroids at the same distance the least number takes a point: a centroid goes
    only where it is farther than another one at every place of the box. All products
    are whole and below 2^53 where floats serve.
    """
    small = max(np.abs(tree["low"].astype(np.int64)).max(), np.abs(tree["high"].astype(np.int64)).max(), np.abs(centroids).max()) <= 1 << 21
    kind = np.float64 if small else np.int64
    c, norms = centroids.astype(kind), (centroids.astype(kind) ** 2).sum(1)
    k, leaf = len(c), tree["children"][:, 0] < 0
    todo = [(np.zeros(1, np.int64), np.ones((1, k), bool))]
    while todo:
        nodes, may = todo.pop()
        low, high = tree["low"][nodes].astype(kind), tree["high"][nodes].astype(kind)
        # Of those that may be nearest the one nearest to the middle of the box sets the measure.
        away = np.where(may, norms.astype(float) - (low + high).astype(float) @ c.T.astype(float), np.inf)
        best = away.argmin(1)
        for z in np.unique(best):
            rows = best == z
            u = c - c[z]
            # At the corner of the box that favours each other centroid most, is it still farther away?
            gain = high[rows] @ np.maximum(u, 0).T + low[rows] @ np.minimum(u, 0).T
            may[rows] &= norms - norms[z] - 2 * gain <= 0
        alone = may.sum(1) == 1
        if alone.any():
            yield nodes[alone], None, best[alone]
        ends = ~alone & leaf[nodes]
        if ends.any():
            at = np.concatenate([np.arange(tree["start"][n], tree["stop"][n]) for n in nodes[ends]])
            mask = np.repeat(may[ends], tree["stop"][nodes[ends]] - tree["start"][nodes[ends]], axis=0)
            p = tree["points"][at].astype(kind)
            gaps = norms - 2 * (p @ c.T)
            gaps[~mask] = np.inf if small else np.iinfo(np.int64).max
            yield at, at, gaps.argmin(1)
        inner = ~alone & ~leaf[nodes]
        if inner.any():
            below, kept = tree["children"][nodes[inner]].reshape(-1).astype(np.int64), np.repeat(may[inner], 2, axis=0)
            todo += [(below[i : i + FRONT], kept[i : i + FRONT]) for i in range(0, len(below), FRONT)]


def opened(tree: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(tree)) as arrays:
        return {n: arrays[n] for n in arrays.files}


def assigned(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each point of a tree."""
    cluster = np.empty(len(tree["points"]), np.int64)
    for at, points, own in filtered(tree, centroids):
        if points is None:
            for n, z in zip(at, own):
                cluster[tree["start"][n] : tree["stop"][n]] = z
        else:
            cluster[points] = own
    gaps = tree["points"].astype(np.int64) - centroids[cluster]
    return cluster, np.einsum("ij,ij->i", gaps, gaps)


def plant(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (key, components) as rows (tree), each over ``block`` vectors of one task."""

    @tidy
    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, present, points, held = [], [], [], 0

        def made() -> pd.DataFrame:
            return pd.DataFrame({"tree": [grown(np.concatenate(ids), np.concatenate(present), np.concatenate(points))]})

        for batch in batches:
            for begin in range(0, len(batch), block):
                part = batch.iloc[begin : begin + block]
                known = part["key"].notna().to_numpy()
                ids.append(part["key"].fillna(0).to_numpy(np.int64))
                present.append(known)
                points.append(np.array(part["components"].tolist(), np.int64))
                held += len(part)
                if held >= block:
                    yield made()
                    ids, present, points, held = [], [], [], 0
        if held:
            yield made()

    return vectors.select("key", "components").mapInPandas(trees, "tree binary")


def totals(trees: DataFrame, centroids: np.ndarray, inertia: bool = False) -> dict[int, list[int]]:
    """By centroid: the sums of its vectors' components, their number and, with ``inertia``, their squared distances in sum.

    At most one row for each centroid and component comes to the driver.
    """
    width = centroids.shape[1]

    @tidy
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [[0] * (width + 2) for _ in centroids]
        for batch in batches:
            for raw in batch["tree"]:
                tree = opened(raw)
                part = np.zeros((len(centroids), width + 1), np.int64)
                if inertia:
                    cluster, gaps = assigned(tree, centroids)
                    for z in np.unique(cluster):
                        own = cluster == z
                        sums[z][width + 1] += sum((gaps[own].astype(object) * tree["weight"][own]).tolist())
                        part[z, width] = tree["weight"][own].sum()
                else:
                    for at, points, own in filtered(tree, centroids):
                        if points is None:
                            np.add.at(part, own, np.column_stack([tree["sums"][at], tree["counts"][at]]))
                        else:
                            weight = tree["weight"][points]
                            np.add.at(part, own, np.column_stack([tree["points"][points] * weight[:, None], weight]))
                for z in np.flatnonzero(part[:, width]).tolist():
                    sums[z][: width + 1] = [a + b for a, b in zip(sums[z], part[z].tolist())]
        rows = [(z, i, Decimal(x)) for z, own in enumerate(sums) if own[width] for i, x in enumerate(own)]
        yield pd.DataFrame(rows, columns=["cluster", "part", "total"])

    got = trees.mapInPandas(summed, "cluster int, part int, total decimal(38,0)").groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()
    out: dict[int, list[int]] = {}
    for r in got:
        out.setdefault(r["cluster"], [0] * (width + 2))[r["part"]] = int(r["total"])
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:key``, in that order; k rows come to the driver."""
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256))
    return np.array([r["components"] for r in named.orderBy("h", "components").limit(k).collect()], np.int64)


def moved(centroids: np.ndarray, sums: dict[int, list[int]]) -> np.ndarray:
    """Each centroid with vectors at the exact floor of their mean; others stay."""
    out, width = centroids.copy(), centroids.shape[1]
    for z, own in sums.items():
        out[z] = [x // own[width] for x in own[:width]]
    return out


def cluster(vectors: DataFrame, size: int = 64, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, vector: str = "embedding", key: str = "vec_id", block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector, and the centroids.

    Vectors that are null, of another length than ``size``, or with a component that is
    null or not finite have no row. Rows of equal keys are vectors of their own, as are
    those with a null key (first centroids: hash of an empty id); equal hashes go by
    components. With fewer than ``k`` vectors there are as many centroids; without any
    the result is empty. Equal vectors take each a row, but one point of a tree. Of
    centroids at the same distance the smaller number counts. Components that exceed
    2^19 times the scale's 256ths count as that, and an inertia of over 64 bits is null.
    Other columns are not carried; names of the input can't clash with inner ones.
    """
    small_batches(vectors.sparkSession)
    own = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).where(usable(F.col("v"), size)).select("key", whole_components(F.col("v")).alias("components"))
    schema = "key long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(own, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key), centroids
    # The table stays until the application ends: the result reads it.
    trees, _ = written(plant(own, block))
    for _ in range(rounds):
        centroids = moved(centroids, totals(trees, centroids))
    within = {z: s[-1] for z, s in totals(trees, centroids, inertia=True).items()}
    fits = [x if x < 1 << 63 else None for x in (within.get(z, 0) for z in range(len(centroids)))]
    total = sum(within.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    @tidy
    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, names = pd.Series(fits, dtype="Int64"), np.array(hashes, object)
        for batch in batches:
            for raw in batch["tree"]:
                tree = opened(raw)
                z, gaps = (x[tree["place"]] for x in assigned(tree, centroids))
                yield pd.DataFrame({
                    "key": pd.arrays.IntegerArray(tree["ids"], ~tree["present"]), "cluster": z.astype(np.int32), "distance": gaps, "cluster_inertia": sums.take(z).array,
                    "inertia": pd.array([total if total < 1 << 63 else None] * len(z), "Int64"), "centroid_sha256": names[z],
                })

    return trees.mapInPandas(told, schema).withColumnRenamed("key", key), centroids


def op11_kd_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))[0]


def op11_sql() -> str:
    """The same by comparing every vector with every centroid."""
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
d{r} as (
  select v.nth, c.z, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) as d from v cross join c{r} c),
a{r} as (select nth, min(d) as d, cast(arg_min(z, (d, z)) as integer) as z from d{r} group by nth)""")
        if r < ROUNDS:
            rounds.append(f"""
s{r} as (select a.z, i, sum(v.x[i]) as total, count(*) as n from a{r} a join v using (nth) cross join range(1, 65) t(i) group by a.z, i),
m{r} as (select z, list(cast(case when total % n < 0 then total // n - 1 else total // n end as bigint) order by i) as x from s{r} group by z),
c{r + 1} as (select c.z, coalesce(m.x, c.x) as x from c{r} c left join m{r} m using (z))""")
    last = ROUNDS
    return f"""
with v as materialized (
  select row_number() over (order by vec_id) as nth, vec_id, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(cast(e as double)))) = 64),
c0 as (select cast(row_number() over (order by h) - 1 as integer) as z, x from (select x, sha256('{SEED}:' || vec_id) as h from v order by h limit {CENTROIDS})),
{','.join(x.strip() for x in rounds)}
select vec_id, z as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by z) as bigint) as cluster_inertia,
       cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{last} join v using (nth) join c{last} c using (z)"""
