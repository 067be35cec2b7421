"""Merkle dataset manifest with parent-preimage paths.

Leaves of a group stand in the order of their key and are joined two by two into parents
until one node is left, the group's subroot; the subroots are joined likewise into the
root. For each parent its preimage is stored, the hex digests of its children one
after the other. A leaf joins the preimages of its ancestors: what is left of one
without the leaf's own 64 characters are the siblings of the proof, and one with other
64 characters in that slot is what the fold hashes next.

Places in a group come from a range sort and counts by task, and BITS levels at a time
are built within blocks of 2^BITS neighbours, so no group is ever in one task and a
level is no shuffle of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, join_null_safe, read, written

#: Levels of a tier, and blocks up to which their paths may be broadcast.
BITS, PATH_ROWS = 10, 2_000
DIGEST = 64
#: The tampering of the query: which documents.
EVERY = 7


def field(value: Column) -> Column:
    """A value as the number of its UTF-8 bytes, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def placed(rows: DataFrame) -> DataFrame:
    """From rows (tree, key, node, extra): adds place (from 0, by key and node within a tree) and n, the tree's rows.

    Rows alike in tree, key and node come in any order. The rows are sorted by ranges of
    all these, and by a number for those alike, so neither a tree nor a key is one task.
    """
    numbered, drop_numbered = written(rows.withColumn("nth", F.monotonically_increasing_id()))
    order = ["tree", "key", "node", "nth"]
    ranged = numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("nth")
    ranged, _ = written(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    drop_numbered()
    # A row for each task and tree that it has rows of.
    parts = ranged.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    starts = bounded(parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")))
    return join_null_safe(ranged, starts, ["tree", "part"]).select("tree", "n", "key", "node", "extra", (F.col("at") + F.col("shift")).alias("place"))


def stacked(nodes: DataFrame) -> list[DataFrame]:
    """From nodes (tree, n, place, key, node, extra) tiers of rows (tree, n, block, items, levels, top), lowest first.

    ``items`` are the nodes of a block of 2^BITS places, ``levels`` the preimages of
    their ancestors, level by level, and ``top`` the digest of the highest; the last
    tier has one row for each tree, whose top is the tree's root.
    """
    preimages = "transform(sequence(0, (size(a.nodes) - 1) div 2), j -> concat(a.nodes[2 * j], coalesce(get(a.nodes, 2 * j + 1), '')))"
    tiers: list[DataFrame] = []
    while True:
        left = F.greatest(F.lit(0), F.least(F.lit(BITS), F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0) - BITS * len(tiers)))
        blocks = nodes.groupBy("tree", "n", F.shiftright("place", BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "key", "node", "extra"))).alias("items"))
        built = F.expr(f"""
            aggregate(slice(sequence(1, {BITS}), 1, height), named_struct('nodes', transform(items, x -> x.node), 'levels', cast(array() as array<array<string>>)),
                (a, i) -> named_struct('nodes', transform({preimages}, x -> sha2(x, 256)), 'levels', concat(a.levels, array({preimages}))))""")
        tier, _ = written(blocks.withColumn("height", left).withColumn("a", built).select("tree", "n", "block", "items", "a.levels", F.col("a.nodes")[0].alias("top")))
        tiers.append(tier)
        most = tier.agg(F.max("n").alias("n")).first()["n"]
        if not most or (most - 1).bit_length() <= BITS * len(tiers):
            return tiers
        nodes = tier.select("tree", "n", F.col("block").alias("place"), F.lit(None).cast("long").alias("key"), F.col("top").alias("node"), F.lit(None).cast("string").alias("extra"))


def _stepped(tier: DataFrame, above: DataFrame) -> DataFrame:
    """Each item of a tier with its path: (preimage, slot) of its ancestors here and, from ``above`` (tree, block, path), further up."""
    joined = join_null_safe(tier, bounded(above, PATH_ROWS), ["tree", "block"])
    steps = "transform(levels, (level, l) -> named_struct('preimage', level[shiftright(p, l + 1)], 'slot', shiftright(p, l) & 1))"
    return joined.select("tree", F.expr(f"inline(transform(items, (x, p) -> named_struct('place', x.place, 'key', x.key, 'node', x.node, 'extra', x.extra, 'path', concat({steps}, path))))"))


def paths(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Rows (tree, place, key, node, extra, path) for the nodes below all ``tiers``; ``above``: tree, path for each tree."""
    above = above.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for tier in reversed(tiers[1:]):
        above = _stepped(tier, above).select("tree", F.col("place").alias("block"), "path")
    return _stepped(tiers[0], above)


def siblings(path: Column) -> Column:
    """What each preimage of a path has besides the node's own slot, bottom up."""
    return F.transform(path, lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * DIGEST), F.substring(s["preimage"], s["slot"] * DIGEST + DIGEST + 1, F.lit(DIGEST))))


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from ``leaf`` in its slot of the lowest preimage, its digest in the next one's, and so on."""
    return F.aggregate(path, leaf, lambda own, s: digest(F.substring(s["preimage"], F.lit(1), s["slot"] * DIGEST), own, F.substring(s["preimage"], s["slot"] * DIGEST + DIGEST + 1, F.lit(DIGEST))))


@dataclass
class Manifest:
    """Trees of groups, the tree over their subroots, and its root (None without leaves)."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def subroots(self) -> DataFrame:
        return self.tiers[-1].select("tree", F.col("top").alias("subroot"))

    def preimages(self) -> DataFrame:
        """The stored parents: tree (null for the tree over subroots, with ``over_groups``), tier, block, levels."""
        rows = [t.select("tree", F.lit(over).alias("over_groups"), F.lit(i).alias("tier"), "block", "levels") for over, tiers in ((False, self.tiers), (True, self.top)) for i, t in enumerate(tiers)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def proofs(self) -> DataFrame:
        """(tree, place, key, leaf, extra, subroot, path) of each leaf; the path leads through the subroot to the root."""
        tops = paths(self.top, self.top[-1].select("tree", F.expr("cast(array() as array<struct<preimage:string,slot:int>>)").alias("path")))
        # The nodes below the upper tree are subroots; their groups stand in extra, null for the group of nulls.
        above = join_null_safe(self.subroots(), tops.select(F.col("extra").alias("tree"), "path"), ["tree"])
        leaves = paths(self.tiers, above.select("tree", "path"))
        return join_null_safe(leaves, bounded(self.subroots(), PATH_ROWS), ["tree"]).withColumnRenamed("node", "leaf")


def manifest(leaves: DataFrame) -> Manifest:
    """From leaves (tree, key, node, extra: group, integer key, digest and a text that goes along).

    Leaves of a group ascend by key, null first, then by digest; groups ascend by name,
    null first. Rows that repeat are leaves of their own. The group's name and the key may
    be null. The tables are in the shared folder until the application ends.
    """
    tiers = stacked(placed(leaves.select(F.col("tree").cast("string"), F.col("key").cast("long"), "node", F.col("extra").cast("string"))))
    tops = tiers[-1].select("tree", "top")
    # Groups are ranked by name: null first, then by bytes.
    ranked = placed(tops.select(F.when(F.col("tree").isNull(), "").otherwise(F.concat(F.lit("="), "tree")).alias("name"), "tree", "top").select(F.lit(None).cast("string").alias("tree"), F.lit(0).cast("long").alias("key"), F.struct("name", "top").alias("node"), F.col("tree").alias("extra")))
    top = stacked(ranked.withColumn("node", F.col("node.top")))
    last = top[-1].select("top").first()
    return Manifest(tiers, top, last["top"] if last else None)


def document_leaf(n_chars: Column) -> Column:
    return digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))])


def document_manifest(docs: DataFrame) -> Manifest:
    """Manifest of documents by language; ``extra`` is the leaf after tampering, where there is any.

    Null values are dashes, so they differ from empty ones; null texts, empty tables and
    repeated rows have leaves like others. Tampering adds 1 to n_chars (a null stays) of
    documents with an id whose crc32 is divisible by EVERY. Only the five columns are
    read, so others may have any name. Texts are hashed where they are read and not shuffled.
    """
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    own = docs.select("doc_id", "source", "lang", "n_chars", "text")
    return manifest(own.select(
        F.col("lang").alias("tree"), F.col("doc_id").alias("key"), document_leaf(F.col("n_chars")).alias("node"),
        F.when(changed, document_leaf(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("extra"),
    ))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = document_manifest(read(spark, sf_dir, "documents"))
    rows = made.proofs().select("key", "leaf", "subroot", "path", folded(F.col("path"), F.coalesce("extra", "leaf")).alias("folded_root"))
    root = F.lit(made.root).cast("string")
    return rows.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(F.array_join(siblings(F.col("path")), ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


def op12_sql() -> str:
    """The same level by level: nodes of all levels, siblings by place, folds by recursion."""

    def field_sql(value: str) -> str:
        return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"

    def leaf(n_chars: str) -> str:
        return f"sha256({' || '.join(field_sql(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"

    def levels(name: str, base: str, tree: str) -> str:
        return f"""
{name} as (
  select {tree}, 0 as level, place, h, n from {base}
  union all
  select {tree}, level + 1, place // 2, sha256(string_agg(h, '' order by place)), (any_value(n) + 1) // 2 from {name} where n > 1 group by {tree}, level, place // 2)"""

    step = "xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)"
    crc = f"xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda s: cast(ascii(s) as bigint)), lambda a, b: list_reduce(range(8), lambda c, i: {step}, xor(a, b)), 4294967295::bigint), 4294967295)"
    return f"""
with recursive d as (
  select row_number() over () as r, doc_id, lang, {leaf('n_chars')} as leaf,
         case when doc_id is not null and {crc} % {EVERY} = 0 then {leaf('(cast(n_chars as hugeint) + 1)')} else {leaf('n_chars')} end as given
  from documents),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from d),
base as (select lang, place, leaf as h, n from p),{levels('nodes', 'base', 'lang')},
subs as (select lang, h, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from nodes where n = 1),
roots as (select 0 as t, place, h, n from subs),{levels('upper', 'roots', 't')},
walk as (
  select r, lang, 0 as level, place, n, given as h, '' as proof from p
  union all
  select r, w.lang, w.level + 1, w.place // 2, (w.n + 1) // 2,
         sha256(case when s.h is null then w.h when w.place % 2 = 0 then w.h || s.h else s.h || w.h end), w.proof || coalesce(s.h, '')
  from walk w left join nodes s on s.lang is not distinct from w.lang and s.level = w.level and s.place = xor(w.place, 1) where w.n > 1),
climb as (
  select r, 0 as level, s.place, s.n, w.h, w.proof from walk w join subs s on s.lang is not distinct from w.lang where w.n = 1
  union all
  select r, w.level + 1, w.place // 2, (w.n + 1) // 2,
         sha256(case when s.h is null then w.h when w.place % 2 = 0 then w.h || s.h else s.h || w.h end), w.proof || coalesce(s.h, '')
  from climb w left join upper s on s.level = w.level and s.place = xor(w.place, 1) where w.n > 1)
select d.doc_id, d.leaf, subs.h as subroot, u.h as root, sha256(c.proof) as proof_sha256, c.h as folded_root, c.h = u.h as verified
from d join climb c on c.r = d.r and c.n = 1 join subs on subs.lang is not distinct from d.lang cross join (select h from upper where n = 1) u"""
