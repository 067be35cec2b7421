"""Mixing sources to target weights over a tree of domains, languages and sources.

The token budget flows down the tree by weight. A node can take no more than its
leaves hold times the number of epochs; what it cannot take goes to its siblings,
and only when all of them are full to the siblings of its parent (the capacity of an
inner node is the sum of its leaves', so filling level by level does just that). A
leaf then takes whole epochs and, of one more, the prefix that fits in the order of a
seeded hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, join_null_safe, numbered_columns, read, words

SEED, MAX_EPOCHS, SHARE = 17, 4, 0.5
#: Weights of the tree's nodes by level; a node that is not named has weight 1.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
LEVELS = ("domain", "lang", "source")
#: A hash has 60 bits; each refinement looks at 12 more of them.
BITS, STEP = 60, 12


def domain_of(source: Column) -> Column:
    """Sources belong to one of four domains by the number that ends their name; others to ``other``."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))


def order_hash(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A 60-bit number that orders documents in one epoch."""
    text = F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    given = weights.get(level, {})
    out = F.lit(1)
    for name, w in given.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("double")


def allocate(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From leaves (domain, lang, source, tokens): adds ``target``, the tokens that each leaf shall give.

    Works on one row for each leaf. Leaves under a node of weight 0 and those without
    tokens get 0 and are no capacity of the nodes above. What rounding down leaves of a
    grant goes, a token each, to the open siblings of the least names, as far as they
    have room.
    """
    parents: list[str] = []
    live = (F.col("tokens") > 0) & (F.least(*[_weight(level, weights) for level in LEVELS]) > 0)
    plan = leaves.where(live).withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    given = plan.agg(F.coalesce(F.sum("cap"), F.lit(0.0)).alias("all")).select(F.least(F.col("all"), budget).alias("grant"))
    grants = given
    for level in LEVELS:
        nodes = plan.groupBy(*parents, level).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        nodes = join_null_safe(nodes, grants, parents) if parents else nodes.crossJoin(F.broadcast(grants))
        group = Window.partitionBy(*(parents or [F.lit(0)]))
        ordered = group.orderBy(F.col("cap") / F.col("w"), F.col(level).asc_nulls_first())
        before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest_weight = F.sum("w").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", F.col("cap") * rest_weight <= (F.col("grant") - before) * F.col("w"))
        taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(group)
        open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(group)
        share = F.floor(F.col("w") * (F.col("grant") - taken) / open_weight).cast("double")
        nodes = nodes.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(share)).withColumn("room", ~F.col("full") & (F.col("share") < F.col("cap")))
        left = F.col("grant") - F.sum("share").over(group)
        nth = F.sum(F.col("room").cast("int")).over(group.orderBy(F.col(level).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        nodes = nodes.withColumns({"left_over": left, "nth": nth})
        parents = [*parents, level]
        # Cut, so that each level is a plan of its own: the driver holds one level's windows at a time, and no level is computed again for the next.
        grants = cut(nodes.select(*parents, (F.col("share") + F.when(F.col("room") & (F.col("nth") <= F.col("left_over")), 1.0).otherwise(0.0)).alias("grant")))
    joined = join_null_safe(leaves, grants, parents, "left")
    return joined.withColumn("target", F.coalesce(F.col("grant"), F.lit(0.0)).cast("long")).drop("grant")


def _boundary(rows: DataFrame, leaf: list[str], shift: int) -> DataFrame:
    """Of rows (leaf, rest, base, h, tokens): the bucket of the next bits in which the running sum passes ``rest``."""
    sums = rows.groupBy(*leaf, "rest", "base", F.expr(f"shiftright(h, {shift})").alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    run = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("bucket"))
    found = sums.withColumn("upto", F.col("base") + run).where(F.col("upto") > F.col("rest"))
    return found.groupBy(*leaf, "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("base"))).alias("b")).select(*leaf, "rest", "b.bucket", "b.base")


def mix(docs: DataFrame, share: float = SHARE, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", tokens: Column | None = None, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """Rows of ``docs`` once for each epoch that takes them, with ``mix_epoch`` (from 0) and ``mix_tokens``.

    The budget is ``share`` of all tokens (words, unless ``tokens`` is given). Null
    languages and sources are nodes of their own; null texts have no tokens; rows with
    equal keys in one leaf, null ones too, are taken or left together. ``domain`` tells a
    source's domain. Columns mix_epoch and mix_tokens of the input are replaced. The cut of a leaf's last epoch
    is found by sums over ever finer ranges of the hash, so no task orders a leaf.
    """
    columns = docs.columns
    docs, names = numbered_columns(docs if tokens is None else docs.withColumn("mix_tokens", tokens.cast("long")))
    text, key, lang, source = (names[c] for c in (text, key, lang, source))
    count = F.size(words(F.col(text))).cast("long") if tokens is None else F.col(names["mix_tokens"])
    tree = {"domain": domain(F.col(source)), "lang": F.col(lang), "source": F.col(source)}
    leaf = [*tree]
    slim = cut(docs.select(F.col(key).alias("key"), *[c.alias(n) for n, c in tree.items()], count.alias("tokens")))
    leaves = cut(slim.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    plan = cut(allocate(leaves, F.lit(float(int(total * share))), weights, max_epochs).withColumnRenamed("tokens", "leaf_tokens").where("target > 0"))
    plan = plan.withColumn("whole", F.expr("target div leaf_tokens")).withColumn("rest", F.expr("target % leaf_tokens"))
    plan = bounded(plan)
    # Rows of equal keys in a leaf are taken together, so they are one row from here on.
    keyed = join_null_safe(slim, plan, leaf).groupBy(*leaf, "key", "whole", "rest").agg(F.sum("tokens").alias("tokens"))
    rows = keyed.withColumn("h", order_hash(F.col("key"), F.col("whole"), seed)).withColumn("base", F.lit(0).cast("long"))
    for shift in (BITS - STEP, BITS - 2 * STEP):
        edge = bounded(cut(_boundary(rows, leaf, shift))).withColumnsRenamed({"base": "e_base", "rest": "e_rest"})
        rows = join_null_safe(rows.withColumn("bucket", F.expr(f"shiftright(h, {shift})")), edge, [*leaf, "bucket"]).select(*leaf, "key", "tokens", "rest", F.col("e_base").alias("base"), "h")
    run = F.col("base") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("h", "key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = rows.withColumn("upto", run).groupBy(*leaf).agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("h", "key"))).alias("last"), F.min(F.expr(f"shiftleft(shiftright(h, {shift}), {shift})")).alias("edge")
    )
    ends = bounded(cut(join_null_safe(plan, last, leaf, "left").select(*leaf, "whole", "last", "edge")))
    h = order_hash(F.col(key), F.col("whole"), seed)
    upto = F.struct(h.alias("h"), F.col(key).alias("key")) <= F.col("last")
    taken = F.coalesce((h < F.col("edge")) | F.coalesce(upto, F.lit(False)), F.lit(False))
    out = docs.join(ends, on=[c.eqNullSafe(F.col(n)) for n, c in tree.items()]).withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0)).where("copies > 0")
    extra = {"mix_tokens": count, "mix_epoch": F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))}
    return out.select(*[F.col(names[c]).alias(c) for c in columns if c not in extra], *[c.alias(n) for n, c in extra.items()])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", F.col("mix_epoch").cast("long").alias("epoch"), F.col("mix_tokens").alias("n_tokens"))


def mix_sql(docs: str = "documents", share: float = SHARE, weights: dict[str, dict[str, int]] = WEIGHTS) -> str:
    def weight(level: str) -> str:
        whens = " ".join(f"when {level} = '{n}' then {w}" for n, w in weights.get(level, {}).items())
        return f"cast(case {whens} else 1 end as double)" if whens else "1.0::double"

    ctes, parents, grants = [], [], "root"
    for level in LEVELS:
        on = " and ".join(f"n.{p} is not distinct from g.{p}" for p in parents) or "true"
        cols = ", ".join([*parents, level])
        part = "partition by " + ", ".join(parents) if parents else ""
        ctes.append(f"""
n_{level} as (select {cols}, sum(cap) as cap, {weight(level)} as w from leaf where live group by {cols}),
s_{level} as (
  select {', '.join(f'n.{c}' for c in [*parents, level])}, cap, w, "grant",
         cap * sum(w) over (o rows between current row and unbounded following) <= ("grant" - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) * w as is_full
  from n_{level} n join {grants} g on {on}
  window o as ({part.replace('by ', 'by n.').replace(', ', ', n.')} order by cap / w, n.{level} nulls first)),
h_{level} as (
  select *, case when is_full then cap else floor(w * ("grant" - sum(case when is_full then cap else 0 end) over ({part})) / sum(case when is_full then 0 else w end) over ({part})) end as share
  from s_{level}),
r_{level} as (
  select *, not is_full and share < cap as room, "grant" - sum(share) over ({part}) as left_over from h_{level}),
g_{level} as (
  select {cols}, share + case when room and sum(cast(room as int)) over ({part} order by {level} nulls first rows unbounded preceding) <= left_over then 1 else 0 end as "grant"
  from r_{level})""")
        parents, grants = [*parents, level], f"g_{level}"
    same = " and ".join(f"{{a}}.{p} is not distinct from {{b}}.{p}" for p in parents)
    return f"""
with d as (
  select doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens,
         case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'other'
              else 'd' || (cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as integer) % 4) end as domain
  from {docs}),
leaf as (
  select domain, lang, source, sum(n_tokens) as tokens, cast(sum(n_tokens) * {MAX_EPOCHS} as double) as cap,
         sum(n_tokens) > 0 and least({', '.join(weight(level) for level in LEVELS)}) > 0 as live from d group by domain, lang, source),
root as (select least(coalesce(sum(cap) filter (where live), 0), floor(sum(tokens) * {share})) as "grant" from leaf),{','.join(ctes)},
plan as (
  select l.*, cast(g."grant" as bigint) // tokens as whole, cast(g."grant" as bigint) % tokens as rest
  from leaf l join g_source g on {same.format(a='l', b='g')} where g."grant" >= 1),
k as (
  select d.*, whole, rest,
         cast('0x' || substr(md5('{SEED}-' || whole || '-' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from d join plan p on {same.format(a='d', b='p')}),
r as (select *, sum(n_tokens) over (partition by domain, lang, source order by h, doc_id) as upto from k),
c as (select *, whole + case when upto <= rest then 1 else 0 end as copies from r)
select doc_id, domain, lang, source, cast(unnest(range(cast(copies as bigint))) as bigint) as epoch, cast(n_tokens as bigint) as n_tokens from c"""
