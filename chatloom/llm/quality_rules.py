"""Quality rules: documents are judged by their own rules and by how their host does.

Every document gets rule outcomes from its own words and lines. Failures are summed
by host, each host's rate is shrunk by a beta prior fitted to all hosts by the method
of moments, and the shrunk rates give each host a verdict for every rule, which goes
back to its documents: a host may be rejected as a whole, be trusted (then a lone
failure is forgiven), or neither (then a failure counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, free_name, let, read, SPACE_CLASS, words

#: Rules of the method over the base columns; each is a test that a document fails.
RULES = {
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "shouting": "100 * n_marks > 20 * n_words",
}
#: A host's shrunk rate from which all its documents go, and below which a failure is forgiven.
REJECT_RATE, TRUST_RATE = 0.75, 0.001


def _repeat_words(ws: Column) -> Column:
    """Words that stand in a window of three found at least twice; sorted hashes bring equal windows together."""

    def of(w: Column) -> Column:
        n = F.size(w)
        keyed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def twice(s: Column) -> Column:
            last = F.size(s) - 1
            same = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & (F.get(s, j)["h"] == F.get(s, j - 1)["h"])) | ((j < last) & (F.get(s, j)["h"] == F.get(s, j + 1)["h"])))
            starts = F.transform(same, lambda j: F.get(s, j)["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(n >= 4, let(F.sort_array(keyed), twice)).otherwise(0)

    return let(ws, of)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_marks; null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    per_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    per_word = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("again")))
    w, l = free_name(docs, "_w"), free_name(docs, "_l")  # noqa: E741
    return (
        docs.withColumns({w: per_word, l: per_line})
        .withColumns({
            "n_words": F.col(f"{w}.n"),
            "word_chars": F.length(F.regexp_replace(t, SPACE_CLASS, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": F.col(f"{l}.again"),
            "n_repeat_words": F.col(f"{w}.again"),
            "n_lines": F.col(f"{l}.n"),
            "n_marks": F.length(F.regexp_replace(t, "[^!]+", "")).cast("long"),
        })
        .drop(w, l)
    )


def host_verdicts(judged: DataFrame, host: str, rules: list[str]) -> DataFrame:
    """From boolean columns fail_<rule>: a row for each host with its shrunk rates (rate_<rule>, rate_any).

    The prior of a rule has the mean and variance of the hosts' rates, weighted by
    their documents; where hosts do not differ beyond chance, the prior is as strong
    as all documents together.
    """
    names = [*rules, "any"]
    by_host = judged.groupBy(host).agg(F.count("*").alias("n"), *[F.count_if(f"fail_{r}").alias(f"k_{r}") for r in names])
    parts = []
    for r in names:
        rate = F.col(f"k_{r}") / F.col("n")
        parts += [F.sum(f"k_{r}").alias(f"sum_{r}"), F.sum(F.col("n") * rate * rate).alias(f"square_{r}")]
    whole = by_host.agg(F.sum("n").alias("total"), F.count("*").alias("hosts"), *parts)
    # One row of sums; every host reads it.
    joined = by_host.crossJoin(F.broadcast(whole))
    rates = []
    for r in names:
        mean = F.col(f"sum_{r}") / F.col("total")
        spread = F.col(f"square_{r}") / F.col("total") - mean * mean
        chance = mean * (1 - mean) * F.col("hosts") / F.col("total")
        beyond = spread - chance
        strength = F.when(beyond > 1e-9, F.least(F.col("total").cast("double"), F.greatest(F.lit(1.0), mean * (1 - mean) / beyond - 1))).otherwise(F.col("total").cast("double"))
        rates.append(((F.col(f"k_{r}") + mean * strength) / (F.col("n") + strength)).alias(f"rate_{r}"))
    return joined.select(F.col(host).alias("_host"), F.col("n").alias("host_docs"), *rates)


def judge_quality(docs: DataFrame, host: str = "source", text: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """One row for each row of ``docs`` with the measures, base_failed, failed_rules, host_rate and kept.

    A document is kept when the base rules pass, its host is not rejected
    (rate_any < REJECT_RATE) and it fails no rule but those its host is trusted for
    (rate < TRUST_RATE). Null hosts form one host; null and empty texts fail the base.
    Measures are made once and kept in the checkpoint folder without texts.
    """
    key = [c for c in ("doc_id", host) if c in docs.columns]
    slim = measure(docs.select(*key, F.col(text).alias("_text")), "_text").drop("_text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    slim = slim.withColumn("base_failed", base).withColumns({f"fail_{r}": F.coalesce(F.expr(test), F.lit(False)) for r, test in rules.items()})
    slim = cut(slim.withColumn("fail_any", F.col("base_failed") | F.greatest(*[F.col(f"fail_{r}") for r in rules]) if len(rules) > 1 else F.col("base_failed") | F.col(f"fail_{[*rules][0]}")))
    hosts = bounded(host_verdicts(slim, host, [*rules]))
    back = slim.join(hosts, slim[host].eqNullSafe(hosts["_host"]), "left")
    counted = [F.when(F.col(f"fail_{r}") & (F.col(f"rate_{r}") >= TRUST_RATE), F.lit(r)) for r in rules]
    failed = F.array_compact(F.array(*counted))
    return back.withColumn("failed_rules", F.array_join(failed, ",")).withColumn("host_rate", F.col("rate_any")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rate_any") < REJECT_RATE) & (F.col("failed_rules") == "")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op3_sql() -> str:
    names = [*RULES, "any"]
    ks = ", ".join(f"count(*) filter (where fail_{r}) as k_{r}" for r in names)
    sums = ", ".join(f"sum(k_{r}) as sum_{r}, sum(n * (k_{r} / n) * (k_{r} / n)) as square_{r}" for r in names)

    def rate(r: str) -> str:
        mean = f"(sum_{r} / total)"
        beyond = f"(square_{r} / total - {mean} * {mean} - {mean} * (1 - {mean}) * hosts / total)"
        return f"(k_{r} + {mean} * (case when {beyond} > 1e-9 then least(total, greatest(1.0, {mean} * (1 - {mean}) / {beyond} - 1)) else total end)) / (n + (case when {beyond} > 1e-9 then least(total, greatest(1.0, {mean} * (1 - {mean}) / {beyond} - 1)) else total end)) as rate_{r}"

    fails = ", ".join(f"({test}) as fail_{r}" for r, test in RULES.items())
    counted = ", ".join(f"case when fail_{r} and rate_{r} >= {TRUST_RATE} then '{r}' end" for r in RULES)
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]"
    return rf"""
with d as (select row_number() over () as id, doc_id, source, coalesce(text, '') as t from documents),
w as (select id, regexp_extract_all(t, '{word}+') as ws from d),
grams as (
  select id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
  from (select id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
again as (select id, i from (select id, i, count(*) over (partition by id, g) as c from grams) where c > 1),
rep as (select id, count(distinct i + k) as r from again, range(3) as o(k) group by id),
lines as (
  select id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
  from (select id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '{word}') group by id),
m as (
  select d.id, doc_id, source, cast(len(ws) as bigint) as n_words,
         cast(length(regexp_replace(t, '{space}+', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
         cast(length(regexp_replace(t, '[^!]+', '', 'g')) as bigint) as n_marks,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(r, 0) as n_repeat_words
  from d join w using (id) left join rep using (id) left join lines using (id)),
f as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, {fails} from m),
g as (select *, base_failed or {' or '.join(f'fail_{r}' for r in RULES)} as fail_any from f),
h as (select source, cast(count(*) as double) as n, {ks} from g group by source),
a as (select cast(sum(n) as double) as total, count(*) as hosts, {sums} from h),
r as (select source, {', '.join(rate(r) for r in names)} from h, a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and rate_any < {REJECT_RATE} and concat_ws(',', {counted}) = '' as kept,
       concat_ws(',', {counted}) as failed_rules
from g join r on g.source is not distinct from r.source"""
