"""URL filters: pattern rules indexed by their rarest literal token.

A rule is ``||host/path`` text: it fits that host and all its subdomains when the
path starts with the rule's. ``*`` stands for any characters and ``^`` for one
character that is no letter or digit (or the end). Whole tokens (runs of a-z, A-Z
and 0-9 with a separator on both sides) are literals that a matching URL must have,
so a rule is stored under the one of them that is rarest over all URLs. Each URL
looks its tokens up in that index and runs only the regular expressions found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, read


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str
    #: Base rules are named in the result and go before the others.
    base: bool = False

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    @property
    def regex(self) -> str:
        body = "".join({"*": ".*", "^": "(?:[^a-zA-Z0-9]|$)"}.get(c, re.escape(c) if not c.isalnum() else c) for c in self.name)
        return (r"(?s)^(?:[^/]*\.)?" if self.pattern.startswith("||") else "(?s)") + body

    @property
    def tokens(self) -> list[str]:
        """Runs that no wildcard and no open end can lengthen."""
        text = self.name
        open_start = not self.pattern.startswith("||")
        found = []
        for m in re.finditer(r"[a-zA-Z0-9]+", text):
            left = text[m.start() - 1] if m.start() else ("*" if open_start else "/")
            right = text[m.end()] if m.end() < len(text) else "*"
            if "*" not in (left, right):
                found.append(m[0])
        return found


BASE_RULES = [
    Rule("allow", "||org/", True),
    Rule("block", "||example.org/es/", True),
    Rule("block", "||example.org/en/1", True),
    Rule("allow", "||com/fr/", True),
    Rule("block", "||com/de/", True),
]

#: The method's own rules: hosts and paths of advertising, gambling, adult and spam sites.
PATTERN_RULES = [
    Rule("block", p)
    for p in (
        "||spam-farm.", "||casino-win.", "||adult-x.", "||cheap-pills.", "||free-bets.", "||ads-track.",
        "-casino.", ".casino.", "||casino.", "||poker.", "-poker.", "||betting.", "-bets.", "||slots.",
        "||porn.", ".xxx/", "||xxx.", "-adult.", "||adult.", "||escort.", "||viagra.", "-pills.", "||pills.",
        "||doubleclick.", "||adserver.", "||ads.", ".ads.", "||tracking.", "||tracker.", "-track.", "||banner.",
        "/ads/", "/adserver/", "/banner/", "/casino/", "/porn/", "/viagra/", "/popunder/", "/wp-spam/", "/phishing/",
    )
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or none: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[Rule], counts: dict[str, int]) -> DataFrame:
    """Rules under their rarest token; a rule without a whole token goes under '' and meets every URL."""

    def row(n: int, r: Rule) -> Column:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        return F.struct(F.lit(token).alias("rule_token"), F.lit(r.base).alias("base"), F.lit(len(r.name)).alias("size"), F.lit(-n).alias("nth"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"))

    return spark.range(1).select(F.inline(F.array(*[row(n, r) for n, r in enumerate(rules)])))


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """Returns one row for each row of ``pages``: key, host, path, rule, verdict, n_candidates, n_matches.

    The longest base rule that fits decides and is named in ``rule``; else any
    blocking pattern rule blocks; else ``default``. Null urls and urls without
    ``://`` have an empty host and path and get ``default``; repeated rows stay
    repeated; other columns are not read. Of equally long base rules the first decides.
    """
    spark = pages.sparkSession
    rules = BASE_RULES + PATTERN_RULES if rules is None else rules
    parts = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    tokens = F.array_remove(F.split(F.concat("host", "path"), "[^a-zA-Z0-9]+"), "")
    literal = sorted({t for r in rules for t in r.tokens})
    # Bounded: at most one row for each token of the rules.
    seen = parts.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, literal)))).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}
    table = bounded(rule_table(spark, rules, counts))
    # The empty token comes first: one such row stands for the URL itself, also when nothing is found.
    looked_up = parts.select("key", "host", "path", F.posexplode(F.array_union(F.array(F.lit("")), tokens)).alias("nth_token", "token"))
    met = looked_up.join(table, F.col("token") == F.col("rule_token"), "left")
    subject = F.concat("host", "path")
    fits = F.col("regex").isNotNull() & F.regexp_like(subject, F.col("regex"))
    first_rule = F.col("nth").isNull() | (F.col("nth") == F.col("first_nth"))
    firsts = [-n for n, r in enumerate(rules) if not r.tokens][:1]
    own = (F.col("nth_token") == 0) & (first_rule if firsts else F.lit(True))
    met = met.withColumn("first_nth", F.lit(firsts[0] if firsts else 0)).withColumn("fits", fits).withColumn("own", own)
    best = F.max(F.when(F.col("fits") & F.col("base"), F.struct("size", "nth", "name", "verdict")))
    other = F.max(F.when(F.col("fits") & ~F.col("base") & (F.col("verdict") == "block"), F.lit(1)))
    judged = met.groupBy("key", "host", "path").agg(
        best.alias("best"), other.alias("other"), F.count_if("own").alias("n"),
        F.count("regex").alias("candidates"), F.count_if("fits").alias("matches"),
    )
    return judged.select(
        F.col("key").alias(key), "host", "path", F.col("best.name").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("other") == 1, F.lit("block")), F.lit(default)).alias("verdict"),
        F.expr("candidates div n").alias("n_candidates"), F.expr("matches div n").alias("n_matches"),
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"),
    ).drop("copy")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_sql() -> str:
    subject = "host || path"

    def quoted(r: Rule) -> str:
        return r.regex.replace("'", "''")

    base = " union all ".join(f"select '{r.name}' as rule, '{r.verdict}' as v, {len(r.name)} as size, '{quoted(r)}' as rx" for r in BASE_RULES)
    other = " or ".join(f"regexp_matches({subject}, '{quoted(r)}')" for r in PATTERN_RULES)
    return f"""
with parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
         row_number() over () as n
  from pages),
rules as ({base}),
best as (
  select n, arg_max(rule, size) as rule, arg_max(v, size) as v
  from parts join rules on regexp_matches({subject}, rx) group by n)
select page_id, host, path, rule,
       case when v is not null then v when {other} then 'block' else 'allow' end as verdict
from parts left join best using (n)"""
