"""License scans: ordered signature rules over normalised words.

A text is lower-cased (A-Z), its words joined by single spaces. Every rule is a
regular expression gated by a keyword that any text it fits must hold; a text
without keywords runs no rule. Detections are intervals of words. A detection that
lies in one of the same or a higher priority is suppressed, and of two that overlap in
part the one of lower priority goes (of equal ones the later).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, let, read

#: What stands between words of a lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks around matches; they are gaps, so no normalised text holds them.
OPEN, CLOSE = "\x01", "\x02"
#: Values whose states are gathered in one array before it is put away.
CHUNK = 256


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    #: Over words joined by single spaces; has no space at its ends.
    regex: str
    priority: int
    base: bool = False


#: The phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def signatures() -> list[Signature]:
    """The ordered rules: hand-written forms, spelled out over versions and clauses."""
    rules = [Signature(label, phrase, phrase, 50, True) for phrase, label in BASE.items()]

    def add(label: str, keyword: str, regex: str, priority: int) -> None:
        rules.append(Signature(label, keyword, regex, priority))

    lic = "licen[cs]e"
    for family, name, versions in (("gpl", "(?:gnu )?general public", "1 0|2 0|3 0|1|2|3"), ("lgpl", "(?:gnu )?(?:lesser|library) general public", "2 0|2 1|3 0|2|3"), ("agpl", "(?:gnu )?affero general public", "1 0|3 0|1|3"), ("fdl", "(?:gnu )?free documentation", "1 1|1 2|1 3")):
        key = name.rsplit(" ", 1)[-1] if family == "fdl" else "general public"
        add(family, key, f"(?:gnu )?{name.removeprefix('(?:gnu )?')} {lic}", 60)
        for v in versions.split("|"):
            n = v.replace(" ", ".")
            add(f"{family}-{n}", key, f"{name} {lic}(?: as published by the free software foundation)? (?:version|v) {v}", 70)
            add(f"{family}-{n}-or-later", key, f"{name} {lic}(?: as published by the free software foundation)? (?:either )?(?:version|v) {v}(?: of the {lic})? or at your option any later version", 80)
            add(f"{family}-{n}-only", f"{family} {v}", f"{family} {v} only", 80)
            add(f"{family}-{n}-or-later", f"{family} {v}", f"{family} {v} or later", 80)
    for clause in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        label = "cc-" + clause.replace(" ", "-")
        full = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?", "nc": "non ?commercial"}
        spelled = " ".join(full[c] for c in clause.split())
        add(label, "creative commons", f"creative commons {spelled}", 55 + len(clause))
        add(label, f"cc {clause}", f"cc {clause}", 50 + len(clause))
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            n = v.replace(" ", ".")
            add(f"{label}-{n}", f"cc {clause} {v}", f"cc {clause} {v}", 70 + len(clause))
            add(f"{label}-{n}", "creative commons", f"creative commons {spelled} {v}", 70 + len(clause))
            add(f"{label}-{n}", "creativecommons org", f"creativecommons org licenses {clause} {v}", 75 + len(clause))
    add("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 70)
    add("cc0-1.0", "publicdomain zero", "creativecommons org publicdomain zero 1 0", 75)
    add("public-domain", "public domain", "(?:released|dedicated|placed)? ?(?:in|into|to)? ?the public domain", 60)
    for v in ("1 0", "1 1", "2 0"):
        add(f"apache-{v.replace(' ', '.')}", "apache", f"apache(?: software)? {lic} (?:version |v )?{v}", 70)
        add(f"apache-{v.replace(' ', '.')}", "apache", f"apache {v}(?: {lic})?", 65)
        add(f"mpl-{v.replace(' ', '.')}", "mozilla public", f"mozilla public {lic} (?:version |v )?{v}", 70)
        add(f"epl-{v.replace(' ', '.')}", "eclipse public", f"eclipse public {lic} (?:version |v )?{v}", 70)
        add(f"eupl-{v.replace(' ', '.')}", "european union public", f"european union public {lic} (?:version |v )?{v}", 70)
        add(f"cddl-{v.replace(' ', '.')}", "common development and distribution", f"common development and distribution {lic} (?:version |v )?{v}", 70)
        add(f"artistic-{v.replace(' ', '.')}", "artistic", f"artistic {lic} {v}", 70)
        add(f"osl-{v.replace(' ', '.')}", "open software", f"open software {lic} (?:version |v )?{v}", 70)
    for family, key in (("apache", "apache"), ("mpl", "mozilla public"), ("epl", "eclipse public"), ("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("bsl-1.0", "boost software"), ("artistic", "artistic"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("odbl", "open database"), ("ofl", "open font"), ("psf", "python software foundation"), ("php", "php"), ("ruby", "ruby"), ("openssl", "openssl"), ("postgresql", "postgresql"), ("x11", "x11"), ("ncsa", "ncsa"), ("afl", "academic free"), ("ms-pl", "microsoft public")):
        if family in ("unlicense", "wtfpl"):
            add(family, key, key, 50)
        else:
            add(family, key, f"(?:the )?{key} {lic}", 60)
            add(family, key, f"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?{key} {lic}", 65)
    for n, v in ((2, "simplified|freebsd"), (3, "new|modified|revised"), (4, "original|old")):
        add(f"bsd-{n}-clause", "bsd", f"(?:bsd {n} clause|{n} clause bsd|(?:{v}) bsd)(?: {lic})?", 70)
        add(f"bsd-{n}-clause", f"bsd {n}", f"spdx {lic} identifier bsd {n} clause", 80)
    add("bsd", "bsd", f"bsd(?: style)? {lic}", 60)
    add("bsd", "redistribution and use", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?", 65)
    add("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 70)
    add("isc", "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose", 70)
    add("warranty", "without warranty", "(?:provided )?(?:as is )?without warranty of any kind", 40)
    add("proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)", 55)
    add("reserved", "rights reserved", "(?:all|some|no) rights reserved", 45)
    add("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 40)
    for spdx in ("mit", "apache 2 0", "isc", "zlib", "unlicense", "cc0 1 0", "mpl 2 0", "epl 2 0", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0"):
        label, version = (spdx.split(" ", 1) + [""])[:2]
        add("-".join(x for x in (label, version.replace(" ", ".")) if x), "spdx", f"spdx {lic} identifier {spdx}", 80)
    return rules


def normalised(text: Column) -> Column:
    """Words joined by single spaces, with one space before the first and after the last."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), GAP, " ")


def _count(norm: Column) -> Column:
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))


def _running(values: Column, seed: int, step: Callable[[Column, Column], Column]) -> Column:
    """The states (int) behind each of ``values``: ``step(state, value)``, from ``seed`` on.

    Appending copies an array, so states are gathered chunk by chunk, which takes time
    in proportion to the number of values.
    """
    numbers = F.sequence(F.lit(0), F.call_function("div", F.size(values) - 1, F.lit(CHUNK)).cast("int"))
    chunks = let(values, lambda v: F.transform(numbers, lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))

    def over(state: Column, chunk: Column) -> Column:
        start = F.struct(state.alias("s"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(chunk, start, lambda acc, v: let(step(acc["s"], v).cast("int"), lambda n: F.struct(n.alias("s"), F.array_append(acc["out"], n).alias("out"))))

    start = F.struct(F.lit(seed).alias("s"), F.array().cast("array<array<int>>").alias("out"))
    return F.flatten(F.aggregate(chunks, start, lambda acc, c: let(over(acc["s"], c), lambda r: F.struct(r["s"].alias("s"), F.array_append(acc["out"], r["out"]).alias("out"))))["out"])


def _spans(norm: Column, rule: Column) -> Column:
    """One struct for each place where the rule's expression fits, from left to right.

    Matches are put between two marks that no normalised text holds. The spaces before
    a match tell the place of its first word, those inside how many more follow.
    """
    marked = F.regexp_replace(norm, F.concat(F.lit(" ("), rule["regex"], F.lit(")(?= )")), F.lit(f" {OPEN}$1{CLOSE}"))

    def placed(pieces: Column) -> Column:
        before = _running(F.transform(pieces, _count), -1, lambda total, n: total + n)
        return let(before, lambda at: F.transform(F.slice(pieces, 2, F.size(pieces) - 1), lambda p, k: let(F.get(at, k), lambda w: F.struct(
            w.alias("first"), (w + _count(F.substring_index(p, CLOSE, 1))).cast("int").alias("last")))))

    none = F.array().cast("array<struct<first:int,last:int>>")
    return let(F.split(marked, OPEN), lambda pieces: F.when(F.size(pieces) > 1, placed(pieces)).otherwise(none))


FOUND = "array<struct<below:int,first:int,stop:int,label:string,base:boolean,last:int,priority:int>>"


def _suppressed(found: Column) -> Column:
    """Keeps what containment and priority leave, in order of place.

    The higher priority goes first, then the earlier and longer. One goes that lies in
    one kept before or overlaps it in part; one that holds kept ones inside stays.
    Detections are cut where none reaches over, and each chain of overlapping ones is
    judged alone, so time grows with the number of detections, and with the square only
    of those in one chain.
    """
    names = ("first", "stop", "below", "label", "base", "last", "priority")

    def ordered(d: Column, lead: str) -> Column:
        return F.struct(*[d[n].alias(n) for n in (lead, *(n for n in names if n != lead))])

    def step(acc: Column, d: Column) -> Column:
        def against(k: Column) -> Column:
            holds = (d["first"] <= k["first"]) & (k["last"] <= d["last"]) & ((d["first"] < k["first"]) | (k["last"] < d["last"]))
            return (k["first"] <= d["last"]) & (d["first"] <= k["last"]) & ~holds

        return F.when(F.exists(acc, against), acc).otherwise(F.array_append(acc, d))

    def judged(chain: Column) -> Column:
        ranked = F.sort_array(F.transform(chain, lambda d: ordered(d, "below")))
        return F.transform(F.aggregate(ranked, F.array().cast(FOUND), step), lambda d: ordered(d, "first"))

    def chains(by_place: Column) -> Column:
        reach = _running(F.transform(by_place, lambda d: d["last"]), -1, F.greatest)
        opens = let(reach, lambda top: F.filter(F.sequence(F.lit(1), F.size(by_place)), lambda i: (i == 1) | (F.get(by_place, i - 1)["first"] > F.get(top, i - 2))))
        return let(opens, lambda at: F.transform(at, lambda i, k: F.slice(by_place, i, F.coalesce(F.get(at, k + 1), F.size(by_place) + 1) - i)))

    in_order = F.sort_array(F.transform(found, lambda d: ordered(d, "first")))
    kept = let(in_order, lambda d: F.flatten(F.transform(chains(d), lambda c: F.when(F.size(c) == 1, c).otherwise(judged(c)))))
    return F.when(F.size(found) == 0, found).otherwise(F.sort_array(kept))


def scan_licenses(docs: DataFrame, rules: list[Signature] | None = None, text: str = "text") -> DataFrame:
    """Adds ``license_words`` and ``license_found`` and ``license_kept`` (arrays of first, last, priority, label, base) to ``docs``.

    Null and empty texts have no words and no detections. Rows and all other
    columns stay as they are. No shuffle; a text meets a rule only by its keyword.
    Texts of any length are scanned whole, in time that grows with their length.
    """
    rules = signatures() if rules is None else rules
    norm = normalised(F.col(text))
    keywords = sorted({r.keyword for r in rules})
    # One literal for all rules: thousands of small ones take seconds to plan.
    spelled = json.dumps([{"keyword": f" {r.keyword}", "regex": r.regex, "priority": r.priority, "label": r.label, "base": r.base} for r in rules])
    table = F.from_json(F.lit(spelled), "array<struct<keyword:string,regex:string,priority:int,label:string,base:boolean>>")
    # Keywords open with one of few words; the first look at a text is for those alone.
    opening = " (?:" + "|".join(sorted({k.split(" ")[0] for k in keywords})) + ")"

    def detections(n: Column) -> Column:
        held = F.filter(F.from_json(F.lit(json.dumps([f" {k}" for k in keywords])), "array<string>"), lambda k: F.contains(n, k))
        met = let(held, lambda h: F.filter(table, lambda r: F.array_contains(h, r["keyword"])))
        return F.flatten(F.transform(met, lambda r: F.transform(_spans(n, r), lambda s: F.struct(
            s["first"].alias("first"), (-s["last"]).alias("stop"), (-r["priority"]).alias("below"), r["label"].alias("label"), r["base"].alias("base"), s["last"].alias("last"), r["priority"].alias("priority")))))

    def scanned(n: Column) -> Column:
        all_of = F.when(F.rlike(n, F.lit(opening)), detections(n))
        return F.struct((_count(n) - 1).cast("long").alias("words"), let(all_of, lambda f: F.struct(f.alias("found"), F.when(f.isNotNull(), _suppressed(f)).alias("kept"))).alias("hits"))

    none = F.array().cast("array<struct<first:int,stop:int,below:int,label:string,base:boolean,last:int,priority:int>>")
    scan = free_name(docs, "_scan")
    return (
        docs.withColumn(scan, let(norm, scanned))
        .withColumns({"license_words": F.col(f"{scan}.words"), "license_found": F.coalesce(F.col(f"{scan}.hits.found"), none), "license_kept": F.coalesce(F.col(f"{scan}.hits.kept"), none)})
        .drop(scan)
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("license_found", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["first"])
    base_labels = F.array_distinct(F.transform(base, lambda d: d["label"]))
    kept_labels = F.array_distinct(F.transform("license_kept", lambda d: d["label"]))
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("license_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, kept_labels)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("license_kept", lambda d: d["priority"])) / 100, F.lit(0.0)).alias("score"),
    )


def op5_base_sql() -> str:
    """The columns that the contract fixes, for a comparison (labels and score are the method's)."""
    phrases = " union all ".join(f"select {tuple(p.split())!r} as p, '{label}' as label".replace("(", "[").replace(")", "]") for p, label in BASE.items())
    return f"""
with w as (
  select doc_id, row_number() over () as n,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws
  from documents),
p as ({phrases}),
hits as (
  select n, label, i - 1 as word
  from (select n, ws, unnest(range(1, len(ws) + 1)) as i from w), p
  where ws[i:i + len(p) - 1] = p)
select doc_id, cast(len(ws) as bigint) as n_words, count(word) as n_base, min(word) as first_word, max(word) as last_word,
       coalesce(string_agg(distinct label, ',' order by label), '') as base_labels
from w left join hits using (n) group by w.n, doc_id, ws"""
