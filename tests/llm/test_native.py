"""URL filters, license scans, quality rules, mixing and fingerprints against SQL, brute force and edge cases."""

import hashlib
import re
import time
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from chatloom.llm import fingerprint, license_scan, mixing, quality_rules, url_filter

DOCS = "doc_id bigint, text string, lang string, source string"
EDGE = [None, "", " ", "a", "a b c", "\n\n", "same line\nsame line", "word " * 3000, "grüße 日本語 🎉 " * 10, "x" * 20000]


def frame(spark, texts, extra=True):
    rows = [(i, t, None if i % 3 else "en", f"src{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "no id", None, None)] if extra else []
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df, *names):
    """Extra columns named like ones that operators use inside."""
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def test_op7_same_as_sql(spark, sf, same):
    same(url_filter.op7_url_filter(spark, sf), url_filter.op7_sql())


def test_op7_edges(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.ORG", "http://a.org/", "http://x.EXAMPLE.org/es/1?q#f", "https://notexample.org/es/", "http://example.org/en/12", "http://b.com/fr/", "http://b.com/de/x", "http://free-bets.example.net/x", "http://u:p@c.com:80/DE/", "x://y://z.org/", "http://c.net/a/casino/b"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1, ""), (None, None)], "page_id bigint, url string")
    pages = with_clashes(pages, "host", "path", "token", "key", "rule", "n")
    rows = url_filter.judge_urls(pages).collect()
    assert len(rows) == len(urls) + 2
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[0] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[4] == ("a.org", "", None, "allow")
    assert got[5] == ("a.org", "/", "org/", "allow")
    assert got[6] == ("x.example.org", "/es/1", "example.org/es/", "block")
    assert got[7][2:] == ("org/", "allow") and got[8][2:] == ("example.org/en/1", "block")
    assert got[9][2:] == ("com/fr/", "allow") and got[10][2:] == ("com/de/", "block")
    assert got[11][2:] == (None, "block") and got[12][2:] == (None, "allow") and got[13][:2] == ("y:", "//z.org/") and got[14][3] == "block"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_op7_index_equals_all_rules(spark):
    rules = [url_filter.Rule("block", "*tail"), url_filter.Rule("block", "mid*dle"), url_filter.Rule("block", "||h.org^"), url_filter.Rule("allow", "||h.org/ok/", True), url_filter.Rule("block", "||org/", True)]
    urls = [f"http://{h}{p}" for h in ("h.org", "a.h.org", "b.net", "midxdle.net") for p in ("", "/", "/ok/", "/x/tail", "/mid/dle")]
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules).collect()
    for r in rows:
        subject = r["host"] + r["path"]
        fit = [x for x in rules if re.search(x.regex, subject)]
        base = max((x for x in fit if x.base), key=lambda x: len(x.name), default=None)
        assert r["rule"] == (base.name if base else None)
        assert r["verdict"] == (base.verdict if base else "block" if any(not x.base for x in fit) else "allow")
        assert r["n_matches"] == len(fit)


def test_op5_base_same_as_sql(spark, sf, same):
    same(license_scan.op5_license_scan(spark, sf).drop("labels", "score"), license_scan.op5_base_sql())


def brute_spans(text, rule):
    norm = re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", " " + re.sub("[A-Z]", lambda m: m[0].lower(), text or "") + " ")
    return norm.count(" ") - 1, [(norm[: m.start()].count(" "), norm[: m.start()].count(" ") + m[0].count(" ") - 1) for m in re.finditer(f" {rule.regex}(?= )", norm)]


def test_op5_edges_and_all_rules(spark):
    texts = EDGE + ["CC BY", "cc-by cc by! cc bypass", "x all rights reserved", "GNU General Public License version 3 or at your option any later version", "licensed under the Apache License, Version 2.0 and the MIT licence", "general public license " * 500, "creative commons attribution noncommercial 4.0 cc by nc 4.0"]
    rules = license_scan.signatures()
    assert len(rules) > 200
    rows = license_scan.scan_licenses(with_clashes(frame(spark, texts, extra=False), "regex", "priority", "found", "at")).collect()
    for r, text in zip(sorted(rows, key=lambda r: r["doc_id"]), texts):
        found = sorted((d["first"], d["last"], d["label"], d["priority"]) for d in r["license_found"])
        want = sorted((a, b, rule.label, rule.priority) for rule in rules for a, b in brute_spans(text, rule)[1])
        assert found == want and r["license_words"] == brute_spans(text, rules[0])[0]
        kept = [(d["first"], d["last"]) for d in r["license_kept"]]
        assert bool(kept) == bool(found) and set(kept) <= {x[:2] for x in found}
        for d in r["license_found"]:
            assert any(k["first"] <= d["last"] and d["first"] <= k["last"] for k in r["license_kept"])
    by = {t: {d["label"] for d in r["license_kept"]} for t, r in zip(texts, sorted(rows, key=lambda r: r["doc_id"]))}
    assert "gpl-3-or-later" in by[texts[len(EDGE) + 3]] and "apache-2.0" in by[texts[len(EDGE) + 4]]


def test_op3_same_as_sql(spark, sf, same):
    same(quality_rules.op3_quality_rules(spark, sf), quality_rules.op3_sql())


def brute_measure(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(ws) < 200 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), again if again is None else len(again)


def test_op3_edges(spark):
    texts = EDGE + ["a b c a b c", "a a a a", "a b c d", "#x | y\nz\n\nz\n z", "one\x0btwo\x0cthree\rfour"]
    rows = quality_rules.judge_quality(with_clashes(frame(spark, texts), "_host", "n", "rate_any")).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is None:
            continue
        n, chars, symbols, lines, again = brute_measure(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, lines)
        assert again is None or r["n_repeat_words"] == again
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge_quality(frame(spark, texts).limit(0)).count() == 0


def test_op3_hosts_decide(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    bad = " ".join(f"w{i} # | #" for i in range(60))
    rows = [(i, bad if i % 10 else clean + f" {i}", "en", "junk") for i in range(100)] + [(1000 + i, clean + f" {i}", "en", "good") for i in range(100)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(kept[i] for i in range(100)) and all(kept[1000 + i] for i in range(100))


def test_op1_same_as_sql(spark, sf, same):
    same(mixing.op1_mixing(spark, sf), mixing.mix_sql())


def test_op1_edges(spark):
    docs = with_clashes(frame(spark, EDGE), "h", "tokens", "whole", "rest", "target", "bucket", "domain")
    out = mixing.mix(docs, share=1.0)
    rows = out.collect()
    assert set(docs.columns) < set(out.columns)
    assert all(r["mix_tokens"] is not None and r["mix_epoch"] < mixing.MAX_EPOCHS for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_op1_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000), ("d1", "en", "e", 1000)], "domain string, lang string, source string, tokens bigint")
    got = {r["source"]: r["target"] for r in mixing.allocate(leaves, F.lit(800.0), {}, 1).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "e": 400}
    got = {r["source"]: r["target"] for r in mixing.allocate(leaves, F.lit(10000.0), {}, 1).collect()}
    assert got == {"a": 10, "b": 1000, "c": 1000, "e": 1000}


def test_op1_prefix_of_a_large_leaf(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    rows = mixing.mix(docs, share=0.4).collect()
    total = sum(1 + i % 7 for i in range(3000))
    took = sum(r["mix_tokens"] for r in rows)
    assert int(total * 0.4) - 7 < took <= int(total * 0.4) and len({r["doc_id"] for r in rows}) == len(rows)




def test_op10_edited_texts(spark, sf):
    rows = {r["doc_id"]: r for r in fingerprint.op10_syncmer_fingerprints(spark, sf).collect()}
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    assert len(rows) == len(docs)
    for i, (key, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert rows[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[key]["n_chars"] == len(text)
    long = [r for r in rows.values() if r["n_chars"] > 1000]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.5 and sum(r["near_next"] for r in long) / len(long) < 0.2


def test_op10_neighbours_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_DOCS", 3)
    keys = [5, 6, 7, 100, 101, 1000, -4, 0]
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id bigint, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(df, ["text"], "text").collect()}
    order = sorted(keys, reverse=True)
    assert got == {k: f"t{order[(i + 1) % len(order)]}" for i, k in enumerate(order)}


def test_op10_neighbours_of_shared_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_DOCS", 3)
    keys = [1 << 60, *range(20), *[7] * 60, *[None] * 50, -(1 << 60)]
    rows = [(k, f"t{i}") for i, k in enumerate(keys)]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id bigint, text string"), ["text"], "text").collect()
    after = {r["text"]: r["next_text"] for r in got}
    assert len(got) == len(rows) == len(set(after.values()))
    # One ring, in which keys only descend, nulls last.
    key_of = {t: k for k, t in rows}
    ring, at = [], f"t{0}"
    while at not in ring:
        ring.append(at)
        at = after[at]
    assert len(ring) == len(rows) and at == "t0"
    want = sorted(keys, key=lambda k: (k is None, -(k or 0)))
    assert [key_of[t] for t in ring] == want


def brute_anchors(text, k=fingerprint.K, s=fingerprint.S):
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def chain(numbers):
        seed = 42
        for n in numbers:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", n), seed)
        return signed(seed)

    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")]
    if len(h) < k:
        array = 42
        for x in h:
            array = xxhash.xxh64_intdigest(struct.pack("<q", x), array)
        return [((array & (1 << 64) - 1) >> 33, 0)] if h else []
    pairs = [chain(h[i : i + s]) for i in range(len(h) - s + 1)]
    out = []
    for i in range(len(h) - k + 1):
        inner = pairs[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append(((chain(h[i : i + k]) & (1 << 64) - 1) >> 33, i))
    return out


def brute_likeness(a, b):
    x, y = ({(p[0], q[0], q[1] - p[1]) for p, q in zip(f, f[1:])} if len(f) > 1 else {v for v, _ in f} for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def test_op10_is_brute_force(spark, sf):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    rows = {r["doc_id"]: r for r in fingerprint.op10_syncmer_fingerprints(spark, sf).collect()}
    for i, (key, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 3
        own, edited, other = (brute_anchors(t) for t in (text, text[: len(text) - cut] + after[:cut], after))
        r = rows[key]
        assert r["fingerprint"] == "".join(f"{(v << 28) + w:016x}" for v, w in own) and r["edited_fingerprint"] == "".join(f"{(v << 28) + w:016x}" for v, w in edited)
        assert abs(r["near_edited"] - brute_likeness(own, edited)) < 1e-12 and abs(r["near_next"] - brute_likeness(own, other)) < 1e-12


def test_op10_edges(spark):
    docs = with_clashes(frame(spark, EDGE), "body", "anchors", "n", "cut", "_k", "_h", "_bucket")
    rows = fingerprint.edited_fingerprints(docs).collect()
    assert len(rows) == len(EDGE) + 2
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == "" and by[0]["near_edited"] in (0.0, 1.0) and by[3]["fingerprint"] != ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.edited_fingerprints(docs.limit(0)).count() == 0
    one = fingerprint.edited_fingerprints(docs.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


def test_op10_choice_is_context_free(spark):
    base = [f"w{i * 7919 % 1009}" for i in range(300)]
    moved = ["x"] * 13 + base[50:250] + ["y"] * 9
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(moved))], "doc_id bigint, text string").withColumn("anchors", fingerprint.anchors(F.col("text")))
    a, b = ({(x["value"], x["word"]) for x in r["anchors"]} for r in df.orderBy("doc_id").collect())
    inside = {(v, w - 50 + 13) for v, w in a if 50 <= w <= 250 - fingerprint.K}
    assert inside and inside <= b
    best = fingerprint.aligned(df.where("doc_id = 1"), df.where("doc_id = 2")).orderBy(F.desc("n_anchors")).first()
    assert best["shift"] == -37 and best["n_anchors"] == len(inside)


def test_weight_zero_and_remainders(spark):
    """Tokens that a child of weight 0 would hold go to others, and no token is lost to rounding."""
    leaves = spark.createDataFrame([("d0", "en", "a", 100), ("d0", "de", "a", 100), ("d1", "en", "a", 1000), ("d1", "en", "b", 1000), ("d1", "en", None, 1000)], "domain string, lang string, source string, tokens bigint")
    weights = {"domain": {"d0": 1, "d1": 1}, "lang": {"de": 0}}
    got = {(r["domain"], r["lang"], r["source"]): r["target"] for r in mixing.allocate(leaves, F.lit(601.0), weights, 1).collect()}
    assert got == {("d0", "en", "a"): 100, ("d0", "de", "a"): 0, ("d1", "en", None): 167, ("d1", "en", "a"): 167, ("d1", "en", "b"): 167}
    got = {r["target"] for r in mixing.allocate(leaves, F.lit(1e9), weights, 1).collect()}
    assert got == {0, 100, 1000}
    assert mixing.allocate(leaves, F.lit(10.0), {"lang": {"en": 0, "de": 0}}, 1).agg(F.sum("target")).first()[0] == 0


def test_mixing_plans_stay_small(spark, monkeypatch):
    """No plan of the allocation holds all levels, and none of the cut all refinements; in one piece they had 34 windows, aggregates and joins."""
    docs = spark.createDataFrame([(i, f"a b c {i}", "en", f"s{i % 3}") for i in range(30)], "doc_id bigint, text string, lang string, source string")
    sizes, plain = [], mixing.cut

    def watched(df):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        sizes.append(sum(plan.count(x) for x in ("Window ", "Aggregate(", "Join ", "Aggregate ")))
        return plain(df)

    monkeypatch.setattr(mixing, "cut", watched)
    assert mixing.mix(docs, share=1.0).count() > 0
    assert max(sizes) < 20


def test_mixing_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i % 4, f"a b c {i}", "en", f"s{i % 2}") for i in range(12)], "doc_id bigint, text string, lang string, source string")
    for c in ("_n", "_whole", "_last", "_edge", "_end_domain", "domain", "h", "copies", "key", "tokens", "mix_tokens"):
        docs = docs.withColumn(c, F.lit("clash"))
    rows = mixing.mix(docs, share=1.0, max_epochs=2).collect()
    assert rows and all(r["_n"] == r["domain"] == r["copies"] == "clash" and r["mix_tokens"] == 4 for r in rows)


def brute_suppressed(found):
    kept = []
    for first, last, priority, label in sorted(found, key=lambda d: (-d[2], d[0], -d[1], d[3])):
        clash = False
        for a, b, _, _ in kept:
            overlap = a <= last and first <= b
            holds = first <= a and b <= last and (first, last) != (a, b)
            clash |= overlap and not holds
        if not clash:
            kept.append((first, last, priority, label))
    return sorted(kept)


def test_op5_suppression_is_brute_force(spark):
    rule = license_scan.Signature
    rules = [rule("outer", "aa", "aa bb cc dd ee ff", 60), rule("in1", "bb", "bb cc", 70), rule("in2", "ee", "ee ff", 50), rule("long", "cc", "cc dd ee", 65), rule("tail", "ff", "ff gg hh", 55), rule("pair", "aa", "aa(?: aa)?", 40), rule("same", "bb", "bb cc", 70)]
    rng = __import__("random").Random(4)
    texts = ["aa bb cc dd ee ff", "aa bb cc dd ee ff gg hh"] + [" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"], weights=[3, 3, 3, 2, 2, 2, 1, 1], k=rng.randint(0, 40))) for _ in range(80)]
    texts += ["aa bb cc dd ee ff gg hh " * 30]
    for own in (rules[:3], rules):
        rows = license_scan.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), own).collect()
        for r in rows:
            found, kept = ([(d["first"], d["last"], d["priority"], d["label"]) for d in r[c]] for c in ("license_found", "license_kept"))
            assert sorted(kept) == brute_suppressed(found)
    first = license_scan.scan_licenses(spark.createDataFrame([("aa bb cc dd ee ff",)], "text string"), rules[:3]).first()
    assert [d["label"] for d in first["license_kept"]] == ["outer", "in1"]


def test_op5_labels_and_score(spark, sf):
    """The query's labels and score from the operator's own detections, suppressed by brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in license_scan.op5_license_scan(spark, sf).collect()}
    for r in license_scan.scan_licenses(docs).collect():
        found = [(d["first"], d["last"], d["priority"], d["label"]) for d in r["license_found"]]
        kept = brute_suppressed(found)
        base = {d["label"] for d in r["license_found"] if d["base"]}
        row = got[r["doc_id"]]
        assert row["labels"] == ",".join(sorted(base | {d[3] for d in kept})) and row["score"] == max([d[2] for d in kept], default=0) / 100


def test_op5_long_texts_take_time_with_their_length(spark):
    """Quarter of a megabyte full of detections, one with letters of several bytes, and long chains of overlapping ones."""
    texts = ["cc by x " * 32_000, "ümläut cc by é mit license " * 9_000, "mit license " * 20_000]
    start = time.monotonic()
    rows = {r["i"]: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert time.monotonic() - start < 90
    for i, text in enumerate(texts):
        rules = [x for x in license_scan.signatures() if x.keyword in text]
        want = sorted((a, b, x.label, x.priority) for x in rules for a, b in brute_spans(text, x)[1])
        assert sorted((d["first"], d["last"], d["label"], d["priority"]) for d in rows[i]["license_found"]) == want
    assert [len(rows[i]["license_kept"]) for i in range(3)] == [32_000, 18_000, 20_000]
    assert [d["first"] for d in rows[0]["license_kept"]] == list(range(0, 96_000, 3))


@pytest.mark.parametrize("chunk", [1, 2, 3, 256])
def test_op5_chains_at_edges_of_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(license_scan, "CHUNK", chunk)
    rule = license_scan.Signature
    rules = [rule("ab", "aa", "aa bb", 60), rule("bc", "bb", "bb cc", 50), rule("ca", "cc", "cc aa", 70), rule("all", "aa", "aa bb cc aa bb", 55), rule("a", "aa", "aa", 60)]
    rng = __import__("random").Random(chunk)
    texts = ["aa bb cc " * 40, "aa bb", "bb", " ".join(rng.choices(["aa", "bb", "cc", "xx"], k=200))] + [" ".join(rng.choices(["aa", "bb", "cc", "xx"], k=rng.randint(0, 30))) for _ in range(20)]
    for r in license_scan.scan_licenses(spark.createDataFrame([(t,) for t in texts], "text string"), rules).collect():
        found, kept = ([(d["first"], d["last"], d["priority"], d["label"]) for d in r[c]] for c in ("license_found", "license_kept"))
        assert sorted(found) == sorted((a, b, x.priority, x.label) for x in rules for a, b in brute_spans(r["text"], x)[1])
        assert sorted(kept) == brute_suppressed(found) and [k[0] for k in kept] == sorted(k[0] for k in kept)


def test_anchors_are_shuffled_packed(spark, monkeypatch):
    """One long for each anchor goes through the shuffle, a quarter of the structs; unpacking gives the same anchors."""
    seen = {}
    with_next = fingerprint.with_next
    monkeypatch.setattr(fingerprint, "with_next", lambda docs, *rest: seen.update(docs.dtypes) or with_next(docs, *rest))
    docs = spark.createDataFrame([(1, " ".join(f"w{i * i % 97}" for i in range(500))), (2, "one two"), (3, ""), (4, None)], "doc_id bigint, text string")
    assert fingerprint.edited_fingerprints(docs).count() == 4 and seen["anchors"] == "array<bigint>"
    found = docs.select(fingerprint.anchors(F.col("text")).alias("a"))
    assert found.where(~fingerprint.unpacked(fingerprint.packed(F.col("a"))).eqNullSafe(F.col("a"))).count() == 0
