"""Classifiers, encoding, SimHash and suffix dedup against brute force, libraries and edge cases."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from chatloom.llm import byte_bpe, calibration, components, quality_classifier, simhash, suffix_dedup, toxicity
from chatloom.llm.common import maybe_among

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [None, "", " ", "a", "a b", "a b c", "Ünïcode 日本語 🎉", "word " * 3000, "<|endoftext|> x"]


def frame(spark, texts):
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark, texts):
    """With a repeated row, a null key and clashing columns."""
    df = frame(spark, texts)
    df = df.unionByName(df.where("doc_id = 3")).unionByName(spark.createDataFrame([(None, "no id here", None, None, None)], DOCS))
    for n in ("score", "bits", "least", "node", "cut_spans", "first", "n_tokens", "x", "body"):
        df = df.withColumn(n, F.lit("clash"))
    return df


# 2 and 6: classifiers.


def held_out(spark, query, sf, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    return [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]


@pytest.mark.parametrize("query, label, least", [(quality_classifier.op2_quality_classifier, "quality", 0.9), (toxicity.op6_toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, query, label, least):
    cases = held_out(spark, query, "/root/testdata/sf0.01", label)
    assert sum(p == y for _, p, y in cases) / len(cases) >= least


@pytest.mark.parametrize("module, label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers_on_edges(spark, module, label):
    texts = EDGE + [f"good plain text number {i} about rivers" for i in range(40)] + [f"bad ### junk %%% idiot {i} $$$" for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < len(EDGE) + 40), int(i >= len(EDGE) + 40)) for i in range(len(texts))] + [(None, 1, None), (5, None, None), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = odd(spark, texts)
    rows = module.score(docs, module.train(docs, labels, label)).collect()
    name = "score" if module is quality_classifier else "toxic_score"
    assert len(rows) == len(texts) + 2 and all(0 <= r[name] <= 1 for r in rows)
    assert len({r[name] for r in rows if not (r["text"] or "")}) == 1
    none = module.train(docs, labels.limit(0), label)
    assert {round(r[name], 6) for r in module.score(docs, none).collect()} == {0.5}
    assert module.score(docs.limit(0), none).count() == 0


def dense(index):
    out = np.zeros((len(index.terms), len(index.ids)))
    out[index.at, np.repeat(np.arange(len(index.ids)), np.diff(index.start))] = index.w
    return out


@pytest.mark.parametrize("n_words, n, most", [(40, 700, 6), (3000, 900, 120)])
def test_block_max_is_exact(n_words, n, most):
    rng = random.Random(n)
    words = [f"t{i}" for i in range(n_words)]
    examples = [(i, i % 2, " ".join(rng.choices(words, k=rng.randint(1, most)))) for i in range(n)]
    index = toxicity.counted(examples)
    assert set(index.terms) == {w for _, _, x in examples for w in toxicity.words_of(x)} and len(index.ids) == n
    index = toxicity.weighted(index, np.log(1000 / np.array([rng.randint(1, 500) for _ in index.terms])) + 1)
    assert (index.weights > 0).all()
    full = dense(index)
    assert np.allclose((full * full).sum(0), 1, atol=1e-5)
    for _ in range(150):
        text = " ".join(rng.choices([*words, "other"], k=rng.randint(0, most + 2)))
        places, cosines = index.nearest(text)
        at, w = index.vector(text)
        want = np.round(w @ full[at], 12) if len(at) else np.zeros(n)
        order = [i for i in np.lexsort((index.ids, -want))[: index.k] if want[i] > 0]
        assert len(order) == len(places) and np.allclose(want[order], cosines, atol=1e-9) and np.allclose(want[places], cosines, atol=1e-9)


def test_toxicity_query_is_brute_force(spark):
    """The whole query against plain loops: frequencies, weights, cosines, votes; the curve is its own test's."""
    import math
    from collections import Counter

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    bags = {k: Counter(__import__("re").findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))) for k, t in texts.items()}
    sample = {r["doc_id"]: r["y"] for r in toxicity.labelled_sample(docs, labels, "toxic").where("part = 1").collect()}
    sample = {k: y for k, y in sample.items() if bags[k]}
    share = sum(sample.values()) / len(sample)
    weight = {}
    for t in {t for k in sample for t in bags[k]}:
        m, a = sum(t in bags[k] for k in sample), sum(t in bags[k] for k, y in sample.items() if y)
        tie = sum(n * math.log(n / (m * p)) for n, p in ((a, share), (m - a, 1 - share)) if n)
        weight[t] = (math.log((1 + len(bags)) / (1 + sum(t in b for b in bags.values()))) + 1) * (1 + max(0, tie))

    def unit(bag):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in bag.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {k: unit(bags[k]) for k in sample}
    for r in toxicity.score(docs, model).collect():
        own = unit(bags[r["doc_id"]])
        near = sorted(((-sum(x * v.get(t, 0) for t, x in own.items()), k) for k, v in vectors.items()))[: toxicity.K]
        near = [(c, k) for c, k in near if c < -1e-9]
        want = (sum(c * c * sample[k] for c, k in near) + toxicity.PRIOR * share) / (sum(c * c for c, _ in near) + toxicity.PRIOR) if near else -1.0
        assert abs(r["toxic_evidence"]["vote"] - want) < 1e-5
        assert np.allclose([-c for c, _ in near[:3]], r["toxic_evidence"]["cosines"], atol=1e-5)
    assert len({r["toxic_score"] for r in toxicity.score(docs, model).collect()}) > 10


def test_curves_are_monotone_and_weighted():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (x + rng.normal(size=500) > 0).astype(float)
    grid = calibration.fit_curve(x, y)(np.linspace(-3, 3, 100))
    assert (np.diff(grid) >= 0).all() and grid[0] < 0.2 and grid[-1] > 0.8
    assert calibration.fit_curve(x, y, {0: 9.0, 1: 1.0})(np.zeros(1))[0] < calibration.fit_curve(x, y)(np.zeros(1))[0]
    assert calibration.fit_curve(np.ones(4), np.ones(4))(np.zeros(1))[0] > 0.8


# 4: encoding.


@pytest.fixture(scope="module")
def encoding():
    path, pattern = byte_bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_tiktokens(spark, sf, encoding):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in byte_bpe.op4_byte_bpe(spark, sf).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_round_trip_and_long_words(spark, encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED_BYTES", 1000)
    path, pattern = byte_bpe.public_vocabulary()
    texts = EDGE + ["a" * 1500, "supercalifragilistic" * 20, "x\n\n  y\t z  ", "don't we'll I'm", "é́​"]
    rows = frame(spark, texts).withColumn("ids", byte_bpe.token_ids(path, pattern)("text")).withColumn("back", byte_bpe.token_text(path)("ids")).collect()
    for r in rows:
        assert list(r["ids"]) == encoding.encode_ordinary(r["text"] or "") and r["back"] == (r["text"] or "")
    out = byte_bpe.encode_documents(odd(spark, texts), path, pattern)
    assert out.count() == len(texts) + 2 and out.columns.count("n_tokens") == 1
    assert byte_bpe.encode_documents(odd(spark, texts).limit(0), path, pattern).count() == 0


def test_long_words_by_windows(encoding):
    path, pattern = byte_bpe.public_vocabulary()
    c, split, rng = byte_bpe.WordCodec(path), byte_bpe.splitter(pattern), random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for text in ["".join(rng.choices(letters, k=20_000)), "a" * 5000, "abc" * 2000, "é" * 1300, "!?" * 900, "x" * 513, "".join(rng.choices("0123456789", k=3000))]:
        words = split(text)
        c.learn(set(words))
        assert [int(i) for w in words for i in np.frombuffer(c.known[w][0], "<u4")] == encoding.encode_ordinary(text)
        assert b"".join(c.known[w][1] for w in words) == text.encode()


def test_windows_that_share_no_token(encoding, monkeypatch):
    c = byte_bpe.WordCodec(byte_bpe.public_vocabulary()[0])
    monkeypatch.setattr(c, "_stitched", lambda size, windows: None)
    c.learn({"qxz" * 300})
    assert np.frombuffer(c.known["qxz" * 300][0], "<u4").tolist() == encoding.encode_ordinary("qxz" * 300)


def test_splitter_is_the_pattern():
    import regex

    _, pattern = byte_bpe.public_vocabulary()
    rng, chars = random.Random(6), [chr(i) for i in range(256)] + ["ſ", "日", "\u2028", "'s", "'ll", " ", "  ", "\n"]
    for own in (pattern, r"\p{L}+|[^\p{L}\s]+|\s+", r"\p{Lu}?\w+|."):
        for _ in range(300):
            text = "".join(rng.choices(chars, k=rng.randint(0, 60)))
            assert byte_bpe.splitter(own)(text) == regex.findall(own, text)


def test_encoding_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 3), (1, "a b", "x", "y", 3)], "doc_id bigint, text string, _e string, _encoded string, n_tokens int")
    rows = byte_bpe.encode_documents(docs, *byte_bpe.public_vocabulary()).collect()
    assert [(r["_e"], r["_encoded"], r["n_tokens"]) for r in rows] == [("x", "y", 2)] * 2


# 9: SimHash.


def brute_simhash(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", __import__("re").sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    least = dict.fromkeys(prints)
    label = {k: k for k in least}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_components_are_brute_force(spark, sf):
    rows = simhash.op9_simhash_near_dedup(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: brute_simhash(t) for k, t in texts.items()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(prints)


@pytest.mark.parametrize("most", [1, 3, 5])
def test_links_lose_none(spark, most):
    rng = random.Random(most)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(6):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, most + 2))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "bits bigint")
    got = {frozenset((r["left"], r["right"])) for r in simhash.link_fingerprints(df, most).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= most}
    assert got == want


def test_long_chain(spark):
    n = 80
    nodes = spark.createDataFrame([(i, (i * 37) % n) for i in range(n)], "node bigint, least bigint")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 39], "left bigint, right bigint")
    got = {r["node"]: r["least"] for r in components.label_components(nodes, links).collect()}
    for part in (range(40), range(40, n)):
        assert {got[i] for i in part} == {min((i * 37) % n for i in part)}


def test_simhash_edges(spark):
    rows = simhash.near_duplicates(odd(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) + 2
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["component_id"] == by[1]["component_id"] == by[2]["component_id"] == 0 and by[0]["bits"] == 0
    out = simhash.drop_near_duplicates(odd(spark, EDGE))
    assert out.columns == odd(spark, EDGE).columns and sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 7, 8]
    assert simhash.near_duplicates(odd(spark, EDGE).limit(0)).count() == 0 and simhash.drop_near_duplicates(odd(spark, EDGE).limit(0)).count() == 0


# 8: suffix dedup.


def test_op8_same_as_sql(spark, sf, same):
    same(suffix_dedup.op8_suffix_dedup(spark, sf), suffix_dedup.op8_sql())


def brute_spans(texts, least):
    places = {}
    for k, t in texts.items():
        ws = (t or "").split()
        for i in range(len(ws) - least + 1):
            places.setdefault(tuple(ws[i : i + least]), []).append((k, i))
    every, later = {}, {}
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                every.setdefault(k, set()).update(range(i, i + least))
            for k, i in sorted(found)[1:]:
                later.setdefault(k, set()).update(range(i, i + least))
    return every, later


def test_passages_are_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choices(words, k=n) for n in (49, 50, 51, 60, 120)]
    texts = {}
    for k in range(60):
        parts = [rng.choices(words, k=rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            parts += [p if rng.random() < 0.6 else p[rng.randint(0, 9) :], rng.choices(words, k=rng.randint(0, 30))]
        texts[k] = " ".join(w for p in parts for w in p)
    texts[60] = "same " * 130
    texts[61] = texts[3]
    rows = suffix_dedup.repeats(spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id bigint, text string")).collect()
    every, later = brute_spans(texts, 50)
    covered = lambda spans: {i for s in spans for i in range(s["start"], s["stop"])}
    assert {r["doc_id"]: covered(r["spans"]) for r in rows} == every
    assert {r["doc_id"]: covered(r["cut_spans"]) for r in rows if r["cut_spans"]} == later


def test_cut_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = frame(spark, [f"head one {passage} tail one", f"head two\n{passage}\nclose two", passage, "short"])
    rows = {r["doc_id"]: r for r in suffix_dedup.drop_repeats(df).collect()}
    assert rows[0]["text"] == f"head one {passage} tail one" and rows[1]["text"] == "head two\nclose two" and rows[1]["n_chars"] == len("head two\nclose two")
    assert set(rows) == {0, 1, 3}


def test_suffix_edges(spark):
    docs = odd(spark, EDGE)
    rows = suffix_dedup.repeats(docs).collect()
    assert [r["doc_id"] for r in rows] == [7] and [tuple(s) for s in rows[0]["cut_spans"]] == [(1, 3000)]
    out = suffix_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0 and suffix_dedup.drop_repeats(docs.limit(0)).count() == 0


def test_filter_keeps_all_keys(spark):
    keys = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    held = maybe_among(keys, "k")
    kept = {r["id"] for r in spark.range(1000).where(held(F.col("id"))).collect()}
    assert set(range(0, 1000, 7)) <= kept and len(kept) < 160


def test_calibration_pools_ties():
    x = np.array([-1.0] * 10 + [0.5] * 4)
    for order in (np.arange(14), np.arange(14)[::-1]):
        y = np.array([0.0] * 9 + [1.0] + [1.0, 1.0, 1.0, 0.0])
        curve = calibration.fit_curve(x[order], y[order])
        assert curve(np.array([-1.0]))[0] < 0.2 < 0.6 < curve(np.array([0.5]))[0]
    assert calibration.fit_curve(np.empty(0), np.empty(0))(np.zeros(1))[0] == 0.5


def test_rare_toxic_words_count(spark):
    # Each insult stands in two toxic examples only, behind a gate of 19 rows or one of 200 terms.
    insults = [f"zq{i}x" for i in range(300)]
    texts = [f"{insults[i // 2 % 300]} plain {i % 7}" if i < 600 else f"calm{i // 2 % 300}y plain {i % 7}" for i in range(1200)]
    unseen = [f"{w} again" for w in insults] + [f"calm{i}y again" for i in range(300)]
    docs = frame(spark, texts + unseen)
    labels = spark.createDataFrame([(i, int(i < 600)) for i in range(1200)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).where("doc_id >= 1200").collect()
    found = {r["text"].split()[0]: r["toxic_score"] for r in rows if r["text"].split()[0].encode() in model.index.terms}
    seen = [w for w in found if w.startswith("zq")]
    # Half of the toxic texts of the other part have words that no example has, so calm ones stay uncertain.
    assert len(seen) > 150 and all(found[w] > 0.9 for w in seen) and all(v < 0.5 for w, v in found.items() if w.startswith("calm"))


def jaccard(a, b, n=5):
    def shingles(t):
        ws = [w.lower() for w in t.split()]
        return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_kept(rows, least=0.8):
    """Of (key, text): one of each component of texts alike, by the least key, nulls last."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(rows[i][1] or "", rows[j][1] or "") >= least:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    parts = {}
    for i, r in enumerate(rows):
        parts.setdefault(label[i], []).append(r)
    return [min(p, key=lambda r: (r[0] is None, r[0] or 0)) for p in parts.values()]


def test_equal_and_null_ids_are_different_documents(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (3, a), (None, c), (None, c), (None, c), (None, a), (7, c + " end"), (9, "alone here"), (9, "other words"), (None, "lone text"), (11, None), (None, ""), (12, " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted((k or 0, t or "") for k, t in brute_kept(rows)) and (7, c + " end") in kept and (11, "") in kept


def test_near_texts_are_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(80, 300))
        # A chain: each copy edits the one before, so the ends are unlike but one component.
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows), " ".join(base)))
            base = [*base]
            for _ in range(rng.randint(0, 5)):
                base[rng.randrange(len(base))] = rng.choice(words)
    rows += [(100 + i, t) for i, t in enumerate(["", "one", "one two", "One  two", "three words here"])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    want = sorted(k for k, _ in brute_kept(rows))
    # The recall of links is 0.9 and more at a similarity of 0.8; no text goes that is like none that stays.
    assert set(want) <= set(got) and len(got) <= len(want) + 1


def test_enough_segments():
    assert simhash.segment_count(22, 0.8, 0.9) == 17 and simhash.segment_count(22, 0.9, 0.9) < 10 and simhash.segment_count() == 20
    rng = np.random.default_rng(1)
    apart = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 450, dtype=np.uint64)
        y = np.concatenate([x[:400], rng.integers(0, 2**63, 50, dtype=np.uint64)])
        a, b = (simhash.segments_of(np.unique(h), 17, 22) for h in (x, y))
        apart.append(sum(int(i ^ j).bit_count() for i, j in zip(a, b)) / (17 * 22))
    assert abs(np.mean(apart) - simhash.differing_share(0.8)) < 0.01


def test_short_near_texts_are_all_found(spark):
    """Pairs at a similarity of just 0.8 and above, of 1 to 50 shingles: the prefix filter loses none."""
    rng = random.Random(5)
    rows = []
    for n in range(1, 51):
        base = [f"t{n}w{i}" for i in range(n + 4)]
        # The last words only: each that goes takes one shingle along.
        rows += [(10 * n, " ".join(base)), (10 * n + 1, " ".join(base[: len(base) - n // 5])), (10 * n + 2, " ".join(base[: len(base) - n // 5 - 1])), (10 * n + 3, " ".join([*base[:-1], "other"]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == sorted(k for k, _ in brute_kept(rows))


def test_short_texts_do_not_meet_by_a_common_line(spark, monkeypatch):
    """Texts that share a line of their own each have rarer shingles; only copies of one text with few changes are in buckets, and all of them are found."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5_000)]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(3)]
    rows = []
    for i in range(300):
        own = rng.choices(words, k=rng.randint(9, 35))
        rows.append((len(rows), f"{lines[i % 3]} {' '.join(own)}" if i % 2 else f"{' '.join(own)} {lines[i % 3]}"))
        if i < 40:
            # One word less or another at an end: above 0.8 for some, below for others.
            own = own[1:] if rng.random() < 0.5 else [*own[:-1], "other"]
            rows.append((len(rows), f"{lines[i % 3]} {' '.join(own)}" if i % 2 else f"{' '.join(own)} {lines[i % 3]}"))
    rows += [(len(rows) + i, t) for i, t in enumerate([*lines, lines[0] + " more", "more " + lines[1]])]
    sizes = []

    def kept(df):
        found = simhash_written(df)
        if "bucket" in df.columns and "one" in df.columns and "root" not in df.columns:
            sizes.extend(r["count"] for r in found[0].groupBy("bucket").count().collect())
        return found

    simhash_written = simhash.written
    monkeypatch.setattr(simhash, "written", kept)
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted(k for k, _ in brute_kept(rows)) and len(got) < len(rows)
    assert sizes and max(sizes) <= 4


def test_buckets_of_a_bit_hold_both_values(spark, monkeypatch):
    """Near copies with equal segments are in the segment's first bucket only, and one is left of them all the same."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(5_000)]
    base, rows = rng.choices(words, k=400), []
    for i in range(30):
        rows.append((i, " ".join([*base[: 390 + i % 10], f"end{i}"])))
    found = []

    def kept(df):
        out = simhash_written(df)
        if "bucket" in df.columns and "one" in df.columns and "root" not in df.columns:
            found.extend(tuple(r) for r in out[0].groupBy("bucket").agg(F.max("b"), F.count_distinct("one")).collect())
        return out

    simhash_written = simhash.written
    monkeypatch.setattr(simhash, "written", kept)
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()] == [0]
    assert found and all(b == 0 or values == 2 for _, b, values in found)


@pytest.mark.parametrize("size", [51, 60, 100, 300, 1000, 2000])
def test_recall_of_larger_texts(size):
    """Pairs at a similarity of just 0.8, one in the other and of like size: 0.9 and more meet in a bucket and pass the bits."""
    rng = np.random.default_rng(size)
    width, count = simhash.WIDTH, simhash.segment_count()
    p = simhash.differing_share(simhash.LEAST)
    most = int(count * width * p + simhash.DEVIATIONS * np.sqrt(count * width * p * (1 - p)))
    found, pairs = 0, 400 if size < 500 else 150
    for i in range(pairs):
        x = rng.integers(0, 2**63, size, dtype=np.uint64)
        held = -(-8 * size // 10) if i % 2 else -(-16 * size // 18)
        y = x[:held] if i % 2 else np.concatenate([x[:held], rng.integers(0, 2**63, size - held, dtype=np.uint64)])
        a, b = (simhash.segments_of(np.unique(h), count, width) for h in (x, y))
        apart = [int(u ^ v).bit_count() for u, v in zip(a.tolist(), b.tolist())]
        found += min(apart) <= 1 and sum(apart) <= most
    # Two deviations of the measurement are allowed for.
    assert found / pairs >= 0.9 - 2 * (0.09 / pairs) ** 0.5


def test_unlike_texts_do_not_meet_by_chance(spark, monkeypatch):
    """Of 2,000 texts without a shingle in common none is in a bucket with another; by 23 bits alone about 100 pairs are."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5_000)]
    rows = [(i, " ".join(rng.choices(words, k=70))) for i in range(2_000)]
    members = []

    def kept(df):
        found = simhash_written(df)
        if "bucket" in df.columns and "one" in df.columns and "root" not in df.columns:
            members.append(found[0].count())
        return found

    simhash_written = simhash.written
    monkeypatch.setattr(simhash, "written", kept)
    assert simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == len(rows)
    assert members == [0]


@pytest.mark.parametrize("size", [51, 60, 100, 300, 1000, 2000])
def test_recall_of_marked_segments(size):
    """Pairs at a similarity of just 0.8, one in the other and of like size: 0.9 and more have a segment of equal mark that differs in one bit at most, and pass the bits."""
    rng = np.random.default_rng(size + 1)
    width, count = simhash.MARKED, simhash.segment_count(simhash.MARKED, shared=simhash.SHARED)
    p = simhash.differing_share(simhash.LEAST)
    most = int(simhash.BITS * p + simhash.DEVIATIONS * np.sqrt(simhash.BITS * p * (1 - p)))
    found, pairs = 0, 400 if size < 500 else 150
    for i in range(pairs):
        x = rng.integers(0, 2**63, size, dtype=np.uint64)
        held = -(-8 * size // 10) if i % 2 else -(-16 * size // 18)
        y = x[:held] if i % 2 else np.concatenate([x[:held], rng.integers(0, 2**63, size - held, dtype=np.uint64)])
        a, b = (simhash.bits_of(np.unique(h), simhash.BITS) for h in (x, y))
        m = simhash.marks_of(np.unique(x), count) == simhash.marks_of(np.unique(y), count)
        apart = (a != b)[: count * width].reshape(count, width).sum(1)
        found += any(m & (apart <= 1)) and sum(a != b) <= most
    # Two deviations of the measurement are allowed for.
    assert found / pairs >= 0.9 - 2 * (0.09 / pairs) ** 0.5


def test_passages_of_equal_and_null_ids(spark):
    passage, long = (" ".join(f"{x}{i}" for i in range(60)) for x in "pq")
    rows = [(1, f"one {passage}"), (None, f"clean words only {' '.join(f'k{i}' for i in range(200))}"), (None, "short"), (None, f"a b c {passage} end"), (4, f"{passage} left"), (4, "tiny"), (4, f"x {long}"), (8, f"y {long} z"), (8, f"y {long} z"), (8, "few words")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in suffix_dedup.drop_repeats(docs).collect())
    gone = {3: "a b c end", 4: "left", 7: "y z"}
    # Of the two equal rows the later is repeated as a whole.
    assert got == sorted((k or 0, gone.get(i, t)) for i, (k, t) in enumerate(rows) if i != 8)
    found = sorted((r["doc_id"] or 0, [tuple(s) for s in r["spans"]]) for r in suffix_dedup.repeats(docs).collect())
    assert found == [(0, [(3, 63)]), (1, [(1, 61)]), (4, [(0, 60)]), (4, [(1, 61)]), (8, [(0, 62)]), (8, [(0, 62)])]


def final_plan(df):
    """The plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Behind a shuffle of few bytes, 64 times as many rows looked small to Spark and went through the driver."""
    df = spark.range(300).select(F.xxhash64("id").alias("bits"))
    plan = final_plan(simhash.link_fingerprints(df))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    nodes, links = spark.createDataFrame([(i, i) for i in range(9)], "node long, least long"), spark.createDataFrame([(i, i + 1) for i in range(5)], "left long, right long")
    assert "BroadcastHashJoin" in final_plan(components.label_components(nodes, links))
    monkeypatch.setattr(components, "BROADCAST_ROWS", 9)
    parts = components.label_components(nodes, links)
    assert "BroadcastHashJoin" not in final_plan(parts)
    assert sorted(tuple(r) for r in parts.collect()) == [(i, 0 if i < 6 else i, 0 if i < 6 else i) for i in range(9)]
