"""Kd-tree clustering, Merkle manifest and language identification against SQL, brute force and edge cases."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import kd_clustering, language_id, merkle


def test_op11_same_as_sql(spark, sf, same):
    same(kd_clustering.op11_kd_clustering(spark, sf), kd_clustering.op11_sql())


def brute_clusters(rows, size, k, rounds, seed=2):
    """(key, cluster, distance) by comparing all vectors with all centroids."""
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in ok)
    centroids = [list(v) for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), z) for z, c in enumerate(centroids))

    for _ in range(rounds):
        own = [(nearest(v)[1], v) for _, v in ok]
        for z in range(len(centroids)):
            held = [v for y, v in own if y == z]
            if held:
                centroids[z] = [sum(x) // len(held) for x in zip(*held)]
    found = [(i, *nearest(v)[::-1]) for i, v in ok]
    within = {z: sum(d for _, y, d in found if y == z) for z in range(len(centroids))}
    return sorted((i is None, i or 0, z, d, within[z], sum(within.values()), hashlib.sha256(",".join(map(str, centroids[z])).encode()).hexdigest()) for i, z, d in found)


@pytest.mark.parametrize("scale", [0.01, 1.0, 300.0, 100_000.0])
def test_op11_brute_force_with_ties_and_copies(spark, scale):
    draw = np.random.default_rng(int(scale * 100))
    rows = [(i, [float(x) * scale for x in draw.integers(-2, 3, 3)]) for i in range(400)]  # few different places: many ties
    rows += [(i, [scale, scale, 0.0]) for i in range(400, 600)]  # a third of all rows is one vector
    rows += [rows[5], rows[5], (None, [0.5, 0.25, -scale]), (None, [0.5, 0.25, -scale]), (700, None), (701, []), (702, [1.0, 2.0]), (703, [1.0, None, 2.0]), (704, [float("nan"), 0.0, 0.0]), (705, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3).withColumns({n: F.lit("clash") for n in ("key", "components", "tree", "cluster", "inertia")})
    for block in (4096, 50):
        got = kd_clustering.cluster(df, size=3, k=7, rounds=3, block=block)[0].collect()
        assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == brute_clusters(rows, 3, 7, 3)


def test_op11_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0])], "vec_id bigint, embedding array<double>")
    rows = kd_clustering.cluster(df, size=2)[0].collect()
    assert len(rows) == 3 and all(r["distance"] == 0 and r["inertia"] == 0 for r in rows)
    empty, centroids = kd_clustering.cluster(df.where("vec_id > 9"), size=2)
    assert empty.columns == kd_clustering.cluster(df, size=2)[0].columns and empty.count() == 0 and not len(centroids)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert sum(r["distance"] for r in kd_clustering.cluster(huge, size=2, k=3, rounds=1)[0].collect()) == 0
    far = kd_clustering.cluster(huge, size=2, k=1, rounds=1)[0].collect()
    assert all(0 <= r["distance"] <= 1 << 56 for r in far)


def test_op11_trees_prune(spark):
    draw = np.random.default_rng(1)
    points = np.concatenate([draw.integers(0, 50, (500, 4)) + 1000 * z for z in range(4)])
    tree = kd_clustering.opened(kd_clustering.grown(np.arange(2000), np.ones(2000, bool), points))
    centroids = np.array([[1000 * z + 25] * 4 for z in range(4)])
    taken = list(kd_clustering.filtered(tree, centroids))
    assert all(at is None for _, at, _ in taken) and sum(len(n) for n, _, _ in taken) < 20
    assert (tree["counts"][0], *tree["sums"][0]) == (2000, *points.sum(0))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text): sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes, i, own):
        """(top, proof, folded) of node i of a tree whose digest is replaced by ``own``."""
        proof = []
        while len(nodes) > 1:
            pair = nodes[i // 2 * 2 : i // 2 * 2 + 2]
            proof += pair[: i % 2] + pair[i % 2 + 1 :]
            own = H(*pair[: i % 2], own, *pair[i % 2 + 1 :])
            nodes, i = [H(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)], i // 2
        return nodes[0], proof, own

    groups = {}
    for d, s, g, n, t in rows:
        leaf = H(*map(field, (d, s, g, n, t)))
        bad = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups.setdefault(g, []).append((d is not None, d or 0, leaf, H(*map(field, (d, s, g, n + 1, t))) if bad else leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort()
    subroots = [climb([x[2] for x in groups[g]], 0, "")[0] for g in names]
    out = []
    for place, g in enumerate(names):
        leaves = [x[2] for x in groups[g]]
        for i, (known, d, leaf, given) in enumerate(groups[g]):
            sub, low, own = climb(leaves, i, given)
            root, high, own = climb(subroots, place, own)
            out.append((known, d, leaf, sub, root, H(*low, *high), own, own == root))
    return sorted(out)


def manifest_rows(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


def query_of(spark, tmp_path, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return merkle.op12_merkle(spark, str(tmp_path))


def test_op12_same_as_sql(spark, sf, same):
    same(merkle.op12_merkle(spark, sf), merkle.op12_sql())


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_op12_brute_force_edges(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = [(i, f"s{i % 3}" if i % 5 else None, ["en", "de", "é", "", "z"][min(i % 7, 4)] if i % 11 else None, None if i % 13 == 0 else i, None if i % 17 == 0 else f"tëxt {i}" * (i % 4)) for i in range(75)]
    rows += [(3, "s", "en", 1, "other text of an id")] + [(9, "s", "en", 4, "copy")] * 40 + [(None, None, None, None, None)] * 3 + [(None, "s", "en", 2, "no id"), (500, "s", "alone", 9223372036854775807, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    df = df.withColumns({n: F.lit("clash") for n in ("tree", "key", "node", "extra", "place", "path", "leaf", "root")})
    found = manifest_rows(query_of(spark, tmp_path, df))
    assert found == brute_manifest(rows) and {x[-1] for x in found} == {True, False}


def test_op12_one_and_no_leaf(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", "en", 3, "abc")], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    (only,) = query_of(spark, tmp_path / "one", df).collect()
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"] and only["proof_sha256"] == H() and only["verified"]
    assert query_of(spark, tmp_path / "none", df.where("doc_id > 5")).count() == 0


def test_op12_stored_preimages_hash_to_the_root(spark, sf):
    made = merkle.document_manifest(spark.read.parquet(f"{sf}/documents.parquet"))
    stored = [p for r in made.preimages().collect() for level in r["levels"] for p in level]
    digests = {H(p): p for p in stored}
    assert made.root in digests
    leaves, todo = [], [made.root]
    while todo:
        d = todo.pop()
        if d in digests:
            todo += [digests[d][i : i + 64] for i in range(0, len(digests[d]), 64)]
        else:
            leaves.append(d)
    assert sorted(leaves) == sorted(r["leaf"] for r in made.proofs().collect())


def test_op13_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in language_id.op13_language_id(spark, sf).collect()]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(out) >= 0.95 * len(out) and all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def network():
    texts = {"aa": ["lorem ipsum dolor sit ", "amet consectetur elit "], "bb": ["über straße grün ", "schön mädchen größe "]}
    held, labels = [], []
    for y, lang in enumerate(texts):
        for i in range(100):
            w, _ = language_id.windows((texts[lang][i % 2] * (i % 9 + 1))[i % 5 :])
            held.append(w[0])
            labels.append(y)
    return language_id.train_network(np.stack(held), np.array(labels), list(texts), np.ones(200, np.float32))


def test_op13_edges(spark, network):
    texts = [None, "", " ", "123 !?", "lorem ipsum", "GRÜN STRASSE ÜBER", "12 größe", "lorem ipsum dolor " * 30_000, "1 " * 1000 + "schön mädchen größe " * 500, "本", "é"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(4, "lorem ipsum"), (None, "lorem ipsum")], "doc_id bigint, text string")
    df = df.withColumns({n: F.lit("clash") for n in ("told", "lang_score", "held", "in0", "lang")})
    rows = language_id.identify(df, network).collect()
    assert len(rows) == len(texts) + 2 and all(r["told"] == r["in0"] == r["lang"] == "clash" for r in rows)
    by = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in rows}
    assert all(by[i] == ("und", 0.0) for i in range(4)) and all(by[i][0] in ("aa", "bb") for i in range(4, len(texts)))
    assert by[4][0] == by[7][0] == by[None][0] == "aa" and by[5][0] == by[6][0] == by[8][0] == "bb"
    assert language_id.identify(df.limit(0), network).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}


def test_op13_windows_hold_every_byte(network):
    for n in (0, 1, 251, 252, 253, 256, 257, 504, 1000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        held, new = language_id.windows(text)
        assert b"".join(w.tobytes()[:252] for w in held).rstrip(b"\0").decode() == text and new.sum() == max(n, 1)
        assert held.shape[1] == 256
    assert language_id.windows("É")[0][0, :2].tobytes() == "é".encode()


def test_op13_batches_do_not_matter(network):
    texts = ["lorem ipsum " * k for k in range(1, 60)] + ["grün " * 999]
    together, alone = network.identify(texts), [network.identify([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone], atol=1e-5)


def test_op13_learns_from_what_is_left_and_labelled(spark):
    rows = [(i, "aaa bbb" if i % 2 else "ccc ddd", ["x", "y"][i % 2] if i % 3 else None) for i in range(60)] + [(100, "123", "digits"), (101, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = language_id.labelled_windows(docs, rows=5, each=2)
    assert sorted(sample["lang"].value_counts().items()) == [("x", 5), ("y", 5)]
    assert language_id.train(docs.where("lang is null")) is None
    assert language_id.train(docs.where("lang = 'x'")).languages == ["x"]
