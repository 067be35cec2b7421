"""The pipeline's stages one by one against what they are to do."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import toxicity
from chatloom.llm.common import WORD

from test_python import brute_kept, brute_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("stages")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def test_columns(stages):
    names = list(stages)
    assert all(stages[n].columns == COLUMNS for n in names[:-1]) and "n_tokens" in stages[names[-1]].columns


def test_toxic_documents_go(spark, stages):
    docs = stages["documents"]
    model = toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.score(docs, model).where(F.col("toxic_score") < toxicity.THRESHOLD).collect()}
    assert {r["doc_id"] for r in stages["toxicity"].collect()} == want


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["toxicity"].collect()]
    assert sorted(r["doc_id"] for r in stages["near_duplicates"].collect()) == sorted(k for k, _ in brute_kept(rows))


def test_repeats_are_cut_as_by_brute_force(stages):
    before = {r["doc_id"]: r["text"] for r in stages["near_duplicates"].collect()}
    _, later = brute_spans(before, 50)
    want = {}
    for k, t in before.items():
        at = [(m.start(), m.end()) for m in WORD.finditer(t or "")]
        gone = later.get(k, set())
        if not gone or len(gone) < len(at):
            keep = [t[: at[0][0]] if at else t or ""] if t is not None else []
            want[k] = None if t is None else "".join([*keep, *(t[at[i][0] : at[i + 1][0] if i + 1 < len(at) else len(t)] for i in range(len(at)) if i not in gone)])
    assert {r["doc_id"]: r["text"] for r in stages["repeated_passages"].collect()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in stages["repeated_passages"].collect() if r["text"] != before[r["doc_id"]])


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls in every column, repeated rows, empty texts, extra columns with the operators' names, and no rows."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a b c", "en", "s1", 5), (1, "a b c", "en", "s1", 5), (None, None, None, None, None), (None, "x y", None, None, None), (2, "", "en", "s", 0), (3, f"head {passage} one", "de", "s1", 9), (4, f"{passage} two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen", None, "s2", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("_row", "_own", "_held", "_n", "_whole", "_last", "_edge", "_e", "node", "bucket", "left", "right", "segments", "row", "h", "tokens", "toxic_score", "toxic_evidence", "mix_epoch", "_new", "_cut"):
        docs = docs.withColumn(name, F.lit("clash"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, docs.limit(0)):
        now = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            folder = str(tmp_path / f"{name}-{start is docs}")
            stage(spark, now, str(tmp_path)).write.parquet(folder)
            now = spark.read.parquet(folder)
            assert i == len(corpus_pipeline.STAGES) - 1 or now.columns == docs.columns
            assert start is docs or now.count() == 0
            assert i == len(corpus_pipeline.STAGES) - 1 or all(v == "clash" for r in now.select(*docs.columns[5:]).collect() for v in r)
            if start is docs and name == "near_duplicates":
                # The null and the empty text are copies, and so are the repeated rows.
                assert sorted((r["doc_id"] or 0, r["text"] or "") for r in now.collect()) == sorted((k or 0, t or "") for k, t in {r[:2]: 0 for r in rows if r[0] or r[1]})
            if start is docs and name == "repeated_passages":
                assert {r["text"] for r in now.collect() if r["doc_id"] == 4} == {rows[6][1][len(passage) + 1 :]}
        assert start is not docs or now.count() >= 1


def test_mix_and_encoding(stages):
    mixed = stages["mixing"].collect()
    known = {r["doc_id"] for r in stages["repeated_passages"].collect()}
    assert mixed and {r["doc_id"] for r in mixed} <= known
    want = sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in mixed)
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in stages["encoding"].collect()) == want


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == stages["encoding"].count()
