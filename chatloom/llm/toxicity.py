"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of the examples is a term; document frequencies are counted over all
documents. A term weighs more, the less likely by chance it is that its presence in
the examples differs so much between labels; none is left out. Examples stand in
blocks of like ones, and a posting list knows its greatest weight in each block. A
text sums these up to a bound for each block, reads the postings of the most promising
blocks, and then of those whose bound still reaches the K-th cosine: no other example
can be among the K nearest. The votes of the K, weighted by squared cosine, go through a curve
fitted on labelled documents that are no examples.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .calibration import Curve, fit_curve
from .common import cut, fold, read, small_batches, tidy
from .quality_classifier import label_weights, labelled_sample

#: Bound of the labelled sample for each label; nearest examples; examples in a block.
SAMPLE_ROWS, K, BLOCK = 4_000, 15, 64
THRESHOLD = 0.3
#: What the share of all examples weighs in a vote (in squared cosines).
PRIOR = 0.1
#: Terms shown as evidence; blocks that a search opens first.
WORDS, FIRST = 20, 8
#: Lower-cases A-Z and blanks all other ASCII characters but letters and digits.
_CLEAN = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of letters and digits (and all beyond ASCII), in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_CLEAN).split()


def gathered(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all entries of the rows, numbers of entries) in arrays that ``start`` parts."""
    n = start[rows + 1] - start[rows]
    return np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


@dataclass
class Index:
    """Bounded by the terms of 2 * SAMPLE_ROWS examples."""

    terms: dict[bytes, int]
    #: Inverse document frequency of each term, times its tie to the label.
    weights: np.ndarray
    #: Examples in order of blocks.
    ids: np.ndarray
    labels: np.ndarray
    #: Vectors: the entries (term, weight) of an example lie between its start and the next one's.
    start: np.ndarray
    at: np.ndarray
    w: np.ndarray
    k: int = K

    def __post_init__(self) -> None:
        order = np.argsort(self.at, kind="stable")
        places = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.start))
        self.places, self.posted = places[order], self.w[order]
        term = self.at[order].astype(np.int64)
        blocks = -(-len(self.ids) // BLOCK)
        #: Postings of one term in one block are a group: its block, first posting and greatest weight.
        group = term * max(blocks, 1) + self.places // BLOCK
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        self.group_block = (self.places[first] // BLOCK).astype(np.int64)
        self.group_start = np.r_[first, len(group)].astype(np.int64)
        self.group_top = np.maximum.reduceat(self.posted, first) if len(first) else np.empty(0, np.float32)
        self.lists = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        self.n_blocks = blocks

    def __reduce__(self):  # noqa: ANN204
        return Index, (self.terms, self.weights, self.ids, self.labels, self.start, self.at, self.w, self.k)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, how often each is in the text)."""
        terms, held = self.terms, Counter(words_of(text))
        known = [*(terms.keys() & held.keys())]
        at = np.array([terms[w] for w in known], np.int64)
        order = np.argsort(at)
        return at[order], np.array([held[w] for w in known], float)[order]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, unit weights) of a text; words that are in no example take no part."""
        at, n = self.counts(text)
        return at, unit(n, self.weights[at])

    def nearest(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the K nearest examples with a cosine above 0, nearest first; ties by id."""
        return self.nearest_to(*self.vector(text))

    def nearest_to(self, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at) or not len(self.ids):
            return np.empty(0, np.int64), np.empty(0)
        groups, n = gathered(self.lists, at)
        own, block = np.repeat(w, n), self.group_block[groups]
        bounds = np.bincount(block, own * self.group_top[groups], self.n_blocks)
        sums = np.zeros(len(self.ids))

        def read(opened: np.ndarray) -> None:
            some = opened[block]
            held, m = gathered(self.group_start, groups[some])
            sums[:] += np.bincount(self.places[held], np.repeat(own[some], m) * self.posted[held], len(sums))

        opened = np.zeros(self.n_blocks, bool)
        opened[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        read(opened)
        worst = float(np.partition(sums, -self.k)[-self.k]) if len(sums) > self.k else 0.0
        # An example that reaches the K-th cosine exactly may have a lesser id.
        more = ~opened & (bounds > 0) & (bounds >= worst - 1e-9)
        if more.any():
            read(more)
        worst = float(np.partition(sums, -self.k)[-self.k]) if len(sums) > self.k else 0.0
        may = np.flatnonzero((sums > 0) & (sums >= worst - 1e-9))
        cosines = np.round(sums[may], 12)
        best = np.lexsort((self.ids[may], -cosines))[: self.k]
        best = best[cosines[best] > 0]
        return may[best], cosines[best]

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic examples, each weighted by its squared cosine, and all examples' share by PRIOR: faint likeness says little. -1 where no example is near."""
        near = cosines * cosines
        return float(((near * self.labels[places]).sum() + PRIOR * self.labels.mean()) / (near.sum() + PRIOR)) if len(places) else -1.0

    def shared(self, at: np.ndarray, w: np.ndarray, places: np.ndarray) -> list[int]:
        """At most WORDS terms that add most to the cosines of the examples at ``places``."""
        held, _ = gathered(self.start, places)
        own = np.zeros(len(self.terms))
        own[at] = w
        term, added = self.at[held], own[self.at[held]] * self.w[held]
        found, which = np.unique(term[added > 0], return_inverse=True)
        sums = np.bincount(which, added[added > 0], len(found))
        return found[np.lexsort((found, -sums))[:WORDS]].tolist()


def unit(n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w = (1 + np.log(n)) * weights
    return w / np.sqrt((w * w).sum()) if len(w) else w


def ties(a: np.ndarray, m: np.ndarray, share: float) -> np.ndarray:
    """1 + how unlikely it is that ``a`` of the ``m`` examples with a term have label 1 (m times the divergence)."""

    def part(k: np.ndarray, of: float) -> np.ndarray:
        return k * np.log(np.maximum(k, 1) / np.maximum(m * of, 1e-12)) if of > 0 else np.zeros(len(k))

    return 1 + np.maximum(0, part(a, share) + part(m - a, 1 - share))


def counted(examples: list[tuple[int, int, str]], k: int = K) -> Index:
    """From (doc_id, label, text): an index whose vectors are still numbers of occurrences. Examples without words are near nothing and left out.

    Ids are as given and only told apart and ordered, so they may be of any type.
    """
    terms: dict[bytes, int] = {}
    rows = []
    for doc_id, label, text in sorted(examples):
        held = Counter(words_of(text))
        if held:
            rows.append((doc_id, label, [terms.setdefault(w, len(terms)) for w in held], [*held.values()]))
    ids, labels, at, n = zip(*rows) if rows else ((), (), (), ())
    start = np.cumsum([0, *map(len, at)])
    flat = [np.array([x for part in y for x in part], t) for y, t in ((at, np.int32), (n, np.float32))]
    return Index(terms, np.ones(len(terms)), np.array(ids), np.array(labels, float), start, *flat, k)


def weighted(index: Index, idf: np.ndarray) -> Index:
    """The index with weights from ``idf`` and the terms' ties to the label, and unit vectors; examples ordered by label and strongest term, so that blocks hold like ones."""
    if not len(index.ids):
        return index
    at, y = index.at, np.repeat(index.labels, np.diff(index.start))
    m, a = np.bincount(at, minlength=len(idf)).astype(float), np.bincount(at, y, len(idf))
    weights = idf * ties(a, m, float(index.labels.mean()))
    w = (1 + np.log(index.w)) * weights[at]
    w = (w / np.repeat(np.sqrt(np.add.reduceat(w * w, index.start[:-1])), np.diff(index.start))).astype(np.float32)
    strongest = np.array([at[i + w[i:j].argmax()] for i, j in zip(index.start, index.start[1:])])
    order = np.lexsort((np.arange(len(index.ids)), strongest, index.labels))
    held, n = gathered(index.start, order)
    return Index(index.terms, weights, index.ids[order], index.labels[order], np.r_[0, np.cumsum(n)], at[held], w[held], index.k)


RESULT = StructType([StructField("vote", DoubleType()), StructField("examples", ArrayType(StringType())), StructField("cosines", ArrayType(DoubleType())), StructField("words", ArrayType(StringType()))])


@dataclass
class Model:
    index: Index
    curve: Curve


def _judge(spark: SparkSession, index: Index, evidence: int):
    shared = spark.sparkContext.broadcast(index)
    names = spark.sparkContext.broadcast(list(index.terms) if evidence else [])

    @pandas_udf(RESULT)
    @tidy
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in texts:
            rows = []
            for text in batch:
                at, w = index.vector(text)
                places, cosines = index.nearest_to(at, w)
                words = [names.value[i].decode("utf-8", "replace") for i in index.shared(at, w, places[:evidence])] if evidence and len(places) else []
                rows.append((index.vote(places, cosines), [str(x) for x in index.ids[places[:evidence]]], cosines[:evidence].tolist(), words))
            yield pd.DataFrame(rows, columns=[f.name for f in RESULT], index=batch.index)

    return judge


def frequencies_of(docs: DataFrame, index: Index) -> np.ndarray:
    """How many documents have each term of the index: one array in each task, summed by term."""
    shared = docs.sparkSession.sparkContext.broadcast(index.terms)

    @tidy
    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = shared.value
        known, n = terms.keys(), np.zeros(len(terms), np.int64)
        for batch in batches:
            for text in batch["text"]:
                n[[terms[w] for w in known & set(words_of(text))]] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"term": at, "n": n[at]})

    # Bounded: one row for each term of the examples.
    got = docs.select("text").mapInPandas(held, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(index.terms))
    n[got["term"].to_numpy()] = got["n"].to_numpy()
    return n


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Examples from one part of the labelled sample, the curve from the other; frequencies from all of ``docs``."""
    small_batches(docs.sparkSession)
    sample = cut(labelled_sample(docs, labels, label, rows))
    examples = [tuple(r) for r in sample.where("part = 1").select("doc_id", "y", "text").collect()]
    # Without examples of both labels nothing can be told.
    index = counted(examples if len({y for _, y, _ in examples}) == 2 else [])
    del examples
    if index.terms:
        index = weighted(index, np.log((1 + docs.count()) / (1 + frequencies_of(docs, index))) + 1)
    fitted = sample.where("part = 0").select("y", _judge(docs.sparkSession, index, 0)("text")["vote"].alias("x")).toPandas()
    return Model(index, fit_curve(fitted["x"].to_numpy(float), fitted["y"].to_numpy(float), label_weights(labels, label, rows)))


def score(docs: DataFrame, model: Model, text: str = "text", evidence: int = 3) -> DataFrame:
    """Adds toxic_score (0 to 1) and toxic_evidence (vote, nearest examples, their cosines, words) to ``docs``.

    Texts without a term of the examples, null and empty ones included, have no near
    examples and the score of labelled texts without any. The words are those that add
    most to the cosines shown, WORDS at most.
    """
    curve = model.curve

    @pandas_udf(DoubleType())
    def calibrated(x: pd.Series) -> pd.Series:
        return pd.Series(curve(x.to_numpy(float)), index=x.index)

    return docs.withColumn("toxic_evidence", _judge(docs.sparkSession, model.index, evidence)(F.col(text))).withColumn("toxic_score", calibrated("toxic_evidence.vote"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
        F.array_join("toxic_evidence.examples", ",").alias("evidence"), F.array_join("toxic_evidence.words", ",").alias("evidence_words"),
    )
