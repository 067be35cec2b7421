"""Language identification by a convolutional network over bytes.

A text is lower-cased, and its UTF-8 bytes are cut into windows of fixed length. Filters
of several widths slide over a window; the greatest answer of each, rectified, goes into
a softmax over the languages. A text's scores are the mean over all its windows, weighted
by the bytes that each is first to hold. The network is trained in numpy on a bounded sample of labelled
documents; Spark applies it to batches of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered_columns, read, small_batches, tidy

#: Widths of filters, filters of each width, numbers that stand for a byte.
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4, 5), 12, 8
#: Bytes of a window and how many it shares with the next (the widest filter's less one); windows of a batch.
LENGTH, OVERLAP, BATCH = 256, max(WIDTHS) - 1, 16
#: Bounds of the sample: documents of a language, windows of a document (spread over all of it), languages (the most frequent).
SAMPLE_ROWS, SAMPLE_WINDOWS, LANGUAGES = 1_500, 2, 200
EPOCHS, RATE, MINIBATCH, SEED = 6, 0.01, 64, 13
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def windows(text: str, length: int = LENGTH, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """(windows, new bytes of each) over all of a text, so that every byte begins a place of one window; the last one is filled with zeros."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    step = length - overlap
    n = max(1, -(-len(raw) // step))
    filled = np.zeros(n * step + overlap, np.uint8)
    filled[: len(raw)] = raw
    at = np.arange(n) * step
    return np.lib.stride_tricks.sliding_window_view(filled, length)[at], np.minimum(step, np.maximum(len(raw) - at, 1))


@dataclass
class Network:
    """``embedded``: (256, EMBEDDED) numbers for each byte; ``filters``: (widest, EMBEDDED, filters of all widths), zero beyond a filter's width."""

    languages: list[str]
    embedded: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    base: np.ndarray

    def logits(self, held: np.ndarray) -> np.ndarray:
        best = slid(held, self.embedded, self.filters).max(1)
        return np.maximum(best + self.bias, 0) @ self.dense + self.base

    def identify(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its share; texts of all lengths, BATCH windows at a time."""
        sums, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        queue: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush() -> None:
            held, new, owner = (np.concatenate(part) for part in zip(*queue))
            for i in range(0, len(held), BATCH):
                part = slice(i, i + BATCH)
                np.add.at(sums, owner[part], self.logits(held[part]) * new[part, None])
            np.add.at(size, owner, new)
            queue.clear()

        for i, text in enumerate(texts):
            held, new = windows(text)
            queue.append((held, new, np.full(len(held), i)))
            waiting += len(held)
            if waiting >= BATCH:
                flush()
                waiting = 0
        if queue:
            flush()
        shares = softmax(sums / np.maximum(size, 1)[:, None])
        at = shares.argmax(1)
        return [self.languages[i] for i in at], shares[np.arange(len(at)), at].tolist()


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def slid(held: np.ndarray, embedded: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """The answers of all filters at all places of each window: (windows, places, filters)."""
    widest, size, n = filters.shape
    places = held.shape[1] - widest + 1
    numbers = embedded[held].reshape(len(held), -1)
    frames = np.lib.stride_tricks.sliding_window_view(numbers, widest * size, 1)[:, ::size]
    return (frames.reshape(-1, widest * size) @ filters.reshape(-1, n)).reshape(len(held), places, n)


def train_network(held: np.ndarray, labels: np.ndarray, languages: list[str], weights: np.ndarray, seed: int = SEED) -> Network:
    """Adam over minibatches of windows; the loss of a window counts by ``weights``."""
    draw = np.random.default_rng(seed)
    n, widest = len(WIDTHS) * FILTERS, max(WIDTHS)
    within = (np.arange(widest)[:, None] < np.repeat(WIDTHS, FILTERS)).astype(np.float32)[:, None, :]
    p = {
        "embedded": draw.normal(0, 0.5, (256, EMBEDDED)), "filters": draw.normal(0, 1, (widest, EMBEDDED, n)) * within / np.sqrt(within.sum(0) * EMBEDDED),
        "bias": np.zeros(n), "dense": draw.normal(0, 0.2, (n, len(languages))), "base": np.zeros(len(languages)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, total = 0, EPOCHS * -(-len(held) // MINIBATCH)
    for _ in range(EPOCHS):
        order = draw.permutation(len(held))
        for begin in range(0, len(order), MINIBATCH):
            some = order[begin : begin + MINIBATCH]
            x, y, case = held[some], labels[some], weights[some]
            answers = slid(x, p["embedded"], p["filters"])
            place = answers.argmax(1)
            hidden = np.take_along_axis(answers, place[:, None], 1)[:, 0] + p["bias"]
            active = np.maximum(hidden, 0)
            wrong = softmax(active @ p["dense"] + p["base"])
            wrong[np.arange(len(y)), y] -= 1
            wrong *= (case / case.sum())[:, None]
            back = (wrong @ p["dense"].T) * (hidden > 0)
            g = {"dense": active.T @ wrong, "base": wrong.sum(0), "bias": back.sum(0), "embedded": np.zeros_like(p["embedded"]), "filters": np.zeros_like(p["filters"])}
            for j in range(widest):
                seen = x[np.arange(len(x))[:, None], place + j]
                g["filters"][j] = np.einsum("nfe,nf->ef", p["embedded"][seen], back)
                np.add.at(g["embedded"], seen, back[:, :, None] * p["filters"][j].T)
            g["filters"] *= within
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for k in p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, p["embedded"], p["filters"], p["bias"], p["dense"], p["base"])


def labelled_windows(docs: DataFrame, rows: int = SAMPLE_ROWS, each: int = SAMPLE_WINDOWS) -> pd.DataFrame:
    """(lang, window) of at most ``rows`` documents of each of the LANGUAGES most frequent languages, at most ``each`` windows of a document.

    Documents are taken in the order of a hash; the windows of one lie at equal distances
    over the whole text. Only windows come to the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    # Rows of a small enough hash are about twice the sample, so that ranking a language never takes all its rows to one task.
    likely = known.join(F.broadcast(counts), "lang").where((F.col("count") <= 2 * rows) | (F.shiftrightunsigned("h", 1).cast("double") < F.lit(2.0**63) * (2 * rows) / F.col("count")))
    ranked = likely.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("nth") <= rows)

    @tidy
    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text, h in zip(batch["lang"], batch["text"], batch["h"]):
                if has_letter(text):
                    held, new = windows(text)
                    at = np.unique((np.arange(min(each, len(held))) + (h % 997) / 997) * len(held) // min(each, len(held))).astype(int)
                    out += [(lang, h, held[i].tobytes(), int(new[i])) for i in at]
            yield pd.DataFrame(out, columns=["lang", "h", "held", "new"])

    return ranked.select("lang", "text", "h").mapInPandas(taken, "lang string, h bigint, held binary, new bigint").toPandas().sort_values(["lang", "h", "held"])


def train(docs: DataFrame) -> Network | None:
    """The network of the languages of documents that are not held out; None where no labelled document has a letter.

    A single language is always predicted. Languages count alike, however many windows each has.
    """
    small_batches(docs.sparkSession)
    sample = labelled_windows(docs)
    if not len(sample):
        return None
    languages, labels = np.unique(sample["lang"].to_numpy(str), return_inverse=True)
    held = np.stack([np.frombuffer(w, np.uint8) for w in sample["held"]])
    weights = 1 / np.bincount(labels)[labels]
    return train_network(held, labels, languages.tolist(), weights.astype(np.float32))


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and lang_score (0 to 1) to ``docs``, in place of columns of these names.

    Null texts, empty ones and those without a letter are ``und`` with the score 0, as
    are all without a network. All windows of a text count, however long it is, and a
    tie goes to the lesser name.
    """
    small_batches(docs.sparkSession)
    originals = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    inner, names = numbered_columns(docs)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("lang_pred string, lang_score double")
    @tidy
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame({"lang_pred": UNKNOWN, "lang_score": 0.0}, index=texts.index)
            known = texts.map(has_letter).to_numpy(bool)
            if shared.value and known.any():
                out.loc[known, "lang_pred"], out.loc[known, "lang_score"] = shared.value.identify(texts[known].tolist())
            yield out

    said = inner.withColumn("told", told(F.col(names[text]).cast("string")))
    return said.select(*[F.col(names[c]).alias(c) for c in originals], "told.lang_pred", "told.lang_score")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
