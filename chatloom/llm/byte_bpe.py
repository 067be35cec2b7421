"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Every match of the tokenizer's pattern is a word. A partition looks up its new words:
their bytes become rows of place (word and position) and token, which a recursive
query joins with the merge table, each round contracting every word's leftmost pair of
the least rank, until no pair is left. A word that is in the vocabulary starts as its
own token. Aggregations ordered by place give ids and decode all of them. Words
repeat, so a worker remembers them within a bound in bytes.

A long word is encoded by overlapping windows. A row of tokens is the encoding of its
bytes exactly if each two neighbours are that of theirs (merges inside two neighbours
go on as if they stood alone, up to a first merge across), so two windows that share
one token in their overlap are joined at it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import read, small_batches, tidy

#: Bytes of the words that a worker remembers (twice that much is held); bytes of new words and rows of one query; rounds of one query.
REMEMBERED_BYTES, QUERY_BYTES, QUERY_ROWS, ROUNDS = 24 << 20, 150_000, 1_500_000, 64
#: What a remembered word takes besides its own bytes (key, pair and dictionary entry).
ENTRY_BYTES = 300
#: Words of more bytes are encoded by windows of so many bytes, half of which overlap.
WINDOW = 256

#: Rows that change no more stay at the step of their word's last contraction. Rows come
#: out of the join as they went in, so a window without order sees them by place; where
#: they did not, the query ends in an error and is asked again with an ordered window.
ROUND = """
with recursive walk(step, place, tok) as (
  select 0, place, tok from start
  union all
  (with next as (select place, tok, lead(tok) over ({order}) as nxt, lead(place) over ({order}) as nplace from walk),
   pairs as (select place, tok, nxt, case when nplace <= place then error('out of order')::bigint else nplace end as nplace from next),
   best as (
     select place >> 32 as word, min(code + (place & 4294967295)) as least, arg_min(nplace, code + (place & 4294967295)) as gone
     from pairs join merges on l = tok and r = nxt where nplace >> 32 = place >> 32 group by 1),
   spots as (select word, (least >> 32)::integer as merged, (word << 32) + (least & 4294967295) as spot, gone from best)
   select step + 1, place, case when place = spot then merged else tok end
   from walk join spots on place >> 32 = word
   where place <> gone and step < {rounds}))
select place, tok, walk.step
from walk semi join (select place >> 32 as word, max(step) as last from walk group by 1) on walk.place >> 32 = word and walk.step = last
"""
#: Words of one ordered aggregation: a power of two.
TOGETHER = 12


class WordCodec:
    """Encodes and decodes single words by the ranks of a vocabulary file of base64 tokens and ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}
        self.size = 0
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.token_bytes[list(ranks.values())] = [len(t) for t in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        vocabulary = pa.table({"rank": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.db.register("vocabulary_rows", vocabulary)
        self.db.execute("create table vocabulary as select * from vocabulary_rows")
        self.db.unregister("vocabulary_rows")
        # Every way to cut a token into two tokens is a pair that may be merged to it.
        self.db.execute("""
            create table merges as
            select a.rank as l, b.rank as r, v.rank::bigint * 4294967296 as code
            from (select rank, hex, unnest(range(2, length(hex), 2)) as cut from vocabulary) v
            join vocabulary a on a.hex = v.hex[1:cut] join vocabulary b on b.hex = v.hex[cut + 1:]""")

    def _tokens(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place, token) of all pieces when no pair is left, in order of place; many rounds take several queries."""
        whole = [self.ranks.get(p) for p in pieces]
        raw = np.frombuffer(b"".join(p for p, w in zip(pieces, whole) if w is None), np.uint8)
        sizes = np.array([1 if w is not None else len(p) for p, w in zip(pieces, whole)])
        starts = np.cumsum(sizes) - sizes
        place = np.repeat((np.arange(len(pieces), dtype=np.int64) << 32) - starts, sizes) + np.arange(sizes.sum(), dtype=np.int64)
        tok = np.empty(len(place), np.int32)
        own = np.repeat(np.array([w is not None for w in whole]), sizes)
        tok[own] = [w for w in whole if w is not None]
        tok[~own] = self.byte_rank[raw]
        done = []
        while len(place):
            self.db.register("start", pa.table({"place": place, "tok": tok}))
            query = "create or replace temp table state as " + ROUND
            try:
                self.db.execute(query.format(rounds=ROUNDS, order=""))
            except duckdb.InvalidInputException:
                self.db.execute(query.format(rounds=ROUNDS, order="order by place"))
            done.append(self.db.execute(f"select place, tok from state where step < {ROUNDS}").fetchnumpy())
            more = self.db.execute(f"select place, tok from state where step >= {ROUNDS}").fetchnumpy()
            place, tok = np.asarray(more["place"]), np.asarray(more["tok"])
        place = np.concatenate([np.asarray(d["place"]) for d in done])
        tok = np.concatenate([np.asarray(d["tok"]) for d in done])
        order = np.argsort(place, kind="stable")
        return place[order], tok[order]

    def _stitched(self, size: int, windows: list[tuple[int, np.ndarray]]) -> np.ndarray | None:
        """The tokens of a long word from those of its windows (first byte, tokens); None where two share no token."""
        out: list[np.ndarray] = []
        begin, tokens = windows[0]
        ends = begin + np.cumsum(self.token_bytes[tokens])
        at = 0
        for begin, other in windows[1:]:
            other_ends = begin + np.cumsum(self.token_bytes[other])
            starts, other_starts = np.r_[ends[0] - self.token_bytes[tokens[0]], ends[:-1]], np.r_[begin, other_ends[:-1]]
            # A place in 32 bits and the bytes of a token (fewer than 2^12) in one number.
            both, i, j = np.intersect1d((starts[at:] << 12) + ends[at:] - starts[at:], (other_starts << 12) + other_ends - other_starts, assume_unique=True, return_indices=True)
            if not len(both):
                return None
            out.append(tokens[at : at + i[0]])
            tokens, ends, at = other, other_ends, int(j[0])
        out.append(tokens[at:])
        joined = np.concatenate(out)
        return joined if int(self.token_bytes[joined].sum()) == size else None

    def _encoded(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The tokens of each piece, by queries of bounded size."""
        sizes = np.array([len(p) for p in pieces])
        rows = sizes * np.minimum(sizes, ROUNDS) // 2 + sizes
        load = np.maximum(np.cumsum(sizes) / QUERY_BYTES, np.cumsum(rows) / QUERY_ROWS)
        cuts = np.flatnonzero(np.diff(load.astype(np.int64))) + 1
        out: list[np.ndarray] = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pieces)]):
            place, tok = self._tokens(pieces[a:b])
            out += np.split(tok, np.searchsorted(place >> 32, np.arange(b - a - 1), side="right"))
        return out

    def _ask(self, words: list[str], window: int = WINDOW) -> None:
        """Makes ``known`` have the words."""
        raws = [w.encode("utf-8") for w in words]
        long = [k for k, raw in enumerate(raws) if len(raw) > 2 * window]
        if len(long) < len(raws):
            held = set(long)
            short = [k for k in range(len(raws)) if k not in held] if held else range(len(raws))
            self._remember([words[k] for k in short], self._encoded([raws[k] for k in short]))
        for k in long:
            raw = raws[k]
            at = range(0, len(raw) - window // 2, window // 2)
            own = self._stitched(len(raw), [*zip(at, self._encoded([raw[i : i + window] for i in at]))])
            self._remember([words[k]], self._encoded([raw]) if own is None else [own])

    def _remember(self, words: list[str], found: list[np.ndarray]) -> None:
        tokens = np.concatenate(found)
        counts = np.array([len(f) for f in found])
        decoded = self._decoded(np.repeat(np.arange(len(found), dtype=np.int64), counts), tokens)
        ids = tokens.astype("<u4").tobytes()
        a = x = 0
        for w, e, y in zip(words, (4 * np.cumsum(counts)).tolist(), np.cumsum(self.token_bytes[tokens])[np.cumsum(counts) - 1].tolist()):
            self.known[w] = (ids[a:e], decoded[x:y])
            self.size += ENTRY_BYTES + e - a + 2 * (y - x)
            a, x = e, y

    def _decoded(self, word: np.ndarray, tokens: np.ndarray) -> bytes:
        """The bytes of all tokens, by aggregations of many words ordered by place."""
        self.db.register("final", pa.table({"place": np.arange(len(tokens), dtype=np.int64), "part": word >> TOGETHER, "tok": tokens.astype(np.int32)}))
        rows = self.db.execute("select count(*)::bigint, string_agg(hex, '' order by place) from final join vocabulary on tok = rank group by part order by part").fetchall()
        if sum(n for n, _ in rows) != len(tokens):
            raise ValueError("an id is not in the vocabulary")
        return b"".join(bytes.fromhex(h) for _, h in rows)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a list of ids; an id outside the vocabulary is an error."""
        return self._decoded(np.arange(len(ids), dtype=np.int64), np.array(ids, np.int64)) if ids else b""

    def learn(self, words: set[str]) -> None:
        """Makes ``known`` have the words. When it has grown too large, those go that were not asked for since the last time."""
        if self.size > REMEMBERED_BYTES:
            self.before, self.known, self.size = self.known, {}, 0
        before, known = self.before, self.known
        new = []
        for w in words:
            if w not in known:
                if w in before:
                    pair = known[w] = before[w]
                    self.size += ENTRY_BYTES + len(pair[0]) + 2 * len(pair[1])
                else:
                    new.append(w)
        for at in range(0, len(new), 1 << 16):
            self._ask(new[at : at + (1 << 16)])

    def forget(self) -> None:
        """Drops all remembered words: a worker may go on to other work."""
        self.known, self.before, self.size = {}, {}, 0
        self.db.execute("drop table if exists state")
        for view in ("start", "final"):
            self.db.unregister(view)


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One for a worker's life; what it remembers is bounded and goes at the end of a partition."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def splitter(pattern: str) -> Callable[[str], list[str]]:
    r"""A function from a text to all matches of ``pattern`` (without groups).

    Over Latin-1 the classes \p{L}, \p{N}, \s and \S are lists of characters, which the
    faster standard library takes; other texts and patterns go to ``regex``.
    """
    every = regex.compile(pattern).findall
    kinds = {c: "".join(f"\\x{i:02x}" for i in range(256) if regex.match(c, chr(i))) for c in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, at = [], False, 0
    while at < len(pattern):
        token = next((t for t in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(t, at)), pattern[at : at + 2] if pattern[at] == "\\" else pattern[at])
        at += len(token)
        if token in kinds:
            out.append(kinds[token] if inside else f"[{kinds[token]}]")
        elif token == r"\S" and not inside:
            out.append(f"[^{kinds[chr(92) + 's']}]")
        elif token[0] == "\\" and token[1:].isalnum():
            return every
        else:
            inside = token == "[" or (inside and token != "]")
            out.append(token)
    try:
        latin = re.compile("".join(out)).findall
    except re.error:
        return every

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return latin(text)

    return split


#: Words of texts that are looked up together; a single text may have more.
WORDS_AT_ONCE = 120_000
ENCODED = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def encode_texts(path: str, pattern: str):
    """A pandas function from texts to ENCODED; null counts as empty."""

    @pandas_udf(ENCODED)
    @tidy
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        split, c = splitter(pattern), codec(path)
        for batch in texts:
            rows: list[tuple[int, str, str]] = []
            waiting: list[list[str]] = []
            n = 0
            for text in batch:
                waiting.append(split(text or ""))
                n += len(waiting[-1])
                if n > WORDS_AT_ONCE:
                    rows += _digests(c, waiting)
                    waiting, n = [], 0
            rows += _digests(c, waiting)
            yield pd.DataFrame(rows, columns=[f.name for f in ENCODED], index=batch.index)
        c.forget()

    return encode


def _digests(c: WordCodec, texts: list[list[str]]) -> list[tuple[int, str, str]]:
    c.learn(set().union(*texts))
    out = []
    for words in texts:
        pairs = [c.known[w] for w in words]
        ids = b"".join([p[0] for p in pairs])
        out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join([p[1] for p in pairs])).hexdigest()))
    return out


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to ``docs`` (columns of these names are replaced).

    The ids are those of the tiktoken library without special tokens; null texts count
    as empty and have no tokens. Every row is encoded by itself, repeated ones too, and
    long texts and words as a whole.
    """
    small_batches(docs.sparkSession)
    made = encode_texts(path, pattern)(F.col(text))
    kept = [c for c in docs.columns if c not in ENCODED.names]
    # A name that the input does not have.
    inner = "_" + max([*kept, "e"], key=len)
    return docs.withColumn(inner, made).select(*kept, f"{inner}.*")


def token_ids(path: str, pattern: str):
    """A pandas function from texts to arrays of ids."""

    @pandas_udf(ArrayType(LongType()))
    @tidy
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split, c = splitter(pattern), codec(path)
        for batch in texts:
            out = []
            for text in batch:
                words = split(text or "")
                c.learn(set(words))
                out.append(np.frombuffer(b"".join(c.known[w][0] for w in words), "<u4").astype(np.int64))
            yield pd.Series(out, index=batch.index)
        c.forget()

    return ids


def token_text(path: str):
    """A pandas function from arrays of ids to texts (bytes that are no UTF-8 are replaced)."""

    @pandas_udf(StringType())
    @tidy
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for batch in ids:
            yield pd.Series([c.decode(list(map(int, x))).decode("utf-8", "replace") if x is not None else None for x in batch], index=batch.index)

    return text


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """(path, pattern) of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, *public_vocabulary()).drop("text")
