"""Encoding texts with a public byte-level BPE: speculate, verify, and merge only what fails.

A text is cut into words by the tokenizer's pattern. For each word not met before, greedy longest match over the
vocabulary proposes tokens. A sequence of tokens is what BPE gives exactly if each adjacent pair is (BPE of the two
tokens' bytes joined gives the two back), so the proposals of a batch are checked by their distinct pairs at once, in
NumPy, against the pairs known to be compatible; pairs not met before are settled by exact merging once. Only words with
a pair that fails are merged exactly themselves. Words, pairs and their answers are kept per Python worker, in caches of
bounded size, so most words of a corpus cost one look-up.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The public pattern of this family of byte-level tokenizers, as documented with its vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: White space in which cutting at spaces alone would go wrong, and the single spaces where it is right.
_RUN, _SINGLE = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
#: Words and pairs kept per worker; beyond it the cache starts anew.
CACHE = 400_000
#: Words longer than this are encoded each time rather than kept.
LONG = 64


class BytePair:
    """Vocabulary of ranks: the id of a token is its rank, and lower ranks merge first."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.words = regex.compile(pattern).findall
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.size = max(self.bytes) + 1
        self.longest = max(map(len, self.ranks))
        self.first: dict[str, tuple[int, ...]] = {}  # chunks that begin a text
        self.rest: dict[str, tuple[int, ...]] = {}  # chunks after a single space, kept without it
        self.good = np.empty(0, dtype=np.int64)  # sorted codes of compatible pairs
        self.bad = np.empty(0, dtype=np.int64)

    def merge(self, data: bytes) -> list[int]:
        """Exact BPE of one word: merge the adjacent pair of lowest rank until none is left."""
        if data in self.ranks:
            return [self.ranks[data]]
        n = len(data)
        if n > 256:
            return self._merge_long(data)
        cuts = list(range(n + 1))
        ranks = self.ranks
        while len(cuts) > 2:
            best, at = None, -1
            for i in range(len(cuts) - 2):
                r = ranks.get(data[cuts[i] : cuts[i + 2]])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            del cuts[at + 1]
        return [ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same by a heap, in n log n, for very long words."""
        import heapq

        n, ranks = len(data), self.ranks
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or not alive[i] or end[j] != e:
                continue
            end[i], alive[j], after[i] = e, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := ranks.get(data[k : end[after[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n = [], 0, len(data)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (i := self.ranks.get(data[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def _pairs(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair code is compatible; unknown ones are settled by exact merging."""
        codes = np.unique(codes)
        known = np.isin(codes, self.good, assume_unique=True) | np.isin(codes, self.bad, assume_unique=True)
        fresh = codes[~known]
        if len(fresh):
            right = np.array([self.merge(self.bytes[c // self.size] + self.bytes[c % self.size]) == [c // self.size, c % self.size] for c in fresh.tolist()], dtype=bool)
            self.good = np.union1d(self.good, fresh[right])
            self.bad = np.union1d(self.bad, fresh[~right])
        return codes[np.isin(codes, self.good, assume_unique=True)]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The tokens of distinct words: proposed, verified pair by pair, merged exactly where a pair fails."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        tokens = [[self.ranks[d]] if d in self.ranks else self.propose(d) for d in data]
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        if not len(lengths) or lengths.max() < 2:
            return [tuple(t) for t in tokens]
        flat = np.fromiter((i for t in tokens for i in t), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(tokens)), lengths)
        inside = owner[:-1] == owner[1:]
        codes, of = (flat[:-1] * self.size + flat[1:])[inside], owner[:-1][inside]
        fails = np.unique(of[~np.isin(codes, self._pairs(codes))])
        for i in fails.tolist():
            tokens[i] = self.merge(data[i])
        return [tuple(t) for t in tokens]

    def _encode_chunks(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """The tokens of distinct chunks, through the words in them."""
        cut = [self.words(c) for c in chunks]
        order = list({w for ws in cut for w in ws})
        known = dict(zip(order, self.encode_words(order)))
        return [known[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable(map(known.__getitem__, ws))) for ws in cut]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, lengths) of a batch; null and empty texts have no ids.

        A single space between two marks always begins a word, so texts are cut there first; the chunks (with their
        space, but for a text's first) are what the cache holds.
        """
        cut = [[] if not t else t.split(" ") if not _RUN.search(t) else _SINGLE.split(t) for t in texts]
        if len(self.first) + len(self.rest) > CACHE:
            self.first, self.rest = {}, {}
        if len(self.good) + len(self.bad) > 8 * CACHE:
            self.good, self.bad = self.good[:0], self.bad[:0]
        first, rest = self.first, self.rest
        fresh = {c[0] for c in cut if c}.difference(first)
        if fresh:
            order = list(fresh)
            first.update(zip(order, self._encode_chunks(order)))
        fresh = set(chain.from_iterable(c[1:] for c in cut)).difference(rest)
        if fresh:
            order = list(fresh)
            rest.update(zip(order, self._encode_chunks([" " + c for c in order])))
        ids: list[int] = []
        lengths = np.zeros(len(texts), dtype=np.int64)
        get = rest.__getitem__
        for k, c in enumerate(cut):
            if c:
                start = len(ids)
                ids.extend(first[c[0]])
                ids.extend(chain.from_iterable(map(get, c[1:])))
                lengths[k] = len(ids) - start
        for kept in (first, rest):  # long chunks seldom come again
            for c in [c for c in fresh if len(c) > LONG and c in kept]:
                del kept[c]
        if any(c and len(c[0]) > LONG for c in cut):
            self.first = {c: t for c, t in first.items() if len(c) <= LONG}
        return np.array(ids, dtype=np.int32), lengths


_LOADED: dict[tuple[str, str], BytePair] = {}


def read_ranks(path: str = DEFAULT_RANKS) -> bytes:
    """The vocabulary file; about a megabyte."""
    with open(path, "rb") as f:
        return f.read()


def tokenizer(name: str, ranks: Callable[[], bytes], pattern: str = PATTERN) -> BytePair:
    """One tokenizer per worker process."""
    if (name, pattern) not in _LOADED:
        _LOADED[name, pattern] = BytePair(ranks(), pattern)
    return _LOADED[name, pattern]


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """(``doc_id``, ids) of each document, without special tokens.

    Null and empty texts get an empty list. A special token's string in a text is ordinary text. Texts of any length are
    encoded whole. Repeated rows are encoded each.
    """
    kind = documents.schema[doc_id].dataType
    sent = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks))  # executors need no copy of the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks, lambda: sent.value, pattern)
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                ids, lengths = bpe.encode_batch(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))], names=[doc_id, "ids"])

    schema = T.StructType([T.StructField(doc_id, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select(doc_id, text).mapInArrow(run, schema)


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """(``doc_id``, n_tokens) of each document, by the same encoding; null and empty texts have 0."""
    sent = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(ranks, lambda: sent.value, pattern)
        for b in batches:
            for start in range(0, len(b), 512):
                part = b.iloc[start : start + 512]
                yield pd.DataFrame({doc_id: part[doc_id], "n_tokens": bpe.encode_batch(part[text].tolist())[1]})

    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType())])
    return documents.select(F.col(doc_id), F.col(text)).mapInPandas(run, schema)
