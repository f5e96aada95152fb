"""Encoding a corpus with a byte-level BPE by speculation and verification.

A word is first cut greedily into its longest known tokens. That guess is the encoding exactly if
every single token encodes to itself and every adjacent pair of tokens encodes to that pair, so all
pairs of a batch are looked up at once in a table of verified pairs; pairs not yet in the table are
verified by merging, once. Only the words with a failing pair are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: The word pattern that the vocabulary's tokenizer is defined with (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept in a worker's memory; beyond it the table of words starts anew.
WORDS_KEPT = 150_000
#: From this length of a word on, merging goes through a heap instead of a scan.
LONG_WORD = 48


class SpeculativeBpe:
    """Encoder of one vocabulary given as lines of base64 bytes and rank."""

    def __init__(self, ranks_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest: dict[bytes, int] = {}
        for token in self.ranks:
            head = token[:2]
            self.longest[head] = max(self.longest.get(head, 0), len(token))
        self.pairs: dict[int, bool] = {}
        self.selves: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.find = regex.compile(PATTERN).findall
        self.failed = self.seen = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact byte-pair merging: the lowest rank first, the leftmost of equal ranks."""
        if len(word) >= LONG_WORD:
            return self._merge_long(word)
        parts, ranks = [word[i : i + 1] for i in range(len(word))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        n, ranks = len(word), self.ranks
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or end[i] != j or not alive[j] or end[j] != k:
                continue
            alive[j], end[i] = False, k
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def guess(self, word: bytes) -> list[int]:
        """The longest known token at each place."""
        out, i, n, ranks, longest = [], 0, len(word), self.ranks, self.longest
        while i < n:
            stop = min(n, i + longest.get(word[i : i + 2], 1))
            while stop > i + 1 and word[i:stop] not in ranks:
                stop -= 1
            out.append(ranks[word[i:stop]])
            i = stop
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words not seen so far and keep their ids."""
        raw = [w.encode() for w in words]
        guesses = [self.guess(b) for b in raw]
        lens = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((i for g in guesses for i in g), np.int64, int(lens.sum()))
        ends = np.cumsum(lens)
        for t in np.unique(flat):
            if t not in self.selves:
                self.selves[int(t)] = self.merge(self.bytes_of[int(t)]) == [t]
        bad_token = ~np.array([self.selves[t] for t in flat.tolist()], bool) if len(flat) else np.zeros(0, bool)
        bad = np.add.reduceat(bad_token, ends - lens) > 0 if len(flat) else np.zeros(0, bool)
        if len(flat) > 1:
            inside = np.ones(len(flat) - 1, bool)
            inside[ends[:-1] - 1] = False
            codes = (flat[:-1] << 20 | flat[1:])[inside]
            owner = np.repeat(np.arange(len(words)), lens)[:-1][inside]
            kinds, which = np.unique(codes, return_inverse=True)
            fits = np.fromiter((self._fits(int(c)) for c in kinds), bool, len(kinds))
            bad[owner[~fits[which]]] = True
        self.seen += len(words)
        for k in np.flatnonzero(bad):
            guesses[k] = self.merge(raw[k])
            self.failed += 1
        if len(self.words) + len(words) > WORDS_KEPT:
            self.words.clear()
        self.words.update(zip(words, guesses))

    def _fits(self, code: int) -> bool:
        ok = self.pairs.get(code)
        if ok is None:
            a, b = code >> 20, code & 0xFFFFF
            ok = self.pairs[code] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of the texts; null and empty texts give no ids."""
        flat: list[int] = []
        offsets = [0]
        group: list[list[str]] = []
        held = 0

        def close() -> None:
            new = list({w for words in group for w in words}.difference(self.words))
            kept: dict[str, list[int]] = self.words
            if new:
                # learn() may start the table anew, so the batch's own words are passed in full then
                if len(self.words) + len(new) > WORDS_KEPT:
                    self.words.clear()
                    new = list({w for words in group for w in words})
                self.learn(new)
                kept = self.words
            for words in group:
                for w in words:
                    flat.extend(kept[w])
                offsets.append(len(flat))
            group.clear()

        for text in texts:
            group.append(self.find(text) if text else [])
            held += len(group[-1])
            if held > 200_000:
                close()
                held = 0
        close()
        return np.array(flat, np.int32), np.array(offsets, np.int64)


_loaded: dict[int, SpeculativeBpe] = {}


def encoder_of(ranks_file: bytes) -> SpeculativeBpe:
    """The encoder of a vocabulary, built once in a worker."""
    key = hash(ranks_file)
    if key not in _loaded:
        _loaded[key] = SpeculativeBpe(ranks_file)
    return _loaded[key]


def ship_vocabulary(spark: SparkSession, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """The vocabulary file as a broadcast; its size is fixed (under 1 MB)."""
    with open(f"{folder}/{name}", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", *, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per row of ``df``: its key and ``ids``, the token ids of its text.

    No special tokens are added, and strings that look like them are ordinary text. A null text and
    an empty text give an empty array. Further columns are not read. A null key stays null; repeated
    keys stay repeated rows.
    """
    shipped = ship_vocabulary(df.sparkSession, folder, name)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                flat, offsets = coder.encode_batch(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["k", "ids"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)
    return out.select(F.col("k").alias(key), "ids")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", *, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The number of tokens of each row's text (0 for null and empty), without keeping the ids."""
    return encode(df, key, text, folder=folder, name=name).select(key, F.size("ids").cast("long").alias("n_tokens"))
