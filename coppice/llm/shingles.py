"""Sets of hashed runs of consecutive items, computed over Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.functions.scratch import shuffled

#: A word: a run of ASCII letters, digits and underscores, or any other single character that is not white space.
WORD = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def runs_of(items: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``width`` consecutive items (ints)."""
    if len(items) < width:
        return np.zeros(0, np.int64)
    x = mixed(items.astype(np.int64).view(np.uint64) + _STEP)
    n = len(x) - width + 1
    h = x[:n].copy()
    for k in range(1, width):
        h = h * _STEP + x[k : k + n]
    return np.unique(mixed(h).view(np.int64))


class Words:
    """Maps the words of texts to 64-bit numbers, remembering the common ones."""

    def __init__(self, kept: int = 200_000):
        self.kept, self.seen = kept, {}

    def __call__(self, text: str) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.kept:
            seen.clear()
        out = []
        for w in WORD.findall(text):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, np.uint64).view(np.int64)


def leaves_of(tokens: np.ndarray, parents: np.ndarray | None, descendants: np.ndarray | None) -> np.ndarray:
    """The leaf tokens in order. Descendants decide; where they are missing or of another length,
    the parents do; where both are missing, every token is a leaf."""
    n = len(tokens)
    if descendants is not None and len(descendants) == n:
        return tokens[descendants == 0]
    if parents is not None and len(parents) == n:
        inner = np.zeros(n, bool)
        inner[parents[(parents >= 0) & (parents < n)]] = True
        return tokens[~inner]
    return tokens


def signature(h: np.ndarray) -> bytes:
    """A digest that is equal exactly for equal sets."""
    return xxhash.xxh3_128_digest(h.tobytes())


SET_SCHEMA = T.StructType([
    T.StructField("sig", T.BinaryType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("shingles", T.ArrayType(T.LongType())),
])


def _emit(keys: list[pa.Array], names: list[str], sets: list[np.ndarray | None]) -> pa.RecordBatch:
    keep = [k for k, s in enumerate(sets) if s is not None]
    take = pa.array(keep, pa.int64())
    full = [sets[k] for k in keep]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in full])]).astype(np.int32)
    flat = np.concatenate(full) if full else np.zeros(0, np.int64)
    arrays = [k.take(take) for k in keys]
    arrays += [pa.array([signature(s) for s in full], pa.binary()), pa.array(np.diff(offsets), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "sig", "n", "shingles"])


def text_sets(df: DataFrame, keys: list[str], text: str, *, width: int, least: int) -> DataFrame:
    """The shingle set of each text's words: ``keys, sig, n, shingles``. ``sig`` is equal exactly for
    equal sets. Rows with a null text or fewer than ``least`` words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = []
                for t in part.column(len(keys)).to_pylist():
                    w = words(t) if t else None
                    sets.append(runs_of(w, width) if w is not None and len(w) >= least else None)
                yield _emit([part.column(k) for k in range(len(keys))], keys, sets)

    schema = T.StructType([df.schema[k] for k in keys] + SET_SCHEMA.fields)
    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def planes(x: np.ndarray) -> bytes:
    """Numbers, compressed byte by byte: the upper bytes of small numbers take next to no room."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def from_planes(data: bytes, kind: type) -> np.ndarray:
    """What :func:`planes` was given."""
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def packed(items: np.ndarray, width: int) -> bytes:
    """The items that a set of runs comes from: an eighth of the room that the hashes take."""
    return bytes([width, items.itemsize]) + planes(items)


def unpacked(data: bytes) -> np.ndarray:
    """The set of runs of :func:`packed` items, as :func:`runs_of` makes it."""
    return runs_of(from_planes(data[2:], {4: np.int32, 8: np.int64}[data[1]]), data[0])


def tree_sets(df: DataFrame, keys: list[str], *, width: int, least: int, first_id: int) -> DataFrame:
    """The shingle set of each tree's leaf tokens (``tokens, parents, descendants``), without the ids
    below ``first_id``: ``keys, sig, n, packed``; :func:`unpacked` makes the set again. Rows with null
    tokens or fewer than ``least`` such leaves are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = [part.column(len(keys) + k) for k in range(3)]
                keep, sigs, sizes, data = [], [], [], []
                for i in range(part.num_rows):
                    tokens, parents, below = (np.asarray(c[i].values.fill_null(0)) if c[i].is_valid else None for c in cols)
                    leaves = None if tokens is None else leaves_of(tokens, parents, below)
                    leaves = None if leaves is None else leaves[leaves >= first_id]
                    if leaves is None or len(leaves) < least:
                        continue
                    s = runs_of(leaves, width)
                    keep.append(i)
                    sigs.append(signature(s))
                    sizes.append(len(s))
                    data.append(packed(leaves, width))
                take = pa.array(keep, pa.int64())
                arrays = [part.column(k).take(take) for k in range(len(keys))] + [pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "sig", "n", "packed"])

    schema = T.StructType([df.schema[k] for k in keys] + SET_SCHEMA.fields[:2] + [T.StructField("packed", T.BinaryType())])
    return df.select(*keys, "tokens", "parents", "descendants").mapInArrow(run, schema)


def classes(sets: DataFrame, key: str, newest: str | None, carried: tuple[str, ...] = ("n", "shingles")) -> tuple[DataFrame, DataFrame]:
    """Collapse equal sets: ``(members(key, rep), heads(rep, carried...))``.

    One row per key in members; of several deliveries of a key the one with the greatest ``newest``
    counts. ``rep`` is the smallest key of the class. Only signatures are shuffled to find the
    classes; what heads carry moves once for each class.
    """
    light = sets.select(key, "sig", *([newest] if newest else []))
    order = F.struct(newest, "sig") if newest else F.struct("sig")
    live = light.groupBy(key).agg(F.max_by("sig", order).alias("sig"))
    reps = live.groupBy("sig").agg(F.min(key).alias("rep"))
    members = live.join(shuffled(reps), "sig").select(key, "rep")
    heads = sets.select("sig", *[c for c in carried if c != "sig"]).dropDuplicates(["sig"]).join(shuffled(reps), "sig").select("rep", *carried)
    return members, heads
