"""Cutting oversized token sequences into overlapping pieces at natural places.

A cut ends a piece. The natural cuts are the ends of lines; how natural each is comes from the folded
places of a table of truncated trees. Dynamic programming over the cuts chooses those that minimise
cut penalties and unequal sizes, under the size limit and with the demanded overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.scratch import shuffled

#: Line-end tokens: two line breaks and one (fixed values of the vocabulary).
LINE_ENDS = (9, 10)
BLANK_LINE = 9
#: Indenting tokens and the spaces each stands for (fixed values of the vocabulary).
INDENTS = {7: 8, 11: 8, 12: 4, 13: 2, 14: 1}
#: Weight of unequal sizes against cut penalties; penalty of a cut within a line and of a shortened
#: overlap (parameters; natural cuts cost between 0 and 1).
UNEVEN, FORCED, SHORTENED = 2.0, 1000.0, 20.0
#: Kinds of line end: blank line or not, and the indent of the next line (0, 1-4, 5-8, more).
KINDS = 8


def line_ends(data: np.ndarray) -> np.ndarray:
    """The positions after which a line ends; the last one is the length of the data."""
    ends = np.flatnonzero((data == LINE_ENDS[0]) | (data == LINE_ENDS[1])) + 1
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    return ends


def kinds_of(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The kind of each line end (0 to KINDS - 1) by what precedes and what follows it."""
    width = np.zeros(len(ends), np.int64)
    going = np.ones(len(ends), bool)
    at = ends.copy()
    for _ in range(8):
        here = np.where(at < len(data), data[np.minimum(at, len(data) - 1)], -1)
        step = np.zeros(len(ends), np.int64)
        for token, w in INDENTS.items():
            step[here == token] = w
        going &= step > 0
        width += np.where(going, step, 0)
        at = at + 1
    depth = np.searchsorted([1, 5, 9], width, side="right")
    return (data[ends - 1] == BLANK_LINE) * 4 + depth


def penalties(truncated: DataFrame) -> np.ndarray:
    """The penalty (0 to 1) of each kind of line end, from the folded places of truncated trees.

    ``truncated(tokens, descendants or parents, cutout_indices)``. A kind at which folds begin more
    often than it occurs as a line end costs less. The counts cover all trees and are a handful of
    numbers; without any tree every kind costs the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_n, folds_n = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.array([-1 if t is None else t for t in row["tokens"]], np.int64)
                parents = row["parents"]
                if parents is None or len(parents) != len(tokens) or not len(tokens):
                    continue
                inner = np.zeros(len(tokens), bool)
                p = np.array([-1 if x is None else x for x in parents])
                inner[p[(p >= 0) & (p < len(p))]] = True
                leaf = np.flatnonzero(~inner)
                data = tokens[leaf]
                ends = line_ends(data)
                kinds = kinds_of(data, ends)
                np.add.at(ends_n, kinds, 1)
                cut = np.array([c for c in row["cutout_indices"] if c is not None], np.int64)
                # the last line end at or before the fold, past its indentation
                place = np.searchsorted(leaf, cut)
                before = np.searchsorted(ends, place, side="right") - 1
                near = (before >= 0) & (place - ends[np.maximum(before, 0)] <= 6)
                np.add.at(folds_n, kinds[before[near]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(KINDS)), pa.array(ends_n), pa.array(folds_n)], names=["kind", "ends", "folds"])

    counted = truncated.where("tokens is not null and cutout_indices is not null").select("tokens", "parents", "cutout_indices")
    rows = counted.mapInArrow(run, "kind long, ends long, folds long").groupBy("kind").agg(F.sum("ends").alias("ends"), F.sum("folds").alias("folds")).collect()
    ends, folds = np.zeros(KINDS), np.zeros(KINDS)
    for r in rows:
        ends[r["kind"]], folds[r["kind"]] = r["ends"], r["folds"]
    rate = (folds + 0.5) / (ends + 1.0)
    return 1.0 - rate / rate.max()


def cut_places(data: np.ndarray, limit: int, overlap: int, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The pieces of one sequence: starts, ends, and whether a cut had to fall within a line.

    Every piece holds at most ``limit`` tokens. A piece starts ``overlap`` tokens before the end of
    the one before; only where a line would else have to be cut does it start later, as much as that
    line needs. Lines longer than the limit are cut into equal parts with the full overlap.
    """
    n = len(data)
    if n <= limit:
        return np.array([0]), np.array([n]), False
    overlap = max(0, min(overlap, limit - 1))
    stride = limit - overlap
    ends = line_ends(data)
    price = cost[kinds_of(data, ends)].astype(float)
    starts = np.concatenate([[0], ends[:-1]])
    forced = bool(((ends - starts) > limit).any())
    if forced:  # further places within the overlong lines, as few and as even as possible
        more = []
        for a, b in zip(starts[(ends - starts) > limit], ends[(ends - starts) > limit]):
            parts = -(-(b - a) // stride)
            more.append(a + np.round(np.arange(1, parts) * (b - a) / parts).astype(np.int64))
        extra = np.concatenate(more)
        ends, price = np.concatenate([ends, extra]), np.concatenate([price, np.full(len(extra), FORCED)])
        order = np.argsort(ends, kind="stable")
        ends, price = ends[order], price[order]
    ideal = n / max(1, -(-(n - overlap) // stride)) + overlap
    best = np.full(len(ends), np.inf)
    came = np.full(len(ends), -1)
    price[-1] = 0.0  # the end of the data is no cut
    for j in range(len(ends)):
        e = ends[j]
        if e <= limit:
            best[j] = price[j] + UNEVEN * ((e - min(ideal, n)) / limit) ** 2 * (j < len(ends) - 1)
            continue
        # places from which this one can be reached, with the whole overlap or a shortened one
        lo = np.searchsorted(ends, e - limit)
        prev = ends[lo:j]
        gap = np.maximum(0, (e - prev) - stride)
        size = np.minimum(e - prev + overlap, limit)
        uneven = UNEVEN * ((size - ideal) / limit) ** 2
        total = best[lo:j] + price[j] + (0.0 if j == len(ends) - 1 else uneven) + np.where(gap > 0, SHORTENED + gap / limit, 0.0)
        k = int(np.argmin(total))
        best[j], came[j] = total[k], lo + k
    path = []
    j = len(ends) - 1
    while j >= 0:
        path.append(j)
        j = came[j]
    stop = ends[path[::-1]]
    start = np.zeros(len(stop), np.int64)
    start[1:] = np.maximum(stop[:-1] - overlap, stop[1:] - limit)
    return start, stop, forced


PIECES = "file_id long, piece int, start int, stop int, n_pieces int, cut string"


def pieces(files: DataFrame, limits: DataFrame, cost: np.ndarray) -> DataFrame:
    """The pieces of every oversized sequence: ``file_id, piece, start, stop, n_pieces, cut``.

    ``files(file_id, data, language)`` with ``language`` a canonical name or ``any``, and
    ``limits(language, max_tokens, overlap)`` (a handful of rows, broadcast). Sequences within the
    limit, null data, null file_ids and languages without a limit give no rows. Of several rows of
    one file (redelivered) the newest by ``ingested_at``, where that column is given, counts, and of
    equally new ones the longest; it is chosen by key, time and size alone. ``cut`` is ``forced`` if a
    line is longer than the limit, else ``clean``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, limit, overlap = (np.asarray(batch.column(k)) for k in (0, 2, 3))
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            cuts: list[str] = []
            for i in range(batch.num_rows):
                data = np.asarray(batch.column(1)[i].values.fill_null(-1)).astype(np.int64)
                start, stop, forced = cut_places(data, int(limit[i]), int(overlap[i]), cost)
                m = len(start)
                for c, v in zip(cols, (np.full(m, ids[i]), np.arange(m, dtype=np.int32), start.astype(np.int32), stop.astype(np.int32), np.full(m, m, np.int32))):
                    c.append(v)
                cuts += ["forced" if forced else "clean"] * m
            if cuts:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in cols), pa.array(cuts)], names=["file_id", "piece", "start", "stop", "n_pieces", "cut"])

    time = F.col("ingested_at") if "ingested_at" in files.columns else F.lit(0)
    mark = F.struct(time.alias("t"), F.size("data").alias("n"), "language", F.xxhash64("data").alias("h"))
    marked = files.where("file_id is not null").withColumn("mark", mark)
    several = marked.groupBy("file_id").agg(F.max("mark").alias("best"), F.count("*").alias("rows")).where("rows > 1").select(F.col("file_id").alias("again"), "best")
    big = marked.join(F.broadcast(limits.select("language", "max_tokens", "overlap")), "language")
    big = big.where("size(data) > max_tokens").join(shuffled(several), F.col("file_id") == F.col("again"), "left").where("again is null or mark = best")
    big = big.select("file_id", "data", F.greatest("max_tokens", F.lit(1)).cast("long"), F.coalesce("overlap", F.lit(0)).cast("long"))
    return big.mapInArrow(run, PIECES).dropDuplicates(["file_id", "piece"])
