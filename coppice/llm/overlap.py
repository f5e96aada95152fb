"""Records of evaluation splits that also stand in the training split.

Min-wise hashes of the word shingles, cut into bands, bring similar programs into common buckets.
Pairs across the splits that meet in several buckets are candidates; their exact Jaccard similarity
decides. Shingle sets are never stored: the sets of candidates are made again from their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.functions.scratch import dropped, shuffled, written
from coppice.llm.shingles import Words, classes, mixed, runs_of, signature, text_sets

#: Runs of four words; at least 20 words; similarity 6/10 (fixed by the task).
WIDTH, LEAST, NUM, DEN = 4, 20, 6, 10
#: Hashes a band, bands, and the bands that two programs must have in common. A pair of similarity 0.6
#: shares a band with probability 0.216 and is missed with probability 9e-7; of pairs of similarity
#: 0.2, three in a hundred are compared.
ROWS, BANDS, COMMON = 3, 80, 3


def band_keys(x: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """The bucket of a set of hashes in each band; the band is part of the bucket's number.

    The hashes are uniform already, so multiplying their upper halves by an odd number orders them anew."""
    factors = (mixed(np.arange(1, rows * bands + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = np.full(rows * bands, np.iinfo(np.uint32).max, np.uint32)
    upper = (x.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):  # bounded memory for very long texts
        low = np.minimum(low, np.multiply.outer(factors, upper[at : at + 1024]).min(axis=1))
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + low[k::rows])
    return h.view(np.int64)


def signed(df: DataFrame, *, width: int, least: int, rows: int, bands: int) -> DataFrame:
    """``index, collected_at, sig, n, bands`` of every program of at least ``least`` words: its set's
    signature and size, and its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            keep, sigs, sizes, keys = [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                w = words(t) if t else ()
                if len(w) < least:
                    continue
                s = runs_of(w, width)
                keep.append(i)
                sigs.append(signature(s))
                sizes.append(len(s))
                keys.append(band_keys(s, rows, bands))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            ends = pa.array(np.arange(len(keep) + 1) * bands, pa.int32())
            take = pa.array(keep, pa.int64())
            cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat))]
            yield pa.RecordBatch.from_arrays(cols, names=["index", "collected_at", "sig", "n", "bands"])

    fields = [df.schema["index"], df.schema["collected_at"], T.StructField("sig", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return df.where("index is not null").select("index", "collected_at", "code").mapInArrow(run, T.StructType(fields))


def overlap_classes(
    train: DataFrame, held_out: DataFrame, *, num: int = NUM, den: int = DEN, width: int = WIDTH, least: int = LEAST, rows: int = ROWS, bands: int = BANDS, common: int = COMMON
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(train members(index, rep), held-out members(index, rep), pairs(train_rep, eval_rep))``.

    ``train(index, code, collected_at)`` and ``held_out`` likewise, ``index`` unique over both apart
    from redelivered rows, of which the last counts. Equal sets are collapsed on each side before the
    buckets are joined. Null indexes, null codes and programs below ``least`` words have no pair.
    In a bucket, pairs whose sizes alone rule them out are never made; a hot bucket is split among
    tasks by the join, as both its sides may be large.
    """
    sides = []
    for df in (train, held_out):
        marks = written(signed(df, width=width, least=least, rows=rows, bands=bands))
        members, heads = classes(marks, "index", "collected_at", ("sig", "n", "bands"))
        members, heads = written(members), written(heads)
        dropped(marks)
        sides.append((members, heads, heads.select("rep", "n", F.explode("bands").alias("bucket"))))
    (tm, th, tb), (em, eh, eb) = sides
    b = eb.select(F.col("rep").alias("eval_rep"), F.col("n").alias("m"), "bucket")
    met = tb.withColumnRenamed("rep", "train_rep").join(shuffled(b), "bucket").where(F.least("n", "m") * den >= F.greatest("n", "m") * num)
    met = met.groupBy("train_rep", "eval_rep").agg(F.count("*").alias("shared")).where(F.col("shared") >= common)
    met = written(met.select("train_rep", "eval_rep"))
    both = met
    for df, heads, rep, n, s in ((train, th, "train_rep", "n_t", "s_t"), (held_out, eh, "eval_rep", "n_e", "s_e")):
        # the delivery of a candidate that its class stands for is the one with its signature
        chosen = heads.join(shuffled(met.select(F.col(rep).alias("rep")).distinct()), "rep").select(F.col("rep").alias("index"), "sig")
        texts = df.join(shuffled(chosen.select("index")), "index", "left_semi")
        sets = text_sets(texts, ["index"], "code", width=width, least=least).join(shuffled(chosen), ["index", "sig"], "left_semi").dropDuplicates(["index"])
        both = both.join(shuffled(sets.select(F.col("index").alias(rep), F.col("n").alias(n), F.col("shingles").alias(s))), rep)
    overlap = F.size(F.array_intersect("s_t", "s_e"))
    pairs = both.select("train_rep", "eval_rep", overlap.alias("o"), (F.col("n_t") + F.col("n_e")).alias("n")).where(F.col("o") * (num + den) >= F.col("n") * num)
    pairs = written(pairs.select("train_rep", "eval_rep"))
    dropped(th, eh)
    return tm, em, pairs


def overlaps(train: DataFrame, valid: DataFrame, test: DataFrame, **how) -> DataFrame:
    """``split, train_index, eval_index`` of every overlapping pair, each once."""
    cols = ["index", "code", "collected_at"]
    held = valid.select(*cols).union(test.select(*cols))
    tm, em, pairs = overlap_classes(train.select(*cols), held, **how)
    which = valid.select("index", F.lit("valid").alias("split")).union(test.select("index", F.lit("test").alias("split"))).where("index is not null").distinct()
    em = em.join(shuffled(which), "index")
    left = tm.select(F.col("index").alias("train_index"), F.col("rep").alias("train_rep"))
    right = em.select(F.col("index").alias("eval_index"), "split", F.col("rep").alias("eval_rep"))
    return pairs.join(shuffled(left), "train_rep").join(shuffled(right), "eval_rep").select("split", "train_index", "eval_index")


def report(train: DataFrame, valid: DataFrame, test: DataFrame, **how) -> DataFrame:
    """Per split and repository of the evaluated program: its programs, those with a training
    counterpart and their share. A null repository is a group of its own; redelivered rows count once."""
    found = overlaps(train, valid, test, **how).select("split", F.col("eval_index").alias("index")).distinct().withColumn("hit", F.lit(1))
    held = valid.select("index", "repository", "collected_at", F.lit("valid").alias("split")).union(test.select("index", "repository", "collected_at", F.lit("test").alias("split")))
    one = held.where("index is not null").groupBy("split", "index").agg(F.max_by("repository", F.struct("collected_at", "repository")).alias("repository"))
    joined = one.join(found, ["split", "index"], "left")
    n = joined.groupBy("split", "repository").agg(F.count("*").alias("programs"), F.count("hit").alias("overlapping"))
    return n.withColumn("share", F.round(F.col("overlapping") / F.col("programs"), 6))
