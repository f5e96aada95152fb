"""Bucketed batches under a budget of padded tokens, in the order of an explicit column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.functions.uniform import uniform


def bucket(size: Column, longest: int, buckets: int) -> Column:
    """The bucket of a size: even widths, the rest in the last."""
    return F.least(F.floor(size / (longest // buckets)), F.lit(buckets - 1)).cast("int")


def cut(sizes: np.ndarray, budget: int) -> np.ndarray:
    """The batch number of each size, in order: a batch closes when its longest size times its number of
    samples would go over the budget."""
    out = np.zeros(len(sizes), np.int64)
    number = most = count = 0
    for i, s in enumerate(sizes.tolist()):
        if count and max(most, s) * (count + 1) > budget:
            number, most, count = number + 1, 0, 0
        most, count = max(most, s), count + 1
        out[i] = number
    return out


def fitting(size: str, longest: int) -> Column:
    """A size column; a size above ``longest`` is an error."""
    above = F.raise_error(F.lit(f"{size} above {longest}, the longest sample of a batch")).cast("int")
    return F.when(F.col(size) > longest, above).otherwise(F.col(size))


def batched(df: DataFrame, keys: list[str], size: str, order: list[str], *, budget: int, longest: int, buckets: int, sizes: list[str] | None = None, shards: int = 1, even: int | None = None) -> DataFrame:
    """``df`` with ``bucket..., shard, batch``: samples of a key and bucket in order of ``order`` (unique),
    cut into batches of at most ``budget`` padded tokens.

    ``size`` may be a pair through ``sizes`` (source and target): then there is a grid of buckets, and
    the longer of both counts. Sizes of 0 or null are dropped. A size above ``longest`` is an error, as
    no batch can hold it; set such samples aside with :func:`oversized` first. ``shards`` splits a bucket by a hash of the order columns, so that no bucket
    is one task; each shard has its own last, underfull batch. ``even``, by default ``longest``, is
    divided evenly among the buckets; the last one holds what is above it.
    """
    if budget < longest:
        raise ValueError("a batch must hold the longest sample")
    parts = sizes or [size]
    known = df
    for k, s in enumerate(parts):
        known = known.where(F.col(s) > 0).withColumn(f"bucket{k}", bucket(fitting(s, longest), even or longest, buckets))
    known = known.withColumn("shard", F.floor(uniform(0, "shard", *[F.col(o) for o in order]) * shards).cast("int")).withColumn("__size", F.greatest(*parts) if len(parts) > 1 else F.col(parts[0]))
    group = [*keys, *[f"bucket{k}" for k in range(len(parts))], "shard"]
    schema = T.StructType([f for f in known.schema.fields if f.name != "__size"] + [T.StructField("batch", T.IntegerType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(o, "ascending") for o in order])
        number = cut(np.asarray(t.column("__size")), budget)
        return t.drop_columns(["__size"]).append_column("batch", pa.array(number.astype(np.int32)))

    return known.groupBy(*group).applyInArrow(run, schema)


def oversized(df: DataFrame, size: str, longest: int) -> tuple[DataFrame, DataFrame]:
    """``(samples that a batch can hold, samples that none can)``; null sizes are in neither."""
    return df.where(F.col(size) <= longest), df.where(F.col(size) > longest)


def batch_report(batches: DataFrame, group: list[str], size: str) -> DataFrame:
    """``group..., n, tokens, cost``: samples, tokens and padded cost of every batch."""
    return batches.groupBy(*group).agg(F.count("*").alias("n"), F.sum(size).alias("tokens"), (F.max(size) * F.count("*")).alias("cost"))


def shard(key: str, workers: int) -> Column:
    """Which of several workers reads a row, by its key."""
    return F.pmod(F.col(key), F.lit(workers)).cast("int")


def sharded(df: DataFrame, key: str, worker: int, workers: int) -> DataFrame:
    """The rows that one of several workers reads: every row belongs to exactly one, by its key."""
    return df.where(shard(key, workers) == worker)


def per_class(df: DataFrame, label: str, key: str, m: int, seed: int) -> DataFrame:
    """Batches with m rows of every class: ``batch`` counts from 0 within a class, rows in a random order."""
    from pyspark.sql import Window as W

    order = W.partitionBy(label).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("per_class"), F.col(key).cast("string"))), key)
    return df.withColumn("batch", F.floor((F.row_number().over(order) - 1) / m).cast("int"))


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    from pyspark.sql import Window as W

    return df.withColumn("__rn", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("__rn") <= n).drop("__rn")


def iterate(df: DataFrame, columns: list[str]) -> Iterator[tuple]:
    """Rows one after the other, partition by partition, without gathering them on the driver."""
    for row in df.select(*columns).toLocalIterator(prefetchPartitions=True):
        yield tuple(row)
