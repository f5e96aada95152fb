"""Filling containers of fixed capacity by multiway differencing.

Items are dealt to shards of bounded size; within a shard, Karmarkar-Karp differencing merges partial
partitions so that their imbalances oppose each other, which gives containers of nearly equal load.
If a container would exceed the capacity, the shard is packed again with one container more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Containers' worth of tokens a shard aims at.
SHARD = 96


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Partition ``sizes`` into k parts by Karmarkar-Karp multiway differencing; the part of each item.

    A partial partition is k loads, sorted, and begins as a single item. The two with the greatest
    spread are merged, the largest loads of one onto the smallest of the other, until one remains.
    """
    n = len(sizes)
    if k <= 1 or not n:
        return np.zeros(n, np.int64)
    # spread, tie, loads, items of each load as nested pairs; single items are unfolded when they are merged
    heap: list[tuple[int, int, np.ndarray | None, list | int]] = [(-int(sizes[i]), tick, None, int(i)) for tick, i in enumerate(np.argsort(-sizes, kind="stable"))]
    tick = n

    def opened(loads: np.ndarray | None, items: list | int) -> tuple[np.ndarray, list]:
        if loads is not None:
            return loads, items
        first = np.zeros(k, np.int64)
        first[0] = sizes[items]
        return first, [items, *[None] * (k - 1)]

    while len(heap) > 1:
        a, ia = opened(*heapq.heappop(heap)[2:])
        b, ib = opened(*heapq.heappop(heap)[2:])
        loads = a + b[::-1]
        items = [x if y is None else y if x is None else (x, y) for x, y in zip(ia, reversed(ib))]
        rank = np.argsort(-loads, kind="stable")
        loads = loads[rank]
        heapq.heappush(heap, (-int(loads[0] - loads[-1]), tick, loads, [items[r] for r in rank.tolist()]))
        tick += 1
    out = np.zeros(n, np.int64)
    for c, held in enumerate(opened(*heap[0][2:])[1]):
        stack = [held]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            elif x is not None:
                out[x] = c
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (each at most ``capacity``), as few containers as differencing finds:
    one more whenever a container overflows. Items that leave no room for even the smallest other get
    a container of their own first."""
    alone = sizes + sizes.min(initial=capacity) > capacity
    if alone.all():
        return np.arange(len(sizes))
    if alone.any():
        out = np.zeros(len(sizes), np.int64)
        out[~alone] = pack(sizes[~alone], capacity)
        out[alone] = out[~alone].max() + 1 + np.arange(int(alone.sum()))
        return out
    k = max(1, int(-(-int(sizes.sum()) // capacity)))
    while True:
        part = difference(sizes, k)
        if np.bincount(part, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return part
        k += 1


def parts_of(files: DataFrame, limits: DataFrame) -> DataFrame:
    """The items to pack: ``file_id, language, capacity, n_tokens, part, n_parts, start, stop``.

    ``files(file_id, n_tokens, language)``; a sequence larger than its capacity is divided into parts
    of the capacity and a rest, any other is one part. Rows with a null file_id, null or no tokens,
    or without a limit for their language give nothing. Rows of one file count once: with a column
    ``ingested_at`` the newest, else, and of equally new ones, the longest.
    """
    time = F.col("ingested_at") if "ingested_at" in files.columns else F.lit(0)
    files = files.where("file_id is not null").groupBy("file_id").agg(F.max_by(F.struct("n_tokens", "language"), F.struct(time.alias("t"), "n_tokens", "language")).alias("v")).select("file_id", "v.*")
    sized = files.where("n_tokens > 0").join(F.broadcast(limits.select("language", F.col("max_tokens_in_batch").alias("capacity"))), "language")
    sized = sized.where("capacity > 0")
    n = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int")
    cut = sized.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    start = (F.col("part") * F.col("capacity")).cast("long")
    return cut.select("file_id", "language", "capacity", "n_tokens", "part", "n_parts", start.alias("start"), F.least(F.col("n_tokens").cast("long"), start + F.col("capacity")).alias("stop"))


def batches(items: DataFrame, shard: int = SHARD) -> DataFrame:
    """The container of every item of :func:`parts_of`: ``shard`` and ``batch`` (within language and
    shard) are added, with ``load``, the tokens of that container, and ``n_batches`` of the shard.

    A language has as many shards as it takes to keep each near ``shard`` containers of tokens, so no
    task grows with the data; an underfull container per shard costs less than 1/``shard``.
    """
    size = F.col("stop") - F.col("start")
    totals = items.groupBy("language").agg(F.ceil(F.sum(size / F.col("capacity")) / shard).cast("int").alias("shards"))
    dealt = items.join(F.broadcast(totals), "language")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("file_id", "part", F.lit(6)), F.col("shards").cast("long")).cast("int"))
    columns = ["file_id", "language", "capacity", "n_tokens", "part", "n_parts", "start", "stop", "shard"]

    def run(_key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("file_id", "ascending"), ("part", "ascending")])
        sizes = np.asarray(t.column("stop")).astype(np.int64) - np.asarray(t.column("start"))
        where = pack(sizes, int(t.column("capacity")[0].as_py()))
        load = np.bincount(where, weights=sizes).astype(np.int64)
        t = t.append_column("batch", pa.array(where.astype(np.int32))).append_column("load", pa.array(load[where]))
        return t.append_column("n_batches", pa.array(np.full(t.num_rows, len(load), np.int32)))

    schema = dealt.select(*columns).schema.add("batch", T.IntegerType()).add("load", T.LongType()).add("n_batches", T.IntegerType())
    return dealt.select(*columns).groupBy("language", "shard").applyInArrow(run, schema)


def divided(packed: DataFrame) -> DataFrame:
    """``file_id`` of the sequences that fill more than one place of the containers."""
    return packed.groupBy("file_id").agg(F.count("*").alias("places")).where("places > 1").select("file_id")


def usage(packed: DataFrame) -> DataFrame:
    """Per language: items, containers, tokens and the share of the containers' room that is used."""
    each = packed.groupBy("language", "capacity", "shard", "batch").agg(F.count("*").alias("items"), F.sum(F.col("stop") - F.col("start")).alias("load"))
    out = each.groupBy("language", "capacity").agg(F.sum("items").alias("items"), F.count("*").alias("batches"), F.sum("load").alias("tokens"), F.max("load").alias("fullest"))
    return out.withColumn("used", F.round(F.col("tokens") / (F.col("batches") * F.col("capacity")), 6))
