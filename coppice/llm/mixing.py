"""Mixing sources to target weights, in blocks of a fixed number of tokens.

The documents of a source, in pseudorandom order, form one stream of tokens that is cut into blocks.
The mix has as many slots as the scarcest source allows. Every output shard draws, by itself, how many
of its slots each source fills: multinomially, by the sources' shares of the slots. Running sums over
the shards number the slots of a source; slots beyond the source's total pass to the sources that drew
too few, so shares are met to within a block. The numbers run through pseudorandom permutations of the
source's blocks, one for each repetition, and blocks are joined to slots by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from coppice.functions.scratch import dropped, shuffled, written
from coppice.llm.bpe import TOKENIZERS, token_counts
from coppice.llm.shingles import mixed

#: Tokens of a block; about the slots of an output shard. There are as many shards as the slots need.
BLOCK, SLOTS = 512, 256
#: Documents a bucket of a source's pseudorandom order aims at, and shards of which running sums are
#: made in one step; buckets and steps grow in number with the data, not in size.
DOCS, STEP = 50_000, 4096
SEED = 9


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each ``x`` under the ``key``-th pseudorandom permutation of ``0 .. n-1``.

    Four Feistel rounds over the smallest even number of bits that holds n; values outside the range
    are sent through again until they fall inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m = half[todo], low[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mixed(right ^ mixed(key[todo].astype(np.uint64) + np.uint64(r * 7919 + 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def targets_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """``source -> (weight, max_repeats)``: rows of one source are added up, with their smallest limit;
    null sources and weights of nothing or less are left out, a null limit is 1. A small fixed table."""
    out: dict[str, tuple[float, int]] = {}
    for r in targets.select("source", "weight", "max_repeats").collect():
        if r["source"] is not None and (r["weight"] or 0) > 0:
            w, m = out.get(r["source"], (0.0, 1 << 30))
            out[r["source"]] = (w + r["weight"], min(m, 1 if r["max_repeats"] is None else max(0, r["max_repeats"])))
    return out


def blocks_of(counts: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``source, index, n_tokens, pieces``: the blocks of every source, numbered from 0.

    ``counts(doc_id, source, n_tokens)``; documents without tokens are in no block. ``pieces`` lists
    ``doc_id, start, stop`` (token offsets) in order. All blocks hold ``block`` tokens but the last of
    a source, which holds the rest. Positions come from sums per bucket, then within a bucket; a source
    has as many buckets as its documents need. One number per source comes to the driver, so ``counts``
    must hold the sources of the targets only.
    """
    live = counts.where("n_tokens > 0 and source is not null")
    docs = {r["source"]: r["n"] for r in live.groupBy("source").agg(F.count("*").alias("n")).collect()}
    buckets = F.element_at(F.create_map(*[F.lit(x) for s, n in docs.items() for x in (s, -(-n // DOCS))]), F.col("source")) if docs else F.lit(1)
    keyed = live.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    keyed = keyed.withColumn("bucket", F.pmod("h", buckets.cast("long")))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    # a row per source and bucket
    starts = sums.select("source", "bucket", (F.sum("t").over(W.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("base"))
    inner = F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    placed = keyed.withColumn("upto", inner).join(starts, ["source", "bucket"])
    placed = placed.select("source", "doc_id", "n_tokens", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("at"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block)
    cut = placed.withColumn("index", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("at"), F.col("index") * block)
    hi = F.least(F.col("at") + F.col("n_tokens"), (F.col("index") + 1) * block)
    piece = F.struct(lo.alias("at"), "doc_id", (lo - F.col("at")).cast("int").alias("start"), (hi - F.col("at")).cast("int").alias("stop"))
    grouped = cut.groupBy("source", "index").agg(F.sum(hi - lo).cast("int").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("p"))
    return grouped.select("source", "index", "n_tokens", F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("pieces"))


def plan(available: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Slots per source.

    ``available``: blocks and tokens per source. Weights are shared among the sources that have blocks
    and may be used; the size of the mix is the largest for which every source suffices. A source's
    slots follow from the mean size of its blocks, as its last one may be short."""
    names = sorted(s for s, (_, m) in targets.items() if available.get(s, (0, 0))[0] > 0 and m > 0)
    if not names:
        return {}
    weight = np.array([targets[s][0] for s in names])
    weight /= weight.sum()
    most = np.array([targets[s][1] for s in names])
    room = np.array([available[s][0] for s in names]) * most
    tokens = np.array([available[s][1] for s in names])
    size = (tokens * most / weight).min()
    take = np.minimum(np.round(size * weight * room / (tokens * most)).astype(np.int64), room)
    return {s: int(n) for s, n in zip(names, take) if n}


def shard_size(slots: int, shards: int, shard):
    """The slots of a shard; the first shards have one more where they do not come out even."""
    return slots // shards + (shard < slots % shards)


def draws(spark: SparkSession, take: dict[str, int], seed: int = SEED) -> DataFrame:
    """``shard, source_no, first, count, offset``: the slots of each shard that a source fills.

    Each shard draws its counts from a multinomial distribution with a generator of its own. ``first``
    numbers the source's slots over all shards, ``offset`` those of the shard over its sources. Sums run
    within steps of :data:`STEP` shards and then over the steps, so no task holds all shards.
    """
    slots = sum(take.values())
    shards = max(1, slots // SLOTS)
    share = np.array(list(take.values())) / slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            counts = [np.random.default_rng([seed, int(j)]).multinomial(int(shard_size(slots, shards, j)), share) for j in ids]
            n = np.array(counts, np.int64).reshape(len(ids), len(share))
            no = np.tile(np.arange(len(share), dtype=np.int32), len(ids))
            cols = [np.repeat(ids, len(share)), no, n.ravel(), (n.cumsum(axis=1) - n).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shard", "source_no", "count", "offset"])

    drawn = written(spark.range(shards).mapInArrow(run, "shard long, source_no int, count long, offset long").where("count > 0"))
    step = F.floor(F.col("shard") / STEP).cast("long")
    sums = drawn.groupBy("source_no", step.alias("step")).agg(F.sum("count").alias("t"))
    bases = sums.select("source_no", "step", (F.sum("t").over(W.partitionBy("source_no").orderBy("step")) - F.col("t")).alias("base"))
    upto = F.sum("count").over(W.partitionBy("source_no", "step").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    placed = drawn.withColumn("step", step).withColumn("upto", upto).join(bases, ["source_no", "step"])
    return placed.select("shard", "source_no", (F.col("base") + F.col("upto") - F.col("count")).alias("first"), "count", "offset")


def evened(numbered: DataFrame, take: list[int], got: list[int]) -> DataFrame:
    """Give the slots that a source drew beyond its total to sources that drew too few.

    ``numbered(..., source_no, at)``, ``at`` the number of the slot among those its source drew;
    ``got``: how many it drew. Afterwards the numbers of source k are 0 to take[k] - 1, each once.
    """
    over, under, upto = F.lit(None).cast("long"), [], 0
    for k, (t, g) in enumerate(zip(take, got)):
        if g > t:
            over = F.when((F.col("source_no") == k) & (F.col("at") >= t), F.lit(upto).cast("long") + F.col("at") - t).otherwise(over)
            upto += g - t
    no, at, upto = F.col("source_no"), F.col("at"), 0
    for k, (t, g) in enumerate(zip(take, got)):
        if g < t:
            under = (F.col("over") >= upto) & (F.col("over") < upto + t - g)
            no, at = F.when(under, k).otherwise(no), F.when(under, F.lit(g - upto).cast("long") + F.col("over")).otherwise(at)
            upto += t - g
    return numbered.withColumn("over", over).withColumns({"source_no": no, "at": at}).drop("over")


@F.pandas_udf(T.LongType())
def _image(x: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(x.to_numpy(), n.to_numpy(), key.to_numpy()))


def mix(documents: DataFrame, targets: DataFrame, *, block: int = BLOCK, seed: int = SEED, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """``(slots, report)`` of the mix of ``documents(doc_id, text, source)``.

    ``slots``: ``shard, slot, source, index, repetition, n_tokens, pieces``, the output in order of
    shard and slot. ``report``: per source of the targets its weight, what it has, what was used, the
    greatest number of uses of a block and the share of all tokens reached. Documents of no target
    are left out, a target without documents gets nothing, its weight going to the others in
    proportion; no block, hence no document, is used more than ``max_repeats`` times. Without any
    usable document both have no slots. Null and empty texts have no tokens.
    """
    spark = documents.sparkSession
    wanted = targets_of(targets)
    chosen = documents.where(F.col("source").isin(*wanted) & F.col("doc_id").isNotNull()) if wanted else documents.limit(0)
    pairs = chosen.select(F.struct("doc_id", "source").alias("k"), "text")
    counts = written(token_counts(pairs, "k", "text", folder=folder).select("k.doc_id", "k.source", "n_tokens"))
    blocks = written(blocks_of(counts, block, seed))
    dropped(counts)
    have = {r["source"]: (r["b"], r["t"]) for r in blocks.groupBy("source").agg(F.count("*").alias("b"), F.sum("n_tokens").alias("t")).collect()}
    take = plan(have, wanted)
    names = list(take)
    if take:
        drawn = written(draws(spark, take, seed))
        got = {r["source_no"]: r["n"] for r in drawn.groupBy("source_no").agg(F.sum("count").alias("n")).collect()}
        total = sum(take.values())
        shards = max(1, total // SLOTS)
        runs = drawn.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
        size = F.lit(total // shards).cast("long") + (F.col("shard") < total % shards).cast("long")
        slot = _image(F.col("offset") + F.col("i"), size, F.lit(seed + 77).cast("long") + F.col("shard"))
        runs = evened(runs.select("shard", slot.cast("int").alias("slot"), "source_no", (F.col("first") + F.col("i")).alias("at")), list(take.values()), [got.get(k, 0) for k in range(len(names))])
        n = F.element_at(F.array(*[F.lit(have[s][0]).cast("long") for s in names]), F.col("source_no") + 1)
        runs = runs.withColumn("repetition", F.floor(F.col("at") / n).cast("int"))
        key = F.lit(seed * 1_000_003) + F.col("source_no") * 8191 + F.col("repetition")
        index = _image(F.pmod("at", n), n, key.cast("long"))
        placed = runs.select("shard", "slot", F.element_at(F.array(*[F.lit(s) for s in names]), F.col("source_no") + 1).alias("source"), index.alias("index"), "repetition")
    else:
        placed = spark.createDataFrame([], "shard long, slot int, source string, index long, repetition int")
    slots = placed.join(shuffled(blocks), ["source", "index"]).select("shard", "slot", "source", "index", "repetition", "n_tokens", "pieces")
    used = slots.groupBy("source").agg(F.count("*").alias("used_blocks"), F.sum("n_tokens").alias("used_tokens"), (F.max("repetition") + 1).alias("most_uses"))
    base = spark.createDataFrame([(s, w, m, *have.get(s, (0, 0))) for s, (w, m) in sorted(wanted.items())], "source string, weight double, max_repeats int, blocks long, tokens long")
    report = base.join(F.broadcast(used), "source", "left").na.fill(0, ["used_blocks", "used_tokens", "most_uses"])
    total = F.sum("used_tokens").over(W.partitionBy(F.lit(1)))
    report = report.withColumn("share", F.when(total > 0, F.round(F.col("used_tokens") / total, 6)).otherwise(0.0))
    return slots, report
