"""Similarity search and retrieval metrics, in blocks.

Vectors are packed into blocks of bounded size; every query block meets every key block once, as a
matrix product. What leaves a pair of blocks is small: counts of better keys, or the best few.
Scores are rounded before they are compared, and ties go to the smaller key, so results do not
depend on how the rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a block.
BLOCK = 1024
#: Decimals that scores are rounded to.
DECIMALS = 9


def normalised(v: Column) -> Column:
    """The vector divided by its length (at least 1e-12)."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(v, lambda x: x / F.greatest(length, F.lit(1e-12)))


def column_normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Divide every component by the length of its column over all rows."""
    long = df.select(F.posexplode(vector).alias("i", "x"))
    norms = long.groupBy("i").agg(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))).alias("n"))
    packed = norms.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda s: F.greatest(s["n"], F.lit(1e-12))).alias("norms"))
    return df.crossJoin(F.broadcast(packed)).withColumn(vector, F.zip_with(vector, "norms", lambda x, n: x / n)).drop("norms")


def _packed(df: DataFrame, prefix: str) -> DataFrame:
    """Blocks of rows: ``<prefix>_block`` and the lists of ids, labels and vectors."""
    rows = df.select("id", "label", F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    blocks = max(1, -(-rows.count() // BLOCK))
    keyed = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return keyed.groupBy("b").agg(F.collect_list(F.struct("id", "label", "vector")).alias(prefix)).select(F.col("b").alias(f"{prefix}_block"), prefix)


def _matrix(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = cell.values
    v = s.field("vector")
    return np.asarray(s.field("id")), np.asarray(s.field("label").fill_null(-1)), np.asarray(v.flatten()).reshape(len(v), -1)


def scores_of(q: np.ndarray, k: np.ndarray, how: str) -> np.ndarray:
    """The score of every query with every key; the greater the better. ``how``: cosine, dot, l1, l2."""
    if how == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        k = k / np.maximum(np.linalg.norm(k, axis=1, keepdims=True), 1e-12)
    if how in ("cosine", "dot"):
        s = q @ k.T
    elif how == "l1":
        s = -np.stack([np.abs(x - k).sum(axis=1) for x in q])
    else:
        s = -np.stack([np.sqrt(((x - k) ** 2).sum(axis=1)) for x in q])
    return np.round(s, DECIMALS) + 0.0


def block_pairs(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Every block of queries with every block of keys, one row each: few rows, each a matrix product."""
    q, k = _packed(queries, "q"), _packed(keys, "k")
    return q.crossJoin(k).repartition("q_block", "k_block")


def scored(queries: DataFrame, keys: DataFrame, how: str = "cosine", best: int | None = None) -> DataFrame:
    """``query, key, score, relevant``: the keys of every query but itself; with ``best``, only the best
    few of each block pair (which hold the best few of all).

    ``queries`` and ``keys``: ``id, label, vector``. ``relevant`` tells whether the labels agree; null
    labels agree with none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qi, ql, qv = _matrix(batch.column(0)[r])
                ki, kl, kv = _matrix(batch.column(1)[r])
                s = scores_of(qv, kv, how)
                for i in range(len(qi)):
                    use = ki != qi[i]
                    ids, sc, lb = ki[use], s[i][use], kl[use]
                    if best is not None and len(ids) > best:
                        top = np.lexsort((ids, -sc))[:best]
                        ids, sc, lb = ids[top], sc[top], lb[top]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qi[i])), pa.array(ids), pa.array(sc), pa.array((lb == ql[i]) & (lb != -1))], names=["query", "key", "score", "relevant"])

    return block_pairs(queries, keys).select("q", "k").mapInArrow(run, "query long, key long, score double, relevant boolean")


def top_k(queries: DataFrame, keys: DataFrame, k: int, how: str = "cosine") -> DataFrame:
    """``query, key, score, relevant, rank``: the best k keys of every query."""
    order = W.partitionBy("query").orderBy(F.desc("score"), "key")
    return scored(queries, keys, how, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gold_ranks(pairs: DataFrame, keys: DataFrame, how: str = "cosine") -> DataFrame:
    """``query, gold, rank``: the place of each query's own key among all keys.

    ``pairs``: ``id, gold, vector, gold_vector``. Each pair of blocks counts the keys that are better
    than a query's gold key (or as good with a smaller id); the counts are added up.
    """
    queries = pairs.select("id", F.lit(None).cast("int").alias("label"), "vector")
    gold = pairs.select("id", "gold", F.col("gold_vector").cast("array<double>").alias("gold_vector"))
    blocks = max(1, -(-queries.count() // BLOCK))
    q = queries.join(gold, "id").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = q.groupBy("b").agg(F.collect_list(F.struct("id", "label", F.col("vector").cast("array<double>").alias("vector"), "gold", "gold_vector")).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qi, _, qv = _matrix(batch.column(0)[r])
                cell = batch.column(0)[r].values
                gi = np.asarray(cell.field("gold"))
                gv = np.asarray(cell.field("gold_vector").flatten()).reshape(len(gi), -1)
                ki, _, kv = _matrix(batch.column(1)[r])
                s = scores_of(qv, kv, how)
                own = np.array([scores_of(qv[i : i + 1], gv[i : i + 1], how)[0, 0] for i in range(len(qi))])
                better = (s > own[:, None]) | ((s == own[:, None]) & (ki[None, :] < gi[:, None]))
                better &= (ki[None, :] != qi[:, None]) & (ki[None, :] != gi[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(gi), pa.array(better.sum(axis=1))], names=["query", "gold", "better"])

    met = packed.crossJoin(_packed(keys, "k")).repartition("b", "k_block").select("q", "k")
    return met.mapInArrow(run, "query long, gold long, better long").groupBy("query", "gold").agg((F.sum("better") + 1).alias("rank"))


def hits_at(k: int, rank: Column) -> Column:
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def search_metrics(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """One row: number of queries, hits at 1, 3, 5, 10, 20 and 100, mean reciprocal and mean rank."""
    r = F.col(rank)
    hits = [F.round(hits_at(k, r), 6).alias(f"hits_{k}") for k in (1, 3, 5, 10, 20, 100)]
    return ranks.agg(F.count("*").alias("n"), *hits, F.round(F.avg(1.0 / r), 6).alias("mrr"), F.round(F.avg(r), 6).alias("mr"))


def class_sizes(labels: DataFrame) -> DataFrame:
    """``label, r``: how many others have a row's label."""
    return labels.where("label is not null").groupBy("label").agg((F.count("*") - 1).alias("r"))


def average_precision(queries: DataFrame, keys: DataFrame, how: str = "cosine", best: int | None = None) -> DataFrame:
    """``query, r, ap``: over the R best keys of each query, R the number of relevant ones, the mean of
    the precision at each relevant place, divided by R; null where R is 0.

    ``best``: an upper bound of R, to carry no more than that from each block; by default the size of
    the largest class."""
    if best is None:
        best = max(1, keys.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    order = W.partitionBy("query").orderBy(F.desc("score"), "key")
    found = scored(queries, keys, how, best).withColumn("rn", F.row_number().over(order))
    found = found.join(queries.select(F.col("id").alias("query"), "label"), "query").join(class_sizes(keys), "label", "left")
    top = found.where(F.col("rn") <= F.col("r")).withColumn("rel", F.col("relevant").cast("int"))
    upto = F.sum("rel").over(order.rowsBetween(W.unboundedPreceding, 0))
    scored_top = top.withColumn("p", F.when(F.col("rel") == 1, upto / F.col("rn")).otherwise(0.0))
    per = scored_top.groupBy("query").agg((F.sum("p") / F.first("r")).alias("ap"))
    sizes = queries.select(F.col("id").alias("query"), "label").join(class_sizes(keys), "label", "left").select("query", F.coalesce("r", F.lit(0)).alias("r"))
    return sizes.join(per, "query", "left").select("query", "r", F.when(F.col("r") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def map_at_r(ap: DataFrame, empty_as_zero: bool = False) -> DataFrame:
    """The mean of the average precisions; queries without relevant keys are left out, or count as 0."""
    value = F.coalesce("ap", F.lit(0.0)) if empty_as_zero else F.col("ap")
    return ap.agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("map"))


def retrieval_suite(queries: DataFrame, keys: DataFrame, how: str = "cosine") -> DataFrame:
    """One row: MAP, nDCG at full depth, R-precision and precision at 1, 3 and 10, in percent with two
    decimals; a query without a relevant key counts as 0."""
    order = W.partitionBy("query").orderBy(F.desc("score"), "key")
    found = scored(queries, keys, how).withColumn("rn", F.row_number().over(order)).withColumn("rel", F.col("relevant").cast("int"))
    n_rel = F.sum("rel").over(W.partitionBy("query"))
    upto = F.sum("rel").over(order.rowsBetween(W.unboundedPreceding, 0))
    f = found.withColumn("n_rel", n_rel).withColumn("upto", upto)
    gain = F.col("rel") / F.log2(F.col("rn") + 1.0)
    ideal = F.when(F.col("rn") <= F.col("n_rel"), 1.0 / F.log2(F.col("rn") + 1.0)).otherwise(0.0)
    at = lambda k: F.sum(F.when(F.col("rn") <= k, F.col("rel")).otherwise(0)) / k
    per = f.groupBy("query").agg(
        (F.sum(F.when(F.col("rel") == 1, F.col("upto") / F.col("rn")).otherwise(0.0)) / F.greatest(F.first("n_rel"), F.lit(1))).alias("ap"),
        F.coalesce(F.sum(gain) / F.nullif(F.sum(ideal), F.lit(0.0)), F.lit(0.0)).alias("ndcg"),
        (F.sum(F.when(F.col("rn") <= F.col("n_rel"), F.col("rel")).otherwise(0)) / F.greatest(F.first("n_rel"), F.lit(1))).alias("rp"),
        at(1).alias("p1"), at(3).alias("p3"), at(10).alias("p10"),
    )
    pct = lambda c: F.round(F.avg(c) * 100, 2)
    return per.agg(F.count("*").alias("n"), pct("ap").alias("map"), pct("ndcg").alias("ndcg"), pct("rp").alias("r_precision"), pct("p1").alias("p_1"), pct("p3").alias("p_3"), pct("p10").alias("p_10"))


def log_rows(queries: DataFrame, keys: DataFrame, k: int, how: str = "cosine") -> DataFrame:
    """``query, query_label, rank, key, key_label, score``: the best k keys of every query, to be read."""
    best = top_k(queries, keys, k, how)
    rows = best.join(queries.select(F.col("id").alias("query"), F.col("label").alias("query_label")), "query").join(keys.select(F.col("id").alias("key"), F.col("label").alias("key_label")), "key")
    return rows.select("query", "query_label", "rank", "key", "key_label", F.round("score", 6).alias("score"))


def predictions(queries: DataFrame, keys: DataFrame, n: int = 499, how: str = "cosine") -> DataFrame:
    """``index, answers``: the ids of the best n keys of each query as text, best first."""
    best = top_k(queries, keys, n, how)
    lists = best.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"].cast("string")).alias("answers"))
    return lists.select(F.col("query").cast("string").alias("index"), "answers")


def classification_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: n, accuracy (all micro averages equal it) and the macro precision, recall and F1 over
    the classes that occur; rows with a null on either side are left out."""
    known = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull())
    cells = known.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    true = cells.groupBy(F.col("l").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("said"))
    both = true.join(said, "c", "full").na.fill(0, ["support", "hit", "said"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    scored_rows = both.select("support", "hit", p.alias("pr"), r.alias("re"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f"))
    return scored_rows.agg(F.sum("support").alias("n"), F.round(F.sum("hit") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("pr"), 6).alias("precision"), F.round(F.avg("re"), 6).alias("recall"), F.round(F.avg("f"), 6).alias("f1"))
