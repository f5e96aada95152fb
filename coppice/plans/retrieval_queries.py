"""Queries over the embeddings: search of paired vectors and retrieval by label.

The queries of a search are the rows whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators import retrieval as R
from coppice.sources.tables import table


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


def _queries(keys: DataFrame) -> DataFrame:
    return keys.where("id % 20 = 0")


def _ranks(spark: SparkSession, folder: str, how: str) -> DataFrame:
    keys = _keys(spark, folder)
    gold = keys.select((F.col("id") - 1).alias("id"), F.col("id").alias("gold"), F.col("vector").alias("gold_vector"))
    return R.gold_ranks(_queries(keys).select("id", "vector").join(gold, "id"), keys, how)


def search_cosine_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return R.search_metrics(_ranks(spark, folder, "cosine"))


def search_l1_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return R.search_metrics(_ranks(spark, folder, "l1"))


def search_l2_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return R.search_metrics(_ranks(spark, folder, "l2"))


def search_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return _ranks(spark, folder, "cosine")


def map_at_r(spark: SparkSession, folder: str) -> DataFrame:
    keys = _keys(spark, folder)
    return R.map_at_r(R.average_precision(_queries(keys), keys))


def map_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    keys = _keys(spark, folder)
    return R.map_at_r(R.average_precision(_queries(keys), keys), empty_as_zero=True)


def map_at_r_colnorm(spark: SparkSession, folder: str) -> DataFrame:
    keys = R.column_normalised(_keys(spark, folder), "vector")
    return R.map_at_r(R.average_precision(_queries(keys), keys, "dot"))


def retrieval_suite(spark: SparkSession, folder: str) -> DataFrame:
    keys = _keys(spark, folder)
    return R.retrieval_suite(_queries(keys), keys)


def top_k_answers(spark: SparkSession, folder: str) -> DataFrame:
    keys = _keys(spark, folder)
    return R.top_k(_queries(keys), keys, 10).select("query", "key", "rank", "relevant")


def top499_predictions(spark: SparkSession, folder: str) -> DataFrame:
    keys = _keys(spark, folder)
    best = R.predictions(_queries(keys), keys)
    return best.select("index", F.size("answers").alias("n"), F.concat_ws(",", "answers").alias("answers"))


def nearest_label(spark: SparkSession, folder: str) -> DataFrame:
    """Classification by the nearest other vector, measured against the labels."""
    keys = _keys(spark, folder)
    best = R.top_k(_queries(keys), keys, 1).select("query", "key")
    said = best.join(keys.select(F.col("id").alias("key"), F.col("label").alias("predicted")), "key")
    return R.classification_metrics(said.join(keys.select(F.col("id").alias("query"), "label"), "query"))


def nearest_label_confusion(spark: SparkSession, folder: str) -> DataFrame:
    keys = _keys(spark, folder)
    best = R.top_k(_queries(keys), keys, 1).select("query", "key")
    said = best.join(keys.select(F.col("id").alias("key"), F.col("label").alias("predicted")), "key")
    return said.join(keys.select(F.col("id").alias("query"), "label"), "query").groupBy("label", "predicted").agg(F.count("*").alias("n"))


def retrieval_log(spark: SparkSession, folder: str) -> DataFrame:
    """What a search found, to be read: the best three keys of every query with both labels and the score."""
    keys = _keys(spark, folder)
    return R.log_rows(_queries(keys), keys, 3)


_E = "e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))"
_LEN = "list_sum(list_transform({0}.v, lambda x: x * x))"
_SCORE = {
    "cosine": f"round({_DOT} / (greatest(sqrt({_LEN.format('a')}), 1e-12) * greatest(sqrt({_LEN.format('b')}), 1e-12)), 9)",
    "dot": f"round({_DOT}, 9)",
    "l1": "round(-list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))), 9)",
    "l2": "round(-sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9)",
}


def _scores(how: str = "cosine", base: str = _E) -> str:
    return f"{base}, s AS (SELECT a.id AS query, b.id AS key, a.label AS ql, b.label AS kl, {_SCORE[how]} AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 20 = 0)"


def _rank_sql(how: str) -> str:
    return f"{_scores(how)}, r AS (SELECT g.query, g.key AS gold, 1 + count(*) FILTER (WHERE s.score > g.score OR (s.score = g.score AND s.key < g.key)) AS rank FROM s g JOIN s ON s.query = g.query WHERE g.key = g.query + 1 GROUP BY 1, 2)"


def _search_sql(how: str) -> str:
    hits = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hits_{k}" for k in (1, 3, 5, 10, 20, 100))
    return f"WITH {_rank_sql(how)} SELECT count(*) AS n, {hits}, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(rank), 6) AS mr FROM r"


def _map_sql(how: str = "cosine", base: str = _E, zero: bool = False) -> str:
    value = "coalesce(ap, 0)" if zero else "ap"
    return f"""WITH {_scores(how, base)}, c AS (SELECT label, count(*) - 1 AS r FROM e GROUP BY 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rn FROM s),
        t AS (SELECT o.*, r, CASE WHEN ql = kl THEN 1 ELSE 0 END AS rel FROM o JOIN c ON c.label = ql WHERE rn <= r),
        u AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rn) AS upto FROM t),
        ap AS (SELECT query, sum(CASE WHEN rel = 1 THEN upto / rn::DOUBLE ELSE 0 END) / max(r) AS ap FROM u GROUP BY 1),
        q AS (SELECT e.id, ap FROM e LEFT JOIN ap ON ap.query = e.id WHERE e.id % 20 = 0)
        SELECT count({value}) AS n, round(avg({value}), 6) AS map FROM q"""


_COLUMNS = """n AS (SELECT i, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1),
    l AS (SELECT list(n ORDER BY i) AS ns FROM n),
    e AS (SELECT vec_id AS id, label, list_transform(list_zip(embedding, ns), lambda z: z[1]::DOUBLE / z[2]) AS v FROM embeddings, l)"""
_TOP = _scores() + ", o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rn FROM s)"

QUERIES = [search_cosine_metrics, search_l1_metrics, search_l2_metrics, search_ranks, map_at_r, map_benchmark, map_at_r_colnorm, retrieval_suite, top_k_answers, top499_predictions, nearest_label, nearest_label_confusion, retrieval_log]
SQL = {
    "search_cosine_metrics": _search_sql("cosine"),
    "search_l1_metrics": _search_sql("l1"),
    "search_l2_metrics": _search_sql("l2"),
    "search_ranks": f"WITH {_rank_sql('cosine')} SELECT query, gold, rank FROM r",
    "map_at_r": _map_sql(),
    "map_benchmark": _map_sql(zero=True),
    "map_at_r_colnorm": _map_sql("dot", _COLUMNS),
    "retrieval_suite": f"""WITH {_TOP}, f AS (SELECT query, rn, CASE WHEN ql = kl THEN 1 ELSE 0 END AS rel FROM o),
        g AS (SELECT *, sum(rel) OVER (PARTITION BY query) AS n_rel, sum(rel) OVER (PARTITION BY query ORDER BY rn) AS upto FROM f),
        p AS (SELECT query, sum(CASE WHEN rel = 1 THEN upto / rn::DOUBLE ELSE 0 END) / greatest(max(n_rel), 1) AS ap,
          coalesce(sum(rel / log2(rn + 1.0::DOUBLE)) / nullif(sum(CASE WHEN rn <= n_rel THEN 1 / log2(rn + 1.0::DOUBLE) ELSE 0 END), 0), 0) AS ndcg,
          sum(CASE WHEN rn <= n_rel THEN rel ELSE 0 END) / greatest(max(n_rel), 1)::DOUBLE AS rp,
          sum(CASE WHEN rn <= 1 THEN rel ELSE 0 END) / 1.0::DOUBLE AS p1, sum(CASE WHEN rn <= 3 THEN rel ELSE 0 END) / 3.0::DOUBLE AS p3, sum(CASE WHEN rn <= 10 THEN rel ELSE 0 END) / 10.0::DOUBLE AS p10 FROM g GROUP BY 1)
        SELECT count(*) AS n, round(avg(ap) * 100, 2) AS map, round(avg(ndcg) * 100, 2) AS ndcg, round(avg(rp) * 100, 2) AS r_precision, round(avg(p1) * 100, 2) AS p_1, round(avg(p3) * 100, 2) AS p_3, round(avg(p10) * 100, 2) AS p_10 FROM p""",
    "retrieval_log": f"WITH {_TOP} SELECT query, ql AS query_label, rn::INT AS rank, key, kl AS key_label, round(score, 6) AS score FROM o WHERE rn <= 3",
    "top_k_answers": f"WITH {_TOP} SELECT query, key, rn::INT AS rank, ql = kl AS relevant FROM o WHERE rn <= 10",
    "top499_predictions": f"WITH {_TOP} SELECT query::VARCHAR AS index, count(*)::INT AS n, string_agg(key::VARCHAR, ',' ORDER BY rn) AS answers FROM o WHERE rn <= 499 GROUP BY 1",
    "nearest_label": f"""WITH {_TOP}, n AS (SELECT ql AS l, kl AS p FROM o WHERE rn = 1),
        c AS (SELECT l AS c FROM n UNION SELECT p FROM n),
        m AS (SELECT c, (SELECT count(*) FROM n WHERE l = c) AS support, (SELECT count(*) FROM n WHERE p = c) AS said, (SELECT count(*) FROM n WHERE l = c AND p = c) AS hit FROM c),
        f AS (SELECT *, CASE WHEN said > 0 THEN hit / said::DOUBLE ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS re FROM m)
        SELECT sum(support)::BIGINT AS n, round(sum(hit)::DOUBLE / sum(support), 6) AS accuracy, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 6) AS f1 FROM f""",
    "nearest_label_confusion": f"WITH {_TOP} SELECT ql AS label, kl AS predicted, count(*) AS n FROM o WHERE rn = 1 GROUP BY 1, 2",
}
