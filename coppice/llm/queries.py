"""The queries pN_... of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.sources.tables import table


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "code_trees", "file_id", "tokens", "parents", "descendants", "ingested_at")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of files that are small variations of one another."""
    from coppice.llm.neardup import similar_pairs

    return similar_pairs(_trees(spark, folder))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The class, the group and the number of links of every file."""
    from coppice.llm.neardup import groups

    return groups(_trees(spark, folder))


def _entity_values(spark: SparkSession, folder: str) -> DataFrame:
    from coppice.llm.splits import raw_values

    repos = raw_values(table(spark, folder, "code_data", "repository"), "repository", "repository")
    labels = raw_values(table(spark, folder, "train", "label"), "label", "label")
    problems = raw_values(table(spark, folder, "cocos", "problem"), "problem", "problem")
    return repos.union(labels).union(problems)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of raw values that must share a split."""
    from coppice.llm.splits import related_pairs

    return related_pairs(_entity_values(spark, folder), table(spark, folder, "repository_links"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every record of code_data, train and cocos."""
    from coppice.llm.splits import assign

    code = table(spark, folder, "code_data", "file_id", "repository").select(F.lit("repository").alias("kind"), F.col("file_id").cast("string").alias("record"), F.col("repository").alias("raw"))
    train = table(spark, folder, "train", "index", "label").select(F.lit("label").alias("kind"), F.col("index").alias("record"), F.col("label").alias("raw"))
    cocos = table(spark, folder, "cocos", "query_id", "problem").select(F.lit("problem").alias("kind"), F.col("query_id").cast("string").alias("record"), F.col("problem").alias("raw"))
    return assign(code.union(train).union(cocos), _entity_values(spark, folder), table(spark, folder, "repository_links"))


def _record_nodes(spark: SparkSession, folder: str) -> DataFrame:
    from coppice.llm.splits import node_of

    code = table(spark, folder, "code_data", "file_id", "repository").select(F.lit("repository").alias("kind"), F.col("file_id").cast("string").alias("record"), F.array(node_of("repository", "repository")).alias("nodes"))
    train = table(spark, folder, "train", "index", "label", "repository").select(F.lit("label").alias("kind"), F.col("index").alias("record"), F.array(node_of("label", "label"), node_of("repository", "repository")).alias("nodes"))
    cocos = table(spark, folder, "cocos", "query_id", "problem").select(F.lit("problem").alias("kind"), F.col("query_id").cast("string").alias("record"), F.array(node_of("problem", "problem")).alias("nodes"))
    return code.union(train).union(cocos).where("record is not null")


def p2_strict(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every record where also the repositories of train's programs keep together."""
    from coppice.llm.splits import assign_across

    return assign_across(_record_nodes(spark, folder), table(spark, folder, "repository_links"))


def p2_crossings(spark: SparkSession, folder: str) -> DataFrame:
    """For both ways of splitting: entities of each kind, and those with records in several splits."""
    from coppice.llm.splits import crossings

    nodes, links = _record_nodes(spark, folder), table(spark, folder, "repository_links")
    ways = [crossings(f(spark, folder), nodes, links).withColumn("way", F.lit(f.__name__)) for f in (p2_splits, p2_strict)]
    return ways[0].union(ways[1]).select("way", "entity_kind", "entities", "in_several_splits")


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the records of each kind that each split received."""
    n = p2_splits(spark, folder).groupBy("kind", "split").agg(F.count("*").alias("records"), F.countDistinct("root").alias("components"))
    return n.withColumn("share", F.round(F.col("records") / F.sum("records").over(Window.partitionBy("kind")), 6))


def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every file of parsing_outputs, with place and cause of the failure."""
    from coppice.llm.syntax import check

    return check(table(spark, folder, "parsing_outputs", "file_id", "code", "language", "repository", "path", "parsed_at"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files of parsing_outputs that are not valid in their language."""
    return p3_files(spark, folder).where("not valid").select("file_id")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The share of invalid files per repository and language."""
    from coppice.llm.splits import repository_key
    from coppice.llm.syntax import rates

    return rates(p3_files(spark, folder).withColumn("repository", repository_key(F.col("repository"))))


def p4_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The origin of every file of code_data with data."""
    from coppice.llm.origin import origins

    files = table(spark, folder, "code_data", "file_id", "data", "repository", "path", "ingested_at")
    return origins(files, table(spark, folder, "vocabulary"), table(spark, folder, "known_libraries"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files of code_data that nobody wrote by hand."""
    return p4_labels(spark, folder).where("label <> 'handwritten'").select("file_id")


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    """code_data with canonical languages; a null language is ``any``, as is one without limits."""
    from coppice.functions.languages import language_identifier

    known = [r[0] for r in table(spark, folder, "batch_limits", "language").where("language is not null").collect()]
    lang = language_identifier(F.col("language"), spellings=True)
    lang = F.when(lang.isin(*known), lang).otherwise("any")
    return table(spark, folder, "code_data", "file_id", "data", "language", "ingested_at").select("file_id", "data", lang.alias("language"), "ingested_at")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized sequence of code_data."""
    from coppice.llm.pieces import penalties, pieces

    cost = penalties(table(spark, folder, "truncated_trees", "tokens", "parents", "cutout_indices"))
    return pieces(_sequences(spark, folder), table(spark, folder, "batch_limits"), cost)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized sequences and whether a cut had to fall within a line."""
    return p5_pieces(spark, folder).where("piece = 0").select("file_id", "cut")


def _packed_items(spark: SparkSession, folder: str) -> DataFrame:
    from coppice.llm.packing import parts_of

    files = _sequences(spark, folder).select("file_id", F.size("data").alias("n_tokens"), "language", "ingested_at")
    return parts_of(files, table(spark, folder, "batch_limits"))


def p6_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The batch of every sequence of code_data, or of each part of one larger than a batch."""
    from coppice.llm.packing import batches

    return batches(_packed_items(spark, folder))


def p6_usage(spark: SparkSession, folder: str) -> DataFrame:
    """How full the batches are, per language."""
    from coppice.llm.packing import usage

    return usage(p6_batches(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences that had to be divided among batches."""
    from coppice.llm.packing import divided

    return divided(p6_batches(spark, folder))


def _programs(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, name, "index", "code", "repository", "collected_at") for name in ("train", "valid", "test")]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Programs of valid and test that also stand in train."""
    from coppice.llm.overlap import overlaps

    return overlaps(*_programs(spark, folder))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping programs per split and repository."""
    from coppice.llm.overlap import report

    return report(*_programs(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    from coppice.llm.bpe import encode

    return encode(table(spark, folder, "documents", "doc_id", "text"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of the documents: every output slot with its block."""
    from coppice.llm.mixing import mix

    return mix(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source reaches in the mix."""
    from coppice.llm.mixing import mix

    return mix(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mix_targets"))[1]


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal information replaced by typed placeholders."""
    from coppice.llm.pii import redact

    common = [r[0] for r in table(spark, folder, "vocabulary", "token").collect()]
    return redact(table(spark, folder, "documents", "doc_id", "text"), common)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct personal texts of each type in each document."""
    one = p10_redacted(spark, folder).select("doc_id", F.explode("found").alias("f"))
    return one.select("doc_id", "f.pii_type", "f.pii_text").distinct()


def queries() -> dict:
    names = [p1_found, p1_groups, p2_found, p2_splits, p2_shares, p2_strict, p2_crossings, p3_found, p3_files, p3_rates, p4_found, p4_labels, p5_found, p5_pieces, p6_found, p6_batches, p6_usage, p7_found, p7_report, p8_ids, p9_mix, p9_shares, p10_found, p10_redacted]
    return {f.__name__: f for f in names}


#: White space as the words of problem 7 know it, beyond what the SQL's own class holds.
_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _similar_sql(sets: str, select: str, where: str) -> str:
    """Pairs of rows of ``sets(id, side, item)`` (items distinct) with six tenths of their items in common."""
    return f"""{sets}, z AS (SELECT id, any_value(side) AS side, count(*) AS n FROM s GROUP BY id), m AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM s a JOIN s b ON a.item = b.item AND {where} GROUP BY 1, 2)
        SELECT {select} FROM m JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE o * 10 >= (x.n + y.n - o) * 6"""


def _sequence_sql() -> str:
    from coppice.functions.languages import ALIAS_OF

    cases = " ".join(f"WHEN '{a}' THEN '{x}'" for a, x in ALIAS_OF.items())
    return f"""f AS (SELECT file_id, data, CASE lower(trim(language)) {cases} END AS lang FROM code_data WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC, len(data) DESC) = 1),
        q AS (SELECT f.file_id, f.data, l.max_tokens, l.max_tokens_in_batch FROM f JOIN batch_limits l ON l.language = CASE WHEN lang IN (SELECT language FROM batch_limits) THEN lang ELSE 'any' END)"""


def oracle_sql() -> dict:
    """SQL that compares everything with everything: for small tables, as a check."""
    trees = """WITH t AS (SELECT * FROM code_trees WHERE file_id IS NOT NULL AND tokens IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1),
        p AS (SELECT file_id, generate_subscripts(tokens, 1)::INT - 1 AS idx, unnest(tokens) AS token, unnest(parents) AS parent FROM t),
        l AS (SELECT *, lead(parent) OVER (PARTITION BY file_id ORDER BY idx) AS after FROM p), k AS (SELECT file_id AS id, idx, token FROM l WHERE after IS DISTINCT FROM idx AND token >= 15),
        r AS (SELECT id, token, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2, lead(token, 3) OVER w AS t3, count(*) OVER (PARTITION BY id) AS words FROM k WINDOW w AS (PARTITION BY id ORDER BY idx)),
        s AS MATERIALIZED (SELECT DISTINCT id, 0 AS side, [token, t1, t2, t3] AS item FROM r WHERE words >= 20 AND t3 IS NOT NULL)"""
    programs = f"""WITH e AS (SELECT index, code, collected_at, 'train' AS side FROM train UNION ALL SELECT index, code, collected_at, 'valid' FROM valid UNION ALL SELECT index, code, collected_at, 'test' FROM test),
        d AS (SELECT * FROM e WHERE index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index ORDER BY collected_at DESC) = 1), w AS (SELECT index AS id, side, regexp_extract_all(code, '[A-Za-z0-9_]+|[^{_SPACE}A-Za-z0-9_]') AS l FROM d WHERE code IS NOT NULL),
        r AS (SELECT id, side, l, unnest(range(1, len(l) - 2)) AS i FROM w WHERE len(l) >= 20), s AS MATERIALIZED (SELECT DISTINCT id, side, l[i:i + 3] AS item FROM r)"""
    return {
        "p1_found": _similar_sql(trees, "a AS file_id_a, b AS file_id_b", "a.id < b.id"),
        "p5_found": f"""WITH {_sequence_sql()}, o AS (SELECT file_id, data, max_tokens FROM q WHERE len(data) > max_tokens), u AS (SELECT file_id, max_tokens, generate_subscripts(data, 1) AS pos, unnest(data) AS token FROM o),
        n AS (SELECT *, coalesce(sum(CASE WHEN token IN (9, 10) THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM u), c AS (SELECT file_id, line, max_tokens, count(*) AS n FROM n GROUP BY ALL)
        SELECT file_id, CASE WHEN max(n) > any_value(max_tokens) THEN 'forced' ELSE 'clean' END AS cut FROM c GROUP BY 1""",
        "p6_found": f"WITH {_sequence_sql()} SELECT file_id FROM q WHERE len(data) > max_tokens_in_batch",
        "p7_found": _similar_sql(programs, "y.side AS split, a AS train_index, b AS eval_index", "a.side = 'train' AND b.side <> 'train'"),
    }
