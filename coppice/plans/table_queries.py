"""Queries over programs, snippets, documents and paths, and random changes to trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice.functions.languages import EXTENSIONS, extension, language_identifier
from coppice.functions.uniform import generator
from coppice.operators import augment as A
from coppice.operators import batching as B
from coppice.operators import identifiers as I
from coppice.operators import ranking as R
from coppice.operators import text as P
from coppice.operators import tokens as X
from coppice.operators import tree_arrays as ta
from coppice.operators import trees as N
from coppice.plans.token_queries import _lang_sql
from coppice.plans.tree_queries import _N, _R, _SUBTREE, _trees, _vocabulary_ids
from coppice.sources.tables import table

SEED = 42
HOST = "https://code.example.org"


def alias_lookup(spark, folder):
    names = table(spark, folder, "code_data", "language").where("language is not null").groupBy("language").agg(F.count("*").alias("n"))
    return names.select("language", language_identifier(F.col("language")).alias("identifier"), "n")


def extension_language(spark, folder):
    """The languages of every path: by extension and, where several have it, by files of the same name
    with another of a language's extensions; ties stay."""
    rows = [(e, lang) for lang, es in EXTENSIONS.items() for e in es]
    dim = spark.createDataFrame(rows, "ext string, lang string")
    paths = table(spark, folder, "code_data", "path").where("path is not null").distinct().withColumn("ext", extension(F.col("path")))
    paths = paths.where("ext <> ''").withColumn("stem", F.expr("substr(path, 1, length(path) - length(ext))"))
    can = paths.join(F.broadcast(dim), "ext")
    other = can.select("path", "stem", "lang", "ext").join(F.broadcast(dim.withColumnRenamed("ext", "other")), "lang").where("other <> ext")
    seen = other.join(paths.select("stem", F.col("ext").alias("other")), ["stem", "other"], "left_semi").groupBy("path", "lang").agg(F.count("*").alias("points"))
    scored = can.join(seen, ["path", "lang"], "left").withColumn("points", F.coalesce("points", F.lit(0)))
    best = scored.withColumn("r", F.rank().over(W.partitionBy("path").orderBy(F.desc("points")))).where("r = 1")
    return best.select("path", "lang")


def identifier_symbols(spark, folder):
    """Every language's identifier nonterminals by class, with their ids in the vocabulary."""
    rows = [(lang, c, s) for lang, classes in I.SYMBOLS.items() for c, group in zip(I.CLASSES, classes) for s in group]
    dim = spark.createDataFrame(rows, "lang string, class string, token string")
    return dim.join(F.broadcast(table(spark, folder, "vocabulary")), "token", "left").select("lang", "class", "token", "token_id")


def meta_urls(spark, folder):
    rows = table(spark, folder, "code_data", "repository", "path").where("repository is not null and path is not null and instr(path, '/') > 0").where(F.col("repository").rlike("^[^/:]+/[^/:]+$")).distinct()
    r, p = F.col("repository"), F.col("path")
    return rows.select("repository", "path", P.repository_name(r).alias("name"), P.branch(r, p).alias("branch"), P.path_from_root(p).alias("from_root"), P.file_url(r, p, HOST).alias("url"))


def split_by_label_range(spark, folder):
    """Programs by the range of their label: up to 64 train, up to 80 valid, up to 194 test."""
    every = None
    for name in ("train", "valid", "test"):
        one = N.newest(table(spark, folder, name, "index", "label", "collected_at"), "index", "collected_at").select("index", F.expr("try_cast(trim(label) as double)").cast("int").alias("label"))
        every = one if every is None else every.union(one)
    split = F.when(F.col("label").between(1, 64), "train").when(F.col("label").between(65, 80), "valid").when(F.col("label").between(81, 194), "test")
    return every.withColumn("split", split).where("split is not null").groupBy("split", "label").agg(F.count("*").alias("n"))


def split_by_id_list(spark, folder):
    """Programs of train whose position is in a list: here, the positions of multiples of 3."""
    rows = N.newest(table(spark, folder, "train", "index", "code", "collected_at"), "index", "collected_at").withColumn("idx", F.col("index").cast("long") - 100_000_000)
    most = rows.agg(F.max("idx")).first()[0]
    ids = spark.range(0, max(0, (-1 if most is None else most) + 1), 3).select(F.col("id").alias("idx"))
    return rows.join(ids, "idx", "left_semi").select("index", "idx", F.length("code").alias("chars"))


def pair_length_filter(spark, folder):
    """Masked methods and their targets within 1200 and 120 characters, target not above the source."""
    rows = table(spark, folder, "cocos").where("method_masked is not null and target is not null")
    kept = X.pair_length_filter(rows, F.length("method_masked"), F.length("target"), 1200, 120, source_at_least_target=True)
    return kept.select("query_id", F.length("method_masked").alias("source"), F.length("target").alias("target"))


def format_masks(spark, folder):
    rows = table(spark, folder, "cocos", "query_id", "method_masked").where("method_masked is not null")
    return rows.select("query_id", F.md5(X.format_masks(F.col("method_masked"))).alias("formatted"), F.md5(X.remove_specials(F.col("method_masked"))).alias("removed"))


def line_window(spark, folder):
    """The method's lines within the masked file (as many fewer as the mask stands for)."""
    rows = table(spark, folder, "cocos").where("mask_start is not null and mask_end is not null").withColumn("last", F.col("method_end") - (F.col("mask_end") - F.col("mask_start")))
    return P.line_window(rows, "query_id", "context_masked", "method_start", "last")


def encode_lines(spark, folder):
    """Lines 3 to 4 of every parsed file masked: context and target."""
    rows = N.newest(table(spark, folder, "parsing_outputs", "file_id", "code", "parsed_at"), "file_id", "parsed_at").where("code is not null and length(code) - length(replace(code, '\n', '')) >= 4")
    m = P.masked_lines(F.col("code"), F.lit(3), F.lit(4))
    return rows.select("file_id", m.alias("m")).select("file_id", F.md5("m.context").alias("context"), "m.target")


def index_with_distractors(spark, folder):
    """The search index: targets labelled by the rank of their problem, and documents of label 0."""
    rows = table(spark, folder, "cocos", "query_id", "problem", "target").where("problem is not null and target is not null")
    targets = rows.join(R.ranked(rows, "problem", "label"), "problem").select("query_id", "label", P.stripped(F.col("target")).alias("code"))
    docs = table(spark, folder, "documents", "text", "source").where("text is not null and source = 'snippets'")
    distractors = docs.select(F.lit(-1).cast("long").alias("query_id"), F.lit(0).alias("label"), P.stripped(F.col("text")).alias("code"))
    return targets.unionByName(distractors).select("query_id", "label", F.length("code").alias("original_length"), F.md5("code").alias("code"))


def length_order(spark, folder):
    """The search index by untruncated length, shortest first; sorted in ranges, not in one task."""
    return index_with_distractors(spark, folder).orderBy("original_length", "query_id", "code")


def language_files(spark, folder):
    """How many files each language has, whatever its spelling."""
    files = N.newest(table(spark, folder, "code_data", "file_id", "language", "ingested_at"), "file_id", "ingested_at")
    return files.groupBy(language_identifier(F.col("language")).alias("language")).agg(F.count("*").alias("files"))


def mclass_sampler(spark, folder):
    """Batches with four programs of every label."""
    rows = N.newest(table(spark, folder, "train", "index", "label", "collected_at"), "index", "collected_at").where("label is not null")
    return B.per_class(rows, "label", "index", 4, SEED).select("index", "label", "batch")


def dedent_text(spark, folder):
    rows = N.newest(table(spark, folder, "parsing_outputs", "file_id", "code", "parsed_at"), "file_id", "parsed_at").where("code is not null")
    return rows.select("file_id", F.md5(X.dedented(F.col("code"), 4)).alias("dedented"))


def indent_tokens(spark, folder):
    """The indentation of every line of the parsed files as tokens, counted by width."""
    rows = N.newest(table(spark, folder, "parsing_outputs", "file_id", "code", "parsed_at"), "file_id", "parsed_at").where("code is not null")
    widths = P.lines_of(rows, "file_id", "code").select(F.length(F.regexp_extract("line", "^( *)", 1)).alias("spaces")).groupBy("spaces").agg(F.count("*").alias("lines"))
    return widths.select("spaces", F.array_join(F.transform(X.indentation_tokens(F.col("spaces")), lambda x: x.cast("string")), ",").alias("tokens"), "lines")


def embedding_norms(spark, folder):
    from coppice.operators.retrieval import normalised

    unit = table(spark, folder, "embeddings").select("vec_id", normalised(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squares"), F.round(F.element_at("u", 1), 6).alias("first"))


def parse_unparse(spark, folder):
    """Bracket trees of the parsed files: nodes, errors, and whether the leaves give the text back."""
    rows = N.newest(table(spark, folder, "parsing_outputs", "file_id", "code", "parsed_at"), "file_id", "parsed_at").where("code is not null")

    def build(code):
        parents, labels, errors = P.bracket_tree(code)
        return [(len(labels), errors, P.unparse(parents, labels) == code)]

    return N.tree_map(rows, ["file_id"], ["code"], build, "nodes int, errors int, same boolean")


def bracket_balance(spark, folder):
    """Opening and closing brackets of every parsed file."""
    rows = N.newest(table(spark, folder, "parsing_outputs", "file_id", "code", "parsed_at"), "file_id", "parsed_at").where("code is not null")
    count = lambda cs: F.length("code") - F.length(F.translate("code", cs, ""))
    return rows.select("file_id", count("([{").alias("opening"), count(")]}").alias("closing"))


def bpe_round_trip(spark, folder, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.json"):
    """Leaves of bracket trees split into sub-tokens and joined again."""
    rows = N.newest(table(spark, folder, "parsing_outputs", "file_id", "code", "parsed_at"), "file_id", "parsed_at").where("code is not null")
    kept: list = []

    def build(code):
        if not kept:
            kept.append(P.byte_pieces(tokenizer))
        parents, labels, _ = P.bracket_tree(code)
        sp, sl = P.split_leaves(parents, labels, kept[0])
        return [(len(labels), len(sl), P.join_leaves(sp, sl) == (parents, labels))]

    return N.tree_map(rows, ["file_id"], ["code"], build, "nodes int, split_nodes int, same boolean")


def truncate_fold(spark, folder):
    """Trees of more than 300 leaves folded, with the parts folded away."""
    fold = _vocabulary_ids(spark, folder, "FOLD0")
    cfg = A.FoldConfig(max_tree=300, max_subtree=300, min_subtree=30)

    def build(file_id, parents, tokens):
        t = ta.Tree(parents, tokens)
        return [(k, *N._out(x)) for k, x in enumerate(A.fold(t, fold, generator(SEED, "fold", file_id), cfg))]

    return N.tree_map(_trees(spark, folder), ["file_id"], ["file_id", "parents", "tokens"], build, "part int, " + N.TREE)


def mask_span_tree(spark, folder):
    """One span of about a quarter of every tree masked: size of the rest and the masked leaves."""

    def build(file_id, parents, tokens):
        got = A.mask_span(ta.Tree(parents, tokens), 2000, generator(SEED, "span", file_id), share=0.25)
        return [] if got is None else [([int(x) for x in got[0].leaves()], [int(x) for x in got[1]])]

    return N.tree_map(_trees(spark, folder), ["file_id"], ["file_id", "parents", "tokens"], build, "source array<int>, target array<int>")


def mask_random_spans(spark, folder):
    def build(file_id, tokens):
        m = A.mask_random_spans(len(tokens), 0.15, 3.0, generator(SEED, "spans", file_id))
        return [(int(m.sum()), len(m), int((m[1:] & ~m[:-1]).sum() + (m[:1].sum() if len(m) else 0)))]

    return N.tree_map(_trees(spark, folder), ["file_id"], ["file_id", "tokens"], build, "masked int, n int, spans int")


def mask_subtrees(spark, folder):
    def build(file_id, parents, tokens):
        got = A.mask_subtrees(ta.Tree(parents, tokens), range(2000, 1 << 20), 0.15, 6.0, generator(SEED, "subtrees", file_id))
        return [] if got is None else [tuple([int(x) for x in side] for side in got)]

    return N.tree_map(_trees(spark, folder), ["file_id"], ["file_id", "parents", "tokens"], build, "source array<int>, target array<int>")


def identifier_occurrences(spark, folder):
    """How often each distinct identifier of a file occurs, and where first."""
    symbol = _vocabulary_ids(spark, folder, "[identifier]")[0]

    def build(parents, tokens):
        nodes, numbers, first = I.occurrences(parents, tokens, symbol)
        return [(k, first[k], numbers.count(k)) for k in sorted(first)]

    return N.tree_map(_trees(spark, folder), ["file_id"], ["parents", "tokens"], build, "identifier int, first_node int, n int").select("file_id", "first_node", "n")


def identifier_mask(spark, folder):
    symbol = _vocabulary_ids(spark, folder, "[identifier]")[0]

    def build(file_id, parents, tokens):
        got = I.mask_identifiers(parents, tokens, symbol, range(2000, 1 << 20), generator(SEED, "identifiers", file_id))
        return [] if got is None else [tuple([int(x) for x in side] for side in got)]

    return N.tree_map(_trees(spark, folder), ["file_id"], ["file_id", "parents", "tokens"], build, "source array<int>, target array<int>")


def unique_identifiers_pair(spark, folder):
    """The first and the second half of every tree as a pair in which shared names stand on one side."""
    symbol = _vocabulary_ids(spark, folder, "[identifier]")[0]

    def build(file_id, parents, tokens):
        t = ta.Tree(parents, tokens)
        kids = ta.children_of(t.parents, 0).tolist()
        if len(kids) < 2:
            return []
        half = len(kids) // 2
        pair = [ta.Tree.cat([t.subtree(k) for k in part], tokens[0]) for part in (kids[:half], kids[half:])]
        got = I.unique_identifiers(tuple((x.parents, x.columns[0]) for x in pair), symbol, range(2000, 1 << 20), generator(SEED, "unique", file_id))
        return [] if got is None else [tuple([int(x) for x in side] for side in got)]

    return N.tree_map(_trees(spark, folder), ["file_id"], ["file_id", "parents", "tokens"], build, "source array<int>, target array<int>")


_V = "values_ AS (SELECT * FROM (VALUES {}) t({}))"
_PO = "p AS (SELECT * FROM parsing_outputs WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY parsed_at DESC) = 1)"
_TR = "p AS (SELECT * FROM train WHERE index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index ORDER BY collected_at DESC) = 1)"
_EXT = ", ".join(f"('{e}', '{lang}')" for lang, es in EXTENSIONS.items() for e in es)
_SYM = ", ".join(f"('{lang}', '{c}', '{s}')" for lang, classes in I.SYMBOLS.items() for c, group in zip(I.CLASSES, classes) for s in group)

QUERIES = [
    alias_lookup, extension_language, identifier_symbols, meta_urls, split_by_label_range, split_by_id_list, pair_length_filter, format_masks, line_window, encode_lines, index_with_distractors, length_order, language_files, mclass_sampler, dedent_text,
    indent_tokens, embedding_norms, parse_unparse, bracket_balance, bpe_round_trip, truncate_fold, mask_span_tree, mask_random_spans, mask_subtrees, identifier_occurrences, identifier_mask, unique_identifiers_pair,
]
SQL = {
    "alias_lookup": f"SELECT language, {_lang_sql('language')} AS identifier, count(*) AS n FROM code_data WHERE language IS NOT NULL GROUP BY 1, 2",
    "extension_language": f"""WITH d AS (SELECT * FROM (VALUES {_EXT}) t(ext, lang)), p0 AS (SELECT DISTINCT path, regexp_extract(path, '[^/](\\.[^./]*)$', 1) AS ext FROM code_data WHERE path IS NOT NULL),
        p AS (SELECT path, ext, substr(path, 1, length(path) - length(ext)) AS stem FROM p0 WHERE ext <> ''), c AS (SELECT p.*, lang FROM p JOIN d USING (ext)),
        s AS (SELECT c.path, c.lang, count(*) AS points FROM c JOIN d ON d.lang = c.lang AND d.ext <> c.ext JOIN p o ON o.stem = c.stem AND o.ext = d.ext GROUP BY 1, 2),
        r AS (SELECT c.path, c.lang, rank() OVER (PARTITION BY c.path ORDER BY coalesce(points, 0) DESC) AS r FROM c LEFT JOIN s ON s.path = c.path AND s.lang = c.lang) SELECT path, lang FROM r WHERE r = 1""",
    "identifier_symbols": f"SELECT lang, class, t.token, token_id FROM (VALUES {_SYM}) t(lang, class, token) LEFT JOIN vocabulary v ON v.token = t.token",
    "meta_urls": f"""WITH r AS (SELECT DISTINCT repository, path, split_part(repository, '/', 2) AS name FROM code_data WHERE repository IS NOT NULL AND contains(path, '/') AND regexp_matches(repository, '^[^/:]+/[^/:]+$')),
        b AS (SELECT *, replace(split_part(path, '/', 1), name || '-', '') AS branch, regexp_replace(path, '^[^/]*/', '') AS from_root FROM r) SELECT *, '{HOST}/' || repository || '/blob/' || branch || '/' || from_root AS url FROM b""",
    "split_by_label_range": """WITH a AS (SELECT * FROM train UNION ALL SELECT * FROM valid UNION ALL SELECT * FROM test), p AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY index ORDER BY collected_at DESC) = 1),
        l AS (SELECT try_cast(trim(label) AS DOUBLE)::INT AS label FROM p), s AS (SELECT CASE WHEN label BETWEEN 1 AND 64 THEN 'train' WHEN label BETWEEN 65 AND 80 THEN 'valid' WHEN label BETWEEN 81 AND 194 THEN 'test' END AS split, label FROM l)
        SELECT split, label, count(*) AS n FROM s WHERE split IS NOT NULL GROUP BY 1, 2""",
    "split_by_id_list": f"WITH {_TR} SELECT index, index::BIGINT - 100000000 AS idx, length(code)::INT AS chars FROM p WHERE (index::BIGINT - 100000000) % 3 = 0 AND index::BIGINT >= 100000000",
    "pair_length_filter": "SELECT query_id, length(method_masked)::INT AS source, length(target)::INT AS target FROM cocos WHERE length(method_masked) <= 1200 AND length(target) <= 120 AND length(method_masked) >= length(target)",
    "format_masks": "SELECT query_id, md5(regexp_replace(method_masked, '___MASK(\\d*)___', ' [MASK\\1] ', 'g')) AS formatted, md5(regexp_replace(method_masked, 'VAR\\d+|FOLD\\d+|___MASK\\d*___|\\[(SEP|PAD|" + "|".join(X.LANGUAGE_TOKENS) + ")\\]', '', 'g')) AS removed FROM cocos WHERE method_masked IS NOT NULL",
    "line_window": "SELECT query_id, array_to_string(string_split(context_masked, chr(10))[greatest(method_start, 1):greatest(method_start, 1) + greatest(method_end - (mask_end - mask_start) - method_start + 1, 0) - 1], chr(10)) AS text FROM cocos WHERE context_masked IS NOT NULL AND mask_start IS NOT NULL AND mask_end IS NOT NULL AND method_start IS NOT NULL AND method_end IS NOT NULL",
    "encode_lines": f"""WITH {_PO}, l AS (SELECT file_id, string_split(code, chr(10)) AS l FROM p WHERE length(code) - length(replace(code, chr(10), '')) >= 4), s AS (SELECT *, l[3] || chr(10) || l[4] AS span, regexp_extract(l[3] || chr(10) || l[4], '^([ \\t]*)', 1) AS lead FROM l)
        SELECT file_id, md5(array_to_string(list_concat(list_concat(l[1:2], [lead || '___MASK___']), l[5:]), chr(10))) AS context, substr(span, length(lead) + 1) AS target FROM s""",
    "index_with_distractors": """WITH t AS (SELECT query_id, (dense_rank() OVER (ORDER BY problem))::INT AS label, regexp_replace(target, '^\\s+', '') AS code FROM cocos WHERE problem IS NOT NULL AND target IS NOT NULL),
        u AS (SELECT * FROM t UNION ALL SELECT -1, 0, regexp_replace(text, '^\\s+', '') FROM documents WHERE text IS NOT NULL AND source = 'snippets') SELECT query_id, label, length(code)::INT AS original_length, md5(code) AS code FROM u""",
    "language_files": f"WITH f AS (SELECT * FROM code_data WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1) SELECT {_lang_sql('language')} AS language, count(*) AS files FROM f GROUP BY 1",
    "mclass_sampler": f"WITH {_TR} SELECT index, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '{SEED}', 'per_class', index)), index) - 1) // 4)::INT AS batch FROM p WHERE label IS NOT NULL",
    "dedent_text": f"WITH {_PO}, l AS (SELECT file_id, list_transform(string_split(code, chr(10)), lambda x: regexp_replace(x, '^ {{1,4}}', '')) AS l FROM p WHERE code IS NOT NULL) SELECT file_id, md5(array_to_string(l, chr(10))) AS dedented FROM l",
    "indent_tokens": f"""WITH {_PO}, l AS (SELECT length(regexp_extract(unnest(string_split(code, chr(10))), '^( *)', 1))::INT AS n FROM p WHERE code IS NOT NULL)
        SELECT n AS spaces, rtrim(repeat('11,', (n // 8)::INT) || repeat('12,', (n % 8 // 4)::INT) || repeat('13,', (n % 4 // 2)::INT) || repeat('14,', (n % 2)::INT), ',') AS tokens, count(*) AS lines FROM l GROUP BY 1""",
    "embedding_norms": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS n FROM e) SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 6) AS squares, round(v[1] / n, 6) AS first FROM n",
    "identifier_occurrences": _R
    + _N
    + f""", g AS MATERIALIZED (SELECT file_id, list(descendants ORDER BY idx) AS d FROM n GROUP BY 1), y AS (SELECT max(token_id) AS symbol FROM vocabulary WHERE token = '[identifier]'),
        k AS (SELECT n.file_id, n.idx, {_SUBTREE} AS c FROM n JOIN t USING (file_id) JOIN g USING (file_id) JOIN y ON n.token = y.symbol WHERE n.descendants > 0) SELECT file_id, min(idx) AS first_node, count(*)::INT AS n FROM k GROUP BY file_id, c""",
    "bracket_balance": f"WITH {_PO} SELECT file_id, length(regexp_replace(code, '[^(\\[{{]', '', 'g'))::INT AS opening, length(regexp_replace(code, '[^)\\]}}]', '', 'g'))::INT AS closing FROM p WHERE code IS NOT NULL",
}
SQL["length_order"] = SQL["index_with_distractors"]
