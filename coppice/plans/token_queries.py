"""Queries over token sequences: code_data and its vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions.languages import language_identifier
from coppice.functions.uniform import uniform, uniform_sql
from coppice.operators import batching as B
from coppice.operators import tokens as X
from coppice.operators.collation import collated_pairs as collated
from coppice.operators.tokenizer import CodeTokenizer, detokenised, tokenised
from coppice.operators.trees import newest
from coppice.sources.tables import table

SEED = 42
#: Mask tokens of these queries: ids beyond the vocabulary.
MASKS = range(2000, 1 << 30)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return newest(table(spark, folder, "code_data"), "file_id", "ingested_at")


def _data(spark, folder):
    return _files(spark, folder).where("data is not null").select("file_id", "data", "language")


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def line_count_filter(spark, folder):
    kept = X.lines_between(_data(spark, folder), least=10, most=200)
    return kept.select("file_id", X.newline_count(F.col("data")).alias("lines"))


def language_filter(spark, folder):
    """Files of three languages, whatever the spelling of the language."""
    kept = _files(spark, folder).where(language_identifier(F.col("language")).isin("python", "go", "cpp"))
    return kept.select("file_id", language_identifier(F.col("language")).alias("language"))


def whitespace_files(spark, folder):
    return _data(spark, folder).where(X.is_whitespace(F.col("data"))).select("file_id", F.size("data").alias("size"))


def token_text(spark, folder):
    """Length and checksum of every file's text, by looking up its tokens."""
    d = _data(spark, folder).select("file_id", "data", X.words_by_id(table(spark, folder, "vocabulary")).alias("words"))
    text = X.once(d.where(F.exists("data", lambda t: F.get("words", t).isNotNull())), "text", X.text_of(F.col("data"), F.col("words")))
    return text.select("file_id", F.length("text").alias("chars"), F.md5("text").alias("checksum"))


def truncate_tokens(spark, folder):
    return _data(spark, folder).select("file_id", F.size("data").alias("original_length"), _joined(X.truncated(F.col("data"), 64, 2)).alias("tokens"))


def add_eos_cls(spark, folder):
    both = X.with_token(X.with_token(F.col("data"), F.lit(X.EOS), front=False), F.lit(X.CLS))
    return _data(spark, folder).select("file_id", both.alias("t")).where("t is not null").select("file_id", F.size("t").alias("n"), F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))


LANGUAGE_IDS = {lang: 4000 + k for k, lang in enumerate(("c", "cpp", "go", "java", "javascript", "python"))}


def add_language_token(spark, folder):
    ids = F.create_map(*[F.lit(x) for kv in LANGUAGE_IDS.items() for x in kv])
    lang = language_identifier(F.col("language"))
    t = X.with_token(F.col("data"), F.element_at(ids, lang))
    return _data(spark, folder).select("file_id", t.alias("t")).where("t is not null").select("file_id", F.element_at("t", 1).alias("first"), F.size("t").alias("n"))


def shifted_sequences(spark, folder):
    """Every whole sequence shifted: its own last token first."""
    return _data(spark, folder).select("file_id", F.size("data").alias("n"), F.md5(_joined(X.shifted(F.col("data")))).alias("tokens"))


def padded_sequences(spark, folder):
    """Every whole sequence, padded to the next multiple of 64, and which places hold a token."""
    d, width = F.col("data"), (F.ceil(F.size("data") / 64) * 64).cast("int")
    mask = F.array_join(F.transform(X.attention(d, width), lambda x: x.cast("int").cast("string")), "")
    return _data(spark, folder).select("file_id", width.alias("width"), F.md5(_joined(X.padded(d, width))).alias("tokens"), F.md5(mask).alias("mask"))


def token_runs(spark, folder):
    """Runs of equal tokens of length 2 or more."""
    long = F.filter(X.array_runs(F.col("data")), lambda r: r["length"] > 1)
    return _data(spark, folder).select("file_id", F.explode(long).alias("r")).select("file_id", "r.start", "r.length", "r.value")


def _masked_pairs(spark, folder, p, op, protected=None):
    """``file_id, p.source, p.target`` of every file with a masked token."""
    drawn = X.once(_data(spark, folder).select("file_id", "data"), "m", X.random_mask(F.col("data"), F.col("file_id"), p, SEED, op, protected))
    return X.once(drawn, "p", X.source_and_target(F.col("data"), F.col("m"), MASKS)).where("p is not null").select("file_id", "p")


def mask_bernoulli(spark, folder):
    """Tokens masked at random, one in eight; fold tokens never."""
    out = _masked_pairs(spark, folder, 0.125, "mask_random", lambda t: t == 1177)
    return out.select("file_id", F.md5(_joined(F.col("p.source"))).alias("source"), F.md5(_joined(F.col("p.target"))).alias("target"), F.size("p.source").alias("n_source"), F.size("p.target").alias("n_target"))


def mask_token_span(spark, folder):
    u = uniform(SEED, "mask_span", F.col("file_id"))
    pair = X.span_masked(F.col("data"), 0.25, u, MASKS[0])
    out = _data(spark, folder).select("file_id", pair.alias("p")).where("p is not null")
    return out.select("file_id", F.md5(_joined(F.col("p.source"))).alias("source"), F.md5(_joined(F.col("p.target"))).alias("target"))


def pair_truncate(spark, folder):
    """Masked pairs cut to 300 source tokens."""
    pairs = _masked_pairs(spark, folder, 0.01, "pair_truncate").select("file_id", "p.source", "p.target", F.filter("p.source", lambda t: t >= MASKS[0]).alias("masks"))
    cut = X.once(pairs, "c", X.truncated_pair(F.col("source"), F.col("target"), 300, F.col("masks"))).where("c is not null")
    return cut.select("file_id", F.size("c.source").alias("n_source"), F.md5(_joined(F.col("c.target"))).alias("target"))


def dispatch(spark, folder):
    """Each file goes to one of three transforms at random; what a transform cannot do, the next does."""
    d = F.col("data")
    whole = F.when(F.size(d) <= 400, F.struct(F.lit("whole").alias("how"), F.size(d).alias("n")))
    cut = F.struct(F.lit("cut").alias("how"), F.size(X.truncated(d, 100)).alias("n"))
    eos = F.struct(F.lit("eos").alias("how"), F.size(X.with_token(d, F.lit(X.EOS), front=False)).alias("n"))
    r = X.dispatched(uniform(SEED, "dispatch", F.col("file_id")), [0.5, 0.3, 0.2], [whole, cut, eos])
    return _data(spark, folder).select("file_id", r.alias("r")).select("file_id", "r.how", "r.n")


def first_n_per_language(spark, folder):
    known = _files(spark, folder).withColumn("lang", language_identifier(F.col("language"))).where("lang is not null")
    return B.first_per_group(known, "lang", "file_id", 5).select("lang", "file_id")


def shard_scan(spark, folder):
    return B.sharded(_files(spark, folder), "file_id", 1, 4).select("file_id", F.size("data").alias("size"))


def file_shards(spark, folder):
    """Every file with the worker of four that reads it."""
    return _files(spark, folder).select("file_id", B.shard("file_id", 4).alias("shard"), F.size("data").alias("size"))


def _sized(spark, folder):
    lang = F.coalesce(language_identifier(F.col("language")), F.lit("unknown"))
    return _data(spark, folder).select("file_id", lang.alias("lang"), F.size("data").alias("size"))


def _longest(spark, folder, buckets: int) -> int:
    """The largest size of the table, outdated rows included: no file is above it, and no bucket has width 0."""
    return max(table(spark, folder, "code_data").agg(F.max(F.size("data"))).first()[0] or 0, buckets)


def bucket_batches(spark, folder):
    """Batches of all files, budget 32000 or the longest file, ten buckets with files above 4000 tokens in the last, four shards."""
    longest = _longest(spark, folder, 10)
    return B.batched(_sized(spark, folder), [], "size", ["file_id"], budget=max(32_000, longest), longest=longest, buckets=10, even=4_000, shards=4)


def language_batches(spark, folder):
    longest = _longest(spark, folder, 10)
    b = B.batched(_sized(spark, folder), ["lang"], "size", ["file_id"], budget=max(32_000, longest), longest=longest, buckets=10, even=4_000, shards=4)
    return B.batch_report(b, ["lang", "bucket0", "shard", "batch"], "size")


def collated_batches(spark, folder):
    """Batches of all files, padded. Batches are made from sizes alone: a bucket's tokens are never one task."""
    d = _data(spark, folder).select("file_id", "data")
    longest = _longest(spark, folder, 3)
    b = B.batched(d.select("file_id", F.size("data").alias("size")), [], "size", ["file_id"], budget=max(6_000, longest), longest=longest, buckets=3)
    c = X.collated(b.join(d, "file_id"), ["bucket0", "batch"], "data", "file_id")
    return c.select("bucket0", "batch", "nsamples", "ntokens", F.size(F.col("tokens")[0]).alias("width"), F.md5(_joined(F.flatten("tokens"))).alias("tokens"), _joined(F.col("ids")).alias("ids"))


def _pairs(spark, folder):
    """A span of every file masked: ``file_id, lang, source, target``, the target with its end token."""
    u = uniform(SEED, "mask_span", F.col("file_id"))
    lang = F.coalesce(language_identifier(F.col("language")), F.lit("unknown"))
    both = X.once(_data(spark, folder).select("file_id", "data", lang.alias("lang")), "p", X.span_masked(F.col("data"), 0.25, u, MASKS[0])).where("p is not null")
    both = both.select("file_id", "lang", F.col("p.source").alias("source"), F.array_append("p.target", F.lit(X.EOS)).alias("target"))
    return both.withColumns({"n_source": F.size("source"), "n_target": F.size("target")})


def _paired(spark, folder, keys):
    pairs = _pairs(spark, folder)
    longest = max(pairs.agg(F.max(F.greatest("n_source", "n_target"))).first()[0] or 0, 4)
    sizes = pairs.select("file_id", *keys, "n_source", "n_target")
    return pairs, B.batched(sizes, keys, "n_source", ["file_id"], budget=max(24_000, longest), longest=longest, buckets=4, sizes=["n_source", "n_target"], shards=2, even=3_000)


def pair_batches(spark, folder):
    """Batches of pairs over a grid of buckets of source and target sizes; the longer side counts."""
    return _paired(spark, folder, [])[1]


def language_pair_batches(spark, folder):
    """A grid of buckets for every language: pairs and padded cost of every batch."""
    b = _paired(spark, folder, ["lang"])[1].withColumn("size", F.greatest("n_source", "n_target"))
    return B.batch_report(b, ["lang", "bucket0", "bucket1", "shard", "batch"], "size")


def collated_pairs(spark, folder):
    """Every batch of pairs as padded matrices, with the targets that feed a decoder."""
    pairs, b = _paired(spark, folder, [])
    c = collated(b.select("file_id", "bucket0", "bucket1", "shard", "batch").join(pairs, "file_id"), ["bucket0", "bucket1", "shard", "batch"], "file_id", left_source=True)
    text = lambda c: F.md5(_joined(F.flatten(c))).alias(c)
    return c.select("bucket0", "bucket1", "shard", "batch", "nsamples", "source_ntokens", "target_ntokens", _joined(F.col("ids")).alias("ids"), *[text(x) for x in ("source_tokens", "target_tokens", "shifted_tokens")])


def modified_pairs(spark, folder):
    """A token put in front of the source, of the target, or of both."""
    pairs = _pairs(spark, folder)
    first = lambda t: X.with_token(t, F.lit(X.CLS))
    out = [X.modified(F.struct("source", "target"), first, source=a, target=b).alias(n) for n, a, b in (("s", True, False), ("t", False, True), ("st", True, True))]
    size = [F.size(f"{n}.{side}").alias(f"{n}_{side}") for n in ("s", "t", "st") for side in ("source", "target")]
    return pairs.select("file_id", *out).select("file_id", *size)


def text_ids_round_trip(spark, folder, tokenizer="/opt/tokenizers/byte_bpe_50k.json"):
    """Texts of the parsed files turned into ids of a public tokenizer and back."""
    rows = newest(table(spark, folder, "parsing_outputs", "file_id", "code", "parsed_at"), "file_id", "parsed_at").where("code is not null")
    coder = CodeTokenizer.load(tokenizer)
    back = detokenised(tokenised(rows, "file_id", "code", coder), "file_id", "ids", coder)
    return back.join(rows, "file_id").select("file_id", F.length("text").alias("chars"), F.md5("text").alias("checksum"), (F.col("text") == F.col("code")).alias("same"))


_F = "f AS (SELECT * FROM code_data WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1), d AS (SELECT file_id, data, language FROM f WHERE data IS NOT NULL)"
_X = _F + ", x AS (SELECT file_id, generate_subscripts(data, 1)::INT - 1 AS pos, unnest(data) AS token FROM d)"


def _lang_sql(c: str) -> str:
    from coppice.functions.languages import ALIAS_OF

    cases = " ".join(f"WHEN '{a}' THEN '{x}'" for a, x in ALIAS_OF.items())
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE coalesce(CASE {c} {cases} END, CASE lower({c}) {cases} END, {c}) END"


def _masked_sql(p: float, op: str, extra: str = "") -> str:
    return f"""{_X}, m AS (SELECT *, {uniform_sql(SEED, op, 'file_id', 'pos')} < {p} {extra} AS masked FROM x),
        n AS (SELECT *, CASE WHEN lag(masked) OVER (PARTITION BY file_id ORDER BY pos) IS NOT DISTINCT FROM masked THEN 0 ELSE 1 END AS new FROM m),
        k AS (SELECT *, 1999 + sum(CASE WHEN masked THEN new ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) AS mask FROM n)"""


_JOIN = "array_to_string(list_transform({0}, lambda z: z::VARCHAR), ',')"


_OVER = "greatest(w.most, o.size) * (w.n + 1) > o.budget"


def _greedy_sql(rows: str, keys: list[str]) -> str:
    """Batches ``b`` of rows (file_id, keys, size, budget), one row after the other within the keys."""
    by = ", ".join(keys)
    return f"""o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY {by}) AS g, row_number() OVER (PARTITION BY {by} ORDER BY file_id) AS rn FROM {rows}),
        w AS (SELECT g, rn, size AS most, 1 AS n, 0 AS batch FROM o WHERE rn = 1 UNION ALL
          SELECT o.g, o.rn, CASE WHEN {_OVER} THEN o.size ELSE greatest(w.most, o.size) END, CASE WHEN {_OVER} THEN 1 ELSE w.n + 1 END, w.batch + CASE WHEN {_OVER} THEN 1 ELSE 0 END FROM w JOIN o ON o.g = w.g AND o.rn = w.rn + 1),
        b AS (SELECT o.*, w.batch::INT AS batch FROM o JOIN w USING (g, rn))"""


def _shard_sql(shards: int) -> str:
    return f"floor({uniform_sql(0, 'shard', 'file_id')} * {shards})::INT" if shards > 1 else "0"


def _batch_sql(keys: list[str], shards: int, budget: int, buckets: int, even: str) -> str:
    """Batches of the files of a group."""
    return f"""{_F}, lim AS (SELECT greatest(max(len(data)), {buckets})::INT AS longest FROM code_data),
        z AS (SELECT file_id, coalesce({_lang_sql('language')}, 'unknown') AS lang, len(data)::INT AS size FROM d WHERE len(data) > 0),
        y AS (SELECT z.*, least(size // ({even} // {buckets}), {buckets - 1})::INT AS bucket0, {_shard_sql(shards)} AS shard, greatest({budget}, longest) AS budget FROM z, lim), {_greedy_sql('y', [*keys, 'bucket0', 'shard'])}"""


_PAIRS = f"""{_F}, a AS (SELECT file_id, coalesce({_lang_sql('language')}, 'unknown') AS lang, data, len(data) AS n, floor(len(data) * 0.25::DOUBLE + 0.5::DOUBLE)::INT AS k0, {uniform_sql(SEED, 'mask_span', 'file_id')} AS u FROM d),
        a1 AS (SELECT *, CASE WHEN k0 >= n THEN n - 1 ELSE k0 END AS k FROM a), a2 AS (SELECT *, floor(u * (n - k + 1))::INT AS at0 FROM a1 WHERE n > 1 AND k > 0),
        q AS MATERIALIZED (SELECT file_id, lang, list_concat(list_concat(data[1:at0], [2000]), data[at0 + k + 1:n]) AS source, list_concat(data[at0 + 1:at0 + k], [2]) AS target FROM a2)"""


def _pair_sql(keys: list[str]) -> str:
    return f"""{_PAIRS}, z AS (SELECT file_id, lang, len(source)::INT AS n_source, len(target)::INT AS n_target, greatest(len(source), len(target))::INT AS size FROM q), lim AS (SELECT greatest(24000, max(size)) AS budget FROM z),
        y AS (SELECT z.*, least(n_source // 750, 3)::INT AS bucket0, least(n_target // 750, 3)::INT AS bucket1, {_shard_sql(2)} AS shard, budget FROM z, lim), {_greedy_sql('y', [*keys, 'bucket0', 'bucket1', 'shard'])}"""


QUERIES = [line_count_filter, language_filter, whitespace_files, token_text, truncate_tokens, add_eos_cls, add_language_token, shifted_sequences, padded_sequences, token_runs, mask_bernoulli, mask_token_span, pair_truncate, dispatch, first_n_per_language, shard_scan, file_shards, bucket_batches, language_batches, collated_batches, pair_batches, language_pair_batches, collated_pairs, modified_pairs, text_ids_round_trip]
SQL = {
    "line_count_filter": f"WITH {_F}, n AS (SELECT file_id, (len(list_filter(data, lambda t: t = 10)) + 2 * len(list_filter(data, lambda t: t = 9)))::INT AS lines FROM d) SELECT * FROM n WHERE lines BETWEEN 10 AND 200",
    "language_filter": f"WITH {_F} SELECT file_id, {_lang_sql('language')} AS language FROM f WHERE {_lang_sql('language')} IN ('python', 'go', 'cpp')",
    "whitespace_files": f"WITH {_F} SELECT file_id, len(data)::INT AS size FROM d WHERE len(list_filter(data, lambda t: t > 14)) = 0",
    "token_text": f"WITH {_X}, w AS (SELECT file_id, string_agg(v.token, '' ORDER BY pos) AS text FROM x JOIN vocabulary v ON v.token_id = x.token GROUP BY 1) SELECT file_id, length(text)::INT AS chars, md5(text) AS checksum FROM w",
    "truncate_tokens": f"WITH {_F} SELECT file_id, len(data)::INT AS original_length, {_JOIN.format('data[1:62]')} AS tokens FROM d",
    "add_eos_cls": f"WITH {_F} SELECT file_id, (len(data) + 2)::INT AS n, 1::INT AS first, 2::INT AS last FROM d WHERE (len(data) = 0 OR (data[len(data)] <> 2 AND data[1] <> 1))",
    "add_language_token": f"WITH {_F}, g AS (SELECT file_id, data, CASE {_lang_sql('language')} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in LANGUAGE_IDS.items())} END AS i FROM d) SELECT file_id, i::INT AS first, (len(data) + 1)::INT AS n FROM g WHERE i IS NOT NULL",
    "shifted_sequences": f"WITH {_F} SELECT file_id, len(data)::INT AS n, md5({_JOIN.format('CASE WHEN len(data) > 0 THEN list_concat(data[len(data):len(data)], data[1:len(data) - 1]) ELSE data END')}) AS tokens FROM d",
    "padded_sequences": f"WITH {_F}, w AS (SELECT file_id, data, len(data)::INT AS n, ((len(data) + 63) // 64 * 64)::INT AS width FROM d) SELECT file_id, width, md5({_JOIN.format('list_resize(data, width, 3)')}) AS tokens, md5(repeat('1', n) || repeat('0', width - n)) AS mask FROM w",
    "token_runs": f"""WITH {_X}, n AS (SELECT *, CASE WHEN lag(token) OVER (PARTITION BY file_id ORDER BY pos) = token THEN 0 ELSE 1 END AS new FROM x), r AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY pos) AS run FROM n)
        SELECT file_id, min(pos) AS start, count(*)::INT AS length, min(token) AS value FROM r GROUP BY file_id, run HAVING count(*) > 1""",
    "mask_bernoulli": f"""WITH {_masked_sql(0.125, 'mask_random', 'AND token <> 1177')},
        o AS (SELECT file_id, string_agg((CASE WHEN masked THEN mask ELSE token END)::INT::VARCHAR, ',' ORDER BY pos) FILTER (WHERE NOT masked OR new = 1) AS s, count(*) FILTER (WHERE NOT masked OR new = 1) AS ns,
          string_agg((CASE WHEN new = 1 THEN mask::INT::VARCHAR || ',' ELSE '' END) || token::VARCHAR, ',' ORDER BY pos) FILTER (WHERE masked) AS t, count(*) FILTER (WHERE masked) + count(*) FILTER (WHERE masked AND new = 1) AS nt FROM k GROUP BY 1)
        SELECT file_id, md5(s) AS source, md5(t) AS target, ns::INT AS n_source, nt::INT AS n_target FROM o WHERE t IS NOT NULL""",
    "mask_token_span": f"""WITH {_F}, a AS (SELECT file_id, data, len(data) AS n, floor(len(data) * 0.25::DOUBLE + 0.5::DOUBLE)::INT AS k0, {uniform_sql(SEED, 'mask_span', 'file_id')} AS u FROM d),
        b AS (SELECT *, CASE WHEN k0 >= n THEN n - 1 ELSE k0 END AS k FROM a), c AS (SELECT *, floor(u * (n - k + 1))::INT AS at0 FROM b WHERE n > 1 AND k > 0)
        SELECT file_id, md5({_JOIN.format('list_concat(list_concat(data[1:at0], [2000]), data[at0 + k + 1:n])')}) AS source, md5({_JOIN.format('data[at0 + 1:at0 + k]')}) AS target FROM c""",
    "dispatch": f"""WITH {_F}, a AS (SELECT file_id, data, len(data) AS n, {uniform_sql(SEED, 'dispatch', 'file_id')} AS u FROM d)
        SELECT file_id, CASE WHEN u < 0.5 THEN CASE WHEN n <= 400 THEN 'whole' ELSE 'cut' END WHEN u < 0.8 THEN 'cut' ELSE 'eos' END AS how,
          (CASE WHEN u < 0.5 THEN CASE WHEN n <= 400 THEN n ELSE least(n, 100) END WHEN u < 0.8 THEN least(n, 100) WHEN n > 0 AND data[n] = 2 THEN NULL ELSE n + 1 END)::INT AS n FROM a""",
    "first_n_per_language": f"WITH {_F}, g AS (SELECT file_id, {_lang_sql('language')} AS lang FROM f) SELECT lang, file_id FROM g WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY file_id) <= 5",
    "pair_truncate": f"""WITH {_masked_sql(0.01, 'pair_truncate')},
        e AS (SELECT *, sum(CASE WHEN NOT masked OR new = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) AS place FROM k),
        g AS (SELECT file_id, max(place) AS n, count(*) FILTER (WHERE masked AND new = 1) AS runs, count(*) FILTER (WHERE masked AND new = 1 AND place <= 300) AS kept, max(mask) FILTER (WHERE masked AND new = 1 AND place <= 300) AS last FROM e GROUP BY 1),
        t AS (SELECT e.file_id, string_agg((CASE WHEN new = 1 THEN mask::INT::VARCHAR || ',' ELSE '' END) || token::VARCHAR, ',' ORDER BY pos) AS target FROM e JOIN g USING (file_id) WHERE masked AND (kept = runs OR kept = 1 OR mask <= last) GROUP BY 1)
        SELECT g.file_id, least(n, 300)::INT AS n_source, md5(target) AS target FROM g JOIN t USING (file_id) WHERE runs > 0 AND (kept = runs OR kept > 0)""",
    "bucket_batches": f"WITH RECURSIVE {_batch_sql([], 4, 32_000, 10, '4000')} SELECT file_id, lang, size, bucket0, shard, batch FROM b",
    "language_batches": f"WITH RECURSIVE {_batch_sql(['lang'], 4, 32_000, 10, '4000')} SELECT lang, bucket0, shard, batch, count(*) AS n, sum(size)::BIGINT AS tokens, (max(size) * count(*))::BIGINT AS cost FROM b GROUP BY 1, 2, 3, 4",
    "collated_batches": f"""WITH RECURSIVE {_batch_sql([], 1, 6_000, 3, 'longest')}, l AS (SELECT bucket0, batch, max(size) AS width, count(*) AS n, sum(size) AS t FROM b GROUP BY 1, 2)
        SELECT b.bucket0, b.batch, any_value(n)::INT AS nsamples, any_value(t)::BIGINT AS ntokens, any_value(width)::INT AS width, md5(string_agg({_JOIN.format('list_resize(d.data, width, 3)')}, ',' ORDER BY b.size DESC, b.file_id)) AS tokens, string_agg(b.file_id::VARCHAR, ',' ORDER BY b.size DESC, b.file_id) AS ids
        FROM b JOIN l USING (bucket0, batch) JOIN d ON d.file_id = b.file_id GROUP BY 1, 2""",
    "pair_batches": f"WITH RECURSIVE {_pair_sql([])} SELECT file_id, n_source, n_target, bucket0, bucket1, shard, batch FROM b",
    "language_pair_batches": f"WITH RECURSIVE {_pair_sql(['lang'])} SELECT lang, bucket0, bucket1, shard, batch, count(*) AS n, sum(size)::BIGINT AS tokens, (max(size) * count(*))::BIGINT AS cost FROM b GROUP BY 1, 2, 3, 4, 5",
    "collated_pairs": f"""WITH RECURSIVE {_pair_sql([])}, l AS (SELECT bucket0, bucket1, shard, batch, max(n_source) AS ws, max(n_target) AS wt FROM b GROUP BY ALL),
        x AS (SELECT b.*, ws, wt, source, target FROM b JOIN l USING (bucket0, bucket1, shard, batch) JOIN q ON q.file_id = b.file_id)
        SELECT bucket0, bucket1, shard, batch, count(*)::INT AS nsamples, sum(n_source)::BIGINT AS source_ntokens, sum(n_target)::BIGINT AS target_ntokens, string_agg(file_id::VARCHAR, ',' ORDER BY n_source DESC, file_id) AS ids,
          md5(string_agg(repeat('3,', ws - n_source) || {_JOIN.format('source')}, ',' ORDER BY n_source DESC, file_id)) AS source_tokens, md5(string_agg({_JOIN.format('list_resize(target, wt, 3)')}, ',' ORDER BY n_source DESC, file_id)) AS target_tokens,
          md5(string_agg({_JOIN.format('list_resize(list_concat([2], target[1:n_target - 1]), wt, 3)')}, ',' ORDER BY n_source DESC, file_id)) AS shifted_tokens FROM x GROUP BY 1, 2, 3, 4""",
    "modified_pairs": f"""WITH {_PAIRS}, n AS (SELECT file_id, len(source)::INT AS s, len(target)::INT AS t, source[1] = 1 AS a, target[1] = 1 AS b FROM q)
        SELECT file_id, CASE WHEN a THEN NULL ELSE s + 1 END AS s_source, CASE WHEN a THEN NULL ELSE t END AS s_target, CASE WHEN b THEN NULL ELSE s END AS t_source, CASE WHEN b THEN NULL ELSE t + 1 END AS t_target,
          CASE WHEN a OR b THEN NULL ELSE s + 1 END AS st_source, CASE WHEN a OR b THEN NULL ELSE t + 1 END AS st_target FROM n""",
    "text_ids_round_trip": "WITH p AS (SELECT * FROM parsing_outputs WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY parsed_at DESC) = 1) SELECT file_id, length(code)::INT AS chars, md5(code) AS checksum, true AS same FROM p WHERE code IS NOT NULL",
    "shard_scan": f"WITH {_F} SELECT file_id, len(data)::INT AS size FROM f WHERE file_id % 4 = 1",
    "file_shards": f"WITH {_F} SELECT file_id, ((file_id % 4 + 4) % 4)::INT AS shard, len(data)::INT AS size FROM f",
}
