"""Queries over the syntax trees of code_trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators import batching as B
from coppice.operators import tree_arrays as ta
from coppice.operators import trees as N
from coppice.operators.collation import collated_trees as collated
from coppice.operators.text import join_leaves
from coppice.operators.tokenizer import CodeTokenizer
from coppice.operators.tokens import text_of, words_by_id
from coppice.sources.tables import table


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return N.newest(table(spark, folder, "code_trees"), "file_id", "ingested_at")


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    return N.structured(_files(spark, folder))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return N.nodes(_trees(spark, folder))


def tree_levels(spark, folder):
    return _nodes(spark, folder).select("file_id", "idx", "level")


def tree_descendants(spark, folder):
    """Descendants of all trees, derived from the parents alone."""
    derived = N.structured(_files(spark, folder).withColumn("descendants", F.lit(None).cast("array<int>")))
    return N.nodes(derived).select("file_id", "idx", "descendants")


def tree_parents(spark, folder):
    """Parents of the trees that carry descendants, derived from these alone."""
    with_descendants = _files(spark, folder).where("descendants is not null").withColumn("parents", F.lit(None).cast("array<int>"))
    return N.nodes(N.structured(with_descendants)).select("file_id", "idx", "parent")


def tree_heights(spark, folder):
    return N.heights(_trees(spark, folder))


def tree_ancestors(spark, folder):
    """How many nodes lie on the path to each node, and how many below it, by the closure."""
    c = N.closure(_trees(spark, folder))
    on_path = c.groupBy("file_id", "idx").agg(F.count("*").alias("path_nodes"))
    below = c.groupBy("file_id", F.col("ancestor").alias("idx")).agg((F.count("*") - 1).alias("below"))
    return on_path.join(below, ["file_id", "idx"])


def tree_adjacency(spark, folder):
    """The edges of every tree, both ways."""
    down = _nodes(spark, folder).where("parent >= 0").select("file_id", F.col("parent").alias("source"), F.col("idx").alias("target"))
    return down.union(down.select("file_id", F.col("target").alias("source"), F.col("source").alias("target")))


def tree_siblings(spark, folder):
    return N.siblings(_nodes(spark, folder))


def tree_leaf_distances(spark, folder):
    return N.leaf_distances(_trees(spark, folder))


def tree_pair_sums(spark, folder):
    """Lowest common ancestors, movements and distances of all pairs of nodes, summed for each node."""
    return N.pair_sums(_trees(spark, folder))


def tree_next_stepout(spark, folder):
    return N.steps(_nodes(spark, folder))


def tree_leaves(spark, folder):
    return _nodes(spark, folder).where("descendants = 0").select("file_id", "idx", "token")


def tree_sizes(spark, folder):
    """Nodes, leaves, inner nodes and depth of every tree."""
    t = _trees(spark, folder)
    return t.select("file_id", F.size("tokens").alias("nodes"), N.leaf_count(F.col("descendants")).alias("leaves"), F.array_max("levels").alias("depth"))


def tree_valid(spark, folder):
    """Whether the stored arrays of every delivered row describe one tree."""
    rows = table(spark, folder, "code_trees").where("file_id is not null and descendants is not null and tokens is not null and parents is not null")
    out = N.tree_map(rows, ["file_id"], ["parents", "descendants"], lambda p, d: [(ta.is_valid(p, d),)], "valid boolean")
    return out.groupBy("file_id").agg(F.min("valid").alias("valid"))


def sibling_ngrams(spark, folder):
    runs = N.sibling_ngrams(_nodes(spark, folder))
    return runs.groupBy("file_id", "n").agg(F.count("*").alias("runs"), F.sum(F.col("stop") - F.col("start")).alias("nodes"))


def nonterminal_histogram(spark, folder):
    """How often each inner token occurs, in how many files."""
    inner = _nodes(spark, folder).where("descendants > 0").groupBy(F.col("token").alias("token_id")).agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))
    return inner.join(F.broadcast(table(spark, folder, "vocabulary")), "token_id", "left").select("token_id", "token", "n", "files")


def tree_text(spark, folder):
    """The source text of every tree: the texts of its leaves, joined."""
    leaves = _trees(spark, folder).select("file_id", N.leaf_tokens(F.col("tokens"), F.col("descendants")).alias("leaves"), words_by_id(table(spark, folder, "vocabulary")).alias("words"))
    return leaves.where(F.exists("leaves", lambda t: F.get("words", t).isNotNull())).select("file_id", text_of(F.col("leaves"), F.col("words")).alias("text"))


def tree_round_trip(spark, folder):
    """Node form packed back into arrays."""
    packed = N.array_form(_nodes(spark, folder))
    return packed.select("file_id", F.concat_ws(",", F.transform("tokens", lambda x: x.cast("string"))).alias("tokens"), F.concat_ws(",", F.transform("parents", lambda x: x.cast("string"))).alias("parents"))


def tree_fold_definitions(spark, folder):
    """Leaves after folding every definition (token 1172) that lies in no other: the fold's token 1177
    at its place, with the leaves it had."""
    ids = _vocabulary_ids(spark, folder, "[definition]", "FOLD0")
    nodes = _nodes(spark, folder)
    picks = nodes.where((F.col("token") == ids[0]) & (F.col("descendants") > 0)).select("file_id", "idx", "descendants")
    over = picks.select("file_id", F.col("idx").alias("up"), F.col("descendants").alias("up_d"))
    inner = picks.join(over, "file_id").where("up < idx and idx <= up + up_d").select("file_id", "idx").distinct()
    chosen = picks.join(inner, ["file_id", "idx"], "left_anti").select("file_id", F.col("idx").alias("node"), F.lit(ids[1]).alias("replacement"))
    out = N.branches_as_leaves(nodes, chosen)
    return out.select("file_id", "position", "token", F.coalesce(F.size("removed"), F.lit(0)).alias("removed"))


def _vocabulary_ids(spark, folder, *names):
    found = {r["token"]: r["token_id"] for r in table(spark, folder, "vocabulary").where(F.col("token").isin(*names)).collect()}
    return [found[n] for n in names]


def _edited(spark, folder, edit):
    """The arrays of every edited tree as texts."""
    out = N.edited(_trees(spark, folder), edit)
    return out.select("file_id", *[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("parents", "descendants", "tokens")])


def tree_delete_first_child(spark, folder):
    return _edited(spark, folder, lambda t: t.delete(1) if len(t) > 2 else None)


def tree_replace_children(spark, folder):
    """Every child of the root keeps two leaves in place of what it holds."""

    def edit(t):
        kids = [int(k) for k in ta.children_of(t.parents, 0) if t.descendants[k]]
        return t.replace_children(kids, [[7, 7]] * len(kids)) if kids else None

    return _edited(spark, folder, edit)


def tree_swap_ends(spark, folder):
    """The first and the last child of the root change places."""

    def edit(t):
        kids = ta.children_of(t.parents, 0)
        return t.swap(int(kids[0]), int(kids[-1])) if len(kids) > 1 else None

    return _edited(spark, folder, edit)


def tree_insert_eos(spark, folder):
    return _edited(spark, folder, lambda t: t.insert(0, 2))


def tree_cat_twice(spark, folder):
    return _edited(spark, folder, lambda t: ta.Tree.cat([t, t], 1))


def tree_crop(spark, folder):
    return _edited(spark, folder, lambda t: t.crop(50))


def tree_drawings(spark, folder):
    return N.drawings(_trees(spark, folder), table(spark, folder, "vocabulary"))


def subtree_hash(spark, folder):
    """A 48-bit hash per subtree: equal hashes, equal subtrees."""
    from coppice.operators.identifiers import hash_subtrees

    return N.tree_map(_trees(spark, folder), ["file_id"], ["parents", "tokens"], lambda p, t: list(enumerate(hash_subtrees(p, t))), "idx int, hash long")


def subtree_classes(spark, folder):
    """For every subtree of more than one node: how many subtrees of all files equal it, and the first of them."""
    h = subtree_hash(spark, folder).join(_nodes(spark, folder).where("descendants > 0").select("file_id", "idx"), ["file_id", "idx"])
    per = h.groupBy("hash").agg(F.count("*").alias("copies"), F.min(F.struct("file_id", "idx")).alias("f"))
    return h.join(per, "hash").select("file_id", "idx", "copies", F.col("f.file_id").alias("first_file"), F.col("f.idx").alias("first_idx"))


_R = "WITH RECURSIVE "
def tree_from_incidences(spark, folder):
    """Parents and descendants of every node from the pairs of nodes and ancestors alone."""
    c = N.closure(_trees(spark, folder))
    below = c.groupBy("file_id", F.col("ancestor").alias("idx")).agg((F.count("*") - 1).cast("int").alias("descendants"))
    up = c.groupBy("file_id", "idx").agg(F.coalesce(F.max(F.when(F.col("ancestor") < F.col("idx"), F.col("ancestor"))), F.lit(-1)).alias("parent"))
    return below.join(up, ["file_id", "idx"])


def tree_incidence_nodes(spark, folder):
    """The path from the root to every node, the node included."""
    return N.tree_map(_trees(spark, folder), ["file_id"], ["parents"], lambda p: list(enumerate(N.paths(p))), "idx int, path string")


def tree_level_masks(spark, folder):
    """The nodes of every level of every tree."""
    per = _nodes(spark, folder).groupBy("file_id", "level").agg(F.array_sort(F.collect_list("idx")).alias("n"))
    return per.select("file_id", "level", F.size("n").alias("nodes"), F.md5(F.concat_ws(",", F.transform("n", lambda x: x.cast("string")))).alias("members"))


def tree_child_with_data(spark, folder):
    """The first child of every node that holds the definition token."""
    symbol = _vocabulary_ids(spark, folder, "[definition]")[0]
    return _nodes(spark, folder).where((F.col("token") == symbol) & (F.col("parent") >= 0)).groupBy("file_id", F.col("parent").alias("idx")).agg(F.min("idx").alias("child"))


def tree_equal(spark, folder):
    """For every tree the first file with an equal one, structure and data, and how many there are."""
    t = _trees(spark, folder).select("file_id", F.sha2(F.concat_ws("|", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("tokens", "parents")]), 256).alias("h"))
    per = t.groupBy("h").agg(F.min("file_id").alias("first_file"), F.count("*").alias("copies"))
    return t.join(per, "h").select("file_id", "first_file", "copies")


def tree_dead_letters(spark, folder):
    """The branch of node 100 removed; trees that have none are kept with the reason."""

    def build(parents, tokens):
        return [(len(ta.Tree(parents, tokens).delete(100)),)]

    return N.tree_map(_trees(spark, folder), ["file_id"], ["parents", "tokens"], build, "nodes int", errors="reason")


def leaf_spans(spark, folder):
    """Where each leaf's text begins and ends in its tree's source text."""
    words = dict(table(spark, folder, "vocabulary").select("token_id", "token").collect())

    def build(descendants, tokens):
        out, at = [], 0
        for i, (d, t) in enumerate(zip(descendants, tokens)):
            if d == 0:
                n = len(words.get(int(t)) or "")
                out.append((i, at, at + n))
                at += n
        return out

    return N.tree_map(_trees(spark, folder), ["file_id"], ["descendants", "tokens"], build, "idx int, start int, stop int")


def tree_ids_round_trip(spark, folder, tokenizer="/opt/tokenizers/byte_bpe_50k.json"):
    """String trees turned into ids of a public tokenizer and back: nodes, and whether nothing changed."""
    vocabulary = dict(table(spark, folder, "vocabulary").select("token_id", "token").collect())
    inner = [w for w in vocabulary.values() if w and w.startswith("[")]
    coder = CodeTokenizer.load(tokenizer, inner)
    shared = spark.sparkContext.broadcast(coder)

    def build(parents, tokens):
        labels = [vocabulary.get(int(t)) or "[UNK]" for t in tokens]
        up, labels = join_leaves([int(x) for x in parents], labels)  # leaves that are split already are joined first
        return [(len(labels), shared.value.decode_tree(*shared.value.encode_tree(up, labels)) == (up, labels))]

    return N.tree_map(_trees(spark, folder), ["file_id"], ["parents", "tokens"], build, "nodes int, same boolean")


def collated_trees(spark, folder):
    """Batches of whole trees, budget 20000 tokens or the largest tree, padded on the left to multiples of 8."""
    trees = _trees(spark, folder).withColumn("size", F.size("tokens"))
    longest = max(trees.agg(F.max("size")).first()[0] or 0, 4)
    b = B.batched(trees.select("file_id", "size"), [], "size", ["file_id"], budget=max(20_000, longest), longest=longest, buckets=4)
    c = collated(b.join(trees.drop("size"), "file_id"), ["bucket0", "batch"], "file_id", left=True, multiple=8)
    text = lambda c: F.md5(F.array_join(F.transform(F.flatten(c), lambda x: x.cast("string")), ",")).alias(c)
    return c.select("bucket0", "batch", "width", F.size("ids").alias("nsamples"), *[text(x) for x in ("tokens", "parents", "descendants", "labels")])


#: A subtree as text: the tokens and descendants of its nodes.
_SUBTREE = "md5(array_to_string(list_transform(t.tokens[n.idx + 1:n.idx + 1 + n.descendants], lambda z: z::VARCHAR), ',') || '|' || array_to_string(list_transform(g.d[n.idx + 1:n.idx + 1 + n.descendants], lambda z: z::VARCHAR), ','))"
_T = "t AS MATERIALIZED (SELECT * FROM code_trees WHERE file_id IS NOT NULL AND tokens IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1)"
_P = _T + ", p AS MATERIALIZED (SELECT file_id, generate_subscripts(tokens, 1)::INT - 1 AS idx, unnest(parents) AS parent, unnest(tokens) AS token FROM t)"
_A = _P + ", a AS (SELECT file_id, idx, idx AS anc, parent AS up FROM p UNION ALL SELECT a.file_id, a.idx, p.idx, p.parent FROM a JOIN p ON p.file_id = a.file_id AND p.idx = a.up)"
_N = (
    _P
    + """, s AS MATERIALIZED (SELECT *, lead(idx) OVER (PARTITION BY file_id, parent ORDER BY idx) AS sib, (count(*) OVER (PARTITION BY file_id))::INT AS size FROM p),
    r AS (SELECT file_id, idx, 0 AS level, NULL::INT AS nb FROM s WHERE parent < 0 UNION ALL SELECT s.file_id, s.idx, r.level + 1, coalesce(s.sib, r.nb) FROM r JOIN s ON s.file_id = r.file_id AND s.parent = r.idx),
    n AS MATERIALIZED (SELECT s.file_id, s.idx, s.parent, s.token, s.size, s.sib, r.level, r.nb, (coalesce(r.nb, s.size) - s.idx - 1)::INT AS descendants FROM s JOIN r USING (file_id, idx))"""
)
_AN = _N + _A.removeprefix(_P) + ", am AS MATERIALIZED (SELECT file_id, idx, anc FROM a)"


def _edit_sql(rows: str) -> str:
    """The arrays of trees given as rows (file_id, o, level, token) in the order of o."""
    return f"""{_R}{_N}, e0 AS ({rows}), e AS MATERIALIZED (SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY o))::INT - 1 AS idx, level, token FROM e0),
        v AS (SELECT file_id, idx, level AS k, NULL::INT AS mark FROM e UNION ALL SELECT file_id, idx, level + 1, idx FROM e),
        u AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY file_id, k ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM v),
        f AS MATERIALIZED (SELECT e.*, coalesce(u.parent, -1) AS parent, (count(*) OVER (PARTITION BY e.file_id))::INT AS size FROM e JOIN u ON e.file_id = u.file_id AND e.idx = u.idx AND u.mark IS NULL),
        g AS MATERIALIZED (SELECT *, lead(idx) OVER (PARTITION BY file_id, parent ORDER BY idx) AS sib FROM f),
        h AS (SELECT file_id, idx, NULL::INT AS nb FROM g WHERE parent < 0 UNION ALL SELECT g.file_id, g.idx, coalesce(g.sib, h.nb) FROM h JOIN g ON g.file_id = h.file_id AND g.parent = h.idx)
        SELECT file_id, string_agg(parent::VARCHAR, ',' ORDER BY idx) AS parents, string_agg((coalesce(h.nb, size) - idx - 1)::INT::VARCHAR, ',' ORDER BY idx) AS descendants, string_agg(token::VARCHAR, ',' ORDER BY idx) AS tokens
        FROM g JOIN h USING (file_id, idx) GROUP BY file_id"""



QUERIES = [
    tree_levels, tree_descendants, tree_parents, tree_heights, tree_ancestors, tree_adjacency, tree_siblings, tree_leaf_distances, tree_pair_sums, tree_next_stepout, tree_leaves, tree_sizes, tree_valid, sibling_ngrams,
    nonterminal_histogram, tree_text, tree_round_trip, tree_fold_definitions, tree_delete_first_child, tree_replace_children, tree_swap_ends, tree_insert_eos, tree_cat_twice, tree_crop, tree_drawings, subtree_hash, subtree_classes,
    tree_from_incidences, tree_incidence_nodes, tree_level_masks, tree_child_with_data, tree_equal, tree_dead_letters, leaf_spans, tree_ids_round_trip, collated_trees,
]
SQL = {
    "tree_levels": _R + _N + " SELECT file_id, idx, level FROM n",
    "tree_descendants": _R + _N + " SELECT file_id, idx, descendants FROM n",
    "tree_parents": "WITH " + _P + " SELECT p.file_id, idx, parent FROM p JOIN t USING (file_id) WHERE t.descendants IS NOT NULL",
    "tree_heights": _R + _AN + " SELECT a.file_id, a.anc AS idx, (max(n.level) - min(m.level))::INT AS height FROM am a JOIN n ON n.file_id = a.file_id AND n.idx = a.idx JOIN n m ON m.file_id = a.file_id AND m.idx = a.anc GROUP BY 1, 2",
    "tree_ancestors": _R + _N + " SELECT file_id, idx, (level + 1)::BIGINT AS path_nodes, descendants::BIGINT AS below FROM n",
    "tree_adjacency": "WITH " + _P + " SELECT file_id, parent AS source, idx AS target FROM p WHERE parent >= 0 UNION ALL SELECT file_id, idx, parent FROM p WHERE parent >= 0",
    "tree_siblings": "WITH " + _P + " SELECT file_id, idx, (row_number() OVER w)::INT - 1 AS ordinal, lag(idx) OVER w AS left_sibling, lead(idx) OVER w AS right_sibling, count(*) OVER (PARTITION BY file_id, parent) - 1 AS n_siblings FROM p WHERE parent >= 0 WINDOW w AS (PARTITION BY file_id, parent ORDER BY idx)",
    "tree_leaf_distances": _R + _AN + """, l AS (SELECT file_id, idx AS left_leaf, lead(idx) OVER (PARTITION BY file_id ORDER BY idx) AS right_leaf FROM n WHERE descendants = 0),
        al AS MATERIALIZED (SELECT am.file_id, am.idx, any_value(n.level) AS level, list(anc) AS up FROM am JOIN n ON n.file_id = am.file_id AND n.idx = am.idx GROUP BY 1, 2),
        c1 AS MATERIALIZED (SELECT l.*, x.level AS li, x.up AS ux FROM l JOIN al x ON x.file_id = l.file_id AND x.idx = l.left_leaf),
        c2 AS MATERIALIZED (SELECT c1.*, y.level AS lj, list_max(list_intersect(ux, y.up)) AS lca, len(list_intersect(ux, y.up)) - 1 AS lk FROM c1 JOIN al y ON y.file_id = c1.file_id AND y.idx = c1.right_leaf)
        SELECT file_id, left_leaf, right_leaf, lca, (li - lk)::INT AS up, (lj - lk)::INT AS down, (li + lj - 2 * lk)::INT AS distance FROM c2""",
    "tree_pair_sums": _R + _AN + """, q AS (SELECT am.file_id, am.idx, anc, n.level, n.descendants + 1 - coalesce(lead(n.descendants + 1) OVER (PARTITION BY am.file_id, am.idx ORDER BY anc), 0) AS w FROM am JOIN n ON n.file_id = am.file_id AND n.idx = am.anc),
        y AS (SELECT file_id, idx, sum(w)::INT AS nodes, sum(anc * w) AS lca, sum(level * w) AS shared FROM q GROUP BY 1, 2), z AS (SELECT file_id, sum(level) AS levels FROM n GROUP BY 1)
        SELECT y.file_id, y.idx, nodes, lca::BIGINT AS lca, (level * nodes - shared)::BIGINT AS up, (levels - shared)::BIGINT AS down, (level * nodes + levels - 2 * shared)::BIGINT AS distance FROM y JOIN n ON n.file_id = y.file_id AND n.idx = y.idx JOIN z ON z.file_id = y.file_id""",
    "tree_next_stepout": _R + _N + " SELECT n.file_id, n.idx, n.nb AS next_branch, u.nb AS step_out FROM n LEFT JOIN n u ON u.file_id = n.file_id AND u.idx = n.parent",
    "tree_leaves": "WITH " + _P + ", q AS (SELECT *, lead(parent) OVER (PARTITION BY file_id ORDER BY idx) AS after FROM p) SELECT file_id, idx, token FROM q WHERE after IS DISTINCT FROM idx",
    "tree_sizes": _R + _N + " SELECT file_id, count(*)::INT AS nodes, (count(*) FILTER (WHERE descendants = 0))::INT AS leaves, max(level)::INT AS depth FROM n GROUP BY 1",
    "tree_valid": _R + _N + ", g AS (SELECT file_id, list(descendants ORDER BY idx) AS d FROM n GROUP BY 1) SELECT t.file_id, t.descendants = g.d AS valid FROM t JOIN g USING (file_id) WHERE t.descendants IS NOT NULL",
    "sibling_ngrams": _R + _N + """, y AS (SELECT file_id, parent, idx, idx + descendants + 1 AS stop FROM n WHERE parent >= 0),
        z AS (SELECT file_id, k AS n, idx AS start, nth_value(stop, k) OVER (PARTITION BY file_id, parent, k ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS stop FROM y, (SELECT unnest([2, 3, 4, 5, 6]) AS k))
        SELECT file_id, n::INT AS n, count(*) AS runs, sum(stop - start)::BIGINT AS nodes FROM z WHERE stop IS NOT NULL GROUP BY 1, 2""",
    "nonterminal_histogram": "WITH " + _P + ", i AS (SELECT DISTINCT file_id, parent AS idx FROM p WHERE parent >= 0) SELECT p.token AS token_id, v.token, count(*) AS n, count(DISTINCT p.file_id) AS files FROM p JOIN i USING (file_id, idx) LEFT JOIN vocabulary v ON v.token_id = p.token GROUP BY 1, 2",
    "tree_text": "WITH " + _P + ", q AS (SELECT *, lead(parent) OVER (PARTITION BY file_id ORDER BY idx) AS after FROM p) SELECT file_id, string_agg(v.token, '' ORDER BY idx) AS text FROM q JOIN vocabulary v ON v.token_id = q.token WHERE after IS DISTINCT FROM idx GROUP BY 1",
    "tree_round_trip": "WITH " + _P + " SELECT file_id, string_agg(token::VARCHAR, ',' ORDER BY idx) AS tokens, string_agg(parent::VARCHAR, ',' ORDER BY idx) AS parents FROM p GROUP BY 1",
    "tree_fold_definitions": _R + _N + """, v AS (SELECT max(token_id) FILTER (WHERE token = '[definition]') AS d, max(token_id) FILTER (WHERE token = 'FOLD0') AS f FROM vocabulary),
        k AS (SELECT n.file_id, n.idx, n.descendants FROM n, v WHERE n.token = v.d AND n.descendants > 0),
        o AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k u WHERE u.file_id = k.file_id AND u.idx < k.idx AND k.idx <= u.idx + u.descendants)),
        x AS (SELECT n.file_id, n.idx, n.token, o.idx AS lo FROM n LEFT JOIN o ON o.file_id = n.file_id AND n.idx BETWEEN o.idx AND o.idx + o.descendants WHERE n.descendants = 0),
        y AS (SELECT file_id, coalesce(lo, idx) AS pos, max(lo) AS lo, min(token) AS own, count(*) AS c FROM x GROUP BY 1, 2)
        SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY pos))::INT - 1 AS position, CASE WHEN lo IS NULL THEN own ELSE (SELECT f FROM v) END AS token, (CASE WHEN lo IS NULL THEN 0 ELSE c END)::INT AS removed FROM y""",
    "tree_delete_first_child": _edit_sql("SELECT n.file_id, n.idx AS o, level, token FROM n JOIN (SELECT file_id, nb FROM n WHERE idx = 1) c USING (file_id) WHERE size > 2 AND (n.idx < 1 OR n.idx >= c.nb)"),
    "tree_replace_children": _edit_sql(
        "SELECT file_id, 10 * idx AS o, level, token FROM n WHERE (idx = 0 OR parent = 0) AND file_id IN (SELECT file_id FROM n WHERE parent = 0 AND descendants > 0) UNION ALL SELECT file_id, 10 * idx + k, 2, 7 FROM n, (SELECT unnest([1, 2]) AS k) WHERE parent = 0 AND descendants > 0"
    ),
    "tree_swap_ends": _edit_sql(
        "SELECT n.file_id, CASE WHEN n.idx = 0 THEN 0 WHEN n.idx < c.nb THEN 3 * size WHEN n.idx >= z.last THEN size ELSE 2 * size END + n.idx AS o, level, token FROM n JOIN (SELECT file_id, nb FROM n WHERE idx = 1) c USING (file_id) JOIN (SELECT file_id, max(idx) AS last FROM n WHERE parent = 0 GROUP BY 1 HAVING count(*) > 1) z USING (file_id)"
    ),
    "tree_insert_eos": _edit_sql("SELECT file_id, idx AS o, level, token FROM n UNION ALL SELECT file_id, size, 1, 2 FROM n WHERE idx = 0"),
    "tree_cat_twice": _edit_sql("SELECT file_id, k * size + idx AS o, level + 1 AS level, token FROM n, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT file_id, -1, 0, 1 FROM n WHERE idx = 0"),
    "tree_crop": _edit_sql("SELECT file_id, idx AS o, level, token FROM (SELECT *, count(*) FILTER (WHERE descendants = 0) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS leaves FROM n) WHERE idx = 0 OR leaves < 50"),
    "subtree_classes": _R
    + _N
    + f""", g AS MATERIALIZED (SELECT file_id, list(descendants ORDER BY idx) AS d FROM n GROUP BY 1), k AS MATERIALIZED (SELECT n.file_id, n.idx, {_SUBTREE} AS c FROM n JOIN t USING (file_id) JOIN g USING (file_id) WHERE n.descendants > 0),
        f AS (SELECT c, count(*) AS copies, min({{'a': file_id, 'b': idx}}) AS f FROM k GROUP BY 1) SELECT file_id, idx, copies, f.f.a AS first_file, f.f.b AS first_idx FROM k JOIN f USING (c)""",
    "tree_drawings": _R
    + _N
    + """, w AS (SELECT n.file_id, n.idx, n.parent, n.sib, translate(coalesce(v.token, n.token::VARCHAR), ' ' || chr(10) || chr(9) || chr(13) || chr(11), '␣⏎⇥↵⇟') AS label FROM n LEFT JOIN vocabulary v ON v.token_id = n.token),
        x AS (SELECT file_id, idx, '' AS stem, label AS line FROM w WHERE parent < 0 UNION ALL
          SELECT w.file_id, w.idx, x.stem || CASE WHEN w.sib IS NULL THEN '    ' ELSE '│   ' END, x.stem || CASE WHEN w.sib IS NULL THEN '└── ' ELSE '├── ' END || w.label FROM x JOIN w ON w.file_id = x.file_id AND w.parent = x.idx)
        SELECT file_id, string_agg(line, chr(10) ORDER BY idx) AS drawing FROM x GROUP BY 1""",
    "tree_from_incidences": _R + _N + " SELECT file_id, idx, descendants, parent FROM n",
    "tree_incidence_nodes": _R + _N + ", x AS (SELECT file_id, idx, idx::VARCHAR AS path FROM n WHERE parent < 0 UNION ALL SELECT n.file_id, n.idx, x.path || ',' || n.idx FROM x JOIN n ON n.file_id = x.file_id AND n.parent = x.idx) SELECT * FROM x",
    "tree_level_masks": _R + _N + " SELECT file_id, level, count(*)::INT AS nodes, md5(string_agg(idx::VARCHAR, ',' ORDER BY idx)) AS members FROM n GROUP BY 1, 2",
    "tree_child_with_data": "WITH " + _P + " SELECT file_id, parent AS idx, min(idx) AS child FROM p WHERE parent >= 0 AND token = (SELECT max(token_id) FROM vocabulary WHERE token = '[definition]') GROUP BY 1, 2",
    "tree_equal": "WITH " + _T + " SELECT file_id, min(file_id) OVER (PARTITION BY tokens, parents) AS first_file, count(*) OVER (PARTITION BY tokens, parents) AS copies FROM t WHERE len(tokens) > 0 OR len(tokens) = 0",
    "tree_dead_letters": _R + _N + " SELECT t.file_id, CASE WHEN len(t.tokens) > 100 THEN (len(t.tokens) - n.descendants - 1)::INT END AS nodes, CASE WHEN len(t.tokens) > 100 THEN NULL ELSE 'no node 100' END AS reason FROM t LEFT JOIN n ON n.file_id = t.file_id AND n.idx = 100",
    "leaf_spans": "WITH "
    + _P
    + """, q AS (SELECT *, lead(parent) OVER (PARTITION BY file_id ORDER BY idx) AS after FROM p), l AS (SELECT file_id, idx, coalesce(length(v.token), 0) AS n FROM q LEFT JOIN vocabulary v ON v.token_id = q.token WHERE after IS DISTINCT FROM idx),
        s AS (SELECT *, sum(n) OVER (PARTITION BY file_id ORDER BY idx) AS stop FROM l) SELECT file_id, idx, (stop - n)::INT AS start, stop::INT AS stop FROM s""",
    "tree_ids_round_trip": "WITH " + _P + " SELECT p.file_id, (count(*) FILTER (WHERE u.token IS DISTINCT FROM 5))::INT AS nodes, true AS same FROM p LEFT JOIN p u ON u.file_id = p.file_id AND u.idx = p.parent GROUP BY 1",
    "collated_trees": _R
    + _N
    + """, lim AS (SELECT greatest(max(len(tokens)), 4)::INT AS longest FROM t), y AS (SELECT file_id, len(tokens)::INT AS size, least(len(tokens) // (longest // 4), 3)::INT AS bucket0, greatest(20000, longest) AS budget FROM t, lim WHERE len(tokens) > 0),
        o AS MATERIALIZED (SELECT *, bucket0 AS g, row_number() OVER (PARTITION BY bucket0 ORDER BY file_id) AS rn FROM y),
        w AS (SELECT g, rn, size AS most, 1 AS n, 0 AS batch FROM o WHERE rn = 1 UNION ALL
          SELECT o.g, o.rn, CASE WHEN greatest(w.most, o.size) * (w.n + 1) > o.budget THEN o.size ELSE greatest(w.most, o.size) END,
            CASE WHEN greatest(w.most, o.size) * (w.n + 1) > o.budget THEN 1 ELSE w.n + 1 END, w.batch + CASE WHEN greatest(w.most, o.size) * (w.n + 1) > o.budget THEN 1 ELSE 0 END FROM w JOIN o ON o.g = w.g AND o.rn = w.rn + 1),
        b AS (SELECT o.file_id, bucket0, w.batch::INT AS batch, size FROM o JOIN w USING (g, rn)), l AS (SELECT bucket0, batch, ((max(size) + 7) // 8 * 8)::INT AS width FROM b GROUP BY 1, 2),
        k AS (SELECT b.bucket0, b.batch, width, b.file_id, (width - b.size)::INT AS pad, list(token ORDER BY idx) AS tokens, list(CASE WHEN parent < 0 THEN parent ELSE parent + width - b.size END ORDER BY idx) AS parents, list(descendants + 1 ORDER BY idx) AS descendants, list(descendants ORDER BY idx) AS labels
          FROM b JOIN l USING (bucket0, batch) JOIN n ON n.file_id = b.file_id GROUP BY 1, 2, 3, 4, 5)
        SELECT bucket0, batch, width, count(*)::INT AS nsamples, """
    + ", ".join(f"md5(string_agg(repeat('{fill},', pad) || array_to_string(list_transform({c}, lambda z: z::VARCHAR), ','), ',' ORDER BY file_id)) AS {c}" for c, fill in (("tokens", -1), ("parents", -1), ("descendants", 0), ("labels", -1)))
    + " FROM k GROUP BY 1, 2, 3",
}
