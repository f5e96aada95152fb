import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coppice.functions.languages import extension_language, language_identifier
from coppice.functions.uniform import central_bounds, generator, truncated_normal
from coppice.operators import augment as A
from coppice.operators import batching as B
from coppice.operators import identifiers as I
from coppice.operators import retrieval as R
from coppice.operators import text as P
from coppice.operators import tokens as X
from coppice.operators import tree_arrays as ta
from coppice.operators import trees as N


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<int>")


def test_indentation_tokens(spark):
    want = {0: [], 3: [13, 14], 7: [12, 13, 14], 12: [11, 12], 23: [11, 11, 12, 13, 14], -2: []}
    for n, tokens in want.items():
        assert one(spark, X.indentation_tokens(F.lit(n))) == tokens


def test_small_token_operators(spark):
    assert one(spark, X.newline_count(ints(10, 9, 10))) == 4
    assert one(spark, X.left_padded_parents(ints(-1, 0, 1), F.lit(4))) == [-1, -1, 1, 2]
    assert one(spark, X.shifted(ints(4, 5, 6))) == [6, 4, 5]
    assert one(spark, X.shifted(ints())) == []
    assert one(spark, X.with_token(ints(1, 5), F.lit(1))) is None
    assert one(spark, X.with_token(ints(5), F.lit(1))) == [1, 5]
    assert one(spark, X.is_whitespace(ints(10, 14))) and not one(spark, X.is_whitespace(ints(10, 15)))
    assert one(spark, X.format_specials(F.lit("aFOLD0b___MASK3___[C][PAD]"))) == "a FOLD0 b  [MASK3]   [C]  [PAD] "
    cut = one(spark, X.truncated_pair(ints(5, 100, 6, 101, 7), ints(100, 1, 101, 2), 3, ints(100, 101)))
    assert (cut["source"], cut["target"]) == ([5, 100, 6], [100, 1, 101, 2])


def test_masked_source_and_target(spark):
    def pair(tokens, mask):
        df = spark.createDataFrame([(tokens, [bool(m) for m in mask])], "t array<int>, m array<boolean>")
        out = df.select(X.source_and_target(F.col("t"), F.col("m"), [100, 101]).alias("p")).first()["p"]
        return out and (out["source"], out["target"])

    assert pair([5, 6, 7, 8, 9], [0, 1, 1, 0, 1]) == ([5, 100, 8, 101], [100, 6, 7, 101, 9])
    assert pair([5, 6, 7], [1, 0, 1]) == ([100, 6, 101], [100, 5, 101, 7])
    assert pair([5, 6], [0, 0]) is None and pair([], []) is None and pair(None, []) is None
    with pytest.raises(Exception, match="more masked runs"):
        pair([5, 6, 7, 8, 9], [1, 0, 1, 0, 1])


def test_runs(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1],), ([],), (None,), ([None, None, 3],)], "v array<int>")
    got = [r["r"] and [tuple(x) for x in r["r"]] for r in df.select(X.array_runs(F.col("v")).alias("r")).collect()]
    assert got == [[(0, 1, 0), (1, 2, 1), (3, 1, 0), (4, 1, 1)], [], None, [(0, 2, None), (2, 1, 3)]]


def test_buckets(spark):
    sizes = spark.createDataFrame([(s,) for s in (50, 51, 509, 512)], "s int")
    assert [r[0] for r in sizes.select(B.bucket(F.col("s"), 512, 10)).collect()] == [0, 1, 9, 9]


@given(st.lists(st.integers(1, 50), max_size=60))
def test_batches_hold_their_budget(sizes):
    number = B.cut(np.array(sizes, int), 100)
    for b in set(number.tolist()):
        mine = [s for s, n in zip(sizes, number) if n == b]
        assert max(mine) * len(mine) <= 100
    assert list(number) == sorted(number)


def test_batched_and_collated(spark):
    rows = [(i, [7] * (i % 9)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t array<int>").withColumn("size", F.size("t"))
    b = B.batched(df, [], "size", ["id"], budget=24, longest=8, buckets=2)
    assert b.count() == sum(1 for i in range(40) if i % 9)
    c = X.collated(b, ["bucket0", "batch"], "t", "id").collect()
    assert sum(r["nsamples"] for r in c) == b.count()
    for r in c:
        assert {len(t) for t in r["tokens"]} == {max(r["lengths"])} and r["lengths"] == sorted(r["lengths"], reverse=True)
        assert [sum(m) for m in r["mask"]] == r["lengths"] and sum(r["lengths"]) == r["ntokens"]
    again = B.batched(df.repartition(7), [], "size", ["id"], budget=24, longest=8, buckets=2)
    key = lambda d: sorted((r["id"], r["bucket0"], r["batch"]) for r in d.collect())
    assert key(again) == key(b)


def test_search_metrics(spark):
    row = R.search_metrics(spark.createDataFrame([(1,), (2,), (4,)], "rank long")).first()
    assert (row["mrr"], row["hits_1"], row["hits_3"], row["mr"]) == (0.583333, 0.333333, 0.666667, 2.333333)


def test_search_in_blocks_does_not_depend_on_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<float>")
    want = sorted(tuple(r) for r in R.top_k(df, df, 5).collect())
    monkeypatch.setattr(R, "BLOCK", 7)
    assert sorted(tuple(r) for r in R.top_k(df, df, 5).collect()) == want


def test_languages(spark):
    assert [one(spark, language_identifier(F.lit(x))) for x in ("C++", "GoLang", "klingon", "JS")] == ["cpp", "go", "klingon", "javascript"]
    assert one(spark, extension_language(F.lit("a.b/x.py"))) == "python"
    assert one(spark, extension_language(F.lit("a/x.h"))) is None


def test_distributions():
    assert central_bounds(3) == (1, 5)
    u = [truncated_normal(x, 150, 90, 10, 200) for x in (0.0, 0.5, 1.0)]
    assert u == sorted(u) and u[0] >= 10 and u[-1] <= 200


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab (){}[]\n", max_size=60))
def test_parsing_loses_nothing(text):
    parents, labels, errors = P.bracket_tree(text)
    assert P.unparse(parents, labels) == text
    split = lambda x: [x[:1], x[1:]] if len(x) > 1 else [x]
    assert P.join_leaves(*P.split_leaves(parents, labels, split)) == (parents, labels)


def random_tree(seed, n=120):
    rng = np.random.default_rng(seed)
    levels = [0]
    for _ in range(n):
        levels.append(int(rng.integers(1, min(levels[-1] + 1, 7) + 1)))
    return ta.Tree.of_levels(levels, rng.integers(15, 25, n + 1).tolist())


@pytest.mark.parametrize("seed", range(8))
def test_random_changes_keep_every_leaf(seed):
    t, rng = random_tree(seed), generator(seed, "test", 1)
    cfg = A.FoldConfig(max_tree=30, max_subtree=30, min_subtree=4)
    parts = A.fold(t, [900], rng, cfg)
    assert all(ta.is_valid(p.parents, p.descendants) for p in parts)
    got = A.mask_subtrees(t, list(range(1000, 1100)), 0.3, 4.0, rng)
    if got:
        source, target = got
        segments, filled = {}, []
        for x in target:
            if x >= 1000:
                now = segments.setdefault(x, [])
            else:
                now.append(x)
        for x in source:
            filled += segments.get(x, [x])
        assert filled == t.leaves()
    span = A.mask_span(t, 999, rng, share=0.2)
    if span:
        leaves = span[0].leaves()
        at = leaves.index(999)
        assert leaves[:at] + span[1] + leaves[at + 1 :] == t.leaves()
    m = A.mask_random_spans(200, 0.2, 3.0, rng)
    assert 0 < m.sum() <= 50


def test_subtree_hashes():
    t = ta.Tree([-1, 0, 1, 1, 0, 4, 4, 0], [9, 3, 1, 2, 3, 1, 2, 1])
    h = I.hash_subtrees(t.parents, t.columns[0])
    assert h[1] == h[4] and h[2] == h[5] == h[7] and h[1] != h[0] and all(0 <= x < 1 << 48 for x in h)


def test_identifiers():
    # root 9 with three identifier branches (symbol 3), two of them equal
    parents, tokens = [-1, 0, 1, 1, 0, 4, 4, 0, 7, 7], [9, 3, 20, 21, 3, 20, 21, 3, 22, 23]
    nodes, numbers, first = I.occurrences(parents, tokens, 3)
    assert nodes == [1, 4, 7] and numbers[0] == numbers[1] != numbers[2] and sorted(first.values()) == [1, 7]
    source, target = I.mask_identifiers(parents, tokens, 3, [100, 101], np.random.default_rng(1), hide=1.0)
    assert len(source) == 3 and source[0] == source[1] != source[2] and sorted(target) == sorted([100, 101, 20, 21, 22, 23])
    assert I.mask_identifiers(parents, tokens, 5, [100], np.random.default_rng(1)) is None
    pair = ((parents, tokens), (parents, tokens))
    left, right = I.unique_identifiers(pair, 3, [100, 101], np.random.default_rng(2), overlap=0.0)
    assert sum(x >= 100 for x in left) + sum(x >= 100 for x in right) == 3
    assert I.symbols_of("python", identifier=False) == {"[IDENTIFIER]"}


def test_dedent():
    assert A.dedent_after([50, 10, 11, 12, 51, 9, 13, 52], 4) == [50, 10, 11, 51, 9, 52]


def test_trees_with_nulls_and_repeats(spark):
    rows = [(1, [5, 6], [-1, 0], None, 1), (1, [5, 6], [-1, 0], None, 2), (2, None, None, None, 1), (3, [], [], None, 1), (4, [7, 8], None, [1, 0], 1), (None, [1], [-1], None, 1), (5, [7], None, None, 1)]
    df = spark.createDataFrame(rows, "file_id long, tokens array<int>, parents array<int>, descendants array<int>, ingested_at int").withColumn("level", F.lit("clash"))
    t = N.structured(N.newest(df, "file_id", "ingested_at"))
    got = {r["file_id"]: (r["parents"], r["descendants"]) for r in t.collect()}
    assert got == {1: ([-1, 0], [1, 0]), 3: ([], []), 4: ([-1, 0], [1, 0])}
    assert N.nodes(t).count() == 4
    assert N.nodes(t.limit(0)).count() == 0


def test_further_spellings_of_languages(spark):
    said = ["py", " C++ ", "Node.js", "cs", "GoLang", "unheard", None]
    got = [one(spark, language_identifier(F.lit(x).cast("string"), spellings=True)) for x in said]
    assert got == ["python", "cpp", "javascript", "c-sharp", "go", "unheard", None]
