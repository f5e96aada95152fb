import ast
import datetime as dt
import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import bpe, mixing, origin, packing, pieces, pii, syntax, triejoin
from coppice.llm.forest import spanning_forest
from coppice.llm.neardup import groups, similar_pairs
from coppice.llm.overlap import overlaps, report
from coppice.llm.shingles import packed, runs_of, text_sets, unpacked
from coppice.llm.splits import assign, deal, raw_values, related_pairs

T0 = dt.datetime(2024, 1, 1)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


# ------------------------------------------------------------------ 1: near duplicates
def test_radix_trie_join_equals_brute_force():
    rng = np.random.default_rng(3)
    base = [rng.choice(400, 60, replace=False) for _ in range(6)]
    sets = []
    for _ in range(80):
        x = set(base[rng.integers(6)].tolist())
        for y in rng.choice(400, rng.integers(0, 30)).tolist():
            x ^= {y}
        sets.append(np.array(sorted(x), np.int64))
    keys, sizes = np.arange(80), np.array([len(s) for s in sets])
    got = {(i, j) for i, j, _ in triejoin.join_cell(keys, sizes, sets, None, 6, 10)}
    want = {(i, j) for i, j in combinations(range(80), 2) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.6}
    assert got == want and want


def tree_rows(n=60, seed=5):
    rng = random.Random(seed)
    bases = [[rng.randrange(15, 900) for _ in range(70)] for _ in range(5)]
    rows = []
    for i in range(n):
        x = list(rng.choice(bases)) if i % 3 else [rng.randrange(15, 900) for _ in range(50)]
        for _ in range(rng.randrange(0, 9)):
            x[rng.randrange(len(x))] = rng.randrange(15, 900)
        tokens = [1170, *x]
        parents = [-1] + [0] * len(x)
        below = [len(x)] + [0] * len(x) if i % 2 else None
        rows.append((i, tokens, parents, below, T0))
    rows += [rows[4], (5, rows[5][1], rows[5][2], None, T0 + dt.timedelta(days=1)), (100, [1, 2], [-1, 0], None, T0), (101, None, None, None, T0), (102, [], [], [], T0), (None, [1], [-1], [0], T0), (103, rows[1][1], rows[1][2], rows[1][3], None)]
    return rows


TREE = "file_id long, tokens array<int>, parents array<int>, descendants array<int>, ingested_at timestamp_ntz"


@pytest.mark.parametrize("block", [384, 3])
def test_similar_pairs_equal_brute_force(spark, block, monkeypatch):
    import coppice.llm.neardup as nd

    monkeypatch.setattr(nd, "trie_join", lambda heads, num, den: triejoin.trie_join(heads, num=num, den=den, block=block))
    rows = tree_rows()
    df = spark.createDataFrame(rows, TREE).withColumn("rep", F.lit(1)).withColumn("n", F.lit("clash"))
    sets = {}
    for i, tokens, _, _, _ in rows:
        if i is not None and tokens and len(tokens) > 20:
            x = tokens[1:]
            sets[i] = {tuple(x[k : k + 4]) for k in range(len(x) - 3)}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.6}
    got = [tuple(r) for r in similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_similar_pairs_in_many_chunks_and_rounds(spark, monkeypatch):
    import coppice.llm.neardup as nd

    df = spark.createDataFrame(tree_rows(), TREE)
    want = sorted(map(tuple, similar_pairs(df).collect()))
    tables = []
    keep = triejoin.written
    monkeypatch.setattr(triejoin, "written", lambda x: tables.append(x.columns) or keep(x))
    for name, value in {"CHUNK": 300, "ROUND": 2000, "SHARE": 0}.items():
        monkeypatch.setattr(triejoin, name, value)
    assert sorted(map(tuple, nd.similar_pairs(df).collect())) == want and want
    assert tables.count(["home", "lo", "hi", "b", "rep"]) > 1


def test_packed_sets_and_bitmaps():
    rng = np.random.default_rng(4)
    sets = []
    for k in range(60):
        x = rng.integers(15, 1200, int(rng.integers(20, 900))).astype([np.int32, np.int64][k % 2])
        assert np.array_equal(unpacked(packed(x, 4)), runs_of(x, 4))
        sets.append(runs_of(x, 4))
    for k in range(60):  # most of another set and some of its own, at various sizes
        own = sets[k][rng.random(len(sets[k])) < rng.uniform(0.5, 1)]
        sets.append(np.union1d(own, rng.integers(-(2**63), 2**63, int(rng.integers(1, 80)))))
    sizes, bits = np.array([len(s) for s in sets]), [triejoin.parities(s) for s in sets]
    full = [set(s.tolist()) for s in sets]
    similar = {(i, j) for i, j in combinations(range(120), 2) if jaccard(full[i], full[j]) >= 0.6}
    hit = triejoin.near(np.zeros(120, np.int64), np.full(120, -1), sizes, bits, 6, 10)
    assert similar and set(np.flatnonzero(hit).tolist()) >= {k for p in similar for k in p}
    cells = np.arange(60).repeat(2)  # of two sets each
    order = np.arange(120).reshape(2, 60).T.ravel()
    hit = triejoin.near(cells, np.full(120, -1), sizes[order], [bits[k] for k in order], 6, 10)
    assert all(hit[2 * k] and hit[2 * k + 1] for k in range(60) if (k, k + 60) in similar)
    assert not triejoin.near(np.zeros(60, np.int64), np.full(60, -1), sizes[:60], bits[:60], 6, 10).any()
    one_side = np.zeros(120, np.int64)
    assert not triejoin.near(np.zeros(120, np.int64), one_side, sizes, bits, 6, 10).any()


def test_similar_pairs_write_less_than_four_times_their_input(spark, tmp_path, monkeypatch):
    import coppice.functions.scratch as scratch
    import coppice.llm.neardup as nd

    rng = np.random.default_rng(6)
    pool = rng.integers(15, 1200, 40_000)
    rows = []
    for i in range(600):  # one leaf in two nodes, passages that other files have too
        at = rng.integers(0, len(pool) - 40, 8)
        x = np.concatenate([*(pool[a : a + 20] for a in at), rng.integers(15, 1200, 160)])
        tokens = np.ravel(np.column_stack([rng.integers(1100, 1200, len(x)), x]))
        parents = np.where(np.arange(len(tokens)) % 2, np.arange(len(tokens)) - 1, np.maximum(0, np.arange(len(tokens)) - 2 * rng.integers(1, 30, len(tokens))))
        parents[0] = -1
        below = np.where(np.arange(len(tokens)) % 2, 0, rng.integers(1, 60, len(tokens)))
        rows.append((i, tokens.tolist(), parents.tolist(), below.tolist(), T0))
    spark.createDataFrame(rows, TREE).coalesce(1).write.parquet(str(tmp_path / "trees"))
    size = lambda folder: sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))

    def stages():
        """Bytes shuffled by stage."""
        java = spark.sparkContext._gateway
        none = java.jvm.java.util.ArrayList()
        found = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, java.new_array(java.jvm.double, 0), none)
        return {s.stageId(): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}

    tables = []
    keep = scratch.written

    def written(df):
        back = keep(df)
        tables.append(size(scratch._path_of[back].removeprefix("file://")))
        return back

    monkeypatch.setattr(nd, "written", written)
    monkeypatch.setattr(triejoin, "written", written)
    before = max(stages(), default=-1)
    similar_pairs(spark.read.parquet(str(tmp_path / "trees"))).collect()
    moved = sum(n for k, n in stages().items() if k > before)
    assert moved and sum(tables) + moved < 4 * size(tmp_path / "trees")


def test_groups_of_files(spark):
    df = spark.createDataFrame(tree_rows(), TREE)
    g = {r["file_id"]: r for r in groups(df).collect()}
    pairs = [tuple(r) for r in similar_pairs(df).collect()]
    assert len(g) == 64 and g[100]["links"] == 0 and g[103]["class_id"] == 1
    for a, b in pairs:
        assert g[a]["group_id"] == g[b]["group_id"]
    assert sum(r["links"] for r in g.values()) == 2 * len(pairs)
    assert groups(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 2: splits
def test_spanning_forest(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(40)] + [("x", "x"), (None, "y"), ("a", "b"), ("b", "a")]
    labels, forest = spanning_forest(spark.createDataFrame(edges, "a string, b string"))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            up[find(a)] = find(b)
    nodes = {x for e in edges if e[0] and e[1] and e[0] != e[1] for x in e}
    least = {}
    for x in nodes:
        least[find(x)] = min(least.get(find(x), x), x)
    assert {r["node"]: r["root"] for r in labels.collect()} == {x: least[find(x)] for x in nodes}
    assert forest.count() == len(nodes) - len(least)


def test_related_values_and_splits(spark):
    code = spark.createDataFrame([("Own/Repo",), ("https://h.example.org/own/repo.git",), (" own/repo/ ",), ("git@h.example.org:own/fork.git",), ("b/other",), ("c/dep",), (None,), ("",)], "repository string")
    train = spark.createDataFrame([("7",), ("07",), (" 7.0",), ("8",), (None,)], "label string")
    cocos = spark.createDataFrame([("merge_sorted_list",), ("MergeSortedList",), ("merge sorted  list ",), ("merge_list_sorted",), (None,)], "problem string")
    links = spark.createDataFrame([("own/fork", "x/between", "fork", 1), ("x/between", "OWN/repo", "mirror", 1), ("b/other", "c/dep", "depends", 1), (None, "b/other", "fork", 1)], "repository string, linked_repository string, relation string, kind int")
    values = raw_values(code, "repository", "repository").union(raw_values(train, "label", "label")).union(raw_values(cocos, "problem", "problem"))
    got = {}
    for r in related_pairs(values, links).collect():
        assert r["key_a"] < r["key_b"]
        got.setdefault(r["kind"], set()).update((r["key_a"], r["key_b"]))
    assert got["repository"] == {"Own/Repo", "https://h.example.org/own/repo.git", " own/repo/ ", "git@h.example.org:own/fork.git"}
    assert got["label"] == {"7", "07", " 7.0"} and got["problem"] == {"merge_sorted_list", "MergeSortedList", "merge sorted  list "}
    records = code.select(F.lit("repository").alias("kind"), F.monotonically_increasing_id().cast("string").alias("record"), F.col("repository").alias("raw"))
    out = assign(records, values, links)
    assert out.count() == 8 and {r["split"] for r in out.collect()} <= {"train", "validation", "test"}


def test_dealing_meets_the_proportions(spark):
    rng = random.Random(2)
    roots = [("k", f"r{i}", rng.choice([1, 1, 2, 3, 9, 40])) for i in range(900)] + [("k", "hot", 4000)]
    out = deal(spark.createDataFrame(roots, "kind string, root string, n long")).collect()
    assert len(out) == 901
    total = sum(r["n"] for r in out)
    for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r["n"] for r in out if r["split"] == split) / total - share) < 0.01


# ------------------------------------------------------------------ 3: syntax
GOOD = {
    "python": ["", "# only a comment", "x = [i for i in range(3) if i]\nwith a as b, c: pass\n", "def g():\n    yield x\n    y = yield\n    yield from z\n", "def f(a, *, b=1) -> int:\n    '''<<<<<<< HEAD'''\n    return a if b else -a\n", "match x:\n    case [1, *r]: pass\n"],
    "javascript": ["", "// c", "const f = async (a, {b = 1}) => { await g(a); };\nlet r = /[/]x/g\nfor (const k of o) { x?.y ??= `a${k}` }\n", "class A extends B { #x = 1; static get y() { return this.#x } }"],
    "java": ["", "package a.b;\nimport java.util.*;\npublic class A<T extends B> { int[] x = {1, 2}; <R> R f(List<Map<String, T>> l) throws E { for (var q : l) { x[0] >>= 1; } return (R) l.stream().map(v -> v).toList(); } }"],
    "go": ["", "package a\n\nimport \"fmt\"\n\ntype S struct {\n\tA, B int `t`\n}\n\nfunc (s *S) F(x ...int) (int, error) {\n\tfor i, v := range x {\n\t\tif v := i; v > 0 {\n\t\t\tfmt.Println(map[string]int{\"a\": v})\n\t\t}\n\t}\n\treturn 0, nil\n}\n"],
    "c": ["", "#include <a.h>\n#if X\nstatic int f(struct s *p, int (*g)(int)) { return p->x[1] + sizeof(int *) * (unsigned) g(2); }\n#endif\n", "typedef enum { A = 1, B } e; e x[] = { [0] = A, };"],
    "cpp": ["", "#include <v>\nnamespace n { template <typename T> class C : public B<T> { public: C(int a) : x{a} {} auto f() const -> int { return [&](auto y) { return y + x; }(1); } private: int x; }; }\nint main() { std::vector<std::pair<int, int>> v; for (const auto& e : v) std::cout << e.first << 1; }"],
}
BAD = {
    "python": ["def f(:\n  pass", "if x\n  y", "x = (1", "  x = 1\n y = 2", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "x = 'a"],
    "javascript": ["function f( {", "const = 1;", "/* open", "import x\nfrom y import z"],
    "java": ["class A { void f() { g( ; } }", "class A {", "def f(): pass"],
    "go": ["package a\nfunc f() {\n", "package a\nx := 1 +\n}", "int f() { return 1; }"],
    "c": ["#include <stdio", "#define\nint a;", "int f( { }", "int f() { return 1 }", "std::vector<int> x;", "#if X\nint a;"],
    "cpp": ["class A {", "int f() { return (1; }", "def f(x):\n    return x"],
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_grammars(lang):
    for text in GOOD[lang]:
        assert syntax.diagnose(text, lang)[0] is True, text
    for text in BAD[lang]:
        ok, at, line, cause = syntax.diagnose(text, lang)
        assert ok is False and 0 <= at <= len(text) and line >= 1 and cause, text


def test_python_grammar_agrees_with_the_language_on_this_repository():
    from pathlib import Path

    rng = random.Random(4)
    for file in sorted(Path(syntax.__file__).parents[1].rglob("*.py"))[:25]:
        text = file.read_text()
        assert syntax.recognise(text, "python")[0], file
        lines = text.split("\n")
        del lines[rng.randrange(len(lines))]
        try:
            ast.parse("\n".join(lines))
            good = True
        except SyntaxError:
            good = False
        assert syntax.recognise("\n".join(lines), "python")[0] == good, file


def test_syntax_of_files(spark):
    rows = [(1, "x = (", "Python", "r", "a.py", T0), (1, "x = (", "Python", "r", "a.py", T0), (2, "x = 1", None, None, "a.py", T0), (3, None, "go", "r", "b.go", T0), (4, "", "js", "r", None, T0), (5, "?", "klingon", "r", "q", T0), (6, "int x;\nconst int y = 1;", "c", "r", "c.c", T0), (None, "x", "go", "r", "x.go", T0)]
    df = spark.createDataFrame(rows, "file_id long, code string, language string, repository string, path string, parsed_at timestamp_ntz").withColumn("valid", F.lit("clash"))
    got = {r["file_id"]: r for r in syntax.check(df).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {1: False, 2: True, 3: None, 4: True, 5: None, 6: True}
    assert got[1]["cause"] in ("truncated", "syntax") and got[2]["language"] == "python"
    top = [r for r in syntax.rates(syntax.check(df)).collect() if r["level"] == "all"]
    assert (top[0]["files"], top[0]["invalid"]) == (4, 1)
    assert syntax.check(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 4: origin
def test_words_of_generated_files():
    for text in ("// Code generated by x_tool. DO NOT EDIT.", "# @generated by a", "/* This file was automatically generated by b; changes will be lost. */", "# state tables, built from x.y"):
        assert origin.says_generated("x = 1\n" + text + "\ny = 2")
    for text in ("# this module generates code, edit it freely", "print('Code generated by x. DO NOT EDIT.')", "# do not edit the table while it runs", "# typed by hand, not generated"):
        assert not origin.says_generated(text)


def test_origin_of_files(spark):
    words = ["[UNK]"] * 9 + ["\n\n", "\n", "        ", "    ", "  ", " "] + list("abcdefghijklmnopqrstuvwxyz0123456789(){};=+-*/<>.,:\"'!?_#") + ["Code generated by t. DO NOT EDIT."]
    ids = {w: k for k, w in enumerate(words)}
    enc = lambda s: [ids.get(c, 0) for c in s]
    rng = random.Random(3)

    def code(seed):
        r = random.Random(seed)
        w = lambda: "".join(r.choice("ghijklmnopq") for _ in range(r.randrange(2, 8)))
        forms = [lambda: f"{w()} = {w()}({w()}, {w()}[{r.randrange(9)}]".replace("[", "(") + "));", lambda: f"if {w()} < {w()}.{w()} {{", lambda: f"return {w()} + {w()} * {r.randrange(99)};", lambda: f"# {w()} {w()} {w()} {w()}", lambda: f"{w()}.{w()}({w()});", lambda: f"for {w()} : {w()}({w()}, {w()}) {{", lambda: f"{w()} -= {w()} / {w()};"]
        return "\n".join(r.choice(forms)() for _ in range(30))

    lib = code(1)
    gen = [ids["#"], ids[" "], len(words) - 1, ids["\n"]]
    blob = "x = {\n" + "\n".join(",".join(str(rng.randrange(256)) for _ in range(20)) for _ in range(20)) + "}"
    mini = "!" + ";".join(f"{rng.choice('abc')}.{rng.choice('xyz')}(u{k % 7})" for k in range(90)).replace("u", "f")
    rows = [(1, enc(code(2)), "o/r", "r-main/src/a.py"), (2, gen + enc(code(3)), "o/r", "r-main/src/b.py"), (3, enc(blob), "o/r", "r-main/src/c.py"), (4, enc(mini), "o/r", "r-main/src/d.js"), (5, enc(code(4)), "o/r", "r-main/vendor/lib/e.py"), (6, enc(lib), "o/r", "r-main/src/f.py"), (7, enc(lib), "lib/lib", "lib-main/src/f.py"),
            (8, enc(code(5)), None, None), (9, None, "o/r", "x"), (10, [], "o/r", "r-main/src/g.py"), (11, enc(code(6)), "o/r", "r-main/src/vendor_list.py"), (None, enc(code(7)), "o/r", "z")]
    rows = [(*r, T0) for r in rows + rows[:2]]
    df = spark.createDataFrame(rows, "file_id long, data array<int>, repository string, path string, ingested_at timestamp_ntz").withColumn("label", F.lit(1))
    vocabulary = spark.createDataFrame(list(enumerate(words)), "token_id int, token string")
    libs = spark.createDataFrame([(1, "lib", "Lib/lib", "lib/f.py", "python", enc(lib))], "lib_id int, lib_name string, repository string, path string, language string, data array<int>")
    got = {r["file_id"]: r["label"] for r in origin.origins(df, vocabulary, libs).collect()}
    assert got == {1: "handwritten", 2: "generated", 3: "blob", 4: "minified", 5: "vendored", 6: "vendored", 7: "handwritten", 8: "handwritten", 10: "handwritten", 11: "handwritten"}
    assert origin.origins(df.limit(0), vocabulary, libs.limit(0)).count() == 0


# ------------------------------------------------------------------ 5 and 6: pieces and batches
@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_overlap_and_fit(seed):
    rng = np.random.default_rng(seed)
    data = rng.choice([10, 9, 12, 20, 21, 22], rng.integers(300, 2500), p=[0.04 if seed % 3 else 0.002, 0.01 if seed % 3 else 0.0, 0.1, 0.3, 0.3, 0.25 if seed % 3 else 0.298])
    limit, overlap = 120, 20
    start, stop, forced = pieces.cut_places(data, limit, overlap, np.linspace(0, 1, pieces.KINDS))
    assert start[0] == 0 and stop[-1] == len(data) and ((stop - start) <= limit).all() and (np.diff(stop) > 0).all()
    ends = pieces.line_ends(data)
    longest = np.diff(np.concatenate([[0], ends])).max()
    assert forced == (longest > limit)
    shared = stop[:-1] - start[1:]
    assert ((shared >= 0) & (shared <= overlap)).all()
    if not forced:
        assert set(stop.tolist()) <= set(ends.tolist())
    if longest <= limit - overlap:
        assert (shared == overlap).all()


def test_pieces_of_files(spark):
    rows = [(1, [20, 10] * 30, "go"), (1, [20, 10] * 30, "go"), (2, [20] * 60, "go"), (3, [20] * 10, "go"), (4, None, "go"), (5, [], "go"), (6, [20] * 99, "other"), (None, [20] * 99, "go")]
    df = spark.createDataFrame(rows, "file_id long, data array<int>, language string").withColumn("piece", F.lit("clash"))
    limits = spark.createDataFrame([("go", 20, 4, 25)], "language string, max_tokens int, overlap int, max_tokens_in_batch int")
    got = pieces.pieces(df, limits, np.zeros(pieces.KINDS)).collect()
    assert {(r["file_id"], r["cut"]) for r in got} == {(1, "clean"), (2, "forced")}
    assert len(got) == len({(r["file_id"], r["piece"]) for r in got})
    sized = df.select("file_id", F.size("data").alias("n_tokens"), "language")
    packed = packing.batches(packing.parts_of(sized, limits), shard=2).collect()
    load = {}
    for r in packed:
        load[r["shard"], r["batch"]] = load.get((r["shard"], r["batch"]), 0) + r["stop"] - r["start"]
    assert max(load.values()) <= 25 and sum(load.values()) == 60 + 60 + 10
    assert {r["file_id"] for r in packed if r["n_parts"] > 1} == {1, 2}
    assert packing.batches(packing.parts_of(sized.limit(0), limits)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_fits_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(6, 0.8, 400).astype(int) + 1, 6144)
    where = packing.pack(sizes, 6144)
    load = np.bincount(where, weights=sizes)
    assert load.max() <= 6144 and len(load) <= sizes.sum() / 6144 + 2.5
    assert packing.pack(np.array([5, 5, 5]), 5).tolist() == [0, 1, 2]


# ------------------------------------------------------------------ 7: overlap of splits
def test_overlaps_equal_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(60)) for _ in range(4)]

    def vary(t):
        w = t.split(" ")
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = "z" + str(rng.randrange(99))
        return " ".join(w)

    make = lambda lo, n: [(str(lo + i), vary(rng.choice(base)), "r" if i % 2 else None, T0) for i in range(n)]
    train, valid, test = make(100, 40) + [("190", None, "r", T0), ("191", "", "r", T0), ("192", "a b", "r", T0)], make(200, 15), make(300, 15)
    train += train[:3]
    schema = "index string, code string, repository string, collected_at timestamp_ntz"
    dfs = [spark.createDataFrame(x, schema).withColumn("split", F.lit(1)) for x in (train, valid, test)]
    sets = {i: {tuple(c.split()[k : k + 4]) for k in range(len(c.split()) - 3)} for i, c, _, _ in train + valid + test if c and len(c.split()) >= 20}
    want = {(s, a, b) for s, part in (("valid", valid), ("test", test)) for a in {r[0] for r in train} & set(sets) for b, *_ in part if jaccard(sets[a], sets[b]) >= 0.6}
    got = [tuple(r) for r in overlaps(*dfs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    rep = report(*dfs).collect()
    assert sum(r["programs"] for r in rep) == 30 and sum(r["overlapping"] for r in rep) == len({(s, b) for s, _, b in want})


def test_words_and_sets(spark):
    assert len(runs_of(np.arange(3), 4)) == 0
    df = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, ""), (4, "é+é x")], "id long, t string")
    assert {r["id"]: r["n"] for r in text_sets(df, ["id"], "t", width=4, least=4).collect()} == {1: 2, 4: 1}


# ------------------------------------------------------------------ 8: encoding
def test_encoding_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = ["".join(rng.choice(" abcdefgeinst\n\té漢字0192_-  😀\x00'<|>") for _ in range(rng.randrange(0, 200))) for _ in range(300)] + ["<|endoftext|>", "a" * 5000, " " * 700, "I'd we'll  x\r\n", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert got == dict(enumerate(want))
    assert bpe.encode(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 9: mixing
def test_permutations():
    for n in (1, 2, 3, 10, 257):
        for key in range(3):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


def test_mixing(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randrange(0, 60))), rng.choice(["a", "a", "b", "c", None])) for i in range(300)] + [(900, None, "a"), (901, "", "b"), (None, "x", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("index", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("gone", 0.2, 4), (None, 0.1, 1), ("c", 0.0, 1)], "source string, weight double, max_repeats int")
    slots, rep = mixing.mix(df, targets, block=16)
    rows = slots.collect()
    shares = {r["source"]: r for r in rep.collect()}
    assert set(shares) == {"a", "b", "gone"} and shares["gone"]["used_blocks"] == 0
    assert abs(shares["a"]["share"] - 0.625) < 0.02 and abs(shares["b"]["share"] - 0.375) < 0.02
    uses = {}
    for r in rows:
        uses[r["source"], r["index"]] = uses.get((r["source"], r["index"]), 0) + 1
        assert sum(p["stop"] - p["start"] for p in r["pieces"]) == r["n_tokens"] <= 16
    assert max(v for (s, _), v in uses.items() if s == "a") == 1 and max(v for (s, _), v in uses.items() if s == "b") <= 3
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    none, report0 = mixing.mix(df.limit(0), targets, block=16)
    assert none.count() == 0 and report0.count() == 3


# ------------------------------------------------------------------ 10: personal information
CASES = [
    ("Mail me at clara.ostergrain@dev.example.com.", {("email", "clara.ostergrain@dev.example.com")}),
    ("contact: otis+tag[at]lab [dot] example [dot] org", {("email", "otis+tag[at]lab [dot] example [dot] org")}),
    ("Reply to mei at dev dot example dot net please", {("email", "mei at dev dot example dot net")}),
    ("fax +49 (0)30 23125654\ncode", {("phone", "+49 (0)30 23125654")}),
    ("On-call number is (020) 7946 0144 this week. tel. 617-555-0109", {("phone", "(020) 7946 0144"), ("phone", "617-555-0109")}),
    ("ssn: 964-04-3104 and passport no. X02200965", {("id_number", "964-04-3104"), ("id_number", "X02200965")}),
    ("My NI number, QQ 05 25 62 A, is refused.", {("id_number", "QQ 05 25 62 A")}),
    ("insured person no. 2 54 09 99 179 145 91", {("id_number", "2 54 09 99 179 145 91")}),
    ("Our office is at Flat 9, 51 Drumlin Terrace, Norvale QZ8 8QQ, second floor.", {("address", "Flat 9, 51 Drumlin Terrace, Norvale QZ8 8QQ")}),
    ("Anschrift: Kratzmühlstraße 7a, D-00636 Bad Lindholz", {("address", "Kratzmühlstraße 7a, D-00636 Bad Lindholz")}),
    ("Envoyez la carte au 79 rue des Tilleuls Bleus, 00384 Valmorin.", {("address", "79 rue des Tilleuls Bleus, 00384 Valmorin")}),
    ("El paquete va a Avenida de los Tejares 188, 00292 Ordoña.", {("address", "Avenida de los Tejares 188, 00292 Ordoña")}),
    ("Reviewed by Mei R. Ostergrain. Thanks to Wrexholt, Clara for it", {("name", "Mei R. Ostergrain"), ("name", "Wrexholt, Clara")}),
    ("// original idea: K. Okonjibe\n# written by Tomas Ostergrain-Tavendrel", {("name", "K. Okonjibe"), ("name", "Tomas Ostergrain-Tavendrel")}),
    ("Error 405-05-3731 is a code of the driver. checksum 59835983599 build 2080700147", set()),
    ("Seen on 2023-09-19 10:29:09, host 192.0.2.17. part number 92-44-926, 3 Lane mode", set()),
    ("Run `digest@build-4:~$ make`. Pinned to margin@21.4.49. `a @ b` git@code.example.org:own/repo.git", set()),
    ("Merge Queue 46 waits. Sparse Grid and Token Tree are the two modes.", set()),
]


@pytest.mark.parametrize("text, want", CASES)
def test_personal_information(text, want):
    names = pii.Names(frozenset("merge queue sparse grid token tree lane".split()))
    assert {(s.kind, text[s.start : s.stop]) for s in pii.spans(text, names)} == want


def test_redaction_is_reversible(spark):
    rows = [(k, t) for k, (t, _) in enumerate(CASES)] + [(90, None), (91, ""), (92, "x" * 10_000), (92, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))
    for r in pii.redact(df, ["merge", None, "queue"]).collect():
        text = dict(rows)[r["doc_id"]] if r["doc_id"] != 92 else r["redacted"]
        if text is None:
            assert r["redacted"] is None and r["found"] == []
            continue
        back = r["redacted"]
        for f in r["found"]:
            back = back.replace(f"[{f['pii_type'].upper()}]", f["pii_text"], 1)
        assert back == text


@pytest.mark.parametrize("form", [f[0] for f in pii.ID_FORMS[:-1]] + [f[0] for f in pii.PHONE_FORMS])
def test_number_forms_hold_a_run_of_digits(form):
    rng = random.Random(form.pattern)
    found = 0
    for _ in range(4_000):
        text = "".join(rng.choice("0123456789" * 3 + " .-()/+AXab") for _ in range(rng.randrange(8, 30)))
        for m in form.finditer(text):
            if form in [f[0] for f in pii.ID_FORMS] or sum(c.isdigit() for c in m[0]) >= 7:
                found += 1
                assert pii.DIGITS.search(text)
    made = ["1 54 09 99 179 145 91", "23 456 789 012", "964-04-3104", "046 454 286", "QQ 05 25 62 A", "12345678-Z", "X02200965", "+49 (0)30 23125654", "(020) 7946 0144", "617-555-0109", "01 23 45 67 89", "030 1234567", "612 345 678", "612 34 56 78", "555 0199 22", "0301234567", "(617) 555-0109"]
    for x in made:
        if form.search(x):
            found += 1
            assert pii.DIGITS.search(x)
    assert found


def test_a_form_with_two_digits_is_found_alone():
    assert [s.kind for s in pii.spans("passport C1BCDEFGH2", pii.Names(frozenset()))] == ["id_number"]
    many = " ".join(f"tel. 617-555-{k:04d}" for k in range(3000))
    assert len(pii.spans(many, pii.Names(frozenset()))) == 3000


def test_mixing_plans_any_number_of_slots(spark):
    take = mixing.plan({"a": (10**10, 512 * 10**10), "b": (10**9, 512 * 10**9)}, {"a": (0.9, 1), "b": (0.1, 4)})
    assert sum(take.values()) > 10**10 and take["a"] <= 10**10 and take["b"] <= 4 * 10**9
    drawn = mixing.draws(spark, {"a": 60_000, "b": 20_000}).collect()
    for no in (0, 1):
        mine = sorted((r["first"], r["count"]) for r in drawn if r["source_no"] == no)
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
    assert sum(r["count"] for r in drawn) == 80_000


def test_splits_across_all_entities(spark):
    from coppice.llm.splits import assign_across, crossings

    rows = [("label", "1", ["label=1", "repository=a/b"]), ("label", "2", ["label=1", None]), ("repository", "3", ["repository=a/b"]), ("repository", "4", ["repository=c/d"]), ("repository", "5", [None]), ("label", "1", ["label=1", "repository=e/f"]), ("repository", "6", ["repository=x/y"])]
    records = spark.createDataFrame(rows, "kind string, record string, nodes array<string>")
    links = spark.createDataFrame([("e/f", "c/d", "fork")], "repository string, linked_repository string, relation string")
    out = assign_across(records, links)
    got = {(r["kind"], r["record"]): (r["root"], r["split"]) for r in out.collect()}
    assert len(got) == 6 and len({got[k] for k in (("label", "1"), ("label", "2"), ("repository", "3"), ("repository", "4"))}) == 1
    assert got["repository", "5"][0] != got["repository", "6"][0]
    assert {r["in_several_splits"] for r in crossings(out, records, links).collect()} == {0}
    assert assign_across(records.limit(0), links).count() == 0


def test_check_digits():
    assert pii.luhn("046454286") and not pii.luhn("046454287")
    assert pii.mod_97("255081416802538") and pii.mod_23("12345678Z") and pii.mod_11_10("86095742719")
