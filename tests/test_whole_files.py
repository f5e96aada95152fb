"""Queries over whole files: nothing is cut from a result."""

import hashlib
from collections import Counter
from datetime import datetime

import pytest

import __spark_entry__ as entry

LENGTHS = {1: 5, 2: 290, 3: 301, 4: 700, 5: 3999, 6: 4001, 7: 9000, 8: 0}
DATA = {k: [15 + (k * 7 + i) % 900 for i in range(n)] for k, n in LENGTHS.items()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A code_data with short, long, empty and null files, one of them delivered twice."""
    at = tmp_path_factory.mktemp("tables")
    rows = [(k, d, ("C++", "go", None)[k % 3], datetime(2026, 1, 2)) for k, d in DATA.items()] + [(9, None, "go", datetime(2026, 1, 2)), (1, [20], "go", datetime(2026, 1, 1))]
    spark.createDataFrame(rows, "file_id long, data array<int>, language string, ingested_at timestamp").write.parquet(f"{at}/code_data.parquet")
    return str(at)


def run(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def test_collated_batches_hold_every_file(spark, folder):
    rows = run(spark, folder, "collated_batches")
    assert Counter(int(x) for r in rows for x in r["ids"].split(",")) == Counter(k for k, n in LENGTHS.items() if n)
    assert sum(r["ntokens"] for r in rows) == sum(LENGTHS.values())
    for r in rows:
        assert r["width"] == max(LENGTHS[int(x)] for x in r["ids"].split(",")) and r["width"] * r["nsamples"] <= 9000


def test_bucket_and_language_batches_hold_every_file(spark, folder):
    rows = run(spark, folder, "bucket_batches")
    assert sorted(r["file_id"] for r in rows) == [k for k, n in LENGTHS.items() if n]
    batches = run(spark, folder, "language_batches")
    assert sum(r["n"] for r in batches) == len(rows) and sum(r["tokens"] for r in batches) == sum(LENGTHS.values())
    assert all(r["cost"] <= 32_000 for r in batches)


def test_a_budget_grows_to_the_longest_file(spark, tmp_path):
    rows = [(1, [15] * 40_000, "go", datetime(2026, 1, 2)), (2, [15] * 3_999, "go", datetime(2026, 1, 2))]
    spark.createDataFrame(rows, "file_id long, data array<int>, language string, ingested_at timestamp").write.parquet(f"{tmp_path}/code_data.parquet")
    assert sorted(r["size"] for r in run(spark, str(tmp_path), "bucket_batches")) == [3_999, 40_000]


def joined(tokens, sep=","):
    return hashlib.md5(sep.join(map(str, tokens)).encode()).hexdigest()


def duck(folder, name):
    """The rows of a query's SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW code_data AS SELECT * FROM '{folder}/code_data.parquet/*.parquet'")
    return con.execute(entry.oracle_sql()[name]).fetchall()


def test_whole_sequences_are_shifted(spark, folder):
    rows = run(spark, folder, "shifted_sequences")
    assert {r["file_id"]: (r["n"], r["tokens"]) for r in rows} == {k: (len(d), joined(d[-1:] + d[:-1])) for k, d in DATA.items()}
    assert sorted(map(tuple, rows)) == sorted(duck(folder, "shifted_sequences"))


def test_whole_sequences_are_padded(spark, folder):
    rows = run(spark, folder, "padded_sequences")
    want = {}
    for k, d in DATA.items():
        fill = -len(d) % 64
        want[k] = (len(d) + fill, joined(d + [3] * fill), joined("1" * len(d) + "0" * fill, ""))
    assert {r["file_id"]: (r["width"], r["tokens"], r["mask"]) for r in rows} == want
    assert sorted(map(tuple, rows)) == sorted(duck(folder, "padded_sequences"))


@pytest.fixture(scope="module")
def forest(spark, tmp_path_factory):
    """A code_trees of a deep, a wide and a mixed tree of more than 40 nodes and a single node, with its vocabulary."""
    at = tmp_path_factory.mktemp("trees")
    shapes = {1: [-1, *range(59)], 2: [-1] + [0] * 70, 3: [-1] + [0, 1, 2, 2, 1, 0, 6, 6] * 1 + [0] * 40, 4: [-1]}
    rows = [(k, [20 + i % 30 for i in range(len(p))], p, None, datetime(2026, 1, 1)) for k, p in shapes.items()]
    spark.createDataFrame(rows, "file_id long, tokens array<int>, parents array<int>, descendants array<int>, ingested_at timestamp").write.parquet(f"{at}/code_trees.parquet")
    spark.createDataFrame([(i, f"t{i}") for i in range(15, 60)], "token_id int, token string").write.parquet(f"{at}/vocabulary.parquet")
    return str(at), shapes


def test_trees_are_drawn_whole(spark, forest):
    folder, shapes = forest
    drawn = {r["file_id"]: r["drawing"].split("\n") for r in run(spark, folder, "tree_drawings")}
    assert {k: len(lines) for k, lines in drawn.items()} == {k: len(p) for k, p in shapes.items()}
    for lines in drawn.values():
        assert [int(x.rpartition("t")[2]) for x in lines] == [20 + i % 30 for i in range(len(lines))]


def test_sums_over_all_pairs_of_nodes(spark, forest):
    folder, shapes = forest
    got = {(r["file_id"], r["idx"]): tuple(r)[2:] for r in run(spark, folder, "tree_pair_sums")}
    assert len(got) == sum(map(len, shapes.values()))
    for k, parents in shapes.items():
        paths = []
        for i, p in enumerate(parents):
            paths.append([*(paths[p] if p >= 0 else []), i])
        for i, a in enumerate(paths):
            shared = [[x for x, y in zip(a, b) if x == y] for b in paths]
            up, down = sum(len(a) - len(s) for s in shared), sum(len(b) - len(s) for s, b in zip(shared, paths))
            assert got[k, i] == (len(paths), sum(s[-1] for s in shared), up, down, up + down)


def test_every_file_has_a_shard(spark, folder):
    rows = run(spark, folder, "file_shards")
    assert sorted((r["file_id"], r["shard"]) for r in rows) == [(k, k % 4) for k in range(1, 10)]
