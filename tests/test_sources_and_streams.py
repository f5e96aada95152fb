import json
import time

import pytest
from pyspark.sql import functions as F

from coppice.operators.batching import cut
from coppice.sources import readers as S
from coppice.streaming.batches import Accumulator, batched_stream, endless


def test_snippets_and_distractors(spark, tmp_path):
    rows = [{"problem": p, "problem_description": p.upper(), "method_masked": f"m{i}", "target": f"t{i}"} for i, p in enumerate(["b", "a", "b"])]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    queries, targets, problems = S.snippets(spark, str(tmp_path / "s.jsonl"))
    assert {r["query_id"]: (r["label"], r["code"]) for r in targets.collect()} == {0: (2, "t0"), 1: (1, "t1"), 2: (2, "t2")}
    assert {r["label"]: r["problem"] for r in problems.collect()} == {1: "a", 2: "b"}
    assert queries.count() == 3
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"language": "go", "code_sampled_span": f"c{i}"}) for i in range(5)))
    assert {r["code"] for r in S.distractors(spark, str(tmp_path / "d.jsonl"), 2).collect()} == {"c0", "c1"}


def test_split_by_position(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"func": f"f{i}", "target": i % 2} for i in range(6)]))
    for name, ids in (("train", [0, 2, 5]), ("test", [1])):
        (tmp_path / f"{name}.txt").write_text("\n".join(map(str, ids)) + "\n")
    got = S.split_by_position(spark, str(tmp_path / "f.json"), {n: str(tmp_path / f"{n}.txt") for n in ("train", "test")})
    assert {(r["idx"], r["split"], r["func"]) for r in got.collect()} == {(0, "train", "f0"), (2, "train", "f2"), (5, "train", "f5"), (1, "test", "f1")}


def test_labelled_folders_and_encodings(spark, tmp_path):
    for label, name, data in (("1", "a.c", b"\xe9"), ("70", "b.c", b"x"), ("300", "c.c", b"y")):
        (tmp_path / "p" / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / label / name).write_bytes(data)
    got = {r["label"]: (r["split"], r["code"]) for r in S.labelled_folders(spark, str(tmp_path / "p")).collect()}
    assert got == {"1": ("train", "é"), "70": ("valid", "x")}
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "u.py").write_bytes("ü".encode())
    (tmp_path / "q" / "l.py").write_bytes(b"\xfc")
    assert [r["code"] for r in S.source_files(spark, str(tmp_path / "q")).collect()] == ["ü", "ü"]


def test_vectors_and_heads(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\na 1 2 3\nb 4 5 6\n")
    v = S.word_vectors(spark, str(tmp_path / "v.txt"))
    assert {r["word"]: r["vector"] for r in v.collect()} == {"a": [1.0, 2.0, 3.0], "b": [4.0, 5.0, 6.0]}
    row = S.vocabulary_overlap(v, spark.createDataFrame([("a",), ("z",)], "token string")).first()
    assert (row["vectors"], row["tokens"], row["both"]) == (2, 2, 1)
    heads = spark.createDataFrame([(1, [1, 1, 1, 2]), (2, [0, 1])], "id long, heads array<int>")
    got = S.from_heads(heads, "id").collect()
    assert [(r["id"], r["parents"], r["order"]) for r in got] == [(1, [-1, 0, 0, 2], [1, 0, 2, 3])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([([1, 2], ["a", "b"])], "x array<int>, y array<string>")
    S.write_zipped(df, ["x", "y"], str(tmp_path / "z"), 3)
    assert {(r["x"], r["y"]) for r in spark.read.json(str(tmp_path / "z" / "version=3")).collect()} == {(1, "a"), (2, "b")}


def test_batches_of_a_stream(spark, tmp_path):
    folder, sizes = str(tmp_path / "in"), [((7 * i) % 40) + 1 for i in range(60)]
    rows = spark.createDataFrame([(i, "k", s) for i, s in enumerate(sizes)], "id long, k string, size int")
    rows.where("id < 30").coalesce(1).write.mode("append").parquet(folder)
    rows.where("id >= 30").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = batched_stream(stream, "k", "size", "id", budget=120, longest=40, buckets=2)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts would run on and on
    q = out.writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    done = q.awaitTermination(45)
    q.stop()
    assert done
    got = spark.table("batches").collect()
    assert got and all(r["cost"] <= 120 for r in got)
    for b in (0, 1):
        mine = [(i, s) for i, s in enumerate(sizes) if min(s // 20, 1) == b]
        number = cut(__import__("numpy").array([s for _, s in mine]), 120)
        want = {n: [i for (i, _), m in zip(mine, number) if m == n] for n in set(number.tolist())}
        for r in (r for r in got if r["bucket"] == b):
            assert r["ids"] == want[r["batch"]]


def test_old_versions_are_removed(spark, tmp_path):
    df = spark.createDataFrame([([1], ["a"])], "x array<int>, y array<string>")
    for version in range(7):
        S.write_zipped(df, ["x", "y"], str(tmp_path / "v"), version)
    assert sorted(x.name for x in (tmp_path / "v").iterdir()) == [f"version={k}" for k in range(2, 7)]


def test_pairs_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "pairs")
    rows = spark.createDataFrame([(i, "k", (7 * i) % 20 + 1, (3 * i) % 20 + 1) for i in range(40)], "id long, k string, s int, t int")
    rows.coalesce(1).write.parquet(folder)
    out = batched_stream(spark.readStream.schema(rows.schema).parquet(folder), "k", "s", "id", budget=60, longest=20, buckets=2, sizes=["s", "t"])
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = out.writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    done = q.awaitTermination(60)
    q.stop()
    assert done
    got = spark.table("pairs").collect()
    side = {r["id"]: (r["s"], r["t"]) for r in rows.collect()}
    assert got and {r["bucket"] for r in got} <= {0, 1, 2, 3}
    for r in got:
        assert r["cost"] == max(max(side[i]) for i in r["ids"]) * len(r["ids"]) <= 60
        assert {min(side[i][0] // 10, 1) * 2 + min(side[i][1] // 10, 1) for i in r["ids"]} == {r["bucket"]}


def test_a_table_without_end(spark, tmp_path):
    stream = endless(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int"), "k", 50)
    q = stream.writeStream.format("memory").queryName("endless").outputMode("append").option("checkpointLocation", str(tmp_path / "cp3")).start()
    for _ in range(60):
        time.sleep(1)
        if spark.table("endless").where("pass > 0").count() > 3:
            break
    q.stop()
    assert {(r["k"], r["v"]) for r in spark.table("endless").collect()} == {("a", 1), ("b", 2), ("c", 3)} and spark.table("endless").agg(F.max("pass")).first()[0] > 0


def test_accumulator(spark, tmp_path):
    acc = Accumulator(str(tmp_path / "acc"), 5)
    for epoch in range(4):
        acc(spark.range(3), epoch)
    assert acc.table(spark).count() == 6
    acc.reset()
    acc(spark.range(1), 9)
    assert acc.table(spark).count() == 1
    with pytest.raises(ValueError):
        batched_stream(spark.range(1).withColumn("s", F.lit(1)), "id", "s", "id", budget=1, longest=2, buckets=1)
