import pytest
from pyspark.sql import functions as F

from coppice.operators import collation as C
from coppice.operators import text as P
from coppice.operators import trees as N
from coppice.operators.ranking import ranked
from coppice.operators.tokenizer import CodeTokenizer, detokenised, split_spans, tokenised
from coppice.operators.tokens import modified, text_of, words_by_id
from coppice.plans.pipelines import Pipeline, load_config

BYTES, SENTENCE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def test_trees_in_a_batch(spark):
    rows = [(1, "b", [5, 6, 7, 8], [-1, 0, 1, 0], [3, 1, 0, 0]), (2, "b", [5, 6, 7], [-1, 0, 1], [2, 1, 0])]
    df = spark.createDataFrame(rows, "id long, batch string, tokens array<int>, parents array<int>, descendants array<int>").withColumn("width", F.lit("clash"))
    left = C.collated_trees(df, ["batch"], "id", left=True).first()
    assert left["parents"] == [[-1, 0, 1, 0], [-1, -1, 1, 2]] and left["tokens"][1] == [-1, 5, 6, 7]
    right = C.collated_trees(df, ["batch"], "id", multiple=8).first()
    assert right["width"] == 8 and right["descendants"][1] == [3, 2, 1, 0, 0, 0, 0, 0] and right["labels"][1] == [2, 1, 0, -1, -1, -1, -1, -1]
    assert C.collated_trees(df.limit(0), ["batch"], "id").count() == 0


def test_pairs_in_a_batch(spark):
    rows = [(1, 0, [5, 6], [7, 2], [[1, 2], [3, 4]]), (2, 0, [5, 6, 7], [2], [[9]]), (3, 0, [], [8, 8, 2], [])]
    df = spark.createDataFrame(rows, "id long, batch int, source array<int>, target array<int>, distances array<array<int>>")
    r = C.collated_pairs(df, ["batch"], "id", left_source=True, matrices={"distances": 0}).first()
    assert r["ids"] == [2, 1, 3] and r["source_tokens"] == [[5, 6, 7], [3, 5, 6], [3, 3, 3]] and r["source_mask"][1] == [False, True, True]
    assert r["target_tokens"] == [[2, 3, 3], [7, 2, 3], [8, 8, 2]] and r["shifted_tokens"] == [[2, 3, 3], [2, 7, 3], [2, 8, 8]]
    assert r["distances"] == [[[9, 0], [0, 0]], [[1, 2], [3, 4]], [[0, 0], [0, 0]]] and (r["source_ntokens"], r["target_ntokens"], r["nsamples"]) == (5, 6, 3)
    with pytest.raises(Exception, match="end token"):
        C.collated_pairs(df.withColumn("target", F.array(F.lit(9))), ["batch"], "id").collect()
    assert C.collated_pairs(df.withColumn("target", F.array(F.lit(9))), ["batch"], "id", feed=False).count() == 1


@pytest.mark.parametrize("text", ["", "def f(x):\n    return [x, 'é😀'] # <|endoftext|>\n", "a" * 5000, "([{", "\t\r\n\x00"])
def test_trees_and_texts_survive_the_tokenizer(text):
    t = CodeTokenizer.load(BYTES, ["[program]", "[group]", "[ERROR]"])
    parents, labels, _ = P.bracket_tree(text)
    assert t.decode(t.encode(text)) == text
    if len(labels) > 1:
        assert t.decode_tree(*t.encode_tree(parents, labels)) == (parents, labels)


def test_tokenizer_is_told_by_its_vocabulary(tmp_path):
    t = CodeTokenizer.load(BYTES, ["[a]"])
    t.save(str(tmp_path / "t.json"))
    assert CodeTokenizer.load(str(tmp_path / "t.json")) == t != t.with_specials(["[b]"]) and hash(t) == hash(CodeTokenizer.load(BYTES, ["[a]"]))
    assert t.with_specials(["[b]"]).special_ids["[a]"] == t.special_ids["[a]"] and len(t) == t.base_size + 3
    assert t.decode([t.special_ids["[a]"], *t.encode("x")]) == "[a]x" and t.encode(None) == []
    s = CodeTokenizer.load(SENTENCE)
    assert s.decode(s.encode("hello world")) == "hello world" and s != t


def test_texts_of_a_table(spark):
    df = spark.createDataFrame([(1, "x = 'é'"), (2, ""), (3, None), (1, "again")], "id long, t string").withColumn("ids", F.lit("clash"))
    coder = CodeTokenizer.load(BYTES)
    ids = tokenised(df, "id", "t", coder)
    back = [(r["id"], r["text"]) for r in detokenised(ids, "id", "ids", coder).collect()]
    assert sorted(back) == [(1, "again"), (1, "x = 'é'"), (2, ""), (3, "")]
    assert tokenised(df.limit(0), "id", "t", coder).count() == 0


def test_spans_of_split_leaves():
    parents, labels, spans = split_spans([-1, 0, 0], ["[p]", "ab", "c"], [(0, 3), (0, 2), (2, 3)], list)
    assert labels == ["[p]", "[BPE]", "a", "b", "c"] and parents == [-1, 0, 1, 1, 0] and spans == [(0, 3), (0, 2), None, None, (2, 3)]


def test_one_or_both_sides_are_modified(spark):
    df = spark.createDataFrame([([1], [2]), ([1], None)], "source array<int>, target array<int>")
    twice = lambda t: F.concat(t, t)
    pair = F.struct("source", "target")
    assert [r["p"] and (r["p"]["source"], r["p"]["target"]) for r in df.select(modified(pair, twice, target=False).alias("p")).collect()] == [([1, 1], [2]), None]


def test_words_are_looked_up_by_id(spark):
    words = words_by_id(spark.createDataFrame([(0, "a"), (3, "\n\"é"), (1, None), (None, "x")], "token_id int, token string"))
    df = spark.createDataFrame([([0, 3, 7, 1, 0],), ([],), (None,)], "t array<int>")
    assert [r["x"] for r in df.select(text_of(F.col("t"), words).alias("x")).collect()] == ["a\n\"éa", "", None]


def test_ranks_over_ranges(spark):
    df = spark.createDataFrame([(f"v{(i * 37) % 500:03d}",) for i in range(500)] + [(None,), ("v001",)], "v string").repartition(9)
    got = {r["v"]: r["rank"] for r in ranked(df, "v").collect()}
    assert got == {f"v{i:03d}": i + 1 for i in range(500)} and ranked(df.limit(0), "v").count() == 0


def test_failures_are_kept_as_rows(spark):
    df = spark.createDataFrame([(1, [2]), (2, None), (3, [])], "id long, a array<int>")
    got = {r["id"]: (r["x"], r["why"]) for r in N.tree_map(df, ["id"], ["a"], lambda a: [(int(a[0]),)], "x int", errors="why").collect()}
    assert got[1] == (2, None) and got[2][0] is None and got[2][1] and got[3][1]


def test_pipeline_from_settings(spark, tmp_path):
    (tmp_path / "c.toml").write_text("least = 3\n")
    (tmp_path / "c.json").write_text('{"least": 3}')
    config = load_config(str(tmp_path / "c.toml"))
    assert config == load_config(str(tmp_path / "c.json"))
    p = Pipeline({"train": lambda s: s.range(10)}, steps=[lambda d: d.where(F.col("id") >= config["least"])], own={"train": [lambda d: d.where("id < 9")]}, batcher=lambda d: d.groupBy(F.floor(F.col("id") / 4).alias("b")).count())
    assert p.samples(spark, "train").count() == 6 and p.batches(spark, "train").count() == 3
    with pytest.raises(KeyError):
        p.samples(spark, "test")
