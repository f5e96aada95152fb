"""Near-duplicate trees: files whose leaf runs mostly agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.scratch import dropped, shuffled, written
from coppice.llm.forest import spanning_forest
from coppice.llm.shingles import classes, tree_sets
from coppice.llm.triejoin import expand, trie_join

#: Runs of four leaf tokens without ids 0-14; at least 20 leaves; similarity 6/10 (fixed by the task).
WIDTH, LEAST, FIRST_ID, NUM, DEN = 4, 20, 15, 6, 10


def similar_classes(trees: DataFrame, *, num: int = NUM, den: int = DEN, width: int = WIDTH, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(members(file_id, rep), pairs(rep_a, rep_b, overlap, n_a, n_b))`` of a table of trees.

    ``trees(file_id, tokens, parents, descendants, ingested_at)``: null descendants are derived from
    the parents; rows with a null file_id or null tokens and files of fewer than ``least`` leaves are
    in no class; of redelivered rows the last counts. Members hold every other file, once.
    """
    sets = written(tree_sets(trees.where("file_id is not null"), ["file_id", "ingested_at"], width=width, least=least, first_id=FIRST_ID))
    members, heads = classes(sets, "file_id", "ingested_at", ("n", "packed"))
    members, pairs = written(members), trie_join(heads, num=num, den=den)
    dropped(sets)
    return members, pairs


def similar_pairs(trees: DataFrame, **how) -> DataFrame:
    """``file_id_a, file_id_b`` (smaller first) of all different files of sufficient similarity, each once."""
    members, pairs = similar_classes(trees, **how)
    return expand(pairs, members, "file_id").select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))


def groups(trees: DataFrame, **how) -> DataFrame:
    """One row per file: ``file_id, class_id, group_id, links``.

    ``class_id`` is the smallest file with an equal set, ``group_id`` the smallest file that can be
    reached over links, ``links`` the number of other files that this one is similar to (its copies
    included). Files without a partner, and those too small to compare, are their own class and group
    with 0 links.
    """
    members, pairs = similar_classes(trees, **how)
    size = members.groupBy("rep").agg(F.count("*").alias("copies"))
    both = pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).union(pairs.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    links = both.join(shuffled(size.select(F.col("rep").alias("other"), "copies")), "other").groupBy("rep").agg(F.sum("copies").alias("links"))
    roots, _ = spanning_forest(pairs, "rep_a", "rep_b")
    heads = size.join(shuffled(links), "rep", "left").join(shuffled(roots.withColumnRenamed("node", "rep")), "rep", "left")
    heads = heads.select("rep", F.coalesce("root", "rep").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    placed = members.join(shuffled(heads), "rep").select("file_id", F.col("rep").alias("class_id"), "group_id", "links")
    own = F.col("file_id")
    every = trees.select("file_id").where("file_id is not null").distinct().join(shuffled(placed), "file_id", "left")
    return every.select("file_id", F.coalesce("class_id", own).alias("class_id"), F.coalesce("group_id", own).alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
