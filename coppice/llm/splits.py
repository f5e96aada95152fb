"""Splits that keep related records together.

Records are related through an entity: the repository of a file, the label of a program, the
problem of a snippet. The written forms of an entity are brought to one key; keys linked by a fork,
mirror or rename join through a spanning forest. The components are then dealt to the splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.functions.scratch import shuffled, written
from coppice.llm.forest import spanning_forest

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Relations of two repositories that carry the same content (fixed values of the data).
SAME_CONTENT = ("fork", "mirror", "rename")
#: Components a bucket of a band's random order aims at; ranks are counted per bucket, so no band is one task.
PER_BUCKET = 50_000

#: White space of any kind, with byte-order marks and zero-width spaces.
_BLANK = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"


def repository_key(c: Column) -> Column:
    """``owner/name`` in lower case, whatever the case, padding or address form (web address, scp-like
    or ssh address, trailing slashes, ``.git``, query or fragment). Null for null and blank."""
    t = F.lower(F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", ""))
    t = F.regexp_replace(t, r"[?#].*$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"/+$", ""), r"(\.git)?/*$", "")
    two = F.regexp_extract(t, r"([^/:@\s]+)\s*/+\s*([^/:\s]+)$", 0)
    t = F.when(two != "", F.regexp_replace(two, r"\s*/+\s*", "/")).otherwise(t)
    return F.when(t == "", None).otherwise(t)


def label_key(c: Column) -> Column:
    """The number that a label writes: blanks, sign, leading zeros and zero decimals do not matter.
    A label without a number keeps its own text, in lower case; null and blank give null."""
    t = F.lower(F.regexp_replace(c, rf"{_BLANK}+", ""))
    number = F.regexp_extract(t, r"^[^0-9+\-]*([+-]?)0*([0-9]+)(?:[.,]0*)?$", 2)
    sign = F.regexp_extract(t, r"^[^0-9+\-]*([+-]?)0*([0-9]+)(?:[.,]0*)?$", 1)
    decimal = F.regexp_extract(t, r"^[^0-9+\-]*[+-]?0*([0-9]+[.,][0-9]*[1-9])0*$", 1)
    key = F.when(number != "", F.concat(F.when((sign == "-") & (number != "0"), "-").otherwise(""), number))
    key = key.when(decimal != "", F.concat(F.when(F.regexp_extract(t, r"^[^0-9+\-]*([+-]?)", 1) == "-", "-").otherwise(""), F.translate(decimal, ",", ".")))
    return F.when(t == "", None).otherwise(key.otherwise(t))


def problem_key(c: Column) -> Column:
    """The words of a problem's name in order; case, separators, joined-up capitals and padding do
    not matter. Null for null and for names without a word."""
    t = F.regexp_replace(c, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2")
    t = F.regexp_replace(t, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    t = F.trim(F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")))
    return F.when(t == "", None).otherwise(t)


KEYS = {"repository": repository_key, "label": label_key, "problem": problem_key}


def raw_values(df: DataFrame, kind: str, column: str) -> DataFrame:
    """The distinct non-null raw values of a column with their entity key and their row count."""
    raw = df.select(F.col(column).alias("raw")).where("raw is not null").groupBy("raw").agg(F.count("*").alias("n"))
    return raw.select(F.lit(kind).alias("kind"), "raw", F.coalesce(KEYS[kind](F.col("raw")), F.col("raw")).alias("key"), "n")


def link_edges(links: DataFrame) -> DataFrame:
    """The entity keys that ``repository_links`` joins: relations of same content only, however the
    relation is cased or padded; rows with a null end join nothing."""
    kept = links.where(F.lower(F.trim("relation")).isin(*SAME_CONTENT))
    return kept.select(repository_key(F.col("repository")).alias("a"), repository_key(F.col("linked_repository")).alias("b"))


def entities(values: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(values with the root of their entity, spanning forest of the linked keys)``.

    A key without links is its own root. The forest is persisted in the shared folder."""
    labels, forest = spanning_forest(link_edges(links))
    labels = labels.select(F.lit("repository").alias("kind"), F.col("node").alias("key"), "root")
    joined = values.join(labels, ["kind", "key"], "left")
    return joined.withColumn("root", F.coalesce("root", "key")), written(forest)


def related_pairs(values: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of different raw values that must share a split: ``kind, key_a, key_b``, key_a < key_b
    by code point. Values are distinct per kind, so a pair occurs once."""
    rooted, _ = entities(values, links)
    rooted = written(rooted.select("kind", "root", "raw"))
    left, right = rooted.withColumnRenamed("raw", "key_a"), rooted.withColumnRenamed("raw", "key_b")
    return left.join(right, ["kind", "root"]).where("key_a < key_b").select("kind", "key_a", "key_b")


def deal(roots: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """Deal components to splits: ``roots(kind, root, n)`` gains ``band`` and ``split``.

    A band holds the components of a size between two powers of two. Bands are served from the
    largest size down; each band's components are shared out so that the rows of every split come as
    near as possible to its proportion of all rows served so far, so smaller bands make up for the
    coarse steps of larger ones. Within a band, components in random order go to the splits
    systematically: evenly spaced, not in runs. Only counts per band come to the driver (at most 64 a
    kind); a band has as many buckets as its components need, and their first ranks are sums over
    the buckets.
    """
    spark = roots.sparkSession
    keyed = roots.select("kind", "root", "n", F.floor(F.log2("n")).cast("int").alias("band"), F.xxhash64("root", F.lit(29)).alias("h"))
    plan = []
    served: dict[str, list[float]] = {}
    bands = keyed.groupBy("kind", "band").agg(F.count("*").alias("m"), F.sum("n").alias("rows")).collect()
    for kind, band, at, rows in sorted(bands, key=lambda x: (x["kind"], -x["band"])):
        have = served.setdefault(kind, [0.0] * len(splits))
        total = sum(have) + rows
        need = [max(0.0, p * total - got) for (_, p), got in zip(splits, have)]
        scale = sum(need) or 1.0
        share = [at * x / scale for x in need]
        give = [int(x) for x in share]
        for k in sorted(range(len(splits)), key=lambda k: (give[k] - share[k], k))[: at - sum(give)]:
            give[k] += 1
        served[kind] = [got + g * rows / max(at, 1) for got, g in zip(have, give)]
        plan.append((kind, band, at, give))
    names = [s for s, _ in splits]
    plan_df = spark.createDataFrame(plan, "kind string, band int, of long, give array<long>")
    keyed = keyed.join(F.broadcast(plan_df), ["kind", "band"]).withColumn("bucket", F.pmod("h", F.ceil(F.col("of") / PER_BUCKET).cast("long")))
    sums = keyed.groupBy("kind", "band", "bucket").agg(F.count("*").alias("m"))
    starts = sums.select("kind", "band", "bucket", (F.sum("m").over(W.partitionBy("kind", "band").orderBy("bucket")) - F.col("m")).alias("start"))
    ranked = keyed.withColumn("r", F.row_number().over(W.partitionBy("kind", "band", "bucket").orderBy("h", "root")))
    ranked = ranked.join(starts, ["kind", "band", "bucket"])
    rank = F.col("start") + F.col("r") - 1
    # the component of rank r goes to the last split whose evenly spaced places include r
    split = F.lit(names[0])
    left_of, left_rank = F.col("of"), rank
    choose = []
    for k in range(len(splits) - 1, 0, -1):
        g = F.col("give")[k]
        hit = F.floor((left_rank + 1) * g / left_of) > F.floor(left_rank * g / left_of)
        choose.append((k, F.coalesce(hit, F.lit(False))))
        left_rank, left_of = left_rank - F.floor(left_rank * g / F.when(left_of > 0, left_of)), left_of - g
    split = reduce(lambda rest, kh: F.when(kh[1], names[kh[0]]).otherwise(rest), reversed(choose), F.lit(names[0]))
    return ranked.withColumn("split", split).select("kind", "root", "n", "band", "split")


def assign(records: DataFrame, values: DataFrame, links: DataFrame, splits=SPLITS) -> DataFrame:
    """The split of every record, each table by its own entity.

    ``records(kind, record, raw)``: the record's table kind, its key (text) and the raw entity value.
    Redelivered records (same kind and key) count once and share a split; the smallest raw value
    stands for a record delivered with several. A record without a value is alone with itself.
    Returns ``kind, record, root, split`` with one row per record. Entities of different kinds are not
    tied to one another; :func:`assign_across` does that.
    """
    one = records.groupBy("kind", "record").agg(F.min("raw").alias("raw"))
    rooted, _ = entities(values, links)
    rooted = rooted.select("kind", "raw", "root")
    placed = one.join(rooted, ["kind", "raw"], "left")
    placed = written(placed.select("kind", "record", F.coalesce(F.concat(F.lit("="), "root"), F.concat(F.lit("#"), "record")).alias("root")))
    dealt = deal(placed.groupBy("kind", "root").agg(F.count("*").alias("n")), splits)
    return placed.join(dealt.select("kind", "root", "split"), ["kind", "root"]).select("kind", "record", "root", "split")


def node_of(kind: str, column: str) -> Column:
    """The entity that a raw value names, as a node that is unlike the nodes of other kinds; null for null."""
    raw = F.col(column)
    return F.concat(F.lit(f"{kind}="), F.coalesce(KEYS[kind](raw), raw))


def assign_across(records: DataFrame, links: DataFrame, splits=SPLITS) -> DataFrame:
    """The split of every record, where all entities of a record stay together, of whatever kind.

    ``records(kind, record, nodes)``: ``nodes`` an array of :func:`node_of`. All nodes of a record are
    joined, so a label ties together all the repositories of its programs, and the proportions hold
    only as far as the components allow: one that holds most records goes whole to one split. Nulls
    among the nodes are no entities; a record without a node is alone; redelivered records join the
    nodes of all deliveries. Returns ``kind, record, root, split``, one row per record.
    """
    nodes = records.select("kind", "record", F.explode("nodes").alias("node")).where("node is not null").distinct()
    first = nodes.groupBy("kind", "record").agg(F.min("node").alias("first"))
    ties = nodes.join(shuffled(first), ["kind", "record"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    same = link_edges(links).select(F.concat(F.lit("repository="), "a").alias("a"), F.concat(F.lit("repository="), "b").alias("b"))
    labels, _ = spanning_forest(ties.union(same))
    every = records.select("kind", "record").distinct().join(shuffled(first), ["kind", "record"], "left")
    placed = every.join(shuffled(labels.withColumnRenamed("node", "first")), "first", "left")
    placed = written(placed.select("kind", "record", F.coalesce("root", "first", F.concat_ws("#", "kind", "record")).alias("root")))
    dealt = deal(placed.groupBy("root").agg(F.count("*").alias("n")).select(F.lit("all").alias("kind"), "root", "n"), splits)
    return placed.join(shuffled(dealt.select("root", "split")), "root").select("kind", "record", "root", "split")


def crossings(assigned: DataFrame, records: DataFrame, links: DataFrame) -> DataFrame:
    """Per kind of entity: the entities of all records, and those whose records are in several splits.

    ``assigned(kind, record, split)``; ``records(kind, record, nodes)`` as for :func:`assign_across`, so
    that every entity column of a record counts. Linked repositories are one entity.
    """
    labels, _ = spanning_forest(link_edges(links))
    labels = labels.select(F.concat(F.lit("repository="), "node").alias("node"), F.concat(F.lit("repository="), "root").alias("root"))
    nodes = records.select("kind", "record", F.explode("nodes").alias("node")).where("node is not null").distinct()
    rooted = nodes.join(shuffled(labels), "node", "left").select("kind", "record", F.coalesce("root", "node").alias("entity"))
    met = rooted.join(shuffled(assigned.select("kind", "record", "split")), ["kind", "record"])
    per = met.groupBy("entity").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    per = per.groupBy(F.substring_index("entity", "=", 1).alias("entity_kind"))
    return per.agg(F.count("*").alias("entities"), F.count_if(F.col("lo") != F.col("hi")).alias("in_several_splits"))
