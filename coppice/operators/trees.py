"""Trees in DataFrames: array form (a row per tree) and node form (a row per node)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from coppice.operators import tree_arrays as ta


def newest(df: DataFrame, key: str, time: str) -> DataFrame:
    """One row per key: of redelivered rows the one with the greatest time. Null keys are left out."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(time)).alias("v")).select(key, "v.*")


def tree_map(df: DataFrame, keep: list[str], arrays: list[str], fn: Callable[..., list[tuple]], fields: str, *, errors: str | None = None) -> DataFrame:
    """Apply ``fn(*arrays of a row) -> rows`` to every row, over Arrow batches.

    ``keep`` columns are repeated before the new ``fields`` (a DDL string). Null arrays arrive as None;
    a :class:`~coppice.operators.tree_arrays.TreeError` gives no row. With ``errors``, the name of a
    further text column, no error passes unseen: any exception gives one row that holds its message
    there and nulls in the new fields; all other rows have a null there.
    """
    new = T._parse_datatype_string(f"{fields}, {errors} string" if errors else fields)
    schema = T.StructType([df.schema[k] for k in keep] + new.fields)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def failed(error: Exception) -> list[tuple]:
        return [(*[None] * (len(kinds) - 1), str(error))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = [part.column(len(keep) + k) for k in range(len(arrays))]
                owner: list[int] = []
                out: list[list] = [[] for _ in kinds]
                for i in range(part.num_rows):
                    values = [None if not c[i].is_valid else (np.asarray(c[i].values) if isinstance(c.type, pa.ListType) and pa.types.is_integer(c.type.value_type) and not c[i].values.null_count else c[i].as_py()) for c in cols]
                    try:
                        rows = fn(*values)
                    except ta.TreeError as error:
                        if errors is None:
                            continue
                        rows = failed(error)
                    except Exception as error:  # noqa: BLE001 - kept as a row
                        if errors is None:
                            raise
                        rows = failed(error)
                    else:
                        rows = rows if errors is None else [(*r, None) for r in rows]
                    for r in rows:
                        owner.append(i)
                        for o, v in zip(out, r):
                            o.append(v)
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in range(len(keep))), *(pa.array(o, k) for o, k in zip(out, kinds))], names=schema.names)

    return df.select(*keep, *arrays).mapInArrow(run, schema)


def structured(df: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, parents, descendants, levels, tokens``: both structure arrays of every tree, the missing
    one derived from the other. Rows without tokens or without any structure are left out."""

    def build(parents, descendants, tokens):
        if tokens is None or (parents is None and descendants is None):
            return []
        p = ta.parents_of(descendants) if parents is None or len(parents) != len(tokens) else ta.as_ints(parents)
        levels = ta.levels_of(p)
        return [(p.tolist(), ta.descendants_of_levels(levels).tolist(), levels.tolist(), [None if t is None else int(t) for t in tokens])]

    return tree_map(df, [key], ["parents", "descendants", "tokens"], build, "parents array<int>, descendants array<int>, levels array<int>, tokens array<int>")


def nodes(trees: DataFrame, key: str = "file_id") -> DataFrame:
    """Node form: ``key, idx, parent, descendants, level, token``, indices from 0."""
    zipped = F.arrays_zip(F.col("parents").alias("parent"), "descendants", F.col("levels").alias("level"), F.col("tokens").alias("token"))
    return trees.select(key, F.posexplode(zipped).alias("idx", "n")).select(key, "idx", "n.parent", "n.descendants", "n.level", "n.token")


def array_form(node_rows: DataFrame, key: str = "file_id") -> DataFrame:
    """The inverse of :func:`nodes`."""
    packed = node_rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "parent", "descendants", "level", "token"))).alias("n"))
    return packed.select(key, F.col("n.parent").alias("parents"), F.col("n.descendants").alias("descendants"), F.col("n.level").alias("levels"), F.col("n.token").alias("tokens"))


def leaf_tokens(tokens: Column, descendants: Column) -> Column:
    """The tokens of the leaves, in order."""
    both = F.arrays_zip(tokens.alias("t"), descendants.alias("d"))
    return F.transform(F.filter(both, lambda x: x["d"] == 0), lambda x: x["t"])


def leaf_count(descendants: Column) -> Column:
    """The size of a code tree: its number of leaves."""
    return F.aggregate(descendants, F.lit(0), lambda a, d: a + F.when(d == 0, 1).otherwise(0))


def closure(trees: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, ancestor, idx``: every node with each node on its path from the root, itself included."""

    def build(parents):
        # a node's path is its parent's and the node itself: one array copy a node, no walk
        up: list[np.ndarray] = []
        for i, p in enumerate(np.asarray(parents).tolist()):
            up.append(np.append(up[p], i) if p >= 0 else np.array([i]))
        return list(zip(np.concatenate(up).tolist(), np.repeat(np.arange(len(up)), [len(x) for x in up]).tolist())) if up else []

    return tree_map(trees, [key], ["parents"], build, "ancestor int, idx int")


def paths(parents) -> list[str]:
    """The path from the root to each node as text."""
    out: list[str] = []
    for i, p in enumerate(np.asarray(parents).tolist()):
        out.append(f"{out[p]},{i}" if p >= 0 else str(i))
    return out


def heights(trees: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, idx, height``."""
    return tree_map(trees, [key], ["parents"], lambda p: list(enumerate(ta.heights_of(p).tolist())), "idx int, height int")


def siblings(node_rows: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, idx, ordinal, left_sibling, right_sibling, n_siblings`` of every node but the root."""
    order = W.partitionBy(key, "parent").orderBy("idx")
    return node_rows.where("parent >= 0").select(
        key, "idx", (F.row_number().over(order) - 1).alias("ordinal"), F.lag("idx").over(order).alias("left_sibling"), F.lead("idx").over(order).alias("right_sibling"),
        (F.count("*").over(W.partitionBy(key, "parent")) - 1).alias("n_siblings"),
    )


def leaf_distances(trees: DataFrame, key: str = "file_id") -> DataFrame:
    """For every two neighbouring leaves: ``left_leaf, right_leaf, lca, up, down, distance``."""

    def build(parents, descendants, levels):
        leaves = np.flatnonzero(np.asarray(descendants) == 0).tolist()
        out = []
        for a, b in zip(leaves, leaves[1:]):
            c = ta.lowest_common_ancestor(parents, a, b)
            up, down = int(levels[a] - levels[c]), int(levels[b] - levels[c])
            out.append((a, b, int(c), up, down, up + down))
        return out

    return tree_map(trees, [key], ["parents", "descendants", "levels"], build, "left_leaf int, right_leaf int, lca int, up int, down int, distance int")


def pair_sums(trees: DataFrame, key: str = "file_id") -> DataFrame:
    """For every node, over its pairs with all nodes of its tree: ``idx, nodes, lca, up, down, distance``,
    the sums of the lowest common ancestors, of the steps up and down, and of the distances."""

    def build(parents, descendants, levels):
        # from a parent to its child, the common ancestors with the child's own branch move down to the child
        n = len(parents)
        size, lca, shared = (np.asarray(descendants) + 1).tolist(), [0] * n, [0] * n
        for i, p in enumerate(np.asarray(parents).tolist()):
            if p >= 0:
                lca[i], shared[i] = lca[p] + (i - p) * size[i], shared[p] + size[i]
        depth, deep = np.asarray(levels).tolist(), int(np.sum(levels))
        return [(i, n, lca[i], depth[i] * n - shared[i], deep - shared[i], depth[i] * n + deep - 2 * shared[i]) for i in range(n)]

    return tree_map(trees, [key], ["parents", "descendants", "levels"], build, "idx int, nodes int, lca long, up long, down long, distance long")


def steps(node_rows: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, idx, next_branch, step_out``: the first node after a node's branch and after its parent's
    branch; null past the end."""
    n = F.count("*").over(W.partitionBy(key))
    after = F.col("idx") + F.col("descendants") + 1
    here = node_rows.select(key, "idx", "parent", F.when(after < n, after).alias("next_branch"))
    up = here.select(key, F.col("idx").alias("parent"), F.col("next_branch").alias("step_out"))
    return here.join(up, [key, "parent"], "left").select(key, "idx", "next_branch", "step_out")


def sibling_ngrams(node_rows: DataFrame, least: int = 2, most: int = 6, key: str = "file_id") -> DataFrame:
    """``key, start, stop, n``: every run of ``least`` to ``most`` adjacent siblings as a node interval."""
    order = W.partitionBy(key, "parent").orderBy("idx")
    ends = F.col("idx") + F.col("descendants") + 1
    parts = None
    for n in range(least, most + 1):
        one = node_rows.where("parent >= 0").select(key, F.col("idx").alias("start"), F.lead(ends, n - 1).over(order).alias("stop"), F.lit(n).alias("n")).where("stop is not null")
        parts = one if parts is None else parts.union(one)
    return parts


def drawings(trees: DataFrame, labels: DataFrame, most: int | None = None, style: str = "continued", key: str = "file_id") -> DataFrame:
    """``key, drawing``: each tree as text, whole or up to ``most`` nodes. ``labels(token_id, token)`` is a
    vocabulary of fixed size."""
    names = {r[0]: r[1] for r in labels.select("token_id", "token").collect()}
    return tree_map(trees, [key], ["parents", "tokens"], lambda p, t: [(ta.render(p, [names.get(int(x), str(x)) for x in t], most, style),)], "drawing string")


TREE = "parents array<int>, descendants array<int>, tokens array<int>"


def _out(t: ta.Tree) -> tuple:
    return t.parents.tolist(), t.descendants.tolist(), [None if x is None else int(x) for x in t.columns[0]]


def edited(trees: DataFrame, edit: Callable[[ta.Tree], ta.Tree | None], key: str = "file_id") -> DataFrame:
    """Apply an edit to every tree; where it gives None or does not apply, there is no row."""

    def build(parents, tokens):
        t = edit(ta.Tree(parents, tokens))
        return [] if t is None else [_out(t)]

    return tree_map(trees, [key], ["parents", "tokens"], build, TREE)


def branches_as_leaves(node_rows: DataFrame, chosen: DataFrame, key: str = "file_id") -> DataFrame:
    """Leaves in order after replacing disjoint branches: ``key, position, token, removed``.

    ``chosen(key, node, replacement)``. A replaced branch is one row with its replacement and, in
    ``removed``, the leaves it had; other leaves have a null there. Relational form, no Python.
    """
    picks = node_rows.join(chosen.withColumnRenamed("node", "idx"), [key, "idx"]).select(key, F.col("idx").alias("lo"), (F.col("idx") + F.col("descendants")).alias("hi"), "replacement")
    leaves = node_rows.where("descendants = 0").select(key, "idx", "token")
    hit = leaves.join(picks, (leaves[key] == picks[key]) & F.col("idx").between(F.col("lo"), F.col("hi")), "left").select(leaves[key], "idx", "token", "lo", "replacement")
    kept = hit.groupBy(key, F.coalesce("lo", "idx").alias("at")).agg(
        F.first("replacement").alias("replacement"), F.max("lo").alias("lo"), F.min("token").alias("own"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))), lambda x: x["token"]).alias("all")
    )
    position = F.row_number().over(W.partitionBy(key).orderBy("at")) - 1
    return kept.select(key, position.alias("position"), F.when(F.col("lo").isNull(), F.col("own")).otherwise(F.col("replacement")).alias("token"), F.when(F.col("lo").isNotNull(), F.col("all")).alias("removed"))
