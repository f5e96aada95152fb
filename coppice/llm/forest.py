"""Connected components by Boruvka-style contraction, keeping the spanning forest.

Each round every component takes its lightest edge to another component, components hook along
those edges, and the edges that became internal are dropped. The number of components at least
halves in each round, so there are few rounds, each a constant number of shuffles plus the pointer
jumps of the hooks. All tables stay distributed; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.scratch import dropped, shuffled, written


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """Components and forest of an undirected graph.

    ``edges``: two columns of one type; loops, repeated edges, either direction and nulls (dropped)
    are allowed, further columns are ignored. Returns ``(labels, forest)``: ``labels(node, root)``
    with one row per node that has an edge to another node, ``root`` the smallest node of its
    component; and ``forest(a, b)``, the chosen edges, one fewer than nodes in every component.
    An empty graph gives two empty tables.
    """
    base = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    base = written(base.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    labels = written(base.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("root", F.col("node")))
    # u, v: the components that the edge x-y joins now; w: a random but total order of the edges
    live = base.select("x", "y", F.col("x").alias("u"), F.col("y").alias("v"), F.xxhash64("x", "y").alias("w"))
    forest = base.select("x", "y").limit(0)
    while not live.isEmpty():
        both = live.select("u", "v", "w", "x", "y").union(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "x", "y"))
        hooks = written(both.groupBy("u").agg(F.min(F.struct("w", "x", "y", "v")).alias("m")).select("u", F.col("m.v").alias("v"), F.col("m.x").alias("x"), F.col("m.y").alias("y")))
        forest = forest.union(hooks.select("x", "y").distinct())
        # two components that chose one another: the smaller is the root of the tree of hooks
        back = hooks.select(F.col("u").alias("v"), F.col("v").alias("u_back"))
        up = hooks.join(shuffled(back), "v").select("u", F.when((F.col("u_back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p"))
        up = at = written(up)
        while True:
            jump = up.join(shuffled(up.select(F.col("u").alias("p"), F.col("p").alias("pp"))), "p")
            nxt = written(jump.select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            dropped(at)
            up, at = nxt.select("u", "p"), nxt
            if nxt.where("moved").isEmpty():
                break
        named = written(labels.join(shuffled(up.withColumnRenamed("u", "root")), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        step = live.join(shuffled(up.select("u", F.col("p").alias("pu"))), "u").join(shuffled(up.select(F.col("u").alias("v"), F.col("p").alias("pv"))), "v")
        step = written(step.where("pu <> pv").select("x", "y", F.col("pu").alias("u"), F.col("pv").alias("v"), "w"))
        dropped(labels, live, at)
        labels, live = named, step
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    named = labels.join(shuffled(least), "root").select("node", F.col("least").alias("root"))
    return named, forest.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
