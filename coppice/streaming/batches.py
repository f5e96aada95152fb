"""The bucketed batcher and accumulating searches over streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from coppice.operators.batching import bucket, fitting
from coppice.operators.ranking import ranked


def batched_stream(samples: DataFrame, key: str, size: str, ident: str, *, budget: int, longest: int, buckets: int, sizes: list[str] | None = None, idle_ms: int = 60_000) -> DataFrame:
    """``key, bucket, batch, cost, n, ids``: batches of a stream of samples, one row each.

    State per key and bucket: the open batch's longest size and ids, and the number of batches so far.
    A batch leaves when the next sample would take it over the budget; an open batch leaves after
    ``idle_ms`` without a sample, as a stream has no end. Samples of a trigger count in order of
    ``ident``. Sizes of 0 or null are dropped; a size above ``longest`` is an error and ends the stream.
    ``sizes``: of pairs, source and target; then the longer counts and ``bucket`` numbers a grid,
    the source's bucket times ``buckets`` plus the target's.
    """
    if budget < longest:
        raise ValueError("a batch must hold the longest sample")
    parts = sizes or [size]
    rows, place = samples, F.lit(0)
    for s in parts:
        rows, place = rows.where(F.col(s) > 0), place * buckets + bucket(fitting(s, longest), longest, buckets)
    most_of = F.greatest(*parts) if len(parts) > 1 else F.col(parts[0])
    rows = rows.select(F.col(key).alias("key"), place.cast("int").alias("bucket"), most_of.cast("int").alias("size"), F.col(ident).cast("long").alias("id"))

    def row(k: tuple, number: int, most: int, ids: list[int]) -> dict[str, Any]:
        return {"key": k[0], "bucket": k[1], "batch": number, "cost": most * len(ids), "n": len(ids), "ids": ids}

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, most, ids = state.get if state.exists else (0, 0, [])
        ids = list(ids)
        out = []
        if state.hasTimedOut:
            if ids:
                out.append(row(k, number, most, ids))
                number, most, ids = number + 1, 0, []
        else:
            data = pd.concat(list(frames)).sort_values("id")
            for s, i in zip(data["size"].tolist(), data["id"].tolist()):
                if ids and max(most, s) * (len(ids) + 1) > budget:
                    out.append(row(k, number, most, ids))
                    number, most, ids = number + 1, 0, []
                most = max(most, s)
                ids.append(i)
        state.update((number, most, ids))
        if ids:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key", "bucket").applyInPandasWithState(run, f"key {kind}, bucket int, batch int, cost long, n int, ids array<bigint>", "number int, most int, ids array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def endless(df: DataFrame, key: str, rows_per_second: int) -> DataFrame:
    """A stream that passes over a table again and again, in order of its unique ``key``: the table's
    columns and ``pass``, counted from 0. Null keys are left out."""
    places = ranked(df, key, "__place", first=0)
    n = max(1, places.count())
    ticks = df.sparkSession.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    ticks = ticks.select(F.pmod("value", F.lit(n)).cast("int").alias("__place"), F.floor(F.col("value") / n).alias("pass"))
    return ticks.join(df.join(places, key), "__place").drop("__place")


class Accumulator:
    """Collects a stream's rows in a table until a number is reached; for ``foreachBatch``.

    The last batch is taken whole, so the number may be exceeded; ``reset`` starts anew."""

    def __init__(self, path: str, most: int):
        self.path, self.most, self.held, self.part = path, most, 0, 0

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if self.held >= self.most:
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/part={self.part}/epoch={epoch}")
        self.held += batch.sparkSession.read.parquet(f"{self.path}/part={self.part}/epoch={epoch}").count()

    def table(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/part={self.part}")

    def reset(self) -> None:
        self.held, self.part = 0, self.part + 1
