"""Pipelines from settings: a source, an ordered list of steps and a batcher for each split."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from coppice.operators.tokens import chain


def load_config(path: str) -> dict:
    """Settings from a JSON or TOML file, by its extension."""
    text = Path(path).read_text(encoding="utf-8")
    return tomllib.loads(text) if path.endswith(".toml") else json.loads(text)


@dataclass
class Pipeline:
    """``sources``: by split, a function of the session that gives a table. ``steps``: applied to every
    split in order, each a function of a table; ``own``: further steps of one split, before the batcher.
    A split that is not among the sources is an error."""

    sources: dict[str, Callable[[SparkSession], DataFrame]]
    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    own: dict[str, list[Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)
    batcher: Callable[[DataFrame], DataFrame] | None = None

    def samples(self, spark: SparkSession, split: str) -> DataFrame:
        """The split after all steps, unbatched."""
        if split not in self.sources:
            raise KeyError(f"no source for {split!r}")
        return chain(self.sources[split](spark), *self.steps, *self.own.get(split, []))

    def batches(self, spark: SparkSession, split: str) -> DataFrame:
        rows = self.samples(spark, split)
        return rows if self.batcher is None else self.batcher(rows)
