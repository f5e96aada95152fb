"""Pseudorandom numbers from hashes: the same for the same row wherever and however often it is computed."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, op: str, *key: Column) -> Column:
    """A number in [0, 1) of 48 random bits, from the MD5 of seed, operation and key."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(op), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def uniform_sql(seed: int, op: str, *key: str) -> str:
    """The same in DuckDB's SQL."""
    text = ", ".join(f"({k})::VARCHAR" for k in key)
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{op}', {text})), 1, 12))::BIGINT / {float(1 << 48)!r}::DOUBLE)"


def generator(seed: int, op: str, *key) -> np.random.Generator:
    """A NumPy generator for one row, from the same kind of key."""
    digest = hashlib.md5("|".join(map(str, (seed, op, *key))).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "big"))


def truncated_normal(u: float, mean: float, sd: float, low: float, high: float) -> float:
    """The quantile u of a normal distribution cut to [low, high]."""
    d = NormalDist(mean, sd)
    a, b = d.cdf(low), d.cdf(high)
    p = min(max(a + u * (b - a), 1e-12), 1 - 1e-12)
    return min(max(d.inv_cdf(p), low), high)


def central_bounds(mean: float, share: float = 0.75) -> tuple[int, int]:
    """The whole numbers around the central share of a normal distribution with mean = variance, at least 1."""
    d = NormalDist(mean, math.sqrt(mean))
    return max(1, math.floor(d.inv_cdf(0.5 - share / 2))), max(1, math.ceil(d.inv_cdf(0.5 + share / 2)))
