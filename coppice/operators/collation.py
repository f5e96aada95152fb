"""Batches as padded matrices: trees, pairs of sequences, and pairs with a matrix for each sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.operators.tokens import EOS, PAD, attention, left_padded_parents, padded, shifted


def width(sizes: Column, multiple: int = 1, least: int = 0) -> Column:
    """The common length of arrays of the given sizes: the longest, at least ``least``, rounded up to a multiple."""
    longest = F.greatest(F.coalesce(F.array_max(sizes), F.lit(0)), F.lit(least))
    return (F.ceil(longest / multiple) * multiple).cast("int")


def padded_matrix(matrix: Column, rows: Column, columns: Column, pad) -> Column:
    """An array of arrays filled up to ``rows`` times ``columns``."""
    fill = lambda n: F.array_repeat(F.lit(pad), F.greatest(n, F.lit(0)))
    wide = F.transform(matrix, lambda r: F.concat(r, fill(columns - F.size(r))))
    return F.concat(wide, F.array_repeat(fill(columns), F.greatest(rows - F.size(matrix), F.lit(0))))


def _gathered(batched: DataFrame, batch: list[str], order: list[Column], values: dict[str, str]) -> DataFrame:
    """A row per batch with its samples in order, as structs of ``values``."""
    ranks = [c.alias(f"__o{k}") for k, c in enumerate(order)]
    return batched.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct(*ranks, *[F.col(c).alias(n) for n, c in values.items()]))).alias("r"))


def collated_trees(batched: DataFrame, batch: list[str], key: str, *, left: bool = False, pad: int = -1, multiple: int = 1) -> DataFrame:
    """A row per batch of trees (``key, tokens, parents, descendants``), in order of ``key``.

    ``tokens`` are padded with ``pad``. ``parents`` are padded with -1 and, where padding stands on the
    left, moved by it. ``descendants`` are counted one higher and padded with 0; ``labels``, the
    descendants as they are, padded with -1. A batch has at least one tree.
    """
    rows = _gathered(batched, batch, [F.col(key)], {"id": key, "t": "tokens", "p": "parents", "d": "descendants"})
    rows = rows.withColumn("width", width(F.transform("r", lambda x: F.size(x["t"])), multiple))
    side = lambda f, p: F.transform("r", lambda x: padded(f(x), F.col("width"), p, left))
    parents = F.transform("r", lambda x: left_padded_parents(x["p"], F.col("width"))) if left else side(lambda x: x["p"], -1)
    return rows.select(
        *batch, "width", F.transform("r", lambda x: x["id"]).alias("ids"), side(lambda x: x["t"], pad).alias("tokens"), parents.alias("parents"),
        side(lambda x: F.transform(x["d"], lambda d: d + 1), 0).alias("descendants"), side(lambda x: x["d"], -1).alias("labels"),
    )


def _side(name: str, left: bool, pad: int) -> list[Column]:
    lengths = F.transform("r", lambda x: F.size(x[name]))
    w = width(lengths)
    tokens = F.transform("r", lambda x: padded(x[name], w, pad, left))
    mask = F.transform("r", lambda x: F.reverse(attention(x[name], w)) if left else attention(x[name], w))
    total = F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + F.size(x[name]))
    return [tokens.alias(f"{name}_tokens"), lengths.alias(f"{name}_lengths"), mask.alias(f"{name}_mask"), total.alias(f"{name}_ntokens")]


def _squares(name: str, fill) -> Column:
    n = width(F.transform("r", lambda x: F.size(x[name])))
    return F.transform("r", lambda x: padded_matrix(x[name], n, n, fill)).alias(name)


def collated_pairs(
    batched: DataFrame, batch: list[str], order: str, *, source: str = "source", target: str = "target", left_source: bool = False, left_target: bool = False, feed: bool = True, pad: int = PAD, eos: int = EOS,
    matrices: dict[str, object] | None = None,
) -> DataFrame:
    """A row per batch of pairs of token arrays, the longest source first, ties by ``order`` (unique).

    For each side the padded tokens, lengths, mask of the places that hold a token, and their number;
    ``ids``; and with ``feed`` the targets with their last token first, which must be ``eos`` (anything
    else is an error), in the same order as all else. ``matrices``: further columns, square matrices of
    a sample (array of arrays), with what they are padded with; each becomes a column of that name.
    """
    more = matrices or {}
    rows = _gathered(batched, batch, [-F.size(source), F.col(order)], {"id": order, "source": source, "target": target, **{m: m for m in more}})
    out = [*_side("source", left_source, pad), *_side("target", left_target, pad)]
    if feed:
        w = width(F.transform("r", lambda x: F.size(x["target"])))
        ended = lambda t: F.when(F.element_at(t, -1) == eos, shifted(t)).otherwise(F.raise_error(F.lit("a target does not end with the end token")).cast("array<int>"))
        out.append(F.transform("r", lambda x: padded(ended(x["target"]), w, pad, left_target)).alias("shifted_tokens"))
    out += [_squares(name, fill) for name, fill in more.items()]
    return rows.select(*batch, F.transform("r", lambda x: x["id"]).alias("ids"), F.size("r").alias("nsamples"), *out)
