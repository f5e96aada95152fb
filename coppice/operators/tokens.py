"""Operators on token arrays, as expressions: filters, masks, runs, padding, indentation."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.uniform import uniform

# Ids that the vocabulary's order of declaration gives (0 to 14).
UNK, CLS, SEP, PAD, MASK, BPE, CR, TAB, VTAB, TWO_LINES, ONE_LINE = range(11)
EOS = SEP
SPACES = ((11, 8), (12, 4), (13, 2), (14, 1))


def newline_count(tokens: Column) -> Column:
    """Line breaks in a token array; the token of two counts twice."""
    return F.aggregate(tokens, F.lit(0), lambda a, t: a + F.when(t == ONE_LINE, 1).when(t == TWO_LINES, 2).otherwise(0))


def is_whitespace(tokens: Column) -> Column:
    """Whether all tokens are white space or other ids up to 14."""
    return F.forall(tokens, lambda t: t <= 14)


def lines_between(df: DataFrame, tokens: str = "data", least: int = 0, most: int | None = None) -> DataFrame:
    """Rows whose number of line breaks lies in a closed range; null arrays are dropped."""
    n = newline_count(F.col(tokens))
    return df.where((n >= least) if most is None else n.between(least, most))


def pair_length_filter(df: DataFrame, source: Column, target: Column, most_source: int, most_target: int, source_at_least_target: bool = False) -> DataFrame:
    """Pairs within both sizes, and, on demand, with a source at least as large as the target."""
    keep = (source <= most_source) & (target <= most_target)
    return df.where(keep & (source >= target) if source_at_least_target else keep)


def with_token(tokens: Column, token: Column, front: bool = True) -> Column:
    """The array with a token at one end; null where it stands there already."""
    there = F.element_at(tokens, 1 if front else -1)
    added = F.array_prepend(tokens, token) if front else F.array_append(tokens, token)
    return F.when((F.size(tokens) == 0) | (there != token), added)


def truncated(tokens: Column, most: int, reserve: int = 0) -> Column:
    """The first ``most - reserve`` tokens."""
    return F.slice(tokens, 1, max(0, most - reserve))


def truncated_pair(source: Column, target: Column, most: int, masks: Column) -> Column:
    """A struct of a cut source and the target's segments whose mask is still in it; null where masks
    were cut and none is left. Segments begin with their mask; one kept mask leaves the target whole."""
    cut = F.slice(source, 1, most)
    before, after = F.array_intersect(source, masks), F.array_intersect(cut, masks)
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, t: Column) -> Column:
        on = F.when(F.array_contains(masks, t), F.array_contains(after, t)).otherwise(a["on"])
        return F.struct(on.alias("on"), F.when(on, F.array_append(a["kept"], t)).otherwise(a["kept"]).alias("kept"))

    segments = F.aggregate(target, start, step)["kept"]
    lost = F.size(after) < F.size(before)
    new_target = F.when(~lost | (F.size(after) == 1), target).otherwise(segments)
    return F.when(~lost | (F.size(after) > 0), F.struct(cut.alias("source"), new_target.alias("target")))


def shifted(tokens: Column) -> Column:
    """The last token first, then the others: what a decoder is fed."""
    return F.when(F.size(tokens) > 0, F.concat(F.slice(tokens, -1, 1), F.slice(tokens, 1, F.size(tokens) - 1))).otherwise(tokens)


def padded(tokens: Column, length: Column, pad: int = PAD, left: bool = False) -> Column:
    """The array filled up to ``length``."""
    fill = F.array_repeat(F.lit(pad), F.greatest(length - F.size(tokens), F.lit(0)))
    return F.concat(fill, tokens) if left else F.concat(tokens, fill)


def left_padded_parents(parents: Column, length: Column) -> Column:
    """Parents of a tree that is filled up on the left: shifted by the padding, padding and root -1."""
    n = F.greatest(length - F.size(parents), F.lit(0))
    moved = F.transform(parents, lambda p: F.when(p < 0, p).otherwise(p + n))
    return F.concat(F.array_repeat(F.lit(-1), n), moved)


def attention(tokens: Column, length: Column) -> Column:
    """Which places of the padded array hold a token."""
    n = F.size(tokens)
    return F.when(length > 0, F.transform(F.sequence(F.lit(1), length), lambda i: i <= n)).otherwise(F.array().cast("array<boolean>"))


def collated(batched: DataFrame, batch: list[str], tokens: str, order: str, pad: int = PAD) -> DataFrame:
    """A row per batch: ``batch..., tokens, lengths, mask, ids, ntokens, nsamples``, padded to the
    longest sample, longest first, ties by ``order``; the ids are in the order of the rows."""
    rows = batched.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct((-F.size(tokens)).alias("neg"), F.col(order).alias("id"), F.col(tokens).alias("t")))).alias("r"))
    longest = F.array_max(F.transform("r", lambda x: F.size(x["t"])))
    return rows.withColumn("longest", longest).select(
        *batch,
        F.transform("r", lambda x: padded(x["t"], F.col("longest"), pad)).alias("tokens"), F.transform("r", lambda x: F.size(x["t"])).alias("lengths"),
        F.transform("r", lambda x: attention(x["t"], F.col("longest"))).alias("mask"), F.transform("r", lambda x: x["id"]).alias("ids"),
        F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + F.size(x["t"])).alias("ntokens"), F.size("r").alias("nsamples"),
    )


def indentation_tokens(spaces: Column) -> Column:
    """The fewest indenting tokens for a number of spaces, largest first; none for nothing or less."""
    left = F.greatest(spaces, F.lit(0)).cast("int")
    parts = []
    for token, width in SPACES:
        n = F.floor(left / width).cast("int")
        parts.append(F.array_repeat(F.lit(token), n))
        left = (left - n * width).cast("int")
    return F.concat(*parts)


def tab_tokens(tabs: Column) -> Column:
    return F.array_repeat(F.lit(TAB), F.greatest(tabs, F.lit(0)))


def dedented(code: Column, spaces: int) -> Column:
    """Every line without up to ``spaces`` leading blanks."""
    return F.regexp_replace(code, rf"(?m)^ {{1,{spaces}}}", "")


def let(value: Column, fn) -> Column:
    """``fn(value)``, where the value is computed once however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: the planner copies a costly expression into every
    filter and column that uses it, but not through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def array_runs(values: Column) -> Column:
    """``start, length, value`` of each run of equal neighbouring values of an array, nulls equal; places
    from 0. An empty array has no runs, null gives null."""

    def ends(v: Column) -> Column:
        at = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(at, lambda i: (i == 0) | ~F.get(v, i).eqNullSafe(F.get(v, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(i.alias("start"), (F.coalesce(F.get(s, k + 1), F.size(v)) - i).alias("length"), F.get(v, i).alias("value"))))

    return F.when(values.isNotNull(), let(values, ends))


def random_mask(tokens: Column, key: Column, p: float, seed: int, op: str = "mask_random", protected=None) -> Column:
    """For each token whether it is masked: with probability p, tokens for which ``protected`` holds never."""
    draw = lambda i: uniform(seed, op, key, i) < p
    return F.transform(tokens, lambda t, i: draw(i) if protected is None else draw(i) & ~protected(t))


def source_and_target(tokens: Column, masked: Column, masks: list[int] | range) -> Column:
    """A struct of source and target: each run of masked tokens becomes the next mask token in the source
    and, behind that token, a segment of the target. Null without a masked run; more runs than mask
    tokens are an error. The array is never taken apart into rows."""

    def mask(k: Column) -> Column:
        if isinstance(masks, range):  # consecutive ids need no table
            return (F.lit(masks.start) + k).cast("int")
        return F.element_at(F.array(*[F.lit(m) for m in masks]), (k + 1).cast("int"))

    def build(b: Column) -> Column:
        t, m, runs = b["t"], b["m"], b["r"]
        target = F.flatten(F.transform(runs, lambda r, k: F.concat(F.array(mask(k)), F.slice(t, r["start"] + 1, r["length"]))))
        place = let(F.transform(runs, lambda r: r["start"]), lambda s: F.transform(t, lambda x, i: F.when(~F.get(m, i), x).when((i == 0) | ~F.get(m, i - 1), mask(F.array_position(s, i) - 1))))
        return F.struct(F.filter(place, lambda x: x.isNotNull()).alias("source"), target.alias("target"))

    hidden = F.filter(array_runs(masked), lambda r: r["value"])
    bound = F.struct(tokens.alias("t"), masked.alias("m"), hidden.alias("r"))
    many = F.raise_error(F.lit("more masked runs than mask tokens")).cast("boolean")
    some = lambda b: F.when(F.size(b["r"]) > len(masks), many).otherwise(F.size(b["r"]) > 0)
    return let(bound, lambda b: F.when(some(b), build(b)))


def text_of(tokens: Column, words: Column) -> Column:
    """The texts of the tokens, joined; ``words`` an array of texts by id. Unknown ids are left out."""
    return F.array_join(F.transform(tokens, lambda t: F.get(words, t)), "")


def words_by_id(vocabulary: DataFrame) -> Column:
    """The texts of a vocabulary (``token_id, token``; a fixed table) as a constant array by id."""
    rows = vocabulary.where("token_id >= 0 and token is not null").collect()
    words: list[str | None] = [None] * (1 + max((r["token_id"] for r in rows), default=-1))
    for r in rows:
        words[r["token_id"]] = r["token"]
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def span_masked(tokens: Column, share: float, u: Column, mask: int) -> Column:
    """A struct of source and target: one window of ``share`` of the tokens, from a start that ``u``
    picks, gives way to the mask token. Null for windows of no token; a whole array loses one less."""
    n = F.size(tokens)
    k = F.floor(n * share + 0.5).cast("int")
    k = F.when(k >= n, n - 1).otherwise(k)
    at = F.floor(u * (n - k + 1)).cast("int")
    source = F.concat(F.slice(tokens, F.lit(1), at), F.array(F.lit(mask)), F.slice(tokens, at + k + 1, n))
    return F.when((n > 1) & (k > 0), F.struct(source.alias("source"), F.slice(tokens, at + 1, k).alias("target")))


def format_masks(text: Column, spaces: bool = True) -> Column:
    """Mask tokens in a readable form."""
    return F.regexp_replace(text, r"___MASK(\d*)___", " [MASK$1] " if spaces else "[MASK$1]")


# The languages that have a token.
LANGUAGE_TOKENS = ("C", "C-SHARP", "CPP", "CSS", "GO", "HASKELL", "JAVA", "JAVASCRIPT", "JULIA", "OCAML", "PHP", "PYTHON", "RUBY", "RUST", "SCALA", "TYPESCRIPT")
SPECIALS = r"(VAR\d+|FOLD\d+|___MASK\d*___|\[(?:SEP|PAD|" + "|".join(LANGUAGE_TOKENS) + r")\])"


def format_specials(text: Column) -> Column:
    """Special tokens set apart by spaces, masks in a readable form."""
    return format_masks(F.regexp_replace(text, SPECIALS, " $1 "))


def remove_specials(text: Column) -> Column:
    return F.regexp_replace(text, SPECIALS, "")


def dispatched(u: Column, shares: list[float], transforms: list[Column]) -> Column:
    """The result of the transform that ``u`` picks by normalised share; where it is null, of the next
    ones in turn."""
    total, upto, out = sum(shares), 0.0, None
    for k, share in enumerate(shares):
        upto += share / total
        turn = F.coalesce(*(transforms[k:] + transforms[:k]))
        out = F.when(u < upto, turn) if out is None else (out.when(u < upto, turn) if k + 1 < len(shares) else out.otherwise(turn))
    return out if len(shares) > 1 else transforms[0]


def modified(pair: Column, modify, *, source: bool = True, target: bool = True) -> Column:
    """A struct of source and target (sequences, or structs of trees) with ``modify`` applied to one side
    or both; null where a modified side is null, as a sample that a modifier drops."""
    s, t = (modify(pair["source"]) if source else pair["source"]), (modify(pair["target"]) if target else pair["target"])
    return F.when(s.isNotNull() & t.isNotNull(), F.struct(s.alias("source"), t.alias("target")))


def chain(df: DataFrame, *steps) -> DataFrame:
    """An ordered list of DataFrame transforms, applied one after the other."""
    return reduce(lambda d, f: d.transform(f), steps, df)
