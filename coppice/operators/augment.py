"""Random changes to trees: folding, span and subtree masking. One tree at a time, seeded per row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from coppice.functions.uniform import central_bounds, truncated_normal
from coppice.operators import tree_arrays as ta


@dataclass(frozen=True)
class FoldConfig:
    """Sizes are in leaves: of a whole tree, of a folded branch at most and at least."""

    max_tree: int = 800
    max_subtree: int = 800
    min_subtree: int = 150
    fold_smaller_share: float = 0.0
    distinct: bool = False


def leaf_counts(parents) -> np.ndarray:
    """Leaves below each node; 1 for a leaf."""
    p = ta.as_ints(parents)
    out = (ta.descendants_of(p) == 0).astype(np.int64)
    for i in range(len(p) - 1, 0, -1):
        out[p[i]] += out[i]
    return out


def fold_places(t: ta.Tree, most_tree: int, most: int, least: int, rng: np.random.Generator, blocked=()) -> list[int]:
    """Disjoint branches of ``least`` to ``most`` leaves, drawn with weight by size, until what is left
    has at most ``most_tree`` leaves. A branch that holds an earlier one takes its place."""
    d, leaves = t.descendants, leaf_counts(t.parents)
    can = np.array([i for i in range(1, len(t)) if least <= leaves[i] <= most and d[i] > 0 and i not in set(blocked)], np.int64)
    chosen: list[int] = []
    left = int(leaves[0])
    if not len(can):
        return chosen
    for i in rng.choice(can, size=len(can), p=d[can] / d[can].sum()).tolist():
        if left <= most_tree:
            break
        if any(j <= i <= j + d[j] for j in chosen):
            continue
        inside = [j for j in chosen if i < j <= i + d[i]]
        chosen = [j for j in chosen if j not in inside] + [i]
        left += sum(int(leaves[j]) - 1 for j in inside) - int(leaves[i]) + 1
    return sorted(chosen)


def group_adjacent(t: ta.Tree, nodes: list[int], blank=lambda leaves: all(x <= 14 for x in leaves)) -> list[list[int]]:
    """Runs of chosen siblings that follow one another, bridging branches of white space only."""
    out: list[list[int]] = []
    for n in nodes:
        if out:
            last = out[-1][-1]
            between = [k for k in ta.children_of(t.parents, int(t.parents[n])).tolist() if last < k < n] if t.parents[last] == t.parents[n] else None
            if between is not None and all(blank(t.subtree(k).leaves()) for k in between):
                out[-1] += [*between, n]
                continue
        out.append([n])
    return out


def fold(t: ta.Tree, folds: list[int], rng: np.random.Generator, cfg: FoldConfig = FoldConfig()) -> list[ta.Tree]:
    """A tree that is small enough, itself; a larger one folded, and every part that was folded away."""
    size = int(leaf_counts(t.parents)[0])
    out: list[ta.Tree] = []
    if size <= cfg.max_tree:
        out.append(t)
        if rng.random() >= cfg.fold_smaller_share or cfg.min_subtree >= size:
            return out
        cfg = FoldConfig(int(0.7 * size), int(0.7 * size), min(cfg.min_subtree, int(0.2 * size)), 0.0, cfg.distinct)
    groups = group_adjacent(t, fold_places(t, cfg.max_tree, cfg.max_subtree, cfg.min_subtree, rng))
    if not groups:
        return out
    token = lambda k: folds[k % len(folds)] if cfg.distinct else folds[0]
    edits, parts, at = [], [], 0
    for k, g in enumerate(groups):
        edits.append((g[0], t.branch(g[-1]).stop, [(int(t.levels[g[0]]), t._values(token(k)))]))
        parts.append(t.subtree(g[0]) if len(g) == 1 else ta.Tree.cat([t.subtree(x) for x in g], token(k)))
        at += 1
    folded = t._spliced(edits)
    if cfg.min_subtree <= int(leaf_counts(folded.parents)[0]) <= cfg.max_tree:
        out.append(folded)
    return out + parts


def span_of_siblings(t: ta.Tree, least: int, most: int, rng: np.random.Generator, tries: int = 100, blocked=()) -> list[int] | None:
    """Adjacent siblings with ``least`` to ``most`` leaves in all: from a random node up to a branch that
    is large enough for them, then growing to either side. None after ``tries`` starts without success."""
    leaves, d = leaf_counts(t.parents), t.descendants
    closed = set(blocked)
    if len(t) < 2:
        return None
    for start in rng.integers(1, len(t), tries).tolist():
        while start > 0 and leaves[start] < least and t.parents[start] > 0 and leaves[t.parents[start]] <= most:
            start = int(t.parents[start])
        if start == 0 or leaves[start] > most or start in closed:
            continue
        kids = ta.children_of(t.parents, int(t.parents[start])).tolist()
        lo = hi = kids.index(start)
        total = int(leaves[start])
        sides = {-1, 1}
        while sides and total < most:
            side = int(rng.choice(sorted(sides)))
            k = lo - 1 if side < 0 else hi + 1
            if not 0 <= k < len(kids) or kids[k] in closed or total + leaves[kids[k]] > most:
                sides.discard(side)
                continue
            total += int(leaves[kids[k]])
            lo, hi = (k, hi) if side < 0 else (lo, k)
        if least <= total <= most:
            return kids[lo : hi + 1]
    return None


def span_size(size: int, rng: np.random.Generator, *, share=None, absolute=None, poisson=None, poisson_share=None, normal=None) -> int:
    """The number of leaves to mask, by exactly one of five modes."""
    modes = [m for m in (share, absolute, poisson, poisson_share, normal) if m is not None]
    if len(modes) != 1:
        raise ValueError("give exactly one size")
    if share is not None:
        return int(round(share * size))
    if absolute is not None:
        return int(absolute)
    if poisson is not None:
        return int(rng.poisson(poisson))
    if poisson_share is not None:
        return int(rng.poisson(poisson_share * size))
    low, high = 0.1 * size, max(size - 50, 0.5 * size)
    return int(round(truncated_normal(rng.random(), normal[0], normal[1], low, high)))


def mask_span(t: ta.Tree, mask: int, rng: np.random.Generator, **size) -> tuple[ta.Tree, list] | None:
    """One run of siblings of about the wanted size gives way to a mask: the tree, and the leaves that
    were there. None where no run fits."""
    n = span_size(len(t.leaves()), rng, **size)
    run = span_of_siblings(t, max(1, int(0.8 * n)), max(1, int(np.ceil(1.2 * n))), rng) if n else None
    if run is None:
        return None
    gone = [x for r in run for x in t.subtree(r).leaves()]
    return t.delete_siblings(run, mask), gone


def mask_random_spans(n: int, p: float, mean: float, rng: np.random.Generator) -> np.ndarray:
    """A mask of n places: spans of Poisson length at random places that do not touch, about p in all."""
    mask = np.zeros(n, bool)
    budget = int(round(p * n * rng.uniform(0.9, 1.1)))
    for at in rng.permutation(n).tolist():
        if mask.sum() >= 0.9 * budget:
            break
        k = min(max(1, int(rng.poisson(mean))), budget - int(mask.sum()), n - at)
        if k > 0 and not mask[max(0, at - 1) : at + k + 1].any():
            mask[at : at + k] = True
    return mask


def mask_subtrees(t: ta.Tree, masks: list[int], p: float, mean: float, rng: np.random.Generator) -> tuple[list, list] | None:
    """``(source leaves, target)``: whole branches, whose sizes lie in the central three quarters around
    the mean, masked until about p of the leaves are. Branches of white space stay. None below two."""
    low, high = central_bounds(mean)
    leaves, d = leaf_counts(t.parents), t.descendants
    inked = np.concatenate([[0], np.cumsum((d == 0) & (np.array(t.columns[0]) > 14))])
    can = [i for i in range(1, len(t)) if low <= leaves[i] <= high and inked[i + d[i] + 1] > inked[i]]
    picks: list[int] = []
    taken = np.zeros(len(t), bool)
    total, goal = 0, p * int(leaves[0])
    for i in rng.permutation(can).tolist() if can else []:
        if total >= goal or len(picks) == len(masks):
            break
        if not taken[i : i + d[i] + 1].any():
            taken[i : i + d[i] + 1] = True
            picks.append(i)
            total += int(leaves[i])
    if len(picks) < 2:
        return None
    picks.sort()
    source, removed = t.delete_and_list(picks, masks[: len(picks)])
    return source, [x for m, r in zip(masks, removed) for x in (m, *r)]


def dedent_after(tokens: list[int], level: int) -> list[int]:
    """Indentation of every line but the first, less by a number of spaces and never negative."""
    from coppice.operators.tokens import ONE_LINE, SPACES, TWO_LINES

    width = dict(SPACES)
    out: list[int] = []
    i = 0
    while i < len(tokens):
        out.append(tokens[i])
        if tokens[i] in (ONE_LINE, TWO_LINES):
            n, j = 0, i + 1
            while j < len(tokens) and tokens[j] in width:
                n += width[tokens[j]]
                j += 1
            left = max(0, n - level)
            for token, w in SPACES:
                out += [token] * (left // w)
                left %= w
            i = j
        else:
            i += 1
    return out
