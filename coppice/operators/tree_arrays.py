"""Ordered trees as flat arrays in pre-order: pure NumPy, one tree at a time.

A tree is ``(parents, data)`` with ``parents[0] == -1``, or ``(descendants, data)``; either structure
array follows from the other. Rewrites recompute the structure from node levels, so no edit has to
keep three arrays consistent by hand.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np


class TreeError(ValueError):
    """An operation that the tree does not allow."""


def as_ints(x) -> np.ndarray:
    return np.asarray(x, np.int64)


def levels_of(parents: np.ndarray) -> np.ndarray:
    """Depth of each node; the root's is 0."""
    out = np.zeros(len(parents), np.int64)
    for i in range(1, len(parents)):
        out[i] = out[parents[i]] + 1
    return out


def parents_of_levels(levels: np.ndarray) -> np.ndarray:
    """The last node before that lies one level higher; -1 for the root."""
    out = np.full(len(levels), -1, np.int64)
    path: list[int] = []
    for i, level in enumerate(levels.tolist()):
        del path[level:]
        if path:
            out[i] = path[-1]
        path.append(i)
    return out


def descendants_of_levels(levels: np.ndarray) -> np.ndarray:
    """Nodes below each node: up to the next node at its level or higher."""
    n = len(levels)
    out = np.zeros(n, np.int64)
    open_nodes: list[int] = []
    for i, level in enumerate(levels.tolist()):
        while open_nodes and levels[open_nodes[-1]] >= level:
            j = open_nodes.pop()
            out[j] = i - j - 1
        open_nodes.append(i)
    for j in open_nodes:
        out[j] = n - j - 1
    return out


def descendants_of(parents) -> np.ndarray:
    return descendants_of_levels(levels_of(as_ints(parents)))


def parents_of(descendants) -> np.ndarray:
    """The nearest earlier node whose interval encloses each node."""
    d = as_ints(descendants)
    out = np.full(len(d), -1, np.int64)
    path: list[int] = []
    for i in range(len(d)):
        while path and path[-1] + d[path[-1]] < i:
            path.pop()
        if path:
            out[i] = path[-1]
        path.append(i)
    return out


def heights_of(parents) -> np.ndarray:
    """Levels between each node and its deepest descendant; 0 for leaves."""
    p = as_ints(parents)
    out = np.zeros(len(p), np.int64)
    for i in range(len(p) - 1, 0, -1):
        out[p[i]] = max(out[p[i]], out[i] + 1)
    return out


def is_valid(parents, descendants) -> bool:
    """Whether both arrays describe the same tree in pre-order."""
    p, d = as_ints(parents), as_ints(descendants)
    if len(p) != len(d) or not len(p) or p[0] != -1 or (p[1:] >= np.arange(1, len(p))).any() or (p[1:] < 0).any():
        return False
    return bool((descendants_of(p) == d).all() and (parents_of(d) == p).all())


def ancestors_of(parents, node: int) -> list[int]:
    """The path from the root to a node, the node included."""
    path = [node]
    while parents[path[-1]] >= 0:
        path.append(int(parents[path[-1]]))
    return path[::-1]


def lowest_common_ancestor(parents, i: int, j: int) -> int:
    a, b = ancestors_of(parents, i), ancestors_of(parents, j)
    return next(x for x, y in zip(reversed(a[: min(len(a), len(b))]), reversed(b[: min(len(a), len(b))])) if x == y)


def incidence_matrix(descendants) -> np.ndarray:
    """Row i marks the nodes of the branch below i, i included: ``m[i, j]`` iff i is on the path to j."""
    d = as_ints(descendants)
    at = np.arange(len(d))
    return (at[:, None] <= at[None, :]) & (at[None, :] <= (at + d)[:, None])


def ancestral_matrix(descendants) -> np.ndarray:
    """The level of the lowest common ancestor of every pair of nodes."""
    return levels_of(parents_of(descendants)).astype(np.int64)[lca_matrix(descendants)]


def lca_matrix(descendants) -> np.ndarray:
    """The lowest common ancestor of every pair: for an earlier node, that of the parent and it."""
    p = as_ints(parents_of(descendants))
    m = np.zeros((len(p), len(p)), np.int64)
    for i in range(1, len(p)):
        m[i, :i] = m[:i, i] = m[p[i], :i]
        m[i, i] = i
    return m


def movements(descendants) -> np.ndarray:
    """Steps up from i before going down to j."""
    a = ancestral_matrix(descendants)
    return np.diagonal(a)[:, None] - a


def distances(descendants) -> np.ndarray:
    """Length of the path between every pair of nodes."""
    up = movements(descendants)
    return up + up.T


def adjacency(parents, directed: bool = True, up: bool = False, loop_root: bool = False) -> np.ndarray:
    """Edges between parents and children, downwards, upwards or both ways."""
    p = as_ints(parents)
    m = np.zeros((len(p), len(p)), bool)
    kids = np.arange(1, len(p))
    if up:
        m[kids, p[kids]] = True
    else:
        m[p[kids], kids] = True
    if loop_root:
        m[0, 0] = True
    return m if directed else m | m.T


def children_of(parents, node: int) -> np.ndarray:
    return np.flatnonzero(as_ints(parents) == node)


def node_at(parents, position: tuple[int, ...]) -> int:
    """The node reached from the root by child ordinals."""
    node = 0
    for ordinal in position:
        kids = children_of(parents, node)
        if ordinal >= len(kids):
            raise TreeError(f"node {node} has no child {ordinal}")
        node = int(kids[ordinal])
    return node


def descendants_of_incidences(matrix) -> np.ndarray:
    """From an incidence matrix (see :func:`incidence_matrix`): the nodes below each node."""
    return np.asarray(matrix, bool).sum(axis=1) - 1


def parents_of_incidences(matrix) -> np.ndarray:
    """From an incidence matrix: each node's parent, the last other node on its path."""
    m = np.asarray(matrix, bool) & ~np.eye(len(matrix), dtype=bool)
    return np.where(m, np.arange(len(m))[:, None], -1).max(axis=0, initial=-1)


def incidence_nodes(matrix, pad: int = -1) -> np.ndarray:
    """An incidence matrix with each row's node in the places it marks, ``pad`` in the others."""
    m = np.asarray(matrix, bool)
    return np.where(m, np.arange(len(m))[:, None], pad)


def level_masks(parents, down: bool = False) -> list[tuple[int, np.ndarray]]:
    """``(level, which nodes lie on it)`` from the deepest level up to the root's children, or, with
    ``down``, from the root to the last level but one; a tree of one level has none."""
    levels = levels_of(as_ints(parents))
    most = int(levels.max(initial=0))
    return [(k, levels == k) for k in (range(most) if down else range(most, 0, -1))]


def subtree_mask(descendants, node: int) -> np.ndarray:
    """Which nodes lie in the branch of a node, itself included."""
    d = as_ints(descendants)
    at = np.arange(len(d))
    return (at >= node) & (at <= node + d[node])


def is_descendant_of(descendants, node: int, ancestor: int) -> bool:
    return ancestor < node <= ancestor + int(descendants[ancestor])


def child_with_data(parents, data, node: int, value) -> int:
    """The first child of a node that holds a value; an error where there is none."""
    for k in children_of(parents, node).tolist():
        if data[k] == value:
            return k
    raise TreeError(f"node {node} has no child with {value!r}")


class Tree:
    """An editable tree: node levels and parallel data columns."""

    def __init__(self, parents, *columns):
        self.parents = as_ints(parents)
        self.levels = levels_of(self.parents)
        self.columns = [list(c) for c in columns]
        if any(len(c) != len(self.parents) for c in self.columns):
            raise TreeError("columns of different lengths")

    @classmethod
    def of_levels(cls, levels, *columns) -> Tree:
        return cls(parents_of_levels(as_ints(levels)), *columns)

    @cached_property
    def descendants(self) -> np.ndarray:
        return descendants_of_levels(self.levels)

    def __len__(self) -> int:
        return len(self.parents)

    def __eq__(self, other) -> bool:
        """Equal structure and equal columns."""
        return isinstance(other, Tree) and self.parents.tolist() == other.parents.tolist() and self.columns == other.columns

    __hash__ = None

    def branch(self, node: int) -> slice:
        """The slice of a node and all below it."""
        if not 0 <= node < len(self):
            raise TreeError(f"no node {node}")
        return slice(node, node + int(self.descendants[node]) + 1)

    def subtree(self, node: int) -> Tree:
        s = self.branch(node)
        return Tree.of_levels(self.levels[s] - self.levels[node], *[c[s] for c in self.columns])

    def leaves(self) -> list:
        return [x for x, d in zip(self.columns[0], self.descendants) if d == 0]

    def _spliced(self, edits: list[tuple[int, int, list[tuple[int, tuple]]]]) -> Tree:
        """Replace ranges (start, stop) by lists of (level, values of the columns)."""
        levels, columns, at = [], [[] for _ in self.columns], 0
        for start, stop, new in sorted(edits, key=lambda e: (e[0], e[1])):
            if start < at:
                raise TreeError("the branches overlap")
            levels += self.levels[at:start].tolist()
            for c, mine in zip(columns, self.columns):
                c += mine[at:start]
            for level, values in new:
                levels.append(level)
                for c, v in zip(columns, values):
                    c.append(v)
            at = stop
        levels += self.levels[at:].tolist()
        for c, mine in zip(columns, self.columns):
            c += mine[at:]
        return Tree.of_levels(levels, *columns)

    def _values(self, value, extra=None) -> tuple:
        return (value, *([None] * (len(self.columns) - 1) if extra is None else extra))

    def delete(self, node: int, replacement=None) -> Tree:
        """Remove a branch, or collapse it to one leaf."""
        return self.delete_many([node], [replacement])

    def delete_many(self, nodes, replacements=None) -> Tree:
        """Remove disjoint branches; a replacement that is not None leaves one leaf in its branch's place."""
        fills = list(replacements) if replacements is not None else [None] * len(nodes)
        edits = []
        for node, fill in zip(nodes, fills):
            s = self.branch(node)
            if s.start == 0 and fill is None:
                raise TreeError("the root cannot be removed")
            edits.append((s.start, s.stop, [] if fill is None else [(int(self.levels[node]), self._values(fill))]))
        return self._spliced(edits)

    def delete_and_list(self, nodes, tokens) -> tuple[list, list[list]]:
        """The leaves after replacing branches by tokens, and the leaves that each branch had."""
        removed = [self.subtree(n).leaves() for n in nodes]
        return self.delete_many(nodes, tokens).leaves(), removed

    def delete_siblings(self, nodes, replacement=None) -> Tree:
        """Remove adjacent siblings, leaving one leaf for all of them if a replacement is given."""
        nodes = sorted(nodes)
        parents = {int(self.parents[n]) for n in nodes}
        stops = [self.branch(n).stop for n in nodes]
        if len(parents) != 1 or any(stop != nxt for stop, nxt in zip(stops, nodes[1:])):
            raise TreeError("not adjacent siblings")
        new = [] if replacement is None else [(int(self.levels[nodes[0]]), self._values(replacement))]
        return self._spliced([(nodes[0], stops[-1], new)])

    def delete_children(self, node: int, token) -> Tree:
        """Put one leaf in the place of all that is below a node."""
        return self.replace_children([node], [[token]])

    def replace_children(self, nodes, leaves) -> Tree:
        """Put lists of leaves in the place of what is below several nodes."""
        edits = []
        for node, new in zip(nodes, leaves):
            s = self.branch(node)
            if s.stop == s.start + 1:
                raise TreeError(f"node {node} has no children")
            edits.append((s.start + 1, s.stop, [(int(self.levels[node]) + 1, self._values(x)) for x in new]))
        return self._spliced(edits)

    def swap(self, i: int, j: int) -> Tree:
        """Exchange two disjoint branches."""
        if i == j:
            return Tree(self.parents, *self.columns)
        i, j = min(i, j), max(i, j)
        a, b = self.branch(i), self.branch(j)
        if a.stop > b.start:
            raise TreeError("one branch lies within the other")

        def moved(s: slice, level: int) -> list[tuple[int, tuple]]:
            shift = level - int(self.levels[s.start])
            return [(int(x) + shift, v) for x, v in zip(self.levels[s], zip(*[c[s] for c in self.columns]))]

        return self._spliced([(a.start, a.stop, moved(b, int(self.levels[i]))), (b.start, b.stop, moved(a, int(self.levels[j])))])

    def insert(self, parent: int, node, right_sibling: int | None = None, extra=None) -> Tree:
        """Add a leaf or a whole tree below a node, before a sibling or as the last child. Missing
        further columns of a leaf are filled with None."""
        at = self.branch(parent).stop if right_sibling is None else right_sibling
        if right_sibling is not None and int(self.parents[right_sibling]) != parent:
            raise TreeError(f"{right_sibling} is no child of {parent}")
        level = int(self.levels[parent]) + 1
        if isinstance(node, Tree):
            wide = [*node.columns, *[[None] * len(node)] * (len(self.columns) - len(node.columns))]
            new = [(int(x) + level, v) for x, v in zip(node.levels, zip(*wide))]
        else:
            new = [(level, self._values(node, extra))]
        return self._spliced([(at, at, new)])

    @staticmethod
    def cat(trees: list[Tree], root, extra=None) -> Tree:
        """A new root over several trees."""
        width = max((len(t.columns) for t in trees), default=1)
        columns = [[root], *[[x] for x in (extra if extra is not None else [None] * (width - 1))]]
        levels = [0]
        for t in trees:
            levels += (t.levels + 1).tolist()
            for c, mine in zip(columns, [*t.columns, *[[None] * len(t)] * (width - len(t.columns))]):
                c += mine
        return Tree.of_levels(levels, *columns)

    def crop(self, length: int, start: int = 0, leaves: bool = True, gone=None) -> Tree:
        """Keep ``length`` leaves (or nodes) from the ``start``-th leaf on, with all their ancestors and
        no inner node without children. Nodes marked in ``gone`` count as removed already."""
        d = self.descendants
        lost = np.zeros(len(self), bool) if gone is None else np.asarray(gone, bool)
        leaf = np.flatnonzero((d == 0) & ~lost)[start:]
        keep = np.zeros(len(self), bool)
        kept = 0
        for x in leaf.tolist():
            path = [a for a in ancestors_of(self.parents, x) if not keep[a]]
            cost = 1 if leaves else len(path)
            if kept + cost > length:
                break
            keep[path] = True
            kept += cost
        keep[0] = True
        at = np.flatnonzero(keep)
        return Tree.of_levels(self.levels[at], *[[c[k] for k in at] for c in self.columns])


def sibling_runs(parents, least: int = 2, most: int = 6) -> list[tuple[int, int]]:
    """``(start, stop)`` of every branch with something below it and of every run of ``least`` to
    ``most`` adjacent siblings, distinct, in order."""
    p = as_ints(parents)
    d = descendants_of(p)
    out = {(i, i + int(d[i]) + 1) for i in range(len(p)) if d[i]}
    for node in range(len(p)):
        kids = children_of(p, node) if d[node] else []
        for n in range(least, most + 1):
            for k in range(len(kids) - n + 1):
                out.add((int(kids[k]), int(kids[k + n - 1] + d[kids[k + n - 1]] + 1)))
    return sorted(out)


STYLES = {"ascii": ("|   ", "|-- ", "+-- "), "continued": ("│   ", "├── ", "└── "), "round": ("│   ", "├── ", "╰── "), "double": ("║   ", "╠══ ", "╚══ ")}
#: White space and the signs that make it visible.
VISIBLE = {" ": "␣", "\n": "⏎", "\t": "⇥", "\r": "↵", "\v": "⇟"}


def visible(text: str) -> str:
    return text.translate(str.maketrans(VISIBLE))


def unvisible(text: str) -> str:
    return text.translate(str.maketrans({v: k for k, v in VISIBLE.items()}))


def render(parents, labels, most: int | None = None, style: str = "continued") -> str:
    """A drawing of a tree, one node a line; nodes beyond ``most`` are replaced by one ``[...]``."""
    p = as_ints(parents)
    bar, tee, last = STYLES[style]
    up = p.tolist()
    final = set({a: i for i, a in enumerate(up)}.values())  # the last child of every node
    lines, stems = [], []
    for i in range(len(p) if most is None else min(most, len(p))):
        stem = stems[up[i]] if up[i] >= 0 else ""
        stems.append(stem + ("    " if i in final else bar) if up[i] >= 0 else "")
        lines.append(stem + ((last if i in final else tee) if up[i] >= 0 else "") + visible(str(labels[i])))
    if most is not None and len(p) > most:
        lines.append("[...]")
    return "\n".join(lines)
