import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from coppice.operators import tree_arrays as ta

# The documented trees of six and of sixteen nodes, and the results for them.
SIX = [-1, 0, 0, 2, 2, 4]
SIXTEEN = [-1, 0, 1, 2, 3, 4, 5, 2, 7, 1, 9, 10, 11, 12, 9, 0]


@st.composite
def trees(draw):
    levels = [0]
    for _ in range(draw(st.integers(0, 40))):
        levels.append(draw(st.integers(1, levels[-1] + 1)))
    return ta.parents_of_levels(np.array(levels))


def tree(parents):
    return ta.Tree(parents, list(range(len(parents))))


def shape(t):
    return t.columns[0], t.parents.tolist(), t.descendants.tolist()


def test_six_node_tree():
    d = ta.descendants_of(SIX)
    assert d.tolist() == [5, 0, 3, 0, 1, 0]
    assert ta.levels_of(np.array(SIX)).tolist() == [0, 1, 1, 2, 2, 3]
    assert ta.heights_of(SIX).tolist() == [3, 0, 2, 0, 1, 0]
    assert ta.lca_matrix(d)[3:].tolist() == [[0, 0, 2, 3, 2, 2], [0, 0, 2, 2, 4, 4], [0, 0, 2, 2, 4, 5]]
    assert ta.ancestral_matrix(d)[5].tolist() == [0, 0, 1, 1, 2, 3]
    assert ta.movements(d)[3].tolist() == [2, 2, 1, 0, 1, 1]
    assert ta.distances(d)[5].tolist() == [3, 4, 2, 3, 1, 0]


def test_edits_of_the_six_node_tree():
    assert shape(tree(SIX).insert(2, 77, 4)) == ([0, 1, 2, 3, 77, 4, 5], [-1, 0, 0, 2, 2, 2, 5], [6, 0, 4, 0, 0, 1, 0])
    assert shape(tree(SIX).swap(1, 2)) == ([0, 2, 3, 4, 5, 1], [-1, 0, 1, 1, 3, 0], [5, 3, 0, 1, 0, 0])
    assert shape(tree([-1, 0, 0, 2]).delete(1)) == ([0, 2, 3], [-1, 0, 1], [2, 1, 0])
    with pytest.raises(ta.TreeError):
        tree(SIX).swap(2, 4)


def test_edits_of_the_sixteen_node_tree():
    t = tree(SIXTEEN)
    assert t.descendants.tolist() == [15, 13, 6, 3, 2, 1, 0, 1, 0, 5, 3, 2, 1, 0, 0, 0]
    assert shape(t.delete(2, 99)) == ([0, 1, 99, 9, 10, 11, 12, 13, 14, 15], [-1, 0, 1, 1, 3, 4, 5, 6, 3, 0], [9, 7, 0, 5, 3, 2, 1, 0, 0, 0])
    assert shape(t.delete(2)) == ([0, 1, 9, 10, 11, 12, 13, 14, 15], [-1, 0, 1, 2, 3, 4, 5, 2, 0], [8, 6, 5, 3, 2, 1, 0, 0, 0])
    assert shape(t.delete_many([2, 12, 14], [101, None, 102])) == ([0, 1, 101, 9, 10, 11, 102, 15], [-1, 0, 1, 1, 3, 4, 3, 0], [7, 5, 0, 3, 1, 0, 0, 0])
    assert shape(t.delete_children(2, 99)) == ([0, 1, 2, 99, 9, 10, 11, 12, 13, 14, 15], [-1, 0, 1, 2, 1, 4, 5, 6, 7, 4, 0], [10, 8, 1, 0, 5, 3, 2, 1, 0, 0, 0])


@given(trees())
def test_structures_follow_from_one_another(parents):
    d = ta.descendants_of(parents)
    assert ta.parents_of(d).tolist() == parents.tolist()
    assert ta.is_valid(parents, d)
    assert d[0] == len(parents) - 1
    assert d.sum() == ta.levels_of(parents).sum()


@given(trees())
def test_distances_are_a_metric(parents):
    d = ta.distances(ta.descendants_of(parents))
    assert (d == d.T).all() and (np.diagonal(d) == 0).all()
    assert (d[:, :, None] <= d[:, None, :] + d.T[None, :, :].transpose(0, 2, 1)).all()
    for i in range(0, len(parents), 7):
        for j in range(0, len(parents), 5):
            assert ta.lca_matrix(ta.descendants_of(parents))[i, j] == ta.lowest_common_ancestor(parents, i, j)


@given(trees(), st.data())
def test_deleting_and_listing_agree(parents, data):
    t = tree(parents)
    if len(t) == 1:
        return
    node = data.draw(st.integers(1, len(t) - 1))
    leaves, removed = t.delete_and_list([node], [-5])
    assert leaves == t.delete(node, -5).leaves()
    at = leaves.index(-5)
    assert leaves[:at] + removed[0] + leaves[at + 1 :] == t.leaves()


@given(trees(), st.integers(1, 10))
def test_crop_keeps_whole_paths(parents, n):
    t = tree(parents)
    c = t.crop(n)
    assert c.leaves() == t.leaves()[:n]
    assert len(t.crop(n, leaves=False)) <= max(n, 1)
    assert ta.Tree.cat([t, c], -1).leaves() == t.leaves() + c.leaves()


def test_drawing():
    assert ta.render(SIX, "abcdef", style="ascii") == "a\n|-- b\n+-- c\n    |-- d\n    +-- e\n        +-- f"
    assert ta.render(SIX, "abcdef", most=1).endswith("[...]")
    assert ta.unvisible(ta.visible("a b\n\tc")) == "a b\n\tc"


def test_incidences_give_the_tree_back():
    m = ta.incidence_matrix(ta.descendants_of(SIXTEEN))
    assert ta.descendants_of_incidences(m).tolist() == ta.descendants_of(SIXTEEN).tolist()
    assert ta.parents_of_incidences(m).tolist() == SIXTEEN
    assert [x for x in ta.incidence_nodes(m)[:, 6].tolist() if x >= 0] == ta.ancestors_of(SIXTEEN, 6)


def test_levels_masks_and_children():
    masks = ta.level_masks(SIX)
    assert [k for k, _ in masks] == [3, 2, 1] and np.flatnonzero(masks[0][1]).tolist() == [5]
    assert [k for k, _ in ta.level_masks(SIX, down=True)] == [0, 1, 2] and ta.level_masks([-1]) == [] and ta.level_masks([]) == []
    d = ta.descendants_of(SIX)
    assert np.flatnonzero(ta.subtree_mask(d, 2)).tolist() == [2, 3, 4, 5]
    assert ta.is_descendant_of(d, 5, 2) and not ta.is_descendant_of(d, 2, 2) and not ta.is_descendant_of(d, 1, 2)
    assert ta.child_with_data(SIX, [9, 8, 8, 7, 7, 7], 0, 8) == 1 and ta.child_with_data(SIX, [9, 8, 8, 7, 7, 7], 2, 7) == 3
    with pytest.raises(ta.TreeError):
        ta.child_with_data(SIX, [0] * 6, 0, 1)


def test_equal_trees():
    a, b = ta.Tree(SIX, [1, 2, 3, 4, 5, 6]), ta.Tree(SIX, [1, 2, 3, 4, 5, 6])
    assert a == b and a != ta.Tree(SIX, [1, 2, 3, 4, 5, 7]) and a != ta.Tree([-1, 0, 1, 2, 3, 4], [1, 2, 3, 4, 5, 6]) and a != 1
