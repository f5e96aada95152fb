"""Identifiers in trees: subtree hashes, occurrences, masking and making them unique."""

from __future__ import annotations

import hashlib

import numpy as np

from coppice.operators import tree_arrays as ta


def hash_subtrees(parents, tokens) -> list[int]:
    """A 48-bit number per node; equal subtrees (shape and tokens, height included) have equal numbers.

    A leaf's is the BLAKE2b digest of its token. An inner node's starts from its first child's digest
    and takes in its own token, the other children's digests and its height.
    """
    p = ta.as_ints(parents)
    n = len(p)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        kids[p[i]].append(i)
    heights = ta.heights_of(p) if n else np.zeros(0, int)
    digests: list[bytes] = [b""] * n

    def number(x: int) -> bytes:
        return int(x).to_bytes((int(x).bit_length() + 7) // 8, "big")

    for i in range(n - 1, -1, -1):
        below = kids[i][::-1]
        h = hashlib.blake2b(digest_size=6)
        if below:
            h.update(digests[below[0]])
        h.update(number(tokens[i]))
        for k in below[1:]:
            h.update(digests[k])
        if below:
            h.update(number(heights[i]))
        digests[i] = h.digest()
    return [int.from_bytes(d, "big") for d in digests]


# The nonterminals that hold identifiers, types, primitive types and methods or attributes.
SYMBOLS: dict[str, tuple[tuple[str, ...], ...]] = {
    "c": (("[identifier]",), ("[type_identifier]",), ("[primitive_type]", "[sized_type_specifier]"), ("[field_identifier]",)),
    "c-sharp": (("[identifier]",), (), ("[predefined_type]",), ()),
    "cpp": (("[identifier]",), ("[type_identifier]", "[namespace_identifier]"), ("[primitive_type]",), ("[field_identifier]",)),
    "css": (("[property_name]", "[id_name]", "[class_name]", "[attribute_name]"), (), ("[unit]", "[tag_name]"), ("[function_name]",)),
    "go": (("[identifier]", "[field_identifier]"), ("[package_identifier]", "[type_identifier]"), (), ()),
    "haskell": (("[variable]", "[constructor]"), ("[type_variable]", "[type]", "[module]"), (), ()),
    "java": (("[identifier]",), ("[type_identifier]",), ("[floating_point_type]", "[integral_type]", "[void_type]", "[boolean_type]"), ()),
    "javascript": (("[identifier]",), (), (), ("[property_identifier]", "[shorthand_property_identifier_pattern]", "[shorthand_property_identifier]")),
    "julia": (("[identifier]",), (), (), ()),
    "ocaml": (("[value_name]", "[value_pattern]", "[class_name]", "[constructor_name]", "[label_name]", "[field_name]"), ("[module_name]", "[module_type_name]", "[class_type_name]"), ("[type_constructor]",), ("[method_name]",)),
    "php": (("[name]",), (), ("[primitive_type]",), ()),
    "python": (("[identifier]",), (), (), ()),
    "ruby": (("[identifier]", "[instance_variable]", "[simple_symbol]"), ("[constant]",), (), ()),
    "rust": (("[identifier]",), ("[type_identifier]",), ("[primitive_type]",), ("[field_identifier]", "[shorthand_field_identifier]")),
    "scala": (("[identifier]",), ("[type_identifier]",), (), ()),
    "typescript": (("[identifier]",), ("[type_identifier]",), (), ("[property_identifier]", "[shorthand_property_identifier_pattern]", "[shorthand_property_identifier]")),
}
CLASSES = ("identifier", "types", "primitive_types", "methods")
#: The nonterminal that stands for all identifiers.
ANY_IDENTIFIER = "[IDENTIFIER]"


def symbols_of(lang: str, identifier: bool = True, types: bool = True, primitive_types: bool = True, methods: bool = True) -> set[str]:
    """The nonterminals of a language's identifiers, by class; the general one is always among them."""
    use = (identifier, types, primitive_types, methods)
    return {ANY_IDENTIFIER}.union(*(s for s, u in zip(SYMBOLS[lang], use) if u))


def occurrences(parents, tokens, symbol: int) -> tuple[list[int], list[int], dict[int, int]]:
    """``(nodes, number of each, first node of each number)`` of the identifier branches of a tree.

    A branch below a node with the token ``symbol`` is an identifier; equal branches have the same
    number, numbered by the rank of their hash."""
    d = ta.descendants_of(parents)
    hashes = hash_subtrees(parents, tokens)
    nodes = [i for i in range(len(tokens)) if tokens[i] == symbol and d[i] > 0]
    order = {h: k for k, h in enumerate(sorted({hashes[i] for i in nodes}))}
    numbers = [order[hashes[i]] for i in nodes]
    first: dict[int, int] = {}
    for node, k in zip(nodes, numbers):
        first.setdefault(k, node)
    return nodes, numbers, first


def selected(numbers: list[int], keep: set[int]) -> dict[int, int]:
    """New dense numbers for some of the identifiers."""
    return {k: i for i, k in enumerate(sorted(set(numbers) & keep))}


def probabilistic_round(x: float, u: float) -> int:
    """Down or up, so that the mean is x."""
    return int(np.floor(x)) + (u < x - np.floor(x))


def mask_identifiers(parents, tokens, symbol: int, masks: list[int], rng: np.random.Generator, hide: float = 0.6, reveal: float = 0.0) -> tuple[list[int], list[int]] | None:
    """``(source leaves, target)``: a random share of the distinct identifiers is replaced by masks.

    The target lists each mask with the identifier's own leaves, in order of first occurrence. With
    ``reveal``, that share of the repeated occurrences keeps its name. None without identifiers, or if
    none is hidden."""
    nodes, numbers, first = occurrences(parents, tokens, symbol)
    distinct = sorted(first)
    n = min(len(distinct), probabilistic_round(hide * len(distinct), rng.random()))
    if not n:
        return None
    hidden = set(rng.choice(distinct, n, replace=False).tolist())
    if n > len(masks):
        raise ta.TreeError("more identifiers than mask tokens")
    new = selected(numbers, hidden)
    picks = [(node, k) for node, k in zip(nodes, numbers) if k in hidden and (node == first[k] or rng.random() >= reveal)]
    tree = ta.Tree(parents, tokens)
    source, removed = tree.delete_and_list([p for p, _ in picks], [masks[new[k]] for _, k in picks])
    target: list[int] = []
    for (node, k), own in zip(picks, removed):
        if node == first[k]:
            target += [masks[new[k]], *own]
    return source, target


def unique_identifiers(pair: tuple, symbol: int, masks: list[int], rng: np.random.Generator, overlap: float = 0.1, first_share: float = 0.5) -> tuple[list[int], list[int]] | None:
    """Leaves of source and target in which shared identifiers are named on one side only.

    ``pair``: ``(parents, tokens)`` of source and target. A share ``overlap`` of the shared identifiers
    stays on both sides; every other is masked in the source with probability ``first_share``, else in
    the target. Both sides count masks from the first. None where nothing is shared."""
    sides = []
    for parents, tokens in pair:
        hashes = hash_subtrees(parents, tokens)
        d = ta.descendants_of(parents)
        sides.append({i: hashes[i] for i in range(len(tokens)) if tokens[i] == symbol and d[i] > 0})
    shared = sorted(set(sides[0].values()) & set(sides[1].values()))
    if not shared:
        return None
    exempt = set(rng.choice(shared, probabilistic_round(overlap * len(shared), rng.random()), replace=False).tolist())
    in_source = {h for h in shared if h not in exempt and rng.random() < first_share}
    hide = [in_source, {h for h in shared if h not in exempt and h not in in_source}]
    out = []
    for (parents, tokens), mine, gone in zip(pair, sides, hide):
        number = {h: k for k, h in enumerate(sorted(gone))}
        picks = [(i, h) for i, h in sorted(mine.items()) if h in gone]
        out.append(ta.Tree(parents, tokens).delete_many([i for i, _ in picks], [masks[number[h]] for _, h in picks]).leaves())
    return out[0], out[1]
