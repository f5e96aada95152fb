"""Text to trees and back: lossless parsing, sub-token trees, lines, and links of source files."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.operators import tree_arrays as ta

_PIECE = re.compile(r"\w+|\r\n|[ \t]+|\n|.", re.S)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def bracket_tree(text: str) -> tuple[list[int], list[str], int]:
    """``(parents, labels, errors)``: a lossless tree of a text by its brackets.

    The leaves' labels, joined, are the text. Inner nodes are ``[program]``, ``[group]`` for what
    brackets enclose and ``[ERROR]`` for a bracket without a partner. Any other parser with this
    signature can take its place.
    """
    parents, labels, stack, errors = [-1], ["[program]"], [0], 0
    opened: list[str] = []

    def add(parent: int, label: str) -> int:
        parents.append(parent)
        labels.append(label)
        return len(labels) - 1

    for piece in _PIECE.findall(text):
        if piece in _OPEN:
            stack.append(add(stack[-1], "[group]"))
            opened.append(piece)
            add(stack[-1], piece)
        elif piece in _CLOSE:
            if opened and opened[-1] == _CLOSE[piece]:
                add(stack[-1], piece)
                stack.pop()
                opened.pop()
            else:
                add(add(stack[-1], "[ERROR]"), piece)
                errors += 1
        else:
            add(stack[-1], piece)
    return parents, labels, errors + len(opened)


def unparse(parents: list[int], labels: list[str]) -> str:
    """The text of a tree: its leaves, joined. The lone root of an empty text has none."""
    return "" if len(labels) == 1 and labels[0] == "[program]" else "".join(ta.Tree(parents, labels).leaves())


def split_leaves(parents: list[int], labels: list[str], split: Callable[[str], list[str]], inner: str = "[BPE]") -> tuple[list[int], list[str]]:
    """Every leaf that splits in two or more becomes a node with the pieces below it."""
    t = ta.Tree(parents, labels)
    levels, out = [], []
    for level, label, d in zip(t.levels.tolist(), labels, t.descendants.tolist()):
        pieces = split(label) if d == 0 else [label]
        if len(pieces) > 1:
            levels += [level] + [level + 1] * len(pieces)
            out += [inner, *pieces]
        else:
            levels.append(level)
            out.append(pieces[0] if pieces else label)
    return ta.parents_of_levels(ta.as_ints(levels)).tolist(), out


def join_leaves(parents: list[int], labels: list[str], inner: str = "[BPE]") -> tuple[list[int], list[str]]:
    """The inverse of :func:`split_leaves`."""
    t = ta.Tree(parents, labels)
    d = t.descendants
    levels, out, i = [], [], 0
    while i < len(labels):
        levels.append(int(t.levels[i]))
        if labels[i] == inner and d[i]:
            out.append("".join(labels[i + 1 : i + int(d[i]) + 1]))
            i += int(d[i]) + 1
        else:
            out.append(labels[i])
            i += 1
    return ta.parents_of_levels(ta.as_ints(levels)).tolist(), out


def byte_pieces(file: str) -> Callable[[str], list[str]]:
    """Splits a text into the pieces of a tokenizer file; joined, they are the text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True

    def split(text: str) -> list[str]:
        cut = [o for o in t.encode(text, add_special_tokens=False).offsets]
        edges = sorted({a for a, _ in cut} | {len(text)})
        return [text[a:b] for a, b in zip(edges, edges[1:]) if b > a] or [text]

    return split


def wrapped_variants(code: str) -> dict[str, str]:
    """A snippet as it is, as the body of a class and as that of a method."""
    return {"plain": code, "class": f"class Wrapper {{\n{code}\n}}", "method": f"class Wrapper {{\nvoid wrapper() {{\n{code}\n}}\n}}"}


def least_errors(counts: Column) -> Column:
    """Of ``array<struct<errors, order, ...>>`` the first with the least errors."""
    return F.element_at(F.array_sort(counts), 1)


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``: the lines of a text, counted from 1."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def line_window(df: DataFrame, key: str, text: str, first: str, last: str) -> DataFrame:
    """``key, text``: the lines from ``first`` to ``last`` (columns, counted from 1, both included)."""
    parts = F.split(text, "\n")
    n = F.greatest(F.col(last) - F.col(first) + 1, F.lit(0))
    return df.where(F.col(text).isNotNull() & F.col(first).isNotNull() & F.col(last).isNotNull()).select(key, F.array_join(F.slice(parts, F.greatest(F.col(first), F.lit(1)), n), "\n").alias("text"))


def masked_lines(text: Column, first: Column, last: Column, mask: str = "___MASK___") -> Column:
    """A struct of the text in which lines ``first`` to ``last`` gave way to a mask behind the first
    line's white space, and of those lines without that white space."""
    lines = F.split(text, "\n")
    span = F.array_join(F.slice(lines, first, last - first + 1), "\n")
    lead = F.regexp_extract(span, r"^([ \t]*)", 1)
    before, after = F.slice(lines, F.lit(1), first - 1), F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0)))
    context = F.array_join(F.concat(before, F.array(F.concat(lead, F.lit(mask))), after), "\n")
    return F.struct(context.alias("context"), F.substring(span, F.length(lead) + 1, 1 << 30).alias("target"))


def repository_name(repository: Column) -> Column:
    return F.split_part(repository, F.lit("/"), F.lit(2))


def repository_url(repository: Column, host: str) -> Column:
    return F.concat(F.lit(host + "/"), repository)


def branch(repository: Column, path: Column) -> Column:
    """The path's first directory without the repository's name."""
    return F.replace(F.split_part(path, F.lit("/"), F.lit(1)), F.concat(repository_name(repository), F.lit("-")), F.lit(""))


def path_from_root(path: Column) -> Column:
    return F.regexp_replace(path, r"^[^/]*/", "")


def file_url(repository: Column, path: Column, host: str) -> Column:
    return F.concat(repository_url(repository, host), F.lit("/blob/"), branch(repository, path), F.lit("/"), path_from_root(path))


def escaped(text: Column) -> Column:
    """Text for a page of HTML."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def result_pages(answers: DataFrame, per_page: int) -> DataFrame:
    """``page, html``: result rows ``query, rank, score, text`` as pages of ``per_page`` queries."""
    row = F.format_string("<tr><td>%s</td><td>%s</td><td>%.4f</td><td><pre>%s</pre></td></tr>", F.col("query").cast("string"), F.col("rank").cast("string"), F.col("score"), escaped(F.col("text")))
    rows = answers.select(F.floor(F.col("query") / per_page).alias("page"), "query", "rank", row.alias("row"))
    packed = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("query", "rank", "row"))).alias("r"))
    return packed.select("page", F.concat(F.lit("<table>"), F.array_join(F.transform("r", lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))


def stripped(text: Column) -> Column:
    """Without leading white space of any kind."""
    return F.regexp_replace(text, r"^\s+", "")
