"""A tokenizer of code: texts and string trees to ids and back, with special tokens of its own.

Vocabulary files are public and read on the driver; executors get their content, not a path. No
tokenizer is trained here.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.operators.text import join_leaves, split_leaves

#: The nonterminal over the pieces of a split leaf, and what stands for an unknown nonterminal.
PIECES, UNKNOWN = "[BPE]", "[UNK]"


class CodeTokenizer:
    """A base vocabulary with special tokens behind it.

    ``content``: of a tokenizer file, JSON or a SentencePiece model. Special tokens get the ids after
    the base vocabulary, in order; their strings within texts are ordinary text.
    """

    def __init__(self, content: bytes, specials: Iterable[str] = ()):
        self.content = bytes(content)
        self.specials = tuple(dict.fromkeys([PIECES, UNKNOWN, *specials]))

    @classmethod
    def load(cls, path: str, specials: Iterable[str] = ()) -> CodeTokenizer:
        """From a vocabulary file, or from what :meth:`save` wrote."""
        content = Path(path).read_bytes()
        if content.startswith(b'{"specials"'):
            head = json.loads(content)
            return cls(head["content"].encode("latin-1"), [*head["specials"], *specials])
        return cls(content, specials)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"specials": self.specials, "content": self.content.decode("latin-1")}))

    def with_specials(self, specials: Iterable[str]) -> CodeTokenizer:
        """The same with further special tokens; ids given before stay."""
        return CodeTokenizer(self.content, [*self.specials, *specials])

    def __reduce__(self):
        return CodeTokenizer, (self.content, self.specials)

    def __eq__(self, other) -> bool:
        return isinstance(other, CodeTokenizer) and (self.content, self.specials) == (other.content, other.specials)

    def __hash__(self) -> int:
        return hash((self.content, self.specials))

    @cached_property
    def _base(self):
        if self.content[:1] == b"{":
            from tokenizers import Tokenizer

            base = Tokenizer.from_str(self.content.decode())
            base.encode_special_tokens = True
            return base
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.content)

    @cached_property
    def base_size(self) -> int:
        return self._base.get_vocab_size() if hasattr(self._base, "get_vocab_size") else self._base.get_piece_size()

    @cached_property
    def special_ids(self) -> dict[str, int]:
        return {s: self.base_size + k for k, s in enumerate(self.specials)}

    def __len__(self) -> int:
        return self.base_size + len(self.specials)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one."""
        if not text:
            return []
        got = self._base.encode(text, add_special_tokens=False) if hasattr(self._base, "get_vocab_size") else self._base.encode(text)
        return list(got.ids) if hasattr(got, "ids") else list(got)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; special tokens are written as they are."""
        names = {i: s for s, i in self.special_ids.items()}
        out, held = [], []

        def flush() -> None:
            if held:
                out.append(self._base.decode(held, skip_special_tokens=False) if hasattr(self._base, "get_vocab_size") else self._base.decode(held))
                held.clear()

        for i in ids:
            if i in names:
                flush()
                out.append(names[i])
            else:
                held.append(int(i))
        flush()
        return "".join(out)

    def encode_tree(self, parents: list[int], labels: list[str]) -> tuple[list[int], list[int]]:
        """The id tree of a string tree: nonterminals are special tokens, or the unknown token, and leaves
        their one id, or a node over several. Empty leaves have no ids and get the unknown token."""
        special, has_kids = self.special_ids, set(parents)
        out_parents, out_ids, place = [], [], {}
        for i, (p, label) in enumerate(zip(parents, labels)):
            up = place[p] if p >= 0 else -1
            place[i] = len(out_ids)
            ids = [special.get(label, special[UNKNOWN])] if i in has_kids else self.encode(label) or [special[UNKNOWN]]
            out_parents.append(up)
            if len(ids) == 1:
                out_ids.append(ids[0])
                continue
            out_ids.append(special[PIECES])
            out_parents += [place[i]] * len(ids)
            out_ids += ids
        return out_parents, out_ids

    def decode_tree(self, parents: list[int], ids: list[int]) -> tuple[list[int], list[str]]:
        """The string tree of an id tree: the pieces below a split leaf are decoded together."""
        special, names, kids = self.special_ids, {i: s for s, i in self.special_ids.items()}, {}
        for i, p in enumerate(parents):
            kids.setdefault(p, []).append(i)
        out_parents, labels, place = [], [], {}
        for i, (p, x) in enumerate(zip(parents, ids)):
            if p >= 0 and ids[p] == special[PIECES]:
                continue
            place[i] = len(labels)
            out_parents.append(place[p] if p >= 0 else -1)
            labels.append(self.decode([ids[k] for k in kids[i]]) if x == special[PIECES] and i in kids else names[x] if x in names else self.decode([x]))
        return out_parents, labels


def tokenised(df: DataFrame, key: str, text: str, tokenizer: CodeTokenizer) -> DataFrame:
    """``key, ids`` of every row's text; null and empty texts have no ids. The vocabulary, of fixed size,
    is broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.encode(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["k", "ids"])

    kind = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, kind).select(F.col("k").alias(key), "ids")


def detokenised(df: DataFrame, key: str, ids: str, tokenizer: CodeTokenizer) -> DataFrame:
    """``key, text`` of every row's ids; null ids give a null text."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["k", "text"])

    kind = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("text", T.StringType())])
    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, kind).select(F.col("k").alias(key), "text")


def split_spans(parents: list[int], labels: list[str], spans: list[tuple[int, int]], split: Callable[[str], list[str]]) -> tuple[list[int], list[str], list[tuple[int, int] | None]]:
    """:func:`~coppice.operators.text.split_leaves` with the spans of the nodes: the node over a split
    leaf's pieces has the leaf's span, the pieces have none."""
    out_parents, out_labels = split_leaves(parents, labels, split, PIECES)
    rest, out = iter(spans), []
    for p in out_parents:
        out.append(None if p >= 0 and out_labels[p] == PIECES and out[p] is not None else next(rest))
    if join_leaves(out_parents, out_labels, PIECES)[1] != list(labels):
        raise ValueError("the pieces do not give the leaves back")
    return out_parents, out_labels, out
