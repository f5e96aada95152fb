"""Source files that are not well formed in their language.

A file is recognised by a packrat parser of its language, which must consume the whole text. Failing
files are reported with the furthest position reached and with the cause of the failure; earlier
counts of errors that come with the data play no part in the decision.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.languages import extension_language, language_identifier

_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?: |\r?$)", re.M)

_ready: dict[str, object] = {}


def _grammar(lang: str):
    from coppice.llm.grammars import GRAMMARS
    from coppice.llm.packrat import Grammar

    if lang not in _ready:
        _ready[lang] = Grammar(GRAMMARS[lang])
    return _ready[lang]


def languages() -> list[str]:
    """The languages that have a grammar."""
    from coppice.llm.grammars import GRAMMARS

    return sorted(GRAMMARS)


def recognise(text: str, lang: str) -> tuple[bool, int, str | None]:
    """Whether a text is well formed, else the offset of the furthest failure and the kind of token there."""
    from coppice.llm.lexers import tokens

    toks = tokens(text, lang)
    ok, far = _grammar(lang).recognise(toks)
    if ok:
        return True, len(text), None
    # what is no token stops every grammar, wherever it stands
    if far >= len(toks.at):
        return False, len(text), "EOF"
    return False, toks.at[far], toks.kinds[far]


def diagnose(text: str | None, lang: str | None) -> tuple[bool | None, int | None, int | None, str | None]:
    """``(valid, offset, line, cause)`` of a file. Null text and languages without a grammar give nulls.

    Causes, the first that applies: ``conflict`` (a merge conflict's marker begins the line of the
    failure or one nearby), ``truncated`` (all was well up to the end), ``unclosed`` (a comment or a
    string that never ends), ``language`` (another language's grammar takes the whole text; these
    grammars are tried for such failures only) and ``syntax``.
    """
    if text is None or lang not in languages():
        return None, None, None, None
    ok, at, kind = recognise(text, lang)
    if ok:
        return True, None, None, None
    line = text.count("\n", 0, at) + 1
    start = text.rfind("\n", 0, max(0, at)) + 1
    if any(start - 400 <= m.start() <= at + 400 for m in _CONFLICT.finditer(text)):
        cause = "conflict"
    elif kind == "EOF" or not text[at:].strip():
        cause = "truncated"
    elif kind == "ERROR" and text[at : at + 1] in "/\"'`":
        cause = "unclosed"
    elif any(recognise(text, x)[0] for x in languages() if x != lang):
        cause = "language"
    else:
        cause = "syntax"
    return False, at, line, cause


def check(files: DataFrame) -> DataFrame:
    """``file_id, language, repository, valid, offset, line, cause``, one row per file.

    ``files(file_id, code, language, repository, path, parsed_at)``: a null or blank language is that of
    the path's extension; the last delivery of a redelivered file counts, and is chosen by key and
    time alone, so texts are shuffled once. ``valid`` is null where the code is null or the language
    has no grammar; empty and comment-only files are valid. Rows with a null file_id are left out.
    """
    lang = F.coalesce(language_identifier(F.when(F.trim("language") != "", F.col("language")), spellings=True), extension_language(F.col("path")))
    columns = "file_id long, language string, repository string, parsed_at timestamp_ntz, valid boolean, offset int, line int, cause string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [diagnose(t, x) for t, x in zip(batch.column(4).to_pylist(), batch.column(1).to_pylist())]
            cols = [pa.array(c, k) for c, k in zip(zip(*found) if found else ((), (), (), ()), (pa.bool_(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *cols], names=["file_id", "language", "repository", "parsed_at", "valid", "offset", "line", "cause"])

    live = files.where("file_id is not null").select("file_id", lang.alias("language"), "repository", F.col("parsed_at").cast("timestamp_ntz"), "code")
    every = live.mapInArrow(run, columns)
    kept = ["language", "repository", "valid", "offset", "line", "cause"]
    return every.groupBy("file_id").agg(F.max_by(F.struct(*kept), F.struct("parsed_at", "valid", "offset")).alias("v")).select("file_id", "v.*")


def rates(checked: DataFrame) -> DataFrame:
    """Per repository and language, per repository and per language, and in all: files with a verdict,
    invalid files and their share. Totals have null names and a ``level``."""
    known = checked.where("valid is not null")
    out = known.groupingSets([["repository", "language"], ["repository"], ["language"], []], "repository", "language").agg(
        F.grouping_id("repository", "language").alias("g"), F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid")
    )
    level = F.element_at(F.create_map(*[F.lit(x) for kv in ((0, "repository and language"), (1, "repository"), (2, "language"), (3, "all")) for x in kv]), F.col("g").cast("int"))
    return out.select(level.alias("level"), "repository", "language", "files", "invalid", F.round(F.col("invalid") / F.col("files"), 6).alias("share"))
