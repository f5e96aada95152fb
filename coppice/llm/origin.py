"""Which files of a code collection were written by hand.

Every file gets evidence for the five labels: from its own words, its name, its form (line lengths, data
rows, repeated line shapes) and its likeness to known libraries. The directories of each repository
form a tree; a directory has a label too, with evidence from its name. Exact belief propagation over
the trees, messages up and then down, level by level, combines the evidence of a file with the
compatibility of labels between parents, children and so siblings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.functions.scratch import written
from coppice.llm.shingles import mixed
from coppice.llm.splits import repository_key

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: The states of the model: a copy known by its content says nothing about its directory, unlike
#: one known by its place, so "vendored" has two states.
STATES = ("handwritten", "generated", "minified", "vendored", "copied", "blob")
REPORTED = {"copied": "vendored"}
N = len(STATES)
HAND, GEN, MIN, VEND, COPY, BLOB = range(N)

#: P(state of a child | state of its directory): the rows are directories. A hand-written directory
#: may hold single files of any kind, but hardly a whole directory of another kind; the other kinds of
#: directory mostly hold their own (fixed parameters). A file is a third-party copy by its place only
#: where its directory is, so what files look like says nothing for or against that: the rows of
#: hand-written and vendored directories mirror one another.
_MINIFIED, _COPIED, _BLOB = [0.15, 0.04, 0.74, 0.01, 0.02, 0.04], [0.50, 0.10, 0.10, 0.10, 0.10, 0.10], [0.15, 0.04, 0.01, 0.01, 0.02, 0.77]
OF_DIRECTORY = np.array([
    [0.9880, 0.0020, 0.0040, 0.0010, 0.0010, 0.0040],
    [0.0020, 0.9900, 0.0020, 0.0020, 0.0020, 0.0020],
    _MINIFIED,
    [0.0010, 0.0020, 0.0040, 0.9880, 0.0010, 0.0040],
    _COPIED,
    _BLOB,
])
OF_FILE = np.array([
    [0.9380, 0.0200, 0.0100, 0.0020, 0.0200, 0.0100],
    [0.0040, 0.9560, 0.0100, 0.0100, 0.0100, 0.0100],
    _MINIFIED,
    [0.0020, 0.0200, 0.0100, 0.9380, 0.0200, 0.0100],
    _COPIED,
    _BLOB,
])
#: Evidence weights (natural log odds) of the signals.
STRONG, CLEAR, VARIED = 14.0, 10.0, 3.0

# Directory names that say what lies below them.
VENDOR_DIRS = "vendor third_party third-party thirdparty 3rdparty 3rd_party 3rd-party node_modules bower_components jspm_packages godeps external externals bundled deps site-packages dist-packages pods carthage"
GENERATED_DIRS = "gen gen-src gen_src autogen auto-generated generated generated-src generated_src generated-sources generated_sources __generated__ src-gen"
BUILT_DIRS = "dist"
# File names of generated and of minified files.
GENERATED_NAME = re.compile(r"(?:[._-]generated\.[^.]+|[._-]g\.[a-z]+|\.designer\.[a-z]+|\.gen\.[a-z]+|_pb2?(?:_grpc)?\.[a-z]+|\.pb\.[a-z.]+|\.pb-c\.[ch]|\.pb2\.[a-z]+|OuterClass\.java)$", re.I)
MINIFIED_NAME = re.compile(r"(?:[.-]min\.(?:js|css|mjs)|\.bundle\.(?:js|css)|\.[0-9a-f]{5,}\.chunk\.(?:js|css)|\.chunk\.(?:js|css))$", re.I)
# What generated files say of themselves in a comment.
SAYS = re.compile(
    r"<auto-?generated\b|@generated\b|\bauto-?generated (?:file|by|from|code)\b|\b(?:automatically|machine|auto)[ -]?(?:generated|made|written|produced|created) (?:by|from|with|using)\b"
    r"|\bcode generated (?:by|from|with)\b|\b(?:file|code|class|module|source) (?:is|was|has been) (?:auto(?:matically)?[ -]?)?generated (?:by|from|with|using)\b|\bgenerated (?:by|from|with|using) [\w./-]+[^\n]*\b(?:do not|don't) (?:edit|modify|change)"
    r"|\bproduced by (?:the )?[\w./-]+ (?:compiler|generator|tool)\b|\bmanual (?:edits|changes)[^\n]*\b(?:overwritten|lost)\b|\b(?:changes|edits)[^\n]*\bwill be (?:lost|overwritten)\b"
    r"|\bplease (?:regenerate|re-generate)\b|\bregenerate instead of\b|\bedit the (?:template|source|schema|grammar) instead\b|\bgenerated from [\w./-]+\.[a-z]+\b|\bdo not (?:modify|edit|change) (?:it )?by hand\b"
    r"|\b(?:tables?|parser|lexer|bindings|stubs?|code|file),? (?:built|made|derived|compiled|emitted|created) (?:from|by) [\w./-]+\.[a-z]+\b",
    re.I,
)
#: What must occur (in lower case) for SAYS to match at all; a cheap test of the whole text.
STEMS = ("generat", "overwritten", "will be lost", "machine", "automatically", "produced by", "template instead", "by hand", "built from", "made from", "derived from", "compiled from", "emitted", "created ", " instead")
DENIES = re.compile(r"\bnot (?:auto)?generated\b|\bby hand, not\b|\bedit it freely\b|\bgenerates\b", re.I)
COMMENT = re.compile(r"^\s*(?://|#|/?\*|<!--|--|;|\"\"\"|'''|%)")

EVIDENCE = T.StructType([T.StructField(f"e_{x}", T.DoubleType()) for x in STATES])


class TokenTable:
    """Per-token facts of a vocabulary, looked up by id; unknown ids count as one strange character."""

    def __init__(self, tokens: dict[int, str]):
        n = max(tokens, default=0) + 2
        self.text = ["�"] * n
        for i, t in tokens.items():
            self.text[i] = t or ""
        self.n = n
        self.chars = np.array([len(t) for t in self.text], np.int32)
        blank = np.array([bool(t) and t.isspace() for t in self.text])
        self.nonblank = np.where(blank, 0, self.chars).astype(np.int32)
        datum = re.compile(r"[0-9a-fx,]+")
        self.datum = np.where([bool(datum.fullmatch(t)) and (len(t) == 1 or t.isdigit()) for t in self.text], self.chars, 0).astype(np.int32)
        self.quote = np.array([t == '"' for t in self.text])
        self.newlines = np.array([t.count("\n") for t in self.text], np.int32)
        # classes for the shape of a line: words and numbers collapse, other signs stand for themselves
        kind = np.arange(n) + 8
        for i, t in enumerate(self.text):
            if t and (t.replace("_", "a").isalnum()):
                kind[i] = 1
        kind[blank] = 0
        self.kind = kind
        self.item = np.array([bool(t) and not t.isspace() and i > 14 for i, t in enumerate(self.text)])


class Libraries:
    """Runs of four visible tokens of the known libraries."""

    def __init__(self, rows: list[tuple[str, str, np.ndarray]], table: TokenTable):
        self.repos = [r for r, _, _ in rows]
        sets = [np.unique(_runs(d[table.item[np.minimum(d, table.n - 1)]])) for _, _, d in rows]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes) if sets else np.zeros(0, np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.hashes, self.first = np.unique(flat, return_index=True)
        self.last = np.append(self.first[1:], len(flat))

    def likeness(self, runs: np.ndarray) -> np.ndarray:
        """Jaccard similarity of a file's distinct runs with each library."""
        at = np.searchsorted(self.hashes, runs)
        at = at[(at < len(self.hashes))]
        runs = np.unique(runs)
        at = np.minimum(np.searchsorted(self.hashes, runs), max(len(self.hashes) - 1, 0))
        hit = at[self.hashes[at] == runs] if len(self.hashes) else at[:0]
        common = np.zeros(len(self.sizes), np.int64)
        for k in hit:
            common[self.owner[self.first[k] : self.last[k]]] += 1
        return common / np.maximum(len(runs) + self.sizes - common, 1)


def _runs(items: np.ndarray) -> np.ndarray:
    if len(items) < 4:
        return np.zeros(0, np.uint64)
    x = items.astype(np.uint64) + np.uint64(1)
    p = np.uint64(2654435761)
    return mixed(((x[:-3] * p + x[1:-2]) * p + x[2:-1]) * p + x[3:])


def _by_file(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` per file; files may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(flat: np.ndarray, offsets: np.ndarray, t: TokenTable) -> dict[str, np.ndarray]:
    """Form of each file: ``chars``, ``lines``, ``line`` (mean length), ``longest``, ``data`` (share of
    data characters), ``quoted`` (share within double quotes), ``shape`` (share of the lines that have
    one of the four commonest shapes)."""
    files = len(offsets) - 1
    ids = np.where((flat >= 0) & (flat < t.n - 1), flat, t.n - 1)
    chars, nl = t.chars[ids].astype(np.int64), t.newlines[ids]
    visible = t.nonblank[ids]
    out = {"chars": _by_file(chars, offsets), "visible": _by_file(visible, offsets)}
    file_of = np.repeat(np.arange(files), np.diff(offsets))
    # a line ends after a token with a line break, or with the file
    ends = nl > 0
    if len(flat):
        ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    stop = np.flatnonzero(ends)
    upto = np.cumsum(chars)[stop] if len(stop) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([[0], upto])) - np.where(nl[stop] > 0, nl[stop], 0)
    of = file_of[stop]
    lines = np.bincount(of, minlength=files)
    out["lines"] = lines
    longest = np.zeros(files, np.int64)
    np.maximum.at(longest, of, length)
    out["longest"] = longest
    seen = np.maximum(out["visible"], 1)
    out["data"] = _by_file(t.datum[ids], offsets) / seen
    quote = np.cumsum(t.quote[ids])
    before = np.concatenate([[0], quote])[offsets[:-1]]
    inside = ((quote - np.repeat(before, np.diff(offsets))) % 2 == 1) & ~t.quote[ids]
    out["quoted"] = _by_file(np.where(inside, visible, 0), offsets) / seen
    # shapes of lines: the classes of the visible tokens, runs of words as one
    kind = t.kind[ids]
    line_of = np.cumsum(np.concatenate([[0], ends[:-1]])) if len(flat) else np.zeros(0, np.int64)
    keep = kind > 0
    k, ln = kind[keep], line_of[keep]
    if len(k):
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != 1) | (k[:-1] != 1) | (ln[1:] != ln[:-1])
        k, ln = k[new], ln[new]
        start = np.flatnonzero(np.concatenate([[True], ln[1:] != ln[:-1]]))
        place = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
        h = np.add.reduceat(mixed(k.astype(np.uint64) * np.uint64(1000003) + place.astype(np.uint64)), start)
        size = np.diff(np.append(start, len(k)))
        of = file_of[stop][ln[start]]
        lone = size > 1  # lines of a single sign (braces) say nothing
        h, of = h[lone], of[lone]
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
        many = np.diff(np.append(edge, len(h)))
        whose = of[edge]
        best = np.lexsort((-many, whose))
        whose, many = whose[best], many[best]
        first = np.searchsorted(whose, np.arange(files))
        nth = np.arange(len(whose)) - first[whose] if len(whose) else whose
        top = np.bincount(whose[nth < 4], weights=many[nth < 4], minlength=files)
        total = np.bincount(of, minlength=files)
    else:
        top, total = np.zeros(files), np.zeros(files, np.int64)
    out["shaped"] = total
    out["shape"] = top / np.maximum(total, 1)
    out["line"] = out["chars"] / np.maximum(lines, 1)
    return out


def says_generated(text: str) -> bool:
    """Whether a comment line of the text says that a tool made it."""
    low = text.lower()
    if not any(s in low for s in STEMS):
        return False
    for m in SAYS.finditer(text):
        at = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        line = text[at : end if end >= 0 else len(text)]
        if COMMENT.match(line) and not DENIES.search(line):
            return True
    return False


def evidence(files: DataFrame, vocabulary: dict[int, str], libraries: list[tuple[str, str, np.ndarray]]) -> DataFrame:
    """``file_id, repo, path, seen, e_...``: the evidence of every row with non-null data.

    ``files(file_id, data, repository, path, ingested_at)``. Vocabulary and libraries are small
    tables of a fixed size. Null and empty data give no evidence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenTable(vocabulary)
        known = Libraries(libraries, table)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                data = part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1)
                lens = np.nan_to_num(np.asarray(data.value_lengths().fill_null(0))).astype(np.int64)
                flat = np.asarray(data.flatten().fill_null(-1)).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(lens)])
                m = measure(flat, offsets, table)
                e = np.zeros((part.num_rows, N))
                e[:, COPY] = -VARIED  # a copy would show
                big = m["visible"] >= 60
                wide = big & (m["line"] >= 120) & (m["longest"] >= 300) & (m["data"] < 0.5) & (m["quoted"] < 0.6)
                e[wide, MIN] += CLEAR
                e[big & (m["data"] >= 0.6), BLOB] += CLEAR
                e[big & (m["quoted"] >= 0.7), BLOB] += CLEAR
                formed = big & (m["shape"] >= 0.9) & (m["shaped"] >= 8) & (m["data"] < 0.6) & (m["quoted"] < 0.7)
                e[formed, GEN] += CLEAR
                varied = big & ~wide & (m["shape"] < 0.8) & (m["data"] < 0.4) & (m["quoted"] < 0.5)
                e[np.ix_(varied, [HAND, VEND, COPY])] += VARIED  # copies of hand-written code look no different
                ids = np.where((flat >= 0) & (flat < table.n - 1), flat, table.n - 1)
                words = table.text
                visible = table.item[ids]
                where = np.concatenate([[0], np.cumsum(visible)])[offsets]
                runs = _runs(flat[visible])
                if len(known.hashes) and len(runs):
                    at = np.minimum(np.searchsorted(known.hashes, runs), len(known.hashes) - 1)
                    hit = known.hashes[at] == runs
                    hits = np.concatenate([[0], np.cumsum(hit)])
                repos, names = part.column(2).to_pylist(), part.column(3).to_pylist()
                listed = ids.tolist()
                for i in range(part.num_rows):
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    if hi > lo and says_generated("".join([words[k] for k in listed[lo:hi]])):
                        e[i, GEN] += STRONG
                    a, b = int(where[i]), int(where[i + 1]) - 3
                    # half of the distinct runs are common wherever a likeness is 0.5
                    if b > a and len(known.hashes) and hits[b] > hits[a] and 2 * len(np.unique(runs[a:b][hit[a:b]])) >= len(np.unique(runs[a:b])):
                        like = known.likeness(runs[a:b])
                        own = np.array([r is not None and r == repos[i] for r in known.repos])
                        if (like[~own] >= 0.5).any() and not (like[own] >= 0.5).any():
                            e[i, COPY] += STRONG
                    name = (names[i] or "").rsplit("/", 1)[-1]
                    if GENERATED_NAME.search(name):
                        e[i, GEN] += CLEAR
                    if MINIFIED_NAME.search(name):
                        e[i, MIN] += CLEAR
                cols = [part.column(k) for k in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(e[:, k]) for k in range(N))], names=["file_id", "repo", "path", "seen", *(f"e_{x}" for x in STATES)])

    live = files.where("data is not null and file_id is not null")
    live = live.select("file_id", "data", repository_key(F.col("repository")).alias("repo"), F.col("path"), F.col("ingested_at").alias("seen"))
    fields = [T.StructField("file_id", files.schema["file_id"].dataType), T.StructField("repo", T.StringType()), T.StructField("path", T.StringType()), T.StructField("seen", files.schema["ingested_at"].dataType)]
    return live.mapInArrow(run, T.StructType(fields + EVIDENCE.fields))


def _message(e: Column, weights: np.ndarray) -> Column:
    """``log(weights @ exp(e))`` of an array column, without overflow."""
    # the exponentials are made once, as the only element of an array that is then mapped
    top = F.array_max(e)
    powers = F.array(F.transform(e, lambda x: F.exp(x - top)))
    rows = [[F.lit(float(w)) for w in row] for row in weights]

    def total(p: Column, row: list[Column]) -> Column:
        out = row[0] * p[0]
        for k in range(1, len(row)):
            out = out + row[k] * p[k]
        return F.log(out)

    logs = F.transform(powers, lambda p: F.array(*[total(p, row) for row in rows]))[0]
    return F.transform(logs, lambda x: x + top)


def _plus(a: Column, b: Column, sign: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(sign))


def propagate(found: DataFrame) -> DataFrame:
    """``file_id, label, score`` (log odds against hand-written) of every file.

    Takes the rows of :func:`evidence`; the last delivery of a file counts. A file without a
    repository is a tree of its own; one without a path hangs on its repository's root. Directories
    are summed with partial aggregation, so one directory or repository may hold any share of rows.
    """
    es = [f"e_{x}" for x in STATES]
    one = found.groupBy("file_id").agg(F.max_by(F.struct("repo", "path", *es), F.struct("seen", "path")).alias("v")).select("file_id", "v.*")
    parts = F.filter(F.split(F.coalesce(F.regexp_replace("path", r"\\", "/"), F.lit("")), "/"), lambda x: (x != "") & (x != "."))
    one = one.withColumn("tree", F.coalesce(F.concat(F.lit("="), "repo"), F.concat(F.lit("#"), F.col("file_id").cast("string"))))
    one = one.withColumn("dirs", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    one = one.withColumn("depth", F.size("dirs")).withColumn("dir", F.array_join("dirs", "/"))
    one = one.select("file_id", "tree", "dir", "depth", F.array(*es).alias("e"))
    one = written(one.select("*", _message(F.col("e"), OF_FILE).alias("m")))
    deepest = one.agg(F.max("depth")).first()[0]
    if deepest is None:
        return one.select("file_id", F.lit(LABELS[0]).alias("label"), F.lit(0.0).alias("score"))
    last_name = F.lower(F.element_at(F.split("dir", "/"), -1))
    parent = F.regexp_replace("dir", r"/?[^/]*$", "")
    one_of = lambda names: last_name.isin(*sorted(names.split()))
    #: where its name decides, a directory says nothing of its parent, nor its parent of it
    named = one_of(f"{VENDOR_DIRS} {GENERATED_DIRS}")

    def own(root: bool) -> Column:
        """What a directory's name says; a root is hand-written unless something speaks against it."""
        if root:
            return F.array(*[F.lit(6.0 if k == HAND else 0.0) for k in range(N)])
        says = {GEN: F.when(one_of(GENERATED_DIRS), 14.0), VEND: F.when(one_of(VENDOR_DIRS), 14.0), MIN: F.when(one_of(BUILT_DIRS), 2.0)}
        return F.array(*[says[k].otherwise(0.0) if k in says else F.lit(0.0) for k in range(N)])

    zero = F.array(*[F.lit(0.0)] * N)
    heard = one.select("tree", "dir", "depth", "m")
    levels: dict[int, DataFrame] = {}
    for d in range(deepest, -1, -1):
        here = heard.where(F.col("depth") == d).groupBy("tree", "dir").agg(F.array(*[F.sum(F.col("m")[k]) for k in range(N)]).alias("u"))
        here = here.select("tree", "dir", _plus(F.col("u"), own(d == 0)).alias("u"))
        levels[d] = here = written(here.select("*", _message(F.col("u"), OF_DIRECTORY).alias("m")) if d else here)
        if d:
            vote = F.when(named, zero).otherwise(F.col("m"))
            heard = heard.where(F.col("depth") < d).union(here.select("tree", parent.alias("dir"), F.lit(d - 1).alias("depth"), vote.alias("m")))
    above = every = levels[0].withColumnRenamed("u", "b")
    for d in range(1, deepest + 1):
        kid = levels[d].withColumn("parent", parent)
        met = kid.join(above.withColumnRenamed("dir", "parent"), ["tree", "parent"])
        met = met.select("tree", "dir", "u", _plus(F.col("b"), F.col("m"), -1.0).alias("rest"))
        met = met.select("tree", "dir", "u", _message(F.col("rest"), OF_DIRECTORY.T).alias("news"))
        above = written(met.select("tree", "dir", F.when(named, F.col("u")).otherwise(_plus(F.col("u"), F.col("news"))).alias("b")))
        every = every.union(above)
    met = one.join(every, ["tree", "dir"])
    final = met.select("file_id", "e", _plus(F.col("b"), F.col("m"), -1.0).alias("rest"))
    final = final.select("file_id", "e", _message(F.col("rest"), OF_FILE.T).alias("news"))
    final = final.select("file_id", _plus(F.col("e"), F.col("news")).alias("f"))
    names = F.array(*[F.lit(REPORTED.get(x, x)) for x in STATES])
    best = F.array_max("f")
    others = F.slice("f", 2, N - 1)
    score = _message(others, np.ones((1, N - 1)))[0] - F.col("f")[HAND]
    # the first label of the greatest belief, so hand-written at a tie
    return final.select("file_id", F.element_at(names, F.array_position("f", best).cast("int")).alias("label"), F.round(score, 6).alias("score"))


def origins(files: DataFrame, vocabulary: DataFrame, libraries: DataFrame) -> DataFrame:
    """``file_id, label, score`` of every file with non-null data; the small tables are read in full
    by the driver (the vocabulary and the known libraries have a fixed size)."""
    tokens = {r[0]: r[1] for r in vocabulary.select("token_id", "token").where("token_id is not null").collect()}
    libs = libraries.where("data is not null").select(repository_key(F.col("repository")), "path", "data").collect()
    rows = [(r[0], r[1], np.array([-1 if x is None else x for x in r[2]], np.int64)) for r in libs]
    return propagate(written(evidence(files, tokens, rows)))
