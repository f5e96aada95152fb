"""Exact set-similarity join over prefix trees.

Items are put into one global order, rare ones first. Two sets of similarity t or more then share an
item within the first few of each (the prefix), so sets meet at the *home* of such an item: the
smallest key among the sets with it in their prefix. As the items of near copies have the same homes,
a set travels to few places. At a home, the sets are stored in a radix trie, common items first; one
traversal per set counts the overlap of shared paths once and leaves a subtree as soon as the items
that remain on either side cannot reach the overlap that the threshold needs.

Sets travel as the items they are made from and are made again where they are needed: hashes cannot be
compressed. What each item's frequency is, is asked for whole chunks of sets at once, in four bytes an
item, and answered in one. The more sets there are, the more homes they share by chance; so only bitmaps
travel to all homes, in rounds whose files are removed one after the other, and sets only to the homes
where the bitmaps leave them a partner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.scratch import dropped, shuffled, swept, written
from coppice.llm.shingles import from_planes, planes, unpacked

#: Sets per block of a home; larger homes are cut into blocks, and pairs of blocks meet in cells.
BLOCK = 384
#: Items per chunk of sets, and items per bucket in which frequencies are counted; at least so many buckets.
CHUNK, BUCKET, BUCKETS = 1 << 19, 1 << 21, 64
#: Bytes of bitmaps that one round may send, at least; else so many times what the sets take. Words compared at once.
ROUND, SHARE, WORDS = 1 << 26, 2, 1 << 21


def needed_overlap(n: np.ndarray | int, m: np.ndarray | int, num: int, den: int):
    """The least overlap of sets of n and m items with similarity num/den or more, exactly."""
    return -((-num * (n + m)) // (num + den))


class RadixTrie:
    """A trie of descending rank sequences, paths without branches packed into runs."""

    __slots__ = ("run", "kids", "here", "least", "most")

    def __init__(self, run: np.ndarray):
        self.run, self.kids, self.here, self.least, self.most = run, [], [], 0, 0

    @classmethod
    def of(cls, seqs: list[np.ndarray], sizes: np.ndarray) -> RadixTrie:
        """``sizes``: the full set sizes, from which the bounds of a subtree come."""
        root = cls(np.zeros(0, np.int32))
        order = sorted(range(len(seqs)), key=lambda k: seqs[k].astype(">i4").tobytes())
        path: list[tuple[RadixTrie, int]] = [(root, 0)]  # nodes of the current branch, depth of their ends
        before = np.zeros(0, np.int32)
        for k in order:
            s = seqs[k]
            m = min(len(s), len(before))
            differ = np.flatnonzero(s[:m] != before[:m])
            shared = int(differ[0]) if len(differ) else m
            while len(path) > 1 and path[-2][1] >= shared and path[-1][1] > shared:
                path.pop()
            node, depth = path[-1]
            if depth > shared:  # the run is cut where the new sequence leaves it
                top = path[-2][1]
                low = cls(node.run[shared - top :])
                low.kids, low.here = node.kids, node.here
                node.run, node.kids, node.here = node.run[: shared - top], [low], []
                path[-1] = (node, shared)
            if len(s) > shared:
                new = cls(s[shared:])
                path[-1][0].kids.append(new)
                path.append((new, len(s)))
            path[-1][0].here.append(k)
            before = s
        stack, post = [root], []
        while stack:
            x = stack.pop()
            post.append(x)
            stack.extend(x.kids)
        for x in reversed(post):
            low = [int(sizes[k]) for k in x.here] + [c.least for c in x.kids]
            x.least = min(low) if low else 0
            x.most = max([0] + [c.most + len(c.run) for c in x.kids])
        return root


def join_cell(keys: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> list[tuple[int, int, int]]:
    """The pairs of a cell with similarity num/den or more, as (i, j, overlap), keys[i] < keys[j].

    ``sets``: the items of each; ``side``: where given, only pairs of different sides."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    uniq, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(count, kind="stable")  # rare items first; those of a single set are left out
    single = int(np.count_nonzero(count == 1))
    place = np.empty(len(uniq), np.int32)
    place[order] = np.arange(-single, len(uniq) - single, dtype=np.int32)
    uniq = order[single:]
    ends = np.cumsum([len(s) for s in sets])
    seqs = [np.sort(r[r >= 0])[::-1] for r in np.split(place[at], ends[:-1])]  # common items first
    trie = RadixTrie.of(seqs, sizes)
    out: list[tuple[int, int, int]] = []
    mask = np.zeros(len(uniq) + 1, bool)
    for i, s in enumerate(seqs):
        mask[s] = True
        rising = s[::-1]
        n = int(sizes[i])
        stack = [(trie, 0)]
        while stack:
            node, got = stack.pop()
            got += int(np.count_nonzero(mask[node.run]))
            last = node.run[-1] if len(node.run) else len(uniq)
            for j in node.here:
                if keys[i] < keys[j] and (side is None or side[i] != side[j]) and got >= needed_overlap(n, int(sizes[j]), num, den):
                    out.append((i, j, got))
            if node.kids:
                mine = int(np.searchsorted(rising, last)) if len(node.run) else len(s)
                if got + min(mine, node.most) >= needed_overlap(n, node.least, num, den):
                    stack.extend((c, got) for c in node.kids)
        mask[s] = False
    return out


def chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``rep, n, packed`` to rows of sets of ``most`` items in all: ``chunk, items, reps, sizes, sets``; a
    chunk is named by its first set."""
    reps, sizes, sets, items = [], [], [], 0

    def close() -> pa.RecordBatch:
        arrays = [pa.array([reps[0]], pa.int64()), pa.array([items], pa.int64()), pa.array([reps], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([sets], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays, names=["chunk", "items", "reps", "sizes", "sets"])

    for batch in batches:
        for rep, n, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if reps and items + n > most:
                yield close()
                reps, sizes, sets, items = [], [], [], 0
            reps.append(rep)
            sizes.append(n)
            sets.append(data)
            items += n
    if reps:
        yield close()


def coded(items: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 further bits of each item, in one number. Items with equal codes count as one
    more frequent item, which changes what is compared but not what is found."""
    h = items.view(np.uint64)
    low = np.uint64(32)
    return (((h >> low) * np.uint64(buckets)) >> low) << low | (h & np.uint64(0xFFFFFFFF))


def _counted(batches: Iterator[pa.RecordBatch], column: int, make) -> Iterator[pa.RecordBatch]:
    """Calls ``make`` with the rows of each value of a column by which the batches are sorted."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.asarray(batch.column(column))
        bounds = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), batch.num_rows]
        for at, to in zip(bounds, bounds[1:]):
            if held and int(ids[at]) != key:
                yield make(pa.Table.from_batches(held))
                held = []
            key = int(ids[at])
            held.append(batch.slice(at, to - at))
    if held:
        yield make(pa.Table.from_batches(held))


def parities(s: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, half as many again as items at least: whether the number of
    items at each place is odd. Two sets differ in at least as many items as their bitmaps in bits."""
    bits = max(64, 1 << (len(s) * 3 // 2 - 1).bit_length())
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def near(cells: np.ndarray, side: np.ndarray, sizes: np.ndarray, bits: list[bytes], num: int, den: int) -> np.ndarray:
    """Which rows have a partner in their cell that sizes and bitmaps do not rule out.

    ``cells``: numbers in rising order; ``side``: -1 for all, else only different sides are compared."""
    count = len(cells)
    words = np.array([len(x) // 8 for x in bits])
    level: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by width: the place of each row, the rows folded to it
    rows, folded = np.zeros(0, np.int64), None
    for w in sorted(set(words.tolist()), reverse=True):
        own = np.flatnonzero(words == w)
        new = np.frombuffer(b"".join(bits[k] for k in own), np.uint64).reshape(len(own), w)
        folded = new if folded is None else np.concatenate([np.bitwise_xor.reduce(folded.reshape(len(rows), -1, w), axis=1), new])
        rows = np.concatenate([rows, own])
        place = np.zeros(count, np.int64)
        place[rows] = np.arange(len(rows))
        level[w] = place, folded
    hit = np.zeros(count, bool)
    later = np.searchsorted(cells, cells, side="right") - np.arange(count) - 1
    upto = np.cumsum(later)
    at = 0
    while at < count:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS // 8, side="right")))
        own = later[at:to]
        i = np.repeat(np.arange(at, to), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        most = sizes[i] + sizes[j] - 2 * needed_overlap(sizes[i], sizes[j], num, den)
        keep = (most >= np.abs(sizes[i] - sizes[j])) & ((side[i] < 0) | (side[i] != side[j]))
        i, j, most = i[keep], j[keep], most[keep]
        least = np.minimum(words[i], words[j])
        for w, (place, folded) in level.items():
            of = np.flatnonzero(least == w)
            for part in np.array_split(of, -(-len(of) * w // WORDS) or 1):
                a, b = i[part], j[part]
                ok = np.bitwise_count(folded[place[a]] ^ folded[place[b]]).sum(axis=1, dtype=np.int64) <= most[part]
                hit[a[ok]] = hit[b[ok]] = True
        at = to
    return hit


def sifted(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """``home, lo, hi, b, rep`` of the rows with a possible partner, from ``home, lo, hi, b, rep, n, bits`` in order."""

    def of(t: pa.Table) -> tuple[np.ndarray, ...]:
        return tuple(np.asarray(t.column(k).combine_chunks()) for k in range(6))

    def sift(t: pa.Table) -> pa.RecordBatch:
        home, lo, hi, b, rep, n = of(t)
        change = (home[1:] != home[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        cells = np.concatenate([[0], np.cumsum(change)])
        hit = near(cells, np.where(lo == hi, -1, b), n.astype(np.int64), t.column("bits").to_pylist(), num, den)
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (home, lo, hi, b, rep)], names=["home", "lo", "hi", "b", "rep"])

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        home, lo, hi, *_ = of(t)
        whole = np.flatnonzero((home != home[-1]) | (lo != lo[-1]) | (hi != hi[-1])) if len(home) else home
        end = int(whole[-1]) + 1 if len(whole) else 0  # the last cell may go on
        if end:
            yield sift(t.slice(0, end))
        rest = t.slice(end)
    if rest is not None and rest.num_rows:
        yield sift(rest)


def frequencies(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunk, bucket, classes``: the power of two of the number of sets that hold an item, one byte for
    each of a chunk's different codes in a bucket, in their order; 0 means one set."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sets in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, counts = np.unique(np.concatenate([coded(unpacked(x.as_py()), buckets) for x in sets.values]), return_counts=True)
                at = (codes >> np.uint64(32)).astype(np.int64)
                bounds = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(codes)]
                low = codes.astype(np.uint32)
                data = [planes(np.concatenate([np.diff(low[i:j], prepend=np.uint32(0)), counts[i:j].astype(np.uint32)])) for i, j in zip(bounds, bounds[1:])]
                own = at[bounds[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), chunk), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "chunk", "codes"])

    def answer(t: pa.Table) -> pa.RecordBatch:
        asked = [from_planes(x.as_py(), np.uint32).reshape(2, -1) for x in t.column("codes")]
        codes = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in asked])
        _, at = np.unique(codes, return_inverse=True)
        df = np.bincount(at, weights=np.concatenate([x[1] for x in asked]))
        classes = np.floor(np.log2(df)).astype(np.uint8)[at]
        parts = np.split(classes, np.cumsum([x.shape[1] for x in asked])[:-1])
        arrays = [t.column("chunk").combine_chunks(), t.column("bucket").combine_chunks(), pa.array([planes(x) for x in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["chunk", "bucket", "classes"])

    asked = chunks.select("chunk", "sets").mapInArrow(ask, "bucket int, chunk long, codes binary").repartition("bucket").sortWithinPartitions("bucket")
    return asked.mapInArrow(lambda batches: _counted(batches, 0, answer), "chunk long, bucket int, classes binary")


def prefixes(chunks: DataFrame, buckets: int, *, num: int, den: int) -> DataFrame:
    """``rep, n, packed, bits, prefix``: the rarest items of each set, one of which any set similar to it has
    among its own rarest; sets that cannot have a partner are left out.

    The global order is the class of an item's frequency, then its hash."""

    def pick(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        reps, sizes, data = (chunk.column(c)[0].as_py() for c in ("reps", "sizes", "sets"))
        sets = [unpacked(x) for x in data]
        flat = np.concatenate(sets)
        codes, at = np.unique(coded(flat, buckets), return_inverse=True)
        parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("classes").to_pylist()))
        classes = np.concatenate([from_planes(x, np.uint8) for _, x in parts])
        if len(classes) != len(codes):
            raise ValueError(f"{len(codes)} codes were asked for, {len(classes)} answered")
        of = classes[at]
        ends = np.cumsum(sizes)
        keep, bits, picked = [], [], []
        for k, (s, n, end) in enumerate(zip(sets, sizes, ends)):
            c = of[end - n : end]
            shared = c > 0
            most = int(np.count_nonzero(shared)) + (-num * n) // den + 1  # items of a single set never match
            if most > 0:
                keep.append(k)
                bits.append(parities(s))
                s, c = s[shared], c[shared]
                picked.append(s[np.argsort(c, kind="stable")[:most]])
        arrays = [pa.array([reps[k] for k in keep], pa.int64()), pa.array([sizes[k] for k in keep], pa.int32()), pa.array([data[k] for k in keep], pa.binary()), pa.array(bits, pa.binary())]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in picked])]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(picked) if picked else np.zeros(0, np.int64))))
        return pa.Table.from_arrays(arrays, names=["rep", "n", "packed", "bits", "prefix"])

    both = chunks.groupBy("chunk").cogroup(frequencies(chunks, buckets).groupBy("chunk"))
    return both.applyInArrow(pick, "rep long, n int, packed binary, bits binary, prefix array<long>")


def trie_join(heads: DataFrame, *, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """All pairs of sets with Jaccard similarity ``num/den`` or more.

    ``heads(rep bigint, n, packed)``: distinct sets of n items, see :func:`coppice.llm.shingles.packed`.
    Returns ``rep_a, rep_b, overlap, n_a, n_b`` with rep_a < rep_b, each pair once. Exact: no candidate
    is capped or sampled. Empty sets have no partner. Homes of more than ``block`` sets are cut into
    cells of two blocks; a home of c sets reads each set ceil(c / block) times, which is the price of
    exactness. All joins shuffle: what is joined here grows with the data, and its size is not what a
    file's size suggests.
    """
    spark, most = heads.sparkSession, CHUNK
    chunks = written(heads.where("n > 0").select("rep", "n", "packed").mapInArrow(lambda batches: chunked(batches, most), "chunk long, items long, reps array<long>, sizes array<int>, sets array<binary>"))
    swept(spark)
    buckets = max(BUCKETS, (chunks.agg(F.sum("items")).first()[0] or 0) // BUCKET)
    lists = written(prefixes(chunks, buckets, num=num, den=den))
    dropped(chunks)
    swept(spark)
    item = Window.partitionBy("s")
    met = lists.select("rep", F.explode("prefix").alias("s")).select("rep", F.min("rep").over(item).alias("home"), F.count("*").over(item).alias("c")).where("c > 1")
    homes = written(met.select("rep", "home").repartition("rep").groupBy("rep").agg(F.collect_set("home").alias("homes")))
    swept(spark)
    at_home = homes.select("rep", F.explode("homes").alias("home"))
    crowd = written(at_home.groupBy("home").agg(F.count("*").alias("c")).where("c > 1").select("home", "c", F.ceil(F.col("c") / block).cast("int").alias("k")))
    each, whole = lists.agg(F.avg(F.octet_length("bits")), F.sum(F.octet_length("packed"))).first()
    rounds = max(1, math.ceil((crowd.agg(F.sum(F.col("c") * F.col("k"))).first()[0] or 0) * ((each or 0) + 40) / max(ROUND, SHARE * (whole or 0))))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(F.col("b"), j).alias("lo"), F.greatest(F.col("b"), j).alias("hi"))))
    left = []
    for k in range(rounds):
        now = F.pmod(F.xxhash64("home"), F.lit(rounds)) == k
        sent = at_home.where(now).join(shuffled(crowd.where(now)), "home").withColumn("b", F.pmod(F.xxhash64("rep"), F.col("k").cast("long")).cast("int")).select("rep", "home", "b", cell.alias("cell"))
        sent = sent.select("rep", "home", "b", "cell.lo", "cell.hi").join(shuffled(lists.select("rep", "n", "bits")), "rep")
        sent = sent.select("home", "lo", "hi", "b", "rep", "n", "bits").repartition("home", "lo", "hi").sortWithinPartitions("home", "lo", "hi")
        left.append(written(sent.mapInArrow(lambda batches: sifted(batches, num, den), "home long, lo int, hi int, b int, rep long")))
        swept(spark)
    dropped(crowd)
    routed = reduce(DataFrame.unionAll, left).join(shuffled(lists.select("rep", "n", "packed")), "rep").join(shuffled(homes), "rep")
    routed = routed.select("home", "lo", "hi", "b", "rep", "n", "packed", "homes").repartition("home", "lo", "hi").sortWithinPartitions("home", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[pa.RecordBatch] = []
        held_key = None

        def close() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held_rows)
            if t.num_rows < 2:
                return None
            home, lo, hi = held_key
            keys, sizes, b = (np.asarray(t.column(c).combine_chunks()) for c in ("rep", "n", "b"))
            places = [set(h) for h in t.column("homes").to_pylist()]
            sets = [unpacked(x.as_py()) for x in t.column("packed")]
            found = join_cell(keys, sizes.astype(np.int64), sets, b if lo != hi else None, num, den)
            # a pair that meets at several homes is reported at the smallest of them
            found = [f for f in found if min(places[f[0]] & places[f[1]], default=home) == home]
            if not found:
                return None
            i, j, o = (np.array(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(keys[j]), pa.array(o, pa.int32()), pa.array(sizes[i]), pa.array(sizes[j])], names=["rep_a", "rep_b", "overlap", "n_a", "n_b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [np.asarray(batch.column(k)) for k in range(3)]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for at, to in zip(bounds, bounds[1:]):
                key = tuple(int(x[at]) for x in ids)
                if key != held_key and held_rows:
                    if (out := close()) is not None:
                        yield out
                    held_rows = []
                held_key = key
                held_rows.append(batch.slice(at, to - at))
        if held_rows and (out := close()) is not None:
            yield out

    pairs = written(routed.mapInArrow(run, "rep_a long, rep_b long, overlap int, n_a int, n_b int"))
    dropped(lists, homes, *left)
    return pairs


def expand(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Pairs of keys from pairs of classes plus the pairs within classes: ``a, b`` with a < b."""
    within = members.select(F.col(key).alias("a"), "rep").join(shuffled(members.select(F.col(key).alias("b"), "rep")), "rep").where("a < b").select("a", "b")
    left = members.select(F.col(key).alias("x"), F.col("rep").alias("rep_a"))
    right = members.select(F.col(key).alias("y"), F.col("rep").alias("rep_b"))
    across = pairs.select("rep_a", "rep_b").join(shuffled(left), "rep_a").join(shuffled(right), "rep_b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return within.union(across)
