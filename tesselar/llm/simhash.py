"""SimHash fingerprints and near-duplicate components through sharded BK-trees.

Fingerprints within `radius` bits agree in full on at least `agree` of `radius + agree` blocks, so every
combination of `agree` blocks is a shard key and linked fingerprints meet in a shard.  Each shard is a BK-tree
(children keyed by their integer Hamming distance to the parent); a search follows only edges whose distance is
within the radius of the query's.  A shard tree stays with the task that owns the shard: trees of all shards
grow with the data and are never broadcast whole.  Shards of more than `shard_rows` distinct fingerprints are
split again by combinations of finer blocks, which is exact as well.  A shard emits a spanning star of its
links instead of all pairs.  Components come from rounds of minimum hooking on the contracted graph, each
round a written table.

Near copies by Jaccard similarity take further candidates from MinHash bands over the five-word shingles, because
a SimHash differs by some ten bits at similarity 0.8: too far for block keys.  Candidates are thinned out by short
sketches, so that only texts that are very likely near copies are fetched for the exact check.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import WHITE, ascii_lower, dropped, fresh, join_stats, slices, stored
from tesselar.llm.exact_dedup import HitFilter

SEED = 42
SHARD_ROWS = 4000
#: Texts of Jaccard similarity s share one of BANDS keys of BAND_ROWS minima with probability 1 - (1 - s^5)^32: all but
#: 3 in a million at 0.8.
BANDS, BAND_ROWS = 32, 5
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 31, (BANDS * BAND_ROWS, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
#: A sketch holds a byte of every other minimum; a pair whose sketches agree SIGMAS deviations less than expected at the
#: similarity (3 in ten million of such pairs) is no candidate.
SKETCH, SIGMAS = BANDS * BAND_ROWS // 2, 6
#: Members of a band that a task holds at a time.
CHUNK = 1024
#: Shingles that a task holds at a time.
HELD_SHINGLES = 1 << 20


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """The XXH64 of word shingles, A-Z lower-cased, repeats included; fewer words make one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words] if words else []
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64)


def simhash(h: np.ndarray) -> int:
    """64-bit SimHash of hashes; 0 for none."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over the XXH64 of word shingles, A-Z lower-cased, repeats included; 0 for a text without words."""
    return simhash(shingle_hashes(text, width))


def minima(h: np.ndarray) -> np.ndarray:
    """BANDS * BAND_ROWS MinHash values of a set of hashes."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1 << 12):
        np.minimum(least, (low[at : at + (1 << 12)] * _MULTIPLIERS).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """BANDS keys (signed longs), each of BAND_ROWS minima."""
    raw, n = least.astype("<u4").tobytes(), 4 * BAND_ROWS
    return np.array([xxhash.xxh64_intdigest(raw[k * n : (k + 1) * n], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every row; fingerprints are signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64), pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, h, fp, size, bands, sketch) of every row: h is a hash of the text, fp the SimHash of its two-word shingles,
    the rest describes its set of shingles of width words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps, sizes, bands, sketch = [], [], [], []
            for t in b.column(2).to_pylist():
                fps.append(simhash(shingle_hashes(t, 2)))
                h = np.unique(shingle_hashes(t, width))
                least = minima(h)
                sizes.append(len(h))
                bands.append(band_keys(least))
                sketch.append(least[::2].astype(np.uint8).tobytes())  # low bytes: minima are small
            fp = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            more = [pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, *more], ["id", "h", "fp", "size", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, h long, fp long, size long, bands array<long>, sketch binary")


class BKTree:
    """A BK-tree of 64-bit codes under Hamming distance."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> None:
        self.codes.append(code)
        self.children.append({})
        at, new = 0, len(self.codes) - 1
        while new:
            d = (self.codes[at] ^ code).bit_count()
            below = self.children[at]
            if d not in below:
                below[d] = new
                return
            at = below[d]

    def within(self, code: int, radius: int) -> list[int]:
        """Places of the codes at most radius away."""
        found, todo = [], [0] if self.codes else []
        while todo:
            at = todo.pop()
            d = (self.codes[at] ^ code).bit_count()
            if d <= radius:
                found.append(at)
            below = self.children[at]
            todo += [c for e, c in below.items() if d - radius <= e <= d + radius]
        return found


def shard_links(ids: list[int], codes: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest (id, id of one within the radius) of each group of linked codes."""
    tree, root, found = BKTree(), list(range(len(codes))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, code in enumerate(codes):
        for j in tree.within(code, radius):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((ids[i], ids[j]))
        tree.add(code)
    return found


def _block_keys(fp: Column, radius: int, agree: int, within: Column | None = None) -> Column:
    """The shard keys of a fingerprint, one per combination of `agree` of its `radius + agree` blocks.

    Two fingerprints within the radius differ in at most `radius` blocks, so they share a key.  With `within`,
    the keys hold inside that shard only.
    """
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    block = lambda i: F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    first = [within] if within is not None else []
    return F.array(*[F.xxhash64(*first, F.lit(k), *[block(i) for i in c]) for k, c in enumerate(combinations(range(n), agree))])


def links(codes: DataFrame, radius: int = 2, agree: int = 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b) links among the distinct fingerprints of codes(id, fp), enough to span each component.

    Both ends of a link are within the radius, whatever the size of the shards.
    """
    shards = codes.select("id", "fp", F.explode(_block_keys(F.col("fp"), radius, agree)).alias("key"))
    several = shards.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = shards.join(several, "key")
    # a hot shard is split by finer blocks: more of them have to agree, within the shard
    finer = F.explode(_block_keys(F.col("fp"), radius, agree + 1, F.col("key"))).alias("key")
    hot = rows.where(F.col("n") > shard_rows).select("id", "fp", finer)
    rows = rows.where(F.col("n") <= shard_rows).select("id", "fp", "key").unionByName(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, codes_ = None, [], []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            found: list[tuple[int, int]] = []
            i, c, k = (x.to_numpy() for x in b.columns)
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
                if lo == hi:
                    continue
                if k[lo] != key:
                    found += shard_links(ids, codes_, radius)
                    key, ids, codes_ = k[lo], [], []
                ids += i[lo:hi].tolist()
                codes_ += c[lo:hi].view(np.uint64).tolist()
            yield out(found)
        yield out(shard_links(ids, codes_, radius))

    dealt = rows.repartition("key").sortWithinPartitions("key", "id")
    return dealt.select("id", "fp", "key").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) that isn't the smallest of its component, root being that.

    Minimum hooking on the contracted graph: every root takes its smallest neighbour as parent, parents are
    shortened by pointer jumping, and edges move to the roots of their ends until none joins two roots.
    """
    labels = None
    edges = stored(edges.where("a != b"), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("p")).where("p < a")
        up = stored(up.select(F.col("a").alias("node"), F.col("p").alias("root")), "hooks")
        for _ in range(3):
            far = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            up = up.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
        up = stored(up, "hooks")
        moved = edges
        for end in ("a", "b"):
            to = up.select(F.col("node").alias(end), F.col("root").alias("to"))
            moved = moved.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = stored(moved.where("a != b").distinct(), "edges")
        if labels is None:
            labels = up
        else:
            to = up.select(F.col("node").alias("root"), F.col("root").alias("to"))
            old = labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = stored(old.unionByName(up.join(labels.select("node"), "node", "left_anti")), "labels")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, agree: int = 1, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null and empty texts have fingerprint zero, which links like any other.  Rows with a null id get a
    fingerprint, but neither link nor count in a component (component_id null); repeated rows are alike; an empty
    table gives no rows; other columns are ignored.
    """
    found = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    codes = stored(found.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "codes")
    roots = components(links(codes.select("id", "fp"), radius, agree, shard_rows))
    stats = codes.join(roots, codes["id"] == roots["node"], "left").select("fp", "n", F.coalesce("root", "id").alias("component_id"))
    out = join_stats(found.where("id IS NOT NULL"), stored(stats, "code-components"), ["fp"], "n", found.count()).select("id", "fp", "component_id")
    out = out.unionByName(found.where("id IS NULL").select("id", "fp", F.lit(None).cast("long").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_shingles(rows: DataFrame, text_col: str, width: int = 5) -> DataFrame:
    """rows with `shingles`, the distinct 64-bit hashes of the word shingles of text_col, A-Z lower-cased; fewer
    words make one shingle."""
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), WHITE + "+"), lambda w: w != "")
    rows = rows.withColumn("__words", words)  # a column of its own, so that it is split once a row
    last = F.greatest(F.size("__words") - width, F.lit(0))
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice("__words", i + 1, F.lit(width)), " ")))
    return rows.withColumn("shingles", F.array_distinct(grams)).drop("__words")


def shingle_sets(rows: DataFrame, text_col: str, width: int = 5) -> DataFrame:
    """(row, size, shingles) of rows(row, text_col): the distinct hashes of the shingles in order, as bytes, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, width)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["row", "size", "shingles"])

    return rows.select("row", text_col).mapInArrow(run, "row long, size long, shingles binary")


def _least(similarity: float) -> float:
    """In how many bytes the sketches of texts of the similarity agree at least."""
    return SKETCH * similarity - SIGMAS * np.sqrt(SKETCH * similarity * (1 - similarity))


def _agreement(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """In how many bytes the sketches of each pair agree."""
    return (np.frombuffer(b"".join(one), np.uint8) == np.frombuffer(b"".join(other), np.uint8)).reshape(-1, SKETCH).sum(axis=1)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], ["a", "b"])


def neighbours(members: DataFrame) -> DataFrame:
    """Distinct (a, b): each member of members(key, row, n) with the two before it in its key, or its part of a large one.

    A key of more than CHUNK members is cut into parts in two ways, so that no task holds it and its parts are joined.
    """
    parts = F.when(F.col("n") > CHUNK, F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / CHUNK)))).otherwise(1).cast("int")
    ways = F.when(F.col("n") > CHUNK, F.array(F.pmod(F.xxhash64("row"), parts), F.pmod(F.xxhash64("row", F.lit(1)), parts) + parts)).otherwise(F.array(F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [(None, 0), (None, 0)]
        for batch in batches:
            a, b = [], []
            for key, part, row in zip(*(c.to_pylist() for c in batch.columns)):
                for k, i in last:
                    if k == (key, part):
                        a.append(row), b.append(i)
                last = [last[1], ((key, part), row)]
            yield _pairs(a, b)

    dealt = members.select("key", F.explode(ways).alias("part"), "row").repartition("key", "part").sortWithinPartitions("key", "part", "row")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _met(members: DataFrame, *more: str) -> DataFrame:
    """(key, salt, block, side, row, root, size, *more) of members of keys that have several roots, dealt and sorted by the
    first four: the members outside the key's most frequent root (side 0) before the members that they are compared
    with, all of the key (side 1).

    A large key is cut both ways, so no task holds more than about CHUNK members or HELD_SHINGLES of side 0.  In a key that
    isn't cut, members of side 0 come once, as side -1, and _dealt() gives them for both sides.
    """
    per = members.groupBy("key", "root").agg(F.count("*").alias("k"), F.sum("size").alias("w")).groupBy("key")
    per = per.agg(F.sum("k").alias("n"), F.sum("w").alias("weight"), F.max(F.struct("k", "root", "w")).alias("major"), F.count("*").alias("roots"))
    rows = members.join(per.where("roots > 1"), "key")
    salts, blocks = (F.ceil(c).cast("int") for c in (F.col("n") / CHUNK, F.greatest((F.col("n") - F.col("major.k")) / CHUNK, (F.col("weight") - F.col("major.w")) / HELD_SHINGLES)))
    own = lambda of: F.pmod(F.xxhash64("row"), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    kept, cut = ("row", "root", "size", *more), (salts > 1) | (blocks > 1)
    held = rows.where("root != major.root").select("key", every(salts).alias("salt"), own(blocks).alias("block"), F.when(cut, 0).otherwise(-1).alias("side"), *kept)
    met = rows.where(cut | F.expr("root = major.root")).select("key", own(salts).alias("salt"), every(blocks).alias("block"), F.lit(1).alias("side"), *kept)
    return held.unionByName(met).repartition("key", "salt", "block").sortWithinPartitions("key", "salt", "block", "side")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, tuple]]:
    """((key, salt, block), side, the other columns) of each row of _met()."""
    again = []
    for b in slices(batches):
        key, salt, block, side, *columns = (c.to_pylist() for c in b.columns)
        for group, at, x in zip(zip(key, salt, block), side, zip(*columns)):
            if at == 1 and again:
                yield from ((group, 1, y) for y in again)
                again = []
            yield group, max(at, 0), x
            if at < 0:
                again.append(x)  # a key that isn't cut has rows of its most frequent root, so side 1 follows


def mixed_pairs(members: DataFrame, similarity: float, best: int) -> DataFrame:
    """(a, b, more) of members(key, row, root, size, sketch) of one key and different roots, whose sizes and sketches allow
    the similarity: for each member the `best` by sketch, and whether it has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []  # of (row, root, size, sketch)
        near: dict[int, list[tuple[int, int]]] = {}  # by held row: heaps of (agreement, row)
        overflowed: set[int] = set()
        one, other = [], []

        def weigh() -> None:
            agree = _agreement([x[3] for x in one], [y[3] for y in other])
            for i in np.flatnonzero(agree >= _least(similarity)).tolist():
                heap, item = near.setdefault(other[i][0], []), (int(agree[i]), one[i][0])
                if len(heap) < best:
                    heapq.heappush(heap, item)
                else:
                    heapq.heappushpop(heap, item)
                    overflowed.add(other[i][0])
            one.clear(), other.clear()

        def ended() -> pa.RecordBatch:
            if one:
                weigh()
            rows = [(max(x, y), min(x, y), y in overflowed) for y, heap in near.items() for _, x in heap]
            near.clear(), overflowed.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "more"])

        for k, side, x in _dealt(batches):
            if k != group:
                if near or one:
                    yield ended()
                group, held = k, []
            if side == 0:
                held.append(x)
                continue
            for y in held:
                if x[1] != y[1] and min(x[2], y[2]) >= similarity * max(x[2], y[2]):
                    one.append(x), other.append(y)
            if len(one) > 1 << 15:
                weigh()
        if near or one:
            yield ended()

    found = _met(members, "sketch").mapInArrow(run, "a long, b long, more boolean")
    return found.groupBy("a", "b").agg(F.max("more").alias("more"))


def close_members(members: DataFrame, similarity: float) -> DataFrame:
    """Distinct (key, row) of members(key, row, root, size, sketch, band, codes) that have in their key a member of another
    root whose size and sketch allow the similarity, and with which they share no band before the key's.

    As many rows as there are members at most, where their pairs may grow with the square of a key's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, close = None, [], {}  # close: places in held and rows of side 1, as an ordered set
        table: tuple[np.ndarray, ...] | None = None

        def ended() -> pa.RecordBatch:
            rows = list(close)
            close.clear()
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(rows), pa.int64()), pa.array(rows, pa.int64())], ["key", "row"])

        for k, side, x in _dealt(batches):
            if k != group:
                if close:
                    yield ended()
                group, held, table = k, [], None
            if side == 0:
                held.append(x)
                continue
            if not held:
                continue
            if table is None:
                row, root, size, sketch, _, codes = zip(*held)
                table = *(np.array(c, np.int64) for c in (row, root, size, codes)), np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, SKETCH)
            row, root, size, codes, sketch = table
            at = np.flatnonzero((root != x[1]) & (np.minimum(size, x[2]) >= similarity * np.maximum(size, x[2])))
            at = at[(sketch[at] == np.frombuffer(x[3], np.uint8)).sum(axis=1) >= _least(similarity)]
            at = at[~(codes[at, : x[4]] == np.array(x[5][: x[4]], np.int64)).any(axis=1)]
            if len(at):
                close.update(dict.fromkeys(row[at].tolist()))
                close[x[0]] = None
        if close:
            yield ended()

    return _met(members, "sketch", "band", "codes").mapInArrow(run, "key long, row long").distinct()


def mixed_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of members(key, row, root, size, shingles) of one key and different roots with a Jaccard similarity of at least
    `similarity`: enough of them to join the roots, so a task returns fewer than it has members.

    shingles holds the distinct 64-bit hashes, `size` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, index, found = None, [], None, []
        joined: dict[int, int] = {}

        def find(i: int) -> int:
            while (up := joined.get(i, i)) != i:
                joined[i] = i = joined.get(up, up)
            return i

        for k, side, x in _dealt(batches):
            if k != group:
                if found:
                    yield _pairs(*zip(*found))
                group, held, index, found, joined = k, [], None, [], {}
            if side == 0:
                held.append(x)
                continue
            if not held:
                continue
            if index is None:
                roots, sizes = (np.array([y[c] for y in held], np.int64) for c in (1, 2))
                codes = np.frombuffer(b"".join(y[3] for y in held), np.uint64)
                order = np.argsort(codes, kind="stable")
                index = codes[order], np.repeat(np.arange(len(held)), sizes)[order]
            codes, owner = index
            own = np.frombuffer(x[3], np.uint64)
            first = np.searchsorted(codes, own, "left")
            n = np.searchsorted(codes, own, "right") - first
            places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())  # all that equal a shingle of x
            both = np.bincount(owner[places], minlength=len(held))
            for i in np.flatnonzero((roots != x[1]) & (both >= similarity * (sizes + x[2] - both))).tolist():
                a, b = find(x[1]), find(held[i][1])
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    found.append((max(x[0], held[i][0]), min(x[0], held[i][0])))
        if found:
            yield _pairs(*zip(*found))

    return _met(members, "shingles").mapInArrow(run, "a long, b long").distinct()


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, radius: int = 2, agree: int = 2, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(id_col, text_hash, copies, component_id) of the rows of groups of near copies that don't stay.

    Two texts are linked if the Jaccard similarity of their five-word shingles is at least `similarity`; groups are the
    components of the links.  In each group the row with the smallest id stays (component_id; of equal ids that with
    the smallest text_hash; null ids come last).  A row is known by its id and the hash of its text, so texts of one
    id are told apart; of rows repeated with both one stays: copies counts them, and is more than one only for the
    row that stays.

    Candidates are linked neighbours in BK-trees of SimHash fingerprints (radius bits, two-word shingles) and in MinHash
    bands; their links are checked exactly.  Then all pairs that share a band and aren't in one component yet are
    checked too, so the groups depend neither on shards nor on the first candidates: each text first with the one most
    like it, as that joins a dense group, then all others within the tasks that hold their shingles, which return
    links and no pairs.
    """
    found = sketches(docs, id_col, text_col)
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "sketches")  # written once, then fixed
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("body"))

    def alike(edges: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = pa.array(_agreement(b.column(2).to_pylist(), b.column(3).to_pylist()) >= _least(similarity))
                yield pa.RecordBatch.from_arrays([b.column(k).filter(good) for k in (0, 1)], ["a", "b"])

        one, other = (found.select(F.col("row").alias(c), F.col("sketch").alias("s" + c), F.col("size").alias("n" + c)) for c in ("a", "b"))
        sized = edges.join(one, "a").join(other, "b").where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb"))
        return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")

    def bodies(rows: DataFrame) -> DataFrame:
        ends = stored(rows.distinct().join(found.select("row", "id", "h"), "row"), "ends")
        # the filter keeps most texts from being shuffled for the join
        some = HitFilter(ends.select(F.col("h").alias("digest"), F.lit(2).alias("n"))).probe(texts.withColumn("digest", F.col("h"))).where("maybe").select("id", "h", "body")
        return ends.join(some.withColumnsRenamed({"id": "of_id", "h": "of_h"}), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h"))).select("row", "body").dropDuplicates(["row"])

    def holding(edges: DataFrame) -> DataFrame:
        body = bodies(edges.select(F.col("a").alias("row")).unionByName(edges.select(F.col("b").alias("row"))))
        sets = stored(with_shingles(body, "body").select("row", "shingles"), "shingles")
        one, other = (sets.select(F.col("row").alias(c), F.col("shingles").alias("s" + c)) for c in ("a", "b"))
        both = F.size(F.array_intersect("sa", "sb"))
        held = edges.join(one, "a").join(other, "b").where(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both))
        held = stored(held.select("a", "b"), "held-links")
        dropped(sets)
        return held

    codes = stored(found.groupBy("fp").agg(F.min("row").alias("id")), "codes")
    keys = F.concat(F.col("bands"), F.array(F.col("fp")))  # equal fingerprints are one more band
    bands = found.select("row", "size", F.posexplode(keys).alias("band", "code")).select("row", "size", "band", F.xxhash64("band", "code").alias("key"))
    counts = stored(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes")
    several = HitFilter(counts.withColumnRenamed("key", "digest"))
    bands = several.probe(bands.withColumn("digest", F.col("key"))).where("maybe").drop("maybe", "digest")
    bands = stored(join_stats(bands, counts, ["key"], "n", (BANDS + 1) * found.count()), "bands")
    first = stored(links(codes, radius, agree, shard_rows).unionByName(neighbours(bands)).distinct(), "candidate-links")
    tried = stored(alike(first), "candidate-links")
    held = holding(tried)
    roots = components(held)

    def mixed(some: str) -> DataFrame:
        rooted = bands.where(some).join(roots, bands["row"] == roots["node"], "left").select("key", "band", "row", "size", F.coalesce("root", "row").alias("root"))
        several = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
        return stored(rooted.join(several, "key"), "mixed-bands")

    for some in ("band < 4", "band >= 4"):  # the first bands join most of a group, which spares pairs in the others
        rooted = mixed(some)
        pairs = mixed_pairs(rooted.join(found.select("row", "sketch"), "row"), similarity, 1).select("a", "b")
        edges = stored(pairs.join(tried, ["a", "b"], "left_anti"), "candidate-links")
        dropped(rooted)
        tried = tried.unionByName(edges)
        more = holding(edges)
        if not more.isEmpty():
            held = held.unionByName(more)
            roots = components(held)
    rooted = mixed("true")
    close = stored(close_members(rooted.join(found.select("row", "sketch", keys.alias("codes")), "row"), similarity), "close-members")
    sets = stored(shingle_sets(bodies(close.select("row")), "body"), "shingles")
    more = stored(mixed_links(rooted.join(close, ["key", "row"]).select("key", "row", "root").join(sets, "row"), similarity), "held-links")
    if not more.isEmpty():
        roots = components(held.unionByName(more))
    for used in (rooted, close, sets):
        dropped(used)
    return _leaving(found, roots).select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "copies", "component_id")


def _leaving(found: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, h, copies, component_id) of rows that don't stay, and of rows that stay but are repeated."""
    named = found.select("row", "id", "h")
    groups = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = stored(groups.join(named, groups["node"] == named["row"]).select("root", "id", "h"), "near-groups")
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "h")
    per = members.groupBy("root").agg(F.min(order).alias("stays"))
    told = members.groupBy("root", "id", "h").agg(F.count("*").alias("copies")).join(per, "root")
    stays = F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("h") == F.col("stays.h"))
    return told.where(~stays | (F.col("copies") > 1)).select("id", "h", F.when(stays, F.col("copies")).otherwise(1).alias("copies"), F.col("stays.id").alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of docs that stay when near copies go, with all their columns: one of each group.

    Null and empty texts are alike (similarity 1) to one another, as null texts are among themselves.
    """
    gone = near_copies(docs, id_col, text_col, similarity, shard_rows=shard_rows)
    gone = stored(gone.select(F.col(id_col).alias("gone_id"), F.col("text_hash").alias("gone_hash"), "copies"), "near-copies")
    i, h = fresh(docs, "id"), fresh(docs, "h")
    rows = docs.withColumns({i: F.col(id_col).cast("long"), h: F.xxhash64(F.col(text_col))})
    on = lambda some: rows[i].eqNullSafe(some["gone_id"]) & (rows[h] == some["gone_hash"])
    kept = rows.join(gone, on(gone), "left_anti")
    again = gone.where("copies > 1")
    if not again.isEmpty():
        kept = kept.unionByName(rows.join(again, on(again), "left_semi").dropDuplicates([i, h]))
    return kept.drop(i, h)
