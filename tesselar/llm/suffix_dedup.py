"""Repeated-substring removal over distributed, sampled suffix arrays of raw bytes.

A byte goes if a WINDOW-byte string over it also starts in a document with a smaller id.

1. Anchored suffixes.  Every window picks the position of its least GRAM-byte gram (by hash, leftmost first), so
   equal windows pick equal grams at equal offsets.  A maximal run of windows with one anchor is a segment; a
   document's windows are partitioned into segments of some 20 windows.  Anchored suffixes are range-partitioned
   by their leading two words (of eight bytes; the second cuts frequent first ones) with splitters from a bounded
   sample of anchors, and each bucket is sorted by multikey quicksort: in suffix order of these words, then by the
   segment and the id.  Splitters cut between suffixes of different words, so suffixes on the two sides of a boundary
   have no window in common and the comparison of neighbours ends there.  A segment that a smaller id has too is
   covered as a whole.  Before the shuffle, each task keeps just the smallest id of a segment it has met, so a group
   that holds a third of all rows arrives as one record per task.
2. Suffixes at the edges of matches.  Where one anchor has different segments whose bytes to its left or right
   agree, their windows may still be shared in part.  These windows, of the smallest id of each such segment, are
   the suffixes of a second array, in the order of their first word and a 64-bit hash of the rest of the window, with
   the same splitters and multikey quicksort, and a suffix that a smaller id has is marked.
3. Marks and covered segments meet their document, overlapping spans are merged and cut out.

Segments are compared by 56-bit hashes among those of the same 16 leading bytes, windows by 64-bit hashes among those of
the same first word; nothing is capped.  Texts are shuffled once (2 and 3 share the exchange).  Partitions grow in number
with the data.  Long texts are worked on in pieces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import shuffle_partitions, slices, stored

WINDOW = 50
GRAM = 16
SPAN = WINDOW - GRAM + 1  # anchor positions of a window
PIECE = 1 << 18  # bytes worked on at a time
FLUSH = 300_000  # records gathered before they are dealt to buckets
BUCKET = 500_000  # records of a bucket, about
TEXT_BYTES = 64 << 20  # texts of a partition, about
SAMPLE_DOCS, SAMPLE_ANCHORS = 2000, 40_000

_U = np.uint64
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse modulo 2^64."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            _powers.append(np.cumprod(np.r_[_U(1), np.full(PIECE + WINDOW + 8, base, np.uint64)], dtype=np.uint64))
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def words_at(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a little-endian word (zeros past the end)."""
    n = len(b)
    padded = np.concatenate([b, np.zeros(16, np.uint8)])
    rows = n // 8 + 1
    out = np.empty((rows, 8), np.uint64)
    for r in range(8):
        out[:, r] = padded[r : r + 8 * rows].view("<u8") if r + 8 * rows <= len(padded) else 0
    return out.reshape(-1)[:n]


class Segments:
    """Segments of a piece: window starts [start, start + n), anchor, hashes; positions are those of the piece."""

    def __init__(self, b: np.ndarray, ends: np.ndarray) -> None:
        """b: bytes of texts of at least WINDOW bytes, one after another; ends: where each ends in b."""
        w = words_at(b)
        gram = _mixed(w[:-8] * _U(0x9E3779B97F4A7C15) + w[8:] * _U(0xC2B2AE3D27D4EB4F))
        place = _U((1 << 21) - 1)
        least = (gram[: len(b) - GRAM + 1] & ~place) | np.arange(len(b) - GRAM + 1, dtype=np.uint64)
        size = 1
        while 2 * size <= SPAN:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
        ok = np.ones(len(least), bool)
        over = (ends[:-1, None] - np.arange(1, WINDOW)).ravel()
        ok[over] = False
        at = np.flatnonzero(ok)
        anchor = (least[at] & place).astype(np.int64)
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(at)] - 1
        self.start, self.n, self.anchor = at[first], at[last] - at[first] + 1, anchor[first]
        stop = self.start + self.n + WINDOW - 1
        power, inverse = _power_tables()
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power[: len(b)], dtype=np.uint64)])
        rolled = (total[stop] - total[self.start]) * inverse[self.start]
        self.hash = _mixed(rolled + (self.anchor - self.start).astype(np.uint64) * _U(0xD6E8FEB86659FD93) + self.n.astype(np.uint64)) >> _U(8)
        self.lead, self.next = w[self.anchor].byteswap(), w[self.anchor + 8].byteswap()
        # a shared window has 17 bytes or more in common on one side of the anchor
        side = lambda long, at: np.where(long, gram[np.clip(at, 0, len(gram) - 1)] % _U(255) + _U(1), _U(0))
        self.left = side(self.anchor - self.start >= 17, self.anchor - GRAM)
        self.right = side(stop - self.anchor - GRAM >= 17, self.anchor + GRAM)


def pieces(texts: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """(bytes, ends, row, offset in its text) of groups of texts or parts of texts, of about PIECE bytes.

    Parts of a text overlap by WINDOW - 1 bytes, so that each window lies in just one.
    """
    parts: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    total = 0

    def group() -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), list(rows), list(offsets)

    step = PIECE - WINDOW
    for row, text in texts:
        for at in range(0, len(text) - WINDOW + 1, step):
            part = text[at : at + step + WINDOW - 1]
            if total + len(part) > PIECE and parts:
                yield group()
                parts.clear(), rows.clear(), offsets.clear()
                total = 0
            parts.append(part)
            rows.append(row)
            offsets.append(at)
            total += len(part)
    if parts:
        yield group()


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: sort by the first word, then only the runs of equal words by the next, and so on."""
    order = np.argsort(words[0])
    if len(order) < 2:
        return order
    new = np.r_[True, np.diff(words[0][order]) != 0]
    for w in words[1:]:
        alone = new & np.r_[new[1:], True]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        run = np.cumsum(new)[tied]
        rows = order[tied]
        rows = rows[np.lexsort((w[rows], run))]
        order[tied] = rows
        new[tied[1:]] |= (w[rows[1:]] != w[rows[:-1]])
    return order


def changes(*words: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any word."""
    new = np.zeros(len(words[0]), bool)
    new[:1] = True
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    return new


def group_least(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The least value of each row's group; groups start where new."""
    starts = np.flatnonzero(new)
    return np.repeat(np.minimum.reduceat(values, starts), np.diff(np.r_[starts, len(values)])) if len(values) else values


_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of unsigned integers with their widths in bytes, byte plane by byte plane."""
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for c, width in columns]
    return _PACK.compress(b"".join(planes))


def unpack(blob: bytes, widths: list[int]) -> list[np.ndarray]:
    raw = np.frombuffer(_UNPACK.decompress(blob), np.uint8)
    n, at, out = len(raw) // sum(widths), 0, []
    for width in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(full.reshape(-1).view("<u8").astype(np.uint64))
        at += n * width
    return out


DEALT = "bucket int, ids binary, rows binary"
SPANS = "id long, v long, kind int, start long, size int"
ANCHOR_WIDTHS = [8, 8, 7, 3, 5, 1, 1, 1]  # leading words, segment, row, start, windows, left, right
SUFFIX_WIDTHS = [8, 8, 3, 5]  # leading bytes, hash of the rest, row, start


def _deal(bucket: np.ndarray, ids: list[tuple[int, int]], row: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, ids of the rows, packed columns); columns' row numbers are renumbered for the ids of the bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(changes(bucket[order])).tolist() + [len(order)]
    table = np.array(ids, np.int64).reshape(-1, 2)
    for lo, hi in zip(edges, edges[1:]):
        rows = order[lo:hi]
        used, local = np.unique(row[rows], return_inverse=True)
        packed = [(local.astype(np.uint64) if c is row else c[rows], width) for c, width in columns]
        yield int(bucket[rows[0]]), _PACK.compress(np.ascontiguousarray(table[used].T).tobytes()), pack(packed)


def _dealt(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "ids", "rows"])


def _gathered(batches: Iterator[pa.RecordBatch], widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(id, v, columns) of each bucket; rows come sorted by bucket."""
    bucket, held = None, []

    def joined() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        columns = [np.concatenate(c) for c in zip(*[cols for _, cols in held])]
        row = widths.index(3)
        keys = np.concatenate([ids[cols[row].astype(np.int64)] for ids, cols in held])
        return keys[:, 0], keys[:, 1], columns

    for batch in batches:
        for k, ids, rows in zip(*(c.to_pylist() for c in batch.columns)):
            if k != bucket and held:
                yield joined()
                held = []
            bucket = k
            held.append((np.frombuffer(_UNPACK.decompress(ids), np.int64).reshape(2, -1).T, unpack(rows, widths)))
    if held:
        yield joined()


def _spans(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    for id_, v, kind, start, size in parts:
        columns = [id_, v, np.full(len(id_), kind), start, size]
        for lo in range(0, len(id_), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000].astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types)], ["id", "v", "kind", "start", "size"])


def _texts(batch: pa.RecordBatch, versions: bool = False) -> list[tuple[int, int, bytes]]:
    """(id, v, text) of each row; v tells texts of one id apart, if there are such."""
    return [(i, zlib.crc32(t) if versions else 0, t) for i, t in zip(batch.column(0).to_pylist(), (x.encode("utf-8", "surrogatepass") if x else b"" for x in batch.column(1).to_pylist()))]


def two_words(lead: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The 16 leading bytes of suffixes, comparable as bytes."""
    return np.stack([lead, following], axis=1).astype(">u8").view("S16").ravel()


def splitters(rows: DataFrame, total: int, buckets: int) -> np.ndarray:
    """Leading words that cut the sampled anchors into buckets of even size; the sample is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, text in _texts(b):
                for raw, ends, _, _ in pieces([(0, text)]):
                    found = Segments(raw, ends)
                    step = max(1, len(found.lead) * SAMPLE_DOCS // SAMPLE_ANCHORS)
                    yield pa.RecordBatch.from_arrays([pa.array(w[::step].view(np.int64), pa.int64()) for w in (found.lead, found.next)], ["lead", "next"])

    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // SAMPLE_DOCS))) == 0)
    found = some.mapInArrow(run, "lead long, next long").limit(4 * SAMPLE_ANCHORS).toPandas()
    words = np.sort(two_words(*(found[c].to_numpy(np.int64).view(np.uint64) for c in ("lead", "next"))))
    return np.unique(words[np.arange(1, buckets) * len(words) // buckets]) if len(words) else np.zeros(0, "S16")


def covered_segments(rows: DataFrame, cuts: np.ndarray, buckets: int, versions: bool) -> DataFrame:
    """SPANS of kind 0 (covered bytes) and kind 1 (window starts to be compared one by one)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple[int, int]] = []
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            lead, following, seg, row, start, n, left, right = (np.concatenate(c) for c in zip(*held))
            key = np.array([i for i, _ in ids], np.int64)[row.astype(np.int64)]
            order = multikey_order([lead, following, seg, key])
            least = np.empty(len(order), np.int64)
            least[order] = group_least(changes(lead[order], following[order], seg[order]), key[order])
            keep = order[key[order] == least[order]]  # in suffix order, which packs well
            out = []
            if len(keep) < len(order):  # a smaller id of this task has the segment: covered, and told in passing
                gone = np.flatnonzero(key > least)
                table = np.array(ids, np.int64)[row[gone].astype(np.int64)]
                spans = np.stack([table[:, 0], table[:, 1], start[gone].astype(np.int64), (n[gone] + _U(WINDOW - 1)).astype(np.int64)])
                out.append((-1 - int(key[gone[0]]) % 997, b"", spans.tobytes()))
            edges = np.searchsorted(two_words(lead[keep], following[keep]), cuts)
            bucket = np.repeat(np.arange(len(cuts) + 1), np.diff(np.r_[0, edges, len(keep)]))
            row = row[keep]
            columns = [(row if c is None else c[keep], w) for c, w in zip((lead, following, seg, None, start, n, left, right), ANCHOR_WIDTHS)]
            out += _deal(bucket, ids, row, columns)
            held.clear()
            yield _dealt(out)

        for b in slices(batches):
            texts = _texts(b, versions)
            if not held:
                ids.clear()
            base = len(ids)
            ids += [(i, v) for i, v, _ in texts]
            for raw, ends, row, offset in pieces([(base + k, t) for k, (_, _, t) in enumerate(texts) if len(t) >= WINDOW]):
                s = Segments(raw, ends)
                part = np.searchsorted(ends, s.start, side="right")
                begin = np.r_[0, ends[:-1]]
                start = s.start - begin[part] + np.array(offset, np.int64)[part]
                held.append([s.lead, s.next, s.hash, np.array(row, np.uint64)[part], start.astype(np.uint64), s.n.astype(np.uint64), s.left, s.right])
                if sum(len(h[0]) for h in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt() -> Iterator[pa.RecordBatch]:
            for b in batches:
                settled = [k < 0 for k in b.column(0).to_pylist()]
                passing.extend(x for x, t in zip(b.column(2).to_pylist(), settled) if t)
                if not all(settled):
                    yield b.filter(pa.array([not t for t in settled]))

        def told() -> Iterator[pa.RecordBatch]:
            spans = [np.frombuffer(x, np.int64).reshape(4, -1) for x in passing]
            passing.clear()
            yield from _spans([(s[0], s[1], 0, s[2], s[3]) for s in spans])

        passing: list[bytes] = []
        for id_, v, (lead, following, seg, _, start, n, left, right) in _gathered(dealt(), ANCHOR_WIDTHS):
            yield from told()
            order = multikey_order([lead, following, seg, id_])
            lead, following, seg, left, right, id_, v, start, n = (c[order] for c in (lead, following, seg, left, right, id_, v, start.astype(np.int64), n.astype(np.int64)))
            least = group_least(changes(lead, following, seg), id_)
            gone, kept = id_ > least, np.flatnonzero(id_ == least)
            # anchors with several segments and several ids; of these, segments that agree with another on a side
            new = changes(lead, following)
            anchor = np.cumsum(new)
            several = group_least(new, least) != -group_least(new, -least)
            kept = kept[several[kept]]
            near = np.zeros(len(kept), bool)
            for side in (left, right):
                o = multikey_order([anchor[kept], side[kept], seg[kept]])
                rows = kept[o]
                new = changes(anchor[rows], side[rows])
                lo, hi = group_least(new, seg[rows].astype(np.int64)), -group_least(new, -seg[rows].astype(np.int64))
                near[o] |= (lo != hi) & (side[rows] > 0)
            kept = kept[near]
            yield from _spans([(id_[gone], v[gone], 0, start[gone], n[gone] + WINDOW - 1), (id_[kept], v[kept], 1, start[kept], n[kept])])
        yield from told()

    return rows.mapInArrow(deal, DEALT).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, SPANS)


def shared_suffixes(texts: DataFrame, wanted: DataFrame, cuts: np.ndarray, buckets: int, versions: bool) -> DataFrame:
    """SPANS (kind 0) of the wanted windows that a smaller id has too, by a suffix array of these windows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple[int, int]] = []
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            lead, following, tail, row, start = (np.concatenate(c) for c in zip(*held))
            columns = list(zip((lead, tail, row, start), SUFFIX_WIDTHS))
            out = list(_deal(np.searchsorted(cuts, two_words(lead, following), side="right"), ids, row, columns))
            ids.clear(), held.clear()
            yield _dealt(out)

        for b in slices(batches):
            asked = b.column(2).to_pylist()
            for (id_, v, text), spans in zip(_texts(b, versions), asked):
                spans = [s for s in spans if s["v"] == v]
                if not spans:
                    continue
                ids.append((id_, v))
                first = np.array([s["start"] for s in spans])
                count = np.array([s["size"] for s in spans])
                for lo in range(0, len(first), 20_000):
                    f, c = first[lo : lo + 20_000], count[lo : lo + 20_000]
                    at = np.repeat(f, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    raw = np.frombuffer(text, np.uint8)
                    # key words of a window: bytes from 0, 8, ..., the last word ending with the window
                    ends = [*range(0, WINDOW - 8, 8), WINDOW - 8]
                    lead, *rest = (np.ascontiguousarray(raw[at[:, None] + np.arange(e, e + 8)]).view(">u8").ravel().astype(np.uint64) for e in ends)
                    tail = rest[0]
                    for w in rest[1:]:
                        tail = _mixed(tail) * _U(0xD6E8FEB86659FD93) + w
                    held.append([lead, rest[0], _mixed(tail), np.full(len(at), len(ids) - 1, np.uint64), at.astype(np.uint64)])
                if sum(len(h[0]) for h in held) >= FLUSH // 2:
                    yield from flush()
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, v, (*words, _, start) in _gathered(batches, SUFFIX_WIDTHS):
            order = multikey_order(words)
            words, id_, v, start = [w[order] for w in words], id_[order], v[order], start[order].astype(np.int64)
            gone = id_ > group_least(changes(*words), id_)
            yield from _spans([(id_[gone], v[gone], 0, start[gone], np.full(int(gone.sum()), WINDOW))])

    per_doc = wanted.groupBy("id").agg(F.collect_list(F.struct("v", "start", "size")).alias("spans"))
    joined = texts.join(per_doc, "id").select("id", "body", "spans")
    return joined.mapInArrow(deal, DEALT).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, SPANS)


def merged(start: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of overlapping or touching spans."""
    if not len(start):
        return []
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate((start + size)[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return list(zip(start[new].tolist(), end[np.r_[new[1:], True]].tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the rest as binary).

    A null text is empty.  A row with a null id neither removes nor loses bytes.  Rows with the same id don't
    remove from each other, and repeated rows are alike; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    named = rows.where("id IS NOT NULL")
    total, size = named.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    buckets = max(2 * shuffle_partitions(spark), size * 2 // (SPAN + 1) // BUCKET)
    versions = not named.groupBy("id").count().where("count > 1").isEmpty()
    cuts = splitters(named, total, buckets)
    spans = stored(covered_segments(named, cuts, buckets, versions), "segments")
    texts = named.repartition(max(shuffle_partitions(spark), size // TEXT_BYTES), "id")
    marks = shared_suffixes(texts, spans.where("kind = 1"), cuts, buckets, versions)
    gone = spans.where("kind = 0").unionByName(marks).groupBy("id").agg(F.collect_list(F.struct("v", "start", "size")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists, out = b.column(2), []
            at = lists.offsets.to_numpy()  # into the whole batch's values
            v_, start, size = (lists.values.field(k).to_numpy().astype(np.int64) for k in range(3))
            for k, (id_, v, text) in enumerate(_texts(b, versions)):
                own = np.arange(at[k], at[k + 1]) if lists[k].is_valid else np.zeros(0, np.int64)
                own = own[v_[own] == v]
                runs = merged(start[own], size[own])
                kept = b"".join([text[lo:hi] for lo, hi in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(text)])])
                out.append((id_, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = texts.join(gone, "id", "left").select("id", "body", "spans")
    nameless = rows.where("id IS NULL").withColumn("spans", F.lit(None).cast("array<struct<v:bigint,start:bigint,size:int>>"))
    out = done.unionByName(nameless).mapInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
