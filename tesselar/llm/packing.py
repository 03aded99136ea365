"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized in place; only those longer than a sequence are cut.  Packing then works on the
histogram of piece lengths (at most `cap` rows whatever the corpus): a bin takes the longest piece left, is
filled greedily with the longest pieces that fit, and its smallest piece is replaced by two unpacked pieces
that fit the expanded gap more tightly.  A bin pattern is repeated as often as the histogram allows, so the plan
has a few thousand patterns at most and is broadcast.  Pieces find their place by their rank among the pieces of
their length, counted by (block, length) and prefix sums, so that one frequent length isn't ranked in one task.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesselar.llm.bpe_automaton import WORDS, byte_letters
from tesselar.llm.common import shuffle_partitions, slices, stored

CAP = 2048
END_ID = 0


def tokenizer(path: str):
    """text -> ids of a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit integers.

    The ids of such a file are in the order of its merges, so they serve as tiktoken's ranks, which encodes the
    same ids about three times as fast; texts that its pattern matcher gives up on go through tokenizers.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_padding()
    slow.no_truncation()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> bytes:
        try:
            ids = fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # noqa: BLE001  a limit of the matcher on extreme texts
            ids = np.array(slow.encode(text, add_special_tokens=False).ids)
        return ids.astype("<u4").tobytes()

    return encode


_tokenizers: dict[str, object] = {}


def pieces(docs: DataFrame, tokenizer_path: str, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc) of every row: its ids and END_ID, cut if longer than cap."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizers.get(tokenizer_path) or _tokenizers.setdefault(tokenizer_path, tokenizer(tokenizer_path))
        for b in slices(batches):
            rows: list[tuple] = []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n % cap or cap
                for k, hi in enumerate(range(first, n + 1, cap)):
                    lo = max(0, hi - cap) if k else 0
                    rows.append((id_, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])))
            cols = zip(*rows) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "piece", "start", "length", "crc"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, crc long")


def plan(counts: dict[int, int], cap: int = CAP) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), covering counts exactly."""
    left = Counter({n: c for n, c in counts.items() if c})
    sizes = sorted(left)  # lengths that are still there
    bins = []
    while sizes:
        took: Counter = Counter()

        def fitting(gap: int) -> int:
            """The longest unpacked length that fits the gap, or 0."""
            k = bisect.bisect_right(sizes, gap) - 1
            while k >= 0 and left[sizes[k]] <= took[sizes[k]]:
                k -= 1
            return sizes[k] if k >= 0 else 0

        items, gap = [], cap
        while gap and (n := fitting(gap)):
            items.append(n)
            took[n] += 1
            gap -= n
        if gap and len(items) > 1:
            small = items[-1]
            took[small] -= 1
            best = (small, 0, 0)
            for k in range(bisect.bisect_right(sizes, small + gap) - 1, -1, -1):
                a = sizes[k]
                if 2 * a <= best[0]:  # a is the longer one
                    break
                if left[a] <= took[a]:
                    continue
                took[a] += 1
                b = fitting(min(a, small + gap - a))
                took[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == small + gap:
                        break
            replaced = [best[1], best[2]] if best[1] else [small]
            items[-1:] = replaced
            took.update(replaced)
        need = Counter(items)
        times = min(left[n] // k for n, k in need.items())
        bins.append((items, times))
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del sizes[bisect.bisect_left(sizes, n)]
    return bins


def slots(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset) of each slot of each pattern."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for items, times in bins:
        offset = 0
        for n in items:
            out.append((n, rank[n], times, sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return out


def best_fit(
    docs: DataFrame, tokenizer_path: str, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id END_ID.  Null ids pack like others; repeated rows are packed once
    each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    found = stored(pieces(docs, tokenizer_path, cap, id_col, text_col), "pieces")
    blocks = max(shuffle_partitions(spark), -(-found.count() // 100_000))
    found = found.withColumn("block", F.pmod(F.xxhash64("id", "piece", "start"), F.lit(blocks)).cast("int"))
    per_block = found.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    per_block = stored(per_block.withColumn("before", F.coalesce(before, F.lit(0))), "piece-counts")
    counts = per_block.groupBy("length").agg(F.sum("n")).collect()  # at most cap rows
    placed = slots(plan({n: c for n, c in counts}, cap))
    place = spark.createDataFrame(placed, "length long, first_rank long, times long, first_sequence long, offset long")
    nth = F.row_number().over(W.partitionBy("block", "length").orderBy("id", "piece", "crc"))
    ranked = found.withColumn("nth", nth).join(per_block.select("block", "length", "before"), ["block", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1)
    at = (ranked["length"] == place["length"]) & (ranked["rank"] >= place["first_rank"]) & (ranked["rank"] < place["first_rank"] + place["times"])
    return ranked.join(F.broadcast(place), at).select(
        F.col("id").alias(id_col), "piece", "start", ranked["length"], F.col("crc").alias("ids_crc32"),
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset",
    )
