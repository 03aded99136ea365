"""Exact deduplication over a log-structured merge index, in DataFrame functions only.

A task's rows are its memtable: it flushes them as one digest-sorted Parquet run, without a shuffle.  Compaction merges
the runs into one sorted level with a row per digest: the identifier that stays and the number of rows.  The level's
digests that several rows hit are put in a filter, a bitmap in SQL.  Rows are looked up in the filter first: those that
it turns away are alone, and their texts stay where they are.  The texts of the others meet by digest and are compared
byte for byte with that of the row that stays; rows that differ (digest collisions) are regrouped by their whole text.

Scale: the digests shuffle once (40 bytes a row, combined in the tasks first), texts shuffle once and only where the
filter has a hit.  The filter is at most FILTER_BITS large; with more hits it lets more rows through, which are then told
apart by the level.  Groups with more than 1/1000 of all rows are found in the level (at most 1000 of them) and salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesselar.llm.common import HOT_SHARE, ascii_lower, fresh, stored

#: Rows of a memtable at most.
MEMTABLE_ROWS = 4_000_000
#: Bits of the filter, for each hit and at most (64 MB).
BITS_PER_HIT, FILTER_BITS = 16, 1 << 29
BITMAP_BITS = 32768  # fixed by the bitmap functions


def keyed(docs: DataFrame, id_col: str, text_col: str, digest_chars: int, carry: bool = False) -> DataFrame:
    """(id, norm, sha, digest) of every row, with carry also the row itself as a struct."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    df = docs.select(F.col(id_col).alias("id"), text.alias("norm"), *row)
    df = df.withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    return df.withColumn("digest", F.substring("sha", 1, digest_chars // 2))


def flush(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Digest-sorted runs (id, sha, digest): one file per task and memtable_rows rows."""
    sorted_rows = rows.select("id", "sha", "digest").sortWithinPartitions("digest", "id")
    return stored(sorted_rows, "lsm-runs", maxRecordsPerFile=str(memtable_rows))


def compact(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The merged level: (digest, head, n), sorted by digest within its files."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    level = runs.groupBy("digest").agg(pick("id").alias("head"), F.count("*").alias("n"))
    return stored(level.sortWithinPartitions("digest"), "lsm-level")


def merge(levels: list[DataFrame], keep: str = "smallest") -> DataFrame:
    """One level of several, such as that of a new batch and the one before it."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    merged = every.groupBy("digest").agg(pick("head").alias("head"), F.sum("n").alias("n"))
    return stored(merged.sortWithinPartitions("digest"), "lsm-level")


class HitFilter:
    """A bitmap over the digests of a level that several rows hit."""

    def __init__(self, level: DataFrame) -> None:
        hits = level.where("n > 1")
        blocks = -(-BITS_PER_HIT * hits.count() // BITMAP_BITS)
        self.bits = BITMAP_BITS * max(1, min(blocks, FILTER_BITS // BITMAP_BITS))
        slot = self._slot()
        found = hits.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
        self.bitmaps = stored(found, "lsm-filter")  # at most FILTER_BITS / BITMAP_BITS rows of 4 KB

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.bits))

    def probe(self, rows: DataFrame) -> DataFrame:
        """rows with `maybe`: false only for digests that are no hits."""
        slot = self._slot()
        at = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.col("bitmap").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        probed = rows.withColumn("block", F.bitmap_bucket_number(slot)).join(F.broadcast(self.bitmaps), "block", "left")
        return probed.withColumn("maybe", F.coalesce(F.bit_get(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("block", "bitmap")


def _compared(rows: DataFrame, level: DataFrame, found: HitFilter, total: int) -> DataFrame:
    """The rows that pass the filter, with head, n and whether their text equals the head's byte for byte."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total, 1)))).cast("int")
    level = found.probe(level).where("maybe").select("digest", "head", "n", salts.alias("salts"))
    hot = level.where("salts > 1").select("digest", "salts", "head")  # at most HOT_SHARE rows, as their n sum up to total
    spread = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    held = found.probe(rows).where("maybe").drop("maybe")
    salted = held.join(F.broadcast(hot.select("digest", "salts")), "digest", "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("id", "sha"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts").withColumn("first", F.lit(False))
    if not hot.isEmpty():  # the text that stays goes to every part of a hot group
        heads = rows.join(F.broadcast(hot.select(F.col("digest").alias("hot"), F.col("head").alias("of"))), F.col("id").eqNullSafe(F.col("of")))
        heads = heads.where("digest = hot").groupBy("digest").agg(F.min("norm").alias("norm"))
        heads = heads.join(F.broadcast(hot), "digest").select("digest", "norm", spread, F.lit(True).alias("first"))
        salted = salted.unionByName(heads, allowMissingColumns=True)
    met = salted.join(level.select("digest", "head", "n", spread).hint("shuffle_merge"), ["digest", "salt"])
    order = W.partitionBy("digest", "salt").orderBy(F.desc("first"), F.desc(F.col("id").eqNullSafe(F.col("head"))), "norm").rowsBetween(W.unboundedPreceding, 0)
    met = met.withColumn("same", F.col("norm") == F.first("norm").over(order))
    return met.where("NOT first").drop("first", "salt")


def _decided(docs: DataFrame, id_col: str, text_col: str, keep: str, memtable_rows: int, digest_chars: int, carry: bool) -> tuple[DataFrame, DataFrame, HitFilter]:
    """Rows that pass the filter (id, sha, head, n, kept, and row if carry), the runs and the filter."""
    rows = keyed(docs, id_col, text_col, digest_chars, carry)
    runs = flush(rows, memtable_rows)
    level = compact(runs, keep)
    total = level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = HitFilter(level)
    row = ["row"] if carry else []
    checked = stored(_compared(rows, level, found, total).select("id", "sha", "digest", "head", "n", "same", *row), "lsm-verified")
    is_head = F.col("id").eqNullSafe(F.col("head"))
    good = checked.where("same").withColumn("kept", is_head)
    twice = good.where("kept").groupBy("digest").agg(F.count("*").alias("heads")).where("heads > 1")
    if not twice.isEmpty():  # rows repeated with their id: one of them stays
        twice = stored(twice, "lsm-repeated")
        nth = F.row_number().over(W.partitionBy("digest").orderBy("sha"))
        one = good.where("kept").join(twice.select("digest"), "digest", "left_semi").withColumn("kept", nth == 1)
        good = good.where("NOT kept").unionByName(good.where("kept").join(twice.select("digest"), "digest", "left_anti")).unionByName(one)
    bad = checked.where("NOT same")
    if not bad.isEmpty():
        pick = {"smallest": F.min, "largest": F.max}[keep]
        fewer = bad.groupBy("digest").agg(F.count("*").alias("others"))
        good = good.join(fewer, "digest", "left").withColumn("n", F.col("n") - F.coalesce("others", F.lit(0)))
        rows = rows.join(bad.select("digest").distinct(), "digest", "left_semi").join(level.select("digest", "head"), "digest")
        heads = rows.where(F.col("id").eqNullSafe(F.col("head"))).groupBy("digest").agg(F.min("norm").alias("head_norm"))
        apart = rows.join(heads, "digest").where("norm != head_norm").drop("head", "digest")
        groups = apart.groupBy("norm").agg(pick("id").alias("head"), F.count("*").alias("n"))
        nth = F.row_number().over(W.partitionBy("norm", "id").orderBy("sha"))
        apart = apart.withColumn("nth", nth).join(groups, "norm").withColumn("kept", F.col("id").eqNullSafe(F.col("head")) & (F.col("nth") == 1))
        out = ["id", "sha", "head", "n", "kept", *row]
        good = good.select(*out).unionByName(apart.select(*out))
    return good, runs, found


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    memtable_rows: int = MEMTABLE_ROWS,
    digest_chars: int = 64,
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  A null text counts as empty; an empty table gives no
    rows; other columns are ignored, whatever their names.  Null ids stay only where all ids of a group are null.
    Of rows repeated with the same id and text exactly one is kept.  digest_chars under 64 shortens the digest
    of the index (tests force collisions with it); results don't depend on it.
    """
    good, runs, found = _decided(docs, id_col, text_col, keep, memtable_rows, digest_chars, False)
    alone = found.probe(runs).where("NOT maybe").select("id", "sha", F.col("id").alias("head"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"))
    return good.select("id", "sha", "head", "n", "kept").unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("head").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        F.col("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; the texts of rows alone stay where they are."""
    good, _, found = _decided(docs, id_col, text_col, keep, memtable_rows, 64, True)
    whole = fresh(docs, "whole")
    alone = found.probe(keyed(docs, id_col, text_col, 64, True)).where("NOT maybe").select(F.col("row").alias(whole))
    return good.where("kept").select(F.col("row").alias(whole)).unionByName(alone).select(f"{whole}.*")
