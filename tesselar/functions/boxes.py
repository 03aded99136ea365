"""n-dimensional boxes as Columns: arrays of offsets and shapes, whose intersections become contiguous runs.

Rank 0 is a box of volume 1.  Everything is built-in array expressions, so plans stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1).cast("bigint"), lambda a, x: a * x)


def ends(offsets: Column, shape: Column) -> Column:
    return F.zip_with(offsets, shape, lambda o, s: o + s)


def overlap(lo_a: Column, shape_a: Column, lo_b: Column, shape_b: Column) -> Column:
    """Whether two boxes share a cell: the larger start is before the smaller end in every dimension."""
    lo = F.zip_with(lo_a, lo_b, lambda a, b: F.greatest(a, b))
    hi = F.zip_with(ends(lo_a, shape_a), ends(lo_b, shape_b), lambda a, b: F.least(a, b))
    return F.forall(F.zip_with(lo, hi, lambda a, b: a < b), lambda x: x)


def _dimensions(shape: Column) -> Column:
    """0 .. rank - 1, empty for rank 0."""
    n = F.size(shape)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def strides(shape: Column) -> Column:
    """Row-major strides in elements."""
    return F.transform(_dimensions(shape), lambda i: product(F.slice(shape, i + 2, F.size(shape))))


def flat(coordinates: Column, shape: Column) -> Column:
    """Row-major place of a coordinate."""
    return F.aggregate(F.zip_with(coordinates, strides(shape), lambda c, s: c * s), F.lit(0).cast("bigint"), lambda a, x: a + x)


def with_runs(pairs: DataFrame) -> DataFrame:
    """Explode pairs of boxes (src_offsets, src_shape, tgt_offsets, tgt_shape) that overlap into maximal contiguous
    runs: columns run, src_elem, tgt_elem and run_len, in elements of the source and target chunk.

    A dimension is full when the intersection spans source and target chunk there.  From the last dimension that
    isn't full on, elements are contiguous on both sides; each index tuple of the dimensions before gives a run.
    """
    c = F.col
    df = pairs.where(overlap(c("src_offsets"), c("src_shape"), c("tgt_offsets"), c("tgt_shape")))
    df = df.withColumn("__lo", F.zip_with("src_offsets", "tgt_offsets", lambda a, b: F.greatest(a, b)))
    hi = F.zip_with(ends(c("src_offsets"), c("src_shape")), ends(c("tgt_offsets"), c("tgt_shape")), lambda a, b: F.least(a, b))
    df = df.withColumn("__len", F.zip_with(hi, c("__lo"), lambda a, b: a - b))
    partial = lambda i: (F.get("__len", i) != F.get("src_shape", i)) | (F.get("__len", i) != F.get("tgt_shape", i))
    df = df.withColumn("__p", F.aggregate(_dimensions(c("__len")), F.lit(0), lambda a, i: F.when(partial(i), i).otherwise(a)))
    outer = F.slice("__len", F.lit(1), c("__p"))
    df = df.withColumn("run_len", product(F.slice("__len", c("__p") + 1, F.size("__len") + 1)))
    df = df.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), product(outer) - 1)))
    tail = lambda i: product(F.slice("__len", i + 2, F.greatest(c("__p") - i - 1, F.lit(0))))
    index = lambda i: F.when(i < c("__p"), F.expr("0L") + F.floor(c("run") / tail(i)) % F.get("__len", i)).otherwise(F.lit(0).cast("bigint"))
    df = df.withColumn("__at", F.transform("__lo", lambda lo, i: lo + index(i)))
    for side in ("src", "tgt"):
        relative = F.zip_with("__at", f"{side}_offsets", lambda a, o: a - o)
        df = df.withColumn(f"{side}_elem", flat(relative, c(f"{side}_shape")))
    return df.drop("__lo", "__len", "__p", "__at")
