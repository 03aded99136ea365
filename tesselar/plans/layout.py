"""Placing tensors in files: header offsets, shard packing, worker buckets, split rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesselar.functions.boxes import product
from tesselar.functions.dtypes import bits

#: Upper bound of a shard file.
MAX_SHARD_BYTES = 5 << 30

# Name parts that decide how a tensor is split.
COLUMN_PARTS = ("c_fc", "c_attn", "wpe", "wte", "lm_head", "q_proj", "k_proj", "v_proj", "up", "gate")
ROW_PARTS = ("c_attn", "c_proj", "o_proj", "down")


def byte_size(shape: Column, dtype: Column) -> Column:
    """Bytes of a dense box; null unless they are whole."""
    total = product(shape) * bits(dtype)
    return F.when(total % 8 == 0, F.floor(total / 8))


def before(size: str, keys: list[str], order: list[str]) -> Column:
    """Running sum of the sizes before a row."""
    return F.coalesce(F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint")


def header_offsets(chunks: DataFrame) -> DataFrame:
    """chunks(file_idx, name, n_bytes, ...) with begin and end in the data part of their file, in order of names."""
    df = chunks.withColumn("begin", before("n_bytes", ["file_idx"], ["name"]))
    return df.withColumn("end", F.col("begin") + F.col("n_bytes"))


def padded(n: Column) -> Column:
    """n rounded up to a multiple of eight."""
    return n + F.pmod(-n, F.lit(8))


def shard_files(sizes: DataFrame, max_shard_bytes: int = MAX_SHARD_BYTES) -> DataFrame:
    """sizes(rank, name, n_bytes) with shard (of the rank, without empty ones) and file_idx (over all ranks).

    A tensor goes where it starts: shard = bytes before it // max_shard_bytes.
    """
    df = sizes.withColumn("bucket", F.floor(before("n_bytes", ["rank"], ["name"]) / F.lit(max_shard_bytes)))
    df = df.withColumn("shard", F.dense_rank().over(W.partitionBy("rank").orderBy("bucket")) - 1)
    per_rank = df.groupBy("rank").agg((F.max("shard") + 1).alias("n_files"))
    per_rank = per_rank.withColumn("base", F.coalesce(F.sum("n_files").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per rank
    return df.join(per_rank.select("rank", "n_files", "base"), "rank").withColumn("file_idx", (F.col("base") + F.col("shard")).cast("bigint")).drop("base", "bucket")


def file_name(rank: Column, shard: Column) -> Column:
    # Fixed value: the format of the names.
    return F.format_string("model_rank_%d_chunk_%d.safetensors", rank, shard)


def split_dim(name: Column) -> Column:
    """1, 0 or null (replicated) by the rules on tensor names, in their order."""
    has = lambda parts: F.greatest(*[name.contains(p).cast("int") for p in parts]) == 1
    bias = name.contains("bias")
    return F.when(has(COLUMN_PARTS) & ~bias, 1).when(has(ROW_PARTS) & ~bias, 0).when(name.contains("norm") | bias, F.lit(None)).otherwise(0).cast("int")


def split_chunks(tensors: DataFrame, world_size: int) -> DataFrame:
    """(name, kind, shape, dtype, rank, offsets, chunk_shape) of every rank.

    A tensor splits evenly along its dimension; one that lacks the dimension or doesn't divide is replicated.
    """
    dim = split_dim(F.col("name"))
    df = tensors.select("name", "shape", "dtype", dim.alias("dim"))
    extent = F.get("shape", F.col("dim"))
    df = df.withColumn("kind", F.when(F.coalesce((extent > 0) & (extent % world_size == 0), F.lit(False)), "Distributed").otherwise("Shared"))
    df = df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world_size - 1))))
    split = lambda i: (F.col("kind") == "Distributed") & (i == F.col("dim"))
    part = lambda s: F.floor(s / F.lit(world_size))
    return df.select(
        "name", "kind", "shape", "dtype", F.col("rank").cast("bigint").alias("rank"),
        F.transform("shape", lambda s, i: F.when(split(i), part(s) * F.col("rank")).otherwise(F.lit(0)).cast("bigint")).alias("offsets"),
        F.transform("shape", lambda s, i: F.when(split(i), part(s)).otherwise(s).cast("bigint")).alias("chunk_shape"),
    )


def worker_buckets(sizes: DataFrame, workers: int) -> DataFrame:
    """sizes(file_idx, name, n_bytes) with the worker that each row's bytes start in, balanced by bytes."""
    per_file = sizes.groupBy("file_idx").agg(F.sum("n_bytes").alias("file_bytes"))
    base = per_file.withColumn("base", before("file_bytes", [], ["file_idx"])).withColumn("total", F.sum("file_bytes").over(W.partitionBy()))  # one row per file
    df = sizes.join(base.select("file_idx", "base", "total"), "file_idx").withColumn("start", F.col("base") + before("n_bytes", ["file_idx"], ["name"]))
    return df.withColumn("worker", F.least(F.lit(workers - 1), F.floor(F.col("start") * workers / F.greatest("total", F.lit(1)))).cast("int")).drop("base", "total")
