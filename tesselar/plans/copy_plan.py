"""From two topologies to the byte ranges that make the target's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions.boxes import with_runs
from tesselar.functions.dtypes import bits
from tesselar.plans.layout import byte_size, header_offsets
from tesselar.plans.model import Topology, TopologyError


def missing_tensors(target: DataFrame, source: DataFrame) -> DataFrame:
    """Names of the target that the source lacks."""
    return target.join(source, "name", "left_anti").select("name")


def mismatches(target: DataFrame, source: DataFrame) -> DataFrame:
    """Tensors of both whose shape or dtype differ: (name, shape, dtype, src_shape, src_dtype)."""
    old = source.select("name", F.col("shape").alias("src_shape"), F.col("dtype").alias("src_dtype"))
    return target.select("name", "shape", "dtype").join(old, "name").where("shape != src_shape OR dtype != src_dtype")


def first_replica(chunks: DataFrame) -> DataFrame:
    """Chunks to read from: one replica, the first listed, of a Shared tensor."""
    return chunks.where("kind = 'Distributed' OR chunk_idx = 0")


def copy_runs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Runs of elements between chunks(name, offsets, shape, file_idx) of two layouts: an equi-join on the name with
    the overlap of boxes as residual condition, exploded into contiguous runs."""
    src = source.select("name", F.col("offsets").alias("src_offsets"), F.col("shape").alias("src_shape"), F.col("file_idx").alias("src_file"))
    tgt = target.select("name", F.col("offsets").alias("tgt_offsets"), F.col("shape").alias("tgt_shape"), F.col("file_idx").alias("tgt_file"))
    return with_runs(src.join(tgt, "name"))


def byte_runs(runs: DataFrame, width: Column, header_size: Column, begin: Column) -> DataFrame:
    """Runs with src_start and src_end (absolute in the source file) and tgt_off (in the target chunk), in bytes."""
    start = header_size + begin + F.col("src_elem") * width
    return runs.withColumns({"src_start": start, "src_end": start + F.col("run_len") * width, "tgt_off": F.col("tgt_elem") * width})


def copy_plan(source: Topology, head: DataFrame, target: Topology) -> DataFrame:
    """(tgt_file, tgt_pos, name, src_file, src_start, src_end): every byte range of every target file.

    head has the source files' headers (HEADER columns).  Raises for missing tensors, differing shapes or types and
    chunks that their file's header lacks.
    """
    if (row := missing_tensors(target.tensors, source.tensors).orderBy("name").first()) is not None:
        raise TopologyError("TensorNotFound", row["name"])
    if (row := mismatches(target.tensors, source.tensors).orderBy("name").first()) is not None:
        raise TopologyError("ShapeOrTypeMismatch", str(row.asDict()))
    old = first_replica(source.chunks)
    if (row := old.join(head, ["file_idx", "name"], "left_anti").orderBy("name").first()) is not None:
        raise TopologyError("TensorNotFound", f"{row['name']} in file {row['file_idx']}")
    types = target.tensors.select("name", "dtype")
    sized = target.chunks.join(types, "name").withColumn("n_bytes", byte_size(F.col("shape"), F.col("dtype")))
    placed = header_offsets(sized).select("name", F.col("file_idx").alias("tgt_file"), F.col("begin").alias("tgt_begin"))
    where = head.select("name", F.col("file_idx").alias("src_file"), "begin", "header_size")
    runs = copy_runs(old, target.chunks).join(types, "name").join(where, ["name", "src_file"]).join(placed, ["name", "tgt_file"])
    runs = byte_runs(runs, (bits(F.col("dtype")) / 8).cast("bigint"), F.col("header_size"), F.col("begin"))
    return runs.select("tgt_file", (F.col("tgt_begin") + F.col("tgt_off")).alias("tgt_pos"), "name", "src_file", "src_start", "src_end").where("src_end > src_start")
