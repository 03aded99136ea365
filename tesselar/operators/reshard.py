"""Re-sharding checkpoints: fuse into one file, split over ranks, or any target topology."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.operators.validate import validate
from tesselar.plans.catalog import load_topology, manifest_json, with_paths
from tesselar.plans.copy_plan import copy_plan
from tesselar.plans.layout import MAX_SHARD_BYTES, byte_size, file_name, header_offsets, shard_files, split_chunks
from tesselar.plans.model import Topology
from tesselar.sources.headers import headers, open_fs
from tesselar.sources.sink import TensorFiles, writes_anywhere

#: Bytes of a target file that one task writes, about.
PART_BYTES = 64 << 20


def fused_topology(source: Topology) -> Topology:
    """Everything replicated in the one file model.safetensors."""
    spark = source.tensors.sparkSession
    tensors = source.tensors.select("name", F.lit("Shared").alias("kind"), "shape", "dtype")
    zeros = F.transform("shape", lambda _: F.lit(0).cast("bigint"))
    chunks = tensors.select("name", "kind", F.lit(0).alias("chunk_idx"), zeros.alias("offsets"), "shape", F.lit(0).cast("bigint").alias("file_idx"))
    return Topology(tensors, chunks, spark.createDataFrame([(0, "model.safetensors")], "file_idx bigint, filename string"), 1)


def split_topology(source: Topology, world_size: int, max_shard_bytes: int = MAX_SHARD_BYTES) -> Topology:
    """A chunk per rank by the split rules, packed into files of about max_shard_bytes."""
    split = split_chunks(source.tensors, world_size)
    split = split.withColumn("n_bytes", byte_size(F.col("chunk_shape"), F.col("dtype")))
    packed = shard_files(split.select("rank", "name", "n_bytes"), max_shard_bytes)
    files = packed.select("file_idx", file_name(F.col("rank"), F.col("shard")).alias("filename")).distinct()
    chunks = split.join(packed.select("rank", "name", "file_idx"), ["rank", "name"])
    chunks = chunks.select("name", "kind", F.col("rank").cast("int").alias("chunk_idx"), "offsets", F.col("chunk_shape").alias("shape"), "file_idx")
    return Topology(split.select("name", "kind", "shape", "dtype").distinct(), chunks, files, world_size)


def file_headers(target: Topology, metadata: dict[str, str] | None = None) -> DataFrame:
    """(file_idx, filename, header) with the JSON header of every target file, space-padded to eight bytes."""
    types = target.tensors.select("name", "dtype")
    placed = header_offsets(target.chunks.join(types, "name").withColumn("n_bytes", byte_size(F.col("shape"), F.col("dtype"))))
    entry = F.to_json(F.struct("dtype", "shape", F.array("begin", "end").alias("data_offsets")))
    quoted = F.expr("substring(to_json(array(name)), 2, length(to_json(array(name))) - 2)")
    each = placed.select("file_idx", "name", F.concat(quoted, F.lit(":"), entry).alias("entry"))
    listed = each.groupBy("file_idx").agg(F.array_sort(F.collect_list(F.struct("name", "entry"))).alias("entries"))
    first = F.array(F.lit('"__metadata__":' + json.dumps(metadata))) if metadata else F.array().cast("array<string>")
    entries = F.coalesce(F.transform("entries", lambda e: e["entry"]), F.array().cast("array<string>"))
    text = F.concat(F.lit("{"), F.array_join(F.concat(first, entries), ","), F.lit("}"))
    df = target.files.join(listed, "file_idx", "left").select("file_idx", "filename", text.alias("header"))
    n = F.octet_length("header")
    return df.withColumn("header", F.concat("header", F.repeat(F.lit(" "), F.pmod(-n, F.lit(8)))))


def redistribute(
    spark: SparkSession, source_dir: str, target_dir: str, target: Topology, metadata: dict[str, str] | None = None, source: Topology | None = None
) -> list[str]:
    """Write target_dir from source_dir; the created file names, with the manifest if there are several ranks."""
    source = source or load_topology(spark, source_dir)
    target = validate(target.kept())
    files = with_paths(source.files, source_dir)
    plan = copy_plan(source, headers(spark, files).cache(), target)
    paths = files.select(F.col("file_idx").alias("src_file"), F.col("path").alias("src"))
    head = file_headers(target, metadata).withColumn("base", 8 + F.octet_length("header").cast("bigint")).cache()  # a row a file
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("src_end") - F.col("src_start") - 1, F.lit(PART_BYTES).cast("bigint"))).alias("at")
    ranges = plan.select("*", at).join(paths, "src_file").join(head.select(F.col("file_idx").alias("tgt_file"), "filename", "base"), "tgt_file")
    stop = F.least("src_end", F.col("src_start") + F.col("at") + PART_BYTES).alias("src_stop")
    ranges = ranges.select(F.col("tgt_file").alias("file_idx"), "filename", "base", (F.col("tgt_pos") + F.col("at")).alias("seq"), "src", (F.col("src_start") + F.col("at")).alias("src_start"), stop)
    rows = head.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(ranges, allowMissingColumns=True)
    rows = rows.select("file_idx", "filename", "header", "base", "seq", "src", "src_start", "src_stop")
    fs, folder = open_fs(target_dir)
    fs.create_dir(folder, recursive=True)
    spark.dataSource.register(TensorFiles)
    # parts of a file go to several tasks where the file system allows it
    part = [F.floor(F.col("seq") / PART_BYTES)] if writes_anywhere(target_dir) else []
    dealt = rows.repartition("file_idx", *part).sortWithinPartitions("file_idx", "seq")
    dealt.write.format("tensorfiles").option("path", target_dir).option("manifest", manifest_json(target)).mode("append").save()
    names = [r["filename"] for r in target.files.orderBy("file_idx").collect()]
    return names + (["topology.json"] if target.world_size > 1 else [])


def fuse(spark: SparkSession, source_dir: str, target_dir: str) -> list[str]:
    """All tensors whole in one file."""
    source = load_topology(spark, source_dir)
    return redistribute(spark, source_dir, target_dir, fused_topology(source), source=source)


def reshard(spark: SparkSession, source_dir: str, target_dir: str, world_size: int, max_shard_bytes: int = MAX_SHARD_BYTES) -> list[str]:
    """A chunk per rank and tensor by the split rules, in size-capped files."""
    source = load_topology(spark, source_dir)
    return redistribute(spark, source_dir, target_dir, split_topology(source, world_size, max_shard_bytes), source=source)
