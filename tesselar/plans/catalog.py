"""Finding and reading the topology of a checkpoint folder."""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesselar.operators.validate import validate
from tesselar.plans.model import MANIFEST, Topology, TopologyError
from tesselar.sources.headers import headers, open_fs


def parse_manifest(text: DataFrame) -> Topology:
    """A checked topology from text(value), rows of JSON objects that make up the manifest: one row has it all, or
    each of many has some of its tensors and one the rest, so that tasks parse a large manifest in parts."""
    row = text.select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")
    world_size = row.agg(F.max("world_size")).first()[0]  # the tensors stay in tasks
    each = row.select(F.explode("tensors").alias("name", "t"))
    tensors = each.select("name", F.col("t.type").alias("kind"), F.col("t.shape").alias("shape"), F.col("t.dtype").alias("dtype"))
    split = each.select("name", F.lit("Distributed").alias("kind"), F.posexplode("t.chunks").alias("chunk_idx", "c"))
    split = split.select("name", "kind", "chunk_idx", "c.offsets", "c.shape", F.col("c.filename_index").alias("file_idx"))
    zeros = F.transform("t.shape", lambda _: F.lit(0).cast("bigint"))
    whole = each.select("name", F.lit("Shared").alias("kind"), F.posexplode("t.filename_indices").alias("chunk_idx", "file_idx"), zeros.alias("offsets"), F.col("t.shape").alias("shape"))
    files = row.select(F.posexplode("filenames").alias("file_idx", "filename"))
    return validate(Topology(tensors, split.unionByName(whole.select(split.columns)), files, world_size).kept())


def shared_topology(found: DataFrame, files: DataFrame) -> Topology:
    """All tensors of found(name, shape, dtype, file_idx) replicated in the one file that has them."""
    zeros = F.transform("shape", lambda _: F.lit(0).cast("bigint"))
    tensors = found.select("name", F.lit("Shared").alias("kind"), "shape", "dtype")
    chunks = found.select("name", F.lit("Shared").alias("kind"), F.lit(0).alias("chunk_idx"), zeros.alias("offsets"), "shape", "file_idx")
    return validate(Topology(tensors, chunks, files, 1).kept())


def weight_map_files(entries: DataFrame) -> DataFrame:
    """entries(name, filename) -> (file_idx, filename), unique and numbered in their order."""
    number = F.row_number().over(W.orderBy("filename")).cast("bigint") - 1  # a row per file, not per tensor
    return entries.select("filename").distinct().select(number.alias("file_idx"), "filename")


def load_topology(spark: SparkSession, folder: str, lenient: bool = False) -> Topology:
    """The topology of a folder: its manifest, else its weight-map index, else its single file.

    lenient passes over names that the weight map lists but their file lacks.
    """
    fs, path = open_fs(folder.rstrip("/"))
    there = lambda name: fs.get_file_info(f"{path}/{name}").type == pafs.FileType.File
    if there("topology.json"):
        return parse_manifest(spark.read.text(f"{folder}/topology.json", wholetext=True))
    if there("model.safetensors.index.json"):
        index = spark.read.text(f"{folder}/model.safetensors.index.json", wholetext=True)
        entries = index.select(F.explode(F.from_json("value", "weight_map map<string,string>")["weight_map"]).alias("name", "filename"))
        files = weight_map_files(entries)
        head = headers(spark, with_paths(files, folder)).select("file_idx", "name", "dtype", "shape")
        listed = entries.join(files, "filename").select("name", "file_idx")
        missing = listed.join(head, ["name", "file_idx"], "left_anti").orderBy("name").first()
        if missing is not None and not lenient:
            raise TopologyError("TensorNotFound", f"{missing['name']} isn't in its file")
        return shared_topology(listed.join(head, ["name", "file_idx"]), files)
    if there("model.safetensors"):
        files = spark.createDataFrame([(0, "model.safetensors")], "file_idx bigint, filename string")
        return shared_topology(headers(spark, with_paths(files, folder)).select("name", "shape", "dtype", "file_idx"), files)
    raise TopologyError("InvalidDataSource", f"no topology, index or model file in {folder}")


def with_paths(files: DataFrame, folder: str) -> DataFrame:
    return files.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "filename"))


def manifest_json(topology: Topology) -> str:
    """The manifest as indented JSON with tensors in order of names.  A manifest is small: it is one JSON file."""
    boxes: dict[str, list] = {}
    for r in topology.chunks.orderBy("name", "chunk_idx").collect():
        boxes.setdefault(r["name"], []).append(r)
    tensors = {}
    for t in topology.tensors.orderBy("name").collect():
        entry = {"type": t["kind"], "shape": t["shape"], "dtype": t["dtype"]}
        own = boxes.get(t["name"], [])
        if t["kind"] == "Shared":
            entry["filename_indices"] = [c["file_idx"] for c in own]
        else:
            entry["chunks"] = [{"offsets": c["offsets"], "shape": c["shape"], "filename_index": c["file_idx"]} for c in own]
        tensors[t["name"]] = entry
    names = [r["filename"] for r in topology.files.orderBy("file_idx").collect()]
    return json.dumps({"tensors": tensors, "filenames": names, "world_size": topology.world_size}, indent=2)
