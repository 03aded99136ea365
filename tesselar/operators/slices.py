"""Reading parts of tensors: t[a:b, i] over a checkpoint, several slices in one job."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.functions.boxes import with_runs
from tesselar.functions.dtypes import bits, decode
from tesselar.plans.catalog import load_topology, with_paths
from tesselar.plans.copy_plan import byte_runs, first_replica
from tesselar.plans.model import TopologyError
from tesselar.sources.headers import headers, read_ranges, user_metadata

Index = int | slice | list


def bounds(index: Index | tuple[Index, ...], shape: Iterable[int]) -> list[tuple[int, int, bool]]:
    """(lo, hi, whether the dimension is dropped) per dimension of shape; TopologyError for what can't be indexed."""
    shape = list(shape)
    given = list(index) if isinstance(index, tuple) else [index]
    if len(given) > len(shape):
        raise TopologyError("InvalidDimension", f"{len(given)} indices for {len(shape)} dimensions")
    out = []
    for i, n in zip(given + [slice(None)] * (len(shape) - len(given)), shape):
        if isinstance(i, list):
            if i:
                raise TopologyError("InvalidSliceRange", "lists of indices aren't supported")
            out.append((0, 0, False))
        elif isinstance(i, slice):
            lo, hi = i.start or 0, n if i.stop is None else min(i.stop, n)
            if lo < 0 or hi < 0 or i.step not in (None, 1):
                raise TopologyError("InvalidSliceRange", f"{i}")
            out.append((min(lo, n), max(hi, min(lo, n)), False))
        else:
            at = i + n if i < 0 else i
            if not 0 <= at < n:
                raise TopologyError("InvalidSliceRange", f"index {i} of {n}")
            out.append((at, at + 1, True))
    return out


def slice_elements(elements: DataFrame, box: list[tuple[int, int, bool]], dims: list[str]) -> DataFrame:
    """Rows of element coordinates within a box, counted from its start; dropped dimensions lose their column."""
    for (lo, hi, _), d in zip(box, dims):
        elements = elements.where((F.col(d) >= lo) & (F.col(d) < hi))
    for (lo, _, gone), d in zip(box, dims):
        elements = elements.drop(d) if gone else elements.withColumn(d, F.col(d) - lo)
    return elements


class Loader:
    """A checkpoint folder that answers slice plans; usable as a context manager."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.topology = spark, folder, load_topology(spark, folder)

    def __enter__(self) -> Loader:
        return self

    def __exit__(self, *_: object) -> None:
        return None

    def metadata(self) -> dict[str, str]:
        first = with_paths(self.topology.files, self.folder).orderBy("file_idx").first()
        return user_metadata(first["path"])

    def get_slice(self, name: str) -> Handle:
        row = self.topology.tensors.where(F.col("name") == name).first()
        if row is None:
            raise TopologyError("TensorNotFound", name)
        return Handle(name, row["shape"], row["dtype"])


class Handle:
    def __init__(self, name: str, shape: list[int], dtype: str) -> None:
        self.name, self.shape, self.dtype = name, shape, dtype

    def __getitem__(self, index: Index | tuple[Index, ...]) -> tuple[Handle, list[tuple[int, int, bool]]]:
        return self, bounds(index, self.shape)


class Plan:
    """Slices by tensor, at most one each, read by one job."""

    def __init__(self) -> None:
        self.slices: dict[str, tuple[Handle, list[tuple[int, int, bool]]]] = {}

    def add_slice(self, part: tuple[Handle, list[tuple[int, int, bool]]]) -> None:
        if part[0].name in self.slices:
            raise TopologyError("InvalidSliceRange", f"a second slice of {part[0].name}")
        self.slices[part[0].name] = part

    def ranges(self, loader: Loader) -> DataFrame:
        """(name, path, start, stop, tgt_off) of the bytes that the slices need, and no others."""
        spark, t = loader.spark, loader.topology
        rows = [(n, [lo for lo, _, _ in box], [hi - lo for lo, hi, _ in box], h.dtype) for n, (h, box) in self.slices.items()]
        wanted = spark.createDataFrame(rows, "name string, tgt_offsets array<bigint>, tgt_shape array<bigint>, dtype string")
        files = with_paths(t.files, loader.folder)
        src = first_replica(t.chunks).select("name", F.col("offsets").alias("src_offsets"), F.col("shape").alias("src_shape"), "file_idx")
        runs = with_runs(src.join(F.broadcast(wanted), "name"))  # as many rows as the caller's slices
        read = headers(spark, files.join(src.join(F.broadcast(wanted), "name").select("file_idx").distinct(), "file_idx", "left_semi"))
        runs = runs.join(read.select("file_idx", "name", "begin", "header_size"), ["file_idx", "name"]).join(files, "file_idx")
        runs = byte_runs(runs, (bits(F.col("dtype")) / 8).cast("bigint"), F.col("header_size"), F.col("begin"))
        return runs.select("name", "path", F.col("src_start").alias("start"), F.col("src_end").alias("stop"), "tgt_off")

    def execute(self, loader: Loader) -> dict[str, np.ndarray]:
        """The slices as arrays.  They go to the driver, since that is what a slice query asks for."""
        parts: dict[str, list] = {n: [] for n in self.slices}
        for r in read_ranges(self.ranges(loader)).collect():
            parts[r["name"]].append((r["tgt_off"], bytes(r["payload"])))
        out = {}
        for name, (h, box) in self.slices.items():
            flat = decode(b"".join(p for _, p in sorted(parts[name])), h.dtype)
            out[name] = flat.reshape([hi - lo for lo, hi, gone in box if not gone])
        return out
