"""Reading tensor files: an eight-byte little-endian length, a JSON header, then the tensors' bytes.

A header is read by seeking, so a file of any size costs its header alone.  Paths may be local or of any file
system that pyarrow opens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.plans.model import HEADER, TopologyError


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)
    return fs, path


def read_header(uri: str) -> tuple[dict, int]:
    """(header, bytes before the data) of a tensor file."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        size = int.from_bytes(f.read(8), "little")
        if size > max(0, f.size() - 8):
            raise TopologyError("InvalidHeader", f"{uri} announces {size} bytes of header")
        return json.loads(f.read(size)), 8 + size


def headers(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row per tensor of files(file_idx, path): HEADER columns; the user's metadata isn't a tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for idx, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                header, size = read_header(path)
                rows += [(idx, name, t["dtype"], t["shape"], *t["data_offsets"], size) for name, t in header.items() if name != "__metadata__"]
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file_idx", "name", "dtype", "shape", "begin", "end", "header_size"])

    one_each = files.select(F.col("file_idx").cast("bigint"), "path").repartition(F.col("file_idx"))
    return one_each.mapInArrow(run, HEADER)


def user_metadata(uri: str) -> dict[str, str]:
    """The free key-value metadata of a tensor file."""
    return dict(read_header(uri)[0].get("__metadata__", {}))


def read_ranges(ranges: DataFrame) -> DataFrame:
    """ranges(path, start, stop, ...) with the bytes as `payload`; ranges of a file share its handle."""
    schema = ranges.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for b in batches:
            out = []
            for path, start, stop in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", "start", "stop"))):
                if path not in files:
                    fs, p = open_fs(path)
                    files[path] = fs.open_input_file(p)
                out.append(files[path].read_at(stop - start, start))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "payload"])
        for f in files.values():
            f.close()

    return ranges.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", payload binary")
