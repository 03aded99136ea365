"""Schemas and errors of tensor checkpoints.

A topology is three DataFrames: tensors (name, kind, shape, dtype), chunks (name, kind, chunk_idx, offsets, shape,
file_idx) and files (file_idx, filename), and a world size.  A Shared tensor has one full-size chunk per replica.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

MANIFEST = (
    "tensors map<string,struct<type:string,shape:array<bigint>,dtype:string,"
    "chunks:array<struct<offsets:array<bigint>,shape:array<bigint>,filename_index:bigint>>,"
    "filename_indices:array<bigint>>>, filenames array<string>, world_size bigint"
)
HEADER = "file_idx bigint, name string, dtype string, shape array<bigint>, begin bigint, end bigint, header_size bigint"


class TopologyError(ValueError):
    """A violated rule of a topology or plan; code names the rule."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Topology:
    tensors: DataFrame
    chunks: DataFrame
    files: DataFrame
    world_size: int

    def kept(self) -> Topology:
        """The same with its frames cached: manifests are small, and every check and plan reads them again."""
        return Topology(self.tensors.cache(), self.chunks.cache(), self.files.cache(), self.world_size)
