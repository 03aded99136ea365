"""Writing tensor files as a Spark data source: tasks write, the driver renames.

Rows are (file_idx, filename, header, base, seq, src, src_start, src_stop): one with the header of each file, and those
whose bytes are read from a source range and belong at base + seq.  On file systems that write anywhere in a file
(`writes_anywhere`), any task writes any rows: attempts write the same bytes to the same places.  Elsewhere the rows of a
file come to one task, sorted by seq, which appends them under a name per attempt.  Files lie in a folder of the job
until they are renamed on commit, the manifest last, so a retried or speculative task never spoils a target; the folder
goes at the end, with what failed attempts left in it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tesselar.sources.headers import open_fs

ROWS = "file_idx bigint, filename string, header string, base bigint, seq bigint, src string, src_start bigint, src_stop bigint"
CHUNK = 16 << 20


def writes_anywhere(folder: str) -> bool:
    """Whether tasks can write parts of one file side by side: local and mounted file systems."""
    return isinstance(open_fs(folder)[0], pafs.LocalFileSystem)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (temporary, final)


class TensorWriter(DataSourceWriter):
    def __init__(self, folder: str, manifest: str) -> None:
        self.folder, self.manifest, self.job = folder.rstrip("/"), manifest, f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        return (self._parts if writes_anywhere(self.folder) else self._whole)(iterator)

    def _parts(self, iterator: Iterator) -> Written:
        """Each row at its place, whatever files and parts the task has."""
        open_: dict[str, int] = {}
        sources: dict = {}
        fs, folder = open_fs(self.folder)
        fs.create_dir(f"{folder}/{self.job}", recursive=True)
        for row in iterator:
            if row.filename not in open_:
                open_[row.filename] = os.open(f"{folder}/{self.job}/{row.filename}", os.O_WRONLY | os.O_CREAT, 0o644)
            if row.header is not None:
                header = row.header.encode()
                self._at(open_[row.filename], len(header).to_bytes(8, "little") + header, 0)
                continue
            for at, data in self._read(sources, row):
                self._at(open_[row.filename], data, row.base + row.seq + at)
        for fd in open_.values():
            os.close(fd)
        for f in sources.values():
            f.close()
        return Written([(f"{folder}/{self.job}/{name}", f"{folder}/{name}") for name in open_])

    @staticmethod
    def _at(fd: int, data: bytes, place: int) -> None:
        view = memoryview(data)
        while view:
            n = os.pwrite(fd, view, place)
            view, place = view[n:], place + n

    @staticmethod
    def _read(sources: dict, row: object) -> Iterator[tuple[int, bytes]]:
        """(bytes before, bytes) of the row's source range, CHUNK by CHUNK."""
        if row.src not in sources:
            fs, path = open_fs(row.src)
            sources[row.src] = fs.open_input_file(path)
        for at in range(row.src_start, row.src_stop, CHUNK):
            yield at - row.src_start, sources[row.src].read_at(min(CHUNK, row.src_stop - at), at)

    def _whole(self, iterator: Iterator) -> Written:
        """Files one after another, each from its rows in order."""
        done: list[tuple[str, str]] = []
        out = current = None
        sources: dict = {}
        fs, folder = open_fs(self.folder)
        fs.create_dir(f"{folder}/{self.job}", recursive=True)
        for row in iterator:
            if row.header is not None:
                if out:
                    out.close()
                current = row.filename
                temporary = f"{folder}/{self.job}/{current}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(temporary)
                header = row.header.encode()
                out.write(len(header).to_bytes(8, "little") + header)
                done.append((temporary, f"{folder}/{current}"))
                continue
            if row.filename != current:
                raise ValueError(f"rows of {row.filename} come before its header")
            for _, data in self._read(sources, row):
                out.write(data)
        if out:
            out.close()
        for f in sources.values():
            f.close()
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, folder = open_fs(self.folder)
        for temporary, final in sorted({f for m in messages if m for f in m.files}):
            fs.move(temporary, final)
        with fs.open_output_stream(f"{folder}/topology.json") as f:
            f.write(self.manifest.encode())
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, folder = open_fs(self.folder)
        if fs.get_file_info(f"{folder}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.job}")


class TensorFiles(DataSource):
    """format("tensorfiles") with the options path (an empty or new folder) and manifest (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "tensorfiles"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: object, overwrite: bool) -> TensorWriter:
        json.loads(self.options["manifest"])
        return TensorWriter(self.options["path"], self.options["manifest"])
