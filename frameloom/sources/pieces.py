"""Files put together from pieces that many tasks write at known offsets, as a Spark data source.

A row is a piece: a file's name below the target folder, the place of its first byte, and its bytes. Tasks write pieces into
part files of the job; none holds more than a megabyte and one piece, and no piece reaches the driver. Commit happens in two
phases: a task tells how many bytes it wrote to each file, and the driver renames a part file only if its size is the
sum of what was told, so pieces neither leave holes nor overlap. A task that is run again writes the same bytes to the
same places. Aborting deletes the job's part files, which lie in a hidden folder of their own.

Writing at an offset needs a file system with random access (local, NFS, Lustre and the like, under the scheme ``file``).
"""

from __future__ import annotations

import os
import shutil
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PIECE = "file string, at long, data binary"
#: Bytes of a file that go to one task in order, bytes that are written at once, and rows and bytes of a batch.
STRETCH, AT_ONCE, ROWS, BYTES = 64 << 20, 1 << 20, 8192, 4 << 20
#: Folders that the part files of a job are spread over.
FOLDERS = 256

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def gathered(work: Work) -> Work:
    """work whose small batches are put together, as each one that a task hands back costs as much as many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in work(batches):
            if held and (rows + batch.num_rows > ROWS or size + batch.nbytes > BYTES or batch.schema != held[0].schema):
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows, size = [], 0, 0
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def local_folder(uri: str) -> Path:
    """The folder of a URI that tasks can open by its path."""
    if "://" in uri and not uri.startswith("file:"):
        raise ValueError(f"{uri}: writing at an offset needs a file system with random access")
    return Path("/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else Path(uri)


@dataclass
class Written(WriterCommitMessage):
    sizes: dict[str, int] = field(default_factory=dict)


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = local_folder(options["path"])
        self.job = uuid.uuid4().hex

        self.parts = f"{self.root}/.{self.job}.part"

    def _part(self, name: str) -> str:
        # In one folder tasks wait for each other to make a file.
        return f"{self.parts}/{zlib.crc32(name.encode()) % FOLDERS:02x}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        sizes: Counter[str] = Counter()
        name, folders, handle = None, set(), -1
        held, start, size = [], 0, 0

        def put() -> None:
            content, at = memoryview(b"".join(held)), start
            while len(content):
                n = os.pwrite(handle, content, at)
                content, at = content[n:], at + n

        try:
            for batch in iterator:
                for file, at, data in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("data"), strict=True):
                    # Pieces that follow each other are written together.
                    if file != name or at != start + size or size >= AT_ONCE:
                        put()
                        held, start, size = [], at, 0
                    if file != name:
                        if handle >= 0:
                            os.close(handle)
                        part = self._part(file)
                        if (folder := os.path.dirname(part)) not in folders:
                            os.makedirs(folder, exist_ok=True)
                            folders.add(folder)
                        name, handle = file, os.open(part, os.O_WRONLY | os.O_CREAT, 0o644)
                    content = data.as_buffer() or b""
                    held.append(content)
                    size += len(content)
                    sizes[file] += len(content)
            put()
        finally:
            if handle >= 0:
                os.close(handle)
        return Written(dict(sizes))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        total: Counter[str] = Counter()
        for m in messages:
            if m:
                total.update(m.sizes)
        for name, size in total.items():
            if (found := os.stat(self._part(name)).st_size) != size:
                self.abort(messages)
                raise ValueError(f"{name}: pieces of {size} bytes leave holes or overlap in a file of {found}")
        # What describes other files comes last.
        folders = set()
        for name in sorted(total, key=lambda n: (n.endswith(".json"), n)):
            if (folder := os.path.dirname(name)) not in folders:
                os.makedirs(f"{self.root}/{folder}", exist_ok=True)
                folders.add(folder)
            os.replace(self._part(name), f"{self.root}/{name}")
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class PieceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_pieces"

    def schema(self) -> str:
        return PIECE

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PieceWriter(self.options)


def save_pieces(pieces: DataFrame, folder: str, dealt: bool = False) -> None:
    """Write the files of pieces (file, at, data) below a folder; existing files of these names are replaced.

    dealt: pieces of a stretch are in one task already, in their order.
    """
    pieces.sparkSession.dataSource.register(PieceFiles)
    local_folder(folder).mkdir(parents=True, exist_ok=True)
    told = pieces.select("file", F.col("at").cast("long").alias("at"), "data")
    if not dealt:
        # A stretch of a file goes to one task in order, so a short file is opened once, and tasks tell the driver of their own files only.
        told = told.repartition("file", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("file", "at")
    told.write.format("file_pieces").mode("append").save(folder)
