"""Files of a result, written as files: (name, content) rows to a folder that driver and executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

MANIFEST = "name string, size long, path string"


def stored(files: DataFrame, folder: str) -> DataFrame:
    """Write each row's content as folder/name; name, size, path of the files written.

    A file is written under another name and moved when it is whole, so that a task that is run again leaves
    the same files. Names must be different; folder may be a path or the URI of any file system that Arrow knows.
    The files are written when the result is computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        system.create_dir(base, recursive=True)
        for b in batches:
            rows = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path, draft = f"{base}/{name}", f"{base}/.{uuid.uuid4().hex}"
                data = content.as_buffer() or pa.py_buffer(b"")
                with system.open_output_stream(draft) as out:
                    out.write(data)
                system.move(draft, path)
                rows.append((name, data.size, path))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["name", "size", "path"])

    return files.select("name", "content").mapInArrow(run, MANIFEST)


def stored_parts(rows: DataFrame, folder: str, order: str = "row", data: str = "data") -> DataFrame:
    """Write the data of all rows, in order, into part files of folder, whose names are in that order too: one behind the other they are one
    file of any size. name, size, path of the parts; they are written when the result is computed. A part is written under another name first, as in stored()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        system.create_dir(base, recursive=True)
        name, draft, size = f"part-{TaskContext.get().partitionId():06d}", f"{base}/.{uuid.uuid4().hex}", 0
        with system.open_output_stream(draft) as out:
            for b in batches:
                for x in b.column(0):
                    held = x.as_buffer() or pa.py_buffer(b"")
                    out.write(held)
                    size += held.size
        system.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((name, pa.string()), (size, pa.int64()), (f"{base}/{name}", pa.string()))], names=["name", "size", "path"])

    return rows.repartitionByRange(order).sortWithinPartitions(order).select(data).mapInArrow(run, MANIFEST)


def deleted(folder: str) -> bool:
    """Delete a folder of stored files; whether it was there."""
    system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
    if system.get_file_info(base).type == fs.FileType.NotFound:
        return False
    system.delete_dir(base)
    return True
