"""Files from rows: what the writers make, (name, content), is put in a folder by the tasks that have it.

The folder is a URI that pyarrow's file systems know (file, hdfs, s3, gs), which tasks write directly. A file appears under its name only once
it is whole, so a task that is repeated, or runs twice, leaves one file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; what has no scheme is a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def store(made: DataFrame, folder: str) -> int:
    """Put rows (name, content) into ``folder`` as files; how many. Names must differ; a file of that name is replaced. The files stand when this returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                part = f"{root}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([b.column("name")], names=["name"])

    return made.select("name", "content").mapInArrow(run, "name string").count()
