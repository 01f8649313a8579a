"""Answers for the partitions of a table, so that a later pass over the same
table joins them without moving a row of it.

A pass names the partition (and a row's place in it) that it saw something
in; the answers are written to the shared folder, a folder for each partition,
and the task of a later pass that reads the same partition reads its folder.
Tasks use pyarrow's file systems (file, S3, GCS, HDFS)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame

from platewise.session import scratch_dir


def post(answers: DataFrame, name: str) -> str:
    """Write ``answers`` (column ``part`` and others) and return their folder."""
    folder = scratch_dir(answers.sparkSession, f"llm-{name}")
    answers.repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a shared path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def collected(folder: str, part: int, columns: list[str]) -> pa.Table | None:
    """In a task: the answers for a partition, None when there are none."""
    fs, root = file_system(folder)
    found = fs.get_file_info(pa.fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    tables = [pa.parquet.read_table(f.path, columns=columns, filesystem=fs, partitioning=None)
              for f in found if f.path.endswith(".parquet")]
    return pa.concat_tables(tables) if tables else None
