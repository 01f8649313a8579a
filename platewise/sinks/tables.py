"""Versioned table writes (SNK-1, SNK-4, SNK-7, SNK-8, SNK-12).

Parquet paths cannot be overwritten while they are read, and a failed job
must never leave a half-written table. Each write goes to a fresh folder
under the table root; once the Spark job has succeeded, the next numbered
pointer file is created, which only one writer can do, so readers always see
a complete version and no writer's rows are lost. Keyed upserts write the
months they touch; the pointer takes the other months' folders over. Table
roots live in the cluster's shared storage (the folder named by
``spark.checkpoint.dir`` or an explicit shared path), never in a
machine-local temporary folder.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from platewise.operators import upsert as UP

POINTER = "_version-"
#: Rows whose day is null.
NO_MONTH = "none"
#: How often a writer takes up another one's version and tries again.
ATTEMPTS = 50


@dataclass(frozen=True)
class Version:
    """What a pointer says: the folder of a version written whole, or the
    folder of each month; the schema; a note of the writer."""

    number: int
    folder: str | None = None
    months: dict[str, str] | None = None
    schema: str | None = field(default=None, compare=False)
    note: dict = field(default_factory=dict, compare=False)

    def folders(self, root: str) -> list[str]:
        if self.months is None:
            return [os.path.join(root, self.folder)]
        return [month_folder(root, f, m) for m, f in sorted(self.months.items())]

    def path(self, root: str) -> str:
        return os.path.join(root, self.folder)


def month_folder(root: str, folder: str, month: str) -> str:
    return os.path.join(root, folder, f"_month={month}")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with all its content, unless it exists (then
    False): a temporary name takes the file's name, which a local file system
    (a link) and HDFS-like ones (a rename) refuse when the name is taken."""
    p, fs, jvm = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}.tmp"))
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":
        source, target = tmp.toUri().getPath(), p.toUri().getPath()
        with open(source, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(source, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(tmp, p, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        fs.delete(tmp, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise


def _read_text(spark: SparkSession, path: str) -> str | None:
    p, fs, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    line = reader.readLine()
    reader.close()
    return line


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[Version]:
    """The published versions, oldest first."""
    found = [n for n in _names(spark, root) if n.startswith(POINTER)]
    return [_version(spark, root, n) for n in found]


def _version(spark: SparkSession, root: str, name: str) -> Version:
    return Version(int(name.removeprefix(POINTER)), **json.loads(_read_text(spark, os.path.join(root, name))))


def current_version(spark: SparkSession, root: str) -> Version | None:
    found = [n for n in _names(spark, root) if n.startswith(POINTER)]
    return _version(spark, root, found[-1]) if found else None


def read_table(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no published version under {root}")
    if version.months is None:
        return spark.read.parquet(version.path(root))
    return _read_folders(spark, version.folders(root), StructType.fromJson(json.loads(version.schema)))


def _read_folders(spark: SparkSession, folders: list[str], schema: StructType) -> DataFrame:
    """Files of several versions' month folders (their names hold no column)."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)


_ANY = object()


def commit(spark: SparkSession, root: str, base=_ANY, **content) -> bool:
    """Make ``content`` (of a ``Version``) the next version, by creating the
    pointer that follows ``base``; False when another writer has. Without
    ``base``, after whatever is current by then."""
    while True:
        last = current_version(spark, root) if base is _ANY else base
        number = (last.number if last else 0) + 1
        if _create_text(spark, os.path.join(root, f"{POINTER}{number:09d}"), json.dumps(content)):
            return True
        if base is not _ANY:
            return False


def _new_folder() -> str:
    return f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"


def _delete(spark: SparkSession, path: str) -> None:
    p, fs, _ = _fs(spark, path)
    fs.delete(p, True)


def publish(df: DataFrame, root: str, partition_by: list[str] | None = None, base=_ANY,
            note: dict | None = None) -> tuple[bool, str | None]:
    """SNK-4 / SNK-12: write ``df`` as the table's next version.

    Returns ``(True, None)`` once the version is complete and published, or
    ``(False, message)`` with nothing published when the job failed. The
    previous version stays readable throughout, so ``df`` may itself be
    derived from it. With ``base``, the version (see ``current_version``; None
    for no table) that ``df`` is derived from, nothing is published when
    another writer has published since (``change_table`` tries again).
    """
    spark = df.sparkSession
    folder = _new_folder()
    try:
        w = df.write.mode("errorifexists")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(os.path.join(root, folder))
        if commit(spark, root, base, folder=folder, note=note or {}):
            return True, None
        _delete(spark, os.path.join(root, folder))
        return False, f"another version of {root} was published meanwhile; read it and try again"
    except Exception as e:  # noqa: BLE001
        return False, str(e)


def change_table(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame],
                 keep: int = 10) -> tuple[bool, str | None]:
    """Publish ``change(current table or None)``, made anew from the newer
    version whenever another writer came first; the newest ``keep`` versions
    stay. ``(ok, error)``."""
    ok, message = False, None
    for _ in range(ATTEMPTS):
        base = current_version(spark, root)
        try:
            df = change(read_table(spark, root, base) if base else None)
        except Exception as e:  # noqa: BLE001
            return False, str(e)
        ok, message = publish(df, root, base=base)
        if ok or current_version(spark, root) == base:
            break
    if ok:
        retain_versions(spark, root, keep)
    return ok, message


def _month(day: str):
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(NO_MONTH)).alias("_month")


def upsert_into(spark: SparkSession, root: str, updates: DataFrame, keys: Sequence[str] = ("date",),
                order_col: str | None = None, schema: StructType | None = None, day: str = "date",
                repeats: bool = True, note: dict | None = None, base=_ANY, keep: int = 10) -> tuple[bool, str | None]:
    """SNK-1 / SNK-2 as a table write: ``upsert`` of ``updates`` by ``keys``
    into the table at ``root``, which keeps a folder for each month of ``day``
    (one of the keys). ``(ok, error)``.

    The updates are evaluated once: their last rows are written by month
    beside the table, and the folders' names tell the months they touch. Only
    those months are read and written; the new version takes all others' files
    as they are. When another writer publishes first, the merge is made anew
    from its version (not with ``base``: then it is refused). A table that
    does not exist begins with ``schema`` (else that of the updates); one
    written whole is divided by its months the first time. Without
    ``order_col`` the greatest of a key's rows counts, or with ``repeats`` off
    a repeated key is refused. The newest ``keep`` versions stay."""
    if day not in keys:
        raise ValueError(f"{day} must be one of the keys {list(keys)}")
    folder, staged = _new_folder(), f"staged-{uuid.uuid4().hex}"
    try:
        version = current_version(spark, root) if base is _ANY else base
        if version:
            schema = read_table(spark, root, version).schema
        schema = schema or StructType([f for f in updates.schema if f.name != order_col])
        rows = UP.one_per_key(updates, keys, order_col, count="_rows")
        rows = UP.aligned(rows, schema, ["_rows"])
        rows.withColumn("_month", _month(day)).write.partitionBy("_month").parquet(os.path.join(root, staged))
        months = [n.removeprefix("_month=") for n in _names(spark, os.path.join(root, staged)) if n.startswith("_month=")]
        fresh = _read_folders(spark, [month_folder(root, staged, m) for m in months],
                              StructType.fromJson(schema.jsonValue()).add("_rows", LongType()))
        if not repeats and order_col is None and not fresh.filter("_rows > 1").isEmpty():
            raise ValueError(f"several rows for one {'/'.join(keys)}: name the column that orders them (order_col)")
        fresh = fresh.drop("_rows")
        for _ in range(ATTEMPTS):
            known = version.months if version and version.months is not None else {}
            if version and version.months is None:
                before = read_table(spark, root, version)
            else:
                before = _read_folders(spark, [month_folder(root, known[m], m) for m in months if m in known], schema)
            merged = merge(before, fresh, keys).withColumn("_month", _month(day)).hint("rebalance", "_month")
            path = os.path.join(root, folder)
            merged.write.partitionBy("_month").parquet(path)
            new = [n.removeprefix("_month=") for n in _names(spark, path) if n.startswith("_month=")]
            if commit(spark, root, version, months=known | dict.fromkeys(new, folder), schema=schema.json(), note=note or {}):
                retain_versions(spark, root, keep)
                return True, None
            _delete(spark, path)
            if base is not _ANY:
                return False, f"another version of {root} was published meanwhile; read it and try again"
            version = current_version(spark, root)
            folder = _new_folder()
        return False, f"{ATTEMPTS} other versions of {root} came first"
    except Exception as e:  # noqa: BLE001
        return False, str(e)
    finally:
        _delete(spark, os.path.join(root, staged))


def merge(before: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of both, one per key, those of ``fresh`` first: a union and
    one partial aggregate."""
    rest = [c for c in before.columns if c not in keys]
    both = before.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    one = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_fresh").alias("_row"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in before.columns])


def write_json_record(spark: SparkSession, path: str, record: DataFrame) -> None:
    """SNK-8: a one-row record as a single JSON document, of a new name."""
    if not _create_text(spark, path, record.toJSON().first() or "{}"):
        raise FileExistsError(path)


def retain_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the versions before the newest ``keep``: their pointers, and the
    folders that no later version refers to. Returns the removed folders, as
    named under ``root``. Folders that no pointer names (another writer's, not
    yet published) are left alone."""
    found = versions(spark, root)
    old, kept = found[:-keep], found[-keep:]
    used = reduce(set.union, (set(v.folders(root)) for v in kept), set())
    gone = sorted(reduce(set.union, (set(v.folders(root)) for v in old), set()) - used)
    for v in old:  # pointers first: a version is never half there
        _delete(spark, os.path.join(root, f"{POINTER}{v.number:09d}"))
    for folder in gone:
        _delete(spark, folder)
    return [os.path.relpath(f, root) for f in gone]
