"""File sources (SRC-1, SRC-2, SRC-3, SRC-5, SRC-9).

Schemas are always given (no ``inferSchema`` pass over the data). Reads are
distributed: a directory of files becomes one DataFrame split by Spark.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from platewise.functions.formats import to_flag
from platewise.functions.weather import weather_category
from platewise.schemas import HOLIDAYS, MODEL_METADATA, SALES_FILE, WEATHER_RESPONSE
from platewise.sinks.tables import _fs

CANDIDATE_SEPARATORS = [",", ";", "\t", "|"]
#: Of a file's head: bytes read at a time, and lines that choose its separator.
HEAD_BYTES, HEAD_LINES = 1 << 14, 50
#: A list of splits is broadcast up to this length (some 20 MB); a split has
#: so many bytes, unless ``spark.sql.files.maxPartitionBytes`` is less or the
#: file ends.
BROADCAST_SPLITS, SMALLEST_SPLIT = 300_000, 4 << 20


def read_by_name(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns, as text, of all CSV files under ``path``: each file
    is read with its own separator and header, so columns may stand in any
    order, be quoted and have others beside them. A file that lacks one is an
    error."""
    out = None
    for header, df in read_csv_files(spark, path, ordinal=False):
        lower = {c.lower(): c for c in df.columns}
        missing = [c for c in columns if c not in lower]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} under header {header!r}")
        part = df.select(*[F.col(f"`{lower[c]}`").alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: CSV with header, columns by name; ``TRUE``/``FALSE`` flags, ISO dates."""
    raw = read_by_name(spark, path, HOLIDAYS.names)
    return raw.select(
        F.to_date("date", "yyyy-MM-dd").alias("date"),
        F.col("description"),
        to_flag("is_bank_holiday").alias("is_bank_holiday"),
        to_flag("is_school_break").alias("is_school_break"),
        to_flag("is_bridge_day").alias("is_bridge_day"),
    )


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: history CSV, columns by name, ``m/d/yy`` dates (two-digit years
    pivot at 69 like POSIX ``%y``), ``total_day`` as total. Rows whose date or
    counts cannot be read have nulls there; ``rejected_sales`` lists them."""
    return _sales(spark, path).select("date", "total_meals", "veg", "non_veg")


def rejected_sales(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: the rows of a history file, as text, with a date or a count that
    cannot be read."""
    pairs = [("date", "raw_date"), ("total_meals", "raw_total"), ("veg", "raw_veg"), ("non_veg", "raw_non_veg")]
    bad = [F.col(c).isNull() & F.col(r).isNotNull() for c, r in pairs]
    return _sales(spark, path).filter(bad[0] | bad[1] | bad[2] | bad[3]).select(*[r for _, r in pairs])


def _sales(spark: SparkSession, path: str) -> DataFrame:
    from platewise.sinks.reports import us_short_date
    raw = read_by_name(spark, path, SALES_FILE.names)
    types = {f.name: f.dataType for f in SALES_FILE}

    def number(c: str) -> Column:
        return F.trim(c).try_cast("double").try_cast(types[c])

    return raw.select(
        us_short_date("date").alias("date"), number("total_day").alias("total_meals"),
        number("veg").alias("veg"), number("non_veg").alias("non_veg"),
        F.col("date").alias("raw_date"), F.col("total_day").alias("raw_total"),
        F.col("veg").alias("raw_veg"), F.col("non_veg").alias("raw_non_veg"))


def sniff_separator(spark: SparkSession, path: str) -> str:
    """SRC-3: the delimiter of a file (of the first one, of a folder), from
    its first lines; only their bytes are read."""
    heads = file_heads(spark, path)
    if not heads or not heads[0].lines:
        raise ValueError(f"empty or unreadable file: {path}")
    return choose_separator(heads[0].lines)


def read_sniffed(spark: SparkSession, path: str) -> tuple[DataFrame | None, str | None]:
    """SRC-3: read a CSV of unknown delimiter, every column as string.

    Returns ``(df, None)`` or ``(None, message)`` when the file cannot be read.
    """
    try:
        sep = sniff_separator(spark, path)
        df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
        df.columns  # noqa: B018  (resolves the header now, so errors surface here)
        return df, None
    except Exception as e:  # noqa: BLE001
        return None, f"could not read file: {e}"


def weather_rows(responses: DataFrame, doc: Column | str = "daily",
                 keep: list[str] | None = None) -> DataFrame:
    """SRC-5: landed weather responses -> one row per day.

    ``responses`` carries a ``daily`` struct of parallel arrays (time,
    temperature_2m_max, weather_code). ``arrays_zip`` + ``inline`` unzips them
    element-wise inside the task; responses without ``daily`` yield no rows
    (see ``weather_quarantine``).
    """
    keep = keep or []
    d = F.col(doc) if isinstance(doc, str) else doc
    z = responses.filter(d.isNotNull()).select(
        *keep, F.inline(F.arrays_zip(d["time"].alias("time"),
                                     d["temperature_2m_max"].alias("temperature_2m_max"),
                                     d["weather_code"].alias("weather_code"))))
    cat = weather_category(F.col("weather_code"))
    return z.select(*keep, "time", "temperature_2m_max", "weather_code",
                    cat["weather_icon"].alias("weather_icon"),
                    cat["weather_condition"].alias("weather_condition"),
                    F.to_date("time").alias("date"),
                    F.col("temperature_2m_max").alias("temperature_max"))


def weather_quarantine(responses: DataFrame, doc: str = "daily") -> DataFrame:
    """SRC-5: responses without a ``daily`` block (API errors) with their reason."""
    return responses.filter(F.col(doc).isNull())


def parse_weather_json(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Parse response text with the fixed schema (bad JSON -> null struct)."""
    return df.withColumn("_r", F.from_json(F.col(json_col), WEATHER_RESPONSE)).select(
        "*", "_r.latitude", "_r.longitude", "_r.reason", "_r.daily").drop("_r")


def read_weather_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed response files (one JSON document per line)."""
    return spark.read.schema(WEATHER_RESPONSE).json(path)


def read_model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: one-row frame ``training_timestamp`` (null when the file or the
    key is missing, or the value is no timestamp)."""
    try:
        raw = spark.read.option("multiLine", True).json(path)
        if "training_timestamp" not in raw.columns:
            raise KeyError("training_timestamp")
        return raw.select(F.try_to_timestamp(F.col("training_timestamp").cast("string"))
                          .alias("training_timestamp")).limit(1)
    except Exception:  # noqa: BLE001  (missing file / key -> null, like the app)
        return spark.createDataFrame([(None,)], "training_timestamp timestamp")


def read_model_metadata_full(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(MODEL_METADATA).json(path)


@dataclass(frozen=True)
class FileHead:
    """A file's path and size and its first lines that are not blank."""

    path: str
    length: int
    lines: list[str]


def file_heads(spark: SparkSession, paths: list[str] | str) -> list[FileHead]:
    """The heads of all files under ``paths``, by path: Spark lists the files
    (their content is not read), then the first ``HEAD_BYTES`` of each are
    read, more only while these hold no line. The driver gets these bytes, a
    few files at a time, and keeps the lines."""
    listed = spark.read.format("binaryFile").load(paths).select("path", "length").collect()

    def head(path: str, length: int) -> FileHead:
        p, fs, _ = _fs(spark, path)
        stream, data = fs.open(p), b""
        try:
            while len(data) < length and (not data or b"\n" not in data.strip()):
                data += bytes(stream.readNBytes(max(HEAD_BYTES, len(data))))
        finally:
            stream.close()
        if len(data) < length:  # the last line is not whole
            data = data[:data.rfind(b"\n") + 1] or data
        lines = data.decode("utf-8", "replace").lstrip("\ufeff").splitlines()
        return FileHead(path, length, [x for x in lines if x.strip()][:HEAD_LINES])

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(lambda r: head(r["path"], r["length"]), sorted(listed)))


def choose_separator(lines: list[str]) -> str:
    """SRC-3: the candidate by which the lines have as many fields as the
    first one (separators within quotes don't count): at least half of the
    lines must, more than one field is better than one, then the more lines,
    the more fields, the earlier candidate."""

    def score(i: int) -> tuple:
        fields = [len(next(csv.reader([x], delimiter=CANDIDATE_SEPARATORS[i]), [])) for x in lines]
        same = sum(n == fields[0] for n in fields[1:]) / (len(fields) - 1) if len(fields) > 1 else 1.0
        return same >= 0.5, fields[0] > 1, same, fields[0], -i

    return CANDIDATE_SEPARATORS[max(range(len(CANDIDATE_SEPARATORS)), key=score)]


def header_names(header: str, sep: str) -> list[str]:
    """A header line's names as a CSV parser reads them (quotes, byte-order mark)."""
    return [h.strip() for h in next(csv.reader([header.lstrip("\ufeff").rstrip("\r")], delimiter=sep))]


#: What ``with_position`` adds.
POSITION = ["_file", "_file_time", "_block", "_id"]


def with_position(df: DataFrame) -> DataFrame:
    """``df``, straight from a file scan, with each row's file, the file's
    time, the split's place in it and an id that grows within the split."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_modification_time").alias("_file_time"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_id"))


def file_ordinals(rows: DataFrame, few: bool, name: str = "ordinal") -> DataFrame:
    """WIN-2 for file reads: 0-based data-row position inside each file, from
    the columns that ``with_position`` added; all its rows must be there.

    Rows of one split are consecutive in their partition, so ``id - min(id)``
    per (file, split) is the position inside the split, and the rows before it
    are those of the file's earlier splits: one counting pass, then a prefix
    sum over the splits, never a sort or window over rows. The list of the
    splits comes to the driver and is broadcast while ``few`` (see
    ``few_splits``); beyond, it stays distributed. The counting pass reads
    ``rows`` by itself: hand in a written or checkpointed table, or a scan,
    whose splits are counted without reading its columns."""
    splits = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    if few:
        shifts, file, before = [], None, 0
        for r in sorted(splits.collect()):
            file, before = r["_file"], before if r["_file"] == file else 0
            shifts.append((file, r["_block"], before - r["_first"]))
            before += r["_n"]
        shifts = F.broadcast(rows.sparkSession.createDataFrame(shifts, "_file string, _block bigint, _shift bigint"))
    else:
        earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        shifts = splits.select("_file", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = rows.join(shifts, ["_file", "_block"])
    return joined.withColumn(name, F.col("_id") + F.col("_shift")).drop("_block", "_id", "_shift")


def few_splits(spark: SparkSession, heads: list[FileHead]) -> bool:
    """Whether the files' splits are at most ``BROADCAST_SPLITS``."""
    size = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")))
    # splits may be smaller than that, where files are few and cores many
    return sum(1 + h.length // min(size, SMALLEST_SPLIT) for h in heads) <= BROADCAST_SPLITS


def unique_names(names: list[str]) -> list[str]:
    """Header names made unique (case-insensitive): repeats become
    ``<name>__dup<n>`` so the file can be read and the repeat reported."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = n.lower()
        seen[k] = seen.get(k, 0) + 1
        out.append(n if seen[k] == 1 else f"{n}__dup{seen[k]}")
    return out


def read_csv_files(spark: SparkSession, paths: list[str] | str, unreadable: list[str] | None = None,
                   ordinal: bool = True, position: bool = False) -> list[tuple[str, DataFrame]]:
    """SRC-3 for many files: grouped by header line and separator (see
    ``choose_separator``), each group read once, every column as string.
    Returns ``(header, df)`` pairs. With ``ordinal``, ``df`` also has ``_file``,
    ``_file_time`` (when it was last written) and ``ordinal`` (position inside
    its file); with ``position``, what ``file_ordinals`` makes that of, for a
    caller that writes the rows first. Files without a line are appended to
    ``unreadable`` when given.
    """
    heads = file_heads(spark, paths)
    groups: dict[tuple[str, str], list[str]] = {}
    for h in heads:
        if h.lines:
            groups.setdefault((h.lines[0], choose_separator(h.lines)), []).append(h.path)
        elif unreadable is not None:
            unreadable.append(h.path)
    if unreadable is not None and isinstance(paths, list):  # Spark lists no empty files
        named = {urlsplit(h.path).path: 1 for h in heads}
        unreadable.extend(p for p in paths if urlsplit(p).path not in named)
    few, out = few_splits(spark, heads), []
    for (header, sep), files in sorted(groups.items()):
        names = unique_names(header_names(header, sep))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.csv(sorted(files), sep=sep, header=True, schema=schema, enforceSchema=True)
        if ordinal or position:
            df = with_position(df)
        out.append((header, file_ordinals(df, few) if ordinal and not position else df))
    return out
