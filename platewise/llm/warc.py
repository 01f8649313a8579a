"""WARC archives of pages and a two-level capture index.

Tasks write pages as gzipped WARC/1.1 records; a payload that an earlier page
has too becomes a revisit. The index sorts the captures by their URL with the
host reversed, cuts them into compressed blocks and keeps, at the end of each
index file, a sparse directory of the blocks' first keys. A reader holds the
index files' first keys only: it searches those, then one directory, then one
block, and reads the record's bytes from its archive.

Archives and index files are written to the shared folder with pyarrow's file
systems (file, S3, GCS, HDFS). A task's files have names of their own, and
only files that a finished task names are in the index, so a task that is run
again leaves no second record, at most a file that nothing refers to.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import materialise, sized_join
from platewise.session import scratch_dir

#: An archive file is closed once it holds so many bytes.
ARCHIVE_BYTES = 128 << 20
#: Captures of an index block, and of an index file, about.
BLOCK, FILE_CAPTURES = 2048, 1_000_000
#: Equal payloads of at least so many bytes are revisits.
LEAST_PAYLOAD = 100
GZIP_LEVEL = 3
#: Fixed by the format's standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages have no capture time; a record must have one.
DATE = "1970-01-01T00:00:00Z"
_NO_ID = -(1 << 63)


class Capture(NamedTuple):
    """An index line. Lines are sorted by the first three fields."""

    key: str
    page_id: int
    digest: str
    file: str
    offset: int
    length: int

    @property
    def place(self) -> tuple[bytes, int, str]:
        return self.key.encode(), self.page_id, self.digest


def url_key(url: str | None) -> str:
    """The URL with its host reversed (``com,example,www)/path?query``),
    lower-case host, without scheme, user and fragment. Characters outside
    ASCII and white space are escaped. What has no host is its own key; null
    is the empty key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        host, port = "", None
    if not host:
        return quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return quote(key + (f"?{parts.query}" if parts.query else ""), safe="%/:=&?~#+!$,;'@()*[]")


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


# ---- records --------------------------------------------------------------
def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzipped WARC record: a response with its payload, or a revisit of
    page ``refers_to`` without."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if refers_to is None else b"")
    target = quote(url or f"urn:page:{page_id}", safe="%/:=&?~#+!$,;'@()*[]")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{digest}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a
    gzipped record. A response's digest is that of its payload as read."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if version != "WARC/1.1" or not rest.endswith(b"\r\n\r\n") or int(fields["Content-Length"]) != len(rest) - 4:
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    ids = [fields.get(k, "::").strip("<>").split(":")[2] for k in ("WARC-Record-ID", "WARC-Refers-To")]
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"the payload of page {ids[0]} is not what its digest says")
    else:
        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), stated
    return {"page_id": int(ids[0]) if ids[0] else None, "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": int(ids[1]) if ids[1] else None}


# ---- writing --------------------------------------------------------------
def _archive(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(root)
        out, name = None, ""
        try:
            for b in batches:
                lines = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None or out.tell() >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        fs.create_dir(folder, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    raw = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                    lines.append(Capture(url_key(url), _NO_ID if page_id is None else page_id, digest, name,
                                         out.tell(), len(raw))._asdict())
                    out.write(raw)
                yield pa.RecordBatch.from_pylist(lines, schema=_CAPTURE)
        finally:
            if out is not None:
                out.close()

    return write


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("file", pa.string()),
                      ("offset", pa.int64()), ("length", pa.int64())])
_CAPTURE_SQL = "key string, page_id long, digest string, file string, offset long, length long"


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record under
    ``root`` and return the captures. The html goes from its scan to the
    archive; only pages' ids and digests are shuffled, to find the revisits
    (the html is, too, when the list of revisits is too large to broadcast)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    thin = materialise(rows.select("page_id", "digest", F.octet_length("html").alias("bytes")), "warc-pages")
    first = thin.filter(F.col("bytes") >= LEAST_PAYLOAD).groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = thin.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = materialise(revisits.select("digest", F.coalesce("page_id", F.lit(_NO_ID)).alias("_id"), "refers_to")
                           .distinct(), "warc-revisits")
    marked = sized_join(rows.withColumn("_id", F.coalesce("page_id", F.lit(_NO_ID))), revisits, ["digest", "_id"], "left")
    return materialise(marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(
        _archive(root), _CAPTURE_SQL), "warc-captures")


# ---- the index ------------------------------------------------------------
def _index_file(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(root)
        name, out, directory, held = f"{uuid.uuid4().hex}.idx", None, [], []

        def flush(lines: list[Capture]) -> None:
            nonlocal out
            if out is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
            raw = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode())
            directory.append([*lines[0][:3], out.tell(), len(raw)])
            out.write(raw)

        for b in batches:
            held += [Capture(*x) for x in zip(*(c.to_pylist() for c in b.columns))]
            while len(held) >= BLOCK:
                flush(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            flush(held)
        if out is not None:
            raw, at = zlib.compress(json.dumps(directory).encode()), out.tell()
            out.write(raw)
            out.close()
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "page_id", "digest", "file", "offset", "length"),
                                                       (*directory[0][:3], name, at, len(raw))))], schema=_CAPTURE)

    return write


def _sorted(captures: DataFrame, n: int) -> DataFrame:
    parts = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / FILE_CAPTURES))
    return captures.repartitionByRange(parts, "key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest")


def build_index(captures: DataFrame, root: str) -> list[Capture]:
    """Write the index of ``captures`` under ``root``. Returns a line per
    index file with its first key and its directory's place: one for a
    million captures, so a list of bounded size."""
    files = _sorted(captures, captures.count()).mapInArrow(_index_file(root), _CAPTURE_SQL)
    return sorted((Capture(*r) for r in files.collect()), key=lambda c: c.place)


class Reader:
    """Looks captures up and reads their records. Holds a few directories,
    blocks and open archives at a time."""

    def __init__(self, root: str, files: list[Capture]):
        self.fs, self.folder = filesystem(root)
        self.files, self.firsts = files, [c.place for c in files]
        self.kept: OrderedDict = OrderedDict()

    def _keep(self, what, make, most: int = 24):
        if what in self.kept:
            self.kept.move_to_end(what)
        else:
            self.kept[what] = make()
            while len(self.kept) > most:
                self.kept.popitem(last=False)
        return self.kept[what]

    def _bytes(self, name: str, offset: int, length: int) -> bytes:
        f = self._keep(name, lambda: self.fs.open_input_file(f"{self.folder}/{name}"))
        return f.read_at(length, offset)

    def _directory(self, c: Capture) -> tuple[list, list]:
        lines = json.loads(zlib.decompress(self._bytes(c.file, c.offset, c.length)))
        return [(k.encode(), i, d) for k, i, d, _, _ in lines], [x[3:] for x in lines]

    def _block(self, name: str, offset: int, length: int) -> tuple[list, list[Capture]]:
        lines = zlib.decompress(self._bytes(name, offset, length)).decode().split("\n")
        got = [Capture(k, int(i), d, f, int(o), int(n)) for k, i, d, f, o, n in (x.split("\t") for x in lines)]
        return [c.place for c in got], got

    def find(self, key: str, page_id: int, digest: str) -> Capture | None:
        place = key.encode(), page_id, digest
        at = bisect_right(self.firsts, place) - 1
        if at < 0:
            return None
        c = self.files[at]
        firsts, blocks = self._keep((c.file, "directory"), lambda: self._directory(c))
        b = bisect_right(firsts, place) - 1
        if b < 0:
            return None
        places, captures = self._keep((c.file, b), lambda: self._block(c.file, *blocks[b]))
        i = bisect_left(places, place)
        return captures[i] if i < len(places) and places[i] == place else None

    def read(self, c: Capture) -> dict:
        return parse(self._bytes(c.file, c.offset, c.length))

    def captures(self, url: str) -> Iterator[Capture]:
        """All captures of a URL, in order of page_id."""
        place = url_key(url).encode(), _NO_ID, ""
        for c in self.files[max(0, bisect_right(self.firsts, place) - 1):]:
            firsts, blocks = self._directory(c)
            for b in range(max(0, bisect_right(firsts, place) - 1), len(blocks)):
                if firsts[b][0] > place[0]:
                    return
                yield from (x for x in self._block(c.file, *blocks[b])[1] if x.key.encode() == place[0])


_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_back(wanted: DataFrame, root: str, files: list[Capture], n: int) -> DataFrame:
    """The records of ``wanted`` (key, page_id, digest), through the index. A
    capture that is missing is an error."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(root, files)
        for b in batches:
            rows = []
            for want in zip(*(c.to_pylist() for c in b.columns)):
                c = reader.find(*want)
                if c is None:
                    raise LookupError(f"no capture of page {want[1]}")
                rows.append(reader.read(c))
            yield pa.RecordBatch.from_pylist(rows, schema=_BACK)

    return _sorted(wanted.select("key", "page_id", "digest"), n).mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column("url").to_pylist()], pa.string()),
                                          b.column("page_id"), b.column("digest")], ["key", "page_id", "digest"])


def archive_pages(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are ignored) as
    archives with an index under ``root`` (by default a new folder in the
    shared one), then read every page's record back through the index: one
    row per page with page_id, payload_bytes, payload_digest, record_type,
    refers_to.

    A null html is an empty payload, a null URL the empty key. Payloads under
    ``LEAST_PAYLOAD`` bytes are always responses. Rows with a null page_id
    revisit a page that has one. Rows that repeat page_id and payload are the
    same capture and get the same type. An empty table gives none."""
    root = root or scratch_dir(pages.sparkSession, "llm-warc")
    captures = write_archives(pages, root)
    files = build_index(captures, root)
    rows = pages.select("url", F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("page_id"),
                        F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    wanted = rows.mapInArrow(_keys, "key string, page_id long, digest string")
    return read_back(wanted, root, files, captures.count())
