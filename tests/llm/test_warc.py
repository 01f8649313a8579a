"""Archives and index against what was written."""

import gzip
import hashlib
from bisect import bisect_left

import pytest

from platewise.llm import warc as W

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, digest string, offset int"


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        again = len(raw) >= 100 and f is not None and i != f
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")))
                  for r in df.collect())


def test_pages(spark, tmp_dir):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert got(W.archive_pages(pages, f"{tmp_dir}/warc")) == brute(rows)


def test_edge_rows(spark, tmp_dir):
    long = "<p>" + "é" * 200
    rows = [(1, "http://a.com/", long), (2, "http://a.com/", long), (3, None, None), (4, "", ""), (5, "http://b.com", None),
            (6, "not a url\twith\ttabs\nand lines", "short"), (7, "http://b.com", "short"), (None, "http://c.com", long),
            (8, "http://[bad", "x" * 99), (9, "http://d.com:80x/", "x" * 99), (10, "http://e.com/ü?q=ü#f", "x" * 100),
            (11, "http://e.com/%C3%BC", "x" * 100), (12, "http://f.com", "y" * 1_000_000 + "\r\n\r\nWARC/1.1\r\n"),
            (2, "http://a.com/", long), (13, "http://g.com", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(W.archive_pages(pages, f"{tmp_dir}/warc")) == brute(rows)
    assert W.archive_pages(spark.createDataFrame([], SCHEMA), f"{tmp_dir}/none").count() == 0


def test_two_level_index(spark, tmp_dir):
    """Many blocks and files, one URL over several of them."""
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 50}" if i % 3 else "http://hot.example.com/", f"<html>{i % 90}" * 20)
            for i in range(W.BLOCK * 3 + 17)]
    root = f"{tmp_dir}/warc"
    captures = W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), root)
    assert captures.count() == len(rows)
    files = W.build_index(captures, root)
    reader = W.Reader(root, files)
    assert len(files) > 1 and [c.place for c in files] == sorted(c.place for c in files)
    want = sorted(i for i, u, _ in rows if u == "http://hot.example.com/")
    assert [c.page_id for c in reader.captures("HTTP://hot.example.com")] == want
    assert list(reader.captures("http://nowhere.example.com")) == []
    for i in (0, 1, 3, 500, len(rows) - 1):
        digest = hashlib.sha256(rows[i][2].encode()).hexdigest()
        c = reader.find(W.url_key(rows[i][1]), i, digest)
        assert reader.read(c)["page_id"] == i
        assert reader.find(W.url_key(rows[i][1]), i, "0" * 64) is None
    assert len(reader.kept) <= 24


def test_records_are_standard_gzip_members():
    raw = W.record(5, "http://a.com/x y", b"<p>hi", hashlib.sha256(b"<p>hi").hexdigest(), None)
    raw += W.record(6, "http://a.com/z", b"<p>hi", hashlib.sha256(b"<p>hi").hexdigest(), 5)
    text = gzip.decompress(raw).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Target-URI: http://a.com/x%20y\r\n" in text
    assert text.count("<p>hi") == 1 and W.REVISIT_PROFILE in text


@pytest.mark.parametrize("url,key", [
    ("http://www.Example.com/a?b=1#c", "com,example,www)/a?b=1"), ("https://x.org", "org,x)/"), ("http://x.org:8080/", "org,x:8080)/"),
    (None, ""), ("", ""), ("plain words", "plain%20words"), ("http://user@x.org/", "org,x)/")])
def test_url_keys(url, key):
    assert W.url_key(url) == key


def test_keys_sort_hosts_together():
    keys = sorted(map(W.url_key, ["http://a.x.org/", "http://b.com/", "http://x.org/", "http://b.x.org/"]))
    assert keys == ["com,b)/", "org,x)/", "org,x,a)/", "org,x,b)/"] and bisect_left(keys, "org,x") == 1
