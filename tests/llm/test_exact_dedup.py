"""Exact dedup against grouping the texts plainly."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from platewise.llm import exact_dedup as D
from platewise.llm import golomb as G

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, h string, part int, kept boolean"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(map(str, out))


def got(df):
    return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
@pytest.mark.parametrize("span", [1 << 48, 10_007])
def test_golomb_round_trip(n, span):
    values = np.unique(np.random.default_rng(n).integers(0, span, n))
    code = G.golomb_encode(values, span)
    assert G.golomb_decode(code, len(values)).tolist() == values.tolist()
    if n == 500:
        assert len(code) * 8 <= len(values) * (np.log2(span / len(values)) + 3)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(D.exact_dedup(docs)) == brute(rows)


def written(spark, tmp_dir, rows, files=3):
    path = f"{tmp_dir}/docs"
    spark.createDataFrame([(*r, "x", 1, False) for r in rows], SCHEMA).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def test_edge_rows(spark, tmp_dir):
    rows = [(1, None), (2, ""), (3, " "), (4, "\t\n "), (5, "a  b"), (6, "a\tb"), (6, "a\tb"), (None, "a b"), (None, "z"),
            (7, "a b"), (8, "A b"), (9, "w " * 100_000), (10, "w " * 100_000), (2, "other")]
    docs = written(spark, tmp_dir, rows)
    assert got(D.exact_dedup(docs)) == brute(rows)
    kept = D.drop_copies(docs)
    assert kept.columns == docs.columns
    # null and empty are equal, and white space alone is one space
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 5, 7, 8, 9, None]))


def test_repeated_rows_keep_one(spark, tmp_dir):
    docs = written(spark, tmp_dir, [(1, "same"), (1, "same"), (1, "same"), (2, "same"), (3, "new")])
    out = [(r["doc_id"], r["kept"]) for r in D.exact_dedup(docs).collect()]
    assert sorted(out) == [(1, False), (1, False), (1, True), (2, False), (3, True)]
    assert sorted(r["doc_id"] for r in D.drop_copies(docs).collect()) == [1, 3]


def test_hot_group(spark, tmp_dir):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = written(spark, tmp_dir, rows, 9)
    assert got(D.exact_dedup(docs)) == brute(rows)


def test_batches_cut_into_pieces(spark, tmp_dir):
    rows = [(i, f"{i % 40} " + "word " * 40_000) for i in range(80)]  # 16 MB
    assert got(D.exact_dedup(written(spark, tmp_dir, rows, 1))) == brute(rows)


def test_false_matches_are_verified(spark, tmp_dir):
    rows = [(i, f"text {i % 400}") for i in range(900)]  # texts share six-bit fingerprints all the time
    assert got(D.exact_dedup(written(spark, tmp_dir, rows), bits=6)) == brute(rows)


def test_empty_table(spark, tmp_dir):
    docs = written(spark, tmp_dir, [])
    assert D.exact_dedup(docs).count() == 0 and D.drop_copies(docs).count() == 0
