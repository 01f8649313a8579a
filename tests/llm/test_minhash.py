"""Near duplicates against brute force over all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import minhash as M

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, band long, node string"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4)))


def brute(rows, percent):
    """{doc_id: (n_shingles, component_id)} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    near = {frozenset(p) for h in holders.values() for a, p in enumerate(h) for p in [(p, q) for q in h[a + 1:]]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in near:
        a, b = p
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("percent", [85, 80])
def test_components_match_brute_force(spark, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, percent)
    assert len(set(c for _, c in want.values())) < len(want)
    assert got(M.near_duplicates(docs, percent)) == want


def test_chains_and_crossing_groups(spark, monkeypatch):
    """Links that only members other than the bucket's first have, with tiles of two members."""
    monkeypatch.setattr(M, "TILE", 2)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(6):
        base = list(rng.choice(words, 120))
        for k in range(9):  # each differs from the one before in two words
            base = list(base)
            for p in rng.integers(0, 120, 2):
                base[p] = f"x{g}_{k}_{p}"
            rows.append((100 * g + (k * 7) % 9, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(M.near_duplicates(docs, 85)) == brute(rows, 85)


def test_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(7, None, "a", 1, "n"), (8, "", None, 1, "n"), (9, " \t\n", None, 1, "n"),
            (1, "One two three", "en", 1, "n"), (2, "one TWO three", "en", None, None), (3, "one two four", "en", 1, "n"),
            (4, long, "en", 1, "n"), (5, long + " end", "en", 1, "n"),
            (6, "a b c d e f", "en", 1, "n"), (6, "a b c d e f", "en", 1, "n"),
            (None, "q r s t u v", "en", 1, "n"), (10, "q r s t u v", "en", 1, "n"), (None, "only here", "en", 1, "n")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = M.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None}
    assert by[7] == (0, 7, True) and by[8] == (0, 8, True) and by[9] == (0, 9, True)
    assert by[1] == (1, 1, True) and by[2] == (1, 1, False) and by[3] == (1, 3, True)
    assert by[4] == (29_996, 4, True) and by[5] == (29_997, 4, False)
    assert by[6] == (2, 6, True) and by[10] == (2, 10, True)
    assert sorted((r["component_id"] is None, r["kept"]) for r in out if r["doc_id"] is None) == [(False, False), (True, True)]
    kept = M.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 6, 7, 8, 9, 10]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert M.near_duplicates(docs).count() == 0
    assert M.drop_near_duplicates(docs).count() == 0


def test_signature_is_the_scalar_definition():
    elements = np.array([5, 77, 123456789, 2**60], np.uint64)
    want = [2**64 - 1] * M.SLOTS
    for e in elements:
        order = list(range(M.SLOTS))
        for j in range(M.SLOTS):
            r = M._mix(np.array([e]) + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64))
            k = j + int(r[0] >> np.uint64(40)) % (M.SLOTS - j)
            order[j], order[k] = order[k], order[j]
            want[order[j]] = min(want[order[j]], j << 32 | int(M._mix(r)[0] >> np.uint64(32)))
    assert [int(x) for x in M.signatures([elements])[0]] == want


def test_components_over_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long").repartition(7)
    roots = {r["node"]: r["root"] for r in M.components(links).collect()}
    assert roots == {i: 0 for i in range(1, 201)} | {501: 500}
    assert M.components(links.filter(F.lit(False))).count() == 0
