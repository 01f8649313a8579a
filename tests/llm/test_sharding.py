"""Packing against a plain best-fit decreasing, and the laws of the shards."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from platewise.llm import sharding as S

SF = "/root/testdata/sf0.01"


def plain(sizes, rooms=None, capacity=None):
    left, out = list(rooms or []), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [(r, b) for b, r in enumerate(left) if r >= sizes[i]]
        if fit:
            b = min(fit)[1]
        elif capacity is not None:
            b = len(left)
            left.append(capacity)
        else:
            b = max((r, b) for b, r in enumerate(left))[1]
        left[b] -= sizes[i]
        out[i] = b
    return out, left


def test_packing_matches_a_plain_search():
    rng = random.Random(2)
    for n in (0, 1, 5, 60, 400):
        sizes = [rng.randint(1, 50) for _ in range(n)]
        assert S.best_fit_decreasing(sizes, capacity=60) == plain(sizes, capacity=60)
        rooms = [sum(sizes) / 7] * 7
        assert S.best_fit_decreasing(sizes, rooms) == plain(sizes, rooms)


def test_tree_stays_balanced():
    tree, held, rng = S.CapacityTree(), set(), random.Random(4)
    for k in range(4000):
        if held and rng.random() < 0.4:
            x = rng.choice(sorted(held))
            held.discard(x)
            tree.remove(*x)
        else:
            x = (rng.randint(0, 500), k)
            held.add(x)
            tree.add(*x)
        size = rng.randint(0, 520)
        assert tree.tightest(size) == min((x for x in held if x[0] >= size), default=None)

    def depth(n):
        return 0 if n is None else 1 + max(depth(n[2]), depth(n[3]))

    assert depth(tree.root) <= 2 * len(held).bit_length()


def check(rows, out, shards, split=()):
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    where = defaultdict(set)
    text = {i: t or "" for i, t in rows}
    for r in out:
        if r["doc_id"] is not None and text[r["doc_id"]] not in split:
            where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


@pytest.mark.parametrize("cell", [S.PER_CELL, 100])
def test_shards_of_documents(spark, monkeypatch, cell):
    monkeypatch.setattr(S, "PER_CELL", cell)
    monkeypatch.setattr(S, "PER_BUCKET", 10)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = S.shard_documents(docs, 16).collect()
    check([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], out, 16)
    load = defaultdict(int)
    for r in out:
        load[r["shard"]] += r["size"]
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 16


def test_a_group_larger_than_a_shard_is_split(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text")
                                    .otherwise(F.concat(F.lit("text of number "), F.col("id"))).alias("text"))
    out = S.shard_documents(docs, 8).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, out, 8, split={"the same text"})
    load = defaultdict(int)
    for r in out:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.1 * sum(load.values()) / 8


def test_as_few_shards_of_a_capacity_as_hold_all(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = S.shard_documents(docs, capacity=200_000).collect()
    load = defaultdict(int)
    for r in out:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 200_000 and len(load) <= -(-sum(load.values()) // 200_000) + 1


def test_edge_rows(spark):
    schema = "doc_id long, text string, shard string, size int"
    rows = [(1, None), (2, ""), (None, "é" * 10), (3, "x"), (3, "x"), (4, "long " * 20_000)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], schema)
    out = S.shard_documents(docs, 4).collect()
    assert {r["doc_id"]: r["size"] for r in out} == {1: 1, 2: 1, None: 21, 3: 2, 4: 100_001}
    assert len({r["shard"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert len({r["shard"] for r in out if r["doc_id"] == 3}) == 1
    assert S.shard_documents(spark.createDataFrame([], schema), 4).count() == 0
