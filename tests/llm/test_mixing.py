"""The mix's targets against a plain water filling, and the laws of rounding."""

import re
from collections import defaultdict
from statistics import mean

import pytest
from pyspark.sql import functions as F

from platewise.llm import mixing as M

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, target string, copies int"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "PythonUDF", "FlatMapGroupsIn")


def plain_targets(sizes):
    """Share by weight, stop what is above its limit, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * share > 3 * sizes[s]}
        if not above:
            target.update({s: weight[s] * share for s in open_})
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 3, None: 5}, {"B": 5, "a": 0, "é": 9},
                  {"x": 7}, {f"s{i}": (i * 37) % 11 + 1 for i in range(40)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def check(rows, out):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target, taken, largest = plain_targets(sizes), defaultdict(int), defaultdict(int)
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in out) == sorted(
        (str(i), str(s), words(t)) for i, t, s in rows)
    for r in out:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        due = target[r["source"]] / max(1, sizes[r["source"]])
        assert int(due + 1e-9) <= r["copies"] + 1e-9 and r["copies"] < due + 1
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in target)


@pytest.mark.parametrize("block", [M.BLOCK, 4])
def test_documents(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = M.mix(docs).collect()
    check([(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()], out)
    again = M.mix(docs.repartition(5, "n_chars")).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in out) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_expected_copies_stay_what_they_were(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "a") for i in range(40)] + [(100 + i, "w " * 9, "b") for i in range(60)]
    docs, held = frame(spark, rows).cache(), defaultdict(list)
    for seed in range(12):
        monkeypatch.setattr(M, "_SEED", seed)
        for r in M.mix(docs).collect():
            held[r["doc_id"]].append(r["copies"])
    by_source = {s: mean(mean(held[i]) for i in ids) for s, ids in (("a", range(40)), ("b", range(100, 160)))}
    targets = plain_targets({"a": sum(words(t) for _, t, s in rows if s == "a"), "b": 540})
    assert abs(by_source["b"] - targets["b"] / 540) < 0.05
    part = targets["b"] / 540 % 1
    assert all(abs(mean(held[i]) % 1 - part) < 0.45 for i in range(100, 160))  # no document is favoured


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, " \t", "a"), (4, "one two", "a"), (4, "one two", "a"), (None, "x y z", "a"),
            (5, "only", None), (6, "w " * 50_000, "b"), (7, "q", "b")]
    out = M.mix(frame(spark, rows)).collect()
    check(rows, out)
    assert len({r["copies"] for r in out if r["doc_id"] == 4}) == 1
    assert M.mix(frame(spark, [])).count() == 0
    none = M.mix(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [(r["target"], r["taken"]) for r in none] == [(0.0, 0)] * 2


def test_mixed_documents_repeat_as_planned(spark):
    rows = [(i, f"text number {i}", "abc"[i % 3]) for i in range(60)] + [(99, "left alone", "a")]
    docs = frame(spark, rows)
    plan = {r["doc_id"]: r["copies"] for r in M.mix(docs).collect()}
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r["doc_id"]] += 1
    assert count == {i: c for i, c in plan.items() if c}


def test_hot_source(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    rows = [(i, "w " * (1 + i % 13), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(1500)]
    check(rows, M.mix(frame(spark, rows)).collect())


def test_no_python_in_the_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rounded = M.mix(docs).withColumn("x", F.col("copies") + 1)
    plan = rounded._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PYTHON_NODES)
