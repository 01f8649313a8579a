"""The divergence audit against sums over every term and pair of sources."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from platewise.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long, value string, item long"


def brute(docs, least=10, ranks=10):
    """``docs``: (text, lang, source)."""
    found, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        found[lang or "", source or ""].update(words)
        documents[lang or ""].update(set(words))
    out = []
    for lang, of in documents.items():
        kept = [t for t, n in of.items() if n >= least]
        sources = [s for k, s in found if k == lang]
        whole = Counter()
        for s in sources:
            whole.update(found[lang, s])

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return [1 + 10 ** 9 * (counts[t] + 2) // total for t in kept]

        of_lang, p = shares(whole), {s: shares(found[lang, s]) for s in sources}
        for s in sources:
            lists = {"pair": [(-sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o])), o.encode()) for o in sources if o != s],
                     "term": [(-((a - b) ** 2 // (a + b)), t.encode()) for t, a, b in zip(kept, p[s], of_lang)
                              if found[lang, s][t] and a > b]}
            for part, items in lists.items():
                for rank, (value, item) in enumerate(sorted(items)[:ranks if part == "term" else None], 1):
                    out.append((lang, s, part, item.decode(), -value, rank))
    return sorted(out)


def run(spark, docs, **how):
    rows = [(7, *d, "t", 1, "v", 2) for d in docs]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
    return sorted(tuple(r) for r in D.audit(df, **how).collect())


def documents(seed, n=120, sources=6):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "été", "straße", "日本", "a", "b1c", "x_y", "z w", "rare", "é"]
    return [(" ".join(rng.choice(words, rng.integers(0, 12), p=[.2, .2, .1, .1, .1, .1, .05, .05, .05, .02, .03])),
             str(rng.choice(["en", "de"])), f"s{rng.integers(0, sources) ** 2 // sources}") for _ in range(n)]


@pytest.mark.parametrize("least", [1, 10])
def test_matches_sums_over_all_terms(spark, least):
    docs = documents(1)
    assert run(spark, docs, least_documents=least) == brute(docs, least)


def test_nulls_empty_texts_and_sources_without_terms(spark):
    docs = documents(2, 60) + [(None, None, None), ("", "en", "none"), ("12 34", "en", None), ("the " * 50_000, "en", "long"),
                               ("one two", "xx", "a"), ("one", "xx", "b"), ("alone", "yy", "s")] + [("tie", "zz", "q")] * 12
    got = run(spark, docs)
    assert got == brute(docs)
    assert ("xx", "a", "pair", "b", 0, 1) in got  # no term is kept there
    assert not [r for r in got if r[0] == "yy"] and [r[2:] for r in got if r[0] == "zz"] == []


def test_empty_table(spark):
    assert run(spark, []) == []


def test_equal_values_rank_by_utf8(spark):
    words = ["zeta", "￮", "\U0001f600", "alpha"]
    docs = [(" ".join(words), "en", "a")] * 12 + [("other " * 4, "en", "b")] * 12
    got = run(spark, docs)
    assert got == brute(docs)
    assert [r[3] for r in got if r[1:3] == ("a", "term")] == sorted(words, key=str.encode)


def batch(rows):
    path = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("zero", pa.int64())]))
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows]), pa.array([[dict(zip(("source", "p", "zero"), x)) for x in r[1]] for r in rows], path),
        pa.array([r[2] for r in rows], pa.int64())], names=["lang", "path", "n"])


@pytest.mark.parametrize("items, combinations", [(1 << 19, 1 << 20), (7, 1 << 20), (1 << 19, 5), (1, 1)])
def test_tree_of_any_batch_size_gives_the_plain_sums(monkeypatch, items, combinations):
    monkeypatch.setattr(D, "TREE_ITEMS", items)
    monkeypatch.setattr(D, "COMBINATIONS", combinations)
    rng = np.random.default_rng(4)
    zero = {s: 100 + i for i, s in enumerate("abcdef")}
    rows = Counter()
    for _ in range(300):
        held = sorted(rng.choice(list("abcdef"), rng.integers(1, 7), replace=False))
        rows[str(rng.choice(["en", "de"])), tuple((s, int(rng.integers(1, 4)) * 1000, zero[s]) for s in held)] += int(rng.integers(1, 9))
    want = Counter()
    for (lang, path), n in rows.items():
        for j, (b, pb, zb) in enumerate(path):
            for a, pa_, za in path[:j]:
                want[lang, a, b] += n * (D._f(pa_, pb) - D._f(pa_, zb) - D._f(za, pb) + D._f(za, zb))
    got = Counter()
    for out in D._corrections(iter([batch([(*k, n) for k, n in sorted(rows.items())])])):
        for r in out.to_pylist():
            got[r["lang"], r["source"], r["item"]] += r["value"]
    assert got == want


def test_rows_share_nodes():
    # a1 b1, a1 b1 c1, a1 c2, then another language's a1
    langs, starts = np.array([0, 0, 0, 1]), np.array([0, 2, 5, 7, 8])
    items = np.array([1, 2, 1, 2, 3, 1, 4, 1])
    row, at, times = D.tree_nodes(langs, starts, items, np.array([5, 1, 2, 7]))
    assert sorted(zip(row.tolist(), at.tolist(), times.tolist())) == [(0, 0, 8), (0, 1, 6), (1, 4, 1), (2, 6, 2), (3, 7, 7)]
