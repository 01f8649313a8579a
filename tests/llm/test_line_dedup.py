"""Line dedup against counting every line plainly."""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from platewise.llm import line_dedup as L

SCHEMA = "doc_id long, text string, key string, part int, pos long, digest string, n_lines string"
LINE = "This is a line of some length"


def brute(rows, least_chars=20, least=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line))

    held = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                held[k].append(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


def run(spark, folder, rows, files=3, **how):
    spark.createDataFrame([(*r, "k", 1, 2, "d", "n") for r in rows], SCHEMA).repartition(files).write.parquet(folder)
    return sorted(str(tuple(r)) for r in L.drop_repeated_lines(spark.read.parquet(folder), **how).collect())


def documents(seed, n=200):
    rng = np.random.default_rng(seed)
    lines = ([f"Repeated line number {i} of the corpus" for i in range(30)] + ["short", "", "é" * 20, "é" * 19]
             + [f"  repeated LINE number {i} of the corpus\t\r" for i in range(5)])
    return [(int(i), "\n".join([str(x) for x in rng.choice(lines, rng.integers(0, 6))] + [f"line {i} found here alone {i}"]))
            for i in rng.permutation(n)]


@pytest.mark.parametrize("least, chars", [(3, 20), (2, 1), (50, 20)])
def test_matches_plain_counting(spark, tmp_dir, least, chars):
    rows = documents(least)
    assert run(spark, f"{tmp_dir}/d", rows, least_documents=least, least_chars=chars) == brute(rows, chars, least)


def test_edge_rows(spark, tmp_dir):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, LINE), (5, f"{LINE}\n{LINE.upper()}"), (6, f"x\n \t{LINE}\r\ny"), (6, f"{LINE}\nz"),
            (None, LINE), (None, "only in rows without an id"), (None, "only in rows without an id"),
            (None, "only in rows without an id\nq"), (8, f"{LINE} "), (9, "w" * 3_000_000), (10, f"{'w' * 3_000_000}\n"),
            (11, "W" * 3_000_000), (12, "\n" * 100_000), (13, LINE[:19]), (14, LINE[:19]), (15, LINE[:19])]
    assert run(spark, f"{tmp_dir}/d", rows) == brute(rows)


def test_a_line_of_two_documents_stays_and_repeats_in_one_do_not_count(spark, tmp_dir):
    rows = [(1, f"{LINE}\n{LINE}\n{LINE}"), (2, LINE)]
    assert run(spark, f"{tmp_dir}/d", rows) == brute(rows) == sorted(str((*r, r[1].count("\n") + 1, 0)) for r in rows)


def test_empty_table(spark, tmp_dir):
    assert run(spark, f"{tmp_dir}/d", []) == []


def test_partitions_that_changed_are_noticed(spark, tmp_dir):
    spark.createDataFrame([(i, LINE, "k", 1, 2, "d", "n") for i in range(9)], SCHEMA).coalesce(1).write.parquet(f"{tmp_dir}/d")
    docs = spark.read.parquet(f"{tmp_dir}/d").select("doc_id", "text")
    mail = L.post(spark.createDataFrame([(0, 5, np.array([1], np.uint64).tobytes())], L._ANSWERS), "test")
    with pytest.raises(Exception, match="partitions changed"):
        docs.mapInArrow(L._suspected(mail, 20), L._SUSPECTS).collect()


def test_filters_find_every_repeat_and_few_others():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    parts = np.split(hashes, 20)
    parts[3] = np.concatenate([parts[3], hashes[:500]])  # in two partitions
    flags = [np.zeros(len(p), bool) for p in parts]
    flags[7][:100] = True  # in two documents of one partition
    group = pd.DataFrame({"part": range(20), "rows": 1, "segment": 0, "hashes": [p.tobytes() for p in parts],
                          "twice": [np.packbits(f).tobytes() for f in flags]})
    answers = L._answer(1 << 19)(group)
    found = set(np.frombuffer(b"".join(answers["hashes"]), np.uint64).tolist())
    repeats = set(hashes[:500].tolist()) | set(parts[7][:100].tolist())
    assert repeats <= found and len(found) - len(repeats) < 200


def test_segments_are_even_and_ascending():
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2))
    of = L.segment_of(hashes, 7)
    assert (np.diff(of) >= 0).all() and of.min() == 0 and of.max() == 6 and np.bincount(of).min() > 6500
