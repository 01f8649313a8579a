"""The pipeline's stages, and its registration."""

import re

import corpus_pipeline as P
import pytest
import sentencepiece

import __spark_entry__ as E
from platewise.llm import sentencepiece_sa, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_documents(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_dir}/{k}")
        docs = spark.read.parquet(f"{tmp_dir}/{k}")
        if k == len(P.STAGES) - 1:
            break
        assert docs.columns == columns, name
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        after = dict(rows)
        assert after.items() <= before.items() and (name == "mixing" or len(rows) == len(after)), name
        if name == "exact_dedup":
            norms = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in after.values()]
            assert len(set(norms)) == len(norms)
            assert {re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in before.values()} == set(norms)
        if name == "mixing":
            assert len(rows) > len(after)
        assert after, name
        before = after
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.MODEL)
    rows = docs.collect()
    assert len(rows) > len({r["doc_id"] for r in rows}) and all(r["round_trip"] for r in rows)
    assert all(r["token_ids"] == library.encode(before[r["doc_id"]]) for r in rows[:50])


def test_stages_on_no_documents_and_odd_ones(spark, tmp_dir):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here now ok yes", "en", "a", 1),
           (3, "x " * 20_000, "en", "a", 1), (3, "x " * 20_000, "en", "a", 1)]
    for name, rows in (("none", []), ("odd", odd)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_dir}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_dir}/{name}/labels.parquet")
        out = P.run(spark, f"{tmp_dir}/{name}").collect()
        assert len(out) == 0 if not rows else {r["doc_id"] for r in out} <= {1, 2, 3, None}


#: Names that stages have had for their own columns.
CLASHING = ["_id", "_key", "_row_key", "_copies", "_copy", "_source", "row_key", "kept", "once", "copies", "h", "part", "pos"]


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_columns_of_any_name_come_back(spark, tmp_dir, monkeypatch, name, stage, upper):
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: toxicity.BiGru(prior=0.1))
    names = [c.upper() if upper else c for c in CLASHING]
    rows = [(i, f"some words of {i} here " * 6 if i % 4 else "the same " * 9, "en", f"s{i % 2}", 1, *[f"{c}{i}" for c in names])
            for i in range(1, 13)]
    spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in names)).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    out = stage(spark, docs, tmp_dir)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)


def test_registered():
    assert 4 <= len(P.STAGES) <= 5 and P.ORACLE_SQL is None
    ops = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in ops) == list(range(1, 14))
    assert E.queries()["pipeline"] is P.run
