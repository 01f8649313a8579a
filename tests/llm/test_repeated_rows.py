"""Rows without an id of their own, in the pipeline's filters and the sample."""

from platewise.llm import labelled as L
from platewise.llm import toxicity as T
from platewise.llm.minhash import drop_near_duplicates

SCHEMA = "doc_id long, text string, source string"


def test_clean_rows_that_repeat_stay(spark, monkeypatch):
    monkeypatch.setattr(T, "train", lambda docs, labels: T.BiGru(prior=0.1))
    rows = [(None, None, "a"), (None, None, "b"), (1, "one two", "a"), (1, "one two", "b"), (2, "", "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in T.drop_toxic(docs, docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))
    monkeypatch.setattr(T, "train", lambda docs, labels: T.BiGru(prior=0.9))
    assert T.drop_toxic(docs, docs).count() == 0


def test_one_row_of_a_near_group_stays(spark):
    def text(k, end):
        return " ".join(f"{k}{i}" for i in range(100)) + " " + end

    rows = [(7, text("a", "x"), "a"), (7, text("a", "y"), "a"), (7, text("a", "Y"), "b"), (7, text("a", "Y"), "c")]
    rows += [(None, text("b", "x"), "a"), (None, text("b", "y"), "a"), (8, text("c", "x"), "a"), (None, text("c", "y"), "a")]
    rows += [(7, text("d", "x"), "a"), (9, text("d", "y"), "a")]
    rows += [(None, None, "a"), (None, None, "b"), (3, " ", "a"), (3, "", "a")]
    got = [tuple(r) for r in drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    kinds = sorted((t or " ").strip()[:1] for _, t, _ in got)
    assert kinds == ["", "", "", "", "a", "b", "c", "d"]
    assert {(t[0], i) for i, t, _ in got if t and t.strip()} == {("a", 7), ("b", None), ("c", 8), ("d", 7)}


def test_one_text_of_a_labelled_id(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(40)] + [(0, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    got = L.labelled_sample(docs, labels, "toxic", 5, 9, 100)[0].collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == [(0, 0), (1, 1), (2, 0), (3, 1)]
