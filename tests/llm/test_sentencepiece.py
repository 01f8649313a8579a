"""Encoding against the library that the model belongs to; decoding by round trip."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from platewise.llm import sentencepiece_sa as S

SF = "/root/testdata/sf0.001"
EDGES = ["", "a", " a", "a ", "  a  b ", "   ", "hello world", "▁x y", "x▁", "日本語 テスト 🎉 ok\n\ttab  two", "a" * 17, "\x00 nul",
         "x" * 5000, " " * 77 + "z", "mississippi banana " * 3, "\n", "a\n\n  b", "é é ﬁ", "<s> </s> <unk> <0x41>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def test_texts_encode_as_the_library_does(library):
    rng = random.Random(0)
    texts = EDGES + ["".join(rng.choice("abcdeéñ ▁ .\n日x9THth") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    model = S.load()
    for t, ids in zip(texts, S.Encoder(model).encode(texts)):
        assert ids.tolist() == library.encode(t), repr(t)
        assert S.decode(model, ids) == t.replace(S.SPACE, " ") == library.decode(ids.tolist()).replace(S.SPACE, " ") \
            or t != t.strip() or S.SPACE in t or "\0" in t


def test_what_is_remembered_is_bounded(library, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 50)
    encoder = S.Encoder(S.load())
    for k in range(10):
        texts = [f"word{k} other{i} {i * k}" for i in range(40)]
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t) for t in texts]
        assert len(encoder.place) <= 50 + 120


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = S.encode_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r["doc_id"]])
        assert r["token_ids"] == want and r["n_tokens"] == len(want) and r["round_trip"]
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edge_rows(spark, library):
    schema = "doc_id long, text string, token_ids string, n_tokens int"
    rows = [(1, None), (None, ""), (2, "two two"), (2, "two two"), (3, "w " * 100_000), (4, "a▁b")]
    out = S.encode_documents(spark.createDataFrame([(*r, "x", 1) for r in rows], schema)).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and by[1]["n_tokens"] == by[None]["n_tokens"] == 0 and by[1]["round_trip"]
    assert by[3]["token_ids"] == library.encode("w " * 100_000) and by[3]["round_trip"]
    assert by[4]["token_ids"] == library.encode("a▁b") and not by[4]["round_trip"]
    assert S.encode_documents(spark.createDataFrame([], schema)).count() == 0


def test_long_words_by_the_suffix_array():
    import random
    model = S.load()
    rng = random.Random(6)
    parts = ["tion", "the", "straße", "über", "http", "www.", "ab", "x", "é", "1", "00"]
    for n in (S.LONG - 2, S.LONG + 1, 5_000):
        word = S.SPACE + "".join(rng.choice(parts) for _ in range(n))[:n]
        assert model.foreign.search(word) is None
        assert model.encode_long(word).tolist() == model.encode_any(word).tolist() == model.encode_words([word])[0].tolist()
    text = "short " + "abc" * 20_000 + " words 日本" + "zq" * 1_000
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert S.Encoder(model).encode([text])[0].tolist() == library.encode(text)


def test_a_table_of_pieces_serves_batches_of_the_same_characters(library):
    model = S.load()
    encoder = S.Encoder(model)
    tables = []
    for texts in (["the quick brown fox jumps over the lazy dog"], ["dogs fix every quartz lamp now just behind the cow"],
                  ["dogs", "a" * 300], ["Ünïcode and digits 0123 zq"]):
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t) for t in texts]
        tables.append(model._last_table)
    assert tables[0] is tables[1] and tables[2] is not tables[1]


def test_pairs_are_filtered_before_they_are_searched():
    model = S.load()
    rng = np.random.default_rng(0)
    n = len(model.pieces)
    a, b = rng.integers(0, n, 5000), rng.integers(0, n, 5000)
    some = rng.choice(model.pair_keys, 5000)
    a, b = np.concatenate([a, some // n]), np.concatenate([b, some % n])
    assert model.taken[S._slots(model.pair_keys)].all()
    assert model.neighbours(a, b).tolist() == [model._adjoin(x, y) for x, y in zip(a.tolist(), b.tolist())]
