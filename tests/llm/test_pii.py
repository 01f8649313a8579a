"""Spans against the stated patterns, run plainly."""

import hashlib
import random
import re

from platewise.llm import pii as P

SF = "/root/testdata/sf0.01"


def plain(text):
    """The base spans by the patterns as they are stated."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        twice = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(twice)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{P.BASE[k]}:{s}:{e}" for s, k, e in sorted(out))


def base(text):
    return P.listed([s for s in P.find(text) if s.kind in P.BASE])


def test_random_texts_match_the_stated_patterns():
    rng = random.Random(5)
    for alphabet in ("a@.b-1", "0123456789 -", "+1() .-2", "1.2.55", "ab@c.d %+_é٣\n"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert base(t) == plain(t), repr(t)


def test_documents_match_the_stated_patterns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: plain(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    got = P.find_personal_data(docs, with_redacted=True).collect()
    assert len(got) == len(want) and any(want.values())
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
        assert not want[r["doc_id"]] or "[" in r["redacted"]
        kinds = [s["kind"] for s in r["found"]]
        assert [r[f"n_{k}"] for k in P.BASE] == [kinds.count(k) for k in P.BASE]


def test_long_runs_take_linear_time():
    for t in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "1." * 200_000, "+1" * 200_000, "a." * 200_000 + "@",
              "a@" * 200_000, "AB12" * 100_000, "1-" * 200_000):
        P.find(t)


def test_added_kinds_and_context():
    assert [s.kind for s in P.find("IBAN GB82 WEST 1234 5698 7654 32.")] == ["iban"]
    for text, found in (("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89 3704 0044 0532 0130 00"),
                        ("DE89370400440532013000 BIC", "DE89370400440532013000"),
                        ("GB82WEST12345698765432 AND DE89370400440532013000 OK", "GB82WEST12345698765432")):
        spans = [s for s in P.find(text) if s.kind == "iban"]
        assert text[spans[0].start:spans[0].end] == found
    assert len([s for s in P.find("GB82WEST12345698765432 AND DE89370400440532013000 OK") if s.kind == "iban"]) == 2
    assert not [s for s in P.find("DE89 3704 0044 0532 0130 01 BIC COBADEFF") if s.kind == "iban"]
    assert P.find("XX82 WEST 1234 5698 7654 33") == []
    assert [s.kind for s in P.find("his social security number is 123-45-6789 now")] == ["ssn"]
    assert P.find("part 123-45-6789 now") == []
    card = "4111 1111 1111 1111"
    bare, near, against = (P.find(x + card)[0].score for x in ("", "visa card ", "test "))
    assert against < bare < near
    assert P.find(card[:-1] + "2") == []
    assert P.redact(f"pay {card} to a@b.co", P.find(f"pay {card} to a@b.co")) == "pay [CARD] to [EMAIL]"


def test_edge_rows(spark):
    schema = "doc_id long, text string, spans string, kind int"
    rows = [(1, None, "x", 1), (None, "", None, None), (2, "mail é a@b.co", "x", 1), (2, "mail é a@b.co", "x", 1)]
    got = P.find_personal_data(spark.createDataFrame(rows, schema)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((str(r["doc_id"]), r["spans"], r["n_email"], r["base_sha256"] == empty) for r in got) == [
        ("1", "", 0, True), ("2", "email:7:13", 1, False), ("2", "email:7:13", 1, False), ("None", "", 0, True)]
    assert P.find_personal_data(spark.createDataFrame([], schema)).count() == 0
