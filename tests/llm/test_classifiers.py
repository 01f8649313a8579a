"""Held-out accuracy of the quality and toxicity scorers, and their parts."""

import zlib

import numpy as np
import pytest

from platewise.llm import labelled as L
from platewise.llm import quality as Q
from platewise.llm import toxicity as T

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, predicted double"


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    return (order[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def held_out(rows, labels, column, mod, remainder):
    want = {r["doc_id"]: r[column] for r in labels.collect()}
    got = [(r["score"], r["predicted"], want[r["doc_id"]]) for r in rows
           if r["doc_id"] in want and zlib.crc32(str(r["doc_id"]).encode()) % mod == remainder]
    return tuple(np.array(x) for x in zip(*got))


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.score_documents(docs, Q.train(docs, labels)).collect()
    assert len(rows) == docs.count()
    score, predicted, y = held_out(rows, labels, "quality", 4, 2)
    assert auc(score, y) > 0.97 and (predicted == y).mean() > 0.93
    assert abs(score.mean() - y.mean()) < 0.05  # calibrated


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.score_documents(docs, T.train(docs, labels)).collect()
    assert len(rows) == docs.count()
    score, predicted, y = held_out(rows, labels, "toxic", 5, 0)
    assert auc(score, y) > 0.9 and (predicted == y).mean() > 0.93


def test_quality_of_long_texts(spark):
    """The far part of a long text counts as its opening does."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    vocabulary = [["".join(rng.choice(letters, 7)) for _ in range(3000)] for _ in range(2)]

    def text(c, n):
        return " ".join(np.array(vocabulary[c])[rng.integers(0, 3000, n // 8)])

    # lengths from 1 KB to 200 KB
    rows = [(i, text(i % 2, int(n))) for i, n in enumerate(np.geomspace(1000, 200_000, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    judge = Q.train(docs, labels)
    short, long = (judge.differences([text(c, n) for c in (0, 1)]) for n in (8000, 1_000_000))
    assert short[0] < 0 < short[1] and (abs(long) > 0.7 * abs(short)).all()
    score = judge.scores([text(0, 1_000_000), text(1, 1_000_000), text(1, 20_000) + " " + text(0, 1_000_000)])
    assert score[0] < 0.1 and score[1] > 0.9 and score[2] < 0.1


def test_toxicity_of_long_texts(spark, monkeypatch):
    """Calibrated on all windows of long texts; a passage in one place is learned."""
    monkeypatch.setattr(T, "STEPS", 250)
    monkeypatch.setattr(T, "FIRST_STEPS", 250, raising=False)
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("aeiourstlnmd"), 5)) for _ in range(500)])

    def text(c, n):
        ws = rng.choice(words, n).tolist()
        at = int(rng.integers(0, n - 10))
        return " ".join(ws[:at] + ["zqx", "kvvj", "wxzk"] * (2 * c) + ws[at:])

    rows = [(i, text(i % 2, int(n))) for i, n in enumerate(rng.integers(100, 4000, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    net = T.train(docs, labels)
    known, share = L.labelled_sample(docs, labels, "toxic", 5, 0, T.TRAIN_DOCS)
    rest = sorted((r["doc_id"], r["y"], r["text"]) for r in known.collect())[::4]
    (z, held), y = T.logits(net, [t for _, _, t in rest]), np.array([y for _, y, _ in rest], float)
    slopes, shift = L.calibrate(np.stack([z, np.log(held)], axis=1), y, share, T.DAMPING)
    if slopes[1] > 0:
        slopes, shift = [*L.calibrate(z[:, None], y, share)[0], 0.0], L.calibrate(z[:, None], y, share)[1]
    assert np.allclose((net.slope, net.count, net.shift), (*slopes, shift), rtol=1e-3, atol=1e-3) and net.count <= 0
    score = T.scores(net, [text(i % 2, 8000) for i in range(40)])
    assert (score[::2] < 0.5).mean() > 0.9 and (score[1::2] > 0.5).mean() > 0.9


@pytest.mark.parametrize("op,label", [(Q, "quality"), (T, "toxic")])
def test_edge_rows(spark, op, label):
    words = [f"w{i} v{i}" for i in range(60)]
    rows = [(i, " ".join(words) + (" bad bad" if i % 2 else " good good")) for i in range(80)]
    rows += [(None, None), (100, ""), (100, ""), (101, " \t"), (102, "long " * 50_000), (103, "é" * 300)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(80)] + [(None, 1, 1), (100, None, None), (5, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("quality = 1"), labels.limit(0)):  # both classes, one, none
        model = op.train(docs, some)
        out = op.score_documents(docs, model).collect()
        assert len(out) == len(rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= op.THRESHOLD) for r in out)
        empty = [r["score"] for r in out if r["doc_id"] in (None, 100)]
        assert len(set(empty)) == 1
    assert op.score_documents(docs.limit(0), model).count() == 0
    assert op.train(docs.limit(0), labels) is not None


def test_labels_of_held_out_rows_have_no_say(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    sample, _ = L.labelled_sample(docs, labels, "quality", 4, 2, 1000)
    ids = {r["doc_id"] for r in sample.collect()}
    assert ids == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}
    few, _ = L.labelled_sample(docs, labels, "quality", 4, 2, 3)
    assert few.count() == 6


def test_gradients():
    net = T.BiGru.fresh({"aa": 1, "bb": 2, "cc": 3})
    words, at, mask = T._laid_out([["aa", "bb", "zz"], ["cc", "aa"]])
    y, ids = np.array([1.0, 0.0]), net.ids(words)
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64)
    grad = net.gradients(*ids, at, mask.astype(float), y)

    def loss():
        p = L.sigmoid(net.forward(net.project(net.inputs(words)), at, mask.astype(float)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, w in net.weights.items():
        for flat in np.argsort(-np.abs(grad[k]).ravel())[:3]:
            i, e = np.unravel_index(flat, w.shape), 1e-4
            held = w[i]
            w[i] = held + e
            above = loss()
            w[i] = held - e
            below = loss()
            w[i] = held
            assert abs((above - below) / (2 * e) - grad[k][i]) < 1e-4 + 1e-2 * abs(grad[k][i]), (k, i)


def test_windows_cover_all_words_and_overlap():
    for n in range(1, 300):
        starts = T.windows_of(n)
        ends = np.minimum(starts + T.WINDOW, n)
        assert starts[0] == 0 and ends[-1] == n and (starts[1:] < ends[:-1]).all()
    assert len(T.windows_of(0)) == 0


def test_calibration_gives_the_share_back():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.5).astype(float)
    z = rng.standard_normal(4000) + 2 * y
    (slope,), shift = L.calibrate(z[:, None], y, 0.1)
    weight = np.where(y == 1, 0.1 / y.mean(), 0.9 / (1 - y.mean()))
    assert abs((weight * L.sigmoid(slope * z + shift)).mean() - 0.1) < 0.01 and slope > 1


def plain_window(net, words):
    """A window's log-odds, word by word and in doubles."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    x = net.inputs(words).astype(float)  # rows of embeddings; n-grams have a test of their own
    states = {}
    for d in ("f", "b"):
        h, out = np.zeros(T.HIDDEN), []
        for row in (x if d == "f" else x[::-1]):
            n = T.HIDDEN
            g, u = row @ w[f"x_{d}"] + w[f"c_{d}"], w[f"h_{d}"]
            update, reset = L.sigmoid(g[:n] + h @ u[:, :n]), L.sigmoid(g[n:2 * n] + h @ u[:, n:2 * n])
            new = np.tanh(g[2 * n:] + (reset * h) @ u[:, 2 * n:])
            h = (1 - update) * h + update * new
            out.append(h)
        states[d] = out if d == "f" else out[::-1]
    both = np.concatenate([states["f"], states["b"]], axis=1)
    att = np.tanh(both @ w["att_w"] + w["att_b"]) @ w["att_u"]
    share = np.exp(att - att.max())
    return (share / share.sum()) @ both @ w["out_w"] + w["out_b"][0]


def test_embeddings_in_pieces_are_the_means_of_the_n_grams(monkeypatch):
    net = T.BiGru.fresh({"known": 1})
    words = ["known", "a", "ünknown", "x" * 5000, "(known)", "..."]
    vocab, buckets, begins = net.ids(words)
    want = np.add.reduceat(net.weights["char"][buckets].astype(float), begins, axis=0) / np.diff(begins, append=len(buckets))[:, None]
    for places in (7, 1 << 17):
        monkeypatch.setattr(T, "PLACES", places)
        got = net.inputs(words)
        assert np.allclose(got[:, T.WORD_DIM:], want, atol=1e-6) and np.array_equal(got[:, :T.WORD_DIM], net.weights["word"][vocab])


def test_a_document_scores_as_its_highest_window_recomputed():
    net = T.BiGru.fresh({"bad": 1, "good": 2})
    net.slope, net.count, net.shift = 1.5, -0.2, 0.3
    rng = np.random.default_rng(2)
    for n in (1, 5, 100):
        ws = rng.choice(["bad", "good", "other", "words"], n).tolist()
        starts = T.windows_of(n)
        z = max(plain_window(net, ws[s:s + T.WINDOW]) for s in starts)
        assert abs(T.scores(net, [" ".join(ws)])[0] - L.sigmoid(1.5 * z - 0.2 * np.log(len(starts)) + 0.3)) < 1e-4


def test_quality_recomputed_from_blocks(spark):
    import zstandard
    rng = np.random.default_rng(4)
    good, bad = ([f"{c}{i}" for i in range(300)] for c in ("fine", "junk"))
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 400))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judge = Q.train(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int"))
    long = " ".join(rng.choice(good + bad, 5000))
    got = judge.scores([long, ""])
    raw = long.encode()
    sizes = []
    for d in (judge.good, judge.bad):
        c = zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(d))
        sizes.append(sum(len(c.compress(raw[i:i + Q.BLOCK])) for i in range(0, len(raw), Q.BLOCK)))
    z = (sizes[1] - sizes[0]) / len(raw)
    assert abs(got[0] - L.sigmoid(judge.slope * z + judge.shift)) < 1e-6
