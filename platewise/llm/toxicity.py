"""Toxicity: a bidirectional gated recurrent network with attention pooling
over character and word inputs, in numpy.

A word's input is the embedding of the word (of a vocabulary counted on the
training sample) next to the mean embedding of its character n-grams. Two
gated recurrent units read a window of words, one from each end; attention
pools their states and a logistic unit scores the window. Overlapping windows
cover the whole text, and the highest window score, calibrated on the
training documents, is the document's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import keep_decided, materialise, row_key, slices, text_or_empty
from platewise.llm.labelled import calibrate, labelled_sample, sigmoid

#: Words of a window, and the step from one window to the next.
WINDOW, STEP = 32, 24
#: The bounded sample: documents of either class, three quarters to train on
#: and one to calibrate with. Windows to train on that a text gives, spread
#: over it or the highest of all.
TRAIN_DOCS, TRAIN_WINDOWS = 1200, 8
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 8, 8
CHAR_BUCKETS = 1 << 15
#: Lengths of the character n-grams, with marks at the word's ends.
GRAMS = (3, 4, 5)
#: Of the calibration's slopes, of the score and of the windows' number: of the
#: sample few texts have many windows.
DAMPING = (1e-3, 5.0)
#: Characters whose n-grams are looked up at a time.
PLACES = 1 << 17
#: Words of the vocabulary occur in so many training documents at least.
LEAST_DOCS = 20
STEPS, BATCH, RATE, DECAY = 900, 64, 0.01, 0.05
#: Steps of the first network.
FIRST_STEPS = 300
THRESHOLD = 0.5
_SEED = 11
_STRIP = "\"'.,;:!?()[]{}<>|*_-"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def windows_of(n: int) -> np.ndarray:
    """The starts of the windows over ``n`` words: every word is in one, and
    neighbours overlap."""
    return np.arange(0, max(1, n - WINDOW + STEP), STEP) if n else np.empty(0, int)


@dataclass
class BiGru:
    """The network's parameters: embeddings, a unit per direction (input,
    recurrent and bias blocks for update, reset and candidate), attention and
    the output unit."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    #: Calibration: the document's log-odds are slope * logit of its highest
    #: window + count * logarithm of its windows + shift.
    slope: float = 1.0
    count: float = 0.0
    shift: float = 0.0
    prior: float = 0.5

    @staticmethod
    def fresh(vocabulary: dict[str, int]) -> BiGru:
        rng = np.random.default_rng(_SEED)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        w = {"word": normal(len(vocabulary) + 1, WORD_DIM, scale=0.3), "char": normal(CHAR_BUCKETS, CHAR_DIM, scale=0.3),
             "att_w": normal(2 * HIDDEN, ATTEND, scale=0.4), "att_b": np.zeros(ATTEND, np.float32),
             "att_u": normal(ATTEND, scale=0.4), "out_w": normal(2 * HIDDEN, scale=0.4), "out_b": np.zeros(1, np.float32)}
        w["word"][0] = 0  # words outside the vocabulary
        for d in ("f", "b"):
            w[f"x_{d}"] = normal(WORD_DIM + CHAR_DIM, 3 * HIDDEN, scale=0.35)
            w[f"h_{d}"] = normal(HIDDEN, 3 * HIDDEN, scale=0.35)
            w[f"c_{d}"] = np.zeros(3 * HIDDEN, np.float32)
        return BiGru(vocabulary, w)

    # ---- inputs -----------------------------------------------------------
    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: vocabulary ids (0: none), the characters of all,
        marked at both ends, where each begins and how long it is."""
        bare = [w.strip(_STRIP) or w for w in words]
        get = self.vocabulary.get
        vocab = np.fromiter((get(w, 0) for w in bare), np.int64, len(bare))
        marked = "".join(["\x02" + w + "\x03" for w in bare])
        points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
        return vocab, points, np.cumsum(lengths) - lengths, lengths

    @staticmethod
    def _buckets(points: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The buckets of the character n-grams that begin at ``at``, in words
        that end at ``ends``: a row per place."""
        h = points[at].astype(np.uint64) * np.uint64(0x9E3779B1)
        grams = np.empty((len(at), len(GRAMS)), np.uint64)
        for k in range(1, GRAMS[-1]):  # characters past the word's end count as 0
            more = np.where(at + k < ends, points[np.minimum(at + k, len(points) - 1)], 0).astype(np.uint64)
            h = (h + more) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k + 1 in GRAMS:
                grams[:, GRAMS.index(k + 1)] = h * np.uint64(2 * k + 1)
        return ((grams >> np.uint64(20)) % np.uint64(CHAR_BUCKETS)).astype(np.int64)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: vocabulary ids, the buckets of their character
        n-grams one word after the other, and where each begins."""
        vocab, points, first, lengths = self._marked(words)
        at = np.arange(len(points) - 2 * len(words)) + np.repeat(2 * np.arange(len(words)), lengths - 2)
        buckets = self._buckets(points, at, np.repeat(first + lengths, lengths - 2))
        return vocab, buckets.ravel(), len(GRAMS) * (first - 2 * np.arange(len(words)))

    def inputs(self, words: list[str]) -> np.ndarray:
        """A row per word: its embedding and the mean of its n-grams', made
        ``PLACES`` characters at a time, however long a word is."""
        vocab, points, first, lengths = self._marked(words)
        starts, ends = first - 2 * np.arange(len(words)), first + lengths
        chars = np.zeros((len(words), CHAR_DIM), self.weights["char"].dtype)
        for lo in range(0, len(points) - 2 * len(words), PLACES):
            place = np.arange(lo, min(lo + PLACES, len(points) - 2 * len(words)))
            word = np.searchsorted(starts, place, side="right") - 1
            grams = self.weights["char"][self._buckets(points, place + 2 * word, ends[word])].sum(axis=1)
            run = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            chars[word[run]] += np.add.reduceat(grams, run, axis=0)
        chars /= (len(GRAMS) * (lengths - 2))[:, None].astype(chars.dtype)
        return np.concatenate([self.weights["word"][vocab], chars], axis=1)

    # ---- forward ----------------------------------------------------------
    def project(self, table: np.ndarray) -> dict[str, np.ndarray]:
        """What the inputs of distinct words add to the gates, by direction."""
        return {d: table @ self.weights[f"x_{d}"] + self.weights[f"c_{d}"] for d in ("f", "b")}

    def _run(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, d: str, out: np.ndarray, keep: list | None) -> None:
        """Fill ``out`` (steps, windows, HIDDEN) with one direction's states.
        Positions past a window's end leave the state as it is."""
        steps, n = at.shape
        u, h = self.weights[f"h_{d}"], np.zeros((n, HIDDEN), gates.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = gates[at[t]]
            zr = 1 / (1 + np.exp(-(x[:, :2 * HIDDEN] + h @ u[:, :2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN:] + (r * h) @ u[:, 2 * HIDDEN:])
            z = z * mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, zr, c))
            h = h + z * (c - h)
            out[t] = h

    def forward(self, gates: dict, at: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Log-odds of windows. ``gates``: ``project`` of the distinct words;
        ``at`` (steps, windows): rows of it; ``mask``: 1 where a word is."""
        w, keep = self.weights, {d: [] if trace is not None else None for d in ("f", "b")}
        both = np.empty((*at.shape, 2 * HIDDEN), gates["f"].dtype)
        self._run(gates["f"], at, mask, "f", both[..., :HIDDEN], keep["f"])
        self._run(gates["b"], at, mask, "b", both[..., HIDDEN:], keep["b"])
        look = np.tanh(both.reshape(-1, 2 * HIDDEN) @ w["att_w"] + w["att_b"])
        e = np.exp(look @ w["att_u"]).reshape(at.shape) * mask
        a = e / e.sum(axis=0)
        pooled = np.zeros((at.shape[1], 2 * HIDDEN), both.dtype)
        for t in range(len(at)):
            pooled += a[t][:, None] * both[t]
        look = look.reshape(*at.shape, ATTEND)
        if trace is not None:
            trace.update(keep, both=both, look=look, a=a, pooled=pooled)
        return pooled @ w["out_w"] + w["out_b"][0]

    # ---- training ---------------------------------------------------------
    def gradients(self, vocab, buckets, begins, at, mask, y) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over a batch of windows."""
        w, g, trace = self.weights, {}, {}
        counts = np.diff(begins, append=len(buckets))[:, None]
        table = np.concatenate([w["word"][vocab], np.add.reduceat(w["char"][buckets], begins, axis=0) / counts], axis=1)
        score = self.forward(self.project(table), at, mask, trace)
        back = ((sigmoid(score) - y) / len(y)).astype(np.float32)
        both, look, a, pooled = (trace[k] for k in ("both", "look", "a", "pooled"))
        g["out_w"], g["out_b"] = pooled.T @ back, back.sum(keepdims=True)
        dpool = back[:, None] * w["out_w"]
        da = np.einsum("nh,tnh->tn", dpool, both)
        de = a * (da - (a * da).sum(axis=0))
        dlook = de[..., None] * w["att_u"] * (1 - look**2)
        g["att_u"] = np.einsum("tn,tnk->k", de, look)
        g["att_w"], g["att_b"] = np.einsum("tnh,tnk->hk", both, dlook), dlook.sum(axis=(0, 1))
        dboth = a[..., None] * dpool + dlook @ w["att_w"].T
        dtable = np.zeros_like(table)
        for i, d in enumerate(("f", "b")):
            u = w[f"h_{d}"]
            gu, carried = np.zeros_like(u), np.zeros((at.shape[1], HIDDEN), np.float32)
            dgates = np.zeros((*at.shape, 3 * HIDDEN), np.float32)
            for t, h, z, zr, c in reversed(trace[d]):
                dh = dboth[t, :, i * HIDDEN:(i + 1) * HIDDEN] + carried
                r = zr[:, HIDDEN:]
                dc = dh * z * (1 - c**2)
                dz = dh * (c - h) * mask[t][:, None] * zr[:, :HIDDEN] * (1 - zr[:, :HIDDEN])
                drh = dc @ u[:, 2 * HIDDEN:].T
                dr = drh * h * r * (1 - r)
                dgates[t] = np.concatenate([dz, dr, dc], axis=1)
                gu[:, :2 * HIDDEN] += h.T @ dgates[t][:, :2 * HIDDEN]
                gu[:, 2 * HIDDEN:] += (r * h).T @ dc
                carried = dh * (1 - z) + drh * r + dgates[t][:, :2 * HIDDEN] @ u[:, :2 * HIDDEN].T
            dx = _scattered(dgates.reshape(-1, 3 * HIDDEN), at.ravel(), len(table))
            g[f"h_{d}"], g[f"x_{d}"], g[f"c_{d}"] = gu, table.T @ dx, dx.sum(axis=0)
            dtable += dx @ w[f"x_{d}"].T
        g["word"] = _scattered(dtable[:, :WORD_DIM], vocab, len(w["word"]))
        g["word"][0] = 0
        g["char"] = _scattered(np.repeat(dtable[:, WORD_DIM:] / counts, counts[:, 0], axis=0), buckets, len(w["char"]))
        return g


def _scattered(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the sum of the ``rows`` that go ``to`` it."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(to, kind="stable")
    held = to[order]
    first = np.flatnonzero(np.diff(held, prepend=-1))
    out[held[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class _Places(dict):
    """Numbers the words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _laid_out(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows (lists of at most ``WINDOW`` words) as distinct words, and the
    (steps, windows) tables of their places and of where words are."""
    place = _Places()
    at = np.zeros((len(texts), WINDOW), np.int64)
    mask = np.zeros((len(texts), WINDOW), np.float32)
    for i, t in enumerate(texts):
        at[i, :len(t)] = [place[w] for w in t]
        mask[i, :len(t)] = 1
    return list(place), np.ascontiguousarray(at.T), np.ascontiguousarray(mask.T)


def fit(windows: list[list[str]], labels: np.ndarray, doc_of: np.ndarray, steps: int) -> BiGru:
    """Train on labelled windows of documents, by Adam with decay."""
    held = Counter()
    for d in np.unique(doc_of):
        held.update({(x.strip(_STRIP) or x) for i in np.flatnonzero(doc_of == d) for x in windows[i]})
    net = BiGru.fresh({x: i for i, x in enumerate(sorted(x for x, n in held.items() if n >= LEAST_DOCS), 1)})
    rng, step = np.random.default_rng(_SEED), 0
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    epochs = max(1, round(steps * BATCH / len(windows)))
    for epoch in range(epochs):
        for chunk in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            words, at, mask = _laid_out([windows[i] for i in chunk])
            g = net.gradients(*net.ids(words), at, mask, labels[chunk])
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                move = (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                net.weights[k] -= (rate * (move + DECAY * net.weights[k])).astype(np.float32)
    return net


def window_logits(net: BiGru, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The log-odds of all the texts' overlapping windows, text by text, and
    how many windows each text has."""
    place, spots = _Places(), []
    for t in texts:
        spots.append(np.fromiter(map(place.__getitem__, words_of(t)), np.int64))
    counts = [len(x) for x in spots]
    if not sum(counts):
        return np.empty(0), np.zeros(len(texts), int)
    gates, flat = net.project(net.inputs(list(place))), np.concatenate(spots)
    starts, lengths = [], []
    begin = 0
    for n in counts:
        s = windows_of(n)
        starts.append(begin + s)
        lengths.append(np.minimum(WINDOW, n - s))
        begin += n
    held = np.array([len(s) for s in starts])
    starts, lengths = map(np.concatenate, (starts, lengths))
    z = np.empty(len(starts))
    steps = np.arange(WINDOW)[:, None]
    for k in range(0, len(starts), 4096):
        s, n = starts[k:k + 4096], lengths[k:k + 4096]
        mask = (steps < n).astype(np.float32)
        at = flat[np.minimum(s + steps, len(flat) - 1)]
        z[k:k + 4096] = net.forward(gates, at, mask)
    return z, held


def logits(net: BiGru, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The highest window's log-odds of each text, over all its overlapping
    windows (NaN for a text without words), and how many windows it has."""
    z, held = window_logits(net, texts)
    best = np.full(len(texts), np.nan)
    if len(z):
        best[held > 0] = np.maximum.reduceat(z, (np.cumsum(held) - held)[held > 0])
    return best, held


def scores(net: BiGru, texts: list[str]) -> np.ndarray:
    if not net.weights:
        return np.full(len(texts), net.prior)
    z, held = logits(net, texts)
    odds = net.slope * np.nan_to_num(z) + net.count * np.log(np.maximum(held, 1)) + net.shift
    return np.where(np.isnan(z), net.prior, sigmoid(odds))


def _spread(n: int) -> np.ndarray:
    """``TRAIN_WINDOWS`` of ``n`` windows, spread over all of them."""
    return np.unique(np.linspace(0, n - 1, TRAIN_WINDOWS).astype(int)) if n else np.empty(0, int)


def _telling(z: np.ndarray, y: int) -> np.ndarray:
    """Windows of a text with the log-odds ``z`` to train on: of a toxic one
    the highest, and the next ones while they look toxic; of a clean one the
    highest, and others spread over it."""
    top = np.argsort(-z, kind="stable")[:TRAIN_WINDOWS]
    return np.sort(top[(z[top] > 0) | (top == top[:1])]) if y else np.union1d(_spread(len(z)), top)


def _windows(first: BiGru | None, left_out: frozenset[int] = frozenset()):
    """Windows to train on of each text but those ``left_out``, spread over
    it, or the telling ones by a first network."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for i, y, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "text"))):
                if i in left_out:
                    continue
                ws = words_of(text)
                s = windows_of(len(ws))
                s = s[_spread(len(s)) if first is None else _telling(window_logits(first, [text])[0], y)]
                rows.append({"doc_id": i, "y": y, "windows": [" ".join(ws[k:k + WINDOW]) for k in s]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("doc_id", pa.int64()), ("y", pa.int32()), ("windows", pa.list_(pa.string()))]))

    return run


def _highest(net: BiGru, ids: frozenset[int]):
    """The highest window's log-odds of the whole texts of the named documents,
    and their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([i in ids for i in b.column("doc_id").to_pylist()], pa.bool_()))
            for part in slices([b]):
                z, held = logits(net, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(z), pa.array(held, pa.int64())],
                                                 ["doc_id", "y", "z", "held"])

    return run


def train(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5, held_out: int = 0) -> BiGru:
    """A network fitted on at most ``TRAIN_DOCS`` documents of either class,
    and calibrated on a quarter of them that it was not fitted on. All windows
    of the documents are scored in the tasks; the ones to train on and the
    scores to calibrate with reach the driver. Rows with crc32(doc_id) mod
    ``held_out_mod`` = ``held_out`` are never learned from; null labels are
    left out, and of several labels the highest counts. Without both classes
    every score is the share of label 1 (0.5 without any label)."""
    texts, share = labelled_sample(docs, labels, "toxic", held_out_mod, held_out, TRAIN_DOCS)
    texts = materialise(texts, "toxicity-sample")

    def collected(task) -> list[tuple]:
        return sorted((r["doc_id"], r["windows"], r["y"]) for r in texts.mapInArrow(
            task, "doc_id long, y int, windows array<string>").collect())

    def fitted(rows: list[tuple], steps: int) -> BiGru | None:
        drawn = [(i, y, w.split(" ")) for i, ws, y in rows for w in ws]
        y = np.array([y for _, y, _ in drawn], np.float32)
        if not len(y) or not 0 < y.mean() < 1:
            return None
        return fit([w for _, _, w in drawn], y, np.array([i for i, _, _ in drawn]), steps)

    sample = collected(_windows(None))
    rest = frozenset(sorted({i for i, _, _ in sample})[::4])
    first = fitted([x for x in sample if x[0] not in rest], FIRST_STEPS)
    if first is None:
        return BiGru(prior=share)
    net = fitted(collected(_windows(first, rest)), STEPS)
    found = sorted((r["doc_id"], r["z"], r["y"], r["held"]) for r in texts.mapInArrow(
        _highest(net, rest), "doc_id long, y int, z double, held long").collect() if not np.isnan(r["z"]))
    net.prior = share
    if found:
        z, t, n = (np.array([x[k] for x in found], float) for k in (1, 2, 3))
        # of more windows the highest is higher by chance alone: the count may only lower the odds
        (net.slope, net.count), net.shift = calibrate(np.stack([z, np.log(n)], axis=1), t, share, DAMPING)
        if net.count > 0:
            (net.slope,), net.shift = calibrate(z[:, None], t, share)
            net.count = 0.0
    return net


def score_documents(docs: DataFrame, net: BiGru) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, score, predicted, row_key. Every window of the whole text is
    scored. Null texts count as empty; texts without words get the share of
    label 1. The network (a few MB at most, bounded by its parameters and the
    training sample) goes to the tasks with the function."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = scores(net, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), b.column("row_key")],
                ["doc_id", "score", "predicted", "row_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                       text_or_empty().alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double, predicted int, row_key long")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic. Null texts count as empty and
    get the share of label 1, as texts without words do; rows that repeat a
    row that stays stay too. ``docs`` may have any other columns; they come
    back as they are."""
    s = score_documents(docs, train(docs, labels))
    return keep_decided(docs, s.select("doc_id", "row_key", (F.col("predicted") == 0).alias("kept"),
                                       F.lit(False).alias("once")))
