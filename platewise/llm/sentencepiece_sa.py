"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct words of a batch are laid end to end and their suffixes sorted.
Every piece of the vocabulary is searched in the suffix array; the range it
finds holds all its occurrences. Occurrences become edges from a piece's
start to its end, and are relaxed in the order of position: an edge holds
when merging would indeed put its piece next to the one that ends where it
starts. Exactly one edge per position holds, so walking back from a word's
end gives the pieces that merging gives, for all words at once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import row_key, slices, text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Distinct words a process remembers; then it starts anew.
REMEMBERED = 300_000
#: Distinct words that are laid end to end at a time; a word of more than
#: ``LONG`` characters is a batch by itself.
WORDS, LONG = 8_000, 100
#: Slots of the filter before the search for a pair of pieces, as a power of 2.
SLOT_BITS = 22
_FAR = np.iinfo(np.int64).max


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Model:
    """A BPE model with byte fallback. Pieces have ranks: single characters
    first, then the others in the order in which merging prefers them."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError(f"{path} is not a BPE model with byte fallback")
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces):
            raise ValueError(f"{path} normalises texts in a way that this encoder does not")
        normal = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == p.NORMAL]
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in normal):
            raise ValueError(f"{path} has pieces over several words")
        #: Bytes of every id; control and unknown pieces decode to nothing.
        self.bytes_of = [p.piece.encode() if p.type == p.NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE
                         else b"" for p in proto.pieces]
        self.byte_ids = np.array([next(i for i, p in enumerate(proto.pieces) if p.type == p.BYTE
                                       and int(p.piece[1:-1], 16) == b) for b in range(256)], np.int32)
        known = {p for p, _, _ in normal}
        if any(c not in known for p in known for c in p):
            raise ValueError(f"{path} has pieces of characters that are no pieces")
        order = sorted(normal, key=lambda x: (len(x[0]) > 1, -x[2], x[1]))
        self.rank_of = {p: r for r, (p, _, _) in enumerate(order)}
        self.score_of = {p: s for p, _, s in order}
        self.pieces = [p for p, _, _ in order]
        self.ids = np.array([i for _, i, _ in order], np.int32)
        self.singles = sum(len(p) == 1 for p in self.pieces)
        self._splits()
        self.foreign = re.compile("([^" + "".join(re.escape(p) for p in self.pieces[:self.singles]) + "])")

    def merge(self, text: str) -> list[str]:
        """Plain merging, one pair at a time: the best score first, then the leftmost."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        parts, score_of = list(text), self.score_of
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := score_of.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        last = None
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != both:
                continue
            last = parts[i], parts[j]
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p], last

    def _splits(self) -> None:
        """Each piece's last merge, and all pairs of pieces that join into one.
        Pieces that merging their own characters does not give never occur."""
        n = len(self.pieces)
        self.left, self.right = np.arange(n), np.arange(n)
        self.reached = np.ones(n, bool)
        pairs: dict[int, int] = {}
        for r, p in enumerate(self.pieces):
            if len(p) == 1:
                continue
            parts, last = self._merge(p)
            if len(parts) != 1:
                self.reached[r] = False
                continue
            self.left[r], self.right[r] = self.rank_of[last[0]], self.rank_of[last[1]]
            for k in range(1, len(p)):
                a, b = self.rank_of.get(p[:k]), self.rank_of.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = r
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        lengths = np.array([len(p) for p in self.pieces])
        self.lengths = lengths
        #: Slots that hold a pair's key, by its hash: most keys looked up are no pair's.
        self.taken = np.zeros(1 << SLOT_BITS, bool)
        self.taken[_slots(self.pair_keys)] = True
        self._last_table: tuple | None = None  # of the last batch's alphabet
        #: Code points of the pieces that occur, padded with 0.
        self.points = np.zeros((n, lengths.max()), np.uint32)
        for r, p in enumerate(self.pieces):
            self.points[r, :len(p)] = [ord(c) for c in p]

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece ``b`` right of piece ``a``. The merges
        that made both are undone from the last one back; the pair is no
        neighbours if some join across the border comes before the merge last
        undone."""
        n = len(self.pieces)
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), _FAR)
        while len(at):
            keys = a * n + b
            some = np.flatnonzero(self.taken[_slots(keys)])
            k = np.minimum(np.searchsorted(self.pair_keys, keys[some]), len(self.pair_keys) - 1)
            joins = np.zeros(len(at), bool)
            joins[some] = (self.pair_keys[k] == keys[some]) & (self.pair_ranks[k] < limit[some])
            out[at[joins]] = False
            on = ~joins & (np.maximum(a, b) >= self.singles)
            at, a, b = at[on], a[on], b[on]
            undo_a = a > b
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    # ---- words ------------------------------------------------------------
    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of known characters, each without a space after
        its first other character and without several spaces in a row: all
        words' ids, one after the other, and the number of each."""
        text = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size + 1) - size - 1
        start, end, piece = self._edges(text)
        position = (np.arange(len(text)) - np.repeat(first, size + 1))[start]
        if len(text) and size.max() < 1 << 16:
            position = position.astype(np.uint16)  # is sorted by its digits
        ordered = np.argsort(position, kind="stable")  # by position in the word
        start, end, piece, position = start[ordered], end[ordered], piece[ordered], position[ordered]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(position))])
        last = np.full(len(text) + 1, -1, np.int64)  # the piece that ends there
        last[end[:cuts[1]]] = piece[:cuts[1]]
        for lo, hi in zip(cuts[1:-1], cuts[2:]):
            holds = lo + np.flatnonzero(self.neighbours(last[start[lo:hi]], piece[lo:hi]))
            last[end[holds]] = piece[holds]
        # back from the words' ends, a piece of every word at a time
        at, who, steps = first + size, np.arange(len(words)), []
        while len(who):
            p = last[at]
            steps.append((who, p))
            at = at - self.lengths[p]
            on = at > first[who]
            at, who = at[on], who[on]
        who, p = (np.concatenate(x[::-1]) for x in zip(*steps))
        return self.ids[p[np.argsort(who, kind="stable")]], np.bincount(who, minlength=len(words))

    def encode_long(self, word: str) -> np.ndarray:
        """The ids of one word like those of ``encode_words``, edge by edge in
        the order of position: for words so long that a step per position of
        a whole batch would not pay."""
        text = np.frombuffer((word + "\0").encode("utf-32-le"), np.uint32)
        start, end, piece = self._edges(text)
        order = np.argsort(start, kind="stable")
        last, known, n = [-1] * (len(word) + 1), {}, len(self.pieces)
        for k in range(0, len(order), 1 << 16):
            some = order[k:k + (1 << 16)]
            for s, e, p in zip(start[some].tolist(), end[some].tolist(), piece[some].tolist()):
                if s:
                    key = last[s] * n + p
                    holds = known.get(key)
                    if holds is None:
                        holds = known[key] = self._adjoin(last[s], p)
                    if not holds:
                        continue
                last[e] = p
        ranks, at = [], len(word)
        while at:
            ranks.append(last[at])
            at -= len(self.pieces[last[at]])
        return self.ids[ranks[::-1]]

    def _adjoin(self, a: int, b: int) -> bool:
        """``neighbours`` of one pair."""
        n, limit = len(self.pieces), _FAR
        while True:
            k = bisect_left(self.pair_keys, a * n + b)
            if k < len(self.pair_keys) and self.pair_keys[k] == a * n + b and self.pair_ranks[k] < limit:
                return False
            if max(a, b) < self.singles:
                return True
            if a > b:
                limit, a = a, int(self.right[a])
            else:
                limit, b = b + 1, int(self.left[b])

    def encode_any(self, word: str) -> np.ndarray:
        """The ids of one word of any characters, by plain merging:
        characters that are in no piece become their bytes."""
        got = [self.ids[[self.rank_of[x] for x in self.merge(p)]] if i % 2 == 0
               else self.byte_ids[list(p.encode("utf-8", "surrogatepass"))]
               for i, p in enumerate(self.foreign.split(word)) if p]
        return np.concatenate(got)

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, rank) of every occurrence of every piece."""
        alphabet, bits, per, ranks, lengths, bounds = self._table(np.unique(text))
        width = self.points.shape[1]
        codes = np.searchsorted(alphabet, text).astype(np.int64)
        codes = np.concatenate([codes, np.zeros(2 * width + per, np.int64)])
        levels = -(-width // per)
        keys = []
        for v in range(levels):
            k = np.zeros(len(text), np.int64)
            for c in range(v * per, (v + 1) * per):
                k = (k << bits) | codes[c:c + len(text)]
            keys.append(k)
        suffixes = np.lexsort(keys[::-1]) if levels > 1 else np.argsort(keys[0], kind="stable")
        keys = [k[suffixes] for k in keys]
        low, high = np.zeros(len(ranks), np.int64), np.full(len(ranks), len(text), np.int64)
        for v in range(levels):
            a, b = bounds[v]
            live = np.flatnonzero((lengths > v * per) & (low < high))
            if v == 0:
                low[live] = np.searchsorted(keys[0], a[live], side="left")
                high[live] = np.searchsorted(keys[0], b[live], side="right")
            else:  # within the range of the characters before
                for i in live:
                    part = keys[v][low[i]:high[i]]
                    low[i], high[i] = (low[i] + np.searchsorted(part, a[i], side="left"),
                                       low[i] + np.searchsorted(part, b[i], side="right"))
        found = np.maximum(high - low, 0)
        piece = np.repeat(ranks, found)
        place = np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())
        start = suffixes[place]
        return start, start + self.lengths[piece], piece

    def _table(self, alphabet: np.ndarray) -> tuple:
        """An alphabet that holds the given one (0, the words' end, first), the
        bits of a character, the characters in one key, and the pieces over
        that alphabet, by their characters: ranks, lengths and, for each key,
        its least and greatest values. The last table serves the next batch
        too while its characters take the same bits."""
        bits = max(1, int(len(alphabet)).bit_length())
        if self._last_table and self._last_table[1] == bits:
            both = np.union1d(self._last_table[0], alphabet)
            if len(both) == len(self._last_table[0]):
                return self._last_table
            if len(both).bit_length() == bits:
                alphabet = both
        per, width = 63 // bits, self.points.shape[1]
        levels = -(-width // per)
        where = np.minimum(np.searchsorted(alphabet, self.points), len(alphabet) - 1)
        inside = (alphabet[where] == self.points) | (self.points == 0)
        ranks = np.flatnonzero(inside.all(axis=1) & self.reached)
        ranks = ranks[np.lexsort(where[ranks].T[::-1])]
        lengths, where = self.lengths[ranks], where[ranks]
        where = np.concatenate([where, np.zeros((len(ranks), levels * per - width), where.dtype)], axis=1)
        bounds = []
        for v in range(levels):
            a, b = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for c in range(v * per, (v + 1) * per):
                a = (a << bits) | np.where(c < lengths, where[:, c], 0)
                b = (b << bits) | np.where(c < lengths, where[:, c], (1 << bits) - 1)
            bounds.append((a, b))
        self._last_table = alphabet, bits, per, ranks, lengths, bounds
        return self._last_table


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Model:
    return Model(path)


class _Places(dict):
    """Words' places, as they come; new ones are listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes batches of texts; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.known = np.zeros(0x110000, bool)  # characters that are pieces
        self.known[[ord(p) for p in model.pieces[:model.singles]]] = True
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        #: All ids, and where each word's begin and how many they are.
        self.flat, self.first, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def words(self, text: str) -> list[str]:
        """A text's words, each without the space before it; further spaces
        before it, and U+2581, which stands for one, are part of it."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and SPACE not in text:
            return text.split(" ")
        return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > REMEMBERED:
            self._forget()
        place = self.place
        held = [np.fromiter(map(place.__getitem__, ws), np.int64, len(ws)) for ws in map(self.words, texts)]
        if place.new:
            try:
                self._learn(place.new)
            except BaseException:
                self._forget()
                raise
            place.new = []
        out = []
        for at in held:
            n = self.lengths[at]
            total = int(n.sum())
            out.append(self.flat[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(total)])
        return out

    def _learn(self, words: list[str]) -> None:
        """Words are cut at the characters that are in no piece; the distinct
        parts between them are encoded together."""
        model = self.model
        spaced = [SPACE + w for w in words]
        points = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, spaced), np.int64, len(spaced))
        first = np.cumsum(size) - size
        odd = ~np.logical_and.reduceat(self.known[points], first)
        double = np.concatenate([(points[1:] == ord(SPACE)) & (points[:-1] == ord(SPACE)), [False]])
        double[first[1:] - 1] = False
        alone = np.logical_or.reduceat(double, first)
        split = {int(i): model.foreign.split(spaced[i]) for i in np.flatnonzero(odd & ~alone)}
        plain = np.flatnonzero(~odd & ~alone)
        parts = [spaced[i] for i in plain.tolist()]
        place: dict[str, int] = {}
        for s in split.values():
            for p in s[::2]:
                if p and p not in place:
                    place[p] = len(parts)
                    parts.append(p)
        long = np.fromiter(map(len, parts), np.int64, len(parts)) > LONG
        short, long = np.flatnonzero(~long), np.flatnonzero(long)
        n, got = np.zeros(len(parts), np.int64), [np.empty(0, np.int32)]
        for k in range(0, len(short), WORDS):
            some = short[k:k + WORDS]
            ids, n[some] = model.encode_words([parts[i] for i in some.tolist()])
            got.append(ids)
        for i in long.tolist():
            got.append(model.encode_long(parts[i]))
            n[i] = len(got[-1])
        ids, order = np.concatenate(got), np.concatenate([short, long])
        begin = np.empty(len(parts), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        # where every word's ids begin, and how many they are
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[plain], count[plain] = begin[:len(plain)], n[:len(plain)]
        got, end = [ids], len(ids)
        for i, s in split.items():
            got.append(np.concatenate([ids[begin[place[p]]:begin[place[p]] + n[place[p]]] if k % 2 == 0
                                       else model.byte_ids[list(p.encode("utf-8", "surrogatepass"))]
                                       for k, p in enumerate(s) if p]))
            first[i], count[i] = end, len(got[-1])
            end += len(got[-1])
        for i in np.flatnonzero(alone).tolist():
            got.append(model.encode_any(spaced[i]))
            first[i], count[i] = end, len(got[-1])
            end += len(got[-1])
        self.first = np.concatenate([self.first, first + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, count])
        self.flat = np.concatenate([self.flat, *got])


#: One encoder per process: tasks that follow each other share what it remembers.
_ENCODERS: dict[str, Encoder] = {}


def decode(model: Model, ids: np.ndarray) -> str:
    """The text of ``ids``: pieces and bytes joined, the space that encoding
    put first taken off."""
    raw = b"".join([model.bytes_of[i] for i in ids.tolist()])
    return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


def encode_documents(docs: DataFrame, path: str = MODEL, keep_ids: bool = True, piece_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, row_key and,
    with ``keep_ids``, token_ids (array of int).

    The ids are those of the model's own encoder. ``ids_sha256`` is of the
    ids as little-endian 32-bit numbers, ``decoded_sha256`` of the decoded
    text in UTF-8; ``round_trip`` says whether that equals the text (a text
    that holds U+2581 comes back with spaces). Null texts count as empty and
    have no ids. A worker takes ``piece_bytes`` of text at a time (a longer
    text by itself). The vocabulary at ``path`` is read by the driver and goes to
    the tasks as a broadcast variable (a few MB, whatever the input), unpacked
    once in a process."""
    held = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(held.value))
        model = encoder.model
        for b in slices(batches, max_bytes=piece_bytes):
            texts = b.column("text").to_pylist()
            ids = encoder.encode(texts)
            back = [decode(model, x) for x in ids]
            columns = {
                "doc_id": b.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                "round_trip": pa.array([x == y for x, y in zip(texts, back)], pa.bool_()),
                "row_key": b.column("row_key"),
            }
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns["token_ids"] = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                       text_or_empty().alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, row_key long"
    return rows.mapInArrow(run, schema + (", token_ids array<int>" if keep_ids else ""))
