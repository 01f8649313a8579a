"""Near-duplicate documents by SuperMinHash, banding, verification on the full
shingle sets, and union-find grouping.

Documents with one shingle set form a class and are treated once. Classes
that share a band of their signatures are candidates. Each bucket first links
its members to one representative (as many pairs as members). Where a bucket
still holds classes of different groups, its members are compared tile by
tile: signatures say which members may have a link there, and those meet
again with their full sets. A tile gives the links that join its groups, no
list of its pairs. Every link is confirmed on the two full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import BROADCAST_ROWS, keep_decided, materialise, row_key, slices, text_or_empty

SHINGLE = 5
#: Slots of a signature.
SLOTS = 120
#: A true link may miss all bands with this probability at most.
MISS = 1e-6
#: Pairs whose share of equal slots lies this far below the threshold are not
#: verified (six standard deviations of the estimate).
SLACK = 0.2
#: Members of a bucket that one tile compares with one other tile's, and the
#: shingles they may have, about.
TILE, TILE_SHINGLES = 1024, 1_000_000
#: UTF-8 bytes of the texts signed at a time.
SIGN_BYTES = 2 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


def band_rows(percent: int) -> int:
    """The most rows a band may have so that a pair at the threshold shares
    no band with probability ``MISS`` at most."""
    j = percent / 100
    return max(r for r in range(1, SLOTS + 1) if r == 1 or (1 - j**r) ** (SLOTS // r) <= MISS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's five-word shingles.
    A-Z is lower-cased; words are split at ASCII white space. With fewer than
    five words the whole sequence is one shingle, without words the set is
    empty."""
    known, hashed = _WordHashes(), [np.empty(0, _U)]
    for t in texts:
        ws = t.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        hashed.append(np.fromiter(map(known.__getitem__, ws), _U, len(ws)))
    known.clear()
    counts = np.array([len(x) for x in hashed[1:]], np.int64)
    w = np.concatenate(hashed)
    first = np.cumsum(counts) - counts
    whole = _rolled(w, SHINGLE)
    out = []
    for at, n in zip(first.tolist(), counts.tolist()):
        out.append(np.unique(whole[at:at + n - SHINGLE + 1] if n >= SHINGLE else _rolled(w[at:at + n], n)))
    return out


def _rolled(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` word hashes."""
    m = len(w) - n + 1
    if n < 1 or m < 1:
        return np.empty(0, _U)
    h = np.full(m, n, _U)
    for i in range(n):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[i:i + m])
    return h


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (documents, SLOTS) of non-empty sets.

    An element visits the slots in a random order of its own; its j-th visit
    leaves j plus a random fraction, and a slot keeps the smallest value it
    got. All elements take their j-th step together, and a document stops
    once all its slots are filled: a later visit leaves more than j."""
    sig = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, _U)
    live = np.array([i for i, s in enumerate(sets) if len(s)], int)
    element = np.concatenate([sets[i] for i in live]) if len(live) else np.empty(0, _U)
    doc = np.repeat(live, [len(sets[i]) for i in live])
    swaps: list[np.ndarray] = []
    for j in range(SLOTS):
        if not len(doc):
            break
        r = _mix(element + _U((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = j + ((r >> _U(40)) % _U(SLOTS - j)).astype(np.int64)
        slot = k.copy()
        for i in range(j - 1, -1, -1):  # the shuffle's earlier exchanges, undone
            slot = np.where(slot == swaps[i], i, slot)
        swaps.append(k)
        value = (_U(j) << _U(32)) | (_mix(r) >> _U(32))
        at = doc * SLOTS + slot
        np.minimum.at(sig.reshape(-1), at, value)
        full = (sig != np.iinfo(np.uint64).max).all(axis=1)
        on = ~full[doc]
        element, doc, swaps = element[on], doc[on], [s[on] for s in swaps]
    return sig


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots; the band's number is part of it."""
    n = SLOTS // rows
    h = np.broadcast_to(_mix(np.arange(1, n + 1, dtype=_U)), (len(sig), n)).copy()
    for i in range(rows):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + sig[:, i:n * rows:rows])
    return h


def _sign(rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max_bytes=SIGN_BYTES):
            sets = shingle_sets(b.column("text").to_pylist())
            sig = signatures(sets)
            keys = bands(sig, rows).astype(np.int64)
            full = np.array([len(s) > 0 for s in sets])
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("row_key"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([k.tolist() if f else None for k, f in zip(keys, full)], pa.list_(pa.int64())),
                pa.array([_short(s) if f else None for s, f in zip(sig, full)], pa.binary()),
            ], ["doc_id", "row_key", "n_shingles", "set_key", "bands", "signature"])

    return sign


def _short(sig: np.ndarray) -> bytes:
    return _mix(sig).astype(np.uint32).tobytes()  # equal slots stay equal


def _verify(percent: int):
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = []
            for x, y in zip(f["a_set"], f["b_set"]):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield f.loc[ok, ["a", "b"]]

    return verify


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = shingle_sets(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [b.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's links: (node, smallest node of its
    tree); bounded by the nodes of the partition."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(find(x), x) for x in parent]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"]).astype("int64")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the smallest
    node it is linked with, over any number of links. Partitions contract
    their links by union-find, then nodes hand the smallest neighbour on in
    rounds (large and small stars) until the trees are stars."""
    edges = materialise(links.select("a", "b").mapInPandas(_forest, "a long, b long"), "near-edges")
    while True:
        # every node links its larger neighbours to the smallest of them all
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = near.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").distinct()
        # and its smaller ones, and itself, to the smallest of those
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b")
        small = small.select(F.col("low").alias("a"), F.col("a").alias("b")).filter("a < b").unionByName(
            low.select(F.col("low").alias("a"), "b")).distinct()
        small = materialise(small, "near-edges")
        # stars: no node is both a root and a leaf, and each leaf has one root
        stars = small.select(F.col("b").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(
            small.select(F.col("a").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        stars = stars.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
        edges = small
        if stars.filter("leaf > 1 or (leaf > 0 and root > 0)").isEmpty():
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _groups(batch: pa.RecordBatch, column: str) -> tuple[pa.StructArray, list[slice]]:
    """The structs of a list column, one list after the other, and each list's place."""
    lists = batch.column(column)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return pa.compute.list_flatten(lists), [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]


def _promising(percent: int, rows: int):
    """(at, node): the members of a tile pair that have, with one of another
    group, sizes and signatures that allow a link. A pair counts in the first
    band that it shares."""
    least, n = (percent / 100 - SLACK) * SLOTS, SLOTS // rows

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, places = _groups(b, "members")
            node, root, size, tile = (flat.field(c).to_numpy() for c in ("node", "root", "n_shingles", "tile"))
            sig = np.frombuffer(b"".join(flat.field("signature").to_pylist()), np.uint32).reshape(len(node), SLOTS)
            found = [np.empty((0, 2), np.int64)]
            for k, (mine, i, j, band) in enumerate(zip(places, *(b.column(c).to_numpy() for c in ("i", "j", "number")))):
                left = mine.start + np.flatnonzero(tile[mine] == i)
                right = mine.start + np.flatnonzero(tile[mine] == j)
                hit = np.zeros(mine.stop - mine.start, bool)
                for at, x in enumerate(left):
                    y = left[at + 1:] if i == j else right
                    y = y[(root[y] != root[x])
                          & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
                    equal = sig[y] == sig[x]
                    first = equal[:, :n * rows].reshape(-1, n, rows).all(axis=2).argmax(axis=1)
                    y = y[(equal.sum(axis=1) >= least) & (first == band)]
                    if len(y):
                        hit[y - mine.start] = hit[x - mine.start] = True
                at = mine.start + np.flatnonzero(hit)
                found.append(np.stack([np.full(len(at), k), node[at]], axis=1))
            got = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([
                b.column("band").take(pa.array(got[:, 0])), b.column("i").take(pa.array(got[:, 0])),
                b.column("j").take(pa.array(got[:, 0])), pa.array(got[:, 1])], ["band", "i", "j", "node"])

    return promising


def _linked(percent: int):
    """Within each group of members with their sets: links that join all
    those groups of them which a link joins, confirmed on the sets."""
    def links(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        size = np.array([len(x) for x in sets])
        _, element = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        held = np.bincount(element)
        holders = owner[np.argsort(element, kind="stable")]  # by element
        start, first = np.cumsum(held) - held, np.cumsum(size) - size
        label = np.unique(root, return_inverse=True)[1]
        for x in range(len(sets)):
            other = np.flatnonzero((label != label[x])
                                   & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])))
            if not len(other):
                continue
            mine = element[first[x]:first[x] + size[x]]
            n = held[mine]
            at = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(holders[at], minlength=len(sets))[other]
            for y in other[100 * common >= percent * (size[other] + size[x] - common)]:
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    yield min(node[x], node[y]), max(node[x], node[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, places = _groups(b, "members")
            node, root = (flat.field(c).to_numpy() for c in ("node", "root"))
            raw, found = flat.field("set").to_pylist(), []
            for mine in places:
                found += links(node[mine], root[mine], [np.frombuffer(x, _U) for x in raw[mine]])
            got = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    return run


def _members(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of ``near_duplicates`` with ``stays``: of each component the
    rows of its smallest (doc_id, row_key), null doc_ids last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                       text_or_empty().alias("text"))
    signed = materialise(rows.mapInArrow(
        _sign(band_rows(percent)), "doc_id long, row_key long, n_shingles long, set_key binary, "
        "bands array<bigint>, signature binary"), "near-signed")
    classes = signed.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("head"),
        F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = classes.select("set_key", "head.doc_id", "head.row_key", "n_shingles", "bands", "signature")
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")

    # Round 1: in every bucket, its members with the smallest one.
    member = classes.select("node", F.explode("bands").alias("band"))
    bucket = member.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = member.join(bucket.select("band", "a"), "band").filter("a < node").select("a", F.col("node").alias("b"))
    links = _confirmed(rows, classes, materialise(pairs.distinct(), "near-pairs"), percent)
    groups = components(links)

    # Round 2: buckets that still hold different groups, tile by tile.
    placed = classes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialise(placed, "near-placed")
    mixed = placed.select("root", "n_shingles", F.explode("bands").alias("band")).groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.greatest(F.count(F.lit(1)) / TILE, F.sum("n_shingles") / TILE_SHINGLES).alias("share")).filter("low < high")
    mixed = materialise(mixed.select("band", F.ceil("share").cast("int").alias("tiles")), "near-mixed")
    if not mixed.isEmpty():
        spread = placed.select("node", F.posexplode("bands").alias("number", "band")).join(mixed, "band")
        spread = spread.join(placed.select("node", "root", "n_shingles", "signature"), "node")
        spread = spread.withColumn("tile", F.pmod(F.xxhash64("node", "band"), F.col("tiles")).cast("int"))
        # a member meets its own tile and every other one, in (smaller, larger) order
        spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        spread = spread.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
        tiles = spread.groupBy("band", "i", "j", "number").agg(  # two tiles' members
            F.collect_list(F.struct("node", "root", "n_shingles", "tile", "signature")).alias("members"))
        hopeful = materialise(tiles.mapInArrow(_promising(percent, band_rows(percent)),
                                               "band long, i int, j int, node long"), "near-hopeful")
        sets = _sets_of(rows, placed, hopeful.select("node").distinct())
        tiles = hopeful.join(placed.select("node", "root"), "node").join(sets, "node").groupBy("band", "i", "j").agg(
            F.collect_list(F.struct("node", "root", "set")).alias("members"))
        more = materialise(tiles.select("members").mapInArrow(_linked(percent), "a long, b long"), "near-links")
        groups = components(links.unionByName(more))

    named = classes.select("set_key", "node", "doc_id", "row_key").join(groups, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("head"))
    named = named.join(lowest, "root").select(
        "set_key", F.col("head.doc_id").alias("component_id"), F.col("head.row_key").alias("head_key"))
    full = signed.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_key", "row_key").join(named, "set_key")
    bare = signed.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row_key", F.col("row_key").alias("head_key"))
    out = full.select("doc_id", "n_shingles", "component_id", "row_key", "head_key").unionByName(bare)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "row_key",
                      (kept & (F.col("row_key") == F.col("head_key"))).alias("stays"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, n_shingles, component_id, kept, row_key.

    Documents are linked when ``100 * |A and B| >= percent * |A or B|`` for
    their shingle sets; a component is what links reach. ``component_id`` is
    its smallest doc_id (null doc_ids count only when there is no other).
    Texts without words (null, empty, white space) have an empty set and are
    linked with nothing: each such row is its own component. Rows that repeat
    a doc_id share its smallest component's fate by text: equal texts are one
    class, different texts are told apart. ``kept``: doc_id is component_id.
    An empty table gives an empty result."""
    return _members(docs, percent).drop("stays")


def _sets_of(rows: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set) of the named classes. The sets are made anew from the
    texts, so that no other text or set is shuffled while the list of the
    classes is of bounded size."""
    wanted = materialise(classes.join(nodes, "node").select(
        "node", F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")), "near-wanted")
    match = [rows["doc_id"].eqNullSafe(F.col("_id")), rows["row_key"] == F.col("_key")]
    texts = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, match)
    sets = texts.select("node", "text").mapInArrow(_sets, "node long, set binary")
    return materialise(sets.dropDuplicates(["node"]), "near-sets")


def _confirmed(rows: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(rows, classes, nodes)
    a, b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set")) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "a_set", "b_set")
    return materialise(joined.mapInPandas(_verify(percent), "a long, b long"), "near-links")


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every group of near duplicates: that of the
    smallest doc_id, and of its texts the one with the smallest hash, also
    where rows share a doc_id or have none. Texts without words all stay."""
    d = _members(docs, percent)
    return keep_decided(docs, d.select("doc_id", "row_key", F.col("stays").alias("kept"),
                                       (F.col("n_shingles") > 0).alias("once")))
