"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, steps alternate the products p = X v and z = Xᵀ p, both
made where the rows are. The left vectors are as long as the table, so none is
stored: each is X w for a w of one number per dimension, and since uᵀ p = wᵀ z,
the driver reorthogonalises left and right vectors fully from the z of every
step, a few hundred numbers. The small bidiagonal matrix's singular value
decomposition gives the components and their standard deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from platewise.llm.common import materialise

#: Entries are counted in steps of one 64th.
SCALE = 64
#: Entries in a packed block, at most (one longer vector makes a block).
BLOCK_ENTRIES = 1 << 18
#: Tasks of a pass, at most; the driver gets one row of sums from each.
PASS_TASKS = 4096
_SEED = 20_260_311
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)
#: Beyond this a scaled entry stops (no embedding comes near).
_LARGEST = float(1 << 62)

_BLOCKS = "dims int, rows int, ids array<bigint>, width int, x binary, sums array<decimal(38,0)>"
_WHITE = "vec_id bigint, deviation decimal(38,0), whitened array<double>"


def _pack(scale: int):
    """Batches of (vec_id, embedding) as blocks of whole numbers of one length
    in the narrowest type that holds them, without the vectors that are null
    or hold null or non-finite entries."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            values = lists.values.to_numpy(zero_copy_only=False)  # null entries become nan
            offsets = lists.offsets.to_numpy()
            with np.errstate(invalid="ignore"):
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            fine = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
            lengths = np.diff(offsets)
            for dims in np.unique(lengths[fine]):
                of = np.flatnonzero(fine & (lengths == dims))
                step = max(1, BLOCK_ENTRIES // max(1, int(dims)))
                for start in range(0, len(of), step):
                    some = of[start:start + step]
                    x = np.floor(values[offsets[some][:, None] + np.arange(dims)].astype(np.float64) * scale)
                    x = np.clip(x, -_LARGEST, _LARGEST).astype(np.int64)
                    top = int(max(x.max(initial=0), -(x.min(initial=0) + 1)))
                    kind = next(t for t in _WIDTHS if top <= np.iinfo(t).max)
                    near = top * len(some) < 1 << 62
                    sums = x.sum(axis=0) if near else x.astype(object).sum(axis=0)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([dims], pa.int32()), pa.array([len(some)], pa.int32()),
                        pa.array([ids.take(pa.array(some)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary()),
                        pa.array([[Decimal(int(s)) for s in sums]], pa.list_(pa.decimal128(38, 0)))],
                        names=["dims", "rows", "ids", "width", "x", "sums"])

    return blocks


def _unpack(width: int, x: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(x, f"i{width}").reshape(-1, dims)


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for b in batches:
        for width, x in zip(b.column("width").to_pylist(), b.column("x")):
            yield _unpack(width, x.as_buffer(), dims)


def _summed(blocks: DataFrame, dims: int, size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``add(x)`` (``size`` numbers) over all blocks: a row from
    each task, added in the tasks' order, so that reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _matrices(batches, dims):
            total += add(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            names=["part", "total"])

    rows = blocks.select("width", "x").coalesce(PASS_TASKS).mapInArrow(run, "part int, total binary").collect()
    parts = [np.frombuffer(r["total"]) for r in sorted(rows, key=lambda r: r["part"])]
    return np.sum(parts, axis=0) if parts else np.zeros(size)


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): X V = U B with U and V orthonormal and B upper bidiagonal,
    where ``product(w)`` is Xᵀ X w.

    Goes on for as many steps as X has columns, so that no component is
    missed: where the sequence ends early (equal singular values, a row space
    of fewer dimensions) a new direction, orthogonal to the ones so far, starts
    the rest, with a 0 beside the diagonal."""
    rng = np.random.default_rng(_SEED)
    v, w, z = np.zeros((3, dims, dims))  # a row per step: v; w, where u = X w; Xᵀ u
    b = np.zeros((dims, dims))

    def apart(r: np.ndarray, j: int) -> np.ndarray:
        for _ in range(2):
            r = r - v[:j].T @ (v[:j] @ r)
        return r

    def fresh(j: int) -> np.ndarray:
        r = apart(rng.standard_normal(dims), j)
        return r / np.linalg.norm(r)

    v[0], beta, least = fresh(0), 0.0, 0.0
    for j in range(dims):
        wj = v[j] - beta * w[j - 1] if j else v[j]
        zj = product(wj)
        for _ in range(2):  # the left vectors' inner products, in w and z alone
            c = w[:j] @ zj
            wj, zj = wj - c @ w[:j], zj - c @ z[:j]
        alpha = np.sqrt(max(wj @ zj, 0.0))
        least = max(least, alpha * 1e-12, 1e-300)
        if alpha > least:
            w[j], z[j], b[j, j] = wj / alpha, zj / alpha, alpha
        if j + 1 == dims:
            break
        r = apart(z[j] - b[j, j] * v[j], j + 1)
        beta = float(np.linalg.norm(r))
        if beta > least:
            v[j + 1] = r / beta
            b[j, j + 1] = beta
        else:
            v[j + 1], beta = fresh(j + 1), 0.0
    return v, b


def whiten(vectors: DataFrame, components: int = 32, scale: int = SCALE) -> DataFrame:
    """One row per vector that stays and component: vec_id, component (from 1,
    by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    ``vectors`` has vec_id and embedding; other columns are ignored. An entry
    c counts as floor(scale * c). Vectors that are null or hold null or
    non-finite entries are dropped, and so are vectors whose length is not the
    most frequent one (of equally frequent ones, the greater). Null and
    repeated vec_ids are rows like others. Directions without variance (more
    dimensions than vectors, constant entries) are no components; when there
    is no other, or the table is empty, the result is empty. ``deviation`` is
    exact: the sum of squares of n * x - S over the dimensions, as a decimal
    (null beyond 38 digits). Reruns over the same files agree."""
    spark = vectors.sparkSession
    entries = "array<float>" if vectors.schema["embedding"].dataType.elementType == FloatType() else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.col("embedding").cast(entries).alias("embedding"))
    blocks = materialise(rows.mapInArrow(_pack(scale), _BLOCKS), "whiten-blocks")
    shape = (blocks.groupBy("dims").agg(F.sum("rows").alias("n"))
             .orderBy(F.desc("n"), F.desc("dims")).filter("dims > 0").first())
    if shape is None:
        return _empty(vectors)
    dims, n = shape["dims"], shape["n"]
    blocks = blocks.filter(F.col("dims") == dims)
    sums = {r["pos"]: int(r["s"]) for r in blocks.select(F.posexplode("sums")).groupBy("pos")
            .agg(F.sum("col").alias("s")).collect()}
    sums = [sums[i] for i in range(dims)]
    mean = np.array([float(Fraction(s, n)) for s in sums])

    held = blocks.select("width", "x").persist(StorageLevel.MEMORY_AND_DISK)

    def product(w: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ w)

        return _summed(held, dims, dims, add)

    v, b = bidiagonalise(product, dims)
    _, deviations, right = np.linalg.svd(b)
    variances = deviations ** 2 / n
    trace = float(variances.sum())
    k = min(components, int((variances > variances[0] * dims * 1e-14).sum()) if trace > 0 else 0)
    if k == 0:
        held.unpersist()
        return _empty(vectors)
    # a column per component, scaled to unit variance of the projection
    to_white = (right[:k] @ v).T / np.sqrt(variances[:k])

    def moments(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ to_white
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    total = _summed(held, dims, k + k * k, moments) / n
    held.unpersist()
    covariance = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    error = float(np.abs(covariance - np.eye(k)).max())

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, width, packed in zip(batch.column("ids"), batch.column("width").to_pylist(), batch.column("x")):
                x = _unpack(width, packed.as_buffer(), dims)
                white = (x - mean) @ to_white
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids.as_py(), pa.int64()), _deviations(x, n, sums),
                    pa.ListArray.from_arrays(np.arange(0, white.size + 1, k, dtype=np.int32), white.ravel())],
                    names=["vec_id", "deviation", "whitened"])

    out = blocks.select("ids", "width", "x").mapInArrow(whitened, _WHITE)
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*[F.lit(float(e / trace)) for e in variances[:k]]), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of squares of n * x - S, a vector each."""
    top = n * int(np.abs(x.astype(np.float64)).max(initial=0.0) + 1) + max(map(abs, sums))
    kind = np.int64 if top * top * len(sums) < 1 << 63 else object
    apart = n * x.astype(kind) - np.array(sums, dtype=kind)
    return pa.array([Decimal(d) if d < 10 ** 38 else None for d in (apart * apart).sum(axis=1).tolist()],
                    pa.decimal128(38, 0))


def _empty(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "vec_id bigint, component int, n bigint, deviation decimal(38,0), "
                                                    "whitened double, explained double, identity_error double")
