"""Embedding whitening: leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration.

Entries become whole numbers x = floor(64 c) + 1000000. They are written once as blocks, matrices of at most
BLOCK numbers. The exact sums S give the centre, and x - S/n is taken as (x - S div n) - (S mod n)/n, so that
nothing cancels. After that only passes over the blocks touch the data: a task sums its share of
X'X Q for the centred X, and Spark adds up the tasks. Q has as many rows as a vector has entries and
as many columns as the subspace, so what comes to the driver does not grow with the vectors.

A round is one Rayleigh-Ritz step (its pass also gives the residuals) and, until these are certified, a
filter: the Chebyshev recurrence, one pass a degree, damps all eigenvalues between 0 and the smallest Ritz
value, then QR. Certified means a residual under CERTAIN times the largest eigenvalue, about what
rounding leaves, or one that rounds have stopped to lower; the second is an error above WORST. The angle to
the true eigenvector is at most the residual over the distance to the next eigenvalue.

Edge cases: vectors that are null, empty, or hold a null or non-finite entry are dropped; the others must
have the width that most of them have (ties: the larger), those of other widths are dropped likewise.
64 c beyond 2^53 counts as 2^53 with its sign, a deviation beyond a long as the largest long. Rows
without a vec_id and repeated rows take part, a result row each. A component whose eigenvalue is under
FLAT of the largest is left out, since doubles cannot tell it from zero, so few or constant vectors have
fewer components, and equal vectors have none; equal eigenvalues have any basis. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import staged, table

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Numbers of a block.
BLOCK = 1 << 18
#: Highest degree of a filter, and how much more a filter may stretch the largest direction than the smallest.
DEGREE, STRETCH = 8, 1e7
CERTAIN, WORST, FLAT, ROUNDS = 1e-14, 1e-10, 1e-11, 200
LONGEST = (1 << 63) - 1
#: Sums of x are taken of high and low parts, so that no long overflows.
LOW = 26


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        begin = np.asarray(vectors.offsets)[: len(vectors)]
        widths = np.diff(np.asarray(vectors.offsets))
        entries = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            each = max(1, BLOCK // int(width))
            for at in range(0, len(rows), each):
                own = rows[at : at + each]
                c = entries[begin[own][:, None] + np.arange(width)]
                x = np.clip(np.floor(SCALE * c), -(2.0**53), 2.0**53).astype(np.int64) + SHIFT
                held = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids.take(pa.array(own)))
                sums = [pa.array([part.sum(axis=0).tolist()], pa.list_(pa.int64())) for part in (x >> LOW, x & ((1 << LOW) - 1))]
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([len(own)], pa.int64()), held, pa.array([x.tobytes()], pa.binary()), *sums], names=["width", "n", "ids", "x", "high", "low"])


def fit_list(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """The vectors that take part, as blocks (width, n, ids, x, high, low)."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & finite).select("vec_id", vec)
    return kept.mapInArrow(_blocks, "width int, n long, ids array<long>, x binary, high array<long>, low array<long>")


@dataclass
class Centre:
    """Number of vectors and where their mean lies: floor and rest of S / n."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.low = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.over = [s % self.n for s in self.sums]
        self.rest = np.array([r / self.n for r in self.over])

    def whole(self, block: pa.RecordBatch, row: int) -> np.ndarray:
        """x - floor(S / n) of a block."""
        return np.frombuffer(block.column("x")[row].as_buffer(), dtype=np.int64).reshape(-1, len(self.low)) - self.low

    def deviation(self, whole: np.ndarray) -> np.ndarray:
        """Sum of (n x - S)^2 of each row, exact."""
        if len(self.low) * (self.n * (int(np.abs(whole).max()) + 1)) ** 2 <= LONGEST:
            return ((whole * self.n - np.array(self.over, dtype=np.int64)) ** 2).sum(axis=1)
        return np.array([min(LONGEST, sum((self.n * int(v) - o) ** 2 for v, o in zip(row, self.over, strict=True))) for row in whole], dtype=np.int64)


def centre(blocks: DataFrame) -> tuple[int, Centre] | None:
    """The width that most vectors have, and their centre."""
    widths = blocks.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widths:
        return None
    parts = blocks.where(F.col("width") == widths[0].width).select(F.posexplode(F.arrays_zip("high", "low")))
    sums = parts.groupBy("pos").agg(F.sum("col.high").alias("high"), F.sum("col.low").alias("low")).orderBy("pos").collect()
    return widths[0].width, Centre(widths[0].n, [(r.high << LOW) + r.low for r in sums])


def summed(blocks: DataFrame, at: Centre, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over blocks of fn(centred vectors), a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in range(batch.num_rows):
                part = fn(at.whole(batch, row) - at.rest)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    added = blocks.select("x").mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((1 + max(r.i for r in added), 1 + max(r.j for r in added)))
    for i, j, v in added:
        out[i, j] = v
    return out


def _degree(top: float, edge: float) -> int:
    """The highest degree under which the largest direction outgrows the edge by STRETCH at most."""
    return int(np.clip(np.log(2 * STRETCH) / np.arccosh(max(2 * top / edge - 1, 1 + 1e-9)), 2, DEGREE))


def _filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, first: np.ndarray, edge: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the covariance that is small on [0, edge], scaled to 1 at `top`, times q; first is the covariance times q."""
    half = edge / 2
    scale = half / (top - half)
    sigma, before, now = scale, q, (first - half * q) * (scale / half)
    for _ in range(_degree(top, edge) - 1):
        after = 1 / (2 / scale - sigma)
        before, now = now, (product(now) - half * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def eigen(product: Callable[[np.ndarray], np.ndarray], width: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), the k largest, of the matrix behind product(q)."""
    size = min(width, k + max(16, 5 * k // 8))
    q = np.eye(width) if size == width else np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    worst, stalled = np.inf, 0
    for _ in range(ROUNDS):
        w = product(q)
        small = q.T @ w
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        top = values[0]
        if top <= 0:
            return values[:0], q[:, :0]
        off = np.linalg.norm(w - q * values, axis=0)[:k].max() / top
        stalled, worst = (stalled + 1, worst) if off > worst / 2 else (0, off)
        edge = values[-1]
        if off <= CERTAIN or size == width or stalled > 2 and off <= WORST:
            kept = values[:k] > FLAT * top
            sign = np.sign(q[np.abs(q).argmax(axis=0), np.arange(size)])
            return values[:k][kept], (q * sign)[:, :k][:, kept]
        # Where the subspace reaches eigenvalues of zero, one product has all others.
        q = np.linalg.qr(w if edge <= FLAT * top else _filtered(product, q, w, edge, top))[0]
    raise ArithmeticError(f"the residual is still {off:.1e} of the largest eigenvalue")


def whitened(rows: DataFrame, k: int = COMPONENTS, vec: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and component up to k."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks = staged(fit_list(rows, vec), "blocks")
    found = centre(blocks)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    width, at = found
    blocks = blocks.where(F.col("width") == width)
    trace = summed(blocks, at, lambda d: (d * d).sum(keepdims=True).reshape(1, 1))[0, 0] / at.n
    values, vectors = eigen(lambda q: summed(blocks, at, lambda d: d.T @ (d @ q)) / at.n, width, k)
    kept = len(values)
    if not kept:
        return rows.sparkSession.createDataFrame([], schema)
    to = vectors / np.sqrt(values)
    mean = summed(blocks, at, lambda d: (d @ to).sum(axis=0, keepdims=True))[0] / at.n

    def spread(d: np.ndarray) -> np.ndarray:
        z = d @ to - mean
        return z.T @ z

    off = float(np.abs(summed(blocks, at, spread) / at.n - np.eye(kept)).max())
    shares = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                whole = at.whole(batch, row)
                z, m = (whole - at.rest) @ to, len(whole)
                arrays = [
                    batch.column("ids")[row].values.take(pa.array(np.repeat(np.arange(m), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, at.n, dtype=np.int64)),
                    pa.array(np.repeat(at.deviation(whole), kept)), pa.array(z.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * kept, off)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.select("ids", "x").mapInArrow(run, schema)


def op11_whiten_chebyshev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
