"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become integers, floor(256 * c).  The covariance V is over the distinct vectors, which are
written once, each as the bytes of its integers in the least width.  V is never formed for wide vectors: every
step is one pass over that table that sends each task's part of the centred product X'XQ / n (a
block of a few columns) to a sum by cell.

A few Lanczos steps give the low end of the spectrum.  Each round then applies a scaled Chebyshev
polynomial to the block, by its three-term recurrence with one pass a degree: it stays below one
between the low end and the block's least Ritz value and grows fast above, so the wanted
directions come out.  QR and Rayleigh-Ritz follow.  Directions whose residual is below ``EXACT`` of
the largest eigenvalue are locked and taken out of the block.  The degree is chosen so that the
largest growth in a round is ``GROWTH``: more would drown the weaker directions in rounding.

The result is certified: once the wanted components are locked, the rest of the block is drawn
anew at random, and a whole round must bring up no direction above the least wanted one; the last
pass measures all residuals and the covariance of the whitened fit list.  Where the block
is as wide as the vectors, one pass and Rayleigh-Ritz are the whole problem.

Cases: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are those
of another length than most rows have (ties: the longer; empty vectors have no components); a
null vec_id stays; repeated rows and ids get a row each, their vector counts once in the fit;
components whose eigenvalue is zero (fewer than two distinct vectors, or fewer dimensions than
components are spanned) have null ``whitened``; an empty table, or one without sound rows, gives
an empty result; values beyond the exact range of 64-bit integers raise an error; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expstudy.llm.common import written

SCALE, COMPONENTS = 256, 4
#: Columns of the block, Lanczos steps, most degrees of a round and most rounds.
BLOCK, STEPS, DEGREE, ROUNDS = 32, 8, 16, 200
#: Residual of a locked direction and largest growth in a round, both against the largest eigenvalue.
EXACT, GROWTH = 2e-14, 1e8
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _integers(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integer vectors as a matrix) of the sound rows of an Arrow list array, for each length."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten()  # without the entries of null rows
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(known, sizes, 0)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.append(0, np.cumsum(~np.isfinite(values)))  # nulls are NaN here
    sound = known & (bad[ends] == bad[ends - sizes]) & (sizes > 0)
    for d in np.unique(sizes[sound]).tolist():
        rows = np.flatnonzero(sound & (sizes == d))
        x = np.floor(values[(ends[rows] - d)[:, None] + np.arange(d)] * SCALE)
        if np.abs(x).max(initial=0) >= 2.0 ** 62:
            raise OverflowError("an entry of a vector is beyond the exact range of 64-bit integers")
        yield rows, x.astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d and x (little-endian integers of the least width that holds the vector) of the sound rows."""
    for b in batches:
        for _, x in _integers(b.column(0)):
            d, most = x.shape[1], np.abs(x).max(axis=1)
            width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
            for w in np.unique(width).tolist():
                own, step = x[width == w], max(1, (1 << 30) // (w * d))
                for at in range(0, len(own), step):
                    part = own[at:at + step].astype(f"<i{w}")
                    offsets = np.arange(len(part) + 1, dtype=np.int32) * np.int32(w * d)
                    data = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(part.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), d, np.int32)), data], names=["d", "x"])


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """The vectors of packed rows as matrices of 64-bit integers, in pieces of up to 4,096."""
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column(0)
        sizes = np.diff(np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1])
        for size in np.unique(sizes).tolist():
            own = x if (sizes == size).all() else x.filter(pa.array(sizes == size))
            start = np.frombuffer(own.buffers()[1], np.int32)[own.offset]
            whole = np.frombuffer(own.buffers()[2], f"<i{size // d}", len(own) * d, start).reshape(-1, d)
            for at in range(0, len(whole), 4096):
                yield whole[at:at + 4096].astype(np.int64)


def _cells(fit: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str) -> dict[int, object]:
    """The sum over the tasks of the numbers that ``part`` makes of each task's rows, by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = part(batches)
        yield pa.RecordBatch.from_arrays([pa.array([made.ravel().tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))],
                                         names=["part"])
    sums = fit.select("x").mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part"))
    return {r.pos: r.total for r in sums.groupBy("pos").agg(F.sum("col").alias("total")).collect()}  # d times a few


@dataclass
class Fit:
    """Count and sums of the fit list, and the leading eigenpairs of its covariance."""

    d: int = 0
    n: int = 0
    sums: np.ndarray | None = None     # 64-bit integers
    values: np.ndarray | None = None   # falling
    vectors: np.ndarray | None = None  # columns
    trace: float = 0.0
    residual: float = 0.0              # largest |Vq - eq|: an eigenvalue is that close to each value
    identity_error: float = 0.0
    passes: int = 0

    @property
    def directions(self) -> np.ndarray:
        """Columns that whiten; zero where the eigenvalue is."""
        sound = self.values > self.d * np.finfo(float).eps * max(self.trace, 0.0)
        return np.where(sound, self.vectors / np.sqrt(np.where(sound, self.values, 1.0)), 0.0)


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The distinct vectors (x) of the length that most rows have, written once, and that length."""
    rows = vectors.select("embedding").mapInArrow(_packed, "d int, x binary")
    distinct = written(rows.groupBy("d", "x").agg(F.count("*").alias("rows")), "fit")
    lengths = distinct.groupBy("d").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    return distinct.where(F.col("d") == d).select("x"), d


class _Passes:
    """Products with the covariance, one job each."""

    def __init__(self, fit: DataFrame, d: int):
        self.fit, self.d, self.n_passes = fit, d, 1
        def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total, most, n = np.zeros(d, np.int64), 0.0, 0
            for x in _matrices(batches, d):
                most += float(np.abs(x).max()) * len(x)
                if most >= 2.0 ** 62:
                    raise OverflowError("sums of the vectors are beyond the exact range of 64-bit integers")
                total, n = total + x.sum(axis=0), n + len(x)
            return np.append(total, n)
        made = _cells(fit, sums, "long")
        self.n, self.sums = made[d], np.array([made[i] for i in range(d)], np.int64)
        self.mean = self.sums / self.n

    def __call__(self, q: np.ndarray, trace: bool = False):
        """V q, and the trace of V where asked for."""
        mean, d = self.mean, self.d

        def product(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out, squares = np.zeros(q.shape), 0.0
            for x in _matrices(batches, d):
                c = x - mean
                out += c.T @ (c @ q)
                if trace:
                    squares += float((c * c).sum())
            return np.append(out, squares)

        self.n_passes += 1
        made = _cells(self.fit, product, "double")
        out = np.array([made[i] for i in range(q.size)]).reshape(q.shape) / self.n
        return (out, made[q.size] / self.n) if trace else out


def _lowest(v: _Passes, rng: np.random.Generator, steps: int) -> float:
    """A number at or below the spectrum's low end, but for chance, by Lanczos with full orthogonalisation."""
    basis, alpha, beta = [], [], []
    q = rng.standard_normal(v.d)
    q /= np.linalg.norm(q)
    for _ in range(min(steps, v.d)):
        basis.append(q)
        w = v(q[:, None])[:, 0]
        alpha.append(float(q @ w))
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        q = w / beta[-1]
    theta, s = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, float(theta[0] - abs(beta[-1] * s[-1, 0])))


def _rayleigh_ritz(v: _Passes, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), Ritz vectors and their products with V, of the span of q (orthonormal)."""
    vq = v(q)
    h = q.T @ vq
    theta, s = np.linalg.eigh((h + h.T) / 2)
    s = s[:, ::-1]
    return theta[::-1], q @ s, vq @ s


def _orthonormal(y: np.ndarray, locked: np.ndarray) -> np.ndarray:
    """An orthonormal basis of y's columns without their parts in ``locked``."""
    for _ in range(2):
        y = y - locked @ (locked.T @ y)
        y = np.linalg.qr(y / np.maximum(np.linalg.norm(y, axis=0), 1e-300))[0]
    return y


def leading(v: _Passes, want: int, block: int = BLOCK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues (falling) and their vectors as columns."""
    rng, d = np.random.default_rng(seed), v.d
    if d <= block:
        theta, q, _ = _rayleigh_ritz(v, np.eye(d))
        return theta[:want], q[:, :want]
    low = _lowest(v, rng, STEPS)
    locked, values, certain = np.zeros((d, 0)), np.zeros(0), False
    theta, q, vq = _rayleigh_ritz(v, _orthonormal(rng.standard_normal((d, block)), locked))
    for _ in range(ROUNDS):
        # one filter: degree m of the recurrence scaled to stay near one at the largest Ritz value
        high, floor = float(theta[-1]), min(low, float(theta[-1]))
        centre, half = (high + floor) / 2, max((high - floor) / 2, 1e-14 * theta[0], 1e-300)
        reach = max(1.0 + 1e-12, (theta[0] - centre) / half)
        degree = int(np.clip(np.log(2 * GROWTH) / np.arccosh(reach), 2, DEGREE))
        sigma = first = 1 / reach
        x, y = q, (vq - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            nxt = 1 / (2 / first - sigma)
            w = v(y)
            x, y = y, 2 * (nxt / half) * (w - locked @ (locked.T @ w) - centre * y) - sigma * nxt * x
            sigma = nxt
        theta, q, vq = _rayleigh_ritz(v, _orthonormal(y, locked))
        top = max(theta[0], values.max(initial=0.0))
        residual = np.linalg.norm(vq - locked @ (locked.T @ vq) - q * theta, axis=0)
        if certain and theta[0] <= values[want - 1]:
            break
        new = 0
        while new < q.shape[1] - 1 and len(values) + new < want and residual[new] <= EXACT * np.sqrt(d) * top:
            new += 1
        if new:
            locked, values = np.concatenate((locked, q[:, :new]), axis=1), np.append(values, theta[:new])
            theta, q, vq = theta[new:], q[:, new:], vq[:, new:]
        certain = False
        if len(values) == want:
            if theta[0] > values[-1]:  # it takes the place of the last, which is found again if need be
                values, locked = values[:-1], locked[:, :-1]
            else:
                certain = True
                theta, q, vq = _rayleigh_ritz(v, _orthonormal(rng.standard_normal((d, min(block, d - want))), locked))
    else:
        raise ArithmeticError(f"no certified components after {ROUNDS} rounds")
    return values, locked


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Fit:
    """The leading components of the covariance of the distinct vectors of ``vectors`` (column embedding)."""
    fit, d = fit_list(vectors)
    if not d:
        return Fit()
    v = _Passes(fit, d)
    q = leading(v, min(components, d), max(block, components + 2))[1]
    vq, trace = v(q, trace=True)
    h = q.T @ vq
    theta, s = np.linalg.eigh((h + h.T) / 2)
    q, vq, theta = q @ s[:, ::-1], vq @ s[:, ::-1], theta[::-1]
    made = Fit(d, v.n, v.sums, np.maximum(theta, 0.0), q, trace, float(np.abs(np.linalg.norm(vq - q * theta, axis=0)).max()), 0.0, v.n_passes)
    w = made.directions
    sound = w.any(axis=0)
    cover = w.T @ vq
    roots = np.sqrt(np.where(sound, made.values, 1.0))
    error = (cover / roots - np.eye(len(roots)))[np.ix_(sound, sound)]
    made.identity_error = float(np.abs(error).max(initial=0.0))
    return made


def _whitened(m: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, k = m.directions, len(m.values)
        sound = w.any(axis=0)
        share = m.values / m.trace if m.trace > 0 else np.zeros(k)
        whole = [int(x) for x in m.sums]
        most = max(map(abs, whole))
        for b in batches:
            for rows, x in _integers(b.column(1)):
                if x.shape[1] != m.d:
                    continue
                far = m.n * float(np.abs(x).max()) + most
                if far * far * m.d >= 2.0 ** 63:
                    raise OverflowError("a deviation is beyond 64-bit integers")
                c = m.n * x - m.sums
                made, times = (x - m.sums / m.n) @ w, len(rows)
                ids = b.column(0).take(pa.array(np.repeat(rows, k)))
                same = lambda value, kind: pa.array(np.full(times * k, value, kind))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), times)), same(m.n, np.int64),
                     pa.array(np.repeat((c * c).sum(axis=1), k)), pa.array(made.ravel(), mask=~np.tile(sound, times)),
                     pa.array(np.tile(share, times)), same(m.identity_error, np.float64)],
                    names=[x.split()[0] for x in _OUT.split(", ")])
    return run


def whiten(vectors: DataFrame, m: Fit) -> DataFrame:
    """A row for each sound row of ``vectors`` (vec_id, embedding) and component, see ``_OUT``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if not m.d:
        return rows.where("false").mapInArrow(lambda batches: iter(()), _OUT)
    return rows.mapInArrow(_whitened(m), _OUT)
