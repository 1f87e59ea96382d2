"""Embedding whitening from exact sums: entries in fixed point, cross-products from bit-sliced planes, eigenvectors of the covariance.

An entry c becomes the whole number x = floor(64 c) + 1000000. The distinct x vectors are the fit list. A task takes the list in
batches: each dimension is shifted by its least value there and cut into bit planes, which are packed across the batch's rows
into 64-bit words. The cross-product of two dimensions is the sum of 2^(a+b) times the set bits that plane a of the one and
plane b of the other share, so nothing is rounded. Shifts are undone, and tasks added up, in whole numbers of any size. With n,
the sums S and the products Q known, n Q - S S' is n squared times the covariance, exactly; only then comes floating point.

Eigenvectors come from eigh and STEPS refinement steps in extended precision. Components whose eigenvalue is below FLOOR of the
trace can't be told from none and are left out, so a table may have fewer components than dimensions; one distinct vector has
none, and no rows come out. Each component's entry of the largest size is positive.

Defined results: vectors that are null or hold a null, NaN or infinity take no part, nor do those of another length than most
(the longer at equal counts), empty ones, and those with an entry beyond 2^55, whose x would not fit. Repeated vectors count
once in the fit and come out each, with a null id too. A deviation beyond a long is null. Other columns are not read. Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows whose planes are packed together.
ROWS = 8192
#: Share of the trace below which an eigenvalue counts as none.
FLOOR = 1e-15
#: Bits of a limb; sums travel as four.
LIMB = 48
#: Refinement steps of eigenvectors; each squares their error.
STEPS = 5


def fixed_point(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and x (array<long>) of the vectors that take part."""
    v = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    v = v.filter(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < 2.0**55)))
    most = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.filter(F.size("v") == (most["n"] if most else 0)).select("id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def cross_products(x: np.ndarray) -> np.ndarray:
    """The sums over rows of x_i x_j for whole numbers without a sign, (rows, d) to (d, d) of Python ints, from bit planes."""
    rows, d = x.shape
    width = [max(1, int(m).bit_length()) for m in x.max(0)]
    words = -(-rows // 64)
    dim = np.repeat(np.arange(d), width)
    bit = np.concatenate([np.arange(w) for w in width])
    planes = np.zeros((len(dim), words * 8), np.uint8)
    for p, (i, a) in enumerate(zip(dim, bit)):
        packed = np.packbits((x[:, i] >> np.uint64(a)).astype(np.uint8) & 1)
        planes[p, : len(packed)] = packed
    planes, head = planes.view(np.uint64), np.r_[0, np.cumsum(width)]
    # a weighted count fits a word when bits and rows do
    kind = np.int64 if 2 * max(width) + rows.bit_length() + 1 < 63 else object
    weight = (np.int64(1) << bit) if kind is np.int64 else np.array([1 << int(b) for b in bit], object)
    out = np.zeros((d, d), object)
    for p, (i, a) in enumerate(zip(dim, bit)):
        shared = np.bitwise_count(planes[p] & planes[head[i] :]).sum(1, dtype=np.int64).astype(kind)
        out[i, i:] += np.add.reduceat(shared * weight[head[i] :] * (kind(1 << int(a)) if kind is np.int64 else 1 << int(a)), head[i:-1] - head[i]).astype(object)
    return np.triu(out) + np.triu(out, 1).T


def partial_sums(batches: Iterator[np.ndarray], d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and cross-products of whole numbers (rows, d) of any sign, exactly."""
    n, s, q = 0, np.zeros(d, object), np.zeros((d, d), object)
    for all_rows in batches:
        for at in range(0, len(all_rows), ROWS):
            x = all_rows[at : at + ROWS]
            low = x.min(0)
            y = (x - low).astype(np.uint64)
            low, m = low.astype(object), len(x)
            # words are added in two halves, so that no sum wraps
            t = (y >> np.uint64(32)).sum(0).astype(object) * (1 << 32) + (y & np.uint64(0xFFFFFFFF)).sum(0).astype(object)
            n, s = n + m, s + t + m * low
            q = q + cross_products(y) + np.outer(low, t) + np.outer(t, low) + m * np.outer(low, low)
    return n, s, q


def _limbs(x: int) -> list[int]:
    mask = (1 << LIMB) - 1
    return [x & mask, x >> LIMB & mask, x >> 2 * LIMB & mask, x >> 3 * LIMB]


def sums(fit_list: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and cross-products of a column x of equally long array<long>; what the driver gets depends on their length alone."""
    on_workers(fit_list.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        d = len(first.column("x")[0])
        matrix = lambda b: b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

        def every() -> Iterator[np.ndarray]:
            yield matrix(first)
            yield from (matrix(b) for b in batches if b.num_rows)

        n, s, q = partial_sums(every(), d)
        i, j = np.triu_indices(d)
        values = [n, *s.tolist(), *q[i, j].tolist()]
        limbs = np.array([_limbs(v) for v in values], np.int64)
        i, j = np.r_[-1, np.arange(d), i], np.r_[-1, np.full(d, -1), j]
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32())} | {f"l{k}": pa.array(limbs[:, k]) for k in range(4)})

    parts = fit_list.select("x").mapInArrow(run, "i int, j int, l0 long, l1 long, l2 long, l3 long")
    got = parts.groupBy("i", "j").agg(*[F.sum(F.col(f"l{k}").cast("decimal(20,0)")).alias(f"l{k}") for k in range(4)]).toArrow().to_pydict()
    value = {(i, j): sum(int(x) << LIMB * k for k, x in enumerate(limbs)) for i, j, *limbs in zip(got["i"], got["j"], *(got[f"l{k}"] for k in range(4)))}
    d = sum(1 for i, j in value if j == -1) - 1 if value else 0
    q = np.zeros((d, d), object)
    for (i, j), v in value.items():
        if j >= 0:
            q[i, j] = q[j, i] = v
    return value.get((-1, -1), 0), np.array([value[i, -1] for i in range(d)], object), q


def _extended(x: int, over: int) -> np.longdouble:
    """A quotient of whole numbers in extended precision."""
    shift = max(0, 80 + over.bit_length() - abs(x).bit_length())
    top = (abs(x) << shift) // over
    high = float(top)
    return (np.longdouble(high) + np.longdouble(float(top - int(high)))) * np.longdouble(2) ** -shift * (1 if x >= 0 else -1)


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as columns: eigh, then refinement by what is left of orthogonality and of the diagonal; last, orthogonality alone."""
    x = np.linalg.eigh(v.astype(np.float64))[1][:, ::-1].astype(np.longdouble)
    for _ in range(STEPS):
        r, s = np.eye(len(v)) - x.T @ x, x.T @ v @ x
        e = np.diag(s) / (1 - np.diag(r))
        apart = e[None, :] - e[:, None]
        close = np.abs(apart) <= 2 * (np.abs(s - np.diag(e)).max() + np.abs(v).max() * np.abs(r).max())
        x = x + x @ np.where(close, r / 2, (s + e[None, :] * r) / np.where(close, 1, apart))
    for _ in range(2):
        x = x @ (3 * np.eye(len(v)) - x.T @ x) / 2
    e = (x * (v @ x)).sum(0)
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order]


@dataclass
class Whitening:
    """A fit: rows n, sums, components as columns, their eigenvalues, the trace, and how far whitened covariances are from the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float


def solve(n: int, s: np.ndarray, q: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """The components of exact sums."""
    d = len(s)
    centred = n * q - np.outer(s, s)
    v = np.array([[_extended(int(c), n * n) for c in row] for row in centred], np.longdouble).reshape(d, d)
    trace = v.trace() if d else np.longdouble(0)
    if not trace > 0:
        return Whitening(n, s, np.zeros((d, 0)), np.zeros(0), float(trace), 0.0)
    e, x = eigen(v / trace)
    keep = int((e[:components] > FLOOR).sum())
    e, x = e[:keep], x[:, :keep]
    x = x * np.sign(x[np.abs(x).argmax(0), np.arange(keep)])
    # of the vectors as they are handed out, in double precision
    e, x = e.astype(np.float64), x.astype(np.float64)
    w = x / np.sqrt(e)
    return Whitening(n, s, x, e * float(trace), float(trace), float(np.abs(w.T.astype(np.longdouble) @ (v / trace) @ w - np.eye(keep)).max()))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The fit of a column x: distinct vectors, copies dropped before they are shuffled."""
    return solve(*sums(vectors.select("x").distinct()), components)


def transform(vectors: DataFrame, w: Whitening) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of every row (id, x) and component."""
    on_workers(vectors.sparkSession)
    d, k, n = len(w.sums), len(w.values), w.n
    key = vectors.schema["id"].dataType.simpleString()
    turned, explained, error, total = w.components / np.sqrt(w.values), w.values / (w.trace or 1), w.error, w.sums
    most = max((abs(int(x)) for x in total), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not k:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            # whole numbers of any size where words could wrap
            if int(np.abs(x).max()) * n + most >= 1 << 62:
                x = x.astype(object)
            away = n * x - (total if x.dtype == object else total.astype(np.int64))
            if x.dtype != object and int(np.abs(away).max()) ** 2 * d < 1 << 63:
                deviation = (away**2).sum(1).tolist()
            else:
                deviation = [y if (y := sum(int(c) ** 2 for c in row)) < 1 << 63 else None for row in away]
            # rounded once: the quotient of whole numbers
            mean_free = (away / n).astype(np.float64)
            whitened = mean_free @ turned
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(whitened.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, f"id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fits a table's vectors and transforms each of them."""
    x = fixed_point(vectors, key, column)
    return transform(x, fit(x, components)).withColumnRenamed("id", key)
