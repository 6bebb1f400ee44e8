"""Embedding whitening: leading components of the centred covariance, and every vector's whitened coordinates on them.

Vectors are fixed-point: each entry c is the long floor(256 c).  The model is fitted on the distinct vectors.  One pass
counts and sums them (exact integers); the next centres them and adds up outer products, a matrix per task, its rows
summed by a shuffle.  That d x d matrix, whose size depends on the dimension only, is reduced on the driver to
tridiagonal form by Householder reflections; bisection on Sturm counts gives the leading eigenvalues of its unreduced blocks to the last bit,
inverse iteration their vectors, made orthogonal within clusters of near eigenvalues, and the reflections carry them
back.  Mean and components (5 d numbers) are broadcast, and every vector is projected where it lies.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those
whose length is not the most frequent one (ties: the smallest).  Entries beyond the range of a long stop at its ends.
A component without variance (as with one distinct vector, or copies only) has null coordinates and no part in
``identity_error``; ``explained`` is null if nothing varies.  A ``deviation`` beyond a long is null.  Null, repeated or
tied ids are rows like others; other columns are ignored; an empty table gives no rows.

Scale: one shuffle, of distinct vectors, packed in 2 bytes an entry where they fit (a repeated vector is dropped in its
map task), and one of d numbers per row of a task's matrix.  Vectors are read twice.  A task holds one Arrow
batch and one matrix.
"""
from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
LONG = 1 << 63


def fixed_point(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable vectors of length ``dim``, their entries as longs)."""
    column = column.cast(pa.large_list(pa.float64()))
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dim)
    flat = pc.list_flatten(column.take(pa.array(rows)))
    c = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(c).all(axis=1)
    with np.errstate(over="ignore"):
        f = np.floor(256.0 * c[good])
    top = f >= float(LONG)
    x = np.where(top, 0, np.maximum(f, -float(LONG))).astype(np.int64)
    x[top] = LONG - 1
    return rows[good], x


def pack(x: np.ndarray) -> list[bytes]:
    """Every row of ``x`` in the narrowest of ``WIDTHS``, that number in front: equal rows give equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    width = sum(((low < np.iinfo(w).min) | (high > np.iinfo(w).max)).astype(int) for w in WIDTHS[:2])
    return [bytes([w]) + row.astype(WIDTHS[w]).tobytes() for w, row in zip(width.tolist(), x)]


def unpack(packed: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(b, WIDTHS[b[0]], offset=1) for b in packed.to_pylist()]).astype(np.int64)


def exact_sum(x: np.ndarray) -> list[int]:
    """Sums of the columns of ``x``, exact whatever their size."""
    if len(x) * max(abs(float(x.min())), abs(float(x.max()))) < 2.0 ** 62:
        return x.sum(axis=0).tolist()
    return [sum(c) for c in x.T.tolist()]


def dimension(vectors: DataFrame, column: str) -> int:
    """The most frequent length of vectors, 0 if there are none."""
    n = F.size(column)
    found = vectors.where(n > 0).groupBy(n.alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return found[0]["d"] if found else 0


def fit_list(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """Every distinct usable vector once (x: packed longs)."""

    def run(batches):
        for batch in batches:
            _, x = fixed_point(batch.column(0), dim)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(sorted(set(pack(x))), pa.binary())], names=["x"])

    return vectors.select(column).mapInArrow(run, "x binary").distinct()


def count_and_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of every dimension."""

    def run(batches):
        n, s = 0, [0] * dim
        for batch in batches:
            if batch.num_rows:
                x = unpack(batch.column(0))
                n += len(x)
                s = [a + b for a, b in zip(s, exact_sum(x))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(v) for v in (n, *s)], pa.decimal128(38, 0))],
                                         names=["i", "s"])

    total = {r["i"]: int(r["s"]) for r in fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return total.get(-1, 0), [total.get(i, 0) for i in range(dim)]


def means(n: int, s: list[int]) -> np.ndarray:
    return np.array([v / n for v in s])  # Python divides integers to the nearest double


def covariance(fit: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """Covariance of the fit list (divisor n), centred before multiplying."""
    dim, mean = len(s), means(n, s)

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                z = unpack(batch.column(0)) - mean
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.array(table.column("row").to_pylist())
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.float64()))})

    rows = fit.mapInArrow(run, "i int, row array<double>").groupBy("i").applyInArrow(add, "i int, row array<double>").collect()
    v = np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])]) / n
    return (v + v.T) / 2


# ------------------------------------------------------------------ leading eigenpairs of a symmetric matrix
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, subdiagonal, Householder vectors): the reflections I - 2 v v', applied from both sides, leave these."""
    a, reflections = a.copy(), []
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm and np.any(x[1:]):
            x[0] += norm if x[0] >= 0 else -norm
            v = x / np.linalg.norm(x)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        else:
            v = np.zeros(d - k - 1)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diag: np.ndarray, off: np.ndarray, x: float) -> int:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are less than ``x``."""
    least = np.finfo(float).tiny
    count, q = 0, 1.0
    for i in range(len(diag)):
        q = diag[i] - x - (off[i - 1] ** 2 / q if i else 0.0)
        if abs(q) < least:
            q = -least
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each halved in until no double lies between its bounds."""
    d = len(diag)
    around = np.zeros(d)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    low, high = float((diag - around).min()), float((diag + around).max())
    slack = np.finfo(float).eps * d * max(abs(low), abs(high), np.finfo(float).tiny)
    found = []
    for j in range(k):
        a, b = low - slack, high + slack
        while True:
            mid = a + (b - a) / 2
            if not a < mid < b:
                break
            if below(diag, off, mid) >= d - j:
                b = mid
            else:
                a = mid
        found.append(a + (b - a) / 2)
    return np.array(found)


def _solver(diag: np.ndarray, off: np.ndarray, shift: float, floor: float):
    """Solves (T - shift) y = b by elimination with row exchanges; pivots of nearly nothing count as ``floor``."""
    d = len(diag)
    u, up, up2 = diag - shift, np.r_[off, 0.0], np.zeros(d)
    factor, swapped = np.zeros(d), np.zeros(d, bool)
    for i in range(d - 1):
        low, nxt = off[i], u[i + 1]
        nxt_up = up[i + 1]
        if abs(low) > abs(u[i]):
            swapped[i] = True
            factor[i] = u[i] / low
            old_up = up[i]
            u[i], up[i], up2[i] = low, nxt, nxt_up
            u[i + 1], up[i + 1] = old_up - factor[i] * nxt, -factor[i] * nxt_up
        else:
            if abs(u[i]) < floor:
                u[i] = floor
            factor[i] = low / u[i]
            u[i + 1] = nxt - factor[i] * up[i]
    if abs(u[-1]) < floor:
        u[-1] = floor

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(d - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor[i] * y[i]
        for i in range(d - 1, -1, -1):
            t = y[i] - (up[i] * y[i + 1] if i + 1 < d else 0.0) - (up2[i] * y[i + 2] if i + 2 < d else 0.0)
            y[i] = t / u[i]
        return y

    return solve


def leading_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 6) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix for its ``values``, by inverse iteration.  Vectors of one
    cluster (values nearer than a thousandth of the matrix's norm) are made orthogonal to one another in every step."""
    d = len(diag)
    around = np.abs(diag)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    norm = max(float(around.max()), np.finfo(float).tiny)
    floor = np.finfo(float).eps * norm
    random = np.random.default_rng(12)
    out, cluster = np.zeros((d, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        solve, mates = _solver(diag, off, value, floor), out[:, cluster:j]
        y = random.standard_normal(d)
        for _ in range(steps):
            y = solve(y / np.abs(y).max())
            for _ in range(3):
                y /= np.linalg.norm(y)
                y -= mates @ (mates.T @ y)
            y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of the symmetric matrix ``v``."""
    k = min(k, len(v))
    largest = float(np.abs(v).max())
    if not largest:
        return np.zeros(k), np.eye(len(v), k)
    scale = 2.0 ** np.floor(np.log2(largest))  # a power of two: no rounding, and no square falls out of range
    diag, off, reflections = tridiagonal(v / scale)
    # where the subdiagonal is nothing but rounding, the matrix falls into blocks
    cuts = np.flatnonzero(np.abs(off) <= np.finfo(float).eps * max(np.abs(diag).max(), np.abs(off).max())) + 1 if len(off) else []
    blocks = [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(diag)])]
    inner = [(diag[b], off[b.start:b.stop - 1]) for b in blocks]
    found = sorted(((value, -i) for i, (d, o) in enumerate(inner) for value in leading_values(d, o, min(k, len(d)))), reverse=True)[:k]
    values, y = np.array([value for value, _ in found]), np.zeros((len(v), k))
    for i, (d, o) in enumerate(inner):
        mine = [j for j, (_, at) in enumerate(found) if at == -i]
        if mine:
            y[blocks[i], mine] = leading_vectors(d, o, values[mine]) if len(d) > 1 else 1.0
    for at in range(len(reflections) - 1, -1, -1):
        r = reflections[at]
        y[at + 1:] -= 2 * np.outer(r, r @ y[at + 1:])
    return values * scale, y / np.linalg.norm(y, axis=0)


# ------------------------------------------------------------------ model and projection
def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """Sum over dimensions of (n x - s)^2, exact."""
    worst = n * max(abs(float(x.min())), abs(float(x.max()))) + max(abs(v) for v in s)
    if worst ** 2 * x.shape[1] < 2.0 ** 62:
        return ((n * x - np.array(s, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x.tolist()]


def fit(vectors: DataFrame, column: str = "embedding", k: int = 4) -> dict | None:
    """The model: n, sums, values (variances of the components, falling), vectors, trace and identity_error; None
    without usable vectors."""
    dim = dimension(vectors, column)
    distinct = cut_lineage(fit_list(vectors, column, dim)) if dim else None
    n, s = count_and_sums(distinct, dim) if dim else (0, [])
    if not n:
        return None
    v = covariance(distinct, n, s)
    values, vectors_ = leading_pairs(v, k)
    trace = float(np.trace(v))
    alive = values > dim * np.finfo(float).eps * max(trace, np.finfo(float).tiny)
    model = {"n": n, "sums": s, "values": np.where(alive, values, 0.0), "vectors": vectors_, "trace": trace}
    return {**model, "identity_error": identity_error(distinct, model)}


def project(x: np.ndarray, model: dict) -> np.ndarray:
    """Whitened coordinates of the rows of ``x``; NaN on components without variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model["values"] > 0, (x - means(model["n"], model["sums"])) @ model["vectors"] / np.sqrt(model["values"]), np.nan)


def identity_error(distinct: DataFrame, model: dict) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    sent = distinct.sparkSession.sparkContext.broadcast(model)
    alive = np.flatnonzero(model["values"] > 0).tolist()
    if not alive:
        return None

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                w = project(unpack(batch.column(0)), sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in alive], names=[f"w{i}" for i in alive])

    w = distinct.mapInArrow(run, ", ".join(f"w{i} double" for i in alive))
    pairs = [(i, j) for i in alive for j in alive if i <= j]
    row = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


ROWS = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, id_column: str = "vec_id", column: str = "embedding", k: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component."""
    model = fit(vectors, column, k)
    schema = ROWS.format(id=vectors.schema[id_column].dataType.simpleString())
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        count = len(m["values"])
        explained = m["values"] / m["trace"] if m["trace"] > 0 else np.full(count, np.nan)
        for batch in batches:
            rows, x = fixed_point(batch.column(1), len(m["sums"]))
            if not len(rows):
                continue
            w = project(x, m).ravel()
            each = np.repeat(np.arange(len(rows)), count)
            deviation = [v if v < LONG else None for v in deviations(x, m["n"], m["sums"])]
            e = np.tile(explained, len(rows))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, count + 1), len(rows)), pa.int32()),
                pa.array(np.full(len(each), m["n"]), pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(each)),
                pa.array(w, mask=np.isnan(w)), pa.array(e, mask=np.isnan(e)), pa.array([m["identity_error"]] * len(each), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(id_column, column).mapInArrow(run, schema)
