"""Whitening of embeddings with a compensated covariance.

Entries become integers x = floor(64 * c) + 1,000,000. Their sums S are exact, so a vector's centred value y = n * x - S is an
exact integer too, and centring costs no accuracy. Products of centred values are summed in double-double: values are cut into
slices of few bits, so that the product of two slices, summed over a block of rows by one matrix product, has no rounding
error (an error-free transformation); what blocks give is added by two-sums to high and low parts. High and low parts of all
tasks are merged by matrix row in a tree. The covariance matrix, whose size depends on the dimension alone, is decomposed on
the driver by reduction to tridiagonal form and divide and conquer (LAPACK's syevd).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import Workspace

# Fixed values of the integer entries.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this magnitude count as it.
MOST = 1 << 53
#: Rows of a block; bits of a slice (two slices' products, summed over a block, have 52 bits); slices of a value.
ROWS, BITS, SLICES = 1024, 21, 5
#: Vector entries that a task works on at a time.
ENTRIES = 1 << 20
#: Partial matrices merged at a time.
FAN_IN = 64
#: Components given at most.
COMPONENTS = 32

DD = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> DD:
    """a + b and its rounding error."""
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def dd_add(x: DD, y: DD) -> DD:
    """The sum of two double-doubles."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(high: np.ndarray, low: np.ndarray, unit: np.ndarray) -> list[np.ndarray]:
    """Values high + low below unit (powers of two, for each column) as a sum of slices of BITS bits, largest first."""
    out, rest, tail = [], high, low
    for _ in range(SLICES):
        unit = unit / (1 << BITS)
        cut = np.rint(rest / unit) * unit  # exact: unit is a power of two
        out.append(cut)
        rest, tail = two_sum(rest - cut, tail)
    return out


def outer_sum(high: np.ndarray, low: np.ndarray) -> DD:
    """The sum over rows of the outer products of high + low with themselves, as a double-double."""
    dim = high.shape[1]
    total = (np.zeros((dim, dim)), np.zeros((dim, dim)))
    for at in range(0, len(high), ROWS):
        h, lo = high[at : at + ROWS], low[at : at + ROWS]
        top = np.abs(h).max(axis=0)
        unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1))) + 1)
        cut = slices(h, lo, unit)
        for i in range(SLICES):
            for j in range(i, SLICES - i):  # products of lower slices are below the low part's last bit
                p = cut[i].T @ cut[j]
                total = dd_add(total, (p, np.zeros_like(p)) if i == j else two_sum(p, p.T))
    return total


def pieces(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most ROWS rows and, on average, ENTRIES vector entries."""
    entries = len(batch.column(column).flatten())
    step = max(1, min(ROWS, ENTRIES * batch.num_rows // max(1, entries)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x) for each length of vector in a column: x are integer entries of those without null or non-finite ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if not len(there):
        return
    kept = column.take(pa.array(there))
    sizes = np.diff(kept.offsets.to_numpy())
    flat = kept.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        c = flat[starts[rows][:, None] + np.arange(n)]
        fine = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(SCALE * c[fine]) + SHIFT, -MOST, MOST).astype(np.int64)
        if fine.any():
            yield n, there[rows[fine]], x


def _sum_rows(x: np.ndarray) -> list[int]:
    """Sums of columns as Python integers; parts of 32 bits can't overflow."""
    low, high = x & 0xFFFFFFFF, x >> 32
    return [int(h) * (1 << 32) + int(lo) for h, lo in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def _sums(df: DataFrame, vector: str) -> dict[int, tuple[int, list[int]]]:
    """{length: (n, sums)}: each partition gives a row for each length, and these are added up a decimal a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for dim, _, x in (v for part in pieces(batch) for v in vectors(part.column(0))):
                n, s = held.get(dim, (0, [0] * dim))
                held[dim] = n + len(x), [a + b for a, b in zip(s, _sum_rows(x), strict=True)]
        rows = [(d, i, n, str(v)) for d, (n, s) in held.items() for i, v in enumerate(s)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["dim", "i", "n", "s"])

    each = df.select(vector).mapInArrow(run, "dim int, i int, n long, s string")
    got = each.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in got:
        out.setdefault(r["dim"], (r["n"], [0] * r["dim"]))[1][r["i"]] = int(r["s"])
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, DD]:
    """y = n * x - S, exactly (integers of 64 bits, or Python's where those don't hold them), and as a double-double."""
    most = n * int(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        high = y.astype(np.float64)
        return y, (high, (y - high.astype(np.int64)).astype(np.float64))
    y = n * x.astype(object) - np.array(sums, object)
    high = y.astype(np.float64)
    low = np.vectorize(lambda a, b: float(a - int(b)), otypes=[np.float64])(y, high) if y.size else high
    return y, (high, low)


_PART = "dim int, i int, part long, high array<double>, low array<double>"


def _merge_parts(parts: DataFrame, n_parts: int) -> dict[int, DD]:
    """{length of vector: matrix}: rows (dim, i, part, high, low) merged by matrix row, FAN_IN partial matrices at a time."""

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        total = None
        for high, low in zip(g["high"], g["low"], strict=True):
            one = np.asarray(high, float), np.asarray(low, float)
            total = one if total is None else dd_add(total, one)
        return pd.DataFrame({"dim": [g["dim"].iloc[0]], "i": [g["i"].iloc[0]], "part": [g["group"].iloc[0]], "high": [total[0]], "low": [total[1]]})

    while n_parts > 1:
        parts = parts.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("dim", "i", "group").applyInPandas(merge, _PART)
        n_parts = -(-n_parts // FAN_IN)
    out: dict[int, DD] = {}
    for r in parts.collect():
        k = len(r["high"])
        high, low = out.setdefault(r["dim"], (np.zeros((k, k)), np.zeros((k, k))))
        high[r["i"]], low[r["i"]] = r["high"], r["low"]
    return out


def _outer_sums(df: DataFrame, vector: str, values, ws: Workspace, name: str) -> dict[int, DD]:
    """{length: sum of outer products} of what values(dim, x) makes of vectors: a double-double of rows, or None for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, DD] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for dim, _, x in (v for piece in pieces(batch) for v in vectors(piece.column(0))):
                made = values(dim, x)
                if made is not None:
                    p = outer_sum(*made)
                    held[dim], size[dim] = dd_add(held[dim], p) if dim in held else p, len(p[0])
        part = TaskContext.get().partitionId()
        for dim, (high, low) in held.items():
            k = size[dim]
            list_of = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, k, dtype=np.int32), m.ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, dim, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, part, np.int64)), list_of(high), list_of(low)],
                ["dim", "i", "part", "high", "low"],
            )

    parts = ws.write(df.select(vector).mapInArrow(run, _PART), name)
    n_parts = parts.agg(F.max("part")).first()[0]
    return {} if n_parts is None else _merge_parts(parts, n_parts + 1)


class Fit(NamedTuple):
    """What the vectors of one length give: how many, their sums, components in columns with their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, high: np.ndarray) -> np.ndarray:
        """Centred values (n * x - S) projected on components, over the root of the eigenvalue; NaN where that is nothing."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = ((high / self.n) @ self.components) / np.sqrt(self.values)
        out[:, self.values <= 0] = np.nan
        return out


def decompose(n: int, sums: list[int], outer: DD, components: int = COMPONENTS) -> Fit:
    """The covariance's largest eigenvalues, falling, with unit eigenvectors. Eigenvalues that rounding can't tell from nothing
    are nothing."""
    v = (outer[0] + outer[1]) / float(n) ** 3  # of values n times too large, over n
    v = (v + v.T) / 2
    values, vecs = np.linalg.eigh(v)  # syevd: tridiagonal form, then divide and conquer
    values, vecs = values[::-1][:components].copy(), vecs[:, ::-1][:, :components]
    values[values <= len(v) * np.finfo(float).eps * max(values.max(initial=0), 0)] = 0
    return Fit(n, sums, np.ascontiguousarray(vecs), values, float(np.trace(v)))


def whiten(df: DataFrame, vector: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector of df that has only finite entries, and each of its first `components` components.

    Columns: `keep` (all but the vector by default), __component (from 1, by falling eigenvalue), __n (vectors that the fit
    rests on), __deviation (squared distance of n * x from S, exact; null where a long doesn't hold it), __whitened,
    __explained (share of the trace) and __identity_error (largest absolute entry of the whitened values' own covariance minus
    the identity). Vectors that are null or hold null or non-finite entries are left out; so are empty ones, which have no
    component. Vectors of every length are fitted by themselves. Rows that repeat count as often as they come. A component
    without variance (fewer vectors than dimensions, constant entries) has __whitened null and counts for no __identity_error;
    where nothing varies, __explained and __identity_error are null. Entries whose integer would exceed 2^53 count as that. An
    empty table gives an empty one. Columns of df that have the names of outputs are replaced.

    Four passes over the vectors: sums, covariance, covariance of the whitened values, output. The driver holds matrices of
    the dimension only.
    """
    made = ["__component", "__n", "__deviation", "__whitened", "__explained", "__identity_error"]
    keep = [c for c in (df.columns if keep is None else keep) if c != vector and c not in made]
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "whiten")
    sums = _sums(df, vector)
    sent_sums = spark.sparkContext.broadcast(sums)
    outer = _outer_sums(df, vector, lambda dim, x: centred(x, *sent_sums.value[dim])[1], ws, "outer")
    fits = {d: decompose(*sums[d], outer[d], components) for d in outer}
    sent = spark.sparkContext.broadcast(pickle.dumps(fits, 5))

    def whitened(dim: int, x: np.ndarray) -> DD | None:
        fit = pickle.loads(sent.value)[dim]
        some = fit.values > 0
        if not some.any():
            return None
        w = fit.whiten(centred(x, fit.n, fit.sums)[1][0])[:, some]
        return w, np.zeros_like(w)

    # the mean of whitened values is below the rounding of their own sum, as centred values sum to exactly nothing
    again = _outer_sums(df, vector, whitened, ws, "whitened")
    errors = {d: float(np.abs((h + lo) / sums[d][0] - np.eye(len(h))).max()) for d, (h, lo) in again.items()}
    narrow = df.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.col(vector).alias("v"))
    types = [f"k_{i} {narrow.schema[f'k_{i}'].dataType.simpleString()}" for i in range(len(keep))]
    schema = ", ".join([*types, "c int, n long, deviation long, w double, e double, err double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(sent.value)
        for batch in batches:
            for part in pieces(batch, len(keep)):
                for dim, rows, x in vectors(part.column(len(keep))):
                    yield give(known[dim], errors.get(dim), part, rows, x)

    def give(fit: Fit, error: float | None, part: pa.RecordBatch, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        y, (high, _) = centred(x, fit.n, fit.sums)
        k, many = len(fit.values), len(rows)
        if y.dtype == object or float((high * high).sum(axis=1).max()) >= 2.0**62:
            exact = [sum(int(a) ** 2 for a in row) for row in y]
            deviation = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
        else:
            deviation = pa.array((y * y).sum(axis=1))
        w = fit.whiten(high).ravel()
        each = pa.array(np.repeat(np.arange(many), k))
        share = fit.values / fit.trace if fit.trace > 0 else np.full(k, np.nan)
        arrays = [part.column(i).take(pa.array(rows)).take(each) for i in range(len(keep))]
        arrays += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, fit.n, np.int64)), deviation.take(each)]
        arrays += [pa.array(w, mask=np.isnan(w)), pa.array(np.tile(share, many), mask=np.isnan(np.tile(share, many)))]
        arrays += [pa.array([error] * (many * k), pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, [*(f"k_{i}" for i in range(len(keep))), "c", "n", "deviation", "w", "e", "err"])

    out = narrow.mapInArrow(run, schema)
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], *[F.col(a).alias(b) for a, b in zip(("c", "n", "deviation", "w", "e", "err"), made, strict=True)])
