"""Embedding whitening by TSQR: exact sums centre the rows, QR factors merge in a tree, the last one's SVD whitens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import written
from spanforge.llm.vectors import usable

#: Fixed values of the grid that entries are put on.
SCALE, SHIFT = 64, 1_000_000
#: Entries are held within this, so that the shift and differences stay within the long's limits.
MOST = 1 << 61
LONG = 2**63 - 1
#: Factors merged at a time; rows at a time; bytes of models that one pass carries to its tasks.
FAN, ROWS, MODEL_BYTES = 8, 4096, 32 << 20


def on_grid(vector: Column) -> Column:
    """Each entry as floor(64 * entry) + 1000000."""
    held = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(MOST))), F.lit(float(MOST)))
    return F.transform(vector, lambda c: F.floor(held(c)).cast("long") + F.lit(SHIFT).cast("long"))


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of longs) for the vectors of each length, at most ``ROWS`` at a time."""
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        sizes, values = part.value_lengths().to_numpy(), part.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            yield own + at, values[starts[own][:, None] + np.arange(d)]


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: as longs, or as whole numbers of any size where these could overflow."""
    if not x.size or (int(np.abs(x).max()) + 1) * n + max(abs(int(s)) for s in sums) < LONG:
        return x * n - np.array([int(s) for s in sums], "i8")
    return x.astype(object) * n - sums


def _squares(d: np.ndarray) -> np.ndarray:
    """The rows' sums of squares, exactly; beyond the long's limit that limit."""
    if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] > LONG:
        d = d.astype(object)
    s = (d * d).sum(axis=1) if d.size else np.zeros(len(d), "i8")
    return np.array([min(int(v), LONG) for v in s], "i8")


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype("f8")


@dataclass(frozen=True)
class Model:
    """What whitens the vectors of one length: n rows with their sums; components as columns (unit eigenvectors of the
    covariance), their eigenvalues, and the covariance's trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @classmethod
    def of(cls, n: int, sums: np.ndarray, r: np.ndarray, k: int) -> Model:
        """From the last R factor of the centred rows. A component without variance (to double precision) is left out.
        Signs: the entry of the largest size is positive."""
        _, s, vt = np.linalg.svd(r, full_matrices=False)
        kept = s[:k] > max(n, r.shape[1]) * np.finfo("f8").eps * s.max(initial=0)
        v = vt[:k][kept].T
        if v.size:
            v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        return cls(n, sums, v, s[:k][kept] ** 2 / n, float((s**2).sum() / n))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.components / np.sqrt(self.eigenvalues)


Models = dict[int, Model]
Merge = Callable[[list[np.ndarray]], np.ndarray]


def merge_factors(rs: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(rs), mode="r")


def merge_moments(parts: list[np.ndarray]) -> np.ndarray:
    """Of (k + 1) x (k + 1) blocks with a count, means and sums of products about the means: that of all rows together."""
    out = parts[0].copy()
    for p in parts[1:]:
        n, m = out[0, 0], p[0, 0]
        if not m:
            continue
        off = p[0, 1:] - out[0, 1:]
        out[1:, 1:] += p[1:, 1:] + np.outer(off, off) * (n * m / (n + m))
        out[0, 1:] += off * (m / (n + m))
        out[0, 0] = n + m
    return out


def moments(w: np.ndarray) -> np.ndarray:
    k = w.shape[1]
    out = np.zeros((k + 1, k + 1))
    mean = w.mean(axis=0)
    out[0, 0], out[0, 1:] = len(w), mean
    out[1:, 1:] = (w - mean).T @ (w - mean)
    return out


_PARTS = "d int, part long, width int, m array<double>"


def _local(batches: Iterator[pa.RecordBatch], piece: Callable[[int, np.ndarray], np.ndarray], merge: Merge) -> Iterator[pa.RecordBatch]:
    """One matrix for each length that the partition has, merged as rows stream by."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in _blocks(batch.column(0)):
            d = x.shape[1]
            new = piece(d, x)
            held[d] = merge([held[d], new]) if d in held else merge([new])
    part = TaskContext.get().partitionId()
    for d, m in held.items():
        yield _part(d, part, m)


def _part(d: int, part: int, m: np.ndarray) -> pa.RecordBatch:
    rows = [pa.array([d], pa.int32()), pa.array([part], pa.int64()), pa.array([m.shape[1]], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(rows, ["d", "part", "width", "m"])


def _merged(table: pa.Table, merge: Merge) -> pa.Table:
    found = [np.asarray(m.values).reshape(-1, w.as_py()) for m, w in zip(table.column("m").combine_chunks(), table.column("width"), strict=True)]
    return pa.Table.from_batches([_part(table.column("d")[0].as_py(), table.column("part")[0].as_py() // FAN, merge(found))])


def in_tree(parts: DataFrame, merge: Merge, name: str) -> dict[int, np.ndarray]:
    """The parts of each length merged, ``FAN`` at a time, until one is left. A task holds ``FAN`` matrices, and the driver
    gets one for each length."""
    parts = written(parts, name)
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = written(parts.groupBy("d", F.expr(f"part div {FAN}").alias("_g")).applyInArrow(lambda _, t: _merged(t, merge), _PARTS), name)
    return {r.d: np.array(r.m).reshape(-1, r.width) for r in parts.toLocalIterator()}


def fit_models(vectors: DataFrame, k: int = 16) -> Models:
    """``vectors(x array<long>, d int)``, each distinct -> a model for each length.

    Sums are exact and combine before the shuffle; rows are centred by them as whole numbers. Each partition's
    rows go through QR block by block, and only R factors (length x length) leave it.
    """
    at = vectors.select("d", F.posexplode("x").alias("p", "v")).groupBy("d", "p").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(28,0)")).alias("s"))
    given: dict[int, tuple[int, list[int]]] = {}
    for r in at.orderBy("d", "p").toLocalIterator():
        given.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    sums = {d: (n, np.array(s, object)) for d, (n, s) in given.items()}
    held = vectors.sparkSession.sparkContext.broadcast(sums)
    factor = lambda d, x: _centred(x, *held.value[d])
    factors = in_tree(vectors.select("x").mapInArrow(lambda it: _local(it, factor, merge_factors), _PARTS), merge_factors, "whitening-factors")
    return {d: Model.of(*sums[d], r, k) for d, r in factors.items()}


def identity_errors(vectors: DataFrame, models: Models) -> dict[int, float]:
    """For each length the largest absolute entry of the whitened rows' covariance minus the identity."""
    held = vectors.sparkSession.sparkContext.broadcast(models)
    piece = lambda d, x: moments(held.value[d].whiten(x))
    whole = in_tree(vectors.select("x").mapInArrow(lambda it: _local(it, piece, merge_moments), _PARTS), merge_moments, "whitening-moments")
    return {d: float(np.abs(m[1:, 1:] / m[0, 0] - np.eye(len(m) - 1)).max(initial=0)) for d, m in whole.items()}


_OUT = [("vec_id", "long", pa.int64()), ("component", "int", pa.int32()), ("n", "long", pa.int64()), ("deviation", "long", pa.int64()), ("whitened", "double", pa.float64()), ("explained", "double", pa.float64()), ("identity_error", "double", pa.float64())]


def _whitened(batches: Iterator[pa.RecordBatch], models: Models, errors: dict[int, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for places, x in _blocks(batch.column(1)):
            m = models[x.shape[1]]
            w, rows, k = m.whiten(x), len(x), len(m.eigenvalues)
            dev = _squares(_deviations(x, m.n, m.sums))
            cols = [
                ids.take(pa.array(np.repeat(places, k))),
                np.tile(np.arange(1, k + 1), rows),
                np.full(rows * k, m.n),
                np.repeat(dev, k),
                w.ravel(),
                np.tile(m.eigenvalues / m.trace if k else np.zeros(0), rows),
                np.full(rows * k, errors[x.shape[1]]),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, _, t) in zip(cols, _OUT, strict=True)], [n for n, _, _ in _OUT])


def lots_of(lengths: list[int], k: int, most: int = MODEL_BYTES) -> list[list[int]]:
    """The lengths in lots whose models stay within ``most`` bytes together; a length beyond that is by itself."""
    lots: list[list[int]] = []
    size = 0
    for d in sorted(lengths):
        own = d * (k + 2) * 8 + 256
        if not lots or size + own > most:
            lots.append([])
            size = 0
        lots[-1].append(d)
        size += own
    return lots


def whitened_rows(rows: DataFrame, k: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): up to ``k`` rows for each usable vector.

    Entries go on a grid, x = floor(64 * entry) + 1000000. The fit list is each distinct x once: n of them with sums S.
    Components are unit eigenvectors of its covariance (divisor n), by falling eigenvalue e; ``deviation`` is the exact
    sum of (n*x - S)^2 and stops at the long's limit, ``whitened`` the component's part of x - S/n over sqrt(e), ``explained``
    e over the trace, ``identity_error`` how far the whitened fit list's covariance is from the identity at most.

    Vectors that are null or hold null or non-finite entries have no rows, and neither have components without
    variance, so one vector alone, or vectors without entries, give none. Vectors of each length have a fit of
    their own. Entries beyond 2^61 in size count as that on the grid. Repeated rows each get their rows; null ids
    stay null; extra columns play no part; an empty table gives no rows.
    """
    spark = rows.sparkSession
    placed = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).where(usable(F.col("v"))).select("vec_id", on_grid(F.col("v")).alias("x"))
    vectors = written(placed.select("x").distinct().select("x", F.size("x").alias("d")), "whitening-vectors")
    spec = ", ".join(f"{n} {t}" for n, t, _ in _OUT)
    out = None
    for lot in lots_of([r.d for r in vectors.where("d > 0").select("d").distinct().toLocalIterator()], k):
        own = vectors.where(F.col("d").isin(lot))
        models = fit_models(own, k)
        held = spark.sparkContext.broadcast((models, identity_errors(own, models)))
        part = placed.where(F.size("x").isin(lot)).mapInArrow(lambda it, held=held: _whitened(it, *held.value), spec)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], spec) if out is None else out
