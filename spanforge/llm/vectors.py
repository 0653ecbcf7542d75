"""Exact top-k inner-product search with multi-resolution segment statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.common import written

#: Sums of whole numbers below this are exact in doubles.
EXACT = 1 << 53
#: Pivots that order rows and queries into blocks of neighbours, at most; bytes of the sample that gives them and the first
#: bounds; blocks of queries, at most, whose ranges every task holds.
PIVOTS, SAMPLE_BYTES, QUERY_BLOCKS = 256, 8 << 20, 1 << 14


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row and segment the mean and the deviation, both times the square root of the segment's length.

    The inner product of two rows of these is the largest inner product that vectors of such means and
    deviations can have: a b = (|a|^2 + |b|^2 - d^2) / 2, and d^2 is at least the sum over the segments of
    length * ((mean_a - mean_b)^2 + (deviation_a - deviation_b)^2).
    """
    cuts = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    if not parts:
        return np.zeros((len(x), 2))
    root = np.sqrt([p.shape[1] for p in parts])
    return np.hstack([np.stack([p.mean(axis=1) for p in parts], 1) * root, np.stack([p.std(axis=1) for p in parts], 1) * root])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of ``q`` with rows of ``x``, held within the long's limits."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, len(q)) < EXACT:
        return (x @ q).astype("i8")
    exact = x.astype(object) @ np.array([int(v) for v in q], object) if len(q) else np.zeros(len(x), object)
    return np.array([int(min(max(int(s), -(2**63)), 2**63 - 1)) for s in exact], "i8")


def search_block(asks: np.ndarray, q: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, levels: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(query row, id, score) of the k best rows for each query, its own row aside; exact, but rows below the query's
    ``least`` score may be missing.

    asks, rows: row numbers. Coarse to fine, a row goes on while its bound reaches the k-th best exact score found so far.
    """
    out: list[tuple[int, int, int]] = []
    if not len(x) or not len(q):
        return out
    stats = [(segment_statistics(q, s), segment_statistics(x, s)) for s in levels]
    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1)) * (1 + np.linalg.norm(x, axis=1).max(initial=0))
    for at in range(0, len(q), 64):
        coarse = stats[0][0][at : at + 64] @ stats[0][1].T
        for i, bound in enumerate(coarse, start=at):
            bound = np.where(rows == asks[i], -np.inf, bound)
            seeds = np.argpartition(-bound, k)[: k + 1] if len(bound) > k + 1 else np.arange(len(bound))
            seeds = seeds[bound[seeds] > -np.inf]
            best = np.sort(_scores(q[i], x[seeds]))[::-1]
            floor = max(float(best[k - 1]) if len(best) >= k else -np.inf, float(least[i])) - slack[i]
            left = np.flatnonzero((bound >= floor) & (bound > -np.inf))
            for sq, sx in stats[1:]:
                left = left[sx[left] @ sq[i] >= floor]
            score = _scores(q[i], x[left])
            first = np.lexsort((ids[left], -score))[:k]
            out += [(int(asks[i]), int(ids[left[j]]), int(score[j])) for j in first]
    return out


@dataclass(frozen=True)
class Sample:
    """Rows of one length: their numbers, vectors, coarse statistics; the first ``pivots`` of them order all rows."""

    rows: np.ndarray
    x: np.ndarray
    stats: np.ndarray
    pivots: int

    def nearest(self, stats: np.ndarray) -> np.ndarray:
        own = self.stats[: self.pivots]
        return (np.square(own).sum(axis=1) - 2 * stats @ own.T).argmin(axis=1) if len(own) else np.zeros(len(stats), int)

    def least(self, row: int, v: np.ndarray, k: int) -> float:
        """The k-th best score of the sample's rows without the query's own: no lower one can be among its k best."""
        others = self.x[self.rows != row]
        return float(np.partition(_scores(v, others), -k)[-k]) if len(others) >= k else -np.inf


def _whole(column: pa.Array, d: int, scale: int) -> np.ndarray:
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, d)) if d else np.zeros((len(column), 0))


def _by_length(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        d = batch.column("d").to_numpy()
        for one in np.unique(d):
            part = batch.filter(pa.array(d == one))
            for at in range(0, part.num_rows, most):
                yield int(one), part.slice(at, most)


_NOTHING = Sample(np.zeros(0, "i8"), np.zeros((0, 0)), np.zeros((0, 0)), 0)


def _placed(batches: Iterator[pa.RecordBatch], samples: dict[int, Sample], coarse: int, scale: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, query, d, v) with their pivot; queries also with their coarse statistics and least score."""
    for d, part in _by_length(batches):
        sample, x = samples.get(d, _NOTHING), _whole(part.column("v"), d, scale)
        stats = segment_statistics(x, coarse)
        asks, rows = part.column("query").to_pylist(), part.column("row").to_pylist()
        least = [sample.least(r, v, k) if q else None for q, r, v in zip(asks, rows, x, strict=True)]
        kept = pa.array([s.tolist() if q else None for q, s in zip(asks, stats, strict=True)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sample.nearest(stats).astype("i4")), kept, pa.array(least, pa.float64())], [*part.schema.names, "pivot", "stats", "least"])


def _reached(batches: Iterator[pa.RecordBatch], ranges: dict[int, tuple], coarse: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows with ``reach``, the blocks of queries that they may have to meet.

    The largest product of a row's statistics with any that lie within a block's ranges is at least the largest
    product of the vectors; a row stays away from a block all of whose queries have k better ones.
    """
    for d, part in _by_length(batches):
        if d not in ranges:
            continue
        blocks, low, high, least = ranges[d]
        stats = segment_statistics(_whole(part.column("v"), d, scale), coarse)
        bound = np.maximum(stats, 0) @ high.T + np.minimum(stats, 0) @ low.T
        slack = 1e-9 * (1 + np.linalg.norm(stats, axis=1))[:, None] * (1 + np.maximum(np.linalg.norm(low, axis=1), np.linalg.norm(high, axis=1)))[None]
        near = bound + slack >= least[None]
        ends = np.r_[0, near.sum(axis=1).cumsum()].astype("i4")
        reach = pa.ListArray.from_arrays(pa.array(ends), pa.array(blocks[np.nonzero(near)[1]].astype("i8")))
        yield pa.RecordBatch.from_arrays([*part.columns, reach], [*part.schema.names, "reach"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, levels: tuple[int, ...] = (4, 16), data_block: int = 8192, query_block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k rows of the largest inner product of floor(scale * x).

    All fewer than k rows if there are no more; ties go to the smaller id. Vectors that are null or hold null
    or non-finite components, and rows with a null id, take no part. Vectors meet only those of their own
    length. A query row meets every row but itself: of rows that share an id each asks by itself, under that id,
    and each can be found, by the others too. Scores beyond the long's limits stay at the limit. Extra columns
    play no part; an empty table gives no rows.

    A bounded sample of rows gives each query a first bound, and pivots: rows and queries go into blocks of
    neighbours, each of bounded size, so none is hot. A block of queries is known to all tasks by the ranges of its
    coarse segment statistics and its lowest bound; a row is sent only to the blocks that its own coarse statistics
    reach, and a block only to where such rows are. There finer statistics and exact products decide.
    """
    rows = vectors.where(usable(F.col(f"`{vector_col}`"))).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.size(F.col(f"`{vector_col}`")).alias("d"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id is not null")
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "query", "d", "v"), "vectors")
    n, n_queries, widest = rows.agg(F.count("*"), F.count_if("query"), F.coalesce(F.max("d"), F.lit(1))).first()
    query_block = max(query_block, math.ceil(n_queries / QUERY_BLOCKS))
    some = rows.orderBy(F.xxhash64("row"), "row").limit(max(1, min(data_block, SAMPLE_BYTES // (8 * max(1, widest))))).select("row", "d", "v").toArrow()
    coarse, pivots = levels[0], min(PIVOTS, math.ceil(n / data_block))
    samples = {}
    for d in set(some.column("d").to_pylist()):
        own = some.filter(pa.array(some.column("d").to_numpy() == d))
        x = _whole(own.column("v").combine_chunks(), d, scale)
        samples[d] = Sample(own.column("row").to_numpy(), x, segment_statistics(x, coarse), min(len(x), pivots))
    spec = "row long, id long, query boolean, d int, v array<double>"
    given = rows.sparkSession.sparkContext.broadcast(samples)
    placed = written(rows.mapInArrow(lambda it: _placed(it, given.value, coarse, scale, k), f"{spec}, pivot int, stats array<double>, least double"), "placed")

    def dealt(df: DataFrame, size: int, name: str) -> DataFrame:
        """Each pivot's rows in blocks of ``size``, numbered by pivot and part."""
        parts = df.groupBy("d", "pivot").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
        return df.join(parts, ["d", "pivot"]).withColumn(name, F.col("pivot").cast("long") * (1 << 32) + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts", "pivot")

    queries = dealt(placed.where("query"), query_block, "qb")
    width = 2 * coarse
    ends = [f(F.get("stats", F.lit(j))) for f in (F.min, F.max) for j in range(width)]
    found = queries.groupBy("d", "qb").agg(F.min("least").alias("least"), F.array(*ends).alias("ends")).toArrow()  # at most PIVOTS + QUERY_BLOCKS for each length
    ranges = {}
    for d in set(found.column("d").to_pylist()):
        own = found.filter(pa.array(found.column("d").to_numpy() == d))
        e = np.array(own.column("ends").to_pylist(), "f8")
        real = min(width, segment_statistics(np.zeros((1, d)), coarse).shape[1])
        ranges[d] = (own.column("qb").to_numpy(), e[:, :real], e[:, width : width + real], own.column("least").to_numpy())
    reach = rows.sparkSession.sparkContext.broadcast(ranges)
    held = dealt(placed, data_block, "b").select("row", "id", "query", "d", "v", "b").mapInArrow(lambda it: _reached(it, reach.value, coarse, scale), f"{spec}, b long, reach array<long>")
    held = held.select("d", F.explode("reach").alias("qb"), "b", F.lit(False).alias("query"), "row", "id", "v", F.lit(None).cast("double").alias("least"))
    asked = queries.join(held.select("d", "qb", "b").distinct(), ["d", "qb"]).select("d", "qb", "b", "query", "row", "id", "v", "least")

    def cell(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        x = _whole(table.column("v").combine_chunks(), d, scale)
        asks, row, ids = table.column("query").to_numpy(), table.column("row").to_numpy(), table.column("id").to_numpy()
        best = search_block(row[asks], x[asks], table.column("least").to_numpy()[asks], row[~asks], ids[~asks], x[~asks], k, levels)
        return pa.table({n: pa.array([f[i] for f in best], pa.int64()) for i, n in enumerate(("row", "vec_id", "score"))})

    found = asked.unionByName(held).groupBy("d", "qb", "b").applyInArrow(cell, "row long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(queries.select("row", F.col("id").alias("query_id")), "row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
