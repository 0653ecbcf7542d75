"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import connected_components, written
from spanforge.llm.vectors import usable


@dataclass(frozen=True)
class CrossPolytope:
    """tables of ``functions`` hashes each; a hash is the nearest of the 2d signed axes after a random rotation.

    probes: the buckets looked up in each table, at most 2^functions: the own one, then those with the
    next-best axis in place where it comes closest. With the values given, 0.98 of cosine is found with a probability above 0.999 in
    64 dimensions, among 128^3 buckets for each label and table.
    """

    tables: int = 6
    functions: int = 3
    probes: int = 4
    seed: int = 11

    def _rotated(self, x: np.ndarray, table: int, function: int) -> np.ndarray:
        """Three rounds of random signs and a fast Hadamard transform."""
        signs = np.random.default_rng([self.seed, table, function, x.shape[1]]).choice([-1.0, 1.0], size=(3, x.shape[1]))
        for s in signs:
            x = x * s
            h = 1
            while h < x.shape[1]:
                pairs = x.reshape(len(x), -1, 2, h)
                x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), -1)
                h *= 2
            x = x / np.sqrt(x.shape[1])
        return x

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): bucket numbers, the own bucket first. ``x``: unit rows."""
        n, width = len(x), 1 << max(1, int(np.ceil(np.log2(max(2, x.shape[1])))))
        x = np.hstack([x, np.zeros((n, width - x.shape[1]))])
        out = np.zeros((n, self.tables, self.probes), "i8")
        for t in range(self.tables):
            first, second, gap = [], [], []
            for f in range(self.functions):
                y = self._rotated(x, t, f)
                size = np.abs(y)
                two = np.argsort(-size, axis=1, kind="stable")[:, :2]
                code = two * 2 + (np.take_along_axis(y, two, 1) > 0)
                best = np.take_along_axis(size, two, 1)
                first.append(code[:, 0])
                second.append(code[:, 1])
                gap.append(best[:, 0] - best[:, 1])
            first, second, gap = (np.stack(a, 1) for a in (first, second, gap))
            near = np.argsort(gap, axis=1, kind="stable")
            pack = lambda c: c @ (2 * width) ** np.arange(self.functions)
            for p in range(self.probes):
                # probe p swaps the functions of the bits of p, the closest call being bit 0
                swap = np.zeros((n, self.functions), bool)
                for bit in range(self.functions):
                    if p >> bit & 1:
                        swap[np.arange(n), near[:, bit]] = True
                out[:, t, p] = pack(np.where(swap, second, first))
        return out


def _unit(batch_column: pa.Array, d: int) -> np.ndarray:
    x = batch_column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(batches: Iterator[pa.RecordBatch], lsh: CrossPolytope) -> Iterator[pa.RecordBatch]:
    """Rows (cid, n, label, v) -> with ``codes``, flat."""
    for batch in batches:
        lengths = np.array([len(v) for v in batch.column("v")])
        for d in np.unique(lengths):
            part = batch.filter(pa.array(lengths == d))
            for at in range(0, part.num_rows, 2048):
                some = part.slice(at, 2048)
                codes = lsh.codes(_unit(some.column("v"), int(d)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes[0].size), pa.int32()), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*some.columns, flat], [*some.schema.names, "codes"])


def _cell_links(table: pa.Table, lsh: CrossPolytope, threshold: float) -> pa.Table:
    """One (sub-)cell: rows (t, bucket, a, b, side, cid, n, v, codes) -> (cid, links, root) for rows with a link.

    A pair may meet in several cells. Its links are counted in the first table, and there in the smallest
    bucket, where it meets; both rows' codes tell which that is. Roots hold for all pairs that link here, so
    components need no pair either.
    """
    bucket, t, d = table.column("bucket")[0].as_py(), table.column("t")[0].as_py(), len(table.column("v")[0])
    x = _unit(table.column("v").combine_chunks(), d)
    cid, n, side = (table.column(c).to_numpy() for c in ("cid", "n", "side"))
    codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(cid), lsh.tables, lsh.probes)
    own = codes[:, t, 0] == bucket
    across = table.column("a")[0].as_py() != table.column("b")[0].as_py()
    links, root = np.zeros(len(cid), "i8"), np.arange(len(cid))

    for at in range(0, len(cid), 256):
        sim = x[at : at + 256] @ x.T
        near = sim >= threshold - 1e-9
        near &= np.arange(len(cid))[None, :] > np.arange(at, at + len(sim))[:, None]
        near &= own[at : at + 256, None] | own[None, :]
        if across:
            near &= side[at : at + 256, None] != side[None, :]
        i, j = np.nonzero(near)
        i += at
        sure = np.abs(sim[i - at, j] - threshold) > 1e-9
        sure[~sure] = [float(np.dot(x[p], x[q])) >= threshold for p, q in zip(i[~sure], j[~sure], strict=True)]
        i, j = i[sure], j[sure]
        for lo in range(0, len(i), 1 << 16):
            p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            p_in_q = (codes[q] == codes[p][:, :, :1]).any(axis=2)
            q_in_p = (codes[p] == codes[q][:, :, :1]).any(axis=2)
            meet = p_in_q | q_in_p
            first = meet.argmax(axis=1) == t
            big = np.iinfo("i8").max
            least = np.minimum(np.where(p_in_q[:, t], codes[p, t, 0], big), np.where(q_in_p[:, t], codes[q, t, 0], big))
            count = first & (least == bucket)
            links += np.bincount(p[count], n[q[count]], len(cid)).astype("i8") + np.bincount(q[count], n[p[count]], len(cid)).astype("i8")
        while (root[i] != root[j]).any():
            np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
            root = _roots(root)
    top = _roots(root)
    least = np.full(len(cid), np.iinfo("i8").max)
    np.minimum.at(least, top, cid)
    linked = np.bincount(top, minlength=len(cid))[top] > 1
    return pa.table({"cid": cid[linked], "links": links[linked], "root": least[top][linked]})


def _roots(root: np.ndarray) -> np.ndarray:
    while ((up := root[root]) != root).any():
        root = up
    return root


def near_vectors(vectors: DataFrame, threshold: float = 0.98, lsh: CrossPolytope | None = None, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of ``vectors``.

    Vectors of equal, non-null labels and equal length link where the cosine is at least ``threshold``.
    n_links: the other rows linked directly; component_id: the smallest id reachable over links. Vectors that
    are null, zero, or hold null or non-finite components, and those without a label, link with nothing. A
    null id counts as the smallest one and gives a null component_id. Rows that share an id are one node of
    the graph but count each. Extra columns play no part; an empty table gives no rows.

    Equal vectors of a label are one class with a count and link without being compared. Classes are hashed;
    cells (label, table, bucket) with one class are dropped before any vector moves. A cell beyond ``block``
    rows is dealt into blocks whose pairs are cells of their own, so a task holds two blocks at most, and no
    pair is left out. Cells give counts and stars, never pairs.
    """
    lsh = lsh or CrossPolytope()
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    v = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x + 0.0)  # no -0.0
    able = usable(F.col(f"`{vector_col}`")) & F.exists(v, lambda x: x != 0) & F.col(f"`{label_col}`").isNotNull()
    rows = written(vectors.select(ident.alias("id"), F.coalesce(able, F.lit(False)).alias("able"), F.col(f"`{label_col}`").alias("label"), v.alias("v")).withColumn("h", F.xxhash64("label", "v")), "vectors")
    classes = rows.where("able").groupBy("label", "v").agg(F.min("id").alias("cid"), F.count("*").alias("n"))
    kinds = dict(classes.dtypes)
    hashed = classes.select("cid", "n", "label", "v").mapInArrow(lambda it: _hashed(it, lsh), f"cid long, n long, label {kinds['label']}, v array<double>, codes array<long>")
    hashed = written(hashed, "vector-codes")
    place = F.posexplode("codes").alias("at", "bucket")
    met = hashed.select("cid", "label", F.size("v").alias("d"), place).select("cid", "label", "d", F.expr(f"cast(at div {lsh.probes} as int)").alias("t"), "bucket")
    full = met.groupBy("label", "d", "t", "bucket").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / block).cast("int")
    met = met.join(full, ["label", "d", "t", "bucket"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cid", "label", "d", "t", "bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).alias("side"))
    cells = met.join(hashed.drop("label"), "cid").groupBy("label", "d", "t", "bucket", "a", "b")
    linked = written(cells.applyInArrow(lambda table: _cell_links(table, lsh, threshold), "cid long, links long, root long"), "vector-links")
    root = connected_components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    per_class = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    found = hashed.select("cid", "n", "label", "v").join(per_class, "cid", "left").join(root.withColumnRenamed("node", "cid"), "cid", "left")
    found = found.select(F.xxhash64("label", "v").alias("h2"), F.col("label").alias("l2"), F.col("v").alias("v2"), F.coalesce("links", F.lit(0)).alias("links"), "n", F.coalesce("component", "cid").alias("component"))
    out = rows.join(found, F.col("able") & (F.col("h") == F.col("h2")) & (F.col("label") == F.col("l2")) & (F.col("v") == F.col("v2")), "left")
    n_links = F.when(F.col("component").isNull(), 0).otherwise(F.col("links") + F.col("n") - 1).cast("long")
    named = lambda c: F.when(c != F.lit(-(2**63)), c)
    component = F.coalesce("component", "id")
    return out.select(named(F.col("id")).alias("vec_id"), n_links.alias("n_links"), named(component).alias("component_id"), (F.col("id") == component).alias("kept"))
