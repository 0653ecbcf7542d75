"""Line dedup: range-partitioned line hashes, secondary sort, streamed first occurrences, keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from spanforge.llm.common import SPACE, ascii_lower, scratch, written

#: kinds of rows that a sorted partition streams out
DROP, PENDING, SUMMARY = 0, 1, 2
_OUT = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("n", pa.int64())])


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _rows(kind: int, c: dict[str, np.ndarray], where: np.ndarray) -> pa.RecordBatch:
    n = int(where.sum()) if where.dtype == bool else len(where)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, "i1")), *(pa.array(c[k][where]) for k in ("h1", "h2", "doc", "th", "pos")), pa.array(np.zeros(n, "i8"))], schema=_OUT)


def _summary(h: tuple[int, int], doc: int, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((SUMMARY, *h, doc, 0, 0, n), _OUT.types, strict=True)], schema=_OUT)


def stream_repeats(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Over one range partition, sorted by hash, document (largest first) and position.

    Within a hash the first document keeps its lines. A hash whose documents all lie in the partition is
    decided here. The partition's first hash may have begun in an earlier partition and its last may go on
    in the next: their rows go out as PENDING, with a SUMMARY (largest document, number of documents) each.
    Held back at any time: a batch, and the rows of fewer than ``min_docs`` documents of its last hash.
    """
    held: dict[str, np.ndarray] | None = None
    first, h, top, last, n = True, None, 0, None, 0  # the open hash, its largest and latest document, its documents so far
    decided = False
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "doc", "th", "pos")}
        if held is not None:
            c, held = {k: np.concatenate([held[k], c[k]]) for k in c}, None
        size = len(c["doc"])
        new_hash = np.r_[True, (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1])]
        new_doc = new_hash | np.r_[True, c["doc"][1:] != c["doc"][:-1]]
        start = np.flatnonzero(new_hash)
        end = np.r_[start[1:], size]
        at = 0
        if h is None or (first or decided) and (int(c["h1"][0]), int(c["h2"][0])) == h:
            # goes on with a hash whose rows need not be held: the partition's first, or one decided already
            if h is None:
                h, n, last = (int(c["h1"][0]), int(c["h2"][0])), 0, None
                top = int(c["doc"][0])
            docs = c["doc"][: end[0]]
            n += int(new_doc[: end[0]].sum()) - (last is not None and int(docs[0]) == last)
            last = int(docs[-1])
            rows = np.zeros(size, bool)
            rows[: end[0]] = True if first else docs != top
            yield _rows(PENDING if first else DROP, c, rows)
            at = 1
            if len(start) == 1:
                continue
        if h is not None:
            if first:
                yield _summary(h, top, n)
            first, decided = False, False
        if at == len(start):
            continue
        # the rest: whole hashes, and the last one, which may go on
        group = np.cumsum(new_hash) - 1
        n_docs = np.add.reduceat(new_doc.astype("i8"), start)
        enough = n_docs >= min_docs
        many = enough[group] & (c["doc"] != c["doc"][start][group])
        many[: start[at]] = False
        if many.any():
            yield _rows(DROP, c, many)
        h, top, last, n = (int(c["h1"][start[-1]]), int(c["h2"][start[-1]])), int(c["doc"][start[-1]]), int(c["doc"][-1]), int(n_docs[-1])
        decided = bool(enough[-1])
        if not decided:
            held = {k: v[start[-1] :].copy() for k, v in c.items()}
    if h is not None:
        if held is not None:
            yield _rows(PENDING, held, np.ones(len(held["doc"]), bool))
        yield _summary(h, top, n)


def keep_bitmap(gone: np.ndarray) -> bytes:
    """Compressed bits of lines, 0 at the places ``gone``; it ends with the last one's byte, what comes later stays."""
    keep = np.ones((int(gone.max()) // 8 + 1) * 8, bool)
    keep[gone] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept_text(text: str, bitmap: bytes) -> str:
    """The lines of ``text`` that its keep bitmap keeps, joined."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), "u1"))[: len(lines)]
    return "\n".join([x for x, k in zip(lines, bits.tolist(), strict=False) if k] + lines[len(bits) :])


@F.arrow_udf(BinaryType())
def _bitmaps(gone: pa.Array) -> pa.Array:
    return pa.array([keep_bitmap(x.values.to_numpy()) for x in gone], pa.binary())


@F.arrow_udf(StringType())
def _kept(text: pa.Array, keep: pa.Array) -> pa.Array:
    return pa.array([None if not b.is_valid else kept_text(t.as_py(), b.as_py()) for t, b in zip(text, keep, strict=True)], pa.string())


def _doc_key(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, n_dropped, keep): a compressed keep bitmap for each document that loses lines; all others keep theirs.

    A written table. ``keep`` is made by ``keep_bitmap`` and read by ``kept_text``. ``doc`` is the id (null: the smallest long), ``th`` the XXH64 of the text, so rows that share an id but
    not a text have bitmaps of their own. A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z
    lower-cased, told apart by two 64-bit hashes; keys shorter than ``min_chars`` code points never count.
    """
    with scratch(docs.sparkSession):
        text = F.col(f"`{text_col}`")
        doc = docs.select(_doc_key(id_col).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), lines_of(text).alias("lines"))
        lines = doc.select("doc", "th", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
        key = ascii_lower(F.col("key"))
        hashed = written(lines.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(min_docs), key).alias("h2"), "doc", "th", "pos"), "line-hashes")
        ordered = hashed.repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "pos")
        out = written(ordered.mapInArrow(lambda it: stream_repeats(it, min_docs), "kind byte, h1 long, h2 long, doc long, th long, pos int, n long"), "line-repeats")
        # at most two summaries a partition
        summary = out.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc").alias("top"))
        late = out.where(F.col("kind") == PENDING).select("h1", "h2", "doc", "th", "pos").join(F.broadcast(summary), ["h1", "h2"]).where((F.col("docs") >= min_docs) & (F.col("doc") != F.col("top")))
        gone = out.where(F.col("kind") == DROP).select("doc", "th", "pos").unionByName(late.select("doc", "th", "pos"))
        gone = gone.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))
        return written(gone.select("doc", "th", F.size("gone").cast("long").alias("n_dropped"), _bitmaps("gone").alias("keep")), "keep-bitmaps", keep=True)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that repeat across documents; the text column holds what is left.

    Keys found in at least ``min_docs`` documents lose all their lines except in the document with the
    largest id. Rows are never lost: a null or empty text is one empty line and comes back empty, a text
    whose lines all go comes back empty. Rows with equal ids are one document, so they never count twice;
    a null id counts as the smallest. Appended: ``n_lines``, ``n_dropped`` and ``keep`` (the bitmap, null where
    every line stays), under these names even if ``docs`` has such columns (the older ones are replaced).
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep")]
    bitmaps = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col).select("doc", "th", F.col("n_dropped").alias("gone"), "keep")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], _doc_key(id_col).alias("doc"), F.xxhash64(text).alias("th"), text.alias("whole"))
    rows = rows.join(bitmaps, ["doc", "th"], "left").withColumn("part", _kept(F.when(F.col("keep").isNotNull(), F.col("whole")), "keep"))
    new = F.when(F.col("keep").isNull(), F.col("whole")).otherwise(F.col("part"))
    n_lines = F.size(lines_of(F.col("whole"))).cast("long")
    return rows.select(*[new.alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], n_lines.alias("n_lines"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_dropped"), "keep")
