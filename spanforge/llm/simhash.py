"""Near-dedup: SimHash fingerprints linked by multi-index hashing; in the pipeline, verified by shingle sets, whose prefixes complete it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import by_merge, connected_components, scratch, written

BITS, HALF = 64, 32
MAX_DISTANCE = 3
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash: a bit is set where over half of the shingles' XXH64 have it.

    Words are what ``[\\x20\\x09-\\x0D]`` leaves between it, A-Z lower-cased; fewer words than a shingle are one
    shingle; no words give 0. Repeats count.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, "i8")
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK], strict=True)], ">u8")
        counts += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], "u8").view("i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): a row for each row of ``docs``; the fingerprint's 64 bits are held as a signed long."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def _halves(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, HALF), fp.bitwiseAND(F.lit((1 << HALF) - 1))]


def _ball(value: Column, bits: int, name: int = 0) -> Column:
    """``value`` and its neighbours that have one bit more. Of two values that differ in one bit, only the
    one without it needs to look for the other."""
    more = [F.when(value.bitwiseAND(F.lit(1 << b)) == 0, value.bitwiseOR(F.lit(name | 1 << b))) for b in range(bits)]
    return F.array_compact(F.array(value.bitwiseOR(F.lit(name)), *more))


def _local_stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fp, smallest of its component) for distinct fingerprints of one cell that link to another one.

    A breadth-first walk: what is reached leaves the pool, so a dense group is walked in few passes.
    """
    left, out_a, out_b = np.sort(fps), [], []
    while len(left) > 1:
        group, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), bool)
            for x in front:
                reached |= np.bitwise_count(left ^ x) <= MAX_DISTANCE
            front, left = left[reached], left[~reached]
            group.append(front)
        if len(found := np.concatenate(group)) > 1:
            out_a.append(found)
            out_b.append(np.full(len(found), found.min()))
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (fps[:0], fps[:0])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp) come sorted by cell. A cell's fingerprints share 48 bits, but for one flip in either
    part, so their number has a bound that doesn't depend on the input."""

    def stars(fps: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _local_stars(np.unique(np.concatenate(fps)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, fps = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
        cuts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if cell[s] != key:
                if sum(map(len, held)) > 1:
                    yield stars(held)
                key, held = cell[s], []
            held.append(fps[s:e])
    if sum(map(len, held)) > 1:
        yield stars(held)


def near_links(fps: DataFrame, busy: int = 64) -> DataFrame:
    """``fps(fp long)``, distinct -> ``(a, b)``: links between fingerprints of at most three differing bits.

    The links connect just what all such pairs would. Of two fingerprints at that distance, one 32-bit half
    differs in at most one bit: each fingerprint looks up both halves and their one-bit neighbours in the
    table of halves, and the whole distance is checked in the join.

    Halves that more than ``busy`` fingerprints share (a large group of near copies) would give pairs as the
    square of the group. They are looked up by the other half's two 16-bit parts as well, again with one-bit
    neighbours, and each such cell gives its local components as stars instead of pairs; this is exact too.
    """
    own = fps.select("fp", F.posexplode(F.array(*_halves(F.col("fp")))).alias("seg", "half"))
    ball = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), h.alias("exact"), _ball(h, HALF).alias("halves")) for s, h in enumerate(_halves(F.col("fp")))])).alias("x"))
    ball = ball.select("fp", "x.seg", "x.exact", F.explode("x.halves").alias("half"))
    hot = own.groupBy("seg", "half").count().where(F.col("count") > busy).select("seg", "half")
    hot = written(hot, "busy-halves")
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("to"))) <= MAX_DISTANCE) & ((F.col("half") != F.col("exact")) | (F.col("fp") < F.col("to")))
    quiet = own.join(by_merge(hot), ["seg", "half"], "left_anti").withColumnsRenamed({"fp": "to", "seg": "seg_to", "half": "half_to"})
    pairs = ball.join(by_merge(quiet), (F.col("seg") == F.col("seg_to")) & (F.col("half") == F.col("half_to")) & near).select(F.col("fp").alias("a"), F.col("to").alias("b"))
    if hot.isEmpty():
        return pairs
    in_hot = ball.join(by_merge(hot), ["seg", "half"], "left_semi")
    other = F.when(F.col("seg") == 0, _halves(F.col("fp"))[1]).otherwise(_halves(F.col("fp"))[0])
    parts = F.array(*[F.struct(F.lit(p).alias("part"), _ball(v, HALF // 2).alias("values")) for p, v in enumerate([F.shiftrightunsigned(other, 16), other.bitwiseAND(F.lit(0xFFFF))])])
    cells = in_hot.select("fp", "seg", "half", F.explode(parts).alias("x")).select("fp", "seg", "half", "x.part", F.explode("x.values").alias("value"))
    cell = F.concat_ws(".", "seg", "half", "part", "value").alias("cell")
    stars = cells.select(cell, "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells, "a long, b long")
    return pairs.unionByName(stars)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, busy: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id: the smallest id reachable over links.

    Fingerprints link at three or fewer differing bits, whatever the documents' number: equal fingerprints
    are one node, so copies never make pairs. Null and empty texts have fingerprint 0 and link like others. A
    null id keeps its row and never is a component's id, unless no row of the component has one (null then).
    Rows that repeat each keep their row; extra columns play no part; an empty table gives no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    root = connected_components(near_links(fps.select("fp").distinct(), busy))
    rooted = fps.join(by_merge(root.select(F.col("node").alias("fp"), F.col("component").alias("root"))), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(by_merge(least), "root").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Texts are near copies where their shingle sets have four fifths in common: Jaccard |a & b| / |a | b| >= 4 / 5.
PARTS, WHOLE = 4, 5
#: One document in so many is looked at for common shingles; at most so many of these are held, if seen this often.
SAMPLED, COMMON, SEEN = 16, 1 << 17, 2
#: Bytes of keys that a join may send to every task.
SMALL = 8 << 20


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 of the shingles, sorted, as signed longs; words are those of ``fingerprint``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "i8")
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    first, last = np.r_[0, ends[:-1] + 1][:n].tolist(), ends[-n:].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(first, last, strict=True)), "u8", n).view("i8"))


def set_fingerprint(own: np.ndarray) -> int:
    """The SimHash of a shingle set, as ``fingerprint`` counts it, held as a signed long."""
    counts = np.zeros(BITS, "i8")
    for at in range(0, len(own), _BLOCK):
        counts += np.unpackbits(own[at : at + _BLOCK].astype(">i8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > len(own)).view(">i8")[0])


def _prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """So many shingles, in one order for all documents, that two sets with Jaccard >= 4/5 share one of them.

    Such sets share at least ceil(4/5 n) of their n shingles, so the n - ceil(4/5 n) + 1 first of each can't be
    disjoint, whatever the order. It has the rare ones first: common shingles (sorted, with ranks) come last.
    """
    if len(common):
        at = np.searchsorted(common, own).clip(max=len(common) - 1)
        own = own[np.argsort(np.where(common[at] == own, rank[at], -1), kind="stable")]
    return own[: len(own) - -(-PARTS * len(own) // WHOLE) + 1] if len(own) else own


def parity_bits(own: np.ndarray) -> np.ndarray:
    """As many bits as shingles, or more, a power of two: a bit tells whether an odd number of them falls on it. The bits
    in which two sets differ are at most as many as the shingles that one of them lacks."""
    n = max(64, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount(own & (n - 1), minlength=n) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def parity_distance(a: Column, b: Column) -> Column:
    """The differing bits of two arrays of ``parity_bits``; the longer one is folded to the other's length."""
    xor = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    fold = lambda x, y: F.when(F.size(x) > F.size(y), xor(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)))).otherwise(x)
    return F.aggregate(xor(fold(a, b), fold(b, a)), F.lit(0), lambda n, x: n + F.bit_count(x))


def _long_lists(lists: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(x) for x in lists])].astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "i8"), *lists])))


_SETS = "id long, digest binary, size long, list array<long>, bits array<long>, fp long"


def _shingled(batches: Iterator[pa.RecordBatch], shingle: int, common: np.ndarray | None, rank: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, digest of the set, its size, list, parity bits, SimHash): the prefixes, or whole sets where ``common`` is
    None. A batch goes out in pieces of bounded size."""
    names = ["id", "digest", "size", "list", "bits", "fp"]

    def out(held: list[tuple]) -> pa.RecordBatch:
        ids, digests, sizes, lists, bits, fps = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), _long_lists(lists), _long_lists(bits), pa.array(fps, pa.int64())], names)

    for batch in batches:
        held, n = [], 0
        for i, text in zip(batch.column(0), batch.column(1), strict=True):
            own = shingle_set(text.as_py(), shingle)
            found = own if common is None else _prefix(own, common, rank)
            held.append((i.as_py(), xxhash.xxh3_128_digest(own.tobytes()), len(own), found, parity_bits(own), set_fingerprint(own)))
            if (n := n + len(found)) > 1 << 18:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)


def _alike(n_a: int, n_b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether Jaccard is 4/5 or more, in whole numbers."""
    return (PARTS + WHOLE) * both >= PARTS * (n_a + n_b)


def _set_stars(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As ``_local_stars``, for documents with their shingle sets."""
    out = []
    while len(ids) > 1:
        sizes = np.array([len(s) for s in sets], "i8")
        flat, starts = np.concatenate(sets), np.r_[0, np.cumsum(sizes)[:-1]]
        left, front, group = np.ones(len(ids), bool), [0], [0]
        left[0] = False
        while front and left.any():
            own = sets[front.pop()]
            at = np.searchsorted(own, flat).clip(max=len(own) - 1)
            reached = np.flatnonzero(left & _alike(len(own), sizes, np.add.reduceat((own[at] == flat).astype("i8"), starts)))
            left[reached] = False
            front += reached.tolist()
            group += reached.tolist()
        found = np.unique(ids[group])
        out.append(np.stack([found, np.full(len(found), found.min())]))
        rest = np.flatnonzero(left)
        ids, sets = ids[rest], [sets[i] for i in rest]
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def _set_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, id, list) sorted by cell -> stars; a cell is at most two blocks."""

    def stars(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        a, b = _set_stars(np.array([i for i, _ in held], "i8"), [s for _, s in held])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    key, held = None, []
    for batch in batches:
        cells = zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4), strict=True)
        for *cell, i, own in cells:
            if cell != key:
                if len(held) > 1:
                    yield stars(held)
                key, held = cell, []
            held.append((i, own.values.to_numpy()))
    if len(held) > 1:
        yield stars(held)


def _small(keys: DataFrame, row_bytes: int = 8) -> DataFrame:
    """``keys``, sent to every task if they take ``SMALL`` bytes at most; other joins with them shuffle."""
    return F.broadcast(keys) if keys.count() * row_bytes <= SMALL else keys


def _common_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a sample's documents that repeat most, sorted, and their ranks. They only order the
    lookup: with any others the links are the same, at another cost."""
    few = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
    sets = few.mapInArrow(lambda it: _shingled(it, shingle, None, None), _SETS)
    seen = sets.select(F.explode("list").alias("h")).groupBy("h").count().where(F.col("count") >= SEEN)
    top = seen.orderBy(F.col("count").desc(), "h").limit(COMMON).toArrow()
    h, n = top.column("h").to_numpy(), top.column("count").to_numpy()
    rank = np.zeros(len(h), "i8")
    rank[np.lexsort((h, -n))] = np.arange(len(h))[::-1]  # the most frequent one comes last of all
    order = np.argsort(h)
    return h[order], rank[order]


def fingerprint_pairs(first: DataFrame, busy: int = 64) -> DataFrame:
    """``first(id, fp)`` -> ``(a, b)``: sets to compare as their SimHashes are linked (``near_links``). Those of one fingerprint all meet
    the one with the smallest id, which stands for them in links between fingerprints, so a large group never makes all its pairs."""
    lead = written(first.groupBy("fp").agg(F.min("id").alias("lead")), "fingerprints")
    of = lambda n: lead.select(F.col("fp").alias(n), F.col("lead").alias(f"lead_{n}"))
    near = near_links(lead.select("fp"), busy).join(by_merge(of("a")), "a").join(by_merge(of("b")), "b")
    same = first.select("id", "fp").join(by_merge(lead), "fp").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    pairs = near.select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b")).unionByName(same)
    return pairs.where("a <> b").distinct()


def similar_links(rows: DataFrame, first: DataFrame, shingle: int = 5, busy: int = 64, block: int = 1024) -> DataFrame:
    """``rows(id, text)`` and ``first(id, digest, size, list, bits, fp)``, its distinct sets with prefixes -> ``(a, b)``.

    The links connect just what all pairs with Jaccard >= 4/5 would. SimHash finds sets to compare first, within three bits
    (``fingerprint_pairs``), and each pair is verified by the whole sets. At 4/5 a tenth of the bits and more differ, so what
    three bits miss is searched for too: two such sets share a shingle of their prefixes (see ``_prefix``), so a join on those finds every pair. Of what they share, all that comes no later
    than the end of both prefixes is in both, so a pair is passed over only if what the prefixes share and the
    rest of a set can't be enough, or if their parity bits differ in more places than they may have shingles apart.
    Others are verified by the whole sets, but for pairs that verified ones connect already: each set's likeliest pair along with
    those that SimHash finds, then what still leads from one component to another.

    Shingles in the prefixes of more than ``busy`` sets would give pairs as the square of their number: there
    all are compared with one of them first, and only where this doesn't connect them all they are dealt
    into pairs of blocks that give stars. None is left out.
    """
    keys = first.select("id", "size", F.explode("list").alias("key"))
    counts = written(keys.groupBy("key").count().where("count > 1"), "shared-shingles")
    keys = written(keys.join(counts, "key"), "prefixes")
    quiet, hot = keys.where(F.col("count") <= busy), keys.where(F.col("count") > busy)
    in_hot = hot.groupBy("id").agg(F.count("*").alias("hot"))
    a, b = (quiet.select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("id", "size")]) for n in "ab")
    sized = (F.col("size_a") * WHOLE >= F.col("size_b") * PARTS) & (F.col("size_b") * WHOLE >= F.col("size_a") * PARTS)
    shared = a.join(b, "key").where((F.col("id_a") < F.col("id_b")) & sized).groupBy("id_a", "id_b", "size_a", "size_b").agg(F.count("*").alias("n"))
    for n in "ab":
        shared = shared.join(in_hot.select(F.col("id").alias(f"id_{n}"), F.col("hot").alias(f"hot_{n}")), f"id_{n}", "left")
    more = F.least(*[F.coalesce(F.col(f"hot_{n}"), F.lit(0)) for n in "ab"]) + F.ceil(F.greatest("size_a", "size_b") * PARTS / WHOLE) - 1
    pairs = shared.where((F.col("n") + more) * (PARTS + WHOLE) >= (F.col("size_a") + F.col("size_b")) * PARTS).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    leaders = hot.groupBy("key").agg(F.min("id").alias("a"))
    pairs = pairs.unionByName(hot.join(leaders, "key").where("id <> a").select("a", F.col("id").alias("b"))).distinct()
    side = lambda n: first.select(F.col("id").alias(n), F.col("size").alias(f"size_{n}"), F.col("bits").alias(f"bits_{n}"))
    apart, total = parity_distance(F.col("bits_a"), F.col("bits_b")), F.col("size_a") + F.col("size_b")
    # |a & b| >= 4/9 (|a| + |b|), so at most a ninth of both sizes' sum is in one of the two only
    by_bits = written(fingerprint_pairs(first, busy), "fingerprint-pairs").withColumn("found", F.lit(True))
    pairs = pairs.unionByName(by_bits.select("a", "b")).distinct().join(by_merge(by_bits), ["a", "b"], "left")
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(sized).withColumn("apart", apart).where(F.col("apart") * (PARTS + WHOLE) <= total * (WHOLE - PARTS))
    likely = written(likely.select("a", "b", (F.col("apart") / F.greatest(total, F.lit(1))).alias("apart"), F.coalesce("found", F.lit(False)).alias("found")), "pairs")
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    sets = rows.join(_small(wanted), "id", "left_semi").mapInArrow(lambda it: _shingled(it, shingle, None, None), _SETS)
    sets = written(sets.join(_small(first.select("id", "digest").join(wanted, "id", "left_semi"), 128), ["id", "digest"], "left_semi").select("id", "list"), "sets")

    def verified(some: DataFrame) -> DataFrame:
        of = lambda n: sets.select(F.col("id").alias(n), F.col("list").alias(f"of_{n}"))
        both, each = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
        return written(some.select("a", "b").join(of("a"), "a").join(of("b"), "b").where(both * (PARTS + WHOLE) >= each * PARTS).select("a", "b").distinct(), "links")

    found, rest = likely.where("found"), likely.where("NOT found")
    likeliest = rest.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))
    first_ones = written(found.select("a", "b").unionByName(likeliest.select("a", "b")), "first-pairs")
    # components as stars: what is verified later is added to these, so they are not worked out anew from all links
    joined = connected_components(verified(first_ones))
    left = rest.join(by_merge(first_ones), ["a", "b"], "left_anti")
    for n in "ab":
        left = left.join(by_merge(joined.select(F.col("node").alias(n), F.col("component").alias(f"of_{n}"))), n, "left").withColumn(f"of_{n}", F.coalesce(f"of_{n}", n))
    links = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").unionByName(verified(left.where("of_a <> of_b")))
    if hot.isEmpty():
        return links
    known = connected_components(links).select(F.col("node").alias("id"), "component")
    rooted = hot.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = rooted.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    dealt = hot.select("key", "id").distinct().join(split.where("low <> high").select("key", "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    whole = rows.join(_small(dealt.select("id").distinct()), "id", "left_semi").mapInArrow(lambda it: _shingled(it, shingle, None, None), _SETS)
    whole = whole.join(first.select("id", "digest"), ["id", "digest"], "left_semi").where("size > 0").select("id", "list")
    cells = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "id").join(whole, "id").select("key", "a", "b", "id", "list")
    cells = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return links.unionByName(cells.mapInArrow(_set_cells, "a long, b long"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, busy: int = 64) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id.

    Texts count as near copies where the sets of their five-word shingles have a Jaccard similarity of 0.8 or
    more; every such pair is found and each is verified, and a group is what they connect. Equal sets always
    do, empty ones too. Rows with a null id all stay, as do rows that share the smallest id of a group. Extra
    columns are kept.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null")
    with scratch(docs.sparkSession):
        common, rank = _common_shingles(rows, shingle)
        sets = written(rows.mapInArrow(lambda it: _shingled(it, shingle, common, rank), _SETS), "prefix-sets")
        least = sets.groupBy("digest").agg(F.min("id").alias("least"))
        copies = written(sets.select("id", "digest").join(least, "digest").where("id <> least").select("id", "digest").distinct(), "copies")
        first = sets.join(_small(copies, 128), ["id", "digest"], "left_anti")
        root = connected_components(similar_links(rows, first, shingle, busy)).where("node <> component").select(F.col("node").alias("id"))
        gone = written(copies.select("id").distinct().join(first.select("id"), "id", "left_anti").unionByName(root).distinct(), "near-copies", keep=True)
    ident = F.col(f"`{id_col}`").cast("long")
    return docs.join(_small(gone.withColumnRenamed("id", "_gone_id")), ident == F.col("_gone_id"), "left_anti")
