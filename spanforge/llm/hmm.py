"""LM scoring with a hidden Markov model, trained by Baum-Welch over all partitions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import fresh_path, written

END = b""
#: Distinct words that a worker counts before it passes them on, and texts whose tokens it holds at once.
_FLUSH, _SLICE = 150_000, 512


@dataclass(frozen=True)
class HmmSettings:
    """states: hidden states. own_words: the most frequent words with an emission of their own; all others share
    ``endings`` classes by their last three bytes. known_words: the most frequent words whose counts each worker
    holds; the counts of others come by a join. So what a worker holds is bounded, and nothing depends on the
    vocabulary's size. shards: parts of the training documents for the first, incremental pass, which updates
    the model after each; a pass over all of them follows. smoothing: tokens of the overall distribution added
    to each state's counts. batch_tokens: tokens that a worker trains on or scores side by side; a longer text is
    taken as a whole too, but by itself, and in blocks of so many tokens between which the states carry over."""

    states: int = 8
    own_words: int = 8191
    known_words: int = 65_536
    endings: int = 512
    shards: int = 8
    smoothing: float = 50.0
    batch_tokens: int = 1 << 19
    seed: int = 5

    @property
    def symbols(self) -> int:
        return 1 + self.own_words + self.endings


def words(text: str | None) -> list[bytes]:
    """The text's words between ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
    for batch in batches:
        for t in batch.column(0):
            own = words(t.as_py())
            for at in range(0, len(own), _FLUSH):
                counts.update(own[at : at + _FLUSH])
                if len(counts) > _FLUSH:
                    yield pack()
                    counts.clear()
            counts[END] += 1
    yield pack()


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c): the tokens of all rows of ``docs``; each text's end is the empty word."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ending(word: bytes, classes: int) -> int:
    return xxhash.xxh64_intdigest(word[-3:], 42) % classes


def ending_column(word: Column, classes: int) -> Column:
    """As ``ending``, for a power of two."""
    return F.xxhash64(F.substring(word, -3, 3)).bitwiseAND(F.lit(classes - 1)).cast("int")


@dataclass
class Lexicon:
    """What each worker holds of the vocabulary: frequent words by rank, and the classes' sums."""

    known: dict[bytes, int]
    counts: np.ndarray
    own: int
    class_log: np.ndarray  # log10 of the class's denominator
    n: int
    v: int
    counts_end: float

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


@dataclass
class Hmm:
    """start (K), move (K x K), emit (symbols x K)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def begin(cls, overall: np.ndarray, s: HmmSettings) -> Hmm:
        """Sticky states whose emissions are the overall distribution, perturbed."""
        rng = np.random.default_rng(s.seed)
        emit = overall[:, None] * np.exp(0.7 * rng.standard_normal((len(overall), s.states)))
        move = np.full((s.states, s.states), 0.2 / s.states) + 0.8 * np.eye(s.states)
        return cls(np.full(s.states, 1 / s.states), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, overall: np.ndarray, s: HmmSettings) -> Hmm:
        start, move, emit = start + 1, move + 1, emit + s.smoothing * overall[:, None]
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10_likelihoods(self, sequences: list[np.ndarray], batch_tokens: int) -> np.ndarray:
        """Exact log10 probabilities, by the scaled forward recursion over many sequences at once."""
        out = np.zeros(len(sequences))
        for some, steps, active in _side_by_side(sequences, batch_tokens):
            total = np.zeros(len(some))
            for t, n in enumerate(active):
                alpha = (self.start if t == 0 else alpha[:n] @ self.move) * self.emit[steps[t, :n]]
                scale = alpha.sum(axis=1)
                total[:n] += np.log10(scale)
                alpha /= scale[:, None]
            out[some] = total
        return out

    def expected_counts(self, sequences: list[np.ndarray], batch_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch: expected starts, moves and emissions."""
        k = len(self.start)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(self.emit.shape)
        a, b = self.move.astype("f4"), self.emit.astype("f4")
        for x in sequences:
            if len(x) > batch_tokens:
                for total, new in zip((start, move, emit), self._long_counts(x, batch_tokens), strict=True):
                    total += new
        for _, steps, active in _side_by_side([x for x in sequences if len(x) <= batch_tokens], batch_tokens):
            alphas, seen, scales = [], [], []
            for t, n in enumerate(active):
                e = b[steps[t, :n]]
                alpha = (self.start.astype("f4") if t == 0 else alphas[-1][:n] @ a) * e
                scale = np.maximum(alpha.sum(axis=1, keepdims=True), np.float32(1e-35))
                alphas.append(alpha / scale)
                seen.append(e)
                scales.append(scale)
            beta, moved = np.ones((active[-1], k), "f4"), np.zeros((k, k), "f4")
            gammas = [alphas[-1] * beta]
            for t in range(len(active) - 2, -1, -1):
                n, more = active[t + 1], active[t]
                ahead = seen[t + 1] * beta / scales[t + 1]
                moved += alphas[t][:n].T @ ahead
                beta = np.concatenate([ahead @ a.T, np.ones((more - n, k), "f4")])
                gammas.append(alphas[t] * beta)
            start += gammas[-1].sum(axis=0)
            move += moved * a
            at = np.concatenate([steps[t, : active[t]] for t in range(len(active) - 1, -1, -1)])
            gamma = np.concatenate(gammas)
            for j in range(k):
                emit[:, j] += np.bincount(at, gamma[:, j], len(emit))
        return start, move, emit


    def _long_counts(self, x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``expected_counts`` for one long sequence: forward states are kept where blocks begin, and those of
        a block are worked out again when the backward pass comes to it."""

        def forward(alpha: np.ndarray | None, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            alphas, scales = np.zeros((len(part), len(self.start))), np.zeros(len(part))
            for t, symbol in enumerate(part):
                alpha = (self.start if alpha is None else alpha @ self.move) * self.emit[symbol]
                scales[t] = max(alpha.sum(), 1e-300)
                alpha = alphas[t] = alpha / scales[t]
            return alphas, scales

        heads: list[np.ndarray | None] = [None]
        for at in range(0, len(x) - block, block):
            heads.append(forward(heads[-1], x[at : at + block])[0][-1])
        moved, emit, ahead = np.zeros(self.move.shape), np.zeros(self.emit.shape), None
        for n in range(len(heads) - 1, -1, -1):
            part = x[n * block : (n + 1) * block]
            alphas, scales = forward(heads[n], part)
            for t in range(len(part) - 1, -1, -1):
                beta = np.ones(len(self.start)) if ahead is None else self.move @ ahead
                if ahead is not None:
                    moved += np.outer(alphas[t], ahead)
                ahead = self.emit[part[t]] * beta / scales[t]
                alphas[t] *= beta
            np.add.at(emit, part, alphas)
        return alphas[0].copy(), moved * self.move, emit


def _side_by_side(sequences: list[np.ndarray], batch_tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Batches of sequences, the longest first: their places, their symbols by step, and how many still run at each step."""
    sizes = np.array([len(x) for x in sequences])
    order = np.argsort(-sizes, kind="stable")
    order = order[: int((sizes > 0).sum())]
    at = 0
    while at < len(order):
        n = max(1, batch_tokens // int(sizes[order[at]]))
        some = order[at : at + n]
        steps = np.zeros((sizes[some[0]], len(some)), "i4")
        for i, x in enumerate(some):
            steps[: sizes[x], i] = sequences[x]
        ends = -sizes[some]
        yield some, steps, np.searchsorted(ends, -np.arange(len(steps)), side="left").tolist()
        at += n


def _encode(batches: Iterator[pa.RecordBatch], lex: Lexicon, s: HmmSettings) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, shard, rid, text) -> symbols, what the known words add to the sums, and the other words."""
    ranks = np.arange(len(lex.counts))
    class_of = np.zeros(len(lex.counts), "i4")
    for w, r in lex.known.items():
        class_of[r] = ending(w, s.endings)
    symbol = np.where(ranks < lex.own, 1 + ranks, 1 + s.own_words + class_of).astype("u2")
    base = lex.base(lex.counts)
    within = np.where(ranks < lex.own, 0.0, np.log10(lex.counts + 0.5) - lex.class_log[class_of])
    get, end_count = lex.known.get, lex.counts_end
    names = ["doc_id", "held_out", "shard", "rid", "n_tokens", "known", "base", "within", "symbols", "rest", "times"]
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE // 2):
            part = batch.slice(at, _SLICE // 2)
            rows: list[tuple] = []
            for t in part.column("text"):
                own = words(t.as_py())
                r = np.fromiter(map(get, own, repeat(-1)), "i8", len(own))
                codes = np.zeros(len(own) + 1, "u2")
                found = r >= 0
                codes[:-1][found] = symbol[r[found]]
                rest: Counter[bytes] = Counter()
                for i in np.flatnonzero(~found):
                    rest[own[i]] += 1
                    codes[i] = 1 + s.own_words + ending(own[i], s.endings)
                rows.append((len(own) + 1, int(found.sum()) + (end_count > 0), float(base[r[found]].sum() + lex.base(np.array(end_count))), float(within[r[found]].sum()), codes.tobytes(), list(rest), list(rest.values())))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:4]), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)


def _expect(batches: Iterator[pa.RecordBatch], model: Hmm, s: HmmSettings) -> Iterator[pa.RecordBatch]:
    """Expected counts of a partition: a row for each symbol, and one for starts and for each state's moves."""
    k = s.states
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    for batch in batches:
        sequences = [np.frombuffer(b.as_py(), "<u2") for b in batch.column(0)]
        for total, new in zip((start, move, emit), model.expected_counts(sequences, s.batch_tokens), strict=True):
            total += new
    rows = np.flatnonzero(emit.any(axis=1))
    keys = np.concatenate([[-1 - k], np.arange(-k, 0), rows])
    values = np.vstack([start[None], move, emit[rows]])
    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(values[:, j]) for j in range(k))], ["key", *(f"s{j}" for j in range(k))])


def _collected(encoded: DataFrame, model: Hmm, s: HmmSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = s.states
    spec = "key long, " + ", ".join(f"s{j} double" for j in range(k))
    parts = encoded.select("symbols").mapInArrow(lambda it: _expect(it, model, s), spec)
    table = parts.groupBy("key").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toArrow()  # symbols x states at most
    keys, values = table.column("key").to_numpy(), np.stack([table.column(f"s{j}").to_numpy() for j in range(k)], 1)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((s.symbols, k))
    start[:] = values[keys == -1 - k].sum(axis=0)
    small = (keys >= -k) & (keys < 0)
    move[keys[small] + k] = values[small]
    emit[keys[keys >= 0]] = values[keys >= 0]
    return start, move, emit


def _score(batches: Iterator[pa.RecordBatch], model: Hmm, s: HmmSettings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = model.log10_likelihoods([np.frombuffer(b.as_py(), "<u2") for b in batch.column("symbols")], s.batch_tokens)
        keep = [c for c in batch.schema.names if c != "symbols"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], [*keep, "sequence"])


def score_documents(docs: DataFrame, settings: HmmSettings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of ``docs``.

    Rows whose crc32(id as text) mod 5 is 1 are held out, the rest train (a null id is the empty text). A
    text's tokens are its words and one end; null is the empty text, just an end. base_score: the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))). score: log10 of the model's probability of the text: the hidden
    Markov model gives the probability of the sequence of symbols, a word without a symbol of its own has
    besides (c + 0.5) / (C + 0.5 (W + 1)) within its class of C training tokens and W words, one place in each
    class being for words never seen. So all probabilities sum to one. Repeated rows each count and each have
    a row; extra columns play no part; an empty table, or one without training rows, is scored by the priors.
    """
    s, spark = settings or HmmSettings(), docs.sparkSession
    ident = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(ident.alias("doc_id"), held_out(ident).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = written(token_counts(rows.where(~F.col("held_out"))), "token-counts")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))).first()
    frequent = counts.where(F.octet_length("word") > 0).orderBy(F.col("c").desc(), "word").limit(s.known_words).toArrow()
    known, known_counts = frequent.column("word").to_pylist(), frequent.column("c").to_numpy().astype("f8")
    own = min(s.own_words, len(known))
    sums = counts.where(F.octet_length("word") > 0).groupBy(ending_column(F.col("word"), s.endings).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("w")).toArrow()
    class_c, class_w = np.zeros(s.endings), np.zeros(s.endings)
    class_c[sums.column("k").to_numpy()], class_w[sums.column("k").to_numpy()] = sums.column("c").to_numpy(), sums.column("w").to_numpy()
    for w, c in zip(known[:own], known_counts[:own], strict=True):
        class_c[ending(w, s.endings)] -= c
        class_w[ending(w, s.endings)] -= 1
    class_log = np.log10(class_c + 0.5 * (class_w + 1))
    lex = Lexicon({w: i for i, w in enumerate(known)}, known_counts, own, class_log, n, v, float(ends))
    overall = np.concatenate([[ends], known_counts[:own], np.zeros(s.own_words - own), class_c]) + 0.5
    overall /= overall.sum()

    spec = "doc_id long, held_out boolean, shard int, rid long, n_tokens long, known long, base double, within double, symbols binary, rest array<binary>, times array<long>"
    numbered = rows.select("doc_id", "held_out", F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(s.shards))).cast("int").alias("shard"), F.monotonically_increasing_id().alias("rid"), "text")
    held = spark.sparkContext.broadcast(lex)
    path = fresh_path(spark, "encoded")
    numbered.mapInArrow(lambda it: _encode(it, held.value, s), spec).write.partitionBy("shard").parquet(path)
    encoded = spark.read.schema(spec).parquet(path)

    model, kept = Hmm.begin(overall, s), None
    for shard in range(s.shards):
        new = _collected(encoded.where(F.col("shard") == shard), model, s)
        kept = new if kept is None else tuple(0.5 * old + x for old, x in zip(kept, new, strict=True))
        model = Hmm.from_counts(*kept, overall, s)
    model = Hmm.from_counts(*_collected(encoded.where("shard >= 0"), model, s), overall, s)

    seen = encoded.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("rid", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    seen = seen.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    logs = F.array(*[F.lit(float(x)) for x in class_log])
    rest = seen.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / (n + 0.5 * (v + 1)))).alias("rest_base"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - F.get(logs, ending_column(F.col("word"), s.endings)))).alias("rest_within"),
    )
    final = spark.sparkContext.broadcast(model)
    scored = encoded.select("rid", "doc_id", "held_out", "n_tokens", "known", "base", "within", "symbols").mapInArrow(lambda it: _score(it, final.value, s), "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, within double, sequence double")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rest, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("rest_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rest_base")).alias("base_score"), (F.col("sequence") + F.col("within") + zero("rest_within")).alias("score"),
    )
