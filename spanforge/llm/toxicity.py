"""Toxicity by a classifier chain of sparse linear models."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import scratch, written

_WORD = re.compile(r"[^\W_]+")
STEMS = (3, 4, 5)
#: Texts whose features a worker holds at once.
_SLICE = 128


def words_and_stems(text: str | None) -> list[set[str]]:
    """The distinct lower-cased words of letters and digits, and their first three to five characters: rude
    stems take endings, so most of a rude word's forms are rare. Null has none."""
    words = set(_WORD.findall((text or "").lower()))
    return [words, *({w[:n] + "*" for w in words if len(w) > n} for n in STEMS)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        features = pa.array([[f for own in words_and_stems(t.as_py()) for f in own] for t in batch.column(0)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([features, *batch.columns[1:]], ["features", *batch.schema.names[1:]])


def _numbered(batches: Iterator[pa.RecordBatch], names: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        places = [sorted(names[f] for f in x.as_py() if f in names) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.int32())), *batch.columns[1:]], ["places", *batch.schema.names[1:]])


class Sums:
    """Sums of values that come group by group; ``group`` has each value's group, below ``n``, in any order."""

    def __init__(self, group: np.ndarray, n: int):
        sizes = np.bincount(group, minlength=n)
        self.n, self.found = n, np.flatnonzero(sizes)
        self.first = (np.cumsum(sizes) - sizes)[self.found]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.found):
            out[self.found] = np.add.reduceat(values, self.first)
        return out


class Linear:
    """L1-regularised logistic regression over the presence of features, and over a few dense columns."""

    def __init__(self, penalty: float, iterations: int, tolerance: float = 0.0):
        self.penalty, self.iterations, self.tolerance, self.weights, self.bias = penalty, iterations, tolerance, np.zeros(0), 0.0

    def fit(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, n_features: int) -> Linear:
        """rows (ascending), columns: where the presence matrix holds 1; dense: further columns. Accelerated
        proximal gradient steps over columns of unit variance, restarted where they overshoot, until none
        moves a weight by more than ``tolerance`` times the largest."""
        n, width = len(y), n_features + dense.shape[1]
        if not n:
            return self
        share = np.bincount(columns, minlength=n_features)[:n_features] / n
        sd = np.r_[np.sqrt(share * (1 - share)), dense.std(axis=0) if n else []]
        scale = np.where(sd > 1e-9, 1 / np.maximum(sd, 1e-9), 0.0)
        mean = np.r_[share, dense.mean(axis=0)] * scale

        rows, column_of = rows.astype("i4", copy=False), columns.astype("i4", copy=False)
        by_row, in_column = Sums(rows, n), Sums(column_of, n_features)
        row_of = rows[np.argsort(column_of.astype("u2" if n_features < 1 << 16 else "u4"), kind="stable")]

        def times(w: np.ndarray) -> np.ndarray:
            v = w * scale
            return by_row(v[column_of]) + dense @ v[n_features:] - w @ mean

        def back(r: np.ndarray) -> np.ndarray:
            return np.r_[in_column(r[row_of]), dense.T @ r] * scale - mean * r.sum()

        top = np.ones(width) / max(1.0, np.sqrt(width))
        for _ in range(12):
            top = back(times(top))
            norm = np.linalg.norm(top)
            if not norm:
                break
            top /= norm
        step = 1 / (0.25 * max(norm, 1e-9) / n * 1.1 + 0.25)
        base = np.clip(y.mean(), 0.5 / (n + 1), 1 - 0.5 / (n + 1))
        w = ahead = np.zeros(width)
        b = ahead_b = float(np.log(base / (1 - base)))
        t = 1.0
        for self.taken in range(1, self.iterations + 1):
            r = (1 / (1 + np.exp(-np.clip(times(ahead) + ahead_b, -40, 40))) - y) / n
            new = ahead - step * back(r)
            new = np.sign(new) * np.maximum(np.abs(new) - step * self.penalty, 0)
            new_b = ahead_b - step * r.sum()
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            if (ahead - new) @ (new - w) + (ahead_b - new_b) * (new_b - b) > 0:
                t_new = 1.0
            moved = np.abs(new - w).max(initial=0)
            push = (t - 1) / t_new if t_new > 1 else 0.0
            ahead, ahead_b = new + push * (new - w), new_b + push * (new_b - b)
            w, b, t = new, new_b, t_new
            if moved <= self.tolerance * np.abs(w).max(initial=0):
                break
        self.weights, self.bias = w * scale, float(b - w @ mean)
        return self

    def proba(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        k = len(self.weights) - dense.shape[1]
        score = self.bias + np.bincount(rows, self.weights[columns], n) + (dense @ self.weights[k:] if k >= 0 else 0)
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


@dataclass
class ToxicityChain:
    """Predicts ``categories`` in order; each model sees the words and the earlier categories' probabilities.

    While fitting, those probabilities are out-of-fold: of each of ``folds`` parts, by models that haven't
    seen it, so that a later model learns how far the earlier ones are to be trusted on new rows.

    train_rows: the bound of the labelled documents that are used, those with the smallest hash of their id.
    n_features, min_docs: for each category at most so many words and stems, each found in so many of these
    documents at least, those whose shares differ most. Presence counts, not frequency, so a word weighs alike in
    a short and a long text. penalty: of the absolute weights, so that ordinary words get none. iterations,
    tolerance: when a fit ends. threshold: the probability beyond which a document is of a category.

    The fit works on the bounded sample on the driver; counts and scores are made by all executors.
    """

    categories: tuple[str, ...] = ("low_quality", "toxic")
    train_rows: int = 16_000
    folds: int = 4
    n_features: int = 2048
    min_docs: int = 3
    penalty: float = 3e-4
    iterations: int = 300
    tolerance: float = 1e-2
    threshold: float = 0.5
    names: dict[str, int] = field(default_factory=dict, init=False)
    models: list[Linear] = field(default_factory=list, init=False)

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityChain:
        """labels: the id and a 0/1 column for each category. Rows with a null id or label are left out; of
        label rows that share an id the largest labels count, of documents that share one the greatest text, so
        repeated rows weigh once. Null and empty texts train as texts without words, very long ones as a whole;
        other columns, whatever their names, play no part. Without a labelled document (no rows in either
        table, or no common id) every probability is 0."""
        with scratch(docs.sparkSession):
            ys = [f"y{i}" for i in range(len(self.categories))]
            known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), *[F.col(f"`{c}`").cast("double").alias(y) for c, y in zip(self.categories, ys, strict=True)]).dropna()
            known = known.groupBy("id").agg(*[F.max(y).alias(y) for y in ys])
            some = known.orderBy(F.xxhash64("id"), "id").limit(self.train_rows)  # so the broadcast has a bound
            texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
            rows = texts.join(F.broadcast(some), "id").groupBy("id", *ys).agg(F.max("text").alias("text"))
            rows = rows.select("text", "id", *ys, F.pmod(F.xxhash64("id", F.lit(7)), F.lit(self.folds)).cast("int").alias("fold"))
            spec = "id long, " + ", ".join(f"{y} double" for y in ys) + ", fold int"
            rows = written(rows.mapInArrow(_with_features, f"features array<string>, {spec}"), "labelled")
            total = rows.agg(F.count("*"), *[F.sum(y) for y in ys]).first()
            if not total[0]:
                return self
            counts = rows.select(F.explode("features").alias("f"), *ys).groupBy("f").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).where(F.col("n") >= self.min_docs)
            counts = written(counts, "feature-counts")
            for y, ones in zip(ys, total[1:], strict=True):
                gap = F.abs(F.col(y) - F.col("n") * (ones / total[0])) / F.sqrt(F.col("n"))
                for r in counts.orderBy(gap.desc(), "f").limit(self.n_features).select("f").collect():
                    self.names.setdefault(r.f, len(self.names))
            names = self.names
            found = rows.mapInArrow(lambda it: _numbered(it, names), f"places array<int>, {spec}").toArrow()
            found = found.take(pa.array(np.argsort(found.column("id").to_numpy(), kind="stable")))  # the same sums whatever the partitions' order
            places = found.column("places").combine_chunks()
            self._fit(np.diff(places.offsets.to_numpy()), places.flatten().to_numpy(), [found.column(y).to_numpy() for y in ys], found.column("fold").to_numpy())
            return self

    def _fit(self, sizes: np.ndarray, column: np.ndarray, ys: list[np.ndarray], fold: np.ndarray) -> None:
        """sizes: how many features each row has; column: those features, row by row."""
        n, dense = len(sizes), np.zeros((len(sizes), 0))
        row = np.repeat(np.arange(n, dtype="i4"), sizes)
        fresh = lambda: Linear(self.penalty, self.iterations, self.tolerance)
        for k, y in enumerate(ys):
            self.models.append(fresh().fit(row, column, dense, y, len(self.names)))
            if k + 1 == len(ys):
                break
            ahead = np.zeros(n)
            for f in range(self.folds):
                rest = fold != f if (fold != f).any() else fold == f
                at = (np.cumsum(rest) - 1).astype("i4")
                use = rest[row]
                model = fresh().fit(at[row[use]], column[use], dense[rest], y[rest], len(self.names))
                own = fold == f
                ahead[own] = model.proba(row, column, dense, n)[own]
            dense = np.c_[dense, ahead]

    def probabilities(self, text: Column) -> Column:
        """Array of the categories' probabilities, in their order."""
        if not self.models:
            return F.array(*[F.lit(0.0)] * len(self.categories))
        models = self.models
        used = {f: i for f, i in self.names.items() if any(m.weights[i] for m in models)}
        keys = [{f for f in used if not f.endswith("*")}, *({f for f in used if len(f) == n + 1 and f.endswith("*")} for n in STEMS)]

        @F.arrow_udf("array<double>")
        def chain(texts: pa.Array) -> pa.Array:
            found = [[used[f] for own, key in zip(words_and_stems(t.as_py()), keys, strict=True) for f in own & key] for t in texts]
            row, column = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.array([i for x in found for i in x], "i8")
            dense = np.zeros((len(found), 0))
            for m in models:
                dense = np.c_[dense, m.proba(row, column, dense, len(found))]
            ends = np.arange(len(found) + 1, dtype="i4") * dense.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(dense.reshape(-1)))

        return chain(text)

    def transform(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``p_<category>`` doubles and ``is_<category>`` booleans; equal names of ``docs`` are replaced.
        A null or empty text has no words and gets the models' base rates; a text counts as a whole, however
        long. Repeated rows each get theirs; an empty table stays empty, with the new columns."""
        new = [f"p_{c}" for c in self.categories] + [f"is_{c}" for c in self.categories]
        kept = [c for c in docs.columns if c not in new]
        rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], self.probabilities(F.col(f"`{text_col}`").cast("string")).alias("p"))
        ps = [F.get("p", F.lit(i)) for i in range(len(self.categories))]
        out = ps + [p > self.threshold for p in ps]
        return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[x.alias(name) for x, name in zip(out, new, strict=True)])


def chain_labels(labels: DataFrame) -> DataFrame:
    """The labels table's columns as the chain's categories: poor quality first, then toxicity."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, **parameters: object) -> DataFrame:
    """``docs`` that the chain doesn't call toxic, with their own columns.

    Repeated rows share their verdict; null and empty texts have the base rate and stay, unless most labelled
    documents are toxic; without labels, or from an empty table, nothing goes."""
    chain = ToxicityChain(**parameters).fit(docs, labels=chain_labels(labels))
    toxic = F.get(chain.probabilities(F.col("text").cast("string")), F.lit(chain.categories.index("toxic"))) > chain.threshold
    return docs.where(~toxic)
