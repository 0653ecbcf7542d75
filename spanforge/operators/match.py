"""Captions, values beside them, patterns, and the candidates' scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import similarity as sim
from spanforge.functions import text as tx
from spanforge.session import few_or_merged, settled

# Fixed values, in millionths: weights, bonuses of a candidate's kind, penalties in percent.
WEIGHTS = {"label": 350_000, "proximity": 250_000, "pattern": 300_000, "confidence": 100_000}
KIND_BONUS = {"inline": 300_000, "adjacent_same_line": 180_000, "adjacent": 0, "pattern_only": -100_000}
LABEL_LIKE, FOREIGN, SHORT = 55, 40, 50


@dataclass(frozen=True)
class FieldSpec:
    key: str
    labels: Sequence[str] = ()
    patterns: Sequence[str] = ()
    normalization: Sequence[str] = ("collapse_spaces",)
    expected_documents: Sequence[str] = ()
    min_similarity: float = 0.86
    max_label_chars: int = 60
    exclude: Sequence[str] = ()
    aliases: Sequence[tuple[str, str]] = field(default_factory=tuple)
    value_type: str = "text"
    directions: Sequence[str] = ("right", "below")
    max_distance: float = 4.0
    min_accept: float = 0.6
    validators: Sequence[str] = ()
    default: str | None = None
    derive_from: str | None = None  # the field whose e-mail address gives this one
    priority: int = 50
    required: bool = False
    consistent: bool = False
    junk: Sequence[str] = ()


def min_similarity(label: Column, base: float | Column) -> Column:
    """Short captions must match better: 0.97 up to four characters, 0.92 up to six."""
    base = base if isinstance(base, Column) else F.lit(base)
    return F.when(F.length(label) <= 4, F.greatest(base, F.lit(0.97))).when(F.length(label) <= 6, F.greatest(base, F.lit(0.92))).otherwise(base)


def label_table(spark, specs: Sequence[FieldSpec]) -> DataFrame:
    """dim (field, label_ord, label, threshold): the dictionary's cleaned captions; its size is the configuration's."""
    rows = [F.struct(F.lit(s.key).alias("field"), F.lit(i).alias("label_ord"), tx.clean_label(F.lit(x)).alias("label"), F.lit(s.min_similarity).alias("base"), F.lit(s.max_label_chars).alias("max_chars")) for s in specs for i, x in enumerate(s.labels)]
    dim = spark.range(1).select(F.inline(F.array(*rows))).where("label <> ''")
    return dim.withColumn("threshold", (min_similarity(F.col("label"), F.col("base")) * 1_000_000).cast("long"))


def of_near_length(labels: DataFrame, least: Column) -> DataFrame:
    """``labels`` once for each ``length`` of a text that can reach the indel ratio ``least`` (of 1) with them."""
    n = F.length("label")
    low, high = F.ceil(n * least / (2 - least) - 1e-9), F.floor(n * (2 - least) / least + 1e-9)
    return labels.withColumn("length", F.explode(F.sequence(F.greatest(low, F.lit(1)).cast("int"), high.cast("int"))))


def whole_captions(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``texts(t, key)`` that are a caption as a whole: (t, field, label_ord, label, similarity). An equi-join by length, as
    the ratio of texts bounds their lengths; letters in common rule more pairs out before the ratio is worked out."""
    near = of_near_length(labels, F.col("threshold") / 1_000_000)
    pairs = texts.withColumn("length", F.length("key")).join(near, "length").where(F.length("t") <= 3 * F.col("max_chars"))
    pairs = pairs.where(F.lit(2_000_000).cast("long") * sim.shared_letters(F.col("key"), F.col("label")) >= F.col("threshold") * (F.length("key") + F.length("label")))
    scored = pairs.withColumn("similarity", F.floor(sim.ratio_micro(F.col("key"), F.col("label")) / 100).cast("long"))
    return scored.where("similarity >= threshold").select("t", "field", "label_ord", "label", "similarity")


def is_inline_split(tail: Column, remainder: Column, patterns: Sequence[str]) -> Column:
    """A separator after the caption, or a value of the field's shape; a dot before a digit separates nothing."""
    shape = tx.full_match(remainder, *patterns) if patterns else F.lit(False)
    return ~tail.rlike(r"\A\.\s*[0-9]") & (tail.rlike(r"\A\s*[:\-–—=|>]") | F.ltrim(tail).startswith(".") | shape)


def by_priority(specs: Sequence[FieldSpec]) -> list[FieldSpec]:
    """The largest priority first; equal ones as given."""
    return sorted(specs, key=lambda s: -s.priority)


def wrap_separator(prev: Column, row: Column) -> Column:
    """Between wrapped rows: a comma if the row before has two of its own, doesn't end in a separator, and the next one
    doesn't begin with one."""
    commas = F.length(prev) - F.length(F.replace(prev, F.lit(","), F.lit("")))
    return F.when((commas >= 2) & ~prev.rlike(r"[,;–—]\s*\z") & ~row.rlike(r"\A\s*([,;]|\z)"), ", ").otherwise(" ")


def label_like(texts: DataFrame, specs: Sequence[FieldSpec], at_least: int = 88, repeated: bool = True) -> DataFrame:
    """(key): those of ``texts(key)``, cleaned, that are within ``at_least`` of any field's caption. Texts, distinct ones if they are
    ``repeated``, meet captions of near lengths in an equi-join."""
    known = sorted({x.lower().strip() for s in specs for x in s.labels} - {""})
    labels = texts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in known]).cast("array<string>")).alias("label"))
    keys = texts.where("key <> ''").select("key")
    pairs = (keys.distinct() if repeated else keys).withColumn("length", F.length("key")).join(of_near_length(labels, F.lit(at_least / 100)), "length")
    pairs = pairs.where(200 * sim.shared_letters(F.col("key"), F.col("label")) >= at_least * (F.length("key") + F.length("label")))
    return pairs.where(sim.ratio_micro(F.col("key"), F.col("label")) >= at_least * 1_000_000).select("key").distinct()


def without_excluded(rows: DataFrame, specs: Sequence[FieldSpec], value: str = "value") -> DataFrame:
    """Without values in which one of their field's exclusion patterns is found."""
    tests = [(F.col("field") == s.key) & F.col(value).rlike(p) for s in specs for p in s.exclude]
    return rows.where(~F.coalesce(reduce(Column.__or__, tests, F.lit(False)), F.lit(False)))


def derive_value(raw: Column, spec: FieldSpec) -> Column:
    """struct(value, matched): the first bounded match in the raw text, then in the normalised one, then that as a whole; else the text. Either
    is normalised and goes by its alias."""
    named = lambda value: tx.canonicalize(value, spec.aliases) if spec.aliases else value
    told = lambda value, matched: F.struct(named(value).alias("value"), F.lit(matched).alias("matched"))
    if not spec.patterns:
        return tx.bind(tx.normalize(raw, spec.normalization), lambda clean: told(clean, False))
    alternatives = "|".join(spec.patterns)
    # what has a pattern nowhere, as most texts, has no match of any kind
    first = lambda c: F.when(c.rlike(alternatives), tx.first_bounded_or_glued(c, alternatives))
    normal = lambda c: tx.normalize(c, spec.normalization)
    found = lambda value, rest: tx.bind(value, lambda f: F.when(f.isNotNull(), told(normal(f), True)).otherwise(rest))
    whole = lambda clean: F.when(tx.full_match(clean, *spec.patterns), clean)
    return found(first(raw), tx.bind(normal(raw), lambda clean: found(F.coalesce(first(clean), whole(clean)), told(clean, False))))


def derived_values(rows: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """``rows(field, raw, ..)`` with value and matched, worked out once a row: a generator gives them, as the optimizer repeats plain
    expressions wherever a filter names them. A lambda holds them: as plain expressions they make a method that is too long to be compiled."""
    each = lambda raw: [F.when(F.col("field") == s.key, derive_value(raw, s)) for s in specs]
    none = F.struct(F.lit("").alias("value"), F.lit(False).alias("matched"))
    return rows.select("*", F.inline(F.transform(F.array("raw"), lambda raw: F.coalesce(*each(raw), none))))


def foreign_field(value: Column, field_name: Column, specs: Sequence[FieldSpec]) -> Column:
    """The first other field whose pattern the value has; for fields without patterns."""
    own = F.coalesce(*[F.when(field_name == s.key, F.lit(bool(s.patterns))) for s in specs], F.lit(False))
    other = F.coalesce(*[F.when((field_name != s.key) & tx.full_match(value, *s.patterns), F.lit(s.key)) for s in specs if s.patterns], F.lit(None).cast("string"))
    return F.when(~own, other)


def pattern_hits(spans: DataFrame, specs: Sequence[FieldSpec], on: list[str]) -> DataFrame:
    """(*on, field, value): bounded matches of every field's patterns, glued ones where there are none; excluded values
    are left out."""
    has = {s.key: F.col("text").rlike("|".join(s.patterns)) for s in specs if s.patterns}
    own = lambda t, s, p: F.when(t.rlike(p), F.struct(F.lit(s.key).alias("field"), F.array_distinct(tx.bounded_or_glued_matches(t, p)).alias("values")))
    each = lambda t: F.array_compact(F.array(*[own(t, s, "|".join(s.patterns)) for s in specs if s.patterns]))
    if not has:
        return spans.select(*on, F.lit("").alias("field"), F.lit("").alias("value")).where("false")
    # a text that has a pattern nowhere, as most captions, goes no further
    some = spans.where(reduce(Column.__or__, has.values()))
    found = some.select(*on, F.explode(tx.bind(F.col("text"), each)).alias("f")).select(*on, "f.field", F.explode("f.values").alias("value"))
    return without_excluded(found, specs)


def score(label: Column, proximity: Column, pattern_matched: Column, has_patterns: Column, confidence: Column, kind: Column, same_line: Column, expected: Column, label_like: Column, foreign: Column, short: Column) -> Column:
    """A candidate's score in millionths; similarity, proximity and confidence come in millionths too.

    expected: true, false or null (no expectation). Weighted parts, the kind's bonus, five points either way for
    the document, then the penalties one after another, within 0 and 1.
    """
    pattern = F.when(pattern_matched, 1_000_000).when(~has_patterns, 500_000).otherwise(0)
    parts = {"label": label, "proximity": proximity, "pattern": pattern, "confidence": confidence}
    total = sum((F.floor(c.cast("long") * WEIGHTS[k] / 1_000_000).cast("long") for k, c in parts.items()), F.lit(0).cast("long"))
    named = F.when((kind == "adjacent") & same_line, "adjacent_same_line").otherwise(kind)
    total = total + F.coalesce(*[F.when(named == k, F.lit(v)) for k, v in KIND_BONUS.items()], F.lit(0))
    total = total + F.when(expected.isNull(), 0).when(expected, 50_000).otherwise(-50_000)
    # each names what is before it once; a fold would too, but isn't compiled
    for test, percent in ((label_like, LABEL_LIKE), (foreign, FOREIGN), (short, SHORT)):
        total = F.floor(total * F.when(test, percent).otherwise(100) / 100).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(1_000_000), total)).cast("long")


def classify(documents: DataFrame, keywords: Sequence[tuple[str, str, str]], min_score: int = 10, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """(key, doc_type, score): keywords are (profile, 'content' or 'filename', word); a hit counts 20 or 10 tenths.
    ``layout.first_pages_text`` gives the texts that tell.

    The best profile, the first in order at a tie, or ``other`` below ``min_score``. documents: (key, name, text).
    """
    order = list(dict.fromkeys(p for p, _, _ in keywords))
    text, name = F.lower("text"), F.lower("name")
    if not order:
        return documents.select(*([key] if isinstance(key, str) else key), F.lit("other").alias("doc_type"), F.lit(0).alias("score"))
    scores = [F.struct(sum((F.when((text if where == "content" else name).contains(word.lower()), 20 if where == "content" else 10).otherwise(0) for q, where, word in keywords if q == p), F.lit(0)).alias("score"), F.lit(-i).alias("seq"), F.lit(p).alias("profile")) for i, p in enumerate(order)]
    best = F.array_max(F.array(*scores))
    keys = [key] if isinstance(key, str) else list(key)
    return documents.select(*keys, best.alias("b")).select(*keys, F.when(F.col("b.score") >= min_score, F.col("b.profile")).otherwise("other").alias("doc_type"), F.coalesce("b.score", F.lit(0)).alias("score"))


#: Lengths of the pieces of captions that are looked up; captions in shorter pieces meet every text.
GRAMS = (2, 3)


def caption_grams(labels: DataFrame) -> DataFrame:
    """``labels`` once for each (gram, at) of which a text that begins with the caption has one at least.

    A window that reaches the threshold differs from the caption by d insertions and deletions at most, so of d + 1 pieces
    of the caption one is in it whole, moved by d at most; the window begins within the first three characters.
    """
    n = F.length("label")
    d = F.floor((1 - F.col("threshold") / 1_000_000) * 2 * n + 1e-9).cast("int")
    piece = labels.withColumns({"_d": d, "_i": F.explode(F.sequence(F.lit(0), d))}).withColumns({"_a": F.expr("_i * length(label) div (_d + 1)").cast("int"), "_b": F.expr("(_i + 1) * length(label) div (_d + 1)").cast("int")})
    size = F.least(F.col("_b") - F.col("_a"), F.lit(max(GRAMS)))
    sought = size >= min(GRAMS)
    gram = F.when(sought, F.substring("label", F.col("_a") + 1, size)).otherwise("")
    spots = F.when(sought, F.sequence(F.greatest(F.col("_a") - F.col("_d"), F.lit(0)), F.col("_a") + F.col("_d") + 2)).otherwise(F.array(F.lit(0)))
    return piece.select(*labels.columns, gram.alias("gram"), F.explode(spots).alias("at")).distinct()


def text_grams(texts: DataFrame, reach: int) -> DataFrame:
    """``texts`` with each gram of the first ``reach`` characters of ``low`` and its place; and once with none, at 0."""
    spots = F.sequence(F.lit(0), F.least(F.length("low"), F.lit(reach)))
    of = lambda g: lambda i: F.struct(F.substring(F.col("low"), i + 1, F.lit(g)).alias("gram"), i.alias("at"))
    every = [F.transform(spots, of(g)) for g in GRAMS]
    none = F.array(F.struct(F.lit("").alias("gram"), F.lit(0).alias("at")))
    return texts.select(*texts.columns, F.inline(F.array_distinct(F.concat(none, *every))))


def can_split(t: Column, specs: Sequence[FieldSpec]) -> Column:
    """Whether a text has what ``is_inline_split`` wants: a separator, or a value of some field's shape behind something else."""
    shapes = [p for s in specs for p in s.patterns]
    found = t.rlike(r"[:\-–—=|>.]")
    return found | t.rlike(f"(?s).(?:{'|'.join(shapes)})\\s*\\z") if shapes else found


def own_captions(field: Column, specs: Sequence[FieldSpec]) -> Column:
    """array of struct(label_ord, label, threshold, max_chars): the captions of a row's field, constants of the configuration."""
    label = lambda x: tx.clean_label(F.lit(x))
    each = {s.key: [F.struct(F.lit(i).alias("label_ord"), label(x).alias("label"), (min_similarity(label(x), s.min_similarity) * 1_000_000).cast("long").alias("threshold"), F.lit(s.max_label_chars).alias("max_chars")) for i, x in enumerate(s.labels)] for s in specs}
    return F.coalesce(*[F.when(field == k, F.array(*v)) for k, v in each.items() if v], F.lit(None).cast("array<struct<label_ord: int, label: string, threshold: bigint, max_chars: int>>"))


def prefixed(texts: DataFrame, specs: Sequence[FieldSpec], max_chars: bool = True) -> DataFrame:
    """Texts ``t`` that begin with a caption and go on with a value: (*texts, field, label_ord, label, similarity, raw).

    If ``texts``, distinct then, has a ``field``, only that field's few captions count, and each text meets them in its row. Else captions
    are looked up by pieces of theirs and where these stand in the text, so texts and captions meet in an equi-join. Pairs
    with enough letters in common are aligned.
    """
    own = "field" in texts.columns
    low = texts.withColumn("low", F.lower("t")).where((F.length("t") > 1) & can_split(F.col("t"), specs))
    if own:
        pairs = low.select("*", F.inline(own_captions(F.col("field"), specs))).where("label <> ''")
    else:
        labels = label_table(texts.sparkSession, specs)
        reach = 2 * max((len(x) for s in specs for x in s.labels), default=0) + 4
        pairs = text_grams(low, reach).join(caption_grams(labels), ["gram", "at"])
    pairs = pairs.where(F.length("t") > F.length("label"))
    if max_chars:
        pairs = pairs.where(F.length("t") <= 3 * F.col("max_chars"))
    shared = sim.shared_letters(F.expr("substring(low, 1, length(label) + 2)"), F.col("label"))
    pairs = pairs.where(2_000_000 * shared >= F.col("threshold") * (F.length("label") + shared))
    if not own:
        pairs = pairs.drop("gram", "at").dropDuplicates([*texts.columns, "field", "label_ord"])
    hits = pairs.withColumn("a", sim.aligned(F.col("label"), F.col("low"), (F.col("threshold") - 0.001) / 10_000)).where("a.dest_start <= 2")
    hits = hits.withColumn("similarity", F.floor(F.col("a.score") * 10_000 + 0.001).cast("long")).where("similarity >= threshold")
    hits = hits.withColumn("tail", F.expr("substring(t, a.dest_end + 1)")).withColumn("raw", tx.strip_value_prefix(F.col("tail"))).where("raw <> ''")
    split = F.coalesce(*[F.when(F.col("field") == s.key, is_inline_split(F.col("tail"), F.col("raw"), s.patterns)) for s in specs])
    return hits.where(split).select(*texts.columns, *([] if own else ["field"]), "label_ord", "label", "similarity", "raw")


def text_hits(texts: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """(t, field, label, similarity, raw) of stripped ``texts(t)``, with their cleaned ``key``, that are a field's caption (raw is empty) or begin with one.

    They meet the dictionary. Of a field's captions, in their order, a later one replaces the best so
    far if it fits better; one with a value behind it also if it is longer and fits within two points.
    """
    whole = whole_captions(texts, label_table(texts.sparkSession, specs))
    columns = ["t", "field", "label_ord", "raw", "label", "similarity"]
    every = whole.withColumn("raw", F.lit("")).select(columns).unionByName(prefixed(texts.select("t"), specs).select(columns))
    each = every.groupBy("t", "field").agg(F.sort_array(F.collect_list(F.struct("label_ord", "raw", "label", "similarity"))).alias("all"))
    longer = lambda b, x: (x["raw"] != "") & (x["similarity"] >= b["similarity"] - 20_000) & (F.length(x["label"]) > F.length(b["label"]))
    best = F.aggregate(F.col("all"), F.get("all", F.lit(0)), lambda b, x: F.when((x["similarity"] > b["similarity"]) | longer(b, x), x).otherwise(b))
    return each.select("t", "field", best.alias("b")).select("t", "field", "b.label", "b.similarity", "b.raw")


def label_hits(spans: DataFrame, specs: Sequence[FieldSpec], on: list[str]) -> DataFrame:
    """(*on, field, label, similarity, raw): ``text_hits`` of the spans."""
    # a table, so that what is asked of a text is asked of each distinct one once, and not of each span
    texts = settled(spans.select(tx.strip(F.col("text")).alias("t")).where("t <> ''").distinct())
    each = text_hits(texts.withColumn("key", tx.clean_label(F.col("t"))), specs)
    return spans.withColumn("t", tx.strip(F.col("text"))).join(each.hint("shuffle_hash"), "t").select(*on, "field", "label", "similarity", "raw")


def own_labels(values: DataFrame, specs: Sequence[FieldSpec], passes: int = 2) -> DataFrame | None:
    """(field, t, bare): of distinct, stripped ``values(field, t)`` those that begin with a caption of their own field, without it, twice at most;
    of several that fit, the one goes that leaves least. For a join on its other side; None if there are none."""
    found, asked = None, values
    for _ in range(passes):
        hits = prefixed(asked, specs, max_chars=False)
        least = hits.groupBy("field", "t").agg(F.min_by("raw", F.struct(F.length("raw"), "label_ord")).alias("bare")).where(F.length("bare") < F.length("t"))
        # a table, as the plan of each pass would hold that of the pass before; what a pass leaves alone the next one would too
        more = few_or_merged(least)
        if more is None:
            break
        if found is not None:
            again = found.withColumnRenamed("bare", "_b").join(more.withColumnsRenamed({"t": "_b", "bare": "_c"}), ["field", "_b"], "left")
            more = few_or_merged(again.select("field", "t", F.coalesce("_c", "_b").alias("bare")))
        found, asked = more, more.select("field", F.col("bare").alias("t")).distinct()
    return found


def strip_own_labels(values: DataFrame, specs: Sequence[FieldSpec], passes: int = 2) -> DataFrame:
    """``values(field, text)``, distinct -> (field, text, bare): without a caption of its own field at the start."""
    rows = values.select("field", "text", tx.strip(F.col("text")).alias("t"))
    found = own_labels(rows.select("field", "t").distinct(), specs, passes)
    rows = rows.withColumn("bare", F.col("t")) if found is None else rows.join(found, ["field", "t"], "left").withColumn("bare", F.coalesce("bare", "t"))
    return rows.select("field", "text", "bare")


def _onward(row: list[tuple], first: tuple, unit: float) -> str:
    """``first`` and what follows on its row, up to the first gap beyond 1.2 units or the first caption."""
    parts, right = [first[1]], first[4]
    for t in row:
        if t[2] <= first[2] or t[0] == first[0]:
            continue
        if (t[2] - right) / unit > 1.2 or t[7]:
            break
        parts.append(t[1])
        right = t[4]
    return " ".join(parts)


def join_wrapped(page: list[tuple], *starts: int, lined: bool = True) -> str | list[str]:
    """The values that begin at the spans ``starts``: each its row onward, then rows below.

    page: (ord, text, x1, y1, x2, y2, line, caption); lines that aren't ``lined`` are told as by ``layout.page_lines``. A row goes on with
    the value while it lies within 1.6 heights of the row before, begins within two heights of the value's left edge, and doesn't begin
    with a caption.
    """
    rows: dict[int, list[tuple]] = {}
    if lined:
        for t in sorted(page, key=itemgetter(2, 0)):
            rows.setdefault(t[6], []).append(t)
        rows = dict(sorted(rows.items()))
    else:
        rows = dict(enumerate(sorted(row, key=itemgetter(2, 0)) if len(row) > 1 else row for row in _lines(page)))
    lines = [(r[0][3], r[0][5], r) if len(r) == 1 else (min(t[3] for t in r), max(t[5] for t in r), r) for r in rows.values()]
    at = {t[0]: (r, t) for r in rows.values() for t in r}
    out = [_wrapped_value(lines, *at[s]) for s in starts]
    return out[0] if len(starts) == 1 else out


def _lines(page: list[tuple]) -> list[list[tuple]]:
    """A page's spans by line, from the top."""
    high = sorted([t[5] - t[3] for t in page if t[5] > t[3]])
    tol = max(0.6 * (0.5 * high[(len(high) - 1) // 2] + 0.5 * high[len(high) // 2]), 1.0) if high else 1.0
    sums, means, rows = [], [], []
    for t in sorted(page, key=itemgetter(3, 2, 0)):
        centre = (t[3] + t[5]) / 2
        for i, mean in enumerate(means):
            if abs(centre - mean) <= tol:
                rows[i].append(t)
                sums[i] += centre
                means[i] = sums[i] / len(rows[i])
                break
        else:
            rows.append([t])
            sums.append(centre)
            means.append(centre)
    # each begins with its upper edge, as spans come by it: lines stand in this order already
    return rows


def _wrapped_value(lines: list[tuple], own: list[tuple], first: tuple) -> str:
    unit = first[5] - first[3] if first[5] > first[3] else 1.0
    value = before = _onward(own, first, unit)
    bottom, centre = first[5], (first[3] + first[5]) / 2
    for top, end, row in lines:
        if (top + end) / 2 <= centre:
            continue
        begin = [t for t in row if t[2] <= first[2] + 2 * unit]
        if (top - bottom) / unit > 1.6 or not begin or abs(begin[0][2] - first[2]) > 2 * unit or begin[0][7]:
            break
        more = _onward(row, begin[0], unit)
        listed = before.count(",") >= 2 and before.rstrip()[-1:] not in (",", ";", "–", "—") and more.lstrip()[:1] not in ("", ",", ";")
        value, before = value + (", " if listed else " ") + more, more
        bottom, centre = end, (top + end) / 2
    return value


def _cells(column: pa.Array) -> list:
    """As ``to_pylist``, which walks cell by cell, where none is null."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _wrapped(batches: Iterator[pa.RecordBatch], n: int, lined: bool) -> Iterator[pa.RecordBatch]:
    """Rows (*on, ord, text, x1, y1, x2, y2, line, caption, start) come page by page; ``n`` columns name the page. Starts are rows without text."""

    def values(pages: list[tuple[tuple, list[tuple], list]], schema: pa.Schema) -> pa.RecordBatch:
        out = []
        for key, page, starts in pages:
            known = {t[0] for t in page}
            starts = [s for s in starts if s in known]
            if starts:
                found = join_wrapped(page, *starts, lined=lined)
                out += [(*key, s, v) for s, v in zip(starts, [found] if len(starts) == 1 else found, strict=True)]
        fields = pa.schema([*(schema.field(i) for i in range(n + 1)), ("value", pa.string())])
        columns = zip(*out, strict=True) if out else [[] for _ in fields]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    pages: list[tuple[tuple, list[tuple], list]] = []
    for batch in batches:
        cells = [_cells(c) for c in batch.columns]
        for key, t, start in zip(zip(*cells[:n], strict=True), zip(*cells[n:-1], strict=True), cells[-1], strict=True):
            if not pages or pages[-1][0] != key:
                pages.append((key, [], []))
            if start:
                pages[-1][2].append(t[0])
            else:
                pages[-1][1].append(t)
        schema = batch.schema
        # the last page may go on in the next batch
        yield values(pages[:-1], schema)
        pages = pages[-1:]
    if pages:
        yield values(pages, schema)


def wrapped_values(spans: DataFrame, starts: DataFrame, on: list[str]) -> DataFrame:
    """(*on, ord, value): spans (*on, ord, text, x1, y1, x2, y2, caption boolean), with their line or it is worked out, starts (*on, ord).
    Both are spread by their page once, and pages pass by one at a time; those without a start go no further."""
    lined = "line" in spans.columns
    spans = spans if lined else spans.withColumn("line", F.lit(0))
    columns = [*on, "ord", "text", "x1", "y1", "x2", "y2", "line", "caption"]
    kinds = dict(spans.dtypes)
    none = {"text": F.lit(""), "caption": F.lit(False)}
    begun = starts.select(*on, "ord").distinct().select(*[none.get(c, F.col(c) if c in (*on, "ord") else F.lit(0)).cast(kinds[c]).alias(c) for c in columns], F.lit(True).alias("start"))
    rows = spans.select(*columns, F.lit(False).alias("start")).unionByName(begun).repartition(*on).sortWithinPartitions(*on, "ord", "start")
    marked = rows.withColumn("_any", F.bool_or("start").over(Window.partitionBy(*on))).where("_any").drop("_any")
    spec = ", ".join(f"`{c}` {kinds[c]}" for c in on) + f", ord {kinds['ord']}, value string"
    return marked.mapInArrow(lambda it: _wrapped(it, len(on), lined), spec)
