"""From candidates to fields: bias, winner, alternatives, agreement, review, records.

Candidates: (set_id, field, doc, doc_type, seq, value, score, kind, ...), scores in millionths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import similarity as sim
from spanforge.functions import text as tx
from spanforge.session import by_merge

NEAR_TIE = 50_000
KINDS = ("inline", "adjacent", "pattern_only")
FIELD = ("set_id", "field")


def _position(c: Column, values: Sequence[str]) -> Column:
    """Rank in ``values``; behind all of them if it's none."""
    return F.coalesce(*[F.when(c == v, F.lit(i)) for i, v in enumerate(values)], F.lit(len(values)))


def choose(candidates: DataFrame, expected: Column, expected_rank: Column, precedence: Sequence[str], score: str = "score") -> DataFrame:
    """The winner of each set and field.

    Candidates of expected documents shut out others; of those within five points of the best, the expected
    document's rank decides, then the source's precedence, the kind, the score, and the order of arrival.
    """
    w = Window.partitionBy(*FIELD)
    rows = candidates.withColumns({"_exp": F.coalesce(expected, F.lit(False)), "_rank": expected_rank}).withColumn("_any", F.max("_exp").over(w)).where("_exp = _any")
    rows = rows.withColumn("_best", F.max(score).over(w)).where(F.col("_best") - F.col(score) <= NEAR_TIE)
    order = ["_rank", _position(F.col("doc_type"), precedence), _position(F.col("kind"), KINDS), F.col(score).desc(), "seq"]
    return rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1").drop("_exp", "_rank", "_any", "_best", "_n")


def alternatives(candidates: DataFrame, winners: DataFrame, most: int = 5, score: str = "score") -> DataFrame:
    """(set_id, field, alternatives): of the six best by score the first five without the winner, in order."""
    w = Window.partitionBy(*FIELD).orderBy(F.col(score).desc(), "seq")
    top = candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1)
    rest = top.join(by_merge(winners.select(*FIELD, "seq")), [*FIELD, "seq"], "left_anti")
    items = F.slice(F.sort_array(F.collect_list(F.struct("_n", "value", F.col(score).alias("score")))), 1, most)
    return rest.groupBy(*FIELD).agg(F.transform(items, lambda x: F.struct(x["value"].alias("value"), x["score"].alias("score"))).alias("alternatives"))


def pooled(candidates: DataFrame) -> DataFrame:
    """Each field's candidates together, the best first: the one exchange and sort that ``drop_junk`` and ``winners`` ask for."""
    return candidates.repartition(*FIELD).sortWithinPartitions(*FIELD, F.desc("score"), "seq")


def winners(candidates: DataFrame, expected: Column, precedence: Sequence[str], keep: Sequence[str], most: int = 5) -> DataFrame:
    """(*FIELD, *keep, alternatives): ``choose`` and ``alternatives`` at once, in windows over the order of ``pooled``, where the two by themselves
    take a sort for each window, a grouping and a join. ``alternatives`` is null without any."""
    w = Window.partitionBy(*FIELD)
    by_score = w.orderBy(F.desc("score"), "seq")
    item = F.struct("value", "score", "seq")
    top = F.array(item, *[F.lead(item, i).over(by_score) for i in range(1, most + 1)])
    rows = candidates.withColumns({"_k": F.row_number().over(by_score), "_top": top, "_exp": F.coalesce(expected, F.lit(False))})
    # candidates of expected documents shut out others
    rows = rows.withColumns({"_any": F.max("_exp").over(w), "_best": F.coalesce(F.max(F.when(F.col("_exp"), F.col("score"))).over(w), F.max("score").over(w))})
    near = (F.col("_exp") == F.col("_any")) & (F.col("_best") - F.col("score") <= NEAR_TIE)
    order = [_position(F.col("doc_type"), precedence).alias("_p"), _position(F.col("kind"), KINDS).alias("_q"), (-F.col("score")).alias("_s"), F.col("seq").alias("_seq")]
    won = rows.withColumn("_w", F.min(F.when(near, F.struct(*order, *keep))).over(w)).where("_k = 1")
    rest = F.slice(F.filter("_top", lambda x: x.isNotNull() & (x["seq"] != F.col("_w._seq"))), 1, most)
    found = won.select(*FIELD, "_w", rest.alias("_r"))
    items = F.when(F.size("_r") > 0, F.transform("_r", lambda x: F.struct(x["value"].alias("value"), x["score"].alias("score"))))
    return found.select(*FIELD, *[F.col(f"_w.{c}").alias(c) for c in keep], items.alias("alternatives"))


def best_per_document(candidates: DataFrame, score: str = "score") -> DataFrame:
    w = Window.partitionBy(*FIELD, "doc").orderBy(F.col(score).desc(), "seq")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def consistency(candidates: DataFrame, threshold: int = 85, score: str = "score") -> DataFrame:
    """(set_id, field, docs, consistency, disagreements): each document's best value against each other's.

    Values agree at an indel ratio of ``threshold`` or more. A set's documents are few, so its pairs are too.
    """
    best = best_per_document(candidates, score).select(*FIELD, "doc", "value")
    a, b = best.withColumnsRenamed({"doc": "d1", "value": "v1"}), best.withColumnsRenamed({"doc": "d2", "value": "v2"})
    pairs = a.join(by_merge(b), [*FIELD]).where("d1 < d2").withColumn("bad", (F.lower("v1") != F.lower("v2")) & (sim.ratio_micro(F.lower("v1"), F.lower("v2")) < threshold * 1_000_000))
    bad = pairs.groupBy(*FIELD).agg(F.count_if("bad").alias("disagreements"))
    docs = best.groupBy(*FIELD).agg(F.count("*").alias("docs"))
    rows = docs.join(by_merge(bad), [*FIELD], "left").withColumn("disagreements", F.coalesce("disagreements", F.lit(0)))
    verdict = F.when(F.col("docs") == 1, "single_source").when(F.col("disagreements") > 0, "inconsistent").otherwise("consistent")
    return rows.select(*FIELD, "docs", verdict.alias("consistency"), "disagreements")


def review(results: DataFrame, required: Sequence[str], low: int | Column = 500_000) -> DataFrame:
    """(set_id, field, reason, severity): one branch for each reason, appended, never deduplicated.

    results: (set_id, field, value, score, status, consistency); status and consistency may be null.
    """
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    branches = [
        (blank & F.col("field").isin(*required), "missing_required_field", "error"),
        (~blank & (F.col("status") == "invalid"), "failed_validation", "error"),
        (~blank & (F.col("status") == "warning"), "validation_warning", "warning"),
        (~blank & (F.col("score") < low), "low_confidence", "warning"),
        (F.col("consistency") == "inconsistent", "cross_document_mismatch", "warning"),
    ]
    flags = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(r).alias("reason"), F.lit(s).alias("severity"))) for test, r, s in branches]))
    return results.select(*FIELD, F.explode(flags).alias("f")).select(*FIELD, "f.*")


def summary(results: DataFrame, flagged: DataFrame) -> DataFrame:
    """Counts for each set and the rate of filled fields in tenths of a percent."""
    filled = F.count_if(F.coalesce(F.trim("value"), F.lit("")) != "")
    base = results.groupBy("set_id").agg(F.count("*").alias("total"), filled.alias("filled"), F.count_if(F.col("status") == "valid").alias("valid"))
    n = flagged.groupBy("set_id").agg(F.count("*").alias("review"))
    rows = base.join(by_merge(n), "set_id", "left").withColumn("review", F.coalesce("review", F.lit(0)))
    return rows.withColumns({"empty": F.col("total") - F.col("filled"), "fill_rate": F.floor(F.col("filled") * 1000 / F.col("total")).cast("long")})


def canonical(results: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One wide record a set; the fields are given, so no job looks for them."""
    return results.groupBy("set_id").pivot("field", list(fields)).agg(F.first("value"))


def drop_junk(candidates: DataFrame, junk: Column) -> DataFrame:
    """Without junk values, unless a field has nothing else."""
    w = Window.partitionBy(*FIELD)
    rows = candidates.withColumn("_junk", F.coalesce(junk, F.lit(False))).withColumn("_every", F.bool_and("_junk").over(w))
    return rows.where("NOT _junk OR _every").drop("_junk", "_every")


# Words that begin captions of certificates, classes of enterprises that stand below a name's caption; the length from
# which a text is compared with captions, the words of a caption at most, and the ratios of a caption and of a part of it.
LEAD_WORDS = ("date", "period", "type", "nature", "particulars", "category", "constitution", "jurisdictional", "registration", "validity", "address")
CLASS_WORDS = ("micro", "small", "medium", "micro enterprise", "small enterprise", "medium enterprise", "micro enterprises", "small enterprises", "medium enterprises")
LEAK_CHARS, LEAD_MOST, LEAK_RATIO, LEAK_PART = 8, 8, 88_000_000, 90.0


def caption_leaks(values: Column, labels: Sequence[str], class_words: Sequence[str] = CLASS_WORDS, lead_words: Sequence[str] = LEAD_WORDS) -> Column:
    """For each of ``values`` whether it is a caption taken for a value: it ends in "if any"; cleaned, it is a class word; begins
    with a lead word and has eight words at most; or, with eight characters and more, is within 88 of a dictionary caption of that
    length, or within 90 of a part of one or has one as such a part."""
    known = sorted({x.lower().strip() for x in labels if len(x.strip()) >= LEAK_CHARS})

    def told(value: Column, low: Column) -> Column:
        words, bare = F.split(low, " "), tx.strip(value)
        sure = bare.rlike(r"(?i),?\s*if\s+any\s*$") | low.isin(*class_words) | (F.get(words, F.lit(0)).isin(*lead_words) & (F.size(words) <= LEAD_MOST))
        return F.struct(F.coalesce((bare != "") & sure, F.lit(False)).alias("sure"), F.when((bare != "") & (F.length(low) >= LEAK_CHARS), low).alias("low"))

    return sim.near_any(F.zip_with(values, F.transform(values, tx.clean_label), told), known, LEAK_RATIO, LEAK_PART)


def caption_leak(value: Column, labels: Sequence[str], class_words: Sequence[str] = CLASS_WORDS, lead_words: Sequence[str] = LEAD_WORDS) -> Column:
    """``caption_leaks`` of one value."""
    return F.get(caption_leaks(F.array(value), labels, class_words, lead_words), F.lit(0))


def best_text(values: Column, leaks: Column) -> tuple[Column, Column]:
    """(the first of ``values`` that is neither blank nor a leak, else blank, whether it isn't the first of all)."""
    good = F.filter(values, lambda v, i: v.isNotNull() & (F.trim(v) != "") & ~F.get(leaks, i))
    first = F.get(good, F.lit(0))
    return F.coalesce(first, F.lit("")), first.isNotNull() & ~first.eqNullSafe(F.get(values, F.lit(0)))


def without_leaks(results: DataFrame, fields: Sequence[str], labels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(results, flags): text fields whose value is a caption take their best alternative that is none, else become blank; a
    value from an alternative is flagged. results: (set_id, field, value, alternatives, ..)."""
    told = F.col("field").isin(*fields) & F.col("value").isNotNull()
    every = F.concat(F.array("value"), F.coalesce(F.transform("alternatives", lambda a: a["value"]), F.array().cast("array<string>")))
    rows = results.withColumn("_v", F.when(told, every)).withColumn("_l", caption_leaks(F.col("_v"), labels))
    best, other = best_text(F.col("_v"), F.col("_l"))
    rows = rows.withColumn("_b", F.when(told, F.struct(best.alias("value"), other.alias("other")))).drop("_v", "_l")
    flags = rows.where("_b.other").select(*FIELD, F.lit("caption_instead_of_value").alias("reason"), F.lit("warning").alias("severity"))
    return rows.withColumn("value", F.when(told, F.col("_b.value")).otherwise(F.col("value"))).drop("_b"), flags
