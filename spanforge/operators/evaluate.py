"""Scoring against ground truth: five-way verdicts, their rates, address blocks, partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import similarity as sim
from spanforge.functions import text as tx
from spanforge.operators import address as ad
from spanforge.session import settled

VERDICTS = ("wrong", "hallucinated", "missed", "correct", "correctly_absent")


def verdict(expected: Column, got: Column, key) -> Column:
    """key: column -> what is compared. Absent is null or blank."""
    want, have = F.coalesce(F.trim(expected), F.lit("")) != "", F.coalesce(F.trim(got), F.lit("")) != ""
    return F.when(want & have, F.when(key(expected) == key(got), "correct").otherwise("wrong")).when(want, "missed").when(have, "hallucinated").otherwise("correctly_absent")


def field_verdicts(truth: DataFrame, extracted: DataFrame, exact: Sequence[str]) -> DataFrame:
    """truth: (set_id, field, expected); extracted: (set_id, field, value)."""
    rows = truth.join(extracted, ["set_id", "field"], "left")
    e, g = F.col("expected"), F.col("value")
    found = F.when(F.col("field").isin(*exact), verdict(e, g, lambda c: tx.field_key(c, True))).otherwise(verdict(e, g, lambda c: tx.field_key(c, False)))
    return rows.select("set_id", "field", found.alias("verdict"))


def verdict_summary(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts; recall, precision and accuracy in tenths of a percent, null where nothing counts."""
    n = {v: F.count_if(F.col("verdict") == v) for v in VERDICTS}
    rate = lambda a, b: F.floor(a * 1000 / F.nullif(b, F.lit(0))).cast("long")
    return verdicts.groupBy(*by).agg(
        *[c.alias(v) for v, c in n.items()], rate(n["correct"], n["correct"] + n["wrong"] + n["missed"]).alias("recall"),
        rate(n["correct"], n["correct"] + n["wrong"] + n["hallucinated"]).alias("precision"), rate(n["correct"] + n["correctly_absent"], F.count("*")).alias("accuracy"),
    )


def address_block(verdicts: DataFrame, fields: Sequence[str]) -> DataFrame:
    good = F.col("verdict").isin("correct", "correctly_absent")
    return verdicts.where(F.col("field").isin(*fields)).groupBy("set_id").agg(F.bool_and(good).alias("exact"), F.count_if(good).alias("right"), F.count("*").alias("total"))


def by_severity(verdicts: DataFrame) -> DataFrame:
    """The worst first: wrong, hallucinated, missed, then what is right. ``severity`` is the place of the verdict in that order."""
    return verdicts.withColumn("severity", F.coalesce(*[F.when(F.col("verdict") == v, F.lit(i)) for i, v in enumerate(VERDICTS)])).orderBy("severity", "set_id", "field")


def partition_scores(truth: DataFrame, predicted: DataFrame, key: str | None = None) -> DataFrame:
    """truth, predicted: (key, address_1, address_2, split_index). split_match, token-sort ratio and Jaccard of both parts
    joined by a bar; a missing prediction counts as empty. The key is ``address_id`` unless predictions lack it, then ``address``."""
    key = key or ("address_id" if "address_id" in predicted.columns else "address")
    p = predicted.select(key, *[F.col(c).alias(f"p_{c}") for c in ("address_1", "address_2", "split_index")])
    rows = truth.join(p, key, "left")
    a, b = F.concat_ws(" | ", "address_1", "address_2"), F.concat_ws(" | ", F.coalesce("p_address_1", F.lit("")), F.coalesce("p_address_2", F.lit("")))
    return rows.select(key, F.coalesce(F.col("split_index") == F.col("p_split_index"), F.lit(False)).alias("split_match"), sim.token_sort_ratio_micro(a, b).alias("fuzzy"), sim.token_jaccard(a, b).alias("jaccard"))


def binary_scores(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    return rows.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))


def partition_means(scores: DataFrame) -> DataFrame:
    """(addresses, split_match, fuzzy, jaccard, same): means over all addresses, and how many parts are equal."""
    return scores.agg(F.count("*").alias("addresses"), F.avg(F.col("split_match").cast("double")).alias("split_match"), F.avg("fuzzy").alias("fuzzy"), F.avg("jaccard").alias("jaccard"), F.count_if(F.col("jaccard") == 1.0).alias("same"))


def outcome_tally(verdicts: DataFrame) -> DataFrame:
    """(field, verdict, n)."""
    return verdicts.groupBy("field", "verdict").agg(F.count("*").alias("n"))


def confidence_tally(verdicts: DataFrame, confidence: DataFrame) -> DataFrame:
    """(confidence, addresses, exact, miscalibrated): confidence (set_id, confidence). High confidence in an address with a
    fault is miscalibrated, and low confidence in one without."""
    exact = verdicts.groupBy("set_id").agg(F.bool_and(F.col("verdict").isin("correct", "correctly_absent")).alias("exact"))
    rows = exact.join(confidence, "set_id")
    off = (~F.col("exact") & (F.col("confidence") == "high")) | (F.col("exact") & (F.col("confidence") == "low"))
    return rows.groupBy("confidence").agg(F.count("*").alias("addresses"), F.count_if("exact").alias("exact"), F.count_if(off).alias("miscalibrated"))


def baseline_split(rows: DataFrame, address: str, key: str = "address_id") -> DataFrame:
    """(key, address_1, address_2, split_index): the resolver as a predictor, which keeps an address's rest in one part."""
    found = ad.resolve_address(rows, address)
    return found.select(key, F.array_join("rest", ", ").alias("address_1"), F.lit("").alias("address_2"), F.size("rest").alias("split_index"))


def usable_truth(truth: DataFrame, allow_unverified: bool = False) -> tuple[DataFrame, DataFrame]:
    """(truth that counts, rows refused with the reason): truth (set_id, field, value, absent, verified). A row has a value
    or is marked absent, not both and not neither."""
    has = F.coalesce(F.trim("value"), F.lit("")) != ""
    reason = F.when(~F.coalesce("verified", F.lit(False)) & F.lit(not allow_unverified), "unverified").when(has == F.coalesce("absent", F.lit(False)), "value_xor_absent")
    rows = truth.withColumn("reason", reason)
    return rows.where("reason is null").select("set_id", "field", F.when(has, F.col("value")).otherwise("").alias("expected")), rows.where("reason is not null")


def with_row_number(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, .. in their order, without gaps.

    Rows are written once with the number of their partition and place; the partitions' sizes, one row each, give where each begins. No
    window sees more than those.
    """
    at = settled(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    begins = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    out = at.withColumn("_part", part).join(begins, "_part").withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_at", "_part", "_begin")


def with_address_id(rows: DataFrame, required: Sequence[str], key: str = "address_id") -> DataFrame:
    """``rows`` with the key: their own, else their number from 0; a missing required column raises ValueError."""
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns {missing}")
    return rows if key in rows.columns else with_row_number(rows, key)
