"""Learning where an address splits: segment vocabulary, cut-point table, forest, and the rule-based baseline.

Addresses: (k, segments array<string>, tags array<string>).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as tx
from spanforge.session import settled


def tagged_words(addresses: DataFrame) -> DataFrame:
    """(k, i, word, tag); rows whose segments and tags differ in number are left out."""
    zipped = addresses.where(F.size("segments") == F.size("tags")).select("k", F.posexplode(F.arrays_zip("segments", "tags")).alias("i", "z"))
    return zipped.select("k", "i", F.explode(F.split(F.lower("z.segments"), r"\s+")).alias("word"), F.col("z.tags").alias("tag"))


def segment_vocab(addresses: DataFrame) -> DataFrame:
    return tagged_words(addresses).groupBy("word", "tag").agg(F.count("*").alias("n"))


def type_probabilities(vocab: DataFrame) -> DataFrame:
    """(word, tag, p): shares of a word's tags, in millionths; the word null has the prior."""
    known = vocab.withColumn("p", F.floor(F.col("n") * 1_000_000 / F.sum("n").over(Window.partitionBy("word"))).cast("long"))
    totals = vocab.groupBy("tag").agg(F.sum("n").alias("n"))
    every = totals.agg(F.sum("n").alias("all"))
    prior = totals.select(F.lit(None).cast("string").alias("word"), "tag", F.floor(F.col("n") * 1_000_000 / every.scalar()).cast("long").alias("p"))
    return known.select("word", "tag", "p").unionByName(prior)


def _by_word(probabilities: DataFrame) -> DataFrame:
    """(word, tags): a row for each known word."""
    return probabilities.where("word is not null").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("tag", "p"))).alias("tags"))


def _prior(probabilities: DataFrame) -> Column:
    """The tags' shares for words never seen: a constant, so that such words meet no hot key of a join."""
    return probabilities.where("word is null").agg(F.sort_array(F.collect_list(F.struct("tag", "p")))).scalar()


def vocabulary_features(segments: DataFrame, probabilities: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(segment, p_<tag>.., known): for distinct segments the mean of their words' shares for each tag, in millionths, the
    prior's for words never seen, and whether any word is known; zeros for an empty segment."""
    words = segments.select("segment").distinct().select("segment", F.explode(F.split(F.lower(F.trim("segment")), r"\s+")).alias("word"))
    words = words.join(_by_word(probabilities), "word", "left").withColumns({"held": F.col("tags").isNotNull(), "tags": F.coalesce("tags", _prior(probabilities))})
    share = lambda t: F.coalesce(F.get(F.filter("tags", lambda x: x["tag"] == t), F.lit(0))["p"], F.lit(0))
    empty = F.col("word") == ""
    return words.groupBy("segment").agg(*[F.avg(F.when(empty, 0).otherwise(share(t))).alias(f"p_{t}") for t in tags], F.max(F.when(~empty & F.col("held"), 1.0).otherwise(0.0)).alias("known"))


def with_vocabulary(table: DataFrame, addresses: DataFrame, probabilities: DataFrame, tags: Sequence[str]) -> DataFrame:
    """The cut table with both sides' vocabulary features, as a table of its own, which training reads several times.

    What grows with the addresses meets in merge joins: Spark's estimate doesn't count what an explode multiplies, so it would send a
    table of many times its bound through the driver. The distinct segments' features are settled first, so their size is known.
    """
    sides = addresses.select("k", F.posexplode("segments").alias("_i", "segment"))
    features = settled(vocabulary_features(sides, probabilities, tags))
    sides = sides.join(features, "segment").drop("segment")
    out = table
    for side, shift in (("left", 1), ("right", 0)):
        own = sides.select(F.col("k").alias("_k"), F.col("_i").alias("_at"), *[F.col(c).alias(f"{side}_{c}") for c in features.columns if c != "segment"])
        out = out.join(own.hint("merge"), (F.col("k") == F.col("_k")) & (F.col("cut") - shift == F.col("_at"))).drop("_k", "_at")
    return settled(out)


def likely_tags(addresses: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(k, i, segment, tag): for each segment the tag of the largest sum over its words, the first in order at a tie.
    Words never seen count by the prior."""
    seg = addresses.select("k", F.posexplode("segments").alias("i", "segment"))
    words = seg.select("k", "i", F.explode(F.split(F.lower("segment"), r"\s+")).alias("word"))
    scored = words.join(_by_word(probabilities), "word", "left").withColumn("t", F.explode(F.coalesce("tags", _prior(probabilities)))).groupBy("k", "i", "t.tag").agg(F.sum("t.p").alias("s"))
    best = scored.groupBy("k", "i").agg(F.min_by("tag", F.struct(-F.col("s"), F.col("tag"))).alias("tag"))
    return seg.join(best, ["k", "i"])


def rule_based_split(tagged: DataFrame, geography: Sequence[str]) -> DataFrame:
    """(k, cut, confidence in tenths): before the first later segment of a geography tag; none gives the whole address at
    2, a single segment 10."""
    rows = tagged.groupBy("k").agg(F.min(F.when(F.col("tag").isin(*geography) & (F.col("i") > 0), F.col("i"))).alias("cut"), F.count("*").alias("n"))
    return rows.select("k", F.coalesce("cut", F.col("n")).cast("int").alias("cut"), F.when(F.col("n") < 2, 10).when(F.col("cut").isNull(), 2).otherwise(8).alias("confidence"))


def surface(c: Column) -> dict[str, Column]:
    n = F.length(c)
    digits, letters = F.length(tx.digits_only(c)), F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return {"length": n, "words": F.size(F.split(F.trim(c), r"\s+")), "digit_share": F.when(n > 0, digits / n).otherwise(0.0), "alpha_share": F.when(n > 0, letters / n).otherwise(0.0), "starts_digit": c.rlike("^[0-9]").cast("int"), "has_digit": (digits > 0).cast("int"), "is_upper": ((c == F.upper(c)) & (letters > 0)).cast("int")}


def cut_table(addresses: DataFrame) -> DataFrame:
    """A row for each address and cut 1..n-1 with features of both sides; label: whether it is ``split_index``."""
    n = F.size("segments")
    rows = addresses.where(n > 1).withColumn("cut", F.explode(F.sequence(F.lit(1), n - 1)))
    left, right = F.get("segments", F.col("cut") - 1), F.get("segments", F.col("cut"))
    features = {f"{side}_{k}": v for side, c in (("left", left), ("right", right)) for k, v in surface(c).items()}
    return rows.select("k", "cut", n.alias("total"), (F.col("cut") / n).alias("ratio"), (n - F.col("cut")).alias("remaining"), *[v.cast("double").alias(k) for k, v in features.items()], (F.col("cut") == F.col("split_index")).cast("int").alias("label"))


def split_rows(table: DataFrame, seed: int = 42, share: int = 10) -> DataFrame:
    """``table`` with ``held``: of each label's rows exactly one in ``share`` (rounded), those with the smallest hashes of address and cut.

    Counts of 4,096 ranges of the hash tell in which range a label's share ends; only that range's rows are ranked.
    """
    rows = table.withColumn("_h", F.xxhash64("k", "cut", F.lit(seed))).withColumn("_r", F.shiftrightunsigned("_h", 52))
    counts = rows.groupBy("label", "_r").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("label").orderBy("_r"))).withColumn("_due", F.floor(F.sum("_n").over(Window.partitionBy("label")) / share + 0.5))
    ends = upto.where(F.col("_upto") >= F.col("_due")).groupBy("label").agg(F.min_by(F.struct(F.col("_r").alias("end"), (F.col("_due") - F.col("_upto") + F.col("_n")).alias("take")), "_r").alias("_e"))
    rows = rows.join(ends, "label")
    within = Window.partitionBy("label").orderBy("_h", "k", "cut")
    edge = rows.where(F.col("_r") == F.col("_e.end")).withColumn("held", F.row_number().over(within) <= F.col("_e.take"))
    sure = rows.where(F.col("_r") != F.col("_e.end")).withColumn("held", F.col("_r") < F.col("_e.end"))
    return sure.unionByName(edge).select(*table.columns, "held")


def train(table: DataFrame, trees: int = 200, depth: int = 30, seed: int = 42) -> PipelineModel:
    """A forest with balanced classes, on the rows that ``held``, if there is such a column, leaves; all numeric columns but key and
    label are features. ``model.write().save`` keeps it, ``PipelineModel.load`` brings it back."""
    part = table.where("not held").drop("held") if "held" in table.columns else table
    inputs = [c for c, kind in part.dtypes if c not in ("k", "label") and kind in ("int", "bigint", "double")]
    n, ones = part.agg(F.count("*"), F.sum("label")).first()
    weight = F.when(F.col("label") == 1, n / (2 * max(1, ones or 0))).otherwise(n / (2 * max(1, n - (ones or 0))))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), forest]).fit(part.withColumn("w", weight))


def row_accuracy(model: PipelineModel, table: DataFrame) -> DataFrame:
    """(held, rows, right): how many cuts the model labels rightly, of those it was trained on and of those held out."""
    return model.transform(table).groupBy("held").agg(F.count("*").alias("rows"), F.count_if(F.col("prediction") == F.col("label")).alias("right"))


def predict(model: PipelineModel, table: DataFrame) -> DataFrame:
    """(k, cut, confidence): the most probable cut, the first at a tie; its share of the address's probabilities."""
    p = model.transform(table).select("k", "cut", vector_to_array("probability")[1].alias("p"))
    w = Window.partitionBy("k")
    share = F.when(F.sum("p").over(w) > 0, F.col("p") / F.sum("p").over(w)).otherwise(1 / F.count("*").over(w))
    return p.withColumns({"confidence": share, "_n": F.row_number().over(w.orderBy(F.col("p").desc(), "cut"))}).where("_n = 1").select("k", "cut", "confidence")


def cut_accuracy(predicted: DataFrame, table: DataFrame) -> DataFrame:
    """(addresses, right): how many predicted cuts are the labelled ones."""
    truth = table.where("label = 1").select("k", F.col("cut").alias("_cut"))
    return predicted.join(truth, "k").agg(F.count("*").alias("addresses"), F.count_if(F.col("cut") == F.col("_cut")).alias("right"))
