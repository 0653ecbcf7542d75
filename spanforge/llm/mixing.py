"""Mixing sources to target weights: budgets down a domain-language-source tree, token prefixes of seeded epochs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.common import SPACE, written


@dataclass(frozen=True)
class Mix:
    """levels: expressions from the root down; the last is the leaf. weights: the integer weight of a node by its path of values, 1 unless
    given (0: no part). max_epochs: how often a document may be repeated at most. total_tokens: the budget; all
    tokens of the input unless given. Null values of a level count as the empty string."""

    levels: tuple[Column, ...]
    names: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[tuple[str, ...], int] = field(default_factory=dict)
    max_epochs: int = 2
    total_tokens: int | None = None
    seed: int = 0


def token_count(text: Column) -> Column:
    """Words between ``[\\x20\\x09-\\x0D]``; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children(*parent, name, cap, weight, amount)`` with ``budget``: the parent's ``amount`` dealt by weight.

    No child gets more than its ``cap``; what it can't take goes to its siblings by weight, so a parent whose
    ``amount`` is within its children's caps passes nothing back. Children are filled up in the order of
    cap / weight: one is full if its cap is within its share of what the fuller ones leave. Whole tokens; a
    remainder below one token for each child is left over.
    """
    wide = "decimal(20,0)"
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    rows = children.where("weight > 0").withColumns({"_filled": F.coalesce(F.sum("cap").over(before), F.lit(0)), "_open": F.sum("weight").over(after)})
    full = F.col("cap").cast(wide) * F.col("_open").cast("decimal(18,0)") <= (F.col("amount") - F.col("_filled")).cast(wide) * F.col("weight").cast("decimal(18,0)")
    rows = rows.withColumn("_full", full)
    whole = Window.partitionBy(*parent)
    rest = F.col("amount") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole)
    rows = rows.withColumns({"_rest": rest.cast(wide), "_open": open_weight.cast("decimal(18,0)")})
    part = F.expr("cast((_rest * cast(weight as decimal(18,0))) div _open as bigint)")
    return rows.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(part)).drop("_filled", "_open", "_full", "_rest")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves(*names, tokens)`` -> with ``budget``, the leaf's tokens in the mix."""
    spark, names = leaves.sparkSession, list(mix.names)
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, k + ("",) * len(names))], F.lit(len(k)).alias("depth"), F.lit(w).cast("long").alias("given")) for k, w in [*mix.weights.items(), ((), 1)]]
    given = spark.range(1).select(F.inline(F.array(*entries)))
    caps = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    total = F.sum("tokens") if mix.total_tokens is None else F.lit(mix.total_tokens)
    above = caps.agg(F.least(total, F.sum("cap")).cast("long").alias("amount"))
    for depth in range(1, len(names) + 1):
        path, parent = names[:depth], names[: depth - 1]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(above, parent) if parent else nodes.withColumn("amount", above.scalar())
        own = given.where(F.col("depth") == depth).select(*path, "given")
        nodes = nodes.join(own, path, "left").withColumn("weight", F.coalesce("given", F.lit(1)).cast("long"))
        above = share_out(nodes, parent, path[-1]).select(*path, F.col("budget").alias("amount"))
    return leaves.join(above.withColumnRenamed("amount", "budget"), names, "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


#: Rows of one place in the order that are summed up together.
_BUCKET = 1 << 16


def _mix_columns(mix: Mix, id_col: str, text_col: str) -> list[Column]:
    """row, doc_id, the levels and n_tokens."""
    levels = [F.coalesce(c.cast("string"), F.lit("")) for c in mix.levels]
    return [F.monotonically_increasing_id(), F.col(f"`{id_col}`").cast("long"), *levels, token_count(F.col(f"`{text_col}`"))]


def _row_counts(rows: DataFrame, mix: Mix) -> DataFrame:
    """(row, doc_id, *names, n_tokens, copies) of a table of (row, doc_id, *names, n_tokens)."""
    names = list(mix.names)
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, mix).select(*names, F.expr("if(tokens = 0, 0, budget div tokens)").alias("epochs"), F.expr("if(tokens = 0, -1, budget % tokens)").alias("rest"))
    plan = written(plan.coalesce(1), "mix-plan")
    digest = F.md5(F.concat_ws(":", F.lit(mix.seed), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = rows.join(plan, names).withColumn("place", digest).withColumn("range", F.substring("place", 1, 3))
    dealt = dealt.withColumn("at", F.struct("place", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.expr(f"row div {_BUCKET}").alias("b")))

    def ends(rows: DataFrame, key: str, base: Column, name: str) -> DataFrame:
        """(*names, end, base): the first ``key`` of each leaf whose sum exceeds the rest, and the tokens before it."""
        parts = rows.groupBy(*names, key).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first(base).alias("from"))
        upto = parts.withColumn("upto", F.col("from") + F.sum("n").over(Window.partitionBy(*names).orderBy(key))).where("upto > rest")
        first = upto.groupBy(*names).agg(F.min_by(F.struct(key, (F.col("upto") - F.col("n")).alias("base")), key).alias("e"))
        return written(first.select(*names, F.col(f"e.{key}").alias("end"), F.col("e.base").alias("base")).coalesce(1), name)

    placed = dealt.join(ends(dealt, "range", F.lit(0).cast("long"), "mix-ends"), names, "left").withColumn("end", F.coalesce("end", F.lit("~")))
    sure = placed.where("range <> end").withColumn("last", F.expr("range < end and rest >= 0"))
    edge = placed.where("range = end")
    near = edge.drop("end", "base").join(ends(edge, "at", F.col("base"), "mix-edges"), names)
    within = Window.partitionBy(*names).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    cut = near.where("at = end").withColumn("last", (F.col("base") + F.sum("n_tokens").over(within)) <= F.col("rest"))
    columns = ["row", "doc_id", *names, "n_tokens", (F.col("epochs") + F.col("last").cast("long")).alias("copies")]
    before = near.where("at <> end").withColumn("last", F.expr("at < end"))
    return sure.select(columns).unionByName(before.select(columns)).unionByName(cut.select(columns))


def mix_counts(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *names, n_tokens, copies): how often each row of ``docs`` is in the mix.

    A leaf with budget b and t tokens gives b div t whole epochs, and of the next epoch the documents before
    the first that would exceed the rest; an epoch's order is that of md5(seed:epoch:id). The order falls into 4,096 ranges by
    its first three digits; token sums by range find the one where the budget ends, sums by place in the order
    then the place, and only rows of one place, 65,536 at most, are numbered one by one. So neither a hot leaf nor an id that many rows
    share is ever gathered.

    A row without words costs nothing and comes with its place in the order; a leaf without any words gives
    none. Rows that share an id (or a null id, taken as empty) stand next to each other in the order and each
    count; extra columns play no part; texts count whole; an empty table gives no rows.
    """
    rows = docs.select(_mix_columns(mix, id_col, text_col)).toDF("row", "doc_id", *mix.names, "n_tokens")
    return _row_counts(written(rows, "mix-rows"), mix).drop("row")


def mixed(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_counts`` has it, within the leaves' budgets whatever ids they share. Rows are
    numbered in a table first, and meet their counts by that number."""
    own, levels = [f"c{i}" for i in range(len(docs.columns))], [f"m{i}" for i in range(len(mix.names))]
    numbered = written(docs.select("*", *_mix_columns(mix, id_col, text_col)).toDF(*own, "row", "id", *levels, "tokens"), "mix-documents")
    counts = _row_counts(numbered.select("row", "id", *levels, "tokens").toDF("row", "doc_id", *mix.names, "n_tokens"), mix)
    rows = numbered.select("row", *own).join(counts.where("copies > 0").select("row", "copies"), "row")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*own).toDF(*docs.columns)


#: The mix of the query and the pipeline: the source's number tells its domain.
def corpus_mix() -> Mix:
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) as int)"), F.lit(-1))
    domain = F.when(number == 0, "web").when(number.between(1, 9), "reference").when(number >= 10, "forum").otherwise("other")
    weights = {("web",): 8, ("reference",): 6, ("forum",): 6, ("other",): 1}
    for d in ("web", "reference", "forum", "other"):
        weights |= {(d, "en"): 60, (d, "de"): 15, (d, "fr"): 14, (d, "es"): 11}
    return Mix((domain, F.col("lang"), F.col("source")), weights=weights, seed=7)
