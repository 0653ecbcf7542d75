"""Queries of the resolution steps, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import resolve as re_
from spanforge.operators import validate as va
from spanforge.operators.match import FieldSpec
from spanforge.plans.extract import derived_values
from spanforge.plans.registry import query, view

C = F.col
DOC_TYPES = "CASE doc WHEN 0 THEN 'card' WHEN 1 THEN 'form' ELSE 'other' END"
_EXP = "CASE WHEN field IN ('click', 'view') THEN doc = 0 ELSE false END"


def _cand(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, f"SELECT *, {DOC_TYPES} AS doc_type, {_EXP} AS is_expected FROM v_candidates")


_W = "PARTITION BY set_id, field"
_WIN = f"""c AS (SELECT *, {DOC_TYPES} AS doc_type, {_EXP} AS is_expected FROM v_candidates),
w1 AS (SELECT *, max(is_expected) OVER ({_W}) AS any_expected FROM c), w2 AS (SELECT *, max(score) OVER ({_W}) AS best FROM w1 WHERE is_expected = any_expected),
win AS (SELECT * FROM (SELECT *, row_number() OVER ({_W} ORDER BY CASE doc_type WHEN 'form' THEN 0 WHEN 'card' THEN 1 ELSE 2 END, CASE kind WHEN 'inline' THEN 0 WHEN 'adjacent' THEN 1 ELSE 2 END, score DESC, seq) AS rn FROM w2 WHERE best - score <= 50000) WHERE rn = 1)"""


def _winners(c: DataFrame) -> DataFrame:
    return re_.choose(c, C("is_expected"), F.lit(0), ["form", "card"])


@query("choose_winner", f"WITH {_WIN} SELECT set_id, field, doc, seq, value, score FROM win")
def choose_winner(spark: SparkSession, sf: str) -> DataFrame:
    return _winners(_cand(spark, sf)).select("set_id", "field", "doc", "seq", "value", "score")


@query("alternatives_topk", f"""WITH {_WIN}, t AS (SELECT * FROM (SELECT *, row_number() OVER ({_W} ORDER BY score DESC, seq) AS n FROM c) WHERE n <= 6)
SELECT t.set_id, t.field, list(struct_pack(value := t.value, score := t.score) ORDER BY t.n)[1:5] AS alternatives FROM t WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.set_id = t.set_id AND win.field = t.field AND win.seq = t.seq) GROUP BY t.set_id, t.field""")
def alternatives_topk(spark: SparkSession, sf: str) -> DataFrame:
    c = _cand(spark, sf)
    return re_.alternatives(c, _winners(c))


@query("validation_bias", """SELECT set_id, field, seq, CASE WHEN value = 'val3' THEN CAST(floor(score * 35 / 100.0) AS BIGINT) WHEN value = 'val5' THEN CAST(floor(score * 75 / 100.0) AS BIGINT) ELSE least(score + 100000, 1000000) END AS biased,
  row_number() OVER (PARTITION BY set_id, field ORDER BY CASE WHEN value = 'val3' THEN floor(score * 35 / 100.0) WHEN value = 'val5' THEN floor(score * 75 / 100.0) ELSE least(score + 100000, 1000000) END DESC, seq) AS place FROM v_candidates""")
def validation_bias(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    c = view(spark, sf, "v_candidates").withColumn("biased", va.bias(C("score"), C("value") == "val3", C("value") == "val5", F.lit(True)))
    return c.select("set_id", "field", "seq", "biased", F.row_number().over(Window.partitionBy("set_id", "field").orderBy(C("biased").desc(), "seq")).cast("long").alias("place"))


@query("cross_document_consistency", f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER ({_W}, doc ORDER BY score DESC, seq) AS n FROM v_candidates) WHERE n = 1),
p AS (SELECT a.set_id, a.field, count(*) FILTER (WHERE a.value <> b.value AND CAST(floor(200000000 * 3 / 8.0) AS BIGINT) < 85000000) AS d FROM b a JOIN b ON a.set_id = b.set_id AND a.field = b.field AND a.doc < b.doc GROUP BY ALL)
SELECT b.set_id, b.field, count(*) AS docs, CASE WHEN count(*) = 1 THEN 'single_source' WHEN coalesce(max(d), 0) > 0 THEN 'inconsistent' ELSE 'consistent' END AS consistency, coalesce(max(d), 0) AS disagreements FROM b LEFT JOIN p USING (set_id, field) GROUP BY b.set_id, b.field""")
def cross_document_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return re_.consistency(view(spark, sf, "v_candidates"))


_RES = f"""{_WIN}, res AS (SELECT set_id, field, CASE WHEN value = 'val6' THEN '' ELSE value END AS value, score, CASE WHEN value = 'val3' THEN 'invalid' WHEN value = 'val5' THEN 'warning' ELSE 'valid' END AS status, CASE WHEN set_id % 4 = 0 THEN 'inconsistent' ELSE 'consistent' END AS consistency FROM win),
rev AS (SELECT set_id, field, 'missing_required_field' AS reason, 'error' AS severity FROM res WHERE trim(value) = '' AND field IN ('click', 'purchase')
  UNION ALL SELECT set_id, field, 'failed_validation', 'error' FROM res WHERE trim(value) <> '' AND status = 'invalid' UNION ALL SELECT set_id, field, 'validation_warning', 'warning' FROM res WHERE trim(value) <> '' AND status = 'warning'
  UNION ALL SELECT set_id, field, 'low_confidence', 'warning' FROM res WHERE trim(value) <> '' AND score < 500000 UNION ALL SELECT set_id, field, 'cross_document_mismatch', 'warning' FROM res WHERE consistency = 'inconsistent')"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    w = _winners(_cand(spark, sf))
    return w.select("set_id", "field", F.when(C("value") == "val6", "").otherwise(C("value")).alias("value"), "score", F.when(C("value") == "val3", "invalid").when(C("value") == "val5", "warning").otherwise("valid").alias("status"), F.when(C("set_id") % 4 == 0, "inconsistent").otherwise("consistent").alias("consistency"))


@query("needs_review", f"WITH {_RES} SELECT * FROM rev")
def needs_review(spark: SparkSession, sf: str) -> DataFrame:
    return re_.review(_results(spark, sf), ["click", "purchase"])


@query("extraction_summary", f"""WITH {_RES} SELECT res.set_id, count(*) AS total, count(*) FILTER (WHERE trim(value) <> '') AS filled, count(*) FILTER (WHERE status = 'valid') AS valid, coalesce(max(r.n), 0) AS review,
  count(*) - count(*) FILTER (WHERE trim(value) <> '') AS empty, CAST(floor(count(*) FILTER (WHERE trim(value) <> '') * 1000 / count(*)::DOUBLE) AS BIGINT) AS fill_rate FROM res LEFT JOIN (SELECT set_id, count(*) AS n FROM rev GROUP BY set_id) r USING (set_id) GROUP BY res.set_id""")
def extraction_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf)
    return re_.summary(r, re_.review(r, ["click", "purchase"]))


@query("canonical_pivot", f"""WITH {_WIN} SELECT set_id, max(value) FILTER (WHERE field = 'click') AS click, max(value) FILTER (WHERE field = 'view') AS "view", max(value) FILTER (WHERE field = 'purchase') AS purchase FROM win GROUP BY set_id""")
def canonical_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return re_.canonical(_winners(_cand(spark, sf)), ["click", "view", "purchase"])


@query("derive_and_default", """WITH w AS (SELECT k, CASE WHEN email LIKE '%@%' AND email NOT LIKE '%gmail.com' THEN concat('www.', split_part(lower(email), '@', 2)) END AS made, k % 4 = 3 AS printed, email FROM v_ids)
SELECT k AS set_id, CASE WHEN printed THEN 'www.printed.example' ELSE made END AS website, CASE WHEN printed THEN 700000 WHEN made IS NOT NULL THEN 400000 END AS score, NOT printed AND made IS NOT NULL AS flagged FROM w""")
def derive_and_default(spark: SparkSession, sf: str) -> DataFrame:
    """The website from the e-mail address where none is printed, as in the whole dataflow."""
    specs = [FieldSpec("email"), FieldSpec("website", derive_from="email")]
    rows = view(spark, sf, """SELECT k AS set_id, inline(array(named_struct('field', 'email', 'value', email, 'score', 900000L, 'source', '0'),
      named_struct('field', 'website', 'value', CASE WHEN k % 4 = 3 THEN 'www.printed.example' END, 'score', CASE WHEN k % 4 = 3 THEN 700000L END, 'source', '0'))) FROM v_ids""")
    results, flags = derived_values(rows, specs)
    marked = results.where("field = 'website'").join(flags.select("set_id", F.lit(True).alias("flagged")), "set_id", "left")
    return marked.select("set_id", C("value").alias("website"), "score", F.coalesce("flagged", F.lit(False)).alias("flagged"))
