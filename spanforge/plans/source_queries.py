"""Queries of sources, lookup tables, truth and what records look like on the way in and out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import geometry as geo
from spanforge.functions import text as tx
from spanforge.operators import address as ad
from spanforge.operators import evaluate as ev
from spanforge.operators import ml
from spanforge.operators import onboarding as ob
from spanforge.operators import records as rc
from spanforge.operators import segment as sg
from spanforge.plans.registry import query, view
from spanforge.session import shared_dir
from spanforge.sources import config

C = F.col


@query("recognised_spans", """SELECT set_id, doc, seq AS ord, trim(value) AS text, vx1 AS x1, vy1 AS y1, vx1 + 200 AS x2, vy1 + 26 AS y2, (seq + set_id % 10) / 10.0 AS confidence FROM v_form_spans WHERE set_id % 17 <> 0 AND (seq + set_id % 10) / 10.0 >= 0.3""")
def recognised_spans(spark: SparkSession, sf: str) -> DataFrame:
    """A recogniser's polygons, slightly turned, with blanks around texts and low scores."""
    f = view(spark, sf, "SELECT set_id, doc, seq AS ord, concat(' ', CASE WHEN set_id % 17 = 0 THEN '' ELSE value END, ' ') AS text, vx1 AS x, vy1 AS y, cast((seq + set_id % 10) / 10.0 AS double) AS score FROM v_form_spans")
    corner = lambda dx, dy: F.struct((C("x") + dx).alias("x"), (C("y") + dy).alias("y"))
    return geo.recognised_spans(f.withColumn("points", F.array(corner(0, 2), corner(200, 0), corner(198, 26), corner(2, 25))), ["set_id", "doc"])


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """Lines as a text file in the shared folder, as a site's own tables come."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(path)
    return path


@query("state_table", """WITH n AS (SELECT n_name, [n_name, lower(n_name), concat(substr(n_name, 1, 1), '. ', substr(n_name, 2))] AS names FROM nation)
SELECT DISTINCT regexp_replace(lower(unnest(names)), '[^a-z0-9]', '', 'g') AS key, n_name AS state FROM n""")
def state_table(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "SELECT explode(array('# spellings', '', concat(n_name, '\t', lower(n_name), '\t', substr(n_name, 1, 1), '. ', substr(n_name, 2)))) AS value FROM nation")
    return config.state_table(spark, _written(spark, lines, "states"))


@query("city_table", "SELECT DISTINCT regexp_replace(lower(c), '[^a-z0-9]', '', 'g') AS key, c AS city FROM (SELECT city AS c FROM v_addresses UNION SELECT locality FROM v_addresses)")
def city_table(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "SELECT city AS value FROM v_addresses UNION ALL SELECT locality FROM v_addresses UNION ALL SELECT premises FROM v_addresses WHERE premises LIKE '4%' UNION ALL SELECT '# cities' UNION ALL SELECT 'Ab' UNION ALL SELECT '12345'")
    return config.city_table(spark, _written(spark, lines, "cities"))


@query("pin_directory", "SELECT lpad(cast(c_nationkey AS varchar), 6, '7') AS pin, arg_max(n_name, c_custkey) AS state, arg_max(concat('D', cast(c_custkey % 7 AS varchar)), c_custkey) AS district FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def pin_directory(spark: SparkSession, sf: str) -> DataFrame:
    """A directory's file in which later lines replace earlier ones; lines without a PIN of six digits don't count."""
    lines = view(spark, sf, """SELECT value FROM (SELECT -1 AS o, 'pincode,district,state' AS value UNION ALL
      SELECT c_custkey, concat(lpad(cast(c_nationkey AS string), 6, '7'), ',D', cast(c_custkey % 7 AS string), ',', n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, concat(cast(c_custkey AS string), ',X,Y') FROM customer WHERE c_custkey < 1000) ORDER BY o""")
    return config.pin_directory(spark, _written(spark, lines, "pins"))


@query("blank_for_null", "SELECT k, CASE WHEN k % 3 = 0 THEN '' ELSE name END AS name, coalesce(nullif(trim(udyam), ''), '') AS udyam FROM v_ids")
def blank_for_null(spark: SparkSession, sf: str) -> DataFrame:
    return rc.nulls_to_blank(rc.blanks_to_null(view(spark, sf, "SELECT k, CASE WHEN k % 3 = 0 THEN null ELSE name END AS name, trim(udyam) AS udyam FROM v_ids"), ["udyam"]))


@query("first_seen", "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderpriority")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return rc.first_seen(view(spark, sf, "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("review_list", "SELECT k, CASE WHEN k % 2 = 0 THEN ['pan', name, 'city'] ELSE ['pan', name] END AS names FROM v_ids")
def review_list(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, """SELECT k, array('pan', concat('{"field":"', name, '","reason":"x"}'), '', CASE WHEN k % 2 = 0 THEN '{"field":"city"}' END, CASE WHEN k % 3 = 0 THEN '{"field":""}' END) AS entries FROM v_ids""")
    return v.select("k", ob.review_list(C("entries")).alias("names"))


_TRUTH = "CASE WHEN k % 6 = 5 THEN 'unverified' WHEN k % 6 IN (3, 4) THEN 'value_xor_absent' END"


@query("usable_truth", f"WITH t AS (SELECT k, {_TRUTH} AS reason, CASE WHEN k % 6 IN (0, 1, 4, 5) THEN name ELSE '' END AS expected FROM v_ids) SELECT k AS set_id, CASE WHEN reason IS NULL THEN expected END AS expected, reason FROM t")
def usable_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Verified rows with a value or marked absent; the others with the reason they are refused for."""
    t = view(spark, sf, "SELECT k AS set_id, 'vendor_name' AS field, CASE WHEN k % 6 IN (0, 1, 4, 5) THEN name WHEN k % 6 = 3 THEN ' ' END AS value, k % 6 IN (2, 4) AS absent, k % 6 <> 5 AS verified FROM v_ids")
    good, bad = ev.usable_truth(t)
    return good.select("set_id", "expected", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("set_id", F.lit(None).cast("string").alias("expected"), "reason"))


_VERDICT = "CASE event_id % 7 WHEN 0 THEN 'wrong' WHEN 1 THEN 'hallucinated' WHEN 2 THEN 'missed' WHEN 3 THEN 'correctly_absent' ELSE 'correct' END"


@query("severity_report", f"WITH v AS (SELECT user_id % 50 AS set_id, event_type AS field, {_VERDICT} AS verdict FROM events) SELECT field, verdict, count(*) AS n, CASE verdict WHEN 'wrong' THEN 0 WHEN 'hallucinated' THEN 1 WHEN 'missed' THEN 2 WHEN 'correct' THEN 3 ELSE 4 END AS severity FROM v GROUP BY field, verdict")
def severity_report(spark: SparkSession, sf: str) -> DataFrame:
    """How often each field has each verdict, the worst first."""
    v = view(spark, sf, f"SELECT user_id % 50 AS set_id, event_type AS field, {_VERDICT} AS verdict FROM events")
    return ev.by_severity(ev.outcome_tally(v).withColumn("set_id", F.lit(0))).drop("set_id")


@query("row_numbers", "SELECT c_custkey, c_custkey - (SELECT min(c_custkey) FROM customer) AS address_id FROM customer")
def row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in order, dealt over partitions, numbered without gaps."""
    rows = view(spark, sf, "SELECT c_custkey, c_name AS address FROM customer").repartitionByRange(7, "c_custkey").sortWithinPartitions("c_custkey")
    return ev.with_address_id(rows, ["address"]).select("c_custkey", "address_id")


@query("held_out_rows", "WITH r AS (SELECT l_linenumber % 2 AS label FROM lineitem) SELECT label, count(*) AS rows, CAST(floor(count(*) / 10.0 + 0.5) AS BIGINT) AS held FROM r GROUP BY label")
def held_out_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Of each class exactly a tenth."""
    rows = view(spark, sf, "SELECT l_orderkey AS k, l_linenumber AS cut, cast(l_linenumber % 2 AS int) AS label FROM lineitem")
    return ml.split_rows(rows).groupBy("label").agg(F.count("*").alias("rows"), F.count_if("held").alias("held"))


@query("trailing_location", """SELECT k, CASE WHEN k % 9 = 0 THEN address ELSE concat_ws(', ', premises, building, road, locality) END AS rest, CASE WHEN k % 9 = 0 THEN '' ELSE city END AS city,
  CASE WHEN k % 9 = 0 THEN '' WHEN state = 'KARNATAKA' THEN 'Karnataka' WHEN state = 'Maharastra' THEN 'Maharashtra' ELSE state END AS state, CASE WHEN k % 9 <> 0 AND k % 3 <> 0 THEN pin ELSE '' END AS pin FROM v_addresses""")
def trailing_location(spark: SparkSession, sf: str) -> DataFrame:
    return ad.trailing_location(view(spark, sf, "SELECT k, address FROM v_addresses"), "address")


@query("cell_values", """SELECT k AS set_id, f.field, CASE f.field WHEN 'name' THEN name ELSE pan END AS value FROM v_ids CROSS JOIN (VALUES ('name'), ('pan')) AS f(field) WHERE NOT (f.field = 'pan' AND k % 4 = 0)""")
def cell_values(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets read back through the cell map; blank cells and those of no field don't count."""
    cells = spark.createDataFrame([("name", "A", "B2"), ("pan", "A", "B3"), ("city", "B", "B2")], "field string, sheet string, cell string")
    v = view(spark, sf, "SELECT k AS set_id, inline(array(named_struct('sheet', 'A', 'cell', 'B2', 'value', concat(' ', name)), named_struct('sheet', 'A', 'cell', 'B3', 'value', CASE WHEN k % 4 = 0 THEN ' ' ELSE pan END), named_struct('sheet', 'A', 'cell', 'C9', 'value', 'x'))) FROM v_ids")
    return rc.read_cells(v, cells)


@query("label_dictionary", "SELECT lower(trim(regexp_replace(caption, '[:\\s]+$', ''))) AS label, count(*) AS n FROM v_form_spans GROUP BY 1")
def label_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned captions, each once, and how often the forms have them."""
    return view(spark, sf, "v_form_spans").select(tx.clean_label(C("caption")).alias("label")).where("label <> ''").groupBy("label").agg(F.count("*").alias("n"))


@query("sync_outcomes", """WITH e AS (SELECT event_id AS seq, user_id AS k, concat('p', cast(user_id % 3 + event_id % 4 AS varchar)) AS push, event_id % 5 <> 0 AS ok FROM events), f AS (SELECT *, min(seq) FILTER (WHERE ok) OVER w AS first_ok, arg_min(push, seq) FILTER (WHERE ok) OVER w AS won FROM e WINDOW w AS (PARTITION BY k))
SELECT k, seq, push, CASE WHEN first_ok IS NULL OR seq < first_ok THEN 'failed' WHEN push = won THEN 'pushed' ELSE 'conflict' END AS outcome FROM f""")
def sync_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Pushes of records in the order they arrived: failed, pushed (and repeats of that push), conflict."""
    e = view(spark, sf, "SELECT event_id AS seq, user_id AS k, concat('p', cast(user_id % 3 + event_id % 4 AS string)) AS push, event_id % 5 <> 0 AS ok FROM events")
    return rc.push_outcomes(e, "k")


@query("lines_by_levels", "SELECT 'locality' AS tier, 4 AS level, count(*) AS n FROM v_addresses WHERE locality = 'Haripur Colony' UNION ALL SELECT 'unknown', 4, count(*) FROM v_addresses WHERE locality IN ('Rajpur', 'East Sector') UNION ALL SELECT 'village', 5, count(*) FROM v_addresses WHERE locality = 'Nandigram'")
def lines_by_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Localities by tier and level; unknown fragments take the locality's level, which the taxonomy gives."""
    return sg.classify_fragments(view(spark, sf, "SELECT k, locality AS text FROM v_addresses")).groupBy("tier", "level").agg(F.count("*").alias("n"))
