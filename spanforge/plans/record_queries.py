"""Queries of addresses, records, evaluation and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import address as ad
from spanforge.operators import evaluate as ev
from spanforge.operators import layout as lo
from spanforge.operators import match as ma
from spanforge.operators import ml
from spanforge.operators import onboarding as ob
from spanforge.operators import records as rc
from spanforge.operators import resolve as rs
from spanforge.operators import segment as sg
from spanforge.operators import validate as va
from spanforge.plans.extract import combined_address, extract
from spanforge.plans.layout_queries import SPECS
from spanforge.plans.registry import query, view
from spanforge.sources import config

C = F.col

_RESOLVED = """r AS (SELECT k, address, CASE WHEN k % 9 = 0 THEN [address] ELSE [premises, building, road, locality] END AS rest, CASE WHEN k % 9 = 0 THEN '' ELSE city END AS city,
  CASE WHEN k % 9 = 0 THEN '' WHEN state = 'KARNATAKA' THEN 'Karnataka' WHEN state = 'Maharastra' THEN 'Maharashtra' ELSE state END AS state, CASE WHEN k % 9 <> 0 AND k % 3 <> 0 THEN pin ELSE '' END AS pin FROM v_addresses)"""


@query("address_resolve", f"WITH {_RESOLVED} SELECT k, rest, city, state, pin, CASE WHEN k % 9 = 0 THEN 'low' WHEN pin <> '' THEN 'high' ELSE 'medium' END AS confidence FROM r")
def address_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return ad.resolve_address(view(spark, sf, "SELECT k, address FROM v_addresses"), "address").select("k", "rest", "city", "state", "pin", "confidence")


#: Every address's parts, one of them glued, and a fragment that only its shape or a conflict tells.
_SHAPES = "CASE k % 7 WHEN 0 THEN '12/3' WHEN 1 THEN 'No 7' WHEN 2 THEN 'Tower B' WHEN 3 THEN '2nd' WHEN 4 THEN 'Near Park' WHEN 5 THEN '#4' ELSE 'B-12' END"
_FRAG = f"""WITH f AS (SELECT k, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([premises, building, road, locality, replace(building, ' ', ''), {_SHAPES}]) AS text FROM v_addresses),
t AS (SELECT *, CASE WHEN text = 'Near Park' THEN 'estate' WHEN text = 'Tower B' THEN 'structure' WHEN regexp_matches(text, '^(Flat|Plot|Shop|No|#)|^(B-)?[0-9]') THEN 'premises' WHEN regexp_matches(text, '(Tower|Heights|Complex)$') THEN 'building'
  WHEN regexp_matches(text, '(Road|Street|Lane)$') THEN 'road' WHEN regexp_matches(text, 'Colony$') THEN 'locality' WHEN text = 'Nandigram' THEN 'village' ELSE 'unknown' END AS tier FROM f),
c AS (SELECT *, CASE tier WHEN 'premises' THEN 1 WHEN 'structure' THEN 1 WHEN 'building' THEN 2 WHEN 'estate' THEN 2 WHEN 'road' THEN 3 WHEN 'village' THEN 5 ELSE 4 END AS level,
  CASE WHEN tier = 'unknown' THEN 55 WHEN i = 4 OR tier = 'village' THEN 75 WHEN i < 4 THEN 100 ELSE [70, 80, 80, 85, 50, 80, 70][k % 7 + 1] END AS conf FROM t)"""


def _frags(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array("premises", "building", "road", "locality", F.replace("building", F.lit(" "), F.lit("")), F.expr(_SHAPES))
    return sg.classify_fragments(view(spark, sf, "v_addresses").select("k", F.posexplode(parts).alias("i", "text")))


@query("classify_fragments", _FRAG + " SELECT * FROM c")
def classify_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return _frags(spark, sf)


_GAPS = _FRAG + """, l AS (SELECT *, level - lag(level) OVER w AS up, tier <> lag(tier) OVER w AS other, level <= 2 AND lag(level) OVER w <= 2 AS near FROM c WINDOW w AS (PARTITION BY k ORDER BY i)),
g AS (SELECT *, CASE WHEN up IS NOT NULL THEN CASE WHEN up = 1 THEN 50 WHEN up > 1 THEN 60 WHEN up < 0 AND near THEN 20 WHEN up < 0 THEN 40 ELSE 0 END + CASE WHEN other THEN 20 ELSE 0 END END AS gap FROM l)"""


@query("gap_groups", _GAPS + " SELECT k, i, tier, gap, CAST(sum(CASE WHEN gap >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS INT) AS grp FROM g")
def gap_groups(spark: SparkSession, sf: str) -> DataFrame:
    return sg.gap_groups(_frags(spark, sf)).select("k", "i", "tier", "gap", "grp")


@query("tail_split", """WITH l AS (SELECT doc_id AS k, line_no AS i, CASE WHEN length(text) > 60 THEN 4 ELSE 1 END AS level FROM v_lines),
g AS (SELECT *, CASE WHEN lag(level) OVER w IS NULL THEN 0 WHEN level - lag(level) OVER w > 1 THEN 1 WHEN level < lag(level) OVER w THEN 1 ELSE 0 END AS cut FROM l WINDOW w AS (PARTITION BY k ORDER BY i)),
h AS (SELECT *, sum(cut) OVER (PARTITION BY k ORDER BY i) AS grp FROM g), m AS (SELECT *, max(grp) OVER (PARTITION BY k) AS last, row_number() OVER (PARTITION BY k ORDER BY i DESC) AS n FROM h),
s AS (SELECT *, count(*) FILTER (WHERE grp = last) OVER (PARTITION BY k) AS size, min(CASE WHEN grp = last AND level >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n) AS run FROM m)
SELECT k, i, CAST(grp + CASE WHEN n = 1 AND last > 0 AND size > 1 AND sum(run) OVER (PARTITION BY k) >= 4 THEN 1 ELSE 0 END AS INT) AS grp FROM s""")
def tail_split(spark: SparkSession, sf: str) -> DataFrame:
    f = view(spark, sf, "SELECT doc_id AS k, line_no AS i, text, CASE WHEN length(text) > 60 THEN 4 ELSE 1 END AS level, CASE WHEN length(text) > 60 THEN 'locality' ELSE 'premises' END AS tier, 50 AS conf FROM v_lines")
    return sg.tail_split(sg.gap_groups(f)).select("k", "i", "grp")


_LINES = """p AS (SELECT *, road = 'Park Street' AS named, CASE locality WHEN 'East Sector' THEN concat('East, Sector ', city) WHEN 'Haripur Colony' THEN concat(locality, ', ', city) ELSE concat(locality, ' ', city) END AS area FROM v_addresses),
l AS (SELECT k, CASE WHEN k % 9 <> 0 THEN [premises, building, road, locality] WHEN named THEN [premises, concat(building, ' ', road), area] ELSE [concat(premises, ', ', building), road, area] END AS lines,
  CASE WHEN k % 9 = 0 AND named THEN 3 ELSE 4 END AS n_groups, CASE WHEN k % 9 = 0 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN k % 9 = 0 THEN '' ELSE city END AS city,
  CASE WHEN k % 9 = 0 THEN '' WHEN state = 'KARNATAKA' THEN 'Karnataka' WHEN state = 'Maharastra' THEN 'Maharashtra' ELSE state END AS state, CASE WHEN k % 9 <> 0 AND k % 3 <> 0 THEN pin ELSE '' END AS pin FROM p)"""


@query("segment_lines", f"WITH {_LINES} SELECT * FROM l")
def segment_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ad.segment_lines(view(spark, sf, "SELECT k, address FROM v_addresses"), "address")


@query("deglue_runs", """SELECT k, [CASE WHEN premises = 'Shop 3' THEN 'Shop3' ELSE premises END, building, CASE WHEN road = 'Park Street' THEN 'ParkStreet' ELSE road END, replace(locality, ' ', ''), city] AS split,
  list_concat(CASE WHEN road = 'Park Street' THEN [premises, concat(building, ' ', road)] ELSE [premises, building, road] END, CASE WHEN locality = 'East Sector' THEN ['East', 'Sector'] ELSE [locality] END) AS bounded FROM v_addresses""")
def deglue_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Each part without its blanks; those of one role side by side, place names and short runs stay glued. The whole without commas."""
    rows = view(spark, sf, "v_addresses")
    parts = F.array(*[F.replace(c, F.lit(" "), F.lit("")) for c in ("premises", "building", "road", "locality", "city")])
    return rows.select("k", sg.deglued(parts).alias("split"), sg.bounded(F.concat_ws(" ", "premises", "building", "road", "locality")).alias("bounded"))


@query("onboarding_record", r"""SELECT k AS set_id, name AS company_name, concat_ws(', ', 'Flat 1', CASE WHEN k % 2 = 0 THEN 'Canal Road' END) AS billing_address, '' AS city, '' AS state, pin AS zip_code, gstin AS gst_registration_number,
  CASE WHEN k % 3 = 0 AND regexp_full_match(substr(gstin, 3, 10), '[A-Z]{5}[0-9]{4}[A-Z]') THEN substr(gstin, 3, 10) WHEN k % 3 = 0 THEN '' ELSE pan END AS pan_number, ifsc AS bank_ifsc, '' AS contact_name, 'Services' AS type,
  CASE WHEN k % 3 = 0 AND regexp_full_match(substr(gstin, 3, 10), '[A-Z]{5}[0-9]{4}[A-Z]') THEN 'pan_number' ELSE '' END AS derived FROM v_ids""")
def onboarding_record(spark: SparkSession, sf: str) -> DataFrame:
    w = view(spark, sf, "SELECT k AS set_id, name AS vendor_name, 'Flat 1' AS address_1, CASE WHEN k % 2 = 0 THEN 'Canal Road' ELSE ' ' END AS address_2, cast(null AS string) AS address_3, '' AS address_4, pin AS pin_code, gstin AS gst_number, CASE WHEN k % 3 = 0 THEN '' ELSE pan END AS pan, ifsc FROM v_ids")
    return rc.onboarding(w).withColumns({"bank_ifsc": C("bank.ifsc"), "derived": F.array_join("derived", ",")}).drop("bank")


@query("payload_fit", """WITH f AS (SELECT s_suppkey, trim(s_name) AS n, concat('Unit ', s_suppkey, ', ', 'Long Building Name Number ', s_nationkey) AS a FROM supplier), c AS (SELECT *, substr(a, 1, 20) AS head FROM f),
w AS (SELECT *, CASE WHEN length(a) <= 20 THEN a ELSE regexp_replace(CASE WHEN substr(a, 21, 1) = ' ' OR regexp_replace(head, '\\s+\\S*$', '') = '' THEN head ELSE regexp_replace(head, '\\s+\\S*$', '') END, '[ ,;]+$', '') END AS fit FROM c)
SELECT s_suppkey, concat('{"Name":"', n, '","Address":"', fit, '"}') AS payload, CASE WHEN length(a) > 20 THEN ['Address'] ELSE [] END AS truncated, concat('card(''', replace('O''Neil', '''', ''''''), ''')') AS url FROM w""")
def payload_fit(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "SELECT s_suppkey, s_name, concat('Unit ', cast(s_suppkey AS string), ', ', 'Long Building Name Number ', cast(s_nationkey AS string)) AS a, '  ' AS b FROM supplier")
    return rc.payload(s, "s_suppkey", {"s_name": "Name", "a": "Address", "b": "Phone"}, {"Address": 20}).withColumn("url", rc.card_url("card", F.lit("O'Neil")))


_DUP = "u AS (SELECT k, gstin, trim(udyam) AS udyam FROM v_ids)"


@query("blank_to_null_unique", "SELECT k, CASE WHEN trim(udyam) <> '' THEN udyam END AS udyam, coalesce(CASE WHEN trim(udyam) <> '' THEN udyam END, '') AS shown FROM v_ids")
def blank_to_null_unique(spark: SparkSession, sf: str) -> DataFrame:
    r = rc.blanks_to_null(view(spark, sf, "SELECT k, udyam FROM v_ids"), ["udyam"])
    return r.withColumn("shown", F.coalesce("udyam", F.lit("")))


@query("find_duplicates", f"""WITH {_DUP} SELECT k, coalesce(g, d) AS duplicate_of, CASE WHEN g IS NOT NULL THEN 'gstin' ELSE 'udyam' END AS "by" FROM (
  SELECT u.k, (SELECT min(v.k) FROM u v WHERE v.gstin = u.gstin AND v.k <> u.k) AS g, (SELECT min(v.k) FROM u v WHERE v.udyam = u.udyam AND u.udyam <> '' AND v.k <> u.k) AS d FROM u) WHERE g IS NOT NULL OR d IS NOT NULL""")
def find_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    u = view(spark, sf, "SELECT k, gstin, udyam FROM v_ids")
    return rc.find_duplicates(u, u, "k", ["gstin", "udyam"])


@query("insertable_rows", f"WITH {_DUP}, old AS (SELECT * FROM u WHERE k % 2 = 0) SELECT k FROM u WHERE k % 2 = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.gstin = u.gstin) AND NOT EXISTS (SELECT 1 FROM old WHERE old.udyam = u.udyam AND u.udyam <> '')")
def insertable_rows(spark: SparkSession, sf: str) -> DataFrame:
    u = view(spark, sf, "SELECT k, gstin, udyam FROM v_ids")
    return rc.insertable(u.where("k % 2 = 1"), u.where("k % 2 = 0"), ["gstin", "udyam"]).select("k")


@query("insert_conflicts", f"WITH {_DUP}, old AS (SELECT * FROM u WHERE k % 2 = 0) SELECT u.k, 'udyam' AS kind, u.udyam AS value, min(old.k) AS existing_id FROM u JOIN old ON old.udyam = u.udyam AND u.udyam <> '' WHERE u.k % 2 = 1 GROUP BY u.k, u.udyam UNION ALL SELECT u.k, 'gstin', u.gstin, min(old.k) FROM u JOIN old ON old.gstin = u.gstin WHERE u.k % 2 = 1 GROUP BY u.k, u.gstin")
def insert_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    u = view(spark, sf, "SELECT k, gstin, udyam FROM v_ids")
    return rc.insert_conflicts(u.where("k % 2 = 1"), u.where("k % 2 = 0"), "k", ["gstin", "udyam"])


@query("partial_update", "SELECT k, CASE WHEN k % 4 = 0 THEN 'new' ELSE name END AS name, CASE WHEN k % 4 = 0 THEN NULL ELSE email END AS email, phone FROM v_ids")
def partial_update(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "SELECT k, name, email, phone FROM v_ids")
    return rc.partial_update(rows, rows.where("k % 4 = 0").select("k", F.expr("map('name', 'new', 'email', cast(null AS string))").alias("patch")), "k")


@query("update_conflicts", f"WITH {_DUP}, c AS (SELECT k, CASE WHEN k % 2 = 0 THEN gstin ELSE (SELECT min(gstin) FROM u) END AS v FROM u WHERE k % 5 = 0) SELECT c.k, 'gstin' AS kind, min(u.k) AS existing_id FROM c JOIN u ON u.gstin = c.v AND u.k <> c.k GROUP BY c.k")
def update_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "SELECT k, gstin FROM v_ids")
    least = rows.agg(F.min("gstin")).scalar()
    changes = rows.where("k % 5 = 0").select("k", F.create_map(F.lit("gstin"), F.when(C("k") % 2 == 0, C("gstin")).otherwise(least)).alias("patch"))
    return rc.update_conflicts(rows, changes, "k", ["gstin"])


@query("delete_rows", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_rows(spark: SparkSession, sf: str) -> DataFrame:
    ids = view(spark, sf, "SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R'")
    return rc.delete_rows(view(spark, sf, "SELECT o_orderkey, o_orderstatus FROM orders"), ids, "o_orderkey")


@query("newest_first_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 20")
def newest_first_page(spark: SparkSession, sf: str) -> DataFrame:
    return rc.newest_page(view(spark, sf, "SELECT o_orderkey, o_orderdate FROM orders"), "o_orderdate", "o_orderkey", 20)


@query("active_tokens", "SELECT event_id, user_id FROM events WHERE event_type <> 'click' AND user_id % 10 <> 3 AND ts > (SELECT min(ts) FROM events)")
def active_tokens(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "SELECT event_id, user_id, event_type = 'click' AS revoked, ts AS expires_at, (SELECT min(ts) FROM events) AS now FROM events")
    return rc.active_tokens(rc.revoke(e, C("user_id") % 10 == 3), C("now")).select("event_id", "user_id")


@query("mark_pushed", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pushed' WHEN o_orderstatus = 'F' THEN 'pushed' ELSE 'not_pushed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'conflict' ELSE 'pushed' END END AS outcome FROM orders")
def mark_pushed(spark: SparkSession, sf: str) -> DataFrame:
    o = view(spark, sf, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'pushed' ELSE 'not_pushed' END AS status FROM orders")
    return rc.mark_pushed(o, o.where("o_orderkey % 3 = 0"), "o_orderkey")


def _cells(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('pan', 'Main', 'B2'), ('gstin', 'Main', 'B3'), ('email', 'Main', 'B4'), ('udyam', 'More', 'C9') AS t(field, sheet, cell)")


def _record(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "SELECT k AS set_id, stack(5, 'pan', pan, 'gstin', gstin, 'email', email, 'udyam', udyam, 'phone', phone) AS (field, value) FROM v_ids")


_FILL = "cells AS (SELECT k AS set_id, 'pan' AS field, 'Main' AS sheet, 'B2' AS cell, trim(pan) AS value FROM v_ids UNION ALL SELECT k, 'gstin', 'Main', 'B3', trim(gstin) FROM v_ids UNION ALL SELECT k, 'email', 'Main', 'B4', trim(email) FROM v_ids UNION ALL SELECT k, 'udyam', 'More', 'C9', trim(udyam) FROM v_ids)"


@query("cell_map_fill", f"WITH {_FILL} SELECT set_id, sheet, cell, field, value, value <> '' AS written FROM cells")
def cell_map_fill(spark: SparkSession, sf: str) -> DataFrame:
    return rc.fill_cells(_record(spark, sf), _cells(spark))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    e = rc.fill_cells(_record(spark, sf), _cells(spark))
    actual = e.where("NOT (set_id % 10 = 0 AND field = 'email')").withColumn("value", F.when(C("set_id") % 3 == 0, F.lower("value")).otherwise(F.concat("value", F.when((C("set_id") % 7 == 1) & (C("field") == "pan"), "x").otherwise(""))))
    return rc.verify_cells(e, actual)


_REPORT = f"""{_FILL}, rep AS (SELECT set_id, field, value AS expected, CASE WHEN set_id % 10 = 0 AND field = 'email' THEN '' WHEN set_id % 3 = 0 THEN lower(value) WHEN set_id % 7 = 1 AND field = 'pan' THEN concat(value, 'x') ELSE value END AS actual FROM cells)"""


@query("write_verification", f"WITH {_REPORT} SELECT *, lower(expected) = lower(actual) AS ok FROM rep")
def write_verification(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)


@query("verification_summary", f"WITH {_REPORT} SELECT set_id, count(*) FILTER (WHERE lower(expected) = lower(actual)) AS passed, count(*) FILTER (WHERE lower(expected) <> lower(actual)) AS failed, CAST(floor(count(*) FILTER (WHERE lower(expected) = lower(actual)) * 1000 / count(*)::DOUBLE) AS BIGINT) AS success_rate FROM rep GROUP BY set_id")
def verification_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rc.verification_summary(_report(spark, sf))


@query("registry_annotation", "SELECT k, CASE WHEN k % 2 = 0 AND k % 6 <> 0 THEN 'warning' ELSE 'valid' END AS status, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 6 = 0 THEN 'Active' ELSE 'Cancelled' END END AS registry_status, CASE WHEN k % 2 = 0 THEN name END AS legal_name FROM v_ids")
def registry_annotation(spark: SparkSession, sf: str) -> DataFrame:
    ids = view(spark, sf, "SELECT k, name FROM v_ids")
    status = F.when(C("k") % 6 == 0, "Active").otherwise("Cancelled")
    nested = F.to_json(F.struct(F.struct(status.alias("gstin_status"), C("name").alias("legal_name")).alias("profile")))
    flat = F.to_json(F.struct(status.alias("status"), C("name").alias("lgnm")))
    reg = ids.where("k % 2 = 0").select("k", F.when(C("k") % 4 == 0, nested).otherwise(flat).alias("body"))
    return rc.annotate(ids.select("k", F.lit("valid").alias("status")), reg, "k")


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    truth = view(spark, sf, "SELECT k AS set_id, stack(3, 'pan', CASE WHEN k % 8 = 0 THEN '' ELSE pan END, 'name', name, 'pin', pin) AS (field, expected) FROM v_ids")
    got = view(spark, sf, "SELECT k AS set_id, stack(3, 'pan', lower(pan), 'name', CASE WHEN k % 5 = 0 THEN 'Other' ELSE upper(name) END, 'pin', CASE WHEN k % 7 = 0 THEN ' ' ELSE concat(pin, '.0') END) AS (field, value) FROM v_ids")
    return ev.field_verdicts(truth, got, ["pan", "pin"])


_VERDICT = "ver AS (SELECT k AS set_id, 'pan' AS field, CASE WHEN k % 8 = 0 THEN 'hallucinated' ELSE 'correct' END AS verdict FROM v_ids UNION ALL SELECT k, 'name', CASE WHEN k % 5 = 0 THEN 'wrong' ELSE 'correct' END FROM v_ids UNION ALL SELECT k, 'pin', CASE WHEN k % 7 = 0 THEN 'missed' ELSE 'correct' END FROM v_ids)"


@query("field_verdicts", f"WITH {_VERDICT} SELECT * FROM ver")
def field_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf)


@query("verdict_summary", f"""WITH {_VERDICT}, n AS (SELECT field, count(*) FILTER (WHERE verdict = 'wrong') AS wrong, count(*) FILTER (WHERE verdict = 'hallucinated') AS hallucinated, count(*) FILTER (WHERE verdict = 'missed') AS missed, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) FILTER (WHERE verdict = 'correctly_absent') AS correctly_absent FROM ver GROUP BY field)
SELECT *, CAST(floor(correct * 1000 / nullif(correct + wrong + missed, 0)::DOUBLE) AS BIGINT) AS recall, CAST(floor(correct * 1000 / nullif(correct + wrong + hallucinated, 0)::DOUBLE) AS BIGINT) AS "precision", CAST(floor((correct + correctly_absent) * 1000 / (correct + wrong + missed + hallucinated + correctly_absent)::DOUBLE) AS BIGINT) AS accuracy FROM n""")
def verdict_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ev.verdict_summary(_verdicts(spark, sf), ["field"])


@query("address_block", f"WITH {_VERDICT} SELECT set_id, bool_and(verdict = 'correct') AS exact, count(*) FILTER (WHERE verdict = 'correct') AS \"right\", count(*) AS total FROM ver WHERE field IN ('name', 'pin') GROUP BY set_id")
def address_block(spark: SparkSession, sf: str) -> DataFrame:
    return ev.address_block(_verdicts(spark, sf), ["name", "pin"])


@query("partition_scores", """SELECT k AS address_id, k % 3 <> 0 AS split_match, CASE WHEN k % 4 = 1 THEN 1.0 ELSE 0.0 END AS same FROM v_addresses""")
def partition_scores(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "SELECT k AS address_id, premises AS address_1, road AS address_2, 1 AS split_index FROM v_addresses")
    p = view(spark, sf, "SELECT k AS address_id, CASE WHEN k % 4 = 1 THEN premises ELSE 'x' END AS address_1, road AS address_2, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS split_index FROM v_addresses")
    return ev.partition_scores(a, p).select("address_id", "split_match", F.when(C("jaccard") == 1.0, 1.0).otherwise(0.0).alias("same"))


@query("label_eval", "SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic <> 1 AND quality = 1) AS fp, count(*) FILTER (WHERE toxic = 1 AND quality <> 1) AS fn, count(*) FILTER (WHERE toxic <> 1 AND quality <> 1) AS tn FROM labels JOIN documents USING (doc_id)")
def label_eval(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "SELECT toxic, quality FROM labels JOIN documents USING (doc_id)")
    return ev.binary_scores(rows, C("toxic") == 1, C("quality") == 1)


@query("dim_lookup_build", """WITH r AS (SELECT lpad(cast(c_nationkey * 10 + c_custkey % 3 AS varchar), 6, '1') AS pin, n_name AS state, concat('D', cast(c_custkey % 2 AS varchar)) AS district, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT pin, arg_min(state, c_custkey) AS state, arg_min(district, c_custkey) AS district FROM r GROUP BY pin) SELECT f.*, (SELECT count(*) FROM r WHERE r.pin = f.pin AND (r.state <> f.state OR r.district <> f.district)) AS collisions FROM f""")
def dim_lookup_build(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "SELECT lpad(cast(c_nationkey * 10 + c_custkey % 3 AS string), 6, '1') AS pin, n_name AS state, concat('D', cast(c_custkey % 2 AS string)) AS district, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
    return config.build_pin_directory(rows, "c_custkey")


_TAGS = "['PREMISES', 'BUILDING', 'ROAD', 'LOCALITY', 'CITY']"


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "SELECT k, array(premises, building, road, locality, city) AS segments, CASE WHEN k % 17 = 0 THEN array('PREMISES') ELSE array('PREMISES', 'BUILDING', 'ROAD', 'LOCALITY', 'CITY') END AS tags, CASE WHEN k % 3 = 0 THEN 2 ELSE 3 END AS split_index FROM v_addresses")
    return a


_VOCAB = f"""a AS (SELECT k, [premises, building, road, locality, city] AS segs FROM v_addresses), z AS (SELECT k, unnest(segs) AS seg, unnest({_TAGS}) AS tag FROM a WHERE k % 17 <> 0),
voc AS (SELECT word, tag, count(*) AS n FROM (SELECT unnest(string_split(lower(seg), ' ')) AS word, tag FROM z) GROUP BY word, tag)"""


@query("segment_vocab", f"WITH {_VOCAB} SELECT * FROM voc")
def segment_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return ml.segment_vocab(_tagged(spark, sf))


_PROB = f"""{_VOCAB}, pr AS (SELECT word, tag, CAST(floor(n * 1000000 / (sum(n) OVER (PARTITION BY word))::DOUBLE) AS BIGINT) AS p FROM voc
UNION ALL SELECT NULL, tag, CAST(floor(sum(n) * 1000000 / (SELECT sum(n) FROM voc)::DOUBLE) AS BIGINT) FROM voc GROUP BY tag)"""


@query("type_probabilities", f"WITH {_PROB} SELECT * FROM pr")
def type_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return ml.type_probabilities(ml.segment_vocab(_tagged(spark, sf)))


@query("rule_based_split", f"""WITH {_PROB}, s AS (SELECT k, generate_subscripts(segs, 1) - 1 AS i, unnest(segs) AS seg FROM a), w AS (SELECT k, i, unnest(string_split(lower(seg), ' ')) AS word FROM s),
t AS (SELECT k, i, pr.tag, sum(pr.p) AS sc FROM w JOIN pr ON (pr.word = w.word) OR (pr.word IS NULL AND w.word NOT IN (SELECT word FROM voc)) GROUP BY k, i, pr.tag), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY sc DESC, tag) AS n FROM t) WHERE n = 1)
SELECT k, CAST(coalesce(min(i) FILTER (WHERE i > 0 AND tag IN ('LOCALITY', 'CITY')), count(*)) AS INT) AS cut, CASE WHEN count(*) < 2 THEN 10 WHEN min(i) FILTER (WHERE i > 0 AND tag IN ('LOCALITY', 'CITY')) IS NULL THEN 2 ELSE 8 END AS confidence FROM b GROUP BY k""")
def rule_based_split(spark: SparkSession, sf: str) -> DataFrame:
    a = _tagged(spark, sf)
    return ml.rule_based_split(ml.likely_tags(a, ml.type_probabilities(ml.segment_vocab(a))), ["LOCALITY", "CITY"])


@query("cut_point_training", f"""WITH {_VOCAB} SELECT k, cut, 5 AS total, CAST(cut = CASE WHEN k % 3 = 0 THEN 2 ELSE 3 END AS INT) AS label, length(segs[cut])::DOUBLE AS left_length, len(string_split(segs[cut + 1], ' '))::DOUBLE AS right_words, CASE WHEN regexp_matches(segs[cut], '[0-9]') THEN 1.0 ELSE 0.0 END AS left_has_digit FROM a CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(cut)""")
def cut_point_training(spark: SparkSession, sf: str) -> DataFrame:
    return ml.cut_table(_tagged(spark, sf)).select("k", "cut", "total", "label", "left_length", "right_words", "left_has_digit")


@query("vocabulary_features", f"""WITH {_PROB}, d AS (SELECT DISTINCT seg FROM (SELECT unnest(segs) AS seg FROM a)), w AS (SELECT seg, unnest(string_split(lower(seg), ' ')) AS word FROM d),
m AS (SELECT w.seg, w.word, t.tag, EXISTS (SELECT 1 FROM voc WHERE voc.word = w.word) AS held FROM w CROSS JOIN (SELECT DISTINCT tag FROM voc) t),
v AS (SELECT m.*, CASE WHEN held THEN coalesce((SELECT p FROM pr WHERE pr.word = m.word AND pr.tag = m.tag), 0) ELSE (SELECT p FROM pr WHERE pr.word IS NULL AND pr.tag = m.tag) END AS p FROM m)
SELECT seg AS segment, avg(p) FILTER (WHERE tag = 'ROAD') AS "p_ROAD", avg(p) FILTER (WHERE tag = 'CITY') AS "p_CITY", max(CASE WHEN held THEN 1.0 ELSE 0.0 END) AS known FROM v GROUP BY seg""")
def vocabulary_features(spark: SparkSession, sf: str) -> DataFrame:
    a = _tagged(spark, sf)
    return ml.vocabulary_features(a.select(F.explode("segments").alias("segment")), ml.type_probabilities(ml.segment_vocab(a)), ["ROAD", "CITY"])


@query("forest_split_predict")
def forest_split_predict(spark: SparkSession, sf: str) -> DataFrame:
    """A smaller forest than the operator's own settings make: 20 trees of depth 8."""
    a = _tagged(spark, sf)
    t = ml.with_vocabulary(ml.cut_table(a), a, ml.type_probabilities(ml.segment_vocab(a)), ["BUILDING", "CITY", "LOCALITY", "PREMISES", "ROAD"])
    return ml.predict(ml.train(t, trees=20, depth=8), t)


#: Captions as they leak: whole, misread, cut by a wrapped line, by their words, and values that are none.
_LEAKS = "CASE k % 8 WHEN 0 THEN 'Trade Name, if any' WHEN 1 THEN 'Micro Enterprise :' WHEN 2 THEN 'Address of the Firm' WHEN 3 THEN 'Principal Place of' WHEN 4 THEN 'Legal Narne of Business' WHEN 5 THEN 'Legal' ELSE name END"
_LABELS = ("Legal Name of Business", "Address of Principal Place of Business", "PAN")


@query("caption_leak", f"SELECT k, {_LEAKS} AS value, k % 8 < 5 AS leak FROM v_ids")
def caption_leak(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, f"SELECT k, {_LEAKS} AS value FROM v_ids").withColumn("leak", rs.caption_leak(C("value"), _LABELS))


@query("best_text_value", f"SELECT k AS set_id, CASE WHEN k % 8 < 5 THEN CASE WHEN k % 3 = 0 THEN '' ELSE name END ELSE {_LEAKS} END AS value, k % 8 < 5 AND k % 3 <> 0 AS flagged FROM v_ids")
def best_text_value(spark: SparkSession, sf: str) -> DataFrame:
    """A leaked caption gives way to the first alternative that is none; some have no other."""
    rows = view(spark, sf, f"SELECT k AS set_id, 'vendor_name' AS field, {_LEAKS} AS value, array(named_struct('value', 'Legal Name of', 'score', 3L), named_struct('value', CASE WHEN k % 3 = 0 THEN 'Small' ELSE name END, 'score', 2L)) AS alternatives FROM v_ids")
    out, flags = rs.without_leaks(rows, ["vendor_name"], _LABELS)
    marked = out.join(flags.select("set_id", F.lit(True).alias("flagged")), "set_id", "left")
    return marked.select("set_id", "value", F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query("junk_filter", "SELECT set_id, field, seq FROM (SELECT *, value IN ('val1', 'val2') AS junk, bool_and(value IN ('val1', 'val2')) OVER (PARTITION BY set_id, field) AS every FROM v_candidates) WHERE NOT junk OR every")
def junk_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rs.drop_junk(view(spark, sf, "v_candidates"), C("value").isin("val1", "val2")).select("set_id", "field", "seq")


@query("combined_address_backfill", f"""WITH {_LINES}
SELECT k AS set_id, lines[1] AS address_1, lines[2] AS address_2, lines[3] AS address_3, lines[4] AS address_4, CASE WHEN k % 2 = 0 THEN 'Typed' ELSE nullif(city, '') END AS city, nullif(state, '') AS state,
  CASE WHEN k % 5 = 0 AND pin = '' THEN '' WHEN k % 5 = 0 THEN '999999' ELSE nullif(pin, '') END AS pin_code, len(lines) - 1 + CASE WHEN k % 2 = 1 AND city <> '' THEN 1 ELSE 0 END + CASE WHEN state <> '' THEN 1 ELSE 0 END + CASE WHEN k % 5 <> 0 AND pin <> '' THEN 1 ELSE 0 END AS flags FROM l""")
def combined_address_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """An address on one line, as the whole dataflow takes it apart: a typed city stays, a PIN told by its shape alone goes if the address has none."""
    rows = view(spark, sf, """SELECT k AS set_id, inline(array(named_struct('field', 'address_1', 'value', address, 'score', 800000L, 'kind', 'adjacent', 'source', '0'),
      named_struct('field', 'city', 'value', CASE WHEN k % 2 = 0 THEN 'Typed' END, 'score', 800000L, 'kind', 'inline', 'source', '0'), named_struct('field', 'state', 'value', cast(null AS string), 'score', cast(null AS bigint), 'kind', '', 'source', ''),
      named_struct('field', 'pin_code', 'value', CASE WHEN k % 5 = 0 THEN '999999' END, 'score', 800000L, 'kind', 'pattern_only', 'source', '0'), named_struct('field', 'address_2', 'value', cast(null AS string), 'score', cast(null AS bigint), 'kind', '', 'source', ''),
      named_struct('field', 'address_3', 'value', cast(null AS string), 'score', cast(null AS bigint), 'kind', '', 'source', ''), named_struct('field', 'address_4', 'value', cast(null AS string), 'score', cast(null AS bigint), 'kind', '', 'source', ''))) FROM v_addresses""")
    results, flags = combined_address(rows)
    wide = rs.canonical(results, ["address_1", "address_2", "address_3", "address_4", "city", "state", "pin_code"])
    return wide.join(flags.groupBy("set_id").agg(F.count("*").alias("flags")), "set_id", "left").withColumn("flags", F.coalesce("flags", F.lit(0)))


@query("wrapped_value_join", r"""
WITH t AS (SELECT *, CASE WHEN length(lag(text) OVER w) - length(replace(lag(text) OVER w, ',', '')) >= 2 AND NOT regexp_matches(lag(text) OVER w, '[,;–—]\s*$') AND NOT regexp_matches(text, '^\s*[,;]') THEN ', ' ELSE ' ' END AS sep FROM v_spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord))
SELECT s.doc_id, s.page, s.ord, string_agg(CASE WHEN t.ord = s.ord THEN t.text ELSE concat(t.sep, t.text) END, '' ORDER BY t.ord) AS value
FROM v_spans s JOIN t ON t.doc_id = s.doc_id AND t.page = s.page AND t.ord BETWEEN s.ord AND s.ord - s.ord % 5 + 3 WHERE s.ord % 5 <> 4 GROUP BY s.doc_id, s.page, s.ord""")
def wrapped_value_join(spark: SparkSession, sf: str) -> DataFrame:
    """From each line that is no caption, the lines that go on below it; every fifth one is a caption."""
    s = lo.page_lines(view(spark, sf, "SELECT *, ord % 5 = 4 AS caption FROM v_spans"))
    return ma.wrapped_values(s, s.where("not caption"), ["doc_id", "page"])


@query("own_label_strip", "SELECT set_id, doc, seq, trim(value) AS bare FROM v_form_spans")
def own_label_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Values behind their caption once, twice, misread, or not at all."""
    s = view(spark, sf, """SELECT set_id, doc, seq, field, CASE (set_id + doc) % 4 WHEN 0 THEN concat(label, ': ', value) WHEN 1 THEN concat(label, ' - ', label, ' : ', value)
      WHEN 2 THEN concat(CASE WHEN length(label) > 12 THEN replace(label, 'u', 'v') ELSE label END, ' | ', value) ELSE value END AS text FROM v_form_spans""")
    bare = ma.strip_own_labels(s.select("field", "text").distinct(), SPECS)
    return s.join(bare, ["field", "text"]).select("set_id", "doc", "seq", "bare")


# One address for each rule of the city, with what it resolves to: rest, city, state, PIN, confidence.
_CITY_CASES = [
    ("Shop {k}, Pune, Station Road, Maharashtra 411001", ["Shop {k}", "Station Road"], "Pune", "Maharashtra", "411001", "high"),
    ("Shop {k}, RAMPURA, WEST, BENGAL", ["Shop {k}"], "Rampura", "West Bengal", "", "medium"),
    ("Shop {k}, Natibpur, 711302", ["Shop {k}", "Natibpur"], "Howrah", "West Bengal", "711302", "medium"),
    ("Shop {k}, NOIDA SECTOR 62, Uttar Pradesh", ["Shop {k}", "SECTOR 62"], "Noida", "Uttar Pradesh", "", "medium"),
    ("Shop {k}, Kondli, DELHI", ["Shop {k}", "Kondli"], "Delhi", "Delhi", "", "medium"),
    ("Shop {k}, B, GHAZIPUR ROAD, Gujarat", ["Shop {k}", "B", "GHAZIPUR ROAD"], "", "Gujarat", "", "low"),
    ("Shop {k}, Kolkata, Howrah 711302, India", ["Shop {k}"], "Kolkata", "West Bengal", "711302", "high"),
    ("Shop {k}, HOWRAH, 711302, Gujarat", ["Shop {k}"], "Howrah", "Gujarat", "711302", "low"),
    ("Shop {k}\nUdyog Road", ["Shop {k}", "Udyog Road"], "", "", "", "low"),
    (" , India", [], "", "", "", "low"),
]


def _case(i: int, fill) -> str:
    return "CASE c_custkey % 10 " + " ".join(f"WHEN {n} THEN {fill(c[i])}" for n, c in enumerate(_CITY_CASES)) + " END"


def _filled(text: str) -> str:
    return "replace('" + text.replace("\n", "' || chr(10) || '") + "', '{k}', cast(c_custkey AS varchar(20)))"


_quoted = "'{}'".format


@query("city_rules", f"SELECT c_custkey AS k, {_case(1, lambda r: '[' + ', '.join(map(_filled, r)) + ']')} AS rest, {_case(2, _quoted)} AS city, {_case(3, _quoted)} AS state, {_case(4, _quoted)} AS pin, {_case(5, _quoted)} AS confidence FROM customer")
def city_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, f"SELECT c_custkey AS k, {_case(0, _filled)} AS address FROM customer")
    pins = spark.sql("SELECT * FROM VALUES ('711302', 'WEST BENGAL', 'Howrah') AS t(pin, state, district)")
    return ad.resolve_address(rows, "address", pins=pins).select("k", "rest", "city", "state", "pin", "confidence")


@query("onboarding_review", """WITH r AS (SELECT k AS set_id, unnest(['pin_code', 'tan', 'address_2', 'vendor_name', 'address_1']) AS field, unnest([4, 1, 2, 9, 3]) AS seq, k % 3 AS gap FROM v_ids)
SELECT set_id, CASE WHEN gap = 0 THEN ['billing_address', 'company_name'] ELSE ['billing_address', 'zip_code', 'company_name'] END AS fields_needing_review FROM r GROUP BY set_id, gap""")
def onboarding_review(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "SELECT k AS set_id, stack(5, 'pin_code', 4, 'tan', 1, 'address_2', 2, 'vendor_name', 9, 'address_1', 3) AS (field, seq) FROM v_ids").where("NOT (set_id % 3 = 0 AND field = 'pin_code')")
    return ob.review_names(r)


@query("source_documents", """SELECT user_id AS set_id, list(struct_pack(file_name := concat('f', event_id, '.pdf'), document_type := CASE event_type WHEN 'click' THEN 'PAN Card' WHEN 'view' THEN 'Tax Notice' ELSE 'Other' END,
  confidence := least(1.0, round_even(CAST(event_id % 300 AS DOUBLE) / 128, 2))) ORDER BY event_id) AS source_documents FROM events GROUP BY user_id""")
def source_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = view(spark, sf, "SELECT user_id AS set_id, event_id AS doc, concat('f', cast(event_id AS string), '.pdf') AS name, CASE event_type WHEN 'click' THEN 'pan_card' WHEN 'view' THEN 'tax_notice' ELSE 'other' END AS doc_type, cast(event_id % 300 AS double) / 128 AS score FROM events")
    return ob.source_documents(d)


@query("valid_identifiers", "SELECT k AS set_id, field, CASE WHEN k % 4 = 0 AND field <> 'email' THEN '' ELSE value END AS value FROM (SELECT k, 'pan' AS field, pan AS value FROM v_ids UNION ALL SELECT k, 'gst_number', gstin FROM v_ids UNION ALL SELECT k, 'email', email FROM v_ids)")
def valid_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "SELECT k AS set_id, CASE WHEN k % 4 = 0 THEN 'invalid' ELSE 'valid' END AS status, stack(3, 'pan', pan, 'gst_number', gstin, 'email', email) AS (field, value) FROM v_ids")
    return ob.valid_results(r).select("set_id", "field", "value")


@query("result_documents", f"""WITH {_VERDICT} SELECT set_id, count(*) AS fields, count(*) FILTER (WHERE verdict <> 'correct') AS flags, max(CASE WHEN field = 'name' THEN verdict END) AS name, 3 AS total FROM ver GROUP BY set_id""")
def result_documents(spark: SparkSession, sf: str) -> DataFrame:
    r = _verdicts(spark, sf).select("set_id", "field", C("verdict").alias("value"))
    flags = r.where("value <> 'correct'").select("set_id", "field", C("value").alias("reason"), F.lit("warning").alias("severity"))
    one = ob.result_documents(r, flags, r.groupBy("set_id").agg(F.count("*").alias("total")))
    return one.select("set_id", F.size("fields").cast("long").alias("fields"), F.greatest(F.size("needs_review"), F.lit(0)).cast("long").alias("flags"), F.element_at("canonical", F.lit("name")).alias("name"), C("summary.total").cast("int").alias("total"))


@query("address_tally", f"""WITH {_VERDICT}, c AS (SELECT *, CASE WHEN set_id % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM ver), a AS (SELECT set_id, confidence, bool_and(verdict = 'correct') AS exact FROM c GROUP BY ALL)
SELECT confidence, count(*) AS addresses, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE NOT exact AND confidence = 'high' OR exact AND confidence = 'low') AS miscalibrated FROM a GROUP BY confidence""")
def address_tally(spark: SparkSession, sf: str) -> DataFrame:
    v = _verdicts(spark, sf)
    return ev.confidence_tally(v, v.select("set_id", F.when(C("set_id") % 2 == 0, "high").otherwise("low").alias("confidence")).distinct())


@query("partition_means", """WITH s AS (SELECT CASE WHEN k % 3 = 0 THEN 0.0 ELSE 1.0 END AS m, CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS same FROM v_addresses)
SELECT count(*) AS addresses, CAST(round(avg(m) * 1000000) AS BIGINT) AS split_match, count(*) FILTER (WHERE same = 1) AS same FROM s""")
def partition_means(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "SELECT k AS address_id, premises AS address_1, road AS address_2, 1 AS split_index FROM v_addresses")
    p = view(spark, sf, "SELECT k AS address_id, CASE WHEN k % 4 = 1 THEN premises ELSE 'x' END AS address_1, road AS address_2, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS split_index FROM v_addresses")
    scores = ev.partition_scores(a, p)
    return ev.partition_means(scores).select("addresses", F.round(C("split_match") * 1_000_000).cast("long").alias("split_match"), "same")


@query("baseline_split", f"WITH {_RESOLVED} SELECT k, array_to_string(rest, ', ') AS address_1, '' AS address_2, len(rest) AS split_index FROM r")
def baseline_split(spark: SparkSession, sf: str) -> DataFrame:
    return ev.baseline_split(view(spark, sf, "SELECT k, address FROM v_addresses"), "address", "k")


#: A slip for each address: it stands on two rows beside its caption, some have a PIN or a country of their own, and each an e-mail address.
SLIPS = """WITH s AS (SELECT k, concat(premises, CASE WHEN k % 9 = 0 THEN '' ELSE ', ' END) AS head, address, pin, concat('Desk.', translate(cast(k AS string), '0123456789', 'abcdefghij'), CASE WHEN k % 2 = 0 THEN '@gmail.com' ELSE concat('@shop', cast(k % 50 AS string), '.example.com') END) AS mail FROM v_addresses),
t AS (SELECT k, 0 AS ord, 'Registered Address' AS text, 100 AS x, 100 AS y FROM s
  UNION ALL SELECT k, 1, trim(head), 300, 100 FROM s UNION ALL SELECT k, 2, trim(substr(address, length(head) + 1)), 300, 134 FROM s
  UNION ALL SELECT k, 3, 'PIN Code', 100, 500 FROM s WHERE k % 6 = 0 UNION ALL SELECT k, 4, pin, 220, 500 FROM s WHERE k % 6 = 0
  UNION ALL SELECT k, 5, 'Email', 100, 900 FROM s UNION ALL SELECT k, 6, mail, 220, 900 FROM s
  UNION ALL SELECT k, 7, 'Country', 100, 1300 FROM s WHERE k % 4 = 0 UNION ALL SELECT k, 8, 'Wonderland', 220, 1300 FROM s WHERE k % 4 = 0)
SELECT k AS set_id, 0 AS doc, 'slip' AS doc_type, 1 AS page, ord, text, cast(x AS double) AS x1, cast(y AS double) AS y1, cast(x + 8 * length(text) AS double) AS x2, cast(y + 30 AS double) AS y2, cast(1 AS double) AS confidence FROM t"""
SLIP_SPECS = [
    ma.FieldSpec("address_1", ["Registered Address"]), *[ma.FieldSpec(n) for n in ("address_2", "address_3", "address_4", "city", "state")],
    ma.FieldSpec("pin_code", ["PIN Code"], ["[1-9][0-9]{5}"]), ma.FieldSpec("country", ["Country"], default="India"), ma.FieldSpec("email", ["Email"]), ma.FieldSpec("website", derive_from="email"),
]


@query("resolve_addresses", f"""WITH {_LINES},
r AS (SELECT l.*, a.pin AS printed, concat('Desk.', translate(CAST(l.k AS VARCHAR), '0123456789', 'abcdefghij'), CASE WHEN l.k % 2 = 0 THEN '@gmail.com' ELSE concat('@shop', CAST(l.k % 50 AS VARCHAR), '.example.com') END) AS mail FROM l JOIN v_addresses a ON l.k = a.k),
f AS (SELECT k, unnest([{{'f': 'address_1', 'v': lines[1], 's': '0', 'kind': 'adjacent'}}, {{'f': 'address_2', 'v': lines[2], 's': 'address_resolver', 'kind': NULL}}, {{'f': 'address_3', 'v': lines[3], 's': 'address_resolver', 'kind': NULL}},
  {{'f': 'address_4', 'v': lines[4], 's': 'address_resolver', 'kind': NULL}}, {{'f': 'city', 'v': city, 's': 'address_resolver', 'kind': NULL}}, {{'f': 'state', 'v': state, 's': 'address_resolver', 'kind': NULL}},
  {{'f': 'pin_code', 'v': CASE WHEN k % 6 = 0 THEN printed ELSE pin END, 's': '0', 'kind': CASE WHEN k % 6 = 0 THEN 'adjacent' ELSE 'pattern_only' END}}, {{'f': 'country', 'v': 'India', 's': 'config_default', 'kind': NULL}}, {{'f': 'email', 'v': mail, 's': '0', 'kind': 'adjacent'}},
  {{'f': 'website', 'v': CASE WHEN k % 2 = 1 THEN concat('www.shop', CAST(k % 50 AS VARCHAR), '.example.com') END, 's': 'derived_from_email', 'kind': NULL}}]) AS c FROM r),
g AS (SELECT k, c.f AS field, nullif(c.v, '') AS value, c.s AS source, c.kind AS kind FROM f)
SELECT k AS set_id, field, value, CASE WHEN value IS NOT NULL THEN source END AS source, CASE WHEN value IS NOT NULL THEN kind END AS kind,
  CASE WHEN value IS NULL THEN 'missing' WHEN field IN ('state', 'pin_code', 'country', 'email') THEN 'valid' ELSE 'not_validated' END AS status FROM g""")
def resolve_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """The whole dataflow over addresses in one value: wrapped rows, what the address gives, PINs found by shape or printed, defaults
    for what is blank or refused, and the e-mail address's site."""
    results, _, _ = extract(view(spark, sf, SLIPS), SLIP_SPECS, va.ID_RULES)
    return results.select("set_id", "field", "value", "source", "kind", "status")
