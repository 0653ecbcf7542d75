"""Queries by name, each with its DuckDB twin; derived input views that both dialects define alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL that Spark and DuckDB read alike, over the driver's tables. A view may use those before it.
COMMON_VIEWS = {
    "v_ids": """
SELECT k, concat('Orbit ', translate(cast(k AS string), '0123456789', 'abcdefghij'), CASE WHEN k % 2 = 0 THEN ' Traders' ELSE ' Foods' END) AS name,
  concat(letters, lpad(cast((7 * k) % 10000 AS string), 4, '0'), last) AS pan,
  concat(lpad(cast(1 + k % 45 AS string), 2, '0'), CASE WHEN k % 7 = 0 THEN other ELSE letters END, lpad(cast((7 * k) % 10000 AS string), 4, '0'), last, '1Z', last) AS gstin,
  CASE WHEN k % 5 = 0 THEN concat('a8cdO', lpad(cast(k AS string), 6, '0')) WHEN k % 5 = 1 THEN concat('ABCD0', cast(k AS string)) ELSE concat('ABCD0', lpad(cast(k AS string), 6, '0')) END AS ifsc,
  CASE k % 3 WHEN 0 THEN concat('+91 ', mobile) WHEN 1 THEN concat('91', mobile) ELSE mobile END AS phone,
  CASE k % 4 WHEN 0 THEN concat('User', cast(k AS string), '@gmail.com') WHEN 1 THEN concat('info@shop', cast(k % 50 AS string), '.example.com') WHEN 2 THEN 'no-address' ELSE '' END AS email,
  CASE WHEN k % 11 = 0 THEN '  ' ELSE concat('UDYAM-WB-07-', lpad(cast(CASE WHEN k % 13 = 0 THEN k - 1 ELSE k END AS string), 7, '0')) END AS udyam,
  cast(100000 + (k * 7919) % 900000 AS string) AS pin, c_nationkey, c_acctbal, c_mktsegment
FROM (
  SELECT c_custkey AS k, c_nationkey, c_acctbal, c_mktsegment, translate(lpad(cast(c_custkey AS string), 5, '0'), '0123456789', 'ABCDEFGHJK') AS letters,
    translate(lpad(cast(c_custkey + 1 AS string), 5, '0'), '0123456789', 'ABCDEFGHJK') AS other, chr(cast(65 + c_custkey % 26 AS int)) AS last,
    concat('9', lpad(cast(c_custkey AS string), 9, '0')) AS mobile FROM customer) b""",
    "v_names": """
SELECT k, i, CASE WHEN (k + i) % 4 = 0 THEN replace(damaged, ' ', '') ELSE damaged END AS name FROM (
  SELECT k, i, CASE WHEN (k + i) % 6 = 0 THEN replace(full_name, 'N', 'M') ELSE full_name END AS damaged FROM (
    SELECT s_suppkey AS k, i, concat('NIMBUS ', translate(cast(s_suppkey AS string), '0123456789', 'KLMNOPQRST'), ' GOODS',
      CASE s_suppkey % 8 WHEN 0 THEN ' PVT LTD' WHEN 1 THEN ' Private Limited' WHEN 2 THEN ' llp' WHEN 3 THEN ' Corporation' WHEN 4 THEN ' enterprises' WHEN 5 THEN ' Company' WHEN 6 THEN '' ELSE ' Industries Ltd' END) AS full_name
    FROM supplier CROSS JOIN (VALUES (0), (1), (2)) AS t(i)) a) b""",
    "v_addresses": """
SELECT k, city, state, pin, premises, building, road, locality,
  CASE WHEN k % 9 = 0 THEN concat(premises, ' ', building, ' ', road, ' ', locality, ' ', city)
    ELSE concat(premises, ', ', building, ',', road, ' ,  ', locality, ', ', city, ', ', state, CASE WHEN k % 3 <> 0 THEN concat(' - ', pin) ELSE '' END, CASE WHEN k % 5 = 0 THEN ', India' ELSE '' END) END AS address
FROM (
  SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Flat 12' WHEN 1 THEN 'Plot No 7' WHEN 2 THEN 'Shop 3' ELSE '2nd Floor' END AS premises,
    CASE c_custkey % 3 WHEN 0 THEN 'Sunrise Tower' WHEN 1 THEN 'Lake Heights' ELSE 'Green Complex' END AS building,
    CASE c_custkey % 5 WHEN 0 THEN 'Canal Road' WHEN 1 THEN 'Station Road' WHEN 2 THEN 'Park Street' WHEN 3 THEN 'Ring Road' ELSE 'Temple Lane' END AS road,
    CASE (c_custkey + c_nationkey) % 4 WHEN 0 THEN 'Rajpur' WHEN 1 THEN 'Haripur Colony' WHEN 2 THEN 'Nandigram' ELSE 'East Sector' END AS locality,
    CASE c_custkey % 6 WHEN 0 THEN 'Kolkata' WHEN 1 THEN 'Pune' WHEN 2 THEN 'Jaipur' WHEN 3 THEN 'Surat' WHEN 4 THEN 'Mysuru' ELSE 'Nagpur' END AS city,
    CASE c_custkey % 6 WHEN 0 THEN 'West Bengal' WHEN 1 THEN 'Maharashtra' WHEN 2 THEN 'Rajasthan' WHEN 3 THEN 'Gujarat' WHEN 4 THEN 'KARNATAKA' ELSE 'Maharastra' END AS state,
    cast(CASE c_custkey % 6 WHEN 0 THEN 700001 WHEN 1 THEN 411001 WHEN 2 THEN 302001 WHEN 3 THEN 395001 WHEN 4 THEN 570001 ELSE 440001 END + c_custkey % 20 AS string) AS pin
  FROM customer) b""",
    "v_form_spans": """
SELECT k AS set_id, d AS doc, r AS seq, field, concat(caption, CASE WHEN (k + r) % 6 = 0 THEN ' :' ELSE '' END) AS caption, value, caption AS label,
  cast(100 AS double) AS cx1, cast(100 + 60 * r AS double) AS cy1, cast(100 + 8 * length(caption) AS double) AS cx2, cast(130 + 60 * r AS double) AS cy2,
  cast(CASE WHEN (k + r) % 5 = 0 THEN 104 ELSE 112 + 8 * length(caption) + 15 * (k % 4) END AS double) AS vx1,
  cast(CASE WHEN (k + r) % 5 = 0 THEN 135 + 60 * r ELSE 102 + 60 * r END AS double) AS vy1, cast(0.80 + 0.01 * (k % 20) AS double) AS conf
FROM (
  SELECT k, d, r, field, caption, CASE field WHEN 'pan' THEN pan WHEN 'gst_number' THEN gstin WHEN 'ifsc' THEN ifsc WHEN 'telephone' THEN phone ELSE email END AS value
  FROM v_ids CROSS JOIN (VALUES (0), (1), (2)) AS t(d)
  CROSS JOIN (VALUES (0, 'pan', 'Permanent Account Number'), (1, 'gst_number', 'GSTIN'), (2, 'ifsc', 'IFS Code'), (3, 'telephone', 'Mobile No'), (4, 'email', 'E-mail Id')) AS f(r, field, caption)) b
WHERE value <> ''""",
    "v_candidates": """
SELECT user_id % 50 AS set_id, event_type AS field, event_id % 3 AS doc, event_id AS seq, cast(floor(value * 1000) AS bigint) % 1000001 AS score,
  CASE event_id % 4 WHEN 0 THEN 'inline' WHEN 1 THEN 'adjacent' ELSE 'pattern_only' END AS kind, concat('val', cast(event_id % 7 AS string)) AS value FROM events""",
}
#: The documents' lines, which the dialects split in their own way.
SPARK_VIEWS = {"v_lines": "SELECT doc_id, pos AS line_no, trim(line) AS text FROM documents LATERAL VIEW posexplode(split(coalesce(text, ''), '\n')) AS pos, line WHERE trim(line) <> ''"}
DUCK_VIEWS = {"v_lines": "SELECT doc_id, line_no - 1 AS line_no, trim(line) AS text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents) WHERE trim(line) <> ''"}
#: Each line as a laid-out span, 47 lines a page.
SPANS = """
SELECT doc_id, cast(n AS int) AS ord, cast(floor(n / 47.0) AS int) + 1 AS page, text, cast(150 AS double) AS x1, cast(150 + 44 * (n % 47) AS double) AS y1,
  cast(150 + least(15 * length(text), 1354) AS double) AS x2, cast(194 + 44 * (n % 47) AS double) AS y2
FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS n FROM v_lines) b"""
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needed(sql: str, views: dict[str, str]) -> list[str]:
    names: list[str] = []
    for name in reversed(list(views)):
        if name in sql or any(name in views[n] for n in names):
            names.append(name)
    return names[::-1]


def with_views(sql: str, own: dict[str, str]) -> str:
    views = COMMON_VIEWS | own | {"v_spans": SPANS}
    names = _needed(sql, views)
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({views[n]})" for n in names)
    body = sql.lstrip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the driver's tables and the derived views; a bare name selects it all."""
    text = with_views(sql if " " in sql else f"SELECT * FROM {sql}", SPARK_VIEWS)
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def query(name: str, oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = with_views(oracle, DUCK_VIEWS)
        return f

    return add
