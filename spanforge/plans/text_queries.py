"""Queries of the text, rule and similarity functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import similarity as sim
from spanforge.functions import text as tx
from spanforge.operators import match as ma
from spanforge.operators import validate as va
from spanforge.plans.registry import query, view

C = F.col


@query("norm_chain", """
SELECT k, regexp_replace(CASE WHEN regexp_full_match(p, '(\\+?91)[\\s\\-]?[6-9][0-9]{9}') THEN regexp_replace(p, '^\\+?91[\\s\\-]?', '') ELSE p END, '[^0-9]', '', 'g') AS phone,
  CASE WHEN length(i) = 11 THEN concat(translate(substr(upper(i), 1, 4), '015826', 'OISBZG'), '0', substr(upper(i), 6)) ELSE i END AS ifsc,
  lower(e) AS email, upper(regexp_replace(name, '\\s+', '', 'g')) AS squashed
FROM (SELECT k, trim(phone) AS p, regexp_replace(ifsc, '\\s+', '', 'g') AS i, trim(regexp_replace(email, '\\s+', ' ', 'g')) AS e, name FROM v_ids)""")
def norm_chain(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_ids").select(
        "k", tx.normalize(C("phone"), ["strip", "strip_country_code", "digits_only"]).alias("phone"), tx.normalize(C("ifsc"), ["remove_spaces", "fix_ifsc_confusions"]).alias("ifsc"),
        tx.normalize(C("email"), ["collapse_spaces", "lowercase"]).alias("email"), tx.normalize(C("name"), ["remove_spaces", "uppercase"]).alias("squashed"))


_PEEL = """p{n} AS (SELECT k, i, name, CASE WHEN t IS NULL THEN tail ELSE substr(tail, 1, length(tail) - length(t)) END AS tail, CASE WHEN t IS NULL THEN sfx ELSE concat(' ', CASE t WHEN 'privatelimited' THEN 'PRIVATE LIMITED' WHEN 'pvtltd' THEN 'PVT LTD' ELSE upper(t) END, sfx) END AS sfx FROM (
  SELECT *, list_filter(['privatelimited', 'private', 'limited', 'pvtltd', 'pvt', 'ltd', 'llp', 'opc', 'plc', 'company', 'corporation', 'corp', 'incorporated', 'enterprises', 'enterprise', 'industries'], lambda x: ends_with(lower(tail), x) AND length(tail) - length(x) >= 4)[1] AS t FROM p{m}))"""


@query("norm_corporate_suffix", """
WITH p0 AS (SELECT k, i, name, name AS tail, '' AS sfx FROM v_names WHERE name NOT LIKE '% %'), """ + ", ".join(_PEEL.format(n=n, m=n - 1) for n in (1, 2, 3)) + """
SELECT k, i, concat(tail, sfx) AS canonical FROM p3
UNION ALL
SELECT k, i, regexp_replace(regexp_replace(regexp_replace(name, ' (?i)(pvt ltd|private limited|llp|corporation|enterprises|company|ltd)$', ''), ' (?i)industries$', ''), '$', '') ||
  CASE WHEN regexp_matches(name, '(?i) (pvt ltd|private limited|llp|corporation|enterprises|company|industries ltd|industries)$') THEN ' ' || upper(regexp_extract(name, '(?i) (pvt ltd|private limited|llp|corporation|enterprises|company|industries ltd|industries)$', 1)) ELSE '' END
FROM v_names WHERE name LIKE '% %'""")
def norm_corporate_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_names").select("k", "i", tx.split_corporate_suffix(C("name")).alias("canonical"))


@query("norm_known_phrase", """
WITH f AS (SELECT k, CASE k % 5 WHEN 0 THEN 'PRIVATELIMITEDCOMPANY' WHEN 1 THEN 'Partnership  Firm' WHEN 2 THEN 'HINDUUNDIVIDEDFAMILY' WHEN 3 THEN 'Bright Limited' ELSE 'trust' END AS form, CASE WHEN k % 2 = 0 THEN upper(name) ELSE name END AS name FROM v_ids)
SELECT k, CASE lower(regexp_replace(form, '\\s+', '', 'g')) WHEN 'privatelimitedcompany' THEN 'private limited company' WHEN 'partnershipfirm' THEN 'partnership firm' WHEN 'hinduundividedfamily' THEN 'hindu undivided family' WHEN 'trust' THEN 'trust' ELSE form END AS form,
  array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS titled,
  CASE WHEN name = upper(name) THEN array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE name END AS city_style FROM f""")
def norm_known_phrase(spark: SparkSession, sf: str) -> DataFrame:
    f = view(spark, sf, "SELECT k, CASE k % 5 WHEN 0 THEN 'PRIVATELIMITEDCOMPANY' WHEN 1 THEN 'Partnership  Firm' WHEN 2 THEN 'HINDUUNDIVIDEDFAMILY' WHEN 3 THEN 'Bright Limited' ELSE 'trust' END AS form, CASE WHEN k % 2 = 0 THEN upper(name) ELSE name END AS name FROM v_ids")
    return f.select("k", tx.expand_known_phrase(C("form")).alias("form"), tx.NORMALIZERS["titlecase"](C("name")).alias("titled"), tx.titlecase_city(C("name")).alias("city_style"))


@query("clean_label_keys", """
SELECT set_id, doc, seq, lower(trim(regexp_replace(regexp_replace(caption, '^[\\s\\-:.|*]+|[\\s\\-:.|*]+$', '', 'g'), '\\s+', ' ', 'g'))) AS label,
  trim(regexp_replace(concat(' : ', value), '^[\\s:\\-–—=|.,)#]+', '')) AS bare, regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') AS squash, lower(string_split(trim(caption), ' ')[1]) AS first_word
FROM v_form_spans""")
def clean_label_keys(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "v_form_spans")
    return s.select("set_id", "doc", "seq", tx.clean_label(C("caption")).alias("label"), tx.strip_value_prefix(F.concat(F.lit(" : "), "value")).alias("bare"), tx.squash_key(C("value")).alias("squash"), tx.first_word(C("caption")).alias("first_word"))


@query("alias_canonicalize", """
SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, 'URGENT|HIGH') THEN 'fast' WHEN regexp_matches(o_orderpriority, '^[45]') THEN 'slow' ELSE o_orderpriority END AS priority FROM orders""")
def alias_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "orders").select("o_orderkey", tx.canonicalize(C("o_orderpriority"), [("fast", "URGENT|HIGH"), ("slow", "^[45]")]).alias("priority"))


@query("email_domain_derive", """
SELECT k, CASE k % 4 WHEN 0 THEN CASE k % 3 WHEN 0 THEN 'www.b.example.org' WHEN 1 THEN NULL ELSE CASE WHEN k % 5 = 0 THEN 'www.works.example.com' END END WHEN 1 THEN concat('www.shop', k % 50, '.example.com') END AS website FROM v_ids""")
def email_domain_derive(spark: SparkSession, sf: str) -> DataFrame:
    """Free hosts of several countries, dots and spaces at the end, more than one @."""
    free = "CASE k % 5 WHEN 0 THEN 'me@WORKS.example.com. ' WHEN 1 THEN 'me@yahoo.co.in' WHEN 2 THEN 'me@vsnl.net' WHEN 3 THEN 'me@host' ELSE 'me@Proton.me' END"
    mails = f"CASE WHEN k % 4 <> 0 THEN email WHEN k % 3 = 0 THEN 'a@b.example.org' WHEN k % 3 = 1 THEN 'x@googlemail.com' ELSE {free} END"
    return view(spark, sf, f"SELECT k, {mails} AS email FROM v_ids").select("k", tx.email_domain(C("email")).alias("website"))


_WIDE = """SELECT k, name AS vendor_name, pan, gstin AS gst_number, ifsc, udyam AS udyam_number, email, phone AS telephone, CASE WHEN k % 10 = 0 THEN concat('0', pin) ELSE pin END AS pin_code,
  CASE k % 4 WHEN 0 THEN 'west bengal' WHEN 1 THEN 'Maharastra' WHEN 2 THEN 'Atlantis' ELSE ' ' END AS state, CASE WHEN k % 6 = 0 THEN 'Indya' ELSE 'india' END AS country,
  CASE WHEN k % 5 = 0 THEN concat('12 34', pin) WHEN k % 5 = 1 THEN '123' ELSE concat('1234', pin) END AS account_number, CASE WHEN k % 2 = 0 THEN 'ABCD12345K' ELSE concat('ABCD', cast(k AS string), 'K') END AS tan,
  CASE WHEN k % 3 = 0 THEN '12345678901234567' WHEN k % 3 = 1 THEN '1234567890123456x' ELSE '' END AS esic_number FROM v_ids"""
#: A PIN directory that knows two thirds of the PINs.
_PINS = "SELECT pin, CASE WHEN k % 8 = 0 THEN 'West Bengal' ELSE 'Maharashtra' END AS state, 'Somewhere' AS district FROM v_ids WHERE k % 3 <> 0"
_RULES = f"""n AS ({_WIDE}), p AS ({_PINS}), f AS (
  SELECT k, 'vendor_name' AS field, 'non_empty' AS rule, trim(vendor_name) <> '' AS ok, 'error' AS severity FROM n
  UNION ALL SELECT k, 'pan', 'pan_format', CASE WHEN pan <> '' THEN regexp_full_match(pan, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') END, 'error' FROM n
  UNION ALL SELECT k, 'gst_number', 'gstin_format', regexp_full_match(gst_number, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]'), 'error' FROM n
  UNION ALL SELECT k, 'gst_number', 'gstin_contains_pan', substr(gst_number, 3, 10) = pan, 'error' FROM n
  UNION ALL SELECT k, 'gst_number', 'gstin_state_code', CAST(substr(gst_number, 1, 2) AS INT) BETWEEN 1 AND 38, 'warning' FROM n
  UNION ALL SELECT k, 'tan', 'tan_format', regexp_full_match(tan, '[A-Z]{{4}}[0-9]{{5}}[A-Z]'), 'error' FROM n
  UNION ALL SELECT k, 'esic_number', 'esic_format', CASE WHEN esic_number <> '' THEN regexp_full_match(esic_number, '[0-9]{{17}}') END, 'warning' FROM n
  UNION ALL SELECT k, 'ifsc', 'ifsc_format', regexp_full_match(ifsc, '[A-Z]{{4}}0[A-Z0-9]{{6}}'), 'error' FROM n
  UNION ALL SELECT k, 'udyam_number', 'udyam_format', CASE WHEN trim(udyam_number) <> '' THEN regexp_full_match(udyam_number, 'UDYAM-[A-Z]{{2}}-[0-9]{{2}}-[0-9]{{7}}') END, 'error' FROM n
  UNION ALL SELECT k, 'email', 'email_format', CASE WHEN email <> '' THEN regexp_full_match(email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') END, 'error' FROM n
  UNION ALL SELECT k, 'telephone', 'indian_phone', regexp_full_match(telephone, '[6-9][0-9]{{9}}'), 'error' FROM n
  UNION ALL SELECT k, 'pin_code', 'pin_format', regexp_full_match(pin_code, '[1-9][0-9]{{5}}'), 'error' FROM n
  UNION ALL SELECT k, 'state', 'indian_state', CASE WHEN trim(state) <> '' THEN state = 'west bengal' END, 'warning' FROM n
  UNION ALL SELECT k, 'state', 'pin_matches_state', CASE WHEN trim(n.state) <> '' AND p.state IS NOT NULL THEN CASE n.state WHEN 'west bengal' THEN 'West Bengal' WHEN 'Maharastra' THEN 'Maharashtra' ELSE n.state END = p.state END, 'warning' FROM n LEFT JOIN p ON p.pin = n.pin_code
  UNION ALL SELECT k, 'country', 'country_name', country = 'india', 'error' FROM n
  UNION ALL SELECT k, 'account_number', 'account_number_format', regexp_full_match(account_number, '[0-9]{{9,18}}'), 'error' FROM n)"""


@query("identifier_rules", f"WITH {_RULES} SELECT k, field, rule, ok, severity FROM f WHERE ok IS NOT NULL")
def identifier_rules(spark: SparkSession, sf: str) -> DataFrame:
    wide = va.with_pin_state(view(spark, sf, _WIDE), view(spark, sf, _PINS))
    return va.findings(wide, ["k"], va.ID_RULES).select("k", "field", "rule", "ok", "severity")


@query("pin_matches_state", f"WITH {_RULES} SELECT k, ok FROM f WHERE rule = 'pin_matches_state' AND ok IS NOT NULL")
def pin_matches_state(spark: SparkSession, sf: str) -> DataFrame:
    wide = va.with_pin_state(view(spark, sf, _WIDE), view(spark, sf, _PINS))
    return wide.select("k", va.pin_state(C("state")).alias("ok")).where("ok is not null")


@query("validation_status", """
WITH n AS (SELECT k, regexp_full_match(gstin, '[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]') AND substr(gstin, 3, 10) = pan AS e, CAST(substr(gstin, 1, 2) AS INT) BETWEEN 1 AND 38 AS w FROM v_ids)
SELECT k, CASE WHEN NOT e THEN 'invalid' WHEN NOT w THEN 'warning' ELSE 'valid' END AS status FROM n""")
def validation_status(spark: SparkSession, sf: str) -> DataFrame:
    wide = view(spark, sf, "SELECT k, pan, gstin AS gst_number FROM v_ids")
    found = va.findings(wide, ["k"], [r for r in va.ID_RULES if r.field == "gst_number"])
    return va.status_by(found, ["k"])


@query("token_boundary_scan", """
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS w FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_full_match(w, '[0-9]{4,10}')) AS n_numbers, coalesce(max(w) FILTER (WHERE regexp_full_match(w, '[0-9]{4,10}')), '') AS largest FROM t GROUP BY doc_id""")
def token_boundary_scan(spark: SparkSession, sf: str) -> DataFrame:
    m = tx.bounded_matches(C("text"), "[0-9]{4,10}")
    return view(spark, sf, "documents").select("doc_id", m.alias("m")).select("doc_id", F.size("m").cast("long").alias("n_numbers"), F.coalesce(F.array_max("m"), F.lit("")).alias("largest"))


@query("glued_scan", """
SELECT k, i, CASE WHEN len(b) > 0 THEN b[1] WHEN len(g) > 0 THEN g[1] END AS found FROM (SELECT k, i, list_filter(regexp_split_to_array(name, '[^A-Za-z0-9]+'), lambda x: regexp_full_match(x, 'GOODS|GOODX')) AS b, regexp_extract_all(replace(name, ' ', ''), 'GOODS|GOODX') AS g FROM v_names)""")
def glued_scan(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_names").select("k", "i", F.get(tx.bounded_or_glued_matches(C("name"), "GOODS|GOODX"), 0).alias("found"))


@query("exclude_patterns", "SELECT page_id, url AS value FROM pages WHERE NOT coalesce(regexp_matches(url, '(?i)example\\.net|/es/'), false)")
def exclude_patterns(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "pages").select("page_id", F.lit("website").alias("field"), C("url").alias("value"))
    spec = ma.FieldSpec("website", exclude=[r"(?i)example\.net", "/es/"])
    return ma.without_excluded(rows, [spec]).drop("field")


@query("comparison_keys", """
SELECT k, trim(regexp_replace(lower(regexp_replace(regexp_replace(address, '\\s*,\\s*', ', ', 'g'), '\\s+', ' ', 'g')), '^[ ,]+|[ ,]+$', '', 'g')) AS address_key,
  upper(regexp_replace(regexp_replace(concat(pin, '.0'), '\\.0$', ''), '\\s+', '', 'g')) AS exact_key, lower(trim(regexp_replace(regexp_replace(address, '[^A-Za-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS loose_key,
  pin AS written_key, list_filter(list_transform(string_split(address, ','), lambda s: trim(s)), lambda s: s <> '') AS segments FROM v_addresses""")
def comparison_keys(spark: SparkSession, sf: str) -> DataFrame:
    pin = F.concat("pin", F.lit(".0"))
    return view(spark, sf, "v_addresses").select("k", tx.address_key(C("address")).alias("address_key"), tx.field_key(pin, True).alias("exact_key"), tx.field_key(C("address"), False).alias("loose_key"), tx.verification_key(pin).alias("written_key"), tx.segments(C("address")).alias("segments"))


_LCS = """list_last(list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda z: 0), list_transform(range(1, length({a}) + 1), lambda i: [i::INT])), lambda prev, i:
  list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: [j::INT])), lambda cur, j: list_append(cur, CASE WHEN substr({a}, i[1], 1) = substr({b}, j[1], 1) THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], cur[-1]) END))))"""


@query("indel_ratio_pairs", f"SELECT p_partkey, CAST(floor(200000000.0 * {_LCS.format(a='p_name', b='p_brand')} / (length(p_name) + length(p_brand))) AS BIGINT) AS ratio FROM part")
def indel_ratio_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "part").select("p_partkey", sim.ratio_micro(C("p_name"), C("p_brand")).alias("ratio"))


@query("token_ratios", f"""
WITH s AS (SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS a, array_to_string(list_sort(string_split(p_type, ' ')), ' ') AS b, list_distinct(string_split(lower(p_name), ' ')) AS x, list_distinct(string_split(lower(p_type), ' ')) AS y FROM part)
SELECT p_partkey, CAST(floor(200000000.0 * {_LCS.format(a='a', b='b')} / (length(a) + length(b))) AS BIGINT) AS token_sort, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE AS jaccard FROM s""")
def token_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "part").select("p_partkey", sim.token_sort_ratio_micro(C("p_name"), C("p_type")).alias("token_sort"), sim.token_jaccard(C("p_name"), C("p_type")).alias("jaccard"))


@query("partial_alignment", """
WITH s AS (SELECT set_id, doc, seq, lower(label) AS label, CASE WHEN (set_id + seq) % 3 = 0 THEN 3 ELSE 0 END AS start, set_id % 4 = 0 AND contains(label, 'N') AS slip FROM v_form_spans),
w AS (SELECT *, length(label) AS n, CASE WHEN slip AND label = 'gstin' THEN 4 WHEN slip THEN length(label) - 1 ELSE length(label) END AS lcs, CASE WHEN slip AND label = 'gstin' THEN 4 ELSE length(label) END AS size FROM s)
SELECT set_id, doc, seq, round(200.0 * lcs / (n + size), 4) AS score, start AS dest_start, start + size AS dest_end FROM w""")
def partial_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Captions within spans that hold a caption, sometimes misread or behind other letters, and its value. A misread last letter is left out."""
    s = view(spark, sf, "SELECT set_id, doc, seq, lower(label) AS label, lower(concat(CASE WHEN (set_id + seq) % 3 = 0 THEN 'x. ' ELSE '' END, CASE WHEN set_id % 4 = 0 THEN replace(label, 'N', 'M') ELSE label END, ' ', value)) AS text FROM v_form_spans")
    a = sim.aligned(C("label"), C("text"))
    return s.select("set_id", "doc", "seq", a.alias("a")).select("set_id", "doc", "seq", F.bround("a.score", 4).alias("score"), "a.dest_start", "a.dest_end")


@query("partial_ratio_windows", """
WITH p AS (SELECT p_partkey, lower(split_part(p_type, ' ', 1)) AS a, lower(p_name) AS b FROM part), w AS (SELECT p_partkey, a, b, unnest(range(length(b))) AS i FROM p), v AS (SELECT *, unnest(range(1, 1 + least(length(a), length(b) - i))) AS k FROM w),
m AS (SELECT *, substr(b, i + 1, k) AS win FROM v), l AS (SELECT p_partkey, length(a) AS n, k, list_reduce(list_transform(string_split(win, ''), lambda x: list_reduce(list_transform(range(length(a)), lambda j: CASE WHEN substr(a, j + 1, 1) = x THEN (1::BIGINT << j) ELSE 0::BIGINT END), lambda g, h: g + h)), lambda s, hit: (((s + (s & hit)) & 4611686018427387903) | (s - (s & hit)))::BIGINT, 4611686018427387903::BIGINT) AS bits FROM m)
SELECT p_partkey, round(max(200.0 * (62 - bit_count(bits)) / (n + k)), 6) AS ratio FROM l GROUP BY p_partkey""")
def partial_ratio_windows(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "SELECT p_partkey, lower(split_part(p_type, ' ', 1)) AS a, lower(p_name) AS b FROM part")
    return p.select("p_partkey", F.round(sim.aligned(C("a"), C("b"))["score"], 6).alias("ratio"))
