"""Queries of layout, matching and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import geometry as geo
from spanforge.operators import layout as lo
from spanforge.operators import match as ma
from spanforge.operators import validate as va
from spanforge.plans.extract import extract
from spanforge.plans.registry import query, view

C = F.col
PAN, GSTIN, IFSC = "[A-Z]{5}[0-9]{4}[A-Z]", "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]", "[A-Z]{4}0[A-Z0-9]{6}"
SPECS = [
    ma.FieldSpec("pan", ["Permanent Account Number", "PAN"], [PAN], ["remove_spaces", "uppercase"], ["tax_card"]),
    ma.FieldSpec("gst_number", ["GSTIN", "Registration Number"], [GSTIN], ["remove_spaces", "uppercase"], ["tax_card"]),
    ma.FieldSpec("ifsc", ["IFS Code", "IFSC"], [IFSC], ["remove_spaces", "fix_ifsc_confusions"], ["bank_form"]),
    ma.FieldSpec("telephone", ["Mobile No", "Telephone"], ["[6-9][0-9]{9}"], ["strip_country_code", "digits_only"], ["bank_form"]),
    ma.FieldSpec("email", ["E-mail Id", "Email"], (), ["collapse_spaces", "lowercase"], ["bank_form"]),
]


@query("synthetic_layout", "SELECT doc_id, ord, page, x1, y1, x2, y2 FROM v_spans")
def synthetic_layout(spark: SparkSession, sf: str) -> DataFrame:
    return lo.synthetic_layout(view(spark, sf, "v_lines")).select("doc_id", "ord", "page", "x1", "y1", "x2", "y2")


@query("span_geometry", """
SELECT doc_id, ord, x2 - x1 AS width, (x1 + x2) / 2 AS cx, 1000 - y2 AS flipped, CASE WHEN p IS NULL THEN 0.0 ELSE greatest(0.0, least(x2, px2) - greatest(x1, px1)) / least(x2 - x1, px2 - px1) END AS h_overlap FROM (
  SELECT *, lag(ord) OVER w AS p, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2 FROM v_spans WINDOW w AS (PARTITION BY doc_id ORDER BY ord))""")
def span_geometry(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "SELECT *, lag(x1) OVER w AS p_x1, lag(x2) OVER w AS p_x2, lag(y1) OVER w AS p_y1, lag(y2) OVER w AS p_y2 FROM v_spans WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
    top, _ = geo.flip(F.lit(1000.0), C("y1"), C("y2"), F.lit(1.0))
    return s.select("doc_id", "ord", (C("x2") - C("x1")).alias("width"), ((C("x1") + C("x2")) / 2).alias("cx"), top.alias("flipped"), F.coalesce(geo.horizontal_overlap(geo.box(), geo.box("p_")), F.lit(0.0)).alias("h_overlap"))


@query("page_lines", """
SELECT doc_id, page, CAST(ord % 47 AS INT) AS line, x1, y1, x2, y2, text FROM v_spans""")
def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lo.line_boxes(lo.page_lines(view(spark, sf, "v_spans"))).select("doc_id", "page", "line", "x1", "y1", "x2", "y2", "text")


@query("reading_order", "SELECT doc_id, page, ord, CAST(ord % 47 AS INT) AS line, CAST(ord % 47 AS INT) AS read FROM v_spans")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return lo.reading_order(view(spark, sf, "v_spans")).select("doc_id", "page", "ord", "line", "read")


@query("page_text", "SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord) AS text FROM v_spans GROUP BY doc_id, page")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return lo.page_text(view(spark, sf, "v_spans"))


@query("spatial_neighbours", """
WITH p AS (SELECT a.doc_id, a.page, a.ord AS ref, b.ord AS other, a.y2 AS ay2, b.y1 AS by1, a.y1 AS ay1, b.y2 AS by2, abs(b.x1 - a.x1) AS dx FROM v_spans a JOIN v_spans b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord <> b.ord)
SELECT doc_id, page, ref, other, direction, round(ratio, 6) AS ratio FROM (
  SELECT *, CASE WHEN by1 >= ay2 - 13.2 AND greatest(0, by1 - ay2) / 44 <= 2 THEN 'below' WHEN by2 <= ay1 + 13.2 AND greatest(0, ay1 - by2) / 44 <= 2 THEN 'above' END AS direction,
    CASE WHEN by1 >= ay2 - 13.2 AND greatest(0, by1 - ay2) / 44 <= 2 THEN greatest(0, by1 - ay2) / 88 ELSE greatest(0, ay1 - by2) / 88 END AS ratio FROM p) WHERE direction IS NOT NULL""")
def spatial_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "v_spans").withColumn("median_height", F.lit(44.0))
    n = lo.neighbours(s, s, ["doc_id", "page"], 2.0)
    return n.select("doc_id", "page", "ref", "other", "direction", F.round("distance_ratio", 6).alias("ratio"))


@query("nearest_neighbours", """
WITH p AS (SELECT a.doc_id, a.page, a.ord AS ref, b.ord AS other, CASE WHEN b.y1 >= a.y2 - 13.2 THEN greatest(0, b.y1 - a.y2) ELSE greatest(0, a.y1 - b.y2) END / 88 AS ratio FROM v_spans a JOIN v_spans b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord <> b.ord)
SELECT doc_id, page, ref, other, CAST(row_number() OVER (PARTITION BY doc_id, page, ref ORDER BY ratio, other) - 1 AS INT) AS place FROM p WHERE ratio <= 1""")
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "v_spans").withColumn("median_height", F.lit(44.0))
    return lo.nearest_first(lo.neighbours(s, s, ["doc_id", "page"], 2.0), ["doc_id", "page"]).select("doc_id", "page", "ref", "other", "place")


#: The documents' lines in two columns, the first of them on either side, at uneven heights: two a row.
BOXES = """SELECT doc_id, page, ord, text, row, x1, y1, x1 + least(15 * length(text), 640) AS x2, y1 + high AS y2 FROM (
  SELECT doc_id, page, ord, text, row, cast(150 + 700 * ((ord % 47 + row) % 2) AS double) AS x1, cast(144 + 66 * row + 3 * ((7 * ord) % 5) AS double) AS y1, 44 - 4 * ((3 * ord) % 4) AS high
  FROM (SELECT doc_id, page, ord, text, cast(floor((ord % 47) / 2.0) AS int) AS row FROM v_spans) a) b"""


@query("two_column_lines", "SELECT doc_id, page, row AS line, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(text, ' ' ORDER BY x1) AS text FROM (" + BOXES + ") GROUP BY doc_id, page, row")
def two_column_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lo.line_boxes(lo.page_lines(view(spark, sf, BOXES).drop("row")))


@query("two_column_order", "SELECT doc_id, page, ord, row AS line, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY row, x1) - 1 AS INT) AS read FROM (" + BOXES + ")")
def two_column_order(spark: SparkSession, sf: str) -> DataFrame:
    return lo.reading_order(view(spark, sf, BOXES).drop("row")).select("doc_id", "page", "ord", "line", "read")


@query("mixed_neighbours", "WITH b AS (" + BOXES + """),
p AS (SELECT a.doc_id, a.page, a.ord AS ref, b.ord AS other, a.y2 - a.y1 AS u, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least(a.y2 - a.y1, b.y2 - b.y1) AS v, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / least(a.x2 - a.x1, b.x2 - b.x1) AS h,
  b.x1 - a.x2 AS to_right, b.y1 - a.y2 AS under, a.x1 - b.x2 AS to_left, a.y1 - b.y2 AS above, abs(b.x1 - a.x1) AS dx FROM b a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord <> b.ord),
d AS (SELECT *, CASE WHEN v >= 0.3 AND to_right >= -0.3 * u AND to_right <= 4 * u THEN 'right' WHEN under >= -0.3 * u AND (h >= 0.15 OR dx <= 2 * u) AND under <= 4 * u THEN 'below'
  WHEN v >= 0.3 AND to_left >= -0.3 * u AND to_left <= 4 * u THEN 'left' WHEN above >= -0.3 * u AND (h >= 0.15 OR dx <= 2 * u) AND above <= 4 * u THEN 'above' END AS direction FROM p),
f AS (SELECT *, direction IN ('right', 'left') AND v >= 0.5 AS same_line, greatest(0, CASE direction WHEN 'right' THEN to_right WHEN 'below' THEN under WHEN 'left' THEN to_left ELSE above END) / u / 4 AS ratio FROM d WHERE direction IS NOT NULL)
SELECT doc_id, page, ref, other, direction, same_line, round(ratio, 6) AS ratio, CAST(row_number() OVER (PARTITION BY doc_id, page, ref ORDER BY ratio, same_line DESC, other) - 1 AS INT) AS place FROM f""")
def mixed_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """All four directions, and each reference's neighbours by nearness."""
    s = view(spark, sf, BOXES).withColumn("median_height", F.lit(38.0))
    near = lo.nearest_first(lo.neighbours(s, s, ["doc_id", "page"], 4.0), ["doc_id", "page"])
    return near.select("doc_id", "page", "ref", "other", "direction", "same_line", F.round("distance_ratio", 6).alias("ratio"), "place")


@query("glyph_islands", """
WITH g AS (SELECT item_id, generate_subscripts(string_split(text, ' '), 1) AS w, unnest(string_split(text, ' ')) AS word FROM benchmark), l AS (SELECT item_id, w, unnest(string_split(word, chr(10))) AS part FROM g)
SELECT item_id, w AS island, part AS text FROM l WHERE part <> ''""")
def glyph_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Each word of the benchmark passages is set with wide gaps, so that islands give the words back."""
    words = view(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("w", "word")).where("word <> ''")
    g = words.select("item_id", "w", F.posexplode(F.split("word", "(?!^)")).alias("i", "ch"))
    x = (C("w") * 1000 + C("i") * 8).cast("double")
    g = g.withColumns({"ord": C("w") * 1000 + C("i"), "x1": x, "x2": x + 7.0, "y1": F.lit(0.0), "y2": F.lit(10.0)})
    s = lo.glyph_islands(g, ["item_id"])
    return s.select("item_id", (F.floor(C("x1") / 1000) + 1).cast("long").alias("island"), "text")


@query("scan_quality_route", """
SELECT page_id, CASE WHEN length(trim(coalesce(html, ''))) < 40 THEN 'no_text_layer' WHEN least(imgs / 10.0, 1) >= 0.5 THEN 'image_page' END AS reason
FROM (SELECT page_id, html, (length(html) - length(replace(html, '<img', ''))) / 4 AS imgs FROM pages)""")
def scan_quality_route(spark: SparkSession, sf: str) -> DataFrame:
    images = (F.length("html") - F.length(F.replace(C("html"), F.lit("<img"), F.lit("")))) / 4
    return view(spark, sf, "pages").select("page_id", lo.scan_route(F.length(F.trim(F.coalesce("html", F.lit("")))), F.least(images / 10, F.lit(1))).alias("reason"))


PROFILES = [("invoice", "content", "total"), ("invoice", "content", "the of"), ("letter", "content", "and the"), ("letter", "content", " der "), ("letter", "filename", "src1"), ("form", "filename", "src2"), ("form", "content", " la ")]


@query("classify_documents", """
WITH s AS (SELECT doc_id, lower(text) AS t, lower(source) AS n FROM documents), c AS (
  SELECT doc_id, CASE WHEN contains(t, 'total') THEN 20 ELSE 0 END + CASE WHEN contains(t, 'the of') THEN 20 ELSE 0 END AS i,
    CASE WHEN contains(t, 'and the') THEN 20 ELSE 0 END + CASE WHEN contains(t, ' der ') THEN 20 ELSE 0 END + CASE WHEN contains(n, 'src1') THEN 10 ELSE 0 END AS l,
    CASE WHEN contains(n, 'src2') THEN 10 ELSE 0 END + CASE WHEN contains(t, ' la ') THEN 20 ELSE 0 END AS f FROM s)
SELECT doc_id, CASE WHEN greatest(i, l, f) < 10 THEN 'other' WHEN i >= l AND i >= f THEN 'invoice' WHEN l >= f THEN 'letter' ELSE 'form' END AS doc_type, greatest(i, l, f) AS score FROM c""")
def classify_documents(spark: SparkSession, sf: str) -> DataFrame:
    return ma.classify(view(spark, sf, "SELECT doc_id, source AS name, text FROM documents"), PROFILES)


def _spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = view(spark, sf, "v_form_spans")
    caps = f.select("set_id", "doc", C("seq").alias("ord"), C("caption").alias("text"), *[C(f"c{k}").alias(k) for k in ("x1", "y1", "x2", "y2")], F.lit(30.0).alias("median_height"))
    vals = f.select("set_id", "doc", (C("seq") + 100).alias("ord"), C("value").alias("text"), C("vx1").alias("x1"), C("vy1").alias("y1"), (C("vx1") + 200).alias("x2"), (C("vy1") + 26).alias("y2"), "conf")
    return caps, vals


@query("caption_hits", """
WITH c AS (SELECT set_id, doc, seq AS ord, lower(trim(regexp_replace(caption, '[\\s\\-:.|*]+$', ''))) AS key, (set_id + doc) % 3 AS slip FROM v_form_spans),
m AS (SELECT *, length(key) AS n, CASE slip WHEN 1 THEN length(key) - 1 ELSE length(key) END AS lcs, CASE slip WHEN 2 THEN 1 ELSE 0 END AS extra FROM c)
SELECT set_id, doc, ord, CASE key WHEN 'permanent account number' THEN 'pan' WHEN 'gstin' THEN 'gst_number' WHEN 'ifs code' THEN 'ifsc' WHEN 'mobile no' THEN 'telephone' ELSE 'email' END AS field, key AS label,
  CAST(floor(floor(200000000.0 * lcs / (n + n + extra)) / 100) AS BIGINT) AS similarity FROM m WHERE 2.0 * lcs / (n + n + extra) >= CASE WHEN n <= 4 THEN 0.97 WHEN n <= 6 THEN 0.92 ELSE 0.86 END""")
def caption_hits(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the captions has a letter misread, a third one too many."""
    caps, _ = _spans(spark, sf)
    slip = (C("set_id") + C("doc")) % 3
    text = F.when(slip == 1, F.regexp_replace("text", "^(..)(.)", "$1~")).when(slip == 2, F.regexp_replace("text", "^(..)", "$1~")).otherwise(C("text"))
    return ma.label_hits(caps.withColumn("text", text), SPECS, ["set_id", "doc", "ord"]).drop("raw")


@query("adaptive_threshold_match", """
WITH c AS (SELECT DISTINCT lower(caption) AS key FROM v_form_spans)
SELECT key, CASE WHEN length(key) <= 4 THEN 0.97 WHEN length(key) <= 6 THEN 0.92 ELSE 0.86 END AS threshold FROM c""")
def adaptive_threshold_match(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "SELECT DISTINCT lower(caption) AS key FROM v_form_spans")
    return c.select("key", ma.min_similarity(C("key"), 0.86).alias("threshold"))


_BY_SHAPE = r"""
SELECT set_id, doc, seq AS ord, 'pan' AS field, value FROM v_form_spans WHERE regexp_full_match(value, '[A-Z]{5}[0-9]{4}[A-Z]')
UNION ALL SELECT set_id, doc, seq, 'gst_number', value FROM v_form_spans WHERE regexp_full_match(value, '[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]')
UNION ALL SELECT set_id, doc, seq, 'ifsc', value FROM v_form_spans WHERE regexp_full_match(value, '[A-Z]{4}0[A-Z0-9]{6}')
UNION ALL SELECT set_id, doc, seq, 'telephone', regexp_extract(value, '(?:^|[^A-Za-z0-9])([6-9][0-9]{9})$', 1) FROM v_form_spans WHERE regexp_matches(value, '(^|[^A-Za-z0-9])[6-9][0-9]{9}$')"""


@query("pattern_candidates", _BY_SHAPE)
def pattern_candidates(spark: SparkSession, sf: str) -> DataFrame:
    f = view(spark, sf, "SELECT set_id, doc, seq AS ord, value AS text FROM v_form_spans")
    return ma.pattern_hits(f, SPECS, ["set_id", "doc", "ord"])


@query("foreign_shapes", r"""
SELECT set_id, doc, seq, CASE WHEN field = 'email' THEN CASE WHEN regexp_full_match(value, '[A-Z]{5}[0-9]{4}[A-Z]') THEN 'pan' END END AS "foreign", CASE WHEN seq = 0 THEN ', ' ELSE ' ' END AS separator FROM v_form_spans""")
def foreign_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The separator: two commas and an open end give one; one comma, a comma at the end or at the next beginning don't."""
    f = view(spark, sf, "v_form_spans")
    wrapped = F.when(C("seq") == 1, ",a").when(C("seq") == 2, ",a,b, ").otherwise(",a,b")
    next_row = F.when(C("seq") == 3, ", c").when(C("seq") == 4, " ").otherwise("c, d")
    return f.select("set_id", "doc", "seq", ma.foreign_field(C("value"), C("field"), SPECS).alias("foreign"), ma.wrap_separator(F.concat("value", wrapped), next_row).alias("separator"))


_SCORE = """CAST(greatest(0, least(1000000, 350000 + CAST(floor(250000 * prox / 1000000) AS BIGINT) + CASE WHEN matched THEN 300000 WHEN field = 'email' THEN 150000 ELSE 0 END + CAST(floor(100000 * conf_m / 1000000) AS BIGINT) + CASE WHEN same_line THEN 180000 ELSE 0 END + CASE WHEN expected THEN 50000 ELSE -50000 END)) AS BIGINT)"""
#: EXPECTED: whether a field is sought in the document.
_CANDIDATES = """
g AS (SELECT c.set_id, c.doc, c.seq, c.field, v.seq AS other, v.field AS of, v.value, CAST(round(v.conf * 100) AS BIGINT) * 10000 AS conf_m, EXPECTED AS expected,
  greatest(0, least(c.cy2, v.vy1 + 26) - greatest(c.cy1, v.vy1)) / least(c.cy2 - c.cy1, 26) AS vo, greatest(0, least(c.cx2, v.vx1 + 200) - greatest(c.cx1, v.vx1)) / least(c.cx2 - c.cx1, 200) AS ho,
  c.cx1, c.cx2, c.cy2, v.vx1, v.vy1 FROM v_form_spans c JOIN v_form_spans v ON c.set_id = v.set_id AND c.doc = v.doc),
n AS (SELECT *, vo >= 0.3 AND vx1 >= cx2 - 9 AND greatest(0, vx1 - cx2) / 30 <= 4 AS is_right, vy1 >= cy2 - 9 AND (ho >= 0.15 OR abs(vx1 - cx1) <= 60) AND greatest(0, vy1 - cy2) / 30 <= 4 AS is_below FROM g),
d AS (SELECT *, CASE WHEN is_right THEN 'right' ELSE 'below' END AS direction, is_right AND vo >= 0.5 AS same_line, field = of AND CASE WHEN field = 'pan' THEN regexp_full_match(value, '[A-Z]{5}[0-9]{4}[A-Z]') WHEN field = 'gst_number' THEN regexp_full_match(value, '[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]')
    WHEN field = 'ifsc' THEN length(value) = 11 ELSE field = 'telephone' END AS matched,
    CAST(floor(greatest(0, 1 - CASE WHEN is_right THEN greatest(0, vx1 - cx2) ELSE greatest(0, vy1 - cy2) END / 30 / 4) * 1000000 + 0.0001) AS BIGINT) AS prox,
    CASE field WHEN 'ifsc' THEN concat(translate(substr(upper(value), 1, 4), '015826', 'OISBZG'), '0', substr(upper(value), 6)) WHEN 'telephone' THEN right(value, 10) WHEN 'email' THEN lower(value) ELSE value END AS clean FROM n WHERE is_right OR is_below),
s AS (SELECT set_id, doc, seq, other, field, clean AS value, direction, matched, """ + _SCORE + """ AS score FROM d WHERE matched OR field = 'email')"""
_CAND = _CANDIDATES.replace("EXPECTED", "(c.field IN ('pan', 'gst_number')) = (c.doc = 0)")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Captions, all values right of or below them within four heights, and the scores of those with their field's shape."""
    caps, vals = _spans(spark, sf)
    hits = ma.label_hits(caps, SPECS, ["set_id", "doc", "ord"]).drop("raw")
    near = lo.neighbours(caps, vals, ["set_id", "doc"], 4.0, ("right", "below"))
    rows = hits.withColumnRenamed("ord", "ref").join(near, ["set_id", "doc", "ref"]).join(vals.select("set_id", "doc", C("ord").alias("other"), C("text").alias("raw"), "conf"), ["set_id", "doc", "other"])
    rows = ma.derived_values(rows, SPECS)
    patterned = C("field").isin(*[s.key for s in SPECS if s.patterns])
    expected = C("field").isin("pan", "gst_number") == (C("doc") == 0)
    prox = F.floor(C("proximity") * 1_000_000 + 0.0001).cast("long")
    no = F.lit(False)
    total = ma.score(C("similarity"), prox, C("matched"), patterned, F.round(C("conf") * 100).cast("long") * 10_000, F.lit("adjacent"), C("same_line"), expected, no, no, F.length("value") < 1)
    return rows.where(C("matched") | ~patterned).select("set_id", "doc", C("ref").alias("seq"), (C("other") - 100).alias("other"), "field", "value", "direction", "matched", total.alias("score"))


@query("candidate_scores", "WITH " + _CAND + " SELECT * FROM s")
def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf)


#: A form's captions and values as spans of a page, with the file's name.
FORM_SPANS = """
SELECT set_id, doc, 1 AS page, seq AS ord, caption AS text, cx1 AS x1, cy1 AS y1, cx2 AS x2, cy2 AS y2, cast(1 AS double) AS confidence, CASE doc WHEN 0 THEN 'card.pdf' WHEN 1 THEN 'bank form.pdf' ELSE 'letter.pdf' END AS name FROM v_form_spans
UNION ALL SELECT set_id, doc, 1, seq + 100, value, vx1, vy1, vx1 + 200, vy1 + 26, conf, CASE doc WHEN 0 THEN 'card.pdf' WHEN 1 THEN 'bank form.pdf' ELSE 'letter.pdf' END FROM v_form_spans"""
FORM_PROFILES = [("tax_card", "filename", "card"), ("bank_form", "filename", "form")]


@query("first_pages", "SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS text FROM v_spans WHERE page <= 3 GROUP BY doc_id")
def first_pages(spark: SparkSession, sf: str) -> DataFrame:
    return lo.first_pages_text(view(spark, sf, "v_spans"), ("doc_id",))


#: All candidates of a set, the rules' bias, expected documents before others, the winner within five points, and its status.
_RESOLVE = "WITH " + _CANDIDATES.replace("EXPECTED", "c.doc = CASE WHEN c.field IN ('pan', 'gst_number') THEN 0 ELSE 1 END") + r""",
shape AS (""" + _BY_SHAPE + r"""),
every AS (SELECT set_id, doc, other AS seq, field, value, 'adjacent' AS kind, CASE WHEN field = 'email' AND regexp_full_match(value, '[6-9][0-9]{9}') THEN CAST(floor(score * 40 / 100) AS BIGINT) ELSE score END AS score FROM s WHERE value <> ''
  UNION ALL SELECT p.set_id, p.doc, p.ord, p.field, p.value, 'pattern_only', 200000 + CAST(round(f.conf * 100) AS BIGINT) * 1000 + CASE WHEN p.doc = CASE WHEN p.field IN ('pan', 'gst_number') THEN 0 ELSE 1 END THEN 50000 ELSE -50000 END
    FROM shape p JOIN v_form_spans f ON p.set_id = f.set_id AND p.doc = f.doc AND p.ord = f.seq),
judged AS (SELECT * REPLACE (CASE WHEN CASE field WHEN 'email' THEN regexp_full_match(value, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') WHEN 'pan' THEN regexp_full_match(value, '[A-Z]{5}[0-9]{4}[A-Z]') WHEN 'ifsc' THEN regexp_full_match(value, '[A-Z]{4}0[A-Z0-9]{6}')
    WHEN 'telephone' THEN regexp_full_match(value, '[6-9][0-9]{9}') ELSE regexp_full_match(value, '[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]') END THEN least(score + 100000, 1000000) ELSE CAST(floor(score * 35 / 100) AS BIGINT) END AS score),
    doc = CASE WHEN field IN ('pan', 'gst_number') THEN 0 ELSE 1 END AS wanted FROM every),
near AS (SELECT * FROM (SELECT * FROM judged QUALIFY wanted = bool_or(wanted) OVER (PARTITION BY set_id, field)) QUALIFY max(score) OVER (PARTITION BY set_id, field) - score <= 50000),
won AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY set_id, field ORDER BY least(doc, 2), kind, score DESC, doc, seq, value) = 1),
r AS (SELECT k.set_id, k.field, w.value, w.doc, w.score, w.kind FROM (SELECT DISTINCT set_id, unnest(['pan', 'gst_number', 'ifsc', 'telephone', 'email']) AS field FROM v_form_spans) k LEFT JOIN won w ON k.set_id = w.set_id AND k.field = w.field)
SELECT r.set_id, r.field, r.value, r.doc, r.score, r.kind, CASE WHEN r.value IS NULL THEN 'missing'
    WHEN r.field = 'gst_number' AND p.value IS NOT NULL AND substr(r.value, 3, 10) <> p.value THEN 'invalid' WHEN r.field = 'gst_number' AND NOT CAST(substr(r.value, 1, 2) AS INT) BETWEEN 1 AND 38 THEN 'warning'
    WHEN r.field = 'email' AND NOT regexp_full_match(r.value, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') THEN 'invalid' ELSE 'valid' END AS status, 'not_checked' AS consistency
FROM r LEFT JOIN r p ON p.set_id = r.set_id AND p.field = 'pan'"""


@query("resolve_fields", _RESOLVE)
def resolve_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The whole dataflow over forms of three documents a set: classification, candidates, winners, validation, agreement."""
    results, _, _ = extract(view(spark, sf, FORM_SPANS), SPECS, va.ID_RULES, ["tax_card", "bank_form"], FORM_PROFILES)
    return results.select("set_id", "field", "value", "doc", "score", "kind", "status", "consistency")
