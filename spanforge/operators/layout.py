"""Page layout over spans (doc_id, page, ord, text, x1, y1, x2, y2): synthetic layout, lines, reading order, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import geometry as geo
from spanforge.session import by_merge

# Lines a page, first line, line height, left edge, width of a character, widest line.
LINES_PER_PAGE, TOP, LINE_HEIGHT, LEFT, CHAR_WIDTH, MAX_WIDTH = 47, 150, 44, 150, 15, 1354
#: Bands that a page is cut into, at most, where boxes look for neighbours.
MOST_BANDS = 1024


def placed(rows: DataFrame, line: Column) -> DataFrame:
    """``rows`` (.., text) with page and box, by the number of their line in the document; 47 lines a page."""
    y1 = (TOP + LINE_HEIGHT * (line % LINES_PER_PAGE)).cast("double")
    return rows.withColumns({
        "page": (F.floor(line / LINES_PER_PAGE) + 1).cast("int"), "x1": F.lit(float(LEFT)), "y1": y1,
        "x2": (LEFT + F.least(CHAR_WIDTH * F.length("text"), F.lit(MAX_WIDTH))).cast("double"), "y2": y1 + LINE_HEIGHT,
    })


def synthetic_layout(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Places text lines on pages: ord, page and box follow from the line's rank."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return placed(lines.withColumn("ord", n), F.col("ord"))


def page_lines(spans: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """``spans`` with ``line``: a span, in the order (y1, x1, ord), joins the first line whose running mean centre is
    within max(0.6 * median height, 1), else opens one. Lines are numbered by their upper edge.

    A fold within each page, whose spans are few; pages are spread by the grouping.
    """
    spot = F.struct("y1", "x1", "ord", ((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.struct(*[F.col(f"`{c}`") for c in spans.columns if c not in keys]).alias("span"))
    pages = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(spot)).alias("s"), F.greatest(0.6 * F.median(F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1"))), F.lit(1.0)).alias("tol"))
    tol = F.coalesce("tol", F.lit(1.0))
    line_type = "array<struct<total:double,n:int,top:double>>"
    start = F.struct(F.array().cast(line_type).alias("lines"), F.array().cast("array<int>").alias("of"))

    def put(state: Column, s: Column) -> Column:
        fits = F.transform(state["lines"], lambda ln, i: F.when(F.abs(s["cy"] - ln["total"] / ln["n"]) <= tol, i))
        at = F.coalesce(F.array_min(fits), F.size(state["lines"]))
        grown = F.transform(state["lines"], lambda ln, i: F.when(i == at, F.struct((ln["total"] + s["cy"]).alias("total"), (ln["n"] + 1).alias("n"), F.least(ln["top"], s["y1"]).alias("top"))).otherwise(ln))
        new = F.array(F.struct(s["cy"].alias("total"), F.lit(1).alias("n"), s["y1"].alias("top")))
        lines = F.when(at < F.size(state["lines"]), grown).otherwise(F.concat(state["lines"], new))
        return F.struct(lines.alias("lines"), F.concat(state["of"], F.array(at.cast("int"))).alias("of"))

    folded = pages.select(*keys, "s", F.aggregate("s", start, put).alias("f"))
    tops = F.array_sort(F.transform("f.lines", lambda ln, i: F.struct(ln["top"].alias("top"), i.alias("raw"))))
    rank = lambda raw: F.array_position(F.transform("tops", lambda t: t["raw"]), raw).cast("int") - 1
    placed = folded.withColumn("tops", tops).select(*keys, F.explode(F.zip_with("s", "f.of", lambda s, raw: F.struct(s["span"].alias("span"), rank(raw).alias("line")))).alias("o"))
    return placed.select(*[c if c in keys else F.col(f"o.span.`{c}`").alias(c) for c in spans.columns], "o.line")


def reading_order(spans: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """``spans`` with ``line`` and ``read``: by line, then from the left."""
    lined = page_lines(spans, keys)
    return lined.withColumn("read", F.row_number().over(Window.partitionBy(*keys).orderBy("line", "x1", "ord")) - 1)


def line_boxes(lined: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Each line's envelope and text."""
    return lined.groupBy(*keys, "line").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.array_join(F.sort_array(F.collect_list(F.struct("x1", "ord", "text")))["text"], " ").alias("text"))


def page_text(spans: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    return spans.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct("ord", "text")))["text"], "\n").alias("text"))


def first_pages_text(spans: DataFrame, keys: tuple[str, ...] = ("set_id", "doc"), pages: int = 3) -> DataFrame:
    """(*keys, text): the text of each document's first pages, which tell its kind."""
    near = spans.withColumn("_page", F.dense_rank().over(Window.partitionBy(*keys).orderBy("page"))).where(F.col("_page") <= pages)
    return near.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "ord", "text")))["text"], "\n").alias("text"))


def _least_band(max_distance: float) -> Column:
    return F.greatest(F.coalesce("median_height", F.lit(1.0)), F.lit(1.0)) * (max_distance + 1)


def with_bands(spans: DataFrame, on: list[str], max_distance: float, is_ref: Column) -> DataFrame:
    """``spans`` with their page's ``median_height`` and the ``tall`` bands in which ``neighbours`` looks, from one pass over each page: no
    join, and no box touches more than MOST_BANDS bands."""
    w = Window.partitionBy(*on)
    height = F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1"))
    stats = {"median_height": F.median(height), "_reach": F.max(F.when(is_ref, F.coalesce(height, F.lit(0.0)))), "_low": F.min("y1"), "_high": F.max(F.greatest("y1", "y2"))}
    rows = spans.withColumns({k: c.over(w) for k, c in stats.items()})
    reach = F.greatest("_reach", "median_height", F.lit(1.0)) * (max_distance + 1)
    return rows.withColumn("tall", F.greatest(_least_band(max_distance), (F.col("_high") - F.col("_low") + 2 * reach) / MOST_BANDS)).drop("_reach", "_low", "_high")


def neighbours(refs: DataFrame, others: DataFrame, on: list[str], max_distance: float, directions: tuple[str, ...] = ("right", "below", "left", "above"), band: float | str | None = None, keep: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """(*on, ref, other, direction, distance_ratio, same_line, proximity, *keep, *carry) for spans near a reference span of their page;
    ``keep`` and ``carry`` are further columns of refs and of others.

    refs, others: (*on, ord, x1, y1, x2, y2); refs also ``median_height``. The first direction that fits wins, in
    the order right, below, left, above; distances count in the reference's heights (else the page's median, else 1).
    The join is on the page and on horizontal bands, ``band`` high (the reach of a line of the page's median height unless
    given, or named: a column of both sides, as ``with_bands`` has it), so a page of n spans doesn't meet itself whole: both sides
    are in every band that they touch, a reference with its reach, and a pair counts in the first band that they share.
    """
    columns = ["x1", "y1", "x2", "y2"]
    height = F.coalesce(F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1")), F.col("median_height"), F.lit(1.0))
    named = [band] if isinstance(band, str) else []
    tall = F.col(band) if named else F.lit(float(band)) if band else _least_band(max_distance)
    a = refs.select(*on, F.col("ord").alias("ref"), *[F.col(c).alias(f"a_{c}") for c in columns], height.alias("u"), tall.alias("tall"), *keep)
    b = others.select(*on, F.col("ord").alias("other"), *[F.col(c).alias(f"b_{c}") for c in columns], *[F.col(c).alias("tall") for c in named], *carry)
    reach = F.col("u") * (max_distance + 1)
    if not band:
        # no box touches more than MOST_BANDS bands, as a corrupt one would
        pages = a.groupBy(*on).agg(F.min("tall").alias("tall"), F.min(F.col("a_y1") - reach).alias("_low"), F.max(F.greatest("a_y1", "a_y2") + reach).alias("_high"))
        more = b.groupBy(*on).agg(F.min("b_y1").alias("_top"), F.max(F.greatest("b_y1", "b_y2")).alias("_end"))
        pages = pages.join(by_merge(more), on).select(*on, F.greatest("tall", (F.greatest("_high", "_end") - F.least("_low", "_top")) / MOST_BANDS).alias("tall"))
        a, b = a.drop("tall").join(by_merge(pages), on), b.join(by_merge(pages), on)
    tall = F.lit(float(band)) if band and not named else F.col("tall")
    touched = lambda low, high: F.sequence(F.floor(low / tall), F.floor(F.greatest(low, high) / tall))
    # nothing above is sought where no direction leads there
    up = F.col("a_y1") - reach if "above" in directions else F.least(F.col("a_y1"), F.greatest(F.col("a_y2") - F.col("u"), F.col("a_y1") - reach))
    a = a.withColumn("_low", F.floor(up / tall)).withColumn("band", F.explode(touched(up, F.col("a_y2") + reach)))
    b = b.withColumn("_top", F.floor(F.col("b_y1") / tall)).withColumn("band", F.explode(touched(F.col("b_y1"), F.col("b_y2"))))
    rows = a.drop("tall").join(by_merge(b.drop("tall")), [*on, "band"]).where((F.col("ref") != F.col("other")) & (F.col("band") == F.greatest("_low", "_top")))
    ba, bb, u = geo.box("a_"), geo.box("b_"), F.col("u")
    rows = rows.withColumns({"_v": geo.vertical_overlap(ba, bb), "_h": geo.horizontal_overlap(ba, bb)})
    v, h = F.col("_v"), F.col("_h")
    column = (h >= 0.15) | (F.abs(bb["x1"] - ba["x1"]) <= u * 2.0)
    gap = lambda d: F.greatest(F.lit(0.0), d) / u
    ways = {
        "right": ((v >= 0.3) & (bb["x1"] >= ba["x2"] - u * 0.3), gap(bb["x1"] - ba["x2"]), v >= 0.5),
        "below": ((bb["y1"] >= ba["y2"] - u * 0.3) & column, gap(bb["y1"] - ba["y2"]), F.lit(False)),
        "left": ((v >= 0.3) & (bb["x2"] <= ba["x1"] + u * 0.3), gap(ba["x1"] - bb["x2"]), v >= 0.5),
        "above": ((bb["y2"] <= ba["y1"] + u * 0.3) & column, gap(ba["y1"] - bb["y2"]), F.lit(False)),
    }
    found = F.coalesce(*[F.when(test & (d <= max_distance), F.struct(F.lit(name).alias("direction"), (d / max_distance).alias("distance_ratio"), same.alias("same_line"))) for name, (test, d, same) in ways.items()])
    # worked out once a pair: a generator gives it, as the optimizer repeats plain expressions wherever a filter names them
    out = rows.select(*on, "ref", "other", *keep, *carry, F.inline(F.array(found)))
    return out.where(F.col("direction").isin(*directions)).withColumn("proximity", F.greatest(F.lit(0.0), 1 - F.col("distance_ratio")))


def nearest_first(near: DataFrame, on: list[str]) -> DataFrame:
    """``neighbours`` with ``place``: of each reference the nearest first, at a tie those of its line, then by order."""
    w = Window.partitionBy(*on, "ref").orderBy("distance_ratio", F.col("same_line").desc(), "other")
    return near.withColumn("place", F.row_number().over(w) - 1)


def glyph_islands(glyphs: DataFrame, on: list[str], order: str = "ord") -> DataFrame:
    """Glyphs (*on, ord, ch, x1, y1, x2, y2) -> spans: a line break, a vertical overlap below 0.5 or a gap beyond 2.5
    median glyph widths starts a new one. White space breaks nothing and is trimmed."""
    w = Window.partitionBy(*on).orderBy(order)
    prev = {k: F.lag(k).over(w) for k in ("x1", "y1", "x2", "y2", "ch")}
    wide = F.median(F.when(F.col("x2") > F.col("x1"), F.col("x2") - F.col("x1"))).over(Window.partitionBy(*on))
    cut = F.coalesce((prev["ch"] == "\n") | (geo.vertical_overlap(prev, geo.box()) < 0.5) | (F.col("x1") - prev["x2"] > 2.5 * wide), F.lit(True))
    rows = glyphs.withColumn("cut", cut.cast("int")).withColumn("island", F.sum("cut").over(w))
    text = F.trim(F.replace(F.array_join(F.sort_array(F.collect_list(F.struct(F.col(order), F.col("ch"))))["ch"], ""), F.lit("\n"), F.lit("")))
    spans = rows.groupBy(*on, "island").agg(text.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return spans.where("text <> ''")


def scan_route(text_length: Column, coverage: Column) -> Column:
    """Why a page needs recognition, or null: too little text, or images on half of it."""
    return F.when(text_length < 40, "no_text_layer").when(coverage >= 0.5, "image_page")
