"""Boxes (x1, y1, x2, y2; top left first) as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import strip


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2")}


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Shared length over the shorter side; 0 where a side has no length or is null."""
    shorter = F.least(hi1 - lo1, hi2 - lo2)
    return F.when((shorter > 0) & (hi1 - lo1 + hi2 - lo2).isNotNull(), F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2)) / shorter).otherwise(0.0)


def vertical_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return overlap(a["y1"], a["y2"], b["y1"], b["y2"])


def horizontal_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return overlap(a["x1"], a["x2"], b["x1"], b["x2"])


def polygon_box(points: Column) -> Column:
    """The envelope of an array of (x, y) structs."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def recognised_spans(found: DataFrame, on: Sequence[str], least: float = 0.3) -> DataFrame:
    """What a recogniser gives, (*on, ord, text, points array of (x, y), score), as spans (*on, ord, text, x1, y1, x2, y2, confidence).
    Texts are stripped; empty ones and those below the score ``least`` are left out."""
    rows = found.withColumn("text", strip(F.col("text"))).where((F.col("text") != "") & (F.col("score") >= least))
    return rows.withColumn("_b", polygon_box(F.col("points"))).select(*on, "ord", "text", "_b.x1", "_b.y1", "_b.x2", "_b.y2", F.col("score").alias("confidence"))


def flip(page_height: Column, bottom: Column, top: Column, scale: Column) -> tuple[Column, Column]:
    """Bottom-left coordinates -> (y1, y2) from the top, scaled."""
    return (page_height - top) * scale, (page_height - bottom) * scale


def coverage(widths: Column, heights: Column, page_area: Column) -> Column:
    """Images' share of the page, at most 1, from arrays of sides."""
    area = F.aggregate(F.zip_with(widths, heights, lambda w, h: F.abs(w * h)), F.lit(0.0), lambda s, x: s + x)
    return F.when(page_area > 0, F.least(area / page_area, F.lit(1.0))).otherwise(0.0)
