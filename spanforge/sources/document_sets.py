"""Document sets as JSON: nested in files, flat as spans in the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<text:string,page:int,bbox:array<double>,source_document:string,confidence:double,source:string,order:int,table:struct<table_index:int,row:int,col:int>,synthetic_bbox:boolean>"
PAGE = f"struct<page:int,width:double,height:double,extraction_method:string,ocr_reason:string,duration_s:double,span_count:int,spans:array<{SPAN}>>"
SCHEMA = f"set_id long, document_count int, span_count int, duration_s double, documents array<struct<document:string,path:string,doc_type:string,page_count:int,span_count:int,duration_s:double,metadata:map<string,string>,pages:array<{PAGE}>>>"


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def pages(sets: DataFrame) -> DataFrame:
    d = sets.select("set_id", F.posexplode("documents").alias("doc", "d"))
    return d.select("set_id", "doc", F.col("d.document").alias("name"), F.coalesce("d.doc_type", F.lit("pdf")).alias("file_type"), F.explode("d.pages").alias("p"))


def spans(sets: DataFrame) -> DataFrame:
    """Flat spans; absent keys take confidence 1.0, source ``ocr``, order 0."""
    s = pages(sets).select("set_id", "doc", "name", F.col("p.page").alias("page"), F.posexplode("p.spans").alias("n", "s"))
    box = {k: F.get("s.bbox", F.lit(i)) for i, k in enumerate(("x1", "y1", "x2", "y2"))}
    return s.select("set_id", "doc", "name", "page", F.col("n").alias("ord"), F.col("s.text").alias("text"), *[v.alias(k) for k, v in box.items()], F.coalesce("s.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("s.source", F.lit("ocr")).alias("source"), F.coalesce("s.order", F.lit(0)).alias("read_order"), "s.table")


def totals(sets: DataFrame) -> DataFrame:
    return pages(sets).groupBy("set_id").agg(F.countDistinct("doc").alias("documents"), F.sum(F.size("p.spans")).alias("spans"), F.sum(F.coalesce("p.duration_s", F.lit(0.0))).alias("duration_s"), F.collect_set(F.coalesce("p.extraction_method", F.lit("ocr"))).alias("methods"))


def nest(flat: DataFrame) -> DataFrame:
    """Spans -> one row a set in the files' shape; boxes rounded to two digits, confidences to four."""
    span = F.struct("ord", "text", "page", F.transform(F.array("x1", "y1", "x2", "y2"), lambda v: F.bround(v, 2)).alias("bbox"), F.col("name").alias("source_document"), F.bround("confidence", 4).alias("confidence"), "source")
    by_page = flat.groupBy("set_id", "doc", "name", "page").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    by_doc = by_page.groupBy("set_id", "doc", "name").agg(F.sort_array(F.collect_list(F.struct("page", "spans"))).alias("pages"))
    return by_doc.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("doc", F.col("name").alias("document"), "pages"))).alias("documents"))


def write_sets(flat: DataFrame, path: str) -> None:
    nest(flat).write.mode("overwrite").json(path)
