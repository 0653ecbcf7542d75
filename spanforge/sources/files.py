"""Input files: listing, routing by suffix, Word documents; recognition of images and PDF is a function the caller gives."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.session import settled
from spanforge.sources import word

SUFFIXES = {"pdf": (".pdf",), "docx": (".docx",), "image": word.IMAGES}
SPANS = ("doc_id", "page", "ord", "text", "x1", "y1", "x2", "y2", "source")


class Loaded(NamedTuple):
    """spans: SPANS of every file that was read. unread: (path, reason) of those that were not."""

    spans: DataFrame
    unread: DataFrame


def list_inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(supported files with ``kind``, others), of one folder, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.coalesce(*[F.when(suffix.isin(*s), F.lit(k)) for k, s in SUFFIXES.items()])
    files = files.withColumn("kind", kind)
    return files.where("kind is not null"), files.where("kind is null").select("path", "length")


def load(files: DataFrame, recognise: Callable[[DataFrame], DataFrame] | None = None) -> Loaded:
    """Listed files (path, content, kind) as spans: Word documents' text here, everything else by ``recognise``.

    recognise: (path, content) of PDF, images, and images within Word documents, whose path is ``file#member`` -> SPANS, the
    path as doc_id. A Word document's images that hold text become pages behind its own, in the order of their
    names in the file. What can't be read, or has no recogniser, is listed as unread.
    """
    parts = settled(word.word_parts(files.where("kind = 'docx'")))
    spans = word.word_spans(parts).select(*SPANS)
    unread = parts.where("kind = 'unread'").select("path", F.col("text").alias("reason"))
    media = parts.where("kind = 'image'").select(F.concat_ws("#", "path", "text").alias("path"), "content", F.col("path").alias("_file"), "n")
    other = files.where("kind <> 'docx'").select("path", "content")
    if recognise is None:
        left = other.select("path").unionByName(media.select("path"))
        return Loaded(spans, unread.unionByName(left.withColumn("reason", F.lit("no recogniser"))))
    found = settled(recognise(other.unionByName(media.select("path", "content"))).select(*SPANS))
    own = media.select(F.col("path").alias("doc_id"), "_file", "n").join(word.text_pages(parts).withColumnRenamed("path", "_file"), "_file")
    with_text = own.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    behind = with_text.withColumn("_page", F.col("pages") + F.row_number().over(Window.partitionBy("_file").orderBy("n"))).select("doc_id", "_file", "_page")
    rows = found.join(behind, "doc_id", "left")
    rows = rows.withColumns({"doc_id": F.coalesce("_file", "doc_id"), "page": F.coalesce("_page", "page").cast("int"), "source": F.when(F.col("_file").isNotNull(), "docx_image").otherwise(F.col("source"))})
    return Loaded(spans.unionByName(rows.select(*SPANS)), unread)
