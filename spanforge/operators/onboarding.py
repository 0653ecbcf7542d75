"""A set's results as the record of a registration form, and as one document; names and labels that people read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as tx

# Names of document kinds, of the form's fields by their source, and fields that are blank if invalid.
DOC_LABELS = {"gst_certificate": "GST Certificate", "udyam_certificate": "Udyam Certificate", "cancelled_cheque": "Cancelled Cheque", "pan_card": "PAN Card", "bank_statement": "Bank Statement", "other": "Other"}
FORM_NAMES = {
    "vendor_name": "company_name", "pin_code": "zip_code", "gst_number": "gst_registration_number", "pan": "pan_number", "city": "city", "state": "state", "country": "country",
    "email": "email_id_to", "telephone": "phone_number", "bank_name": "bank_details.bank_name", "account_number": "bank_details.account_number", "branch_address": "bank_details.branch",
    "ifsc": "bank_details.ifsc_code", "address_1": "billing_address", "address_2": "billing_address", "address_3": "billing_address", "address_4": "billing_address",
}
STRICT = ("gst_number", "pan", "ifsc", "pin_code")


def doc_label(kind: Column) -> Column:
    """The kind's name, else its key in words."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in DOC_LABELS.items() for x in kv]), kind)
    return F.coalesce(named, F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))


def source_documents(documents: DataFrame) -> DataFrame:
    """(set_id, source_documents): documents (set_id, doc, name, doc_type, score), in order; the confidence is at most 1."""
    one = F.struct("doc", F.col("name").alias("file_name"), doc_label(F.coalesce("doc_type", F.lit("other"))).alias("document_type"), F.least(F.lit(1.0), F.bround(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), 2)).alias("confidence"))
    return documents.groupBy("set_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda d: F.struct(*[d[c].alias(c) for c in ("file_name", "document_type", "confidence")])).alias("source_documents"))


def review_names(review: DataFrame, order: str = "seq") -> DataFrame:
    """(set_id, fields_needing_review): the form's names of flagged fields, each once, in the order they were first
    flagged; fields that the form lacks are left out."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in FORM_NAMES.items() for x in kv]), F.col("field"))
    first = review.select("set_id", name.alias("name"), order).where("name is not null").groupBy("set_id", "name").agg(F.min(order).alias("_first"))
    return first.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("_first", "name")))["name"].alias("fields_needing_review"))


def review_list(entries: Column) -> Column:
    """Names from entries that are names, or JSON objects with a ``field``; blank ones are left out."""
    return F.filter(F.transform(entries, lambda x: F.coalesce(F.when(x.startswith("{"), F.get_json_object(x, "$.field")), x)), lambda x: x.isNotNull() & (x != ""))


def valid_value(value: Column, status: Column) -> Column:
    """Blank for null and for what its rule refused."""
    return F.when(status.eqNullSafe("invalid"), "").otherwise(F.coalesce(value, F.lit("")))


def valid_results(results: DataFrame) -> DataFrame:
    """``results`` whose invalid identifiers are blank."""
    return results.withColumn("value", F.when(F.col("field").isin(*STRICT), valid_value(F.col("value"), F.col("status"))).otherwise(F.coalesce("value", F.lit(""))))


def result_documents(results: DataFrame, review: DataFrame, summary: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """A row for each set: canonical (field -> value), fields (field -> details), needs_review, summary and, if given,
    documents. ``write.json`` makes it the result's file."""
    keep = [c for c in ("value", "score", "doc", "page", "kind", "source", "status", "consistency", "alternatives") if c in results.columns]
    entry = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", v))))
    out = results.groupBy("set_id").agg(entry(F.coalesce("value", F.lit("")).alias("v")).alias("canonical"), entry(F.struct(*keep).alias("v")).alias("fields"))
    flags = review.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("field", "reason", "severity"))).alias("needs_review"))
    totals = summary.select("set_id", F.struct(*[c for c in summary.columns if c != "set_id"]).alias("summary"))
    out = out.join(flags, "set_id", "left").join(totals, "set_id", "left")
    if documents is not None:
        out = out.join(documents.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in documents.columns if c != "set_id"]))).alias("documents")), "set_id", "left")
    return out


def numbered(review: DataFrame, keys: list[str]) -> DataFrame:
    """``review`` with ``seq``, its order within a set by ``keys``; a set's flags are few."""
    return review.withColumn("seq", F.row_number().over(Window.partitionBy("set_id").orderBy(*keys)))


def gst_pan(gst: Column, pan: Column) -> tuple[Column, Column]:
    """(PAN, whether it was taken from the GSTIN): the GSTIN's third to twelfth characters where the PAN is blank."""
    inner = F.substring(gst, 3, 10)
    use = (F.coalesce(F.trim(pan), F.lit("")) == "") & F.coalesce(tx.full_match(inner, "[A-Z]{5}[0-9]{4}[A-Z]"), F.lit(False))
    return F.when(use, inner).otherwise(F.coalesce(pan, F.lit(""))), use
