"""Records: reshaping, payloads, keys and duplicates, updates, sync state, cell maps and their verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as tx
from spanforge.operators.onboarding import gst_pan


def null_if_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def blanks_to_null(rows: DataFrame, unique: Sequence[str]) -> DataFrame:
    """Blank keys become null, so they never collide."""
    return rows.withColumns({c: null_if_blank(F.col(c)) for c in unique})


def nulls_to_blank(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c, kind in rows.dtypes if kind == "string"})


def onboarding(wide: DataFrame, bank: Sequence[str] = ("bank_name", "ifsc", "account_type", "account_number")) -> DataFrame:
    """The record a registration form takes: renamed fields, a nested bank part, constants; the PAN from the GSTIN where it
    is blank, noted in ``derived``; the billing address joined from its lines. ``onboarding.valid_results`` blanks
    invalid identifiers before."""
    value = lambda n: F.coalesce(F.col(n), F.lit("")) if n in wide.columns else F.lit("")
    pan, can = gst_pan(value("gst_number"), value("pan"))
    lines = [null_if_blank(value(f"address_{i}")) for i in range(1, 5)]
    return wide.select(
        "set_id", value("vendor_name").alias("company_name"), F.concat_ws(", ", *lines).alias("billing_address"), value("city").alias("city"), value("state").alias("state"), value("pin_code").alias("zip_code"),
        value("gst_number").alias("gst_registration_number"), pan.alias("pan_number"), F.struct(*[value(b).alias(b) for b in bank]).alias("bank"),
        F.lit("").alias("contact_name"), F.lit("Services").alias("type"), F.when(can, F.array(F.lit("pan_number"))).otherwise(F.array().cast("array<string>")).alias("derived"),
    )


def payload(rows: DataFrame, key: str, fields: dict[str, str], widths: dict[str, int]) -> DataFrame:
    """(key, payload JSON without blank fields, truncated): source column -> external name, cut to the widths."""
    fit = {out: tx.fit_width(F.trim(F.col(c)), widths.get(out, 10_000)) for c, out in fields.items()}
    cut = F.array_compact(F.array(*[F.when(F.length(F.trim(F.col(c))) > widths[out], F.lit(out)) for c, out in fields.items() if out in widths]))
    body = F.to_json(F.struct(*[null_if_blank(v).alias(out) for out, v in fit.items()]), {"ignoreNullFields": "true"})
    return rows.select(key, body.alias("payload"), cut.alias("truncated"))


def card_url(base: str, c: Column) -> Column:
    return F.concat(F.lit(base + "('"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("')"))


def find_duplicates(rows: DataFrame, stored: DataFrame, key: str, unique: Sequence[str]) -> DataFrame:
    """(key, duplicate_of, by): the smallest stored id with an equal key value, the first key that matches deciding.
    Blank keys match nothing, and no row is its own duplicate."""
    out = rows.select(key, *unique)
    for i, c in enumerate(unique):
        held = stored.where(F.trim(c) != "").select(F.col(c).alias(f"_u{i}"), F.col(key).alias(f"_o{i}"))
        least = held.groupBy(f"_u{i}").agg(F.min(f"_o{i}").alias(f"_m{i}"), F.max(f"_o{i}").alias(f"_x{i}"))
        out = out.join(least, null_if_blank(F.col(c)) == F.col(f"_u{i}"), "left")
        # a row that has the smallest id itself takes the next one, if there is one
        own = out.where((F.col(f"_m{i}") == F.col(key)) & (F.col(f"_x{i}") != F.col(key))).select(F.col(f"_u{i}").alias("_u"), F.col(key).alias("_k")).distinct()
        after = held.join(own, F.col(f"_u{i}") == F.col("_u")).where(F.col(f"_o{i}") != F.col("_k")).groupBy("_u").agg(F.min(f"_o{i}").alias(f"_s{i}"))
        out = out.join(after, F.col(f"_u{i}") == F.col("_u"), "left").drop("_u")
        other = F.when(F.col(f"_m{i}") != F.col(key), F.col(f"_m{i}")).otherwise(F.col(f"_s{i}"))
        out = out.withColumn(f"_d{i}", other)
    ids = [F.col(f"_d{i}") for i in range(len(unique))]
    by = F.coalesce(*[F.when(d.isNotNull(), F.lit(c)) for d, c in zip(ids, unique, strict=True)])
    return out.select(key, F.coalesce(*ids).alias("duplicate_of"), by.alias("by")).where("duplicate_of is not null")


def insertable(rows: DataFrame, stored: DataFrame, unique: Sequence[str]) -> DataFrame:
    """Rows none of whose non-blank keys is stored."""
    for c in unique:
        rows = rows.join(stored.where(F.trim(c) != "").select(F.col(c).alias("_u")), null_if_blank(F.col(c)) == F.col("_u"), "left_anti")
    return rows


def insert_conflicts(rows: DataFrame, stored: DataFrame, key: str, unique: Sequence[str]) -> DataFrame:
    """(key, kind, value, existing_id) for each key that is stored already."""
    parts = [rows.join(stored.where(F.trim(c) != "").groupBy(F.col(c).alias("_u")).agg(F.min(key).alias("existing_id")), F.col(c) == F.col("_u")).select(key, F.lit(c).alias("kind"), F.col(c).alias("value"), "existing_id") for c in unique]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def partial_update(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """changes: (key, patch map<string, string>); only the fields that a patch names change, to null too."""
    rows = stored.join(changes.select(key, F.col("patch").alias("_patch")), key, "left")
    new = {c: F.when(F.coalesce(F.map_contains_key("_patch", c), F.lit(False)), F.element_at("_patch", F.lit(c))).otherwise(F.col(c)) for c, kind in stored.dtypes if c != key and kind == "string"}
    return rows.withColumns(new).drop("_patch")


def update_conflicts(stored: DataFrame, changes: DataFrame, key: str, unique: Sequence[str]) -> DataFrame:
    """(key, kind, existing_id): a patch would give a row a key that another row holds; keeping one's own is none."""
    parts = []
    for c in unique:
        want = changes.select(key, F.element_at("patch", F.lit(c)).alias("_v")).where(F.trim("_v") != "")
        held = stored.where(F.trim(c) != "").select(F.col(c).alias("_v"), F.col(key).alias("_o"))
        parts.append(want.join(held, "_v").where(F.col("_o") != F.col(key)).groupBy(key).agg(F.min("_o").alias("existing_id")).select(key, F.lit(c).alias("kind"), "existing_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def delete_rows(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def newest_page(rows: DataFrame, time: str, key: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """Newest first, ties by the larger id; at most 500 rows."""
    return rows.orderBy(F.col(time).desc(), F.col(key).desc()).offset(offset).limit(min(limit, 500))


def active_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.where(~F.col("revoked") & (F.col("expires_at") > now))


def revoke(tokens: DataFrame, which: Column) -> DataFrame:
    return tokens.withColumn("revoked", F.when(which, True).otherwise(F.col("revoked")))


def mark_pushed(rows: DataFrame, pushed: DataFrame, key: str, enabled: bool = True) -> DataFrame:
    """``rows`` with their new ``status`` and the ``outcome`` of each push: pushed, conflict, refused, or null without one."""
    asked = rows.join(pushed.select(key, F.lit(True).alias("_asked")).distinct(), key, "left")
    outcome = F.when(F.col("_asked").isNull(), None).when(F.lit(not enabled), "refused").when(F.col("status") == "pushed", "conflict").otherwise("pushed")
    out = asked.withColumn("outcome", outcome)
    return out.withColumn("status", F.when(F.col("outcome") == "pushed", "pushed").otherwise(F.col("status"))).drop("_asked")


def push_outcomes(pushes: DataFrame, key: str) -> DataFrame:
    """(key, seq, push, outcome): pushes (key, seq, push, ok) in the order ``seq``. Up to the first that is ok a push has failed; that one
    has pushed the record, and so has a repeat of the same push; any other is a conflict. ``streaming.sync`` gives the same over a stream."""
    w = Window.partitionBy(key)
    at, won = F.min(F.when(F.col("ok"), F.col("seq"))).over(w), F.min(F.when(F.col("ok"), F.struct("seq", "push"))).over(w)["push"]
    outcome = F.when(at.isNull() | (F.col("seq") < at), "failed").when(F.col("push") == won, "pushed").otherwise("conflict")
    return pushes.select(key, "seq", "push", outcome.alias("outcome"))


def fill_cells(record: DataFrame, cells: DataFrame, sheets: Sequence[str] = ()) -> DataFrame:
    """record: (set_id, field, value) -> (set_id, sheet, cell, field, value, written); unmapped fields go, blanks stay empty.
    sheets: fill each of these in place of the map's own."""
    rows = record.join(cells, "field")
    if sheets:
        rows = rows.withColumn("sheet", F.explode(F.array(*[F.lit(x) for x in sheets])))
    value = F.coalesce(F.trim("value"), F.lit(""))
    return rows.select("set_id", "sheet", "cell", "field", value.alias("value"), (value != "").alias("written"))


def read_cells(filled: DataFrame, cells: DataFrame) -> DataFrame:
    """(set_id, field, value): filled sheets (set_id, sheet, cell, value) by the cell map; blank cells and unmapped ones are left out."""
    rows = filled.join(cells, ["sheet", "cell"]).select("set_id", "field", tx.strip(F.col("value")).alias("value"))
    return rows.where("value <> ''")


def verify_cells(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(set_id, field, expected, actual, ok) by the keys that writing may change: blanks, ``.0``, case."""
    a = actual.select("set_id", "sheet", "cell", F.col("value").alias("actual"))
    rows = expected.join(a, ["set_id", "sheet", "cell"], "left")
    return rows.select("set_id", "field", F.col("value").alias("expected"), F.coalesce("actual", F.lit("")).alias("actual"), (tx.verification_key(F.col("value")) == tx.verification_key(F.col("actual"))).alias("ok"))


def verification_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("set_id").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.floor(F.count_if("ok") * 1000 / F.count("*")).cast("long").alias("success_rate"))


def annotate(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """registry: (key, body JSON): status and legal name under one of two names, top-level or below profile or data."""
    path = lambda *names: F.coalesce(*[F.get_json_object("body", f"$.{p}{n}") for p in ("", "profile.", "data.") for n in names])
    r = registry.select(key, path("gstin_status", "status").alias("registry_status"), path("legal_name", "lgnm").alias("legal_name"))
    out = rows.join(r, key, "left")
    inactive = F.coalesce(F.lower("registry_status") != "active", F.lit(False))
    return out.withColumn("status", F.when(inactive & (F.col("status") == "valid"), "warning").otherwise(F.col("status")))


def first_seen(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
