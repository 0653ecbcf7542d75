"""Declarative rules as nullable boolean columns; findings, verdicts and agreement across documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.functions.places import canonical_state


@dataclass(frozen=True)
class Rule:
    """check: column of the field's value -> boolean, null where it can't judge. blank values are judged only by ``non_empty``.
    derived: the check looks at other fields' columns, so it works on wide records only."""

    field: str
    name: str
    check: Callable[[Column], Column]
    severity: str = "error"
    on_blank: bool = False
    derived: bool = False


def regex(pattern: str) -> Callable[[Column], Column]:
    return lambda c: tx.full_match(c, pattern)


def length(least: int, most: int, digits: bool = False) -> Callable[[Column], Column]:
    """digits: any other character fails."""
    return lambda c: F.length(c).between(least, most) & (c.rlike(r"\A[0-9]*\z") if digits else F.lit(True))


def one_of(*values: str) -> Callable[[Column], Column]:
    return lambda c: F.lower(F.trim(c)).isin(*[v.lower() for v in values])


def non_empty(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def substring_equals(source: str, start: int, end: int, target: str) -> Callable[[Column], Column]:
    """source[start:end] is the target, in upper case; null if either is blank."""
    blank = lambda n: F.coalesce(F.trim(F.col(n)), F.lit("")) == ""
    return lambda _: F.when(~blank(source) & ~blank(target), F.upper(F.substring(F.col(source), start + 1, end - start)) == F.upper(F.col(target)))


def state_code(c: Column) -> Column:
    return F.substring(c, 1, 2).isin(*[f"{i:02d}" for i in range(1, 39)])


def pin_state(c: Column) -> Column:
    """The state is that of the PIN's entry in the directory (column ``pin_state``), both by their canonical names; null
    without a state or an entry."""
    named = lambda s: F.lower(F.coalesce(canonical_state(s), F.trim(s)))
    return F.when(F.trim(c) != "", named(c) == named(F.col("pin_state")))


def with_pin_state(wide: DataFrame, directory: DataFrame, pin: str = "pin_code") -> DataFrame:
    """``wide`` with ``pin_state``: the directory's state of its PIN, null for an unknown one."""
    known = directory.select(F.col("pin").alias("_pin"), F.col("state").alias("pin_state"))
    return wide.join(known, F.trim(F.col(pin)) == F.col("_pin"), "left").drop("_pin")


def derived(body: dict, at: str) -> Callable[[Column], Column]:
    """The check of a configured rule that looks at other fields; an unknown one raises KeyError."""
    kinds: dict[str, Callable[[], Callable[[Column], Column]]] = {
        "substring_equals": lambda: substring_equals(body["source"], body.get("start") or 0, body.get("end") or 1 << 20, body["target"]),
        "state_code_valid": lambda: lambda _: F.when(F.trim(F.col(body["source"])) != "", state_code(F.col(body["source"]))),
        "pin_matches_state": lambda: pin_state,
    }
    return kinds[body["rule"]]()


# The identifiers' formats, the states, the countries, and the rules with their severities.
STATES = (
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh",
    "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand",
    "West Bengal", "Andaman and Nicobar Islands", "Chandigarh", "Dadra and Nagar Haveli and Daman and Diu", "Delhi", "Jammu and Kashmir", "Ladakh", "Lakshadweep", "Puducherry",
)
COUNTRIES = ("India", "Bharat", "United States", "United Kingdom", "Singapore", "United Arab Emirates", "Germany", "China", "Japan", "Australia", "Canada", "France", "Netherlands", "Switzerland")
ID_RULES = [
    Rule("vendor_name", "non_empty", non_empty, on_blank=True),
    Rule("gst_number", "gstin_format", regex("[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]")),
    Rule("gst_number", "gstin_contains_pan", substring_equals("gst_number", 2, 12, "pan"), derived=True),
    Rule("gst_number", "gstin_state_code", state_code, "warning", derived=True),
    Rule("pan", "pan_format", regex("[A-Z]{5}[0-9]{4}[A-Z]")),
    Rule("tan", "tan_format", regex("[A-Z]{4}[0-9]{5}[A-Z]")),
    Rule("udyam_number", "udyam_format", regex("UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7}")),
    Rule("esic_number", "esic_format", regex("[0-9]{17}"), "warning"),
    Rule("pin_code", "pin_format", regex("[1-9][0-9]{5}")),
    Rule("state", "pin_matches_state", pin_state, "warning", derived=True),
    Rule("state", "indian_state", one_of(*STATES), "warning"),
    Rule("country", "country_name", one_of(*COUNTRIES)),
    Rule("email", "email_format", regex(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")),
    Rule("telephone", "indian_phone", regex("[6-9][0-9]{9}")),
    Rule("ifsc", "ifsc_format", regex("[A-Z]{4}0[A-Z0-9]{6}")),
    Rule("account_number", "account_number_format", length(9, 18, digits=True)),
]


def findings(wide: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(*keys, field, rule, severity, ok): a row for each rule that can judge. One pass over ``wide``, all rules at once;
    rules of fields that ``wide`` doesn't have are left out."""
    out = []
    for r in (r for r in rules if r.field in wide.columns):
        c = F.col(r.field)
        judged = r.check(c) if r.on_blank else F.when(F.coalesce(F.trim(c), F.lit("")) != "", r.check(c))
        out.append(F.struct(F.lit(r.field).alias("field"), F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), judged.alias("ok")))
    if not out:
        none = {"field": "string", "rule": "string", "severity": "string", "ok": "boolean"}
        return wide.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).where("false")
    return wide.select(*keys, F.explode(F.array(*out)).alias("f")).select(*keys, "f.*").where("ok is not null")


def status_by(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """invalid before warning before valid."""
    bad = lambda s: F.bool_or((F.col("severity") == s) & ~F.col("ok"))
    return found.groupBy(*keys).agg(F.when(bad("error"), "invalid").when(bad("warning"), "warning").otherwise("valid").alias("status"))


def bias(score: Column, errors: Column, warnings: Column, judged: Column) -> Column:
    """Scores in millionths: a failed error rule leaves 35 %, a failed warning 75 %, a pass adds 10 points up to 100."""
    return F.when(errors, F.floor(score * 35 / 100)).when(warnings, F.floor(score * 75 / 100)).when(judged, F.least(score + 100_000, F.lit(1_000_000))).otherwise(score).cast("long")
