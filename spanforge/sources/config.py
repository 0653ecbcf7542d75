"""Configuration: strict YAML, lookup tables, run state."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import fields as dataclass_fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as tx
from spanforge.operators import validate as va
from spanforge.operators.segment import Taxonomy, Tier
from spanforge.operators.match import FieldSpec
from spanforge.operators.validate import Rule

RUN_ID = "[0-9a-f]{10}"


class ConfigError(ValueError):
    pass


def read_yaml(path: str) -> dict:
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except FileNotFoundError as e:
        raise ConfigError(f"{path}: no such file") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(found, dict):
        raise ConfigError(f"{path}: a mapping is expected")
    return found


def compiled(pattern: str, at: str) -> re.Pattern:
    try:
        return re.compile(pattern)
    except re.error as e:
        raise ConfigError(f"{at}: {pattern}: {e}") from e


def field_specs(path: str) -> list[FieldSpec]:
    """A dictionary of fields; unknown keys, normalisers and patterns that don't compile raise ConfigError with their place."""
    known = {f.name for f in dataclass_fields(FieldSpec)} - {"key"}
    out = []
    for key, body in read_yaml(path).get("fields", {}).items():
        if extra := set(body) - known:
            raise ConfigError(f"{path}: {key}: unknown keys {sorted(extra)}")
        if missing := [op for op in body.get("normalization", ()) if op not in tx.NORMALIZERS]:
            raise ConfigError(f"{path}: {key}: unknown normalisers {missing}")
        for p in [*body.get("patterns", ()), *body.get("exclude", ()), *[a[1] for a in body.get("aliases", ())]]:
            compiled(p, f"{path}: {key}")
        if sides := [d for d in body.get("directions", ()) if d not in ("right", "below", "left", "above")]:
            raise ConfigError(f"{path}: {key}: unknown directions {sides}")
        out.append(FieldSpec(key, **{k: [tuple(a) for a in v] if k == "aliases" else v for k, v in body.items()}))
    return out


def rules(path: str) -> tuple[dict[str, Callable[[str], Rule]], list[str]]:
    """({validator: field -> Rule}, documents in order of trust). Unknown types, severities and missing parts raise
    ConfigError with their place."""
    body = read_yaml(path)
    if not body.get("validators"):
        raise ConfigError(f"{path}: no validators")
    out: dict[str, Callable[[str], Rule]] = {}
    for name, v in body["validators"].items():
        at = f"{path}: validator {name}"
        if not isinstance(v, dict):
            raise ConfigError(f"{at}: a mapping is expected")
        kind, severity = v.get("type"), v.get("severity", "error")
        if severity not in ("error", "warning"):
            raise ConfigError(f"{at}: severity {severity!r}")
        need = {"regex": ("pattern",), "enum": ("values",), "derived": ("rule",), "length": (), "non_empty": ()}
        if kind not in need:
            raise ConfigError(f"{at}: unknown type {kind!r}")
        if lacking := [k for k in need[kind] if not v.get(k)]:
            raise ConfigError(f"{at}: {kind} needs {lacking}")
        if kind == "length" and v.get("min") is None and v.get("max") is None:
            raise ConfigError(f"{at}: length needs min or max")
        if kind == "regex":
            compiled(v["pattern"], at)
        checks = {
            "regex": lambda v=v: va.regex(v["pattern"]), "enum": lambda v=v: va.one_of(*map(str, v["values"])), "non_empty": lambda: va.non_empty,
            "length": lambda v=v: va.length(v.get("min") or 0, v.get("max") or 1 << 30, bool(v.get("digits_only"))), "derived": lambda v=v, at=at: va.derived(v, at),
        }
        try:
            check = checks[kind]()
        except KeyError as e:
            raise ConfigError(f"{at}: unknown rule {v.get('rule')!r}") from e
        out[name] = lambda field, name=name, check=check, severity=severity, kind=kind: Rule(field, name, check, severity, kind == "non_empty", kind == "derived")
    return out, list((body.get("cross_document") or {}).get("source_precedence") or [])


def configured(fields_path: str, rules_path: str) -> tuple[list[FieldSpec], list[Rule], list[str]]:
    """(fields, their rules, documents in order of trust), checked against each other: a field's validators must exist, and
    it needs captions or patterns."""
    specs, (known, precedence) = field_specs(fields_path), rules(rules_path)
    for s in specs:
        if missing := [v for v in s.validators if v not in known]:
            raise ConfigError(f"{fields_path}: {s.key}: undefined validators {missing}")
        if not s.labels and not s.patterns:
            raise ConfigError(f"{fields_path}: {s.key}: neither labels nor patterns")
    return specs, [known[v](s.key) for s in specs for v in s.validators], precedence


def profiles(path: str) -> list[tuple[str, str, str]]:
    """(profile, 'content' or 'filename', word); none without a file."""
    if not os.path.exists(path):
        return []
    found = read_yaml(path).get("profiles") or {}
    return [(name, where, str(w)) for name, p in found.items() for where in ("filename", "content") for w in (p or {}).get(f"{where}_keywords") or ()]


def taxonomy(path: str) -> Taxonomy:
    """Address tiers, their priority and connectors; no tiers if the file is missing or malformed, so that addresses stay whole."""
    words = lambda x: tuple(str(w).lower() for w in x or ())
    try:
        body = read_yaml(path)
        tiers = tuple(Tier(n, int(t["level"]), words(t.get("head")), words(t.get("tail")), words(t.get("any")), n == "structural") for n, t in (body.get("tiers") or {}).items())
        return Taxonomy(tiers, words(body.get("conflict_priority")), words(body.get("connectors")))
    except (ConfigError, KeyError, TypeError, ValueError, AttributeError):
        return Taxonomy(())


def mappings(folder: str) -> list[str]:
    """Names of the cell maps in a folder, sorted."""
    return sorted(os.path.splitext(n)[0] for n in os.listdir(folder) if n.endswith((".yaml", ".yml"))) if os.path.isdir(folder) else []


def all_present(*paths: str) -> bool:
    return all(os.path.isfile(p) for p in paths)


def failed_examples(spark: SparkSession, specs: Sequence[FieldSpec], examples: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """(field, text, wanted): examples whose field's patterns match them as a whole although they shouldn't, or the other
    way round. examples: (field, text, whether it should match)."""
    rows = spark.createDataFrame(list(examples), "field string, text string, wanted boolean")
    hit = F.coalesce(*[F.when(F.col("field") == s.key, tx.full_match(F.col("text"), *s.patterns)) for s in specs], F.lit(False))
    return rows.where(hit != F.col("wanted"))


def canonical_label(spec: FieldSpec) -> str:
    return spec.labels[0] if spec.labels else spec.key


def new_run_id() -> str:
    return uuid.uuid4().hex[:10]


def cell_map(spark: SparkSession, path: str) -> DataFrame:
    cells = read_yaml(path).get("cells", {})
    seen: set[tuple[str, str]] = set()
    for name, c in cells.items():
        at = (c.get("sheet", ""), c["cell"])
        if at in seen:
            raise ConfigError(f"{path}: {name}: {at} is used twice")
        seen.add(at)
    return spark.createDataFrame([(n, c.get("sheet", ""), c["cell"]) for n, c in cells.items()], "field string, sheet string, cell string")


def pin_directory(spark: SparkSession, path: str) -> DataFrame:
    """(pin, state, district): six digits only, a later line replaces an earlier one."""
    rows = spark.read.option("header", "true").schema("pincode string, district string, state string").csv(path)
    rows = rows.where(F.col("pincode").rlike("^[0-9]{6}$")).withColumn("n", F.monotonically_increasing_id())
    return rows.groupBy(F.col("pincode").alias("pin")).agg(F.max_by(F.struct("state", "district"), "n").alias("s")).select("pin", "s.*")


def build_pin_directory(rows: DataFrame, order: str) -> DataFrame:
    """(pin, state, district, collisions): for each PIN the row that comes first, and how many others differ from it. Counts by distinct rows
    combine before the shuffle, so a PIN that fills the table is no hot key."""
    each = rows.groupBy("pin", "state", "district").agg(F.count("*").alias("n"), F.min(order).alias("o"))
    found = each.groupBy("pin").agg(F.min_by(F.struct("state", "district", "n"), "o").alias("f"), F.sum("n").alias("n"))
    return found.select("pin", "f.state", "f.district", (F.col("n") - F.col("f.n")).alias("collisions"))


def write_lookup(table: DataFrame, path: str, order: str) -> None:
    """A lookup table as sorted, distinct CSV lines with a header."""
    table.distinct().repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("header", "true").csv(path)


def state_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, state): lines of a name and tab-separated spellings; # begins a comment."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    parts = lines.select(F.split("value", "\t").alias("p"))
    return parts.select(F.trim(F.get("p", F.lit(0))).alias("state"), F.explode("p").alias("n")).select(tx.squash_key(F.col("n")).alias("key"), "state").dropDuplicates(["key"])


def city_table(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(tx.squash_key(F.col("value")).alias("key"), F.trim("value").alias("city")).where((F.length("key") > 2) & ~F.col("key").rlike("^[0-9]+$")).dropDuplicates(["key"])


def read_run(spark: SparkSession, root: str, run_id: str, schema: str) -> DataFrame | None:
    """The run's state, or None for an id of another shape, a missing run or one that can't be read."""
    if not re.fullmatch(RUN_ID, run_id):
        return None
    try:
        found = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{root}/run_id={run_id}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    lines, bad, _ = found.agg(F.count("*"), F.count("_bad"), F.count(F.col(f"`{found.columns[0]}`"))).first()
    return found.drop("_bad") if lines and not bad else None


def write_run(state: DataFrame, root: str, run_id: str) -> None:
    if not re.fullmatch(RUN_ID, run_id):
        raise ConfigError(f"{run_id} is no run id")
    state.write.mode("overwrite").json(f"{root}/run_id={run_id}")
