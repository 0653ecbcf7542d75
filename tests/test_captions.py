"""Caption look-up by lengths and pieces against every pair; leaked captions; the dataflow's edges."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import similarity as sim
from spanforge.functions import text as tx
from spanforge.operators import match as ma
from spanforge.operators import resolve as rs
from spanforge.operators import validate as va
from spanforge.plans import extract as ex

SPECS = [
    ma.FieldSpec("pan", ["PAN", "Permanent Account Number", "PAN No"], ["[A-Z]{5}[0-9]{4}[A-Z]"]), ma.FieldSpec("bank", ["Bank Name", "Name of Bank", "Name of the Bank and Branch Address"]),
    ma.FieldSpec("loose", ["Registered Office", "Of"], min_similarity=0.6), ma.FieldSpec("phone", ["Mobile No", "Ph"], ["[6-9][0-9]{9}"]),
]


def texts(n=400):
    rng = random.Random(6)
    labels = [x for s in SPECS for x in s.labels]
    out = ["", "PAN", "pan:", "PAN ABCDE1234F", "x PAN: ABCDE1234F", "xx PAN - q", "xxx PAN - q", "PAN. 5", "Ph 9876543210", "P h: 1", "Registerd Ofice: here", "漢字: PAN"]
    while len(out) < n:
        t = list(rng.choice(labels))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(t) + 1)
            rng.choice([lambda: t.insert(i, rng.choice("abn :")), lambda: t.pop(min(i, len(t) - 1)) if t else None, lambda: t.insert(0, "x")])()
        out.append("".join(t) + rng.choice(["", ":", " - ", "  "]) + rng.choice(["", "value", "ABCDE1234F", ": 9876543210", "a longer text, with words"]))
    return out


def every_prefixed(spark, df):
    """By all pairs."""
    rows = df.crossJoin(ma.label_table(spark, SPECS)).where((F.length("t") > F.length("label")) & (F.length("t") <= 3 * F.col("max_chars")))
    rows = rows.withColumn("a", sim.aligned(F.col("label"), F.lower("t"))).withColumn("similarity", F.floor(F.col("a.score") * 10_000 + 0.001).cast("long")).where("similarity >= threshold and a.dest_start <= 2")
    rows = rows.withColumn("tail", F.expr("substring(t, a.dest_end + 1)")).withColumn("raw", tx.strip_value_prefix(F.col("tail"))).where("raw <> ''")
    return rows.where(F.coalesce(*[F.when(F.col("field") == s.key, ma.is_inline_split(F.col("tail"), F.col("raw"), s.patterns)) for s in SPECS]))


def test_prefixed_loses_no_pair(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string").distinct()
    columns = ["t", "field", "label", "similarity", "raw"]
    want = sorted(tuple(r) for r in every_prefixed(spark, df).select(columns).collect())
    assert len(want) > 60
    assert sorted(tuple(r) for r in ma.prefixed(df, SPECS).select(columns).collect()) == want
    one = df.withColumn("field", F.lit("bank"))
    assert sorted(tuple(r) for r in ma.prefixed(one, SPECS).select(columns).collect()) == [w for w in want if w[1] == "bank"]


def test_whole_captions_lose_no_pair(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string").distinct().withColumn("key", tx.clean_label(F.col("t"))).where("key <> ''")
    labels = ma.label_table(spark, SPECS)
    every = df.crossJoin(labels).withColumn("similarity", F.floor(sim.ratio_micro(F.col("key"), F.col("label")) / 100).cast("long")).where("similarity >= threshold and length(t) <= 3 * max_chars")
    columns = ["t", "field", "label_ord", "similarity"]
    want = sorted(tuple(r) for r in every.select(columns).collect())
    assert len(want) > 60 and sorted(tuple(r) for r in ma.whole_captions(df, labels).select(columns).collect()) == want
    like = df.crossJoin(labels.select("label").distinct()).where(sim.ratio_micro(F.col("key"), F.col("label")) >= 88_000_000).select("key").distinct()
    assert sorted(r.key for r in ma.label_like(df.select("key"), SPECS).collect()) == sorted(r.key for r in like.collect())


@pytest.mark.parametrize(
    ("value", "leak"),
    [
        ("Address of Principal Place of", True), ("Legal Name of", True), ("Legal Name of Business", True), ("Legal Nane of Business", True), ("Trade Name, if any", True), ("Micro", True), ("Small Enterprise :", True), ("Date of Liability", True),
        ("Date palms and other trees of the western coast Limited", False), ("Acme Traders", False), ("Business", True), ("Legal", False), ("", False), (None, False), ("Iffany Foods", False),
    ],
)
def test_leaks(spark, value, leak):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(rs.caption_leak(F.col("v"), ["Legal Name of Business", "Address of Principal Place of Business", "PAN"])).first()[0] is leak


def test_leaked_name_takes_an_alternative(spark):
    alt = "alternatives array<struct<value: string, score: long>>"
    rows = [(1, "vendor_name", "Legal Name of", [("Micro", 5), ("Acme Traders", 4)]), (2, "vendor_name", "Acme", None), (3, "vendor_name", "Micro", [("Small", 1)]), (4, "vendor_name", None, [("Acme", 1)]), (1, "city", "Micro", None)]
    out, flags = rs.without_leaks(spark.createDataFrame(rows, f"set_id int, field string, value string, {alt}"), ["vendor_name"], ["Legal Name of Business"])
    assert {(r.set_id, r.field): r.value for r in out.collect()} == {(1, "vendor_name"): "Acme Traders", (2, "vendor_name"): "Acme", (3, "vendor_name"): "", (4, "vendor_name"): None, (1, "city"): "Micro"}
    assert [(r.set_id, r.field) for r in flags.collect()] == [(1, "vendor_name")]


SPANS = "set_id int, doc int, page int, ord int, doc_type string, text string, x1 double, y1 double, x2 double, y2 double, confidence double"


def test_fields_without_patterns_or_rules(spark):
    rows = [(7, 0, 1, 0, "card", "Bank Name", 100.0, 100.0, 190.0, 130.0, 1.0), (7, 0, 1, 1, "card", "Orbit Bank", 200.0, 101.0, 290.0, 129.0, 1.0)]
    results, review, summary = ex.extract(spark.createDataFrame(rows, SPANS), [ma.FieldSpec("bank_name", ["Bank Name"])], [])
    assert [(r.value, r.status) for r in results.collect()] == [("Orbit Bank", "not_validated")]
    assert review.count() == 0 and summary.first().filled == 1


def test_refused_value_gives_way_to_the_default(spark):
    rows = [(7, 0, 1, 0, "card", "Country", 100.0, 100.0, 190.0, 130.0, 0.2), (7, 0, 1, 1, "card", "Wonderland", 100.0, 200.0, 290.0, 229.0, 0.2)]
    spec = ma.FieldSpec("country", ["Country"], default="India", min_accept=0.9)
    results, review, _ = ex.extract(spark.createDataFrame(rows, SPANS), [spec], va.ID_RULES)
    r = results.first()
    assert (r.value, r.status, r.source, r.page, r.kind) == ("India", "valid", "config_default", None, None) and r.score < 900_000
    assert review.count() == 0


def test_state_of_another_pin_puts_both_in_doubt(spark):
    rows = [(7, 0, 1, i, "card", t, 100.0, 100.0 + 50 * i, 300.0, 130.0 + 50 * i, 1.0) for i, t in enumerate(["State: Punjab", "PIN Code: 411001"])]
    rows += [(8, 0, 1, i, "card", t, 100.0, 100.0 + 50 * i, 300.0, 130.0 + 50 * i, 1.0) for i, t in enumerate(["State: Maharashtra", "PIN Code: 411001"])]
    specs = [ma.FieldSpec("state", ["State"]), ma.FieldSpec("pin_code", ["PIN Code"], ["[1-9][0-9]{5}"])]
    pins = spark.createDataFrame([("411001", "Maharashtra", "Pune")], "pin string, state string, district string")
    _, review, _ = ex.extract(spark.createDataFrame(rows, SPANS), specs, va.ID_RULES, pins=pins)
    assert {(r.set_id, r.field, r.reason) for r in review.collect()} == {(7, "state", "validation_warning"), (7, "pin_code", "pin_state_mismatch")}


def test_no_nested_loop_between_texts_and_captions(spark):
    rows = [(7, 0, 1, 0, "card", "Bank Name", 100.0, 100.0, 190.0, 130.0, 1.0)]
    df = spark.createDataFrame(rows, SPANS)
    for plan in (ma.label_hits(df, SPECS, ["set_id", "doc", "page", "ord"]), ma.label_like(df.select(F.col("text").alias("key")), SPECS)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
