"""What the review of round 3 found in the dataflow."""

import random
import time

from pyspark.sql import functions as F

from spanforge.functions import similarity as sim
from spanforge.operators import address as ad
from spanforge.operators import layout as lo
from spanforge.operators import match as ma
from spanforge.operators import ml
from spanforge.operators import resolve as rs


def test_numbers_of_premises_are_no_pins(spark):
    """As city_rules has them from the hundred-thousandth customer on."""
    cases = {
        "Shop 129735, Pune, Station Road, Maharashtra 411001": (["Shop 129735", "Pune", "Station Road", "Maharashtra"], "411001"),
        "Plot No. 123456, Surat": (["Plot No. 123456", "Surat"], ""),
        "FLAT#123456 Kolkata 700001": (["FLAT#123456 Kolkata"], "700001"),
        "Workshop 700001": (["Workshop"], "700001"),
        "Shop 3, 711302": (["Shop 3"], "711302"),
    }
    rows = spark.createDataFrame([(t, t.split(", ")) for t in cases], "t string, s array<string>")
    segs, pin = ad.strip_pin(F.col("s"))
    assert {r.t: (r.segs, r.pin) for r in rows.select("t", segs.alias("segs"), pin.alias("pin")).collect()} == cases


def test_windows_by_loops():
    """Pieces of a batch, needles of a word's bits and beyond, ties, and starts that are looked at first."""
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcé😀") for _ in range(n))
    pairs = [(some(rng.randrange(1, 12)), some(rng.randrange(1, 20))) for _ in range(200)] + [(some(n), some(90)) for n in (63, 64, 65, 70)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    def best(needle, text, first, last):
        own = [(200.0 * lcs(needle, text[i : i + k]) / (len(needle) + k), -i, k) for i in range(first, min(last + 1, len(text))) for k in range(1, 1 + min(len(needle), len(text) - i))]
        return max(own, default=(-1.0, 0, 0))

    for first, last in ((0, 1 << 40), (0, 2), (3, 1 << 40)):
        got = zip(*(x.tolist() for x in sim.best_windows(pairs[:200] if first else pairs, first, last)), strict=True)
        for (needle, text), (score, start, end) in zip(pairs, got):
            want = best(needle, text, first, last)
            assert score == want[0] and (score < 0 or (start, end - start) == (-want[1], want[2]))
    short = [p if len(p[0]) <= len(p[1]) else p[::-1] for p in pairs]
    assert sim.lcs_lengths(short).tolist() == [lcs(*p) for p in short]


def test_leaks_and_captions_of_many_rows(spark):
    """Rows by the ten thousand, in seconds: each took milliseconds when windows were walked one by one, as often as a result was named."""
    names = spark.range(20_000).select(F.col("id").alias("set_id"), F.lit("vendor_name").alias("field"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("Legal Narne of Busines "), F.col("id") % 9)).otherwise(F.concat(F.lit("Orbit lobe "), "id")).alias("value"))
    rows = names.withColumn("alternatives", F.array(F.struct(F.lit("Legal Name of").alias("value")), F.struct(F.concat(F.lit("Acme of Sines "), "set_id").alias("value"))))
    start = time.monotonic()
    out, flags = rs.without_leaks(rows, ["vendor_name"], ["Legal Name of Business", "Address of Principal Place of Business"])
    assert out.where("value = CASE WHEN set_id % 2 = 0 THEN concat('Acme of Sines ', set_id) ELSE concat('Orbit lobe ', set_id) END").count() == 20_000 and flags.count() == 10_000
    value = F.concat(F.lit("Acme of Sines "), "set_id")
    texts = names.select(F.lit("name").alias("field"), value.alias("value"), F.concat(F.lit("Legal Nane of Business: "), value).alias("text"))
    bare = ma.strip_own_labels(texts.select("field", "text"), [ma.FieldSpec("name", ["Legal Name of Business", "Name"])])
    assert bare.join(texts, ["field", "text"]).where("bare = value").count() == 20_000
    assert time.monotonic() - start < 90


def test_cut_features_pass_no_driver(spark, tmp_path):
    """A file of a few hundred bytes has 200,000 addresses: what an explode makes of them was estimated small and broadcast."""
    spark.range(200_000).select(F.lit("x").alias("c")).coalesce(1).write.parquet(str(tmp_path / "t"))
    a = spark.read.parquet(str(tmp_path / "t")).select(F.monotonically_increasing_id().alias("k"), F.array(F.lit("Shop 3"), F.lit("Lake"), F.lit("Pune")).alias("segments"), F.array(F.lit("P"), F.lit("B"), F.lit("C")).alias("tags"), F.lit(2).alias("split_index"))
    sent, settled = [], ml.settled

    def seen(df):
        sent.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    ml.settled = seen
    try:
        out = ml.with_vocabulary(ml.cut_table(a), a, ml.type_probabilities(ml.segment_vocab(a)), ["P", "B", "C"])
    finally:
        ml.settled = settled
    assert out.count() == 400_000 and out.where("left_p_P = 1000000 and cut = 1 or left_p_B = 1000000 and cut = 2").count() == 400_000
    assert "SortMergeJoin [k" in sent[-1] and "BroadcastHashJoin [k" not in sent[-1]


def test_addresses_are_spread_before_they_are_resolved(spark, tmp_path):
    """A small file is one task's input: what is worked out for an address comes behind an exchange by its key, whole and the same."""
    texts = ["Flat 12, Lake Heights, Canal Road, Pune, Maharashtra - 411001", "Shop3, ParkStreet, Rajpur, Kolkata", "", None]
    spark.createDataFrame([(k, texts[k % 4]) for k in range(400)], "k int, address string").coalesce(1).write.parquet(str(tmp_path / "t"))
    out = ad.segment_lines(spark.read.parquet(str(tmp_path / "t")), "address")
    steps = [w for line in out._jdf.queryExecution().executedPlan().toString().splitlines() for w in ("FileScan", "Generate", "REPARTITION_BY_COL") if w in line]
    above = [steps[i - 1] for i, w in enumerate(steps) if w == "FileScan"]
    assert above and set(above) == {"REPARTITION_BY_COL"}
    got = {r.k: (r.lines, r.city, r.pin) for r in out.collect()}
    assert len(got) == 400 and all(got[k] == got[k % 4] for k in got) and got[0][1:] == ("Pune", "411001")


def test_pairs_of_boxes_are_judged_once(spark):
    """However often what follows names the direction and the distance, as the whole dataflow does."""
    s = spark.range(6).select(F.lit(1).alias("page"), F.col("id").alias("ord"), F.lit(0.0).alias("x1"), (F.col("id") * 12.0).alias("y1"), F.lit(50.0).alias("x2"), (F.col("id") * 12.0 + 10).alias("y2"), F.lit(10.0).alias("median_height"))
    near = lo.neighbours(s, s, ["page"], 2.0).where("direction = 'below' and distance_ratio * 2 <= 0.5")
    lines = near._jdf.queryExecution().optimizedPlan().toString().split("\n")
    (made,) = [i for i, x in enumerate(lines) if "Generate inline" in x]
    assert any("Filter" in x and "direction#" in x for x in lines[:made])
    assert sorted((r.ref, r.other) for r in near.collect()) == [(i, i + 1) for i in range(5)]


def test_score_names_its_sum_once(spark):
    no = F.lit(False)
    score = lambda **x: ma.score(**{"label": F.col("l"), "proximity": F.lit(0), "pattern_matched": no, "has_patterns": no, "confidence": F.lit(0), "kind": F.lit("adjacent"), "same_line": no, "expected": F.lit(None).cast("boolean"), "label_like": no, "foreign": no, "short": no} | x)
    row = spark.sql("SELECT 1000000L AS l, true AS yes, cast(NULL AS boolean) AS unknown")
    yes = F.col("yes")
    plan = row.select(score(label_like=yes, foreign=yes, short=yes).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("350000") == 1
    cases = [({}, 500_000), ({"label_like": yes}, 275_000), ({"foreign": yes}, 200_000), ({"label_like": yes, "foreign": yes, "short": yes}, 55_000), ({"short": F.col("unknown")}, 500_000)]
    assert list(row.select(*[score(**x) for x, _ in cases]).first()) == [n for _, n in cases]


def test_joins_of_settled_tables_never_pass_the_driver(spark, tmp_path):
    """Files of settled tables are far smaller than their rows in memory."""
    from spanforge.plans import extract as ex

    row = "named_struct('set_id', 1L, 'doc', 0, 'page', 1, 'ord', {}, 'doc_type', 'a', 'text', '{}', 'x1', {}D, 'y1', 0D, 'x2', {}D, 'y2', 10D, 'conf', 900000L, 'line', 0, 'caption', {})"
    base = spark.sql("SELECT inline(array(" + ", ".join(row.format(*x) for x in ((0, "Name", 0, 50, "true"), (1, "Asha", 60, 100, "false"))) + "))")
    hits = base.where("caption").select(*ex.SPAN, F.lit("name").alias("field"), F.lit("name").alias("label"), F.lit(1_000_000).cast("long").alias("similarity"), F.lit("").alias("raw"))
    base, hits = ma.settled(base), ma.settled(hits)
    found = ex.adjacent(base, hits, [ma.FieldSpec("name", ["Name"])])
    assert [(r.field, r.raw, r.direction) for r in found.collect()] == [("name", "Asha", "right")]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()


def test_candidates_without_a_doubt_are_spread(spark):
    """Those with their field's shape have no key to meet captions by; one task had them all."""
    from spanforge.plans import extract as ex

    spans = spark.range(400).select(F.col("id").alias("set_id"), F.lit(0).alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("ord"), F.lit("a").alias("doc_type"), F.concat(F.lit("AB"), F.col("id") + 1000).alias("text"), *[F.lit(x).alias(c) for c, x in (("x1", 0.0), ("y1", 0.0), ("x2", 9.0), ("y2", 9.0))], F.lit(1.0).alias("confidence"))
    was = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = ex.candidates(spans, [ma.FieldSpec("code", ["Code"], ["[A-Z]{2}[0-9]{4}"])])
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was[1])
    assert sum(sizes) == 400 and max(sizes) < 200
