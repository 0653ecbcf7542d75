"""What the review of round 4 found: the dataflow's work for each span."""

import random
import re

from pyspark.sql import functions as F

from spanforge import session
from spanforge.operators import layout as lo
from spanforge.operators import match as ma
from spanforge.operators import resolve as rs
from spanforge.operators import validate as va
from spanforge.plans import extract as ex

SPANS = "set_id int, doc int, page int, ord int, text string, x1 double, y1 double, x2 double, y2 double, confidence double, name string"


def page(rng, n, height=30):
    """Spans of a page in uneven rows."""
    out = []
    for i in range(n):
        x, y = float(rng.choice([100, 180, 260, 400])), float(100 + 36 * rng.randrange(8) + rng.randrange(-3, 4))
        out.append((i, f"t{i}", x, y, x + 70, y + rng.choice([height, height - 6, 0]), rng.random() < 0.3))
    return out


def test_the_dataflow_moves_its_spans_a_few_times(spark, monkeypatch):
    """Each shuffle of spans or candidates costs all of them; there were 61 exchanges by key and 26 merge joins, now 22 and 4."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    settled = ex.settled
    monkeypatch.setattr(ex, "settled", seen)
    monkeypatch.setattr(ma, "settled", seen)
    monkeypatch.setattr(session, "settled", seen)
    rows = [(7, 0, 1, 0, "PAN", 100.0, 100.0, 140.0, 130.0, 1.0, "card.pdf"), (7, 0, 1, 1, "ABCDE1234F", 160.0, 100.0, 300.0, 130.0, 0.9, "card.pdf"), (7, 0, 1, 2, "Email: a@b.org", 100.0, 200.0, 400.0, 230.0, 1.0, "card.pdf")]
    specs = [ma.FieldSpec("pan", ["PAN"], ["[A-Z]{5}[0-9]{4}[A-Z]"], expected_documents=["card"]), ma.FieldSpec("email", ["Email"])]
    results, _, _ = ex.extract(spark.createDataFrame(rows, SPANS), specs, va.ID_RULES, profiles=[("card", "filename", "card")])
    assert {(r.field, r.value, r.kind) for r in results.collect()} == {("pan", "ABCDE1234F", "adjacent"), ("email", "a@b.org", "inline")}
    count = lambda what: sum(len(re.findall(what, p)) for p in plans)
    assert count(r"Exchange hashpartitioning") <= 30 and count("SortMergeJoin") <= 8


def test_lines_are_told_where_values_go_on(spark):
    """``wrapped_values`` works out the lines of pages with a start as ``page_lines`` does, and needs no table of them."""
    rng = random.Random(5)
    spans = spark.createDataFrame([(k, *t) for k in range(60) for t in page(rng, 1 + k % 12)], "doc int, ord int, text string, x1 double, y1 double, x2 double, y2 double, caption boolean")
    starts = spans.where("not caption and (doc + ord) % 3 = 0")
    want = sorted(map(tuple, ma.wrapped_values(lo.page_lines(spans.withColumn("page", F.lit(1)), ("doc", "page")), starts, ["doc"]).collect()))
    assert len(want) > 50 and sorted(map(tuple, ma.wrapped_values(spans, starts, ["doc"]).collect())) == want


def test_values_go_on_over_batches():
    """A page that two batches share, one without a start, and a start without its span."""
    import pyarrow as pa

    names = ["doc", "ord", "text", "x1", "y1", "x2", "y2", "line", "caption", "start"]
    rows = [(1, 0, "a", 0.0, 0.0, 9.0, 9.0, 0, False, False), (1, 0, "", 0.0, 0.0, 0.0, 0.0, 0, False, True), (1, 1, "b", 10.0, 0.0, 19.0, 9.0, 0, False, False), (2, 0, "x", 0.0, 0.0, 9.0, 9.0, 0, False, False), (3, 5, "", 0.0, 0.0, 0.0, 0.0, 0, False, True)]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    out = [tuple(r.values()) for b in ma._wrapped(iter(table.to_batches(max_chunksize=2)), 1, False) for r in b.to_pylist()]
    assert out == [(1, 0, "a b")]


def test_neighbours_on_bands_of_a_pass(spark):
    """The same pairs by ``with_bands`` as by joins, with columns of both sides, and for some directions as by all four."""
    rng = random.Random(6)
    df = spark.createDataFrame([(k, *t) for k in range(40) for t in page(rng, 12)] + [(99, 0, "tall", 0.0, -1e7, 10.0, 1e7, False), (99, 1, "t", 12.0, 5.0, 20.0, 30.0, True)], "p int, ord int, text string, x1 double, y1 double, x2 double, y2 double, caption boolean")
    refs = F.col("caption")
    plain = lo.with_bands(df, ["p"], 3.0, refs)
    for sides in (("right", "below"), ("above",), ("left", "right"), ("right", "below", "left", "above")):
        want = lo.neighbours(plain.where(refs).drop("tall"), plain.where(~refs).drop("tall"), ["p"], 3.0).where(F.col("direction").isin(*sides)).select("p", "ref", "other", "direction", "distance_ratio")
        got = lo.neighbours(plain.where(refs).withColumn("r", F.col("text")), plain.where(~refs).withColumn("o", F.col("text")), ["p"], 3.0, sides, band="tall", keep=("r",), carry=("o",))
        assert got.where("p < 99 and (r <> concat('t', ref) or o <> concat('t', other))").isEmpty()
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_winners_with_their_alternatives(spark):
    """As ``choose`` and ``alternatives`` one after the other."""
    rng = random.Random(7)
    rows = [(rng.randrange(40), rng.choice("ab"), rng.randrange(3), rng.choice(["card", "form", None]), i, f"v{rng.randrange(9)}", rng.randrange(0, 1_000_000, 20_000), rng.choice(rs.KINDS)) for i in range(500)]
    found = spark.createDataFrame(rows, "set_id int, field string, doc int, doc_type string, seq int, value string, score long, kind string")
    wanted = F.col("doc_type") == "card"
    won = rs.choose(found, wanted, F.lit(0), ["form", "card"])
    keep = ["value", "score", "doc", "kind"]
    want = won.select("set_id", "field", *keep).join(rs.alternatives(found, won), ["set_id", "field"], "left")
    got = rs.winners(rs.pooled(found), wanted, ["form", "card"], keep)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_sets_without_a_whole_key_are_told(spark):
    """Spans without a document give no candidates, but their set has its rows."""
    rows = [(7, None, 1, 0, "PAN: ABCDE1234F", 0.0, 0.0, 90.0, 30.0, 1.0, "a"), (None, 0, 1, 0, "PAN: ABCDE1234F", 0.0, 0.0, 90.0, 30.0, 1.0, "a"), (8, 0, 1, 0, "PAN: ABCDE1234F", 0.0, 0.0, 90.0, 30.0, 1.0, "a")]
    for profiles in ([], [("card", "content", "pan")]):
        results, _, _ = ex.extract(spark.createDataFrame(rows, SPANS), [ma.FieldSpec("pan", ["PAN"], ["[A-Z]{5}[0-9]{4}[A-Z]"])], [], profiles=profiles)
        assert {(r.set_id, r.value) for r in results.collect()} == {(7, None), (None, None), (8, "ABCDE1234F")}
