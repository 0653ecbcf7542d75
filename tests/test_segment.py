"""Splitting, classification, boundaries and packing of address fragments, against plain loops and by examples."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.operators import address as ad
from spanforge.operators import segment as sg

LEX = sg.Lexicon(sg.BUILT_IN)


def covers(run):
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
        yield [run[a:b] for a, b in zip(at, at[1:])]


def worth(parts):
    """(worth, anchored) of a cover by the rules, or None if it isn't allowed."""
    found = [LEX.piece(re.sub("[^a-z0-9]", "", p.lower())) if len(p) <= sg.LONGEST_PIECE else None for p in parts]
    if None in found or found[0].letter:
        return None
    total, anchored = -sg.PER_CUT * (len(parts) - 1), False
    for i, p in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        if before and (before.digits and p.digits or before.ends & p.starts or p.letter and not before.lettered):
            return None
        w = p.credit
        if w == sg.STRONG and p.role == "tail" and after and not (after.strong or after.role == "head" or after.digits):
            w = 0.0
        if w == sg.STRONG and p.role == "head" and before and not before.strong:
            w = 0.0
        total, anchored = total + w, anchored or w == sg.STRONG
    return total, anchored


def test_lattice_against_all_splits():
    rng = random.Random(2)
    bits = ["road", "tower", "flat", "12", "7", "b", "no", "sun", "lake", "park", "2nd", "ii", "block", "nagar", "x", "street", "plot", "near", "area", "pur", "green", "5a"]
    n, split = 0, 0
    while n < 500:
        run = "".join(rng.choice(bits) for _ in range(rng.randrange(2, 5)))
        if not 6 <= len(run) <= 12:
            continue
        n += 1
        scored = [(worth(c), c) for c in covers(run)]
        best = max((s[0] for s, _ in scored if s), default=None)
        got = LEX.split(run)
        assert "".join(got) == run
        alone = LEX.piece(run)
        least = (alone.credit if alone else sg.UNLIKELY) + sg.MARGIN
        if len(got) > 1:
            split += 1
            assert worth(got)[1] and worth(got)[0] == pytest.approx(best) and best >= least
        else:  # the best covers have no anchor, gain too little, or one of them is the run itself
            tops = [(s, c) for s, c in scored if s and s[0] == pytest.approx(best)]
            assert not tops or best < least or not all(s[1] and len(c) > 1 for s, c in tops)
    assert split > 150


@pytest.mark.parametrize(
    ("run", "parts"),
    [("CANALROAD", "CANAL ROAD"), ("2NDFLOOR", "2ND FLOOR"), ("FLATNO302", "FLAT NO 302"), ("BLOCKB", "BLOCK B"), ("PHASEII", "PHASE II"), ("BLOCKBTOWER", "BLOCK B TOWER"), ("TOWERROAD", "TOWERROAD"), ("PARKSTREET", "PARKSTREET"), ("RAJNAGAR", "RAJNAGAR"), ("NANDIGRAM", "NANDIGRAM"), ("PLOTTERS", "PLOT TERS"), ("COMPLOT", "COMPLOT"), ("Shop3", "Shop3"), ("x" * 41, "x" * 41), ("", "")],
)
def test_split(run, parts):
    assert " ".join(LEX.split(run)) == parts


def test_only_rows_that_can_be_glued_reach_python(spark):
    rng = random.Random(3)
    bits = ["road", "Tower", "flat", "12", "7", "b", "no", "sun", "lake", "park", "2nd", "ii", "block", "nagar", "x", " ", "-", "street"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(2, 7))) for _ in range(800)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sg.can_be_glued(F.col("t")).alias("can")).collect()
    split = [r for r in got if any(len(LEX.split(x)) > 1 for x in r.t.split())]
    assert len(split) > 100 and all(r.can for r in split)


def test_classes(spark):
    want = {
        "3RD FLOOR": ("premises", 1, 100), "Flat 2": ("premises", 1, 100), "MIDC Industrial Area": ("estate", 2, 90), "GREENFIELDBUSINESS TOWERX": ("unknown", 4, 55), "LAKETOWER": ("building", 2, 75), "Blockade": ("structure", 1, 75),
        "5th": ("premises", 1, 85), "# 12": ("premises", 1, 80), "No. 7": ("premises", 1, 80), "31/1": ("premises", 1, 70), "Complex B": ("structure", 1, 80), "Near Canal Road": ("road", 3, 50), "Koramangala": ("unknown", 4, 55),
        "": ("unknown", 4, 55), "Rajpur Village": ("village", 5, 100), "P.O. Box": ("unknown", 4, 55), "Plot No 7": ("premises", 1, 100),
    }
    rows = spark.createDataFrame([(t,) for t in [*want, None]], "text string")
    got = {r.text: (r.tier, r.level, r.conf) for r in sg.classify_fragments(rows).collect()}
    assert got == {**want, None: ("unknown", 4, 55)}
    none = sg.classify_fragments(rows, sg.Taxonomy(())).collect()
    assert {(r.tier, r.conf) for r in none} == {("unknown", 55)}


def test_priority_beats_the_order_of_tiers(spark):
    tax = sg.Taxonomy((sg.Tier("a", 1, head=("one",)), sg.Tier("b", 2, tail=("two",)), sg.Tier("c", 3, phrases=("one two",))), priority=("c", "b"))
    assert spark.range(1).select(sg.classify(F.lit("one two"), tax)["tier"]).first()[0] == "c"


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Flat 2 Lake Tower Canal Road Rajpur", ["Flat 2", "Lake Tower", "Canal Road", "Rajpur"]),
        ("Block B Wing C Sunrise", ["Block B", "Wing C", "Sunrise"]),
        ("Plot No 7 A 12 B Lake Tower", ["Plot No 7 A 12", "B Lake Tower"]),  # four designators at most
        ("Old Park Street Market", ["Old Park Street", "Market"]),  # two tail words side by side
        ("Near Block Four Corners", ["Near Block Four Corners"]),  # two head words side by side
        ("House of Flat Makers", ["House", "of Flat Makers"]),  # a connector before a head word
        ("Raj Pur Hari Pur", ["Raj Pur Hari Pur"]),
        ("Raj Plot 5", ["Raj", "Plot 5"]),
        ("  Raj   Plot  5 ", ["Raj", "Plot 5"]),
        ("", [""]),
    ],
)
def test_boundaries(spark, text, parts):
    assert spark.range(1).select(sg.bounded(F.lit(text))).first()[0] == parts


def test_boundaries_lose_and_move_nothing(spark):
    rng = random.Random(4)
    words = ["Flat", "2", "B", "Tower", "Road", "no", "Lake", "Park", "Block", "II", "Near", "Rajpur", "of", "P.O.", "Street"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", sg.bounded(F.col("t")).alias("p")).collect():
        assert " ".join(r.p) == r.t and all(r.p)


def test_lines_by_trust(spark):
    texts = {
        1: "2NDFLOOR, SUNRISETOWER, CANALROAD, Rajpur",  # glued words
        2: "Aaa, Bbb, Ccc",  # nothing known: medium, one group
        3: "Flat 2 Lake Tower Canal Road Rajpur",  # found boundaries: three lines at most
        4: "Flat 1, Lake Tower, Aaa, Bbb, Ccc, Ddd",  # a run of four places
        5: "aaa bbb ccc ddd",  # a single unknown text
        6: None,
    }
    rows = spark.createDataFrame(list(texts.items()), "k int, a string")
    got = {r.k: (r.lines, r.confidence) for r in ad.segment_lines(rows, "a").collect()}
    assert got[1] == (["2ND FLOOR", "SUNRISE TOWER", "CANAL ROAD", "Rajpur"], "high")
    assert got[2] == (["Aaa, Bbb, Ccc"], "medium")
    assert got[3] == (["Flat 2, Lake Tower", "Canal Road", "Rajpur"], "medium")
    assert got[4] == (["Flat 1, Lake Tower", "Aaa, Bbb, Ccc", "Ddd"], "medium")
    assert got[5] == (["aaa bbb ccc ddd"], "medium") and got[6] == ([], "low")


def test_pin_glued_to_a_word(spark):
    rows = spark.createDataFrame([(1, "12 MG Road, Pune, Maharashtra PIN411001"), (2, "Mohali, Punjab160055, India"), (3, "Flat 1234567, Pune"), (4, "A 411001 B, Pune")], "k int, a string")
    got = {r.k: r for r in ad.resolve_address(rows, "a", states={"punjab": "Punjab", "maharashtra": "Maharashtra"}).collect()}
    assert (got[1].pin, got[2].pin, got[2].state, got[3].pin) == ("411001", "160055", "Punjab", "")
    assert got[4].pin == "411001" and got[4].rest == ["A B"]
