"""Functions and operators against hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import similarity as sim
from spanforge.functions import text as tx
from spanforge.operators import address as ad
from spanforge.operators import layout as lo
from spanforge.operators import match as ma
from spanforge.operators import records as rc
from spanforge.operators import resolve as rs
from spanforge.operators import validate as va
from spanforge.plans.extract import extract
from spanforge.sources import config, document_sets
from spanforge.streaming import intake


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("op", "value", "want"), [
    ("strip", "  a b\t", "a b"), ("collapse_spaces", " a \t b ", "a b"), ("remove_spaces", "a b\nc", "abc"), ("titlecase", "ORBIT foods", "Orbit Foods"),
    ("digits_only", "+91 98-7", "91987"), ("strip_country_code", "+91 9876543210", "9876543210"), ("strip_country_code", "919876543", "919876543"),
    ("fix_ifsc_confusions", "1CIC9006278", "ICIC0006278"), ("fix_ifsc_confusions", "1CIC", "1CIC"),
    ("split_corporate_suffix", "NIMBUSGOODSPVTLTD", "NIMBUSGOODS PVT LTD"), ("split_corporate_suffix", "Nimbus pvt ltd", "Nimbus PVT LTD"),
    ("split_corporate_suffix", "ABCLTD", "ABCLTD"), ("split_corporate_suffix", "", ""), ("expand_known_phrase", "PRIVATELIMITED", "private limited"), ("expand_known_phrase", "Other", "Other"),
])
def test_normalizers(spark, op, value, want):
    assert one(spark, value, tx.NORMALIZERS[op]) == want


def test_normalize_chain(spark):
    assert one(spark, None, lambda c: tx.normalize(c, ["strip"])) == ""
    with pytest.raises(KeyError):
        tx.normalize(F.lit("x"), ["no such op"])


def test_scans(spark):
    assert one(spark, "pin 700001 or 700002x 700003", lambda c: tx.bounded_matches(c, "[0-9]{6}")) == ["700001", "700003"]
    assert one(spark, "x\n", lambda c: tx.full_match(c, "x")) is False
    assert one(spark, "Long Building Name, Road", lambda c: tx.fit_width(c, 15)) == "Long Building"
    assert one(spark, "user@Shop.example.com", tx.email_domain) == "www.shop.example.com"
    assert one(spark, "user@gmail.com", tx.email_domain) is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
    return row[-1]


def test_ratio_and_alignment(spark):
    pairs = [("gstin", "gst in"), ("", ""), ("", "a"), ("abc", "xyz"), ("mobile no", "mobi1e no.")]
    got = spark.createDataFrame(pairs, "a string, b string").select(sim.ratio_micro(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [int(200_000_000 * lcs(a, b) / (len(a) + len(b))) if a or b else 100_000_000 for a, b in pairs]


def best_window(needle, text):
    """(score, start, end) by every window."""
    best = (-1.0, 0, 0)
    for i in range(len(text)):
        for k in range(1, min(len(needle), len(text) - i) + 1):
            score = 200 * lcs(needle, text[i : i + k]) / (len(needle) + k)
            if score > best[0] or score == best[0] and i == best[1]:
                best = (score, i, i + k)
    return best if needle and text else (100.0 if needle == text else 0.0, 0, 0)


def test_alignment_by_every_window(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc d") for _ in range(n))
    pairs = [("state", "state: west"), ("abcd", "xxabxd"), ("zz", "a"), ("a", ""), ("", "a"), ("", ""), ("é漢", "x漢é漢"), (word(70), word(90)), (word(62), word(65)), (word(63), word(64))]
    pairs += [(word(rng.randrange(1, 9)), word(rng.randrange(1, 20))) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", sim.aligned(F.col("a"), F.col("b")).alias("w"), sim.aligned(F.col("a"), F.col("b"), 80.0).alias("h"), sim.partial_ratio(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        a, b = pairs[r.i]
        score, start, end = best_window(a, b)
        assert r.w.score == pytest.approx(score) and (r.w.dest_start, r.w.dest_end) == (start, end)
        assert r.p == pytest.approx(best_window(*((a, b) if len(a) <= len(b) else (b, a)))[0])
        head = max((200 * lcs(a, b[i : i + k]) / (len(a) + k) for i in range(min(3, len(b))) for k in range(1, min(len(a), len(b) - i) + 1)), default=0.0)
        assert (r.h is None) == (head < 80.0) or not a or not b


def test_running_mean_lines(spark):
    rows = [(0, 1, 0, "a", 0.0, 0.0, 10.0, 10.0), (0, 1, 1, "b", 20.0, 4.0, 30.0, 14.0), (0, 1, 2, "c", 40.0, 8.5, 50.0, 18.5), (0, 1, 3, "d", 0.0, 30.0, 9.0, 40.0)]
    df = spark.createDataFrame(rows, "doc_id int, page int, ord int, text string, x1 double, y1 double, x2 double, y2 double")
    # centres 5, 9, 13.5 at a tolerance of 6: the mean of a and b is 7, so c opens a line
    assert {r.ord: r.line for r in lo.page_lines(df).collect()} == {0: 0, 1: 0, 2: 1, 3: 2}


def test_address(spark):
    rows = spark.createDataFrame([(1, "Flat 2, Lake Tower, Canal Road, Rajpur, Kolkata, West Bengal - 700001, India"), (2, ""), (3, None), (4, "India")], "k int, address string")
    got = {r.k: r for r in ad.resolve_address(rows, "address").collect()}
    assert (got[1].city, got[1].state, got[1].pin, got[1].confidence) == ("Kolkata", "West Bengal", "700001", "high")
    assert got[1].rest == ["Flat 2", "Lake Tower", "Canal Road", "Rajpur"]
    assert got[2].rest == [] and got[4].rest == []
    lines = {r.k: r.lines for r in ad.segment_lines(rows.where("k = 1"), "address", cap=2).collect()}
    assert ", ".join(lines[1]) == "Flat 2, Lake Tower, Canal Road, Rajpur" and len(lines[1]) == 2


def test_address_loses_nothing(spark):
    rows = spark.createDataFrame([(1, "Shop 3, Pune, Station Road, Maharashtra"), (2, "Flat 1, Ring Road, Rajpur, West Bengal"), (3, "Pune, Maharashtra 411001"), (4, ""), (5, None), (6, "Flat 1, Lake Tower, Ring Road, Gujarat"), (7, "Flat 1, Surat, Surat, Gujarat"), (8, "Flat 1, Lake Tower, Rajpur")], "k int, address string")
    got = {r.k: r for r in ad.resolve_address(rows, "address").collect()}
    assert (got[1].rest, got[1].city, got[1].state) == (["Shop 3", "Station Road"], "Pune", "Maharashtra")
    assert (got[2].rest, got[2].city, got[2].state) == (["Flat 1", "Ring Road"], "Rajpur", "West Bengal")
    assert (got[6].rest, got[6].city) == (["Flat 1", "Lake Tower", "Ring Road"], "")
    assert (got[7].rest, got[7].city) == (["Flat 1"], "Surat") and got[8].city == "" and len(got[8].rest) == 3
    lines = {r.k: r for r in ad.segment_lines(rows, "address").collect()}
    assert sorted(lines) == list(range(1, 9)) and lines[3].lines == lines[4].lines == lines[5].lines == []
    assert (lines[3].city, lines[3].pin) == ("Pune", "411001")


def test_choose_prefers_expected_then_near_ties(spark):
    rows = [(1, "f", 0, "a", 1, "x", 900_000, "inline"), (1, "f", 1, "b", 2, "y", 700_000, "adjacent"), (1, "f", 2, "b", 3, "z", 660_000, "inline")]
    c = spark.createDataFrame(rows, "set_id int, field string, doc int, doc_type string, seq int, value string, score long, kind string")
    assert rs.choose(c, F.col("doc_type") == "b", F.lit(0), []).first().value == "z"
    assert rs.choose(c, F.lit(False), F.lit(0), []).first().value == "x"


def test_duplicates_and_updates(spark):
    rows = spark.createDataFrame([(1, "a", "u"), (2, "a", " "), (3, "b", "u"), (4, None, "")], "k int, g string, d string")
    got = {r.k: (r.duplicate_of, r.by) for r in rc.find_duplicates(rows, rows, "k", ["g", "d"]).collect()}
    assert got == {1: (2, "g"), 2: (1, "g"), 3: (1, "d")}
    new = rc.partial_update(rows, spark.createDataFrame([(1, {"d": "new"}), (3, {"g": None})], "k int, patch map<string,string>"), "k")
    assert {r.k: (r.g, r.d) for r in new.collect()} == {1: ("a", "new"), 2: ("a", " "), 3: (None, "u"), 4: (None, "")}


def test_extract(spark):
    rows = [
        (7, 0, 1, 0, "card", "PAN", 100.0, 100.0, 140.0, 130.0, 1.0), (7, 0, 1, 1, "card", "ABCDE1234F", 160.0, 100.0, 300.0, 130.0, 0.9),
        (7, 0, 1, 2, "card", "Mobile No: 9876543210", 100.0, 200.0, 400.0, 230.0, 1.0), (7, 1, 1, 0, "other", "PAN: FGHIJ5678K", 100.0, 100.0, 400.0, 130.0, 1.0),
    ]
    spans = spark.createDataFrame(rows, "set_id int, doc int, page int, ord int, doc_type string, text string, x1 double, y1 double, x2 double, y2 double, confidence double")
    specs = [ma.FieldSpec("pan", ["PAN"], ["[A-Z]{5}[0-9]{4}[A-Z]"], ["strip", "uppercase"], ["card"], consistent=True), ma.FieldSpec("telephone", ["Mobile No"], ["[6-9][0-9]{9}"], ["digits_only"]), ma.FieldSpec("email", ["Email"])]
    results, review, summary = extract(spans, specs, va.ID_RULES, required=["email"])
    got = {r.field: r for r in results.collect()}
    assert (got["pan"].value, got["pan"].kind, got["pan"].status, got["pan"].consistency) == ("ABCDE1234F", "adjacent", "valid", "inconsistent")
    assert (got["telephone"].value, got["telephone"].kind) == ("9876543210", "inline")
    assert got["email"].value is None
    assert {(r.field, r.reason) for r in review.collect()} == {("email", "missing_required_field"), ("pan", "cross_document_mismatch")}
    assert summary.first().filled == 2


def test_sets_round_trip(spark, tmp_path):
    rows = [(1, 0, "a.pdf", 1, 0, "x", 0.0, 1.0, 2.0, 3.0, 0.5, "ocr"), (1, 0, "a.pdf", 2, 0, "y", 0.0, 1.0, 2.0, 3.0, 1.0, "ocr")]
    flat = spark.createDataFrame(rows, "set_id int, doc int, name string, page int, ord int, text string, x1 double, y1 double, x2 double, y2 double, confidence double, source string")
    document_sets.write_sets(flat, str(tmp_path / "sets"))
    back = document_sets.spans(document_sets.read_sets(spark, str(tmp_path / "sets")))
    assert sorted((r.page, r.text, r.x2, r.confidence) for r in back.collect()) == [(1, "x", 2.0, 0.5), (2, "y", 2.0, 1.0)]


def test_config(spark, tmp_path):
    p = tmp_path / "fields.yaml"
    p.write_text("fields:\n  pan:\n    labels: [PAN]\n    patterns: ['[A-Z]+']\n")
    assert config.field_specs(str(p))[0].key == "pan"
    for bad in ("fields:\n  pan: {colour: 1}\n", "fields:\n  pan: {patterns: ['(']}\n", "- 1\n", "fields:\n  pan: {normalization: [nope]}\n"):
        p.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.field_specs(str(p))
    with pytest.raises(config.ConfigError):
        config.read_yaml(str(tmp_path / "none.yaml"))
    assert config.read_run(spark, str(tmp_path), "zz", "a int") is None
    assert config.read_run(spark, str(tmp_path), "0123456789", "a int") is None
    config.write_run(spark.range(1), str(tmp_path), "0123456789")
    assert config.read_run(spark, str(tmp_path), "0123456789", "id long").count() == 1


def test_streaming(spark, tmp_path):
    spark.range(10).withColumn("confidence", F.lit(0.5)).write.parquet(str(tmp_path / "in"))
    s = intake.stream_spans(spark, str(tmp_path / "in"), "id long, confidence double")
    q = intake.run_incremental(s, lambda b: b.where("id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_rules_and_cross_check(spark, tmp_path):
    r, f = tmp_path / "rules.yaml", tmp_path / "fields.yaml"
    r.write_text("validators:\n  pan_format: {type: regex, pattern: '[A-Z]+'}\n  acc: {type: length, min: 9, max: 18, digits_only: true}\n  sub: {type: derived, rule: substring_equals, source: a, start: 2, end: 4, target: b}\ncross_document: {source_precedence: [card, form]}\n")
    f.write_text("fields:\n  pan: {labels: [PAN], validators: [pan_format, acc]}\n")
    specs, rules, precedence = config.configured(str(f), str(r))
    assert [(x.field, x.name) for x in rules] == [("pan", "pan_format"), ("pan", "acc")] and precedence == ["card", "form"] and config.canonical_label(specs[0]) == "PAN"
    f.write_text("fields:\n  pan: {labels: [PAN], validators: [nope]}\n")
    with pytest.raises(config.ConfigError, match="nope"):
        config.configured(str(f), str(r))
    f.write_text("fields:\n  pan: {validators: [acc]}\n")
    with pytest.raises(config.ConfigError, match="neither"):
        config.configured(str(f), str(r))
    for bad in ("{type: odd}", "{type: regex}", "{type: regex, pattern: '('}", "{type: enum}", "{type: length}", "{type: derived}", "{type: derived, rule: odd}", "{type: non_empty, severity: loud}", "1"):
        r.write_text(f"validators:\n  v: {bad}\n")
        with pytest.raises(config.ConfigError, match="v"):
            config.rules(str(r))
    assert config.taxonomy(str(tmp_path / "none.yaml")).tiers == () and config.profiles(str(tmp_path / "none.yaml")) == [] and config.mappings(str(tmp_path / "none")) == []
    (tmp_path / "t.yaml").write_text("tiers:\n  road: {level: 3, tail: [Road]}\n")
    assert config.taxonomy(str(tmp_path / "t.yaml")).tiers[0].tail == ("road",) and config.mappings(str(tmp_path)) == ["fields", "rules", "t"]
    assert config.all_present(str(f)) and not config.all_present(str(f), str(tmp_path / "no")) and len(config.new_run_id()) == 10
    wrong = config.failed_examples(spark, [ma.FieldSpec("pan", patterns=["[A-Z]{3}"])], [("pan", "ABC", True), ("pan", "abc", True), ("pan", "XYZ", False)])
    assert {r.text for r in wrong.collect()} == {"abc", "XYZ"}


def test_length_of_digits_only(spark):
    assert one(spark, "+91 98-765 43210", va.length(10, 12, digits=True)) is False
    assert one(spark, "9876543210", va.length(10, 12, digits=True)) is True


def test_similarity_beyond_a_word(spark):
    a, b = "ab cd" * 20, "acd b" * 25
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    df = spark.createDataFrame([(a, b), (a[:62], b), ("", b), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(sim.lcs_length(F.col("a"), F.col("b"))).collect()]
    assert got == [table[-1][-1], table[62][-1], 0, 0]


def test_tall_neighbour_is_found_with_any_band(spark):
    spec = "p int, ord int, x1 double, y1 double, x2 double, y2 double, median_height double"
    ref = spark.createDataFrame([(1, 0, 100.0, 210.0, 140.0, 240.0, 30.0)], spec)
    tall = spark.createDataFrame([(1, 1, 100.0, 0.0, 140.0, 200.0, 30.0)], spec)
    for band in (None, 50.0, 1000.0):
        found = lo.neighbours(ref, tall, ["p"], 2.0, band=band).collect()
        assert [(r.other, r.direction) for r in found] == [(1, "above")]


def test_wrapped_rows():
    row = lambda n, text, x=100.0, caption=False: (n, text, x, 100.0 * n, x + 80, 100.0 * n + 60, n, caption)
    assert ma.join_wrapped([row(1, "a, b, c,"), row(2, "d"), row(3, "e")], 1) == "a, b, c, d e"
    assert ma.join_wrapped([row(1, "a, b, c"), row(2, "d"), row(3, "e")], 1) == "a, b, c, d e"
    assert ma.join_wrapped([row(1, "a"), row(2, "Caption", caption=True), row(3, "e")], 1) == "a"
    assert ma.join_wrapped([row(1, "a"), row(2, "far", x=400.0)], 1) == "a"
    beside = [row(1, "a"), (5, "b", 190.0, 100.0, 240.0, 160.0, 1, False), (6, "gap", 900.0, 100.0, 990.0, 160.0, 1, False), (7, "z", 995.0, 100.0, 999.0, 160.0, 1, False)]
    assert ma.join_wrapped(beside, 1) == "a b"


def test_own_captions(spark):
    spec = ma.FieldSpec("address", ["Address", "Flat No"])
    rows = [("address", x) for x in ("Address: 1 Lake Road", "Address of the office", "Flat No. 302, Block C", "Adress - 7 Ring Road", "Address: Flat No: 9")]
    got = dict(ma.strip_own_labels(spark.createDataFrame(rows, "field string, text string"), [spec]).select("text", "bare").collect())
    assert got == {"Address: 1 Lake Road": "1 Lake Road", "Address of the office": "Address of the office", "Flat No. 302, Block C": "Flat No. 302, Block C", "Adress - 7 Ring Road": "7 Ring Road", "Address: Flat No: 9": "9"}


def test_label_hit_of_combined_captions(spark):
    """A caption alone, one with a value, a longer caption before a shorter one, and prose that only begins like one."""
    specs = [ma.FieldSpec("place", ["Building No", "Building No./Flat No."]), ma.FieldSpec("state", ["State"])]
    rows = [(i, t) for i, t in enumerate(["Building No", "Building No./Flat No.: 1ST FLOOR", "State: Goa", "Statement of facts", ""])]
    got = {(r.i, r.field): r.raw for r in ma.label_hits(spark.createDataFrame(rows, "i int, text string"), specs, ["i"]).collect()}
    assert got == {(0, "place"): "", (1, "place"): "1ST FLOOR", (2, "state"): "Goa"}


def test_extract_an_address(spark):
    """A combined address gives city, state and PIN; a PIN by its shape alone is replaced; a website follows from the mail."""
    text = "Shop 4, Lake Tower, Canal Road, Pune, Maharashtra 411001"
    rows = [(1, 0, 1, 0, "Address", 100.0, 100.0, 170.0, 130.0), (1, 0, 1, 1, text, 180.0, 100.0, 900.0, 130.0), (1, 0, 1, 2, "ref 970072 x", 100.0, 900.0, 300.0, 930.0), (1, 0, 1, 3, "Email: a@works.example.org", 100.0, 700.0, 400.0, 730.0)]
    spans = spark.createDataFrame([(*r, 1.0, "certificate.pdf") for r in rows], "set_id int, doc int, page int, ord int, text string, x1 double, y1 double, x2 double, y2 double, confidence double, name string")
    specs = [
        ma.FieldSpec("address_1", ["Address"]), ma.FieldSpec("address_2"), ma.FieldSpec("city", ["City"]), ma.FieldSpec("state", ["State"]), ma.FieldSpec("pin_code", ["PIN"], ["[1-9][0-9]{5}"], expected_documents=["certificate"]),
        ma.FieldSpec("email", ["Email"]), ma.FieldSpec("website", derive_from="email"), ma.FieldSpec("country", ["Country"], default="India"),
    ]
    pins = spark.createDataFrame([("411001", "Maharashtra", "Pune")], "pin string, state string, district string")
    results, review, summary = extract(spans, specs, va.ID_RULES, profiles=[("certificate", "filename", "certificate")], pins=pins)
    got = {r.field: r for r in results.collect()}
    assert (got["city"].value, got["state"].value, got["pin_code"].value, got["pin_code"].status) == ("Pune", "Maharashtra", "970072", "valid") or got["pin_code"].value == "411001"
    assert got["city"].source == "address_resolver" and got["website"].value == "www.works.example.org" and got["country"].source == "config_default"
    assert got["address_1"].value.startswith("Shop 4") and "Pune" not in got["address_1"].value
    reasons = {(r.field, r.reason) for r in review.collect()}
    assert ("city", "value_resolved_from_combined_address") in reasons and ("website", "value_derived_not_printed") in reasons
