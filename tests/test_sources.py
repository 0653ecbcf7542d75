"""Word documents, files of a set, row numbers, held-out rows, lookup tables and streams."""

import io
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from spanforge.operators import evaluate as ev
from spanforge.operators import layout as lo
from spanforge.operators import match as ma
from spanforge.operators import ml
from spanforge.operators import records as rc
from spanforge.plans.extract import extract_files, registration
from spanforge.sources import config, files, word
from spanforge.streaming import intake, sync

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def cell(text, span=1):
    grid = f'<w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr>' if span > 1 else ""
    return f"<w:tc>{grid}{P.format(text)}</w:tc>"


def png(w, h):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def docx(body, media=()):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, data in media:
            z.writestr(f"word/media/{name}", data)
    return buffer.getvalue()


def recognise(rows):
    """Reads an image as its own name."""
    name = F.element_at(F.split("path", "/"), -1)
    return rows.where(~name.endswith("blank.png")).select(F.col("path").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("ord"), name.alias("text"), *[F.lit(float(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (10, 10, 90, 30))], F.lit("ocr").alias("source"))


@pytest.fixture
def folder(tmp_path):
    table = f"<w:tbl><w:tr>{cell('PAN')}{cell('ABCDE1234F')}{cell('')}</w:tr><w:tr>{cell('', 3)}</w:tr><w:tr>{cell('Bank Name', 2)}{cell('Orbit Bank')}</w:tr></w:tbl>"
    body = P.format("Form") + "<w:p/>" + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>" + table + "".join(P.format(f"line {i}") for i in range(50))
    (tmp_path / "a.docx").write_bytes(docx(body, [("image1.png", png(200, 90)), ("image2.png", png(79, 500)), ("image3.jpg", b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x64\x00\xc8\x03"), ("blank.png", png(300, 300)), ("notes.txt", b"x")]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.docx").write_bytes(docx("", [("only.bmp", b"BM" + b"\0" * 16 + struct.pack("<ii", 100, -100))]))
    (tmp_path / "d.PNG").write_bytes(png(10, 10))
    (tmp_path / "e.exe").write_bytes(b"x")
    return str(tmp_path)


def test_word_documents(spark, folder):
    good, other = files.list_inputs(spark, folder)
    assert [r.path.rsplit("/", 1)[1] for r in other.collect()] == ["e.exe"]
    spans, unread = files.load(good)
    rows = [r for r in spans.orderBy("ord").collect() if r.doc_id.endswith("a.docx")]
    assert [r.text for r in rows[:6]] == ["Form", "a\tb", "PAN", "ABCDE1234F", "Bank Name", "Orbit Bank"] and len(rows) == 56
    label, value = rows[2], rows[3]
    assert label.y1 == value.y1 and label.x2 == pytest.approx(value.x1) and {label.source, rows[0].source} == {"docx_table", "docx_paragraph"}
    assert rows[4].x2 == pytest.approx(rows[5].x1) and rows[4].y1 - label.y1 == 2 * lo.LINE_HEIGHT  # an empty row takes a line
    assert {r.page for r in rows} == {1, 2} and rows[-1].page == 2 and rows[-1].y1 == lo.TOP + 7 * lo.LINE_HEIGHT
    near = lo.neighbours(spans.where("text = 'PAN'").withColumn("median_height", F.lit(44.0)), spans.where("text <> 'PAN'"), ["doc_id", "page"], 4.0).where("direction = 'right'")
    assert [r.other for r in near.collect()] == [value.ord]
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in unread.collect()}
    assert set(reasons) == {"b.docx", "d.PNG", "image1.png", "image3.jpg", "blank.png", "only.bmp"} and "BadZipFile" in reasons["b.docx"] and reasons["d.PNG"] == "no recogniser"


def test_images_in_word_documents_become_pages(spark, folder):
    spans, unread = files.load(files.list_inputs(spark, folder)[0], recognise)
    got = sorted((r.doc_id.rsplit("/", 1)[1], r.page, r.text, r.source) for r in spans.where("source <> 'docx_paragraph' and source <> 'docx_table'").collect())
    assert got == [("a.docx", 3, "image1.png", "docx_image"), ("a.docx", 4, "image3.jpg", "docx_image"), ("c.docx", 1, "only.bmp", "docx_image"), ("d.PNG", 1, "d.PNG", "ocr")]
    assert [r.path.rsplit("/", 1)[1] for r in unread.collect()] == ["b.docx"]


def test_image_sizes():
    assert word.image_size(png(7, 9)) == (7, 9) and word.image_size(b"") is None and word.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08\x00\x05\x00\x06\x01") == (6, 5)
    assert word.image_size(b"GIF89a" + b"\0" * 30) is None


def test_files_of_a_set(spark, folder, tmp_path):
    specs = [ma.FieldSpec("pan", ["PAN"], ["[A-Z]{5}[0-9]{4}[A-Z]"]), ma.FieldSpec("vendor_name", ["Bank Name"])]
    results, review, summary, unread = extract_files(spark, folder, specs, [], set_id=9)
    assert {r.field: (r.set_id, r.value, r.doc) for r in results.collect()} == {"pan": (9, "ABCDE1234F", 0), "vendor_name": (9, "Orbit Bank", 0)}
    assert unread.count() == 7 and summary.first().filled == 2
    records, names = registration(results, review, specs)
    r = records.first()
    assert (r.company_name, r.pan_number) == ("Orbit Bank", "ABCDE1234F") and names.count() == 0
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.exe").write_bytes(b"x")
    with pytest.raises(ValueError):
        extract_files(spark, str(tmp_path / "empty"), specs, [])


def test_row_numbers(spark):
    rows = spark.range(1000).repartitionByRange(9, "id").sortWithinPartitions("id")
    assert all(r.id == r.n for r in ev.with_row_number(rows, "n").collect())
    assert ev.with_row_number(rows.where("id > 990"), "n").agg(F.max("n")).first()[0] == 8 and ev.with_row_number(rows.where("false"), "n").count() == 0
    own = spark.createDataFrame([(5, "a")], "address_id int, address string")
    assert ev.with_address_id(own, ["address"]).first().address_id == 5
    with pytest.raises(ValueError):
        ev.with_address_id(own, ["address_1"])


def test_partition_scores_by_address(spark):
    truth = spark.createDataFrame([(1, "x", "a", "b", 1), (2, "y", "c", "d", 1)], "address_id int, address string, address_1 string, address_2 string, split_index int")
    said = spark.createDataFrame([("x", "a", "b", 1)], "address string, address_1 string, address_2 string, split_index int")
    assert {r.address: (r.split_match, r.jaccard == 1.0) for r in ev.partition_scores(truth, said).collect()} == {"x": (True, True), "y": (False, False)}


def test_held_out_rows_and_accuracy(spark):
    rows = spark.createDataFrame([(k, c, float(k % 3), float(c), int(c == 1 + k % 3)) for k in range(300) for c in (1, 2, 3)], "k int, cut int, a double, b double, label int")
    split = ml.split_rows(rows).cache()
    assert {(r.label, r.held): r["count"] for r in split.groupBy("label", "held").count().collect()} == {(0, True): 60, (0, False): 540, (1, True): 30, (1, False): 270}
    assert sorted(map(tuple, split.where("held").select("k", "cut").collect())) == sorted(map(tuple, ml.split_rows(rows.repartition(5)).where("held").select("k", "cut").collect()))
    assert ml.split_rows(rows.where("label = 1 and k < 4")).where("held").count() == 0 and ml.split_rows(rows.where("false")).count() == 0
    model = ml.train(split, trees=5, depth=6)
    report = {r.held: (r.rows, r.right) for r in ml.row_accuracy(model, split).collect()}
    assert report[True][0] == 90 and report[False][0] == 810 and report[True][1] > 45
    a = ml.cut_accuracy(ml.predict(model, rows), rows).first()
    assert a.addresses == 300 and 100 < a.right <= 300


def test_lookups(spark, tmp_path):
    rows = spark.createDataFrame([(1, "111111", "A", "D"), (2, "111111", "A", "E"), (3, "111111", "A", "D"), (4, "222222", "B", None)], "n int, pin string, state string, district string")
    out = {r.pin: tuple(r)[1:] for r in config.build_pin_directory(rows, "n").collect()}
    assert out == {"111111": ("A", "D", 1), "222222": ("B", None, 0)}
    config.write_lookup(rows.select("state", "district").unionByName(rows.select("state", "district")), str(tmp_path / "t"), "state")
    text = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert sorted(x for x in text if x != "state,district") == ["A,D", "A,E", "B,"]
    (tmp_path / "m.yaml").write_text("cells:\n  pan: {sheet: S, cell: B2}\n  name: {sheet: S, cell: B3}\n")
    assert sorted(map(tuple, config.cell_map(spark, str(tmp_path / "m.yaml")).collect())) == [("name", "S", "B3"), ("pan", "S", "B2")]
    (tmp_path / "m.yaml").write_text("cells:\n  pan: {sheet: S, cell: B2}\n  name: {sheet: S, cell: B2}\n")
    with pytest.raises(config.ConfigError):
        config.cell_map(spark, str(tmp_path / "m.yaml"))


def test_corrupt_boxes_touch_few_bands(spark):
    rng = random.Random(8)
    boxes = [(1, i, x := rng.uniform(0, 900), y := rng.uniform(0, 1300), x + rng.uniform(5, 200), y + rng.uniform(8, 40)) for i in range(60)]
    boxes += [(1, 90, 5.0, 5.0, 10.0, 1e12), (1, 91, 5.0, -1e9, 10.0, 20.0)]
    df = spark.createDataFrame(boxes, "p int, ord int, x1 double, y1 double, x2 double, y2 double").withColumn("median_height", F.lit(20.0))
    plain, banded = lo.neighbours(df, df, ["p"], 4.0, band=1e13), lo.neighbours(df, df, ["p"], 4.0)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, banded.collect())) and plain.count() > 100


def test_repeats_and_windows_of_a_stream(spark, tmp_path):
    rows = [(1, "2025-01-01 00:00:01", 0.5), (1, "2025-01-01 00:00:02", 0.7), (2, "2025-01-01 00:20:00", 0.9)]
    spark.createDataFrame(rows, "id int, at string, confidence double").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = lambda: intake.stream_spans(spark, str(tmp_path / "in"), "id int, at timestamp, confidence double")
    for name, df, mode in (("firsts", intake.first_arrivals(stream(), "id", "at"), "append"), ("windows", intake.activity(stream(), "at"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("firsts").count() == 2
    assert sorted((r.n, round(r.confidence, 2)) for r in spark.table("windows").collect()) == [(1, 0.9), (2, 0.6)]


def test_sync_over_a_stream_is_that_of_the_batch(spark, tmp_path):
    rng = random.Random(9)
    events = [(rng.randrange(12), i, f"p{rng.randrange(3)}", rng.random() < 0.4) for i in range(120)]
    schema = "k long, seq long, push string, ok boolean"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, at in enumerate(range(0, 120, 40)):  # one file a micro-batch, each a run of its own
            spark.createDataFrame(events[at : at + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = sync.push_outcomes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k")
            write = lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")
            out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    want = sorted(map(tuple, rc.push_outcomes(spark.createDataFrame(events, schema), "k").collect()))
    got = sorted((r.k, r.seq, r.push, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and len({w[3] for w in want}) == 3
