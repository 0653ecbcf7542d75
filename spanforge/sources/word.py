"""Word documents as rows: paragraphs, table cells with their place, embedded images."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.layout import LEFT, LINES_PER_PAGE, MAX_WIDTH, placed

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
LEAST_SIDE = 80


def _text(e: ET.Element) -> str:
    """A paragraph's text, or that of the paragraphs of a cell line by line; tables within a cell aren't its text."""
    if e.tag == f"{_W}tc":
        return "\n".join(_text(p) for p in e.findall(f"{_W}p")).strip()
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in e.iter()).strip()


def _span(cell: ET.Element) -> int:
    found = cell.find(f"{_W}tcPr/{_W}gridSpan")
    return max(1, int(found.get(f"{_W}val", "1"))) if found is not None else 1


def blocks(body: ET.Element) -> Iterator[tuple]:
    """(line, text, table, row, col, span, cols) in the document's order. A paragraph with text takes a line, a table's row
    one whatever is in it; a cell that spans columns stands in the first."""
    line = table = 0
    for block in body:
        if block.tag == f"{_W}p":
            if text := _text(block):
                yield line, text, None, None, None, None, None
                line += 1
        elif block.tag == f"{_W}tbl":
            rows = [[(c, _span(c)) for c in r.findall(f"{_W}tc")] for r in block.findall(f"{_W}tr")]
            cols = max((sum(s for _, s in r) for r in rows), default=0)
            for i, row in enumerate(rows):
                at = 0
                for cell, span in row:
                    if text := _text(cell):
                        yield line, text, table, i, at, span, cols
                    at += span
                line += 1
            table += 1


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height by the header of a PNG, BMP or JPEG; None for others."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return abs(w), abs(h)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


_PARTS = [("path", pa.string()), ("n", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("text", pa.string()), ("table", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("span", pa.int32()), ("cols", pa.int32()), ("content", pa.binary())]
PARTS = "path string, n int, kind string, line int, text string, table int, row int, col int, span int, cols int, content binary"


def parts_of(path: str, content: bytes) -> Iterator[tuple]:
    """PARTS of one document: text, then its images of at least 80 x 80 (or of unknown size) by name. A file that can't be read gives one row
    of kind ``unread`` with the reason."""
    nothing = (None,) * 5
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
            rows = [(path, n, "text", *b, None) for n, b in enumerate(blocks(body) if body is not None else [])]
            for name in z.namelist():
                if name.startswith("word/media/") and name.lower().endswith(IMAGES):
                    data = z.read(name)
                    size = image_size(data)
                    if size is None or min(size) >= LEAST_SIDE:
                        rows.append((path, len(rows), "image", None, name, *nothing, data))
    except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, EOFError, RuntimeError, NotImplementedError) as e:
        rows = [(path, 0, "unread", None, f"{type(e).__name__}: {e}"[:500], *nothing, None)]
    yield from rows


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):  # a document at a time
            rows = list(parts_of(path.as_py(), content.as_py() or b""))
            columns = zip(*rows, strict=True) if rows else [[] for _ in _PARTS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _PARTS, strict=True)], [n for n, _ in _PARTS])


def word_parts(files: DataFrame) -> DataFrame:
    """PARTS of Word files (path, content): no shuffle, a file's parts where it is read."""
    return files.select("path", "content").mapInArrow(_parts, PARTS)


def word_spans(parts: DataFrame) -> DataFrame:
    """(doc_id, page, ord, text, x1, y1, x2, y2, source) of the text of PARTS: lines down the page, cells of a row side by side in equal
    columns, so that a label and its value are right of each other."""
    width = F.lit(float(MAX_WIDTH)) / F.col("cols")
    laid = placed(parts.where("kind = 'text'").withColumn("doc_id", F.col("path")), F.col("line"))
    x1 = F.when(F.col("col").isNull(), F.col("x1")).otherwise(LEFT + F.col("col") * width)
    x2 = F.when(F.col("col").isNull(), F.col("x2")).otherwise(LEFT + (F.col("col") + F.col("span")) * width)
    return laid.select("doc_id", "page", F.col("n").alias("ord"), "text", x1.alias("x1"), "y1", x2.alias("x2"), "y2", F.when(F.col("col").isNull(), "docx_paragraph").otherwise("docx_table").alias("source"))


def text_pages(parts: DataFrame) -> DataFrame:
    """(path, pages): how many pages a document's text takes; 0 for one of images alone."""
    last = F.max(F.when(F.col("kind") == "text", F.floor(F.col("line") / LINES_PER_PAGE) + 1))
    return parts.groupBy("path").agg(F.coalesce(last, F.lit(0)).cast("int").alias("pages"))
