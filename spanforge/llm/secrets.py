"""Secret scans: an Aho-Corasick prefilter, regular expressions anchored at its hits, then embedded checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digits of the checksum in tokens of this kind: a CRC32 in base 62. Fixed values of the format.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: What the automaton reads in place of a byte: letters without case, and one sign for all hexadecimal digits.
HEX = "0"
_VIEW = bytes(ord(HEX) if chr(b) in "0123456789abcdefABCDEF" else ord(chr(b).lower()) if b < 128 else b for b in range(256))
HEX_LEAST = 32


def base62_crc32(payload: bytes, digits: int = 6) -> bytes:
    """The payload's CRC32 in base 62, with leading zeros."""
    crc, out = zlib.crc32(payload), ""
    for _ in range(digits):
        crc, digit = divmod(crc, 62)
        out = BASE62[digit] + out
    return out.encode()


def _token_checksum(m: re.Match[bytes]) -> bool:
    return base62_crc32(m[1][:-6]) == m[1][-6:]


@dataclass(frozen=True)
class SecretKind:
    """pattern: matched only where one of the ``keywords`` begins, so it has to begin with one of them; keywords are
    compared without case and with all hexadecimal digits alike. valid: what a match must also fulfil; one that fails
    is dropped, but the next is sought behind it."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern[bytes]
    valid: Callable[[re.Match[bytes]], bool]


#: The base kinds in the order of their names in results, then those with an embedded checksum.
ASSIGN = SecretKind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8)
ACCESS = SecretKind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16)
GITHUB = SecretKind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _token_checksum)
NPM = SecretKind("npm", ("npm_",), re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _token_checksum)
KEYWORD_KINDS = (ASSIGN, ACCESS, GITHUB, NPM)
#: Every kind in the order of results; ``hex`` has no keyword but the run itself.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
_HEX_RUN, _HEX = re.compile(rb"[0-9a-fA-F]+"), re.compile(rb"[0-9a-f]+")


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    by_view: dict[str, list[int]] = {}
    for i, kind in enumerate(KEYWORD_KINDS):
        for word in kind.keywords:
            by_view.setdefault(word.encode().translate(_VIEW).decode(), []).append(i)
    for view, kinds in by_view.items():
        found.add_word(view, (len(view), tuple(dict.fromkeys(kinds))))
    found.add_word(HEX * HEX_LEAST, (HEX_LEAST, ()))
    found.make_automaton()
    return found


def find_secrets(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets in UTF-8 bytes, by byte offset, in the order of start and kind.

    One pass of the automaton marks where keywords and hexadecimal runs begin. A kind's matches are then tried at
    its own marks from left to right, each behind the last match, which gives the leftmost non-overlapping matches of
    its pattern. Every pattern is of ASCII alone, so bytes and code points match alike.
    """
    marks: list[list[int]] = [[] for _ in KEYWORD_KINDS]
    found: list[tuple[int, int, str]] = []
    behind = 0
    for end, (length, kinds) in _automaton().iter(text.translate(_VIEW).decode("latin-1")):
        start = end - length + 1
        for i in kinds:
            marks[i].append(start)
        if not kinds and start >= behind:  # a run's first mark is its start
            behind = _HEX_RUN.match(text, start).end()
            found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, start, behind) if m.end() - m.start() >= HEX_LEAST]
    for kind, starts in zip(KEYWORD_KINDS, marks, strict=True):
        behind = 0
        for start in sorted(starts):
            if start >= behind and (m := kind.pattern.match(text, start)):
                behind = m.end()
                if kind.valid(m):
                    found.append((start, behind, kind.name))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def in_code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans by code point; each stretch of the text is decoded once."""
    at, points, places = 0, 0, {}
    for cut in sorted({x for start, end, _ in spans for x in (start, end)}):
        points += len(text[at:cut].decode())
        at, places[cut] = cut, points
    return [(places[start], places[end], kind) for start, end, kind in spans]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(1):
            text = x.as_py() or b""
            out.append([{"kind": k, "start": a, "end": b} for a, b, k in in_code_points(text, find_secrets(text))])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "secrets"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, secrets): for each row an array of (kind, start, end) in code points, end exclusive, by start and then kind.

    Kinds: ``assign`` (a named value of 8 characters or more), ``access`` (an access key of 16 or more), ``hex`` (a run of 32
    or more lower-case hexadecimal digits), and ``github`` and ``npm``, tokens whose last six characters are the checksum of
    those before. Spans of different kinds may overlap.

    No shuffle: each row is scanned where it is read. Null and empty texts have no secrets; texts count whole,
    however long; repeated rows, null ids and shared ids each give their row; extra columns play no part, whatever their names;
    an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_spans, "doc_id long, secrets array<struct<kind: string, start: long, end: long>>")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``scan_secrets``: counts and a digest of the base kinds,
    and all spans as ``kind:start:end``, joined by commas."""
    found = scan_secrets(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
