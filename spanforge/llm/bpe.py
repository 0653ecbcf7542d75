"""Byte-level BPE by prefix dynamic programming: encoding, decoding, appends and edits."""

from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts beyond this many characters are split by an iterator, a bounded number of pieces at a time; texts of so many together share their look-ups.
LONG_TEXT, PIECES_AT_ONCE, BLOCK_CHARS = 1 << 20, 1 << 16, 1 << 20
#: Pieces a worker remembers in each of two generations, pairs of tokens, and the longest piece it remembers.
CACHE_PIECES, CACHE_PAIRS, CACHE_PIECE_CHARS = 150_000, 500_000, 64
#: Instead of a prefix's last token: the empty prefix has none, the prefix can't be encoded.
START, NONE = -1, -2


class Vocabulary:
    """Tokens by rank, and which pairs of tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self._whole: dict[int, bool] = {}
        self._after: list[dict[int, bool]] = [{} for _ in self.tokens]
        self._n_pairs = 0
        self._edges: tuple[dict[int, list], dict[int, list]] = ({}, {})

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    def merged(self, piece: bytes) -> list[int]:
        """BPE as defined: the adjacent pair of the lowest rank merges first, the leftmost at a tie. For short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.tokens)))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def is_whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        if token not in self._whole:
            self._whole[token] = self.merged(self.tokens[token]) == [token]
        return self._whole[token]

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts that stand at one end of a whole token while it is merged, from the token itself down to
        a byte, each with the rank of the merge that takes it up."""
        found = self._edges[right].get(token)
        if found is None:
            found, taken = [], len(self.tokens)
            part = self.tokens[token]
            while part:
                found.append((part, taken))
                taken = self.ranks[part]
                part = self._halves(part)[right] if len(part) > 1 else b""
            self._edges[right][token] = found
        return found

    def _halves(self, whole: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a whole token joins."""
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.tokens)))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two whole tokens' bytes, taken together, encode to just these two; with ``START`` on the
        left, whether the right one is whole; never with ``NONE``.

        They don't if some merge across their border comes before both of its parts are taken up within their
        own token; at equal ranks the one further left is first.
        """
        found = self._after[right].get(left)
        if found is None:
            found = left != NONE and self.is_whole(right) and (left == START or not self._crossed(left, right))
            if self._n_pairs >= CACHE_PAIRS:
                for known in self._after:
                    known.clear()
                self._n_pairs = 0
            self._n_pairs += 1
            self._after[right][left] = found
        return found

    def _crossed(self, left: int, right: int) -> bool:
        rank, none = self.ranks.get, len(self.tokens)
        for b, b_taken in self._edge(right, False):
            for a, a_taken in self._edge(left, True):
                across = rank(a + b, none)
                if across < a_taken and across <= b_taken and across < none:
                    return True
        return False


class Prefixes:
    """The last token of each prefix of a piece.

    An encoding is valid just if its tokens are whole and its neighbours fit, so a prefix has one valid last
    token and ``last[i]`` stays right whatever is appended; the tokens are read off from the end.
    """

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [START]
        self.append(piece)

    def append(self, more: bytes) -> None:
        v, start = self.vocabulary, len(self.piece)
        self.piece += more
        piece, last, rank, after, longest = self.piece, self.last, v.ranks.get, v._after, v.longest
        for end in range(start + 1, len(piece) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                token = rank(piece[begin:end])
                if token is not None:
                    fits = after[token].get(last[begin])
                    if fits or fits is None and v.fits(last[begin], token):
                        last.append(token)
                        break
            else:
                last.append(NONE)  # a byte that the vocabulary lacks

    def truncate(self, size: int) -> None:
        self.piece, self.last = self.piece[:size], self.last[: size + 1]

    def tokens(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            if self.last[end] < 0:
                raise ValueError(f"no token ends at byte {end} of the piece")
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[self.last[end]])
        return out[::-1]


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Tokenizer:
    """Encodes text piece by piece, a piece being a match of ``pattern``; no special tokens."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern = Vocabulary.read(path), regex.compile(pattern)
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.vocabulary.ranks.get(raw)
        return [whole] if whole is not None else Prefixes(self.vocabulary, raw).tokens()

    def _packed(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of each piece. Unknown short ones are taken in byte order, so that each starts from the prefix
        that it shares with the one before."""
        out, unknown = {}, []
        for p in pieces:
            ids = self._cache.get(p)
            if ids is None and (ids := self._older.get(p)) is not None:
                self._remember(p, ids)
            if ids is None:
                unknown.append((p.encode(), p))
            else:
                out[p] = ids
        unknown.sort()
        shared, rank = Prefixes(self.vocabulary), self.vocabulary.ranks.get
        for raw, p in unknown:
            whole = rank(raw)
            if whole is not None:
                ids = [whole]
            elif len(p) > CACHE_PIECE_CHARS:
                ids = Prefixes(self.vocabulary, raw).tokens()
            else:
                same = min(len(raw), len(shared.piece))
                while raw[:same] != shared.piece[:same]:
                    same -= 1
                shared.truncate(same)
                shared.append(raw[same:])
                ids = shared.tokens()
            out[p] = _pack(ids)
            if len(p) <= CACHE_PIECE_CHARS:
                self._remember(p, out[p])
        return out

    def _remember(self, piece: str, ids: bytes) -> None:
        if len(self._cache) >= CACHE_PIECES:  # what is still in use moves on from the older generation
            self._older, self._cache = self._cache, {}
        self._cache[piece] = ids

    def encode_chunks(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, some pieces at a time."""
        if len(text) <= LONG_TEXT:
            yield self.encode_many([text])[0]
            return
        pieces = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(pieces, PIECES_AT_ONCE)):
            yield b"".join(map(self._packed(set(some)).__getitem__, some))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """As ``encode_chunks``, for texts whose pieces are held at once."""
        split = [self.pattern.findall(t) for t in texts]
        ids = self._packed(set().union(*split)).__getitem__
        return [b"".join(map(ids, pieces)) for pieces in split]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_chunks(text)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each worker process."""
    return Tokenizer(path, pattern)


class EncodedText:
    """A text with its pieces' tokens; appends and edits encode only what they touch."""

    def __init__(self, tokenizer: Tokenizer, text: str = ""):
        self.tokenizer, self.text, self.ends, self.ids = tokenizer, "", [], []
        self.encoded_chars = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """``text[start:end]`` becomes ``new``.

        A match depends on the text from its start to two characters past its end, so pieces that end two
        characters before the edit stay. Beyond the edit, once a piece ends where an old one did, the rest
        stays as well.
        """
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        keep = bisect_right(self.ends, start - 2)
        at = self.ends[keep - 1] if keep else 0
        ends, ids, old = [], [], keep
        for m in self.tokenizer.pattern.finditer(text, at):
            ends.append(m.end())
            ids.append(self.tokenizer.piece(m.group()))
            self.encoded_chars += m.end() - m.start()
            if m.end() >= start + len(new):
                while old < len(self.ends) and self.ends[old] + shift < m.end():
                    old += 1
                if old < len(self.ends) and self.ends[old] >= end and self.ends[old] + shift == m.end():
                    old += 1
                    break
        else:
            old = len(self.ends)
        self.text = text
        self.ends = self.ends[:keep] + ends + [e + shift for e in self.ends[old:]]
        self.ids = self.ids[:keep] + ids + self.ids[old:]

    def tokens(self) -> list[int]:
        return [t for ids in self.ids for t in ids]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of up to ``BLOCK_CHARS`` characters together, with the first one's place; a longer text is by itself."""
    at, some, chars = 0, [], 0
    for i, x in enumerate(texts):
        text = x.as_py() or ""
        if some and chars + len(text) > BLOCK_CHARS:
            yield at, some
            at, some, chars = i, [], 0
        some.append(text)
        chars += len(text)
    if some:
        yield at, some


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path, pattern)
    for batch in batches:
        for at, texts in _blocks(batch.column(1)):
            ids = t.encode_many(texts) if len(texts) > 1 else [b"".join(t.encode_chunks(texts[0]))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text, as little-endian unsigned 32-bit integers.

    A null text is empty and has no ids. Repeated rows, null ids and extra columns are fine; an empty table
    gives no rows. The vocabulary is read once by each worker; a worker remembers at most twice
    ``CACHE_PIECES`` pieces.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encoded(it, path, pattern), "doc_id long, ids binary")


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            raw = [t.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in part.column("ids")]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the ids' bytes as ``decoded``."""
    return encoded.mapInArrow(lambda it: _decoded(it, path, pattern), "doc_id long, ids binary, decoded binary")


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in _decoded(_encoded(batches, path, pattern), path, pattern):
        ids, raw = batch.column("ids"), batch.column("decoded")
        hexed = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in c]) for c in (ids, raw)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x.as_buffer()) // 4 for x in ids], pa.int64()), *hexed], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, and carries digests only."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _digests(it, path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
