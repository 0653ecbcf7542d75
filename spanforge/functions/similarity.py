"""String similarity: indel ratio, token ratios, Jaccard, and alignment of a text within another."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.text import bind

#: Characters of a needle that a batch takes as bits, and characters of texts that it looks at together.
WORD, PIECE = 64, 1 << 17
#: Characters of the shorter text that the bit-parallel form takes; the sum of two numbers of so many bits is a long.
BITS = 62


def _lcs_by_bits(short: Column, other: Column) -> Column:
    """A long holds a bit for each character of ``short``; a bit turns to 0 with each character that ``other`` matches."""
    at = lambda own, x: F.aggregate(own, F.lit(0).cast("long"), lambda bits, y: bits * 2 + F.when(y == x, 1).otherwise(0))
    full = F.lit((1 << BITS) - 1)
    hits = bind(F.reverse(F.split(short, r"(?s)(?<=.)(?=.)")), lambda own: F.transform(F.split(other, r"(?s)(?<=.)(?=.)"), lambda x: at(own, x)))
    row = F.aggregate(hits, full, lambda s, hit: (s + s.bitwiseAND(hit)).bitwiseAND(full).bitwiseOR(s - s.bitwiseAND(hit)))
    return F.lit(BITS) - F.bit_count(row)


def _lcs_by_rows(a: Column, b: Column) -> Column:
    zeros = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    chars_a, chars_b = F.split(a, "(?!^)"), F.split(b, "(?!^)")

    def row(prev: Column, x: Column) -> Column:
        step = lambda cur, j: F.concat(cur, F.array(F.when(F.get(chars_b, j) == x, F.get(prev, j) + 1).otherwise(F.greatest(F.get(prev, j + 1), F.element_at(cur, -1)))))
        return F.aggregate(F.sequence(F.lit(0), F.length(b) - 1), F.array(F.lit(0)), step)

    return F.aggregate(chars_a, zeros, row, lambda r: F.element_at(r, -1))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence. Bit-parallel where the shorter text has up to ``BITS`` characters, as
    captions and names do; row by row of the table beyond."""
    short, other = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(F.length(short) <= BITS, _lcs_by_bits(short, other)).otherwise(_lcs_by_rows(a, b))


def ratio_micro(a: Column, b: Column) -> Column:
    """200 * LCS / (length + length) in millionths of 100, as a long; two empty strings are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100_000_000).otherwise(F.floor((F.lit(200_000_000).cast("long") * lcs_length(a, b)) / total)).cast("long")


def shared_letters(a: Column, b: Column) -> Column:
    """At least the length of the longest common subsequence: how many characters of either occur in the other."""
    within = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    return F.least(within(a, b), within(b, a))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio_micro(a: Column, b: Column) -> Column:
    return ratio_micro(sorted_tokens(a), sorted_tokens(b))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of the sets of words: 1 if both are empty, 0 if one is."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    both, either = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when(either == 0, 1.0).otherwise(both / either)


def _padded(texts: Sequence[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, a row for each text; lengths)."""
    lengths = np.fromiter(map(len, texts), "i8", len(texts))
    out = np.full((len(texts), max(1, lengths.max(initial=0))), fill, "u4")
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "u4")
    return out, lengths


def _marks(needles: Sequence[str], texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, lengths of needles and texts): for each character of a text the places of the needle that have it."""
    (own, n), (other, m) = _padded(needles, 0xFFFFFFFF), _padded(texts, 0xFFFFFFFE)
    bits = np.zeros(other.shape, "u8")
    for p in range(own.shape[1]):
        bits |= (other == own[:, p : p + 1]).astype("u8") << np.uint64(p)
    return bits, n, m


def _next_row(row: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """A bit turns to 0 with each character that is matched: the LCS is the number of zeros."""
    used = row & hit
    return (row + used) | (row - used)


def _pieces(pairs: Sequence[tuple[str, str]]) -> Iterator[list[int]]:
    """Numbers of the pairs (needle, text): those with longer needles alone, others with ones of like length, so that a piece is bounded."""
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]) > WORD, len(pairs[i][1])))
    while order:
        n = 1 if len(pairs[order[-1]][0]) > WORD else min(len(order), max(1, PIECE // max(1, len(pairs[order[-1]][1]))))
        yield order[-n:]
        del order[-n:]


def _places(needle: str) -> dict[str, int]:
    at = {}
    for p, x in enumerate(needle):
        at[x] = at.get(x, 0) | 1 << p
    return at


def lcs_lengths(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """The length of each pair's longest common subsequence, many pairs at once; the shorter text comes first."""
    out = np.zeros(len(pairs), "i8")
    for some in _pieces(pairs):
        short, other = zip(*[pairs[i] for i in some], strict=True)
        if len(short[0]) > WORD:
            at, full = _places(short[0]), (1 << len(short[0])) - 1
            row = full
            for x in other[0]:
                used = row & at.get(x, 0)
                row = (row + used) & full | (row - used)
            out[some] = len(short[0]) - row.bit_count()
            continue
        bits, _, _ = _marks(short, other)
        row = np.full(len(short), ~np.uint64(0))
        for j in range(bits.shape[1]):
            row = _next_row(row, bits[:, j])
        out[some] = np.bitwise_count(~row)
    return out


def _some_windows(needles: Sequence[str], texts: Sequence[str], first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, start, end) of the best window that starts at ``first`` to ``last``; needles and texts aren't empty. All starts of all
    texts grow by a character at a time."""
    bits, n, m = _marks(needles, texts)
    starts = np.arange(first, min(last + 1, bits.shape[1]))
    bits = np.pad(bits, ((0, 0), (0, n.max())))
    row = np.full((len(n), len(starts)), ~np.uint64(0))
    score, size = np.full(row.shape, -1.0), np.zeros(row.shape, "i8")
    for j in range(n.max()):
        row = _next_row(row, bits[:, first + j : first + j + len(starts)])
        now = 200.0 * np.bitwise_count(~row) / (n + (j + 1))[:, None]
        better = (now >= score) & (j < n)[:, None] & (starts + j < m[:, None])
        score, size = np.where(better, now, score), np.where(better, j + 1, size)
    at, rows = score.argmax(axis=1), np.arange(len(n))
    return score[rows, at], starts[at], starts[at] + size[rows, at]


def _long_windows(needle: str, text: str, first: int, last: int) -> tuple[float, int, int]:
    """As ``_some_windows``, for one needle of any length."""
    at, full, n, best = _places(needle), (1 << len(needle)) - 1, len(needle), (-1.0, first, first)
    for i in range(first, min(last + 1, len(text))):
        row, own = full, (-1.0, i, i)
        for j in range(min(n, len(text) - i)):
            used = row & at.get(text[i + j], 0)
            row = (row + used) & full | (row - used)
            now = 200.0 * (n - row.bit_count()) / (n + j + 1)
            own = (now, i, i + j + 1) if now >= own[0] else own
        best = own if own[0] > best[0] else best
    return best


def best_windows(pairs: Sequence[tuple[str, str]], first: int = 0, last: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, start, end) for pairs (needle, text) that aren't empty; a score of -1 where a text has no such start."""
    out = np.full(len(pairs), -1.0), np.zeros(len(pairs), "i8"), np.zeros(len(pairs), "i8")
    able = [i for i, (_, text) in enumerate(pairs) if len(text) > first]
    for some in _pieces([pairs[i] for i in able]):
        at = [able[i] for i in some]
        needles, texts = zip(*[pairs[i] for i in at], strict=True)
        found = _long_windows(needles[0], texts[0], first, last) if len(needles[0]) > WORD else _some_windows(needles, texts, first, last)
        for own, new in zip(out, found, strict=True):
            own[at] = new
    return out


_WINDOW = "struct<score: double, dest_start: int, dest_end: int>"


def _windows(needle: pa.Array, text: pa.Array, least: pa.Array, within: int) -> pa.Array:
    """Null where a text is, or where no window within the first starts has at least ``least``; repeated pairs are looked at once."""
    pairs = {}
    each = [None if None in x else pairs.setdefault(x, len(pairs)) for x in zip(needle.to_pylist(), text.to_pylist(), least.to_pylist(), strict=True)]
    known = list(pairs)
    score, start, end = best_windows([x[:2] for x in known], 0, within)
    more = np.flatnonzero(score >= np.array([x[2] for x in known], "f8"))
    rest = best_windows([known[i][:2] for i in more], within + 1)
    later = rest[0] > score[more]  # of equal scores the leftmost
    for own, new in zip((score, start, end), rest, strict=True):
        own[more[later]] = new[later]
    told = set(more.tolist())
    found = [None if i is None or i not in told else {"score": score[i], "dest_start": start[i], "dest_end": end[i]} for i in each]
    return pa.array(found, pa.struct([("score", pa.float64()), ("dest_start", pa.int32()), ("dest_end", pa.int32())]))


def aligned(needle: Column, text: Column, at_least: Column | float | None = None, within: int = 2) -> Column:
    """struct(score, dest_start, dest_end): the window of ``text``, at most as long as ``needle``, with the largest indel ratio; the
    leftmost at a tie, and of equal starts the longest. With ``at_least``, null unless a window that starts within
    the first ``within`` + 1 characters reaches that score, and the others are looked at only then.

    Two empty texts score 100, one empty text 0. Where the text has the needle as it is, that is the window; else an Arrow function
    looks at the windows of a whole batch at once, a bit for each character of the needle. It can't stand within a lambda.
    """
    n = F.length(needle)
    least = at_least if isinstance(at_least, Column) else F.lit(-1.0 if at_least is None else at_least)
    search = F.arrow_udf(lambda a, b, c: _windows(a, b, c, within), _WINDOW)
    struct = lambda score, start, end: F.struct(score.alias("score"), start.cast("int").alias("dest_start"), end.cast("int").alias("dest_end"))
    empty = (n == 0) | (F.length(text) == 0)
    at = F.position(needle, text)
    whole = (at > 0) if at_least is None else ((at > 0) & (at <= within + 1) & (least <= 100))
    found = search(F.when(~empty & ~whole, needle), text, least.cast("double"))
    return F.when(empty, struct(F.when((n == 0) & (F.length(text) == 0), 100.0).otherwise(0.0), F.lit(0), F.lit(0))).when(whole, struct(F.lit(100.0), at - 1, at - 1 + n)).otherwise(found)


def partial_ratio(a: Column, b: Column) -> Column:
    """The largest indel ratio of the shorter text with a window of the other, of 100."""
    first = F.length(a) <= F.length(b)
    return aligned(F.when(first, a).otherwise(b), F.when(first, b).otherwise(a))["score"]


def near_any(texts: Column, known: Sequence[str], ratio: int, part: float) -> Column:
    """``texts``: array of struct(sure, low). For each whether it is sure, or the indel ratio of low with one of ``known`` is ``ratio`` at
    least (in millionths of 100), or that of the shorter of the two with a part of the other ``part`` (85 or more). An Arrow
    function: a batch's distinct pairs are looked at once. It can't stand within a lambda, nor be given one that names another's variable."""
    letters = {y: frozenset(y) for y in known}

    def able(x: str, y: str) -> bool:
        # a part that fits shares nearly all its letters, which is cheap to see
        least, own = 85 * min(len(x), len(y)), set(x)
        return 100 * sum(map(letters[y].__contains__, x)) >= least and 100 * sum(map(own.__contains__, y)) >= least

    def batch(lists: pa.Array) -> pa.Array:
        rows = lists.to_pylist()
        distinct = dict.fromkeys(x["low"] for row in rows for x in row or () if not x["sure"] and x["low"])
        both = [(x, y) for x in distinct for y in known if able(x, y)]
        pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in both]
        near = best_windows(pairs)[0] >= part
        rest = [i for i in np.flatnonzero(~near) if 200_000_000 * len(pairs[i][0]) >= ratio * sum(map(len, pairs[i]))]
        total = np.array([sum(map(len, pairs[i])) for i in rest], "i8")
        near[rest] = 200_000_000 * lcs_lengths([pairs[i] for i in rest]) >= ratio * total
        fits = {x for (x, _), n in zip(both, near.tolist(), strict=True) if n}
        return pa.array([None if row is None else [x["sure"] or x["low"] in fits for x in row] for row in rows], pa.list_(pa.bool_()))

    return F.arrow_udf(batch, "array<boolean>")(texts)
