"""Text normalisation as column functions; op chains are folds over names of ``NORMALIZERS``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix tokens in match order, their canonical forms, legal forms, confusable glyphs, free mail hosts.
SUFFIX_TOKENS = ("privatelimited", "private", "limited", "pvtltd", "pvt", "ltd", "llp", "opc", "plc", "company", "corporation", "corp", "incorporated", "enterprises", "enterprise", "industries")
SUFFIX_FORMS = {"pvt": "PVT", "pvtltd": "PVT LTD", "ltd": "LTD", "limited": "LIMITED", "private": "PRIVATE", "privatelimited": "PRIVATE LIMITED", "llp": "LLP", "opc": "OPC", "plc": "PLC", "company": "COMPANY", "co": "CO", "corporation": "CORPORATION", "corp": "CORP", "incorporated": "INCORPORATED", "inc": "INC", "enterprises": "ENTERPRISES", "enterprise": "ENTERPRISE", "industries": "INDUSTRIES", "udyog": "UDYOG"}
LEGAL_FORMS = (
    "private limited company", "public limited company", "one person company", "limited liability partnership", "private limited", "public limited",
    "partnership firm", "sole proprietorship", "proprietorship firm", "proprietorship", "partnership", "hindu undivided family", "co operative society",
    "cooperative society", "trust", "society", "government", "limited",
)
DIGITS_AS_LETTERS = ("015826", "OISBZG")
FREE_MAIL = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "yahoo.in", "hotmail.com", "outlook.com", "live.com", "msn.com", "rediffmail.com", "rediff.com", "sify.com",
    "vsnl.net", "vsnl.com", "bsnl.in", "airtelmail.in", "icloud.com", "me.com", "aol.com", "protonmail.com", "proton.me", "zoho.com", "yandex.com", "mail.com",
)
MIN_STEM = 4


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def remove_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def strip_country_code(c: Column) -> Column:
    """A leading 91 or +91 goes only before a ten-digit mobile number."""
    return F.regexp_replace(c, r"^(?:\+?91)[\s\-]?(?=[6-9][0-9]{9}\z)", "")


def fix_ifsc_confusions(c: Column) -> Column:
    """Eleven characters: letters in the first four places, 0 in the fifth."""
    up = F.upper(c)
    return F.when(F.length(c) == 11, F.concat(F.translate(F.substring(up, 1, 4), *DIGITS_AS_LETTERS), F.lit("0"), F.substring(up, 6, 6))).otherwise(c)


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def split_corporate_suffix(c: Column) -> Column:
    """Spaced names get their trailing suffixes in canonical form; a glued name loses suffixes from its end, in
    the tokens' order, while at least ``MIN_STEM`` characters stay."""
    parts = F.split(strip(c), r"\s+")
    known = [F.lit(k) for k in SUFFIX_FORMS]
    last = F.coalesce(F.array_max(F.transform(parts, lambda w, i: F.when(~F.lower(w).isin(*known), i + 1).otherwise(0))), F.lit(0))
    spaced = F.array_join(F.concat(F.slice(parts, F.lit(1), last), F.transform(F.slice(parts, last + 1, F.size(parts)), lambda w: _lookup(F.lower(w), SUFFIX_FORMS))), " ")
    tokens = F.array(*[F.lit(t) for t in SUFFIX_TOKENS])

    def peel(s: Column, _: Column) -> Column:
        tail = s["tail"]
        found = F.get(F.filter(tokens, lambda t: F.lower(tail).endswith(t) & (F.length(tail) - F.length(t) >= MIN_STEM)), 0)
        fits = found.isNotNull() & (F.length(tail) > MIN_STEM)
        stem = F.substring(tail, F.lit(1), F.length(tail) - F.length(found))
        return F.when(fits, F.struct(stem.alias("tail"), F.concat(F.array(_lookup(found, SUFFIX_FORMS)), s["forms"]).alias("forms"))).otherwise(s)

    start = F.struct(c.alias("tail"), F.array().cast("array<string>").alias("forms"))
    glued = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, peel, lambda s: F.array_join(F.concat(F.array(s["tail"]), s["forms"]), " "))
    return F.when(strip(c) == "", c).when(strip(c).contains(" "), spaced).otherwise(glued)


def expand_known_phrase(c: Column) -> Column:
    return F.coalesce(_lookup(F.lower(remove_spaces(c)), {p.replace(" ", ""): p for p in LEGAL_FORMS}), c)


NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "strip": strip, "collapse_spaces": collapse_spaces, "remove_spaces": remove_spaces, "uppercase": F.upper, "lowercase": F.lower, "titlecase": F.initcap,
    "digits_only": digits_only, "strip_country_code": strip_country_code, "fix_ifsc_confusions": fix_ifsc_confusions,
    "split_corporate_suffix": split_corporate_suffix, "expand_known_phrase": expand_known_phrase,
}


def normalize(c: Column, ops: Sequence[str]) -> Column:
    """The ops in order; null becomes the empty string; an unknown name raises KeyError."""
    return reduce(lambda v, op: NORMALIZERS[op](v), ops, F.coalesce(c, F.lit("")))


def clean_label(c: Column) -> Column:
    edge = r"[\s\-:.|*]+"
    return F.lower(collapse_spaces(F.regexp_replace(c, rf"^{edge}|{edge}$", "")))


def strip_value_prefix(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"^[\s:\-–—=|.,)#]+", ""))


def canonicalize(c: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """aliases: (canonical, regex), the first that is found wins."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(v)) for v, p in aliases], c)


def email_domain(c: Column, free: Sequence[str] = FREE_MAIL) -> Column:
    """``www.`` and what follows an address's first @; null for free mail hosts and hosts without a dot."""
    host = F.lower(F.btrim(strip(F.regexp_extract(c, r"(?s)@(.*)\z", 1)), F.lit(".")))
    return F.when(host.contains(".") & ~host.isin(*free), F.concat(F.lit("www."), host))


def squash_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def titlecase_city(c: Column) -> Column:
    return F.when(((c == F.upper(c)) | (c == F.lower(c))) & (F.upper(c) != F.lower(c)), F.initcap(c)).otherwise(c)


def segments(c: Column, lines: bool = True) -> Column:
    """Comma (and line) separated parts, trimmed, without empty ones."""
    flat = F.translate(c, "\n\r", ",,") if lines else c
    return F.filter(F.transform(F.split(flat, ","), strip), lambda s: s != "")


def first_word(c: Column) -> Column:
    return F.lower(F.element_at(F.split(strip(c), r"\s+"), 1))


def address_key(c: Column) -> Column:
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*,\s*", ", ")
    return F.lower(F.regexp_replace(F.regexp_replace(spaced, r"\s+", " "), r"^[ ,]+|[ ,]+$", ""))


def field_key(c: Column, exact: bool) -> Column:
    """How evaluation compares a field: exact ones upper-cased without spaces, others without punctuation."""
    bare = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\.0$", "")
    return F.upper(remove_spaces(bare)) if exact else F.lower(collapse_spaces(F.regexp_replace(bare, r"[^\p{L}\p{N}\s]", " ")))


def verification_key(c: Column) -> Column:
    bare = strip(F.coalesce(c, F.lit("")))
    return F.lower(F.when(bare.rlike(r"^[0-9]+\.0$"), F.regexp_replace(bare, r"\.0$", "")).otherwise(bare))


def bounded_matches(c: Column, pattern: str) -> Column:
    """Matches that don't lie within a longer run of letters and digits."""
    return F.regexp_extract_all(c, F.lit(rf"(?<![A-Za-z0-9])(?:{pattern})(?![A-Za-z0-9])"), F.lit(0))


def bounded_or_glued_matches(c: Column, pattern: str, least: int = 5) -> Column:
    """As ``bounded_matches``; if there are none, matches anywhere that, spaces aside, are all letters and ``least`` long."""
    found = bounded_matches(c, pattern)
    return F.when(F.size(found) > 0, found).otherwise(_glued_matches(c, pattern, least))


def first_bounded_or_glued(c: Column, pattern: str, least: int = 5) -> Column:
    """The first of ``bounded_or_glued_matches``, null without any."""
    return F.coalesce(F.get(bounded_matches(c, pattern), F.lit(0)), F.get(_glued_matches(c, pattern, least), F.lit(0)))


def _glued_matches(c: Column, pattern: str, least: int) -> Column:
    bare = lambda m: F.replace(m, F.lit(" "), F.lit(""))
    every = F.regexp_extract_all(c, F.lit(f"(?:{pattern})"), F.lit(0))
    # one look at all matches first: the filter isn't compiled, and hardly any match is all letters
    able = F.array_join(every, "\0").rlike(r"(?:\A|\x00)[\p{L} ]+(?:\x00|\z)")
    return F.when(able, F.filter(every, lambda m: bare(m).rlike(r"\A\p{L}+\z") & (F.length(bare(m)) >= least))).otherwise(F.array().cast("array<string>"))


def full_match(c: Column, *patterns: str) -> Column:
    return reduce(Column.__or__, [c.rlike(rf"\A(?:{p})\z") for p in patterns]) if patterns else F.lit(True)


def fit_width(c: Column, width: int) -> Column:
    """At most ``width`` characters: cut at the last space inside, without trailing commas and semicolons."""
    head = F.substring(c, 1, width)
    cut = F.regexp_replace(head, r"\s+\S*$", "")
    whole_word = F.substring(c, width + 1, 1) == " "
    short = F.when(whole_word | (cut == ""), head).otherwise(cut)
    return F.when(F.length(c) <= width, c).otherwise(F.regexp_replace(short, r"[ ,;]+$", ""))
