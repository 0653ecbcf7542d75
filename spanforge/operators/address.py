"""Postal addresses: country, PIN, state and city peeled off; the rest classified, grouped and packed into lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.functions.places import CITIES, STATES, canonical_state, is_in, known_city
from spanforge.operators import segment as sg

# Names of the country, and words that are no city.
COUNTRY = ("india", "bharat", "in", "ind")
NO_CITY = (
    "india", "bharat", "in", "ind", "near", "opp", "opposite", "behind", "beside", "above", "below", "road", "street", "lane", "marg", "nagar", "colony", "sector", "block",
    "floor", "plot", "no", "gala", "unit", "phase", "part",
)


def drop_country(segs: Column) -> Column:
    """Without the country's names at the end, however often."""
    last = F.array_max(F.transform(segs, lambda s, i: F.when(~is_in(F.lower(s), COUNTRY), i + 1).otherwise(0)))
    return F.slice(segs, F.lit(1), F.coalesce(last, F.lit(0)))


def strip_pin(segs: Column, taxonomy: sg.Taxonomy = sg.BUILT_IN) -> tuple[Column, Column]:
    """(segments, PIN): the first six digits that no other digit is next to leave a space in their segment, whose rest stays.
    Digits right behind a word for premises ("Shop 123456", "Plot No. 123456") are their number and no PIN."""
    numbered = "|".join(re.escape(w) for t in taxonomy.tiers if t.name == "premises" for w in t.head)
    numbered = rf"(?<!(?i:\b(?:{numbered})[\s.:#-]{{0,3}}(?:no\b[\s.:#-]{{0,3}})?))" if numbered else ""
    bounded = rf"(?<![0-9]){numbered}([1-9][0-9]{{5}})(?![0-9])"
    at = F.array_min(F.transform(segs, lambda s, i: F.when(s.rlike(bounded), i)))
    pin = F.coalesce(F.regexp_extract(F.get(segs, at), bounded, 1), F.lit(""))
    rest = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, bounded, " "), r"\s+", " "), r"^[\s\-–:.]+|[\s\-–:.]+$", "")
    return F.filter(F.transform(segs, lambda s, i: F.when(i == at, rest(s)).otherwise(s)), lambda s: s != ""), pin


def _step(df: DataFrame, **new: Column) -> DataFrame:
    """``df`` with new columns, each worked out once: they come out of a generator, as the optimizer would merge plain
    projections and repeat a step's expressions wherever a later one uses them."""
    out = df.withColumn("_x", F.explode(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))
    return out.select(*[c for c in df.columns if c not in new], "_x.*")


def _last(c: Column, test) -> Column:
    """The place of the last element that passes."""
    return F.array_max(F.transform(c, lambda x, i: F.when(test(x), i)))


def match_state(rows: DataFrame, segs: str, state: str, states: dict[str, str] = STATES) -> DataFrame:
    """``rows`` whose ``segs`` lose the last segment that names a state, else the last two neighbours that do together; the
    canonical name is in ``state``."""
    one = F.transform(segs, lambda s: canonical_state(s, states))
    out = _step(rows, _one=one)
    two = F.transform(segs, lambda s, i: canonical_state(F.concat(s, F.lit(" "), F.get(F.col(segs), i + 1)), states))
    out = _step(out, _at=_last(F.col("_one"), lambda s: s.isNotNull()), _two=F.when(~F.exists("_one", lambda s: s.isNotNull()), two))
    pair = _last(F.col("_two"), lambda s: s.isNotNull())
    out = _step(out, _pair=pair)
    at, pair = F.col("_at"), F.col("_pair")
    rest = F.filter(segs, lambda s, i: F.when(at.isNotNull(), i != at).when(pair.isNotNull(), (i != pair) & (i != pair + 1)).otherwise(True))
    return _step(out, **{state: F.coalesce(F.get("_one", at), F.get("_two", pair), F.lit("")), segs: rest}).drop("_one", "_two", "_at", "_pair")


def place_like(text: Column, taxonomy: sg.Taxonomy = sg.BUILT_IN) -> Column:
    """Whether a text can be a place: a locality or village by its words, or of no known kind; no premises, building or road."""
    return sg.classify(text, taxonomy)["tier"].isin("locality", "village", "unknown")


def city_prefix(segment: Column, cities: Sequence[str] = CITIES, taxonomy: sg.Taxonomy = sg.BUILT_IN) -> Column:
    """struct(city, rest) of a segment of a known city's name, of three words at most, and a place's; else null."""
    words = F.split(F.trim(segment), r"\s+")
    cuts = []
    for n in (3, 2, 1):  # the longest first
        head, rest = F.array_join(F.slice(words, 1, n), " "), F.array_join(F.slice(words, F.lit(n + 1), F.greatest(F.size(words) - n, F.lit(0))), " ")
        cuts.append(F.when((F.size(words) > n) & known_city(head, cities) & place_like(rest, taxonomy), F.struct(head.alias("city"), rest.alias("rest"))))
    return F.coalesce(*cuts)


def pick_city(rows: DataFrame, segs: str, cities: Sequence[str] = CITIES) -> DataFrame:
    """``rows`` (segs, pin, state, _district) with ``city`` and ``_inferred``; by the first of these that applies, segments
    from the end:

    a known city other than the PIN's district; a known city; a segment that is the district; the district itself
    (inferred); a known city's name before a place's in one segment; a state that is a city (inferred); with a
    state or PIN, the last segment, unless a word of it rules that out or it is premises, a building or a road. The
    city's segment goes, and repeats of it or of the district at the end; others stay.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[ .]", "")
    all_ = F.col(segs)
    looked = F.transform(all_, lambda s: F.struct(known_city(s, cities).alias("city"), bare(s).alias("bare")))
    out = _step(rows, _look=looked, _own=bare(F.col("_district")))
    own, look = F.col("_own"), F.col("_look")
    of_district = lambda x: (own != "") & (x["bare"] == own)
    out = _step(out, _at=F.coalesce(_last(look, lambda x: x["city"] & ~of_district(x)), _last(look, lambda x: x["city"]), _last(look, of_district)))
    named, district = F.col("_at").isNotNull(), F.col("_own") != ""
    prefixes = F.filter(F.transform(all_, lambda s, i: F.struct(i.alias("i"), city_prefix(s, cities).alias("p"))), lambda x: x["p"].isNotNull())
    out = _step(out, _split=F.when(~named & ~district, F.element_at(F.when(F.size(prefixes) > 0, prefixes), -1)))
    of_state = ~named & ~district & F.col("_split").isNull() & (F.col("state") != "") & known_city(F.col("state"), cities)
    out = _step(out, _of_state=of_state)
    end = F.get(all_, F.size(all_) - 1)
    fits = ~F.arrays_overlap(F.split(F.lower(end), r"\s+"), F.array(*[F.lit(w) for w in NO_CITY])) & ~end.rlike(r"\A[0-9]+\z") & place_like(end)
    open_ = ~named & ~district & F.col("_split").isNull() & ~F.col("_of_state") & ((F.col("state") != "") | (F.col("pin") != "")) & (F.size(all_) > 0)
    out = _step(out, _at=F.when(open_ & F.coalesce(fits, F.lit(False)), F.size(all_) - 1).otherwise(F.col("_at")))
    at = F.col("_at")
    token = F.get(look, at)["bare"]
    others = F.filter(look, lambda x, i: i != at)
    stays = F.coalesce(F.array_max(F.transform(others, lambda x, i: F.when((x["bare"] != token) & ~of_district(x), i + 1))), F.lit(0))
    rest = F.slice(F.filter(all_, lambda s, i: i != at), F.lit(1), stays)
    split = F.col("_split")
    left = F.when(at.isNotNull(), rest).when(split.isNotNull(), F.transform(all_, lambda s, i: F.when(i == split["i"], split["p"]["rest"]).otherwise(s))).otherwise(all_)
    city = F.when(at.isNotNull(), F.get(all_, at)).when(F.col("_own") != "", F.col("_district")).when(split.isNotNull(), split["p"]["city"]).when(F.col("_of_state"), F.col("state"))
    inferred = at.isNull() & ((F.col("_own") != "") | F.col("_of_state"))
    return _step(out, **{"city": F.coalesce(tx.titlecase_city(city), F.lit("")), "_inferred": inferred, segs: left}).drop("_look", "_own", "_at", "_split", "_of_state")


def resolve_address(rows: DataFrame, address: str, states: dict[str, str] = STATES, cities: Sequence[str] = CITIES, pins: DataFrame | None = None) -> DataFrame:
    """``rows`` with rest (segments), city, state, pin and confidence.

    pins: (pin, state, district), the PIN directory: it gives a missing state, and the city where the text has none.
    Low where the text's state isn't the PIN's, or little is found; high with a PIN, a state and a city that the
    text names; medium with two of the three.
    """
    out = _step(rows, _s=drop_country(tx.segments(F.col(address))))
    segs, pin = strip_pin(F.col("_s"))
    out = _step(out, pin=pin, _s=segs)
    out = _step(out, _s=drop_country(F.col("_s")))
    if pins is None:
        out = out.withColumns({"_pin_state": F.lit(""), "_district": F.lit("")})
    else:
        known = pins.select(F.col("pin").alias("_pin"), F.coalesce("state", F.lit("")).alias("_pin_state"), F.coalesce("district", F.lit("")).alias("_district"))
        out = out.join(known, F.col("pin") == F.col("_pin"), "left").drop("_pin").fillna("", ["_pin_state", "_district"])
    out = match_state(out, "_s", "_named", states)
    of_pin = F.coalesce(canonical_state(F.col("_pin_state"), states), F.col("_pin_state")) if pins is not None else F.lit("")
    out = _step(out, _pin_state=of_pin)
    of_pin = F.col("_pin_state")
    out = out.withColumn("state", F.when(F.col("_named") != "", F.col("_named")).otherwise(of_pin))
    out = pick_city(out, "_s", cities).withColumnRenamed("_s", "rest")
    conflict = (F.col("_named") != "") & (of_pin != "") & (F.col("_named") != of_pin)
    found = (F.col("pin") != "").cast("int") + (F.col("state") != "").cast("int") + (F.col("city") != "").cast("int")
    level = F.when(conflict, "low").when((found == 3) & ~F.col("_inferred"), "high").when(found >= 2, "medium").otherwise("low")
    return out.withColumn("confidence", level).drop("_pin_state", "_district", "_named", "_inferred")


def segment_lines(rows: DataFrame, address: str, key: str = "k", cap: int = 4, taxonomy: sg.Taxonomy = sg.BUILT_IN, pins: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(key, lines, n_groups, confidence, city, state, pin, *keep): an address resolved, its rest split into lines.

    One pass: addresses are spread by the key at once, as a small file of them is one task's whole input and much is worked out for each; what was
    resolved travels with the fragments, which that key groups too. Only addresses that may hold glued words pass through Python.
    """
    more = ["city", "state", "pin", *keep]
    spread = _step(rows.select(key, address, *[c for c in keep if c != address]).repartition(key), _glued=sg.can_be_glued(F.col(address), taxonomy))
    plain, other = (resolve_address(spread.where(test), address, pins=pins).select(key, "rest", F.struct(*more).alias("_more")) for test in ("not _glued", "_glued"))
    found = plain.unionByName(other.withColumn("rest", sg.deglued(F.col("rest"), taxonomy)))
    frags = sg.classify_fragments(sg.fragments(found, "rest", [key, "_more"], taxonomy), taxonomy)
    grouped = sg.tail_split(sg.gap_groups(sg.trusted(frags, key), key), key, locality_level=taxonomy.locality_level)
    return sg.pack_lines(grouped, key, cap=cap, more="_more").select(key, "lines", "n_groups", "confidence", *[F.col(f"_more.{c}").alias(c) for c in more])


def trailing_location(rows: DataFrame, address: str, key: str = "k", pins: DataFrame | None = None) -> DataFrame:
    """(key, rest, city, state, pin): a combined address in one line."""
    return resolve_address(rows, address, pins=pins).select(key, F.array_join("rest", ", ").alias("rest"), "city", "state", "pin")
