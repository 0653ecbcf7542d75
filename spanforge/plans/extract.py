"""The whole dataflow: spans of document sets -> candidates -> resolved, validated fields, review rows and records."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as tx
from spanforge.operators import address as ad
from spanforge.operators import layout as lo
from spanforge.operators import match as ma
from spanforge.operators import onboarding as ob
from spanforge.operators import records as rc
from spanforge.operators import resolve as rs
from spanforge.operators import validate as va
from spanforge.operators.evaluate import with_row_number
from spanforge.session import by_merge, few_or_merged, settled
from spanforge.sources import files as fl

PAGE = ["set_id", "doc", "page"]
SPAN = [*PAGE, "ord"]
BOX = ["x1", "y1", "x2", "y2"]
# Fixed values, in millionths: scores of what is derived, resolved from an address, or configured; what a trusted PIN has.
DERIVED, RESOLVED, DEFAULT, SOLID = 400_000, 550_000, 1_000_000, 500_000
#: Parts that the rows of one key are dealt into: candidates that nothing puts in doubt have none, and would all be one task's.
PARTS = 64
#: Captions that a text is or begins with.
HITS = "array<struct<field: string, similarity: bigint, raw: string>>"
ADDRESS = ("address_1", "address_2", "address_3", "address_4", "city", "state", "pin_code")


def _by_field(specs: Sequence[ma.FieldSpec], value: Callable[[ma.FieldSpec], Column | None], otherwise: Column) -> Column:
    """``value`` of the row's field."""
    cases = [(s, value(s)) for s in specs]
    return F.coalesce(*[F.when(F.col("field") == s.key, v) for s, v in cases if v is not None], otherwise)


def _no(c: Column | None = None) -> Column:
    return F.lit(False) if c is None else F.coalesce(c, F.lit(False))


def _by_names(profiles: Sequence[tuple[str, str, str]]) -> bool:
    return all(where != "content" for _, where, _ in profiles)


def typed_spans(spans: DataFrame, profiles: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``spans`` with each document's ``doc_type``, told by its first pages, if a profile asks for what they say, and, if there is a
    ``name``, by that."""
    name = F.max("name" if "name" in spans.columns else F.lit(""))
    if _by_names(profiles):
        # a window's pass, as the texts needn't be gathered and joined to each span, in the order of pages that ``banded`` asks for next
        w = Window.partitionBy("set_id", "doc").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        told = ma.classify(spans.withColumn("name", name.over(w)), profiles, key=spans.columns)
        return told.select(*spans.columns, "doc_type")
    names = spans.groupBy("set_id", "doc").agg(name.alias("name"))
    kinds = ma.classify(lo.first_pages_text(spans).join(by_merge(names), ["set_id", "doc"]), profiles, key=["set_id", "doc"])
    return spans.join(by_merge(kinds.select("set_id", "doc", "doc_type")), ["set_id", "doc"])


def _far(specs: Sequence[ma.FieldSpec]) -> float:
    return max((s.max_distance for s in specs), default=0.0)


def banded(base: DataFrame, specs: Sequence[ma.FieldSpec]) -> DataFrame:
    """``base(*SPAN, *BOX, hits, ..)`` with what ``beside`` asks of each page."""
    return lo.with_bands(base, PAGE, _far(specs), F.size("hits") > 0)


def adjacent(base: DataFrame, hits: DataFrame, specs: Sequence[ma.FieldSpec]) -> DataFrame:
    """``beside`` for hits (*SPAN, field, similarity, ..) that are a table of their own."""
    own = hits.groupBy(*SPAN).agg(F.collect_list(F.struct("field", "similarity")).alias("hits"))
    return beside(settled(banded(base.join(by_merge(own), SPAN, "left"), specs)), specs)


def beside(base: DataFrame, specs: Sequence[ma.FieldSpec]) -> DataFrame:
    """(*SPAN, field, raw, similarity, proximity, direction, same_line, doc_type, conf): what lies beside a caption.

    base: ``banded``, hits: array of struct(field, similarity, ..) of the captions. Spans that look like captions are no values. A value
    of a text field goes on over its row and wrapped rows; a repeated caption at its start goes.
    """
    far = _far(specs)
    sides = tuple(dict.fromkeys(d for s in specs for d in s.directions))
    # what is needed of both sides goes with the pair, so that nothing is joined to it again
    near = lo.neighbours(base.where("size(hits) > 0"), base.where("not caption"), PAGE, far, sides, band="tall", keep=("hits",), carry=("text", "doc_type", "conf"))
    rows = near.withColumnRenamed("other", "ord").select(*SPAN, tx.strip(F.col("text")).alias("t"), "doc_type", "conf", "direction", "distance_ratio", "same_line", F.explode("hits").alias("h")).select("*", "h.field", "h.similarity").drop("h")
    within = _by_field(specs, lambda s: F.col("direction").isin(*s.directions) & (F.col("distance_ratio") * far <= s.max_distance), F.lit(False))
    closeness = _by_field(specs, lambda s: F.greatest(F.lit(0.0), 1 - F.col("distance_ratio") * far / s.max_distance), F.lit(0.0))
    # a table, as the wrapped values would work the neighbours out twice more
    rows = settled(rows.where(within).withColumn("proximity", F.floor(closeness * 1_000_000 + 0.0001).cast("long")).drop("distance_ratio"))
    is_free = F.col("field").isin(*[s.key for s in specs if not s.patterns and s.value_type == "text"])
    free = rows.where(is_free)
    joined = ma.wrapped_values(base, free, PAGE)
    free = settled(free.join(by_merge(joined), SPAN, "left").withColumn("t", F.coalesce(tx.strip(F.col("value")), "t")).drop("value"))
    rows = rows.where(~is_free).unionByName(free)
    bare = ma.own_labels(rows.select("field", "t").distinct(), specs)
    rows = rows.withColumn("raw", F.col("t")) if bare is None else rows.join(bare, ["field", "t"], "left").withColumn("raw", F.coalesce("bare", "t"))
    return rows.select(*SPAN, "field", "raw", "similarity", "proximity", "direction", "same_line", "doc_type", "conf")


def told_texts(spans: DataFrame, specs: Sequence[ma.FieldSpec]) -> DataFrame | None:
    """(text, caption, hits): the texts of ``spans`` that look like a caption of any field, or are one or begin with one (hits: array of
    struct(field, similarity, raw)). For a join on its other side; None if there are none."""
    texts = spans.select("text").distinct().select("text", tx.strip(F.col("text")).alias("t"), tx.clean_label(F.col("text")).alias("key"))
    texts = settled(texts.withColumn("bare_key", F.when(F.col("t") == F.col("text"), F.col("key")).otherwise(tx.clean_label(F.col("t")))))
    like = few_or_merged(ma.label_like(texts, specs, repeated=False))
    hits = few_or_merged(ma.text_hits(texts.select("t", F.col("bare_key").alias("key")).where("t <> ''"), specs).groupBy("t").agg(F.collect_list(F.struct("field", "similarity", "raw")).alias("hits")))
    told = texts.withColumn("caption", F.lit(None).cast("boolean")) if like is None else texts.join(like.withColumn("caption", F.lit(True)), "key", "left")
    told = told.withColumn("hits", F.lit(None).cast(HITS)) if hits is None else told.join(hits, "t", "left")
    return few_or_merged(told.where("caption OR hits IS NOT NULL").select("text", _no(F.col("caption")).alias("caption"), "hits"))


def candidates(spans: DataFrame, specs: Sequence[ma.FieldSpec]) -> DataFrame:
    """(set_id, field, doc, doc_type, seq, value, score, kind, direction, page): inline, adjacent and pattern-only.

    spans: (*SPAN, doc_type, text, x1, y1, x2, y2, confidence).
    """
    rows = spans.select(*SPAN, "doc_type", "text", *BOX, F.floor(F.coalesce("confidence", F.lit(1.0)) * 1_000_000 + 0.0001).cast("long").alias("conf"))
    told = told_texts(spans, specs)
    none = F.lit(0).cast("long")
    rows = rows.withColumns({"caption": F.lit(False), "hits": F.lit(None).cast(HITS)}) if told is None else rows.join(told, "text", "left").withColumn("caption", _no(F.col("caption")))
    base = settled(banded(rows, specs))
    whole = base.dropna(subset=SPAN)
    meta = [*SPAN, "doc_type", "conf"]
    inline = whole.where("size(hits) > 0").select(*meta, F.inline("hits")).where("raw <> ''")
    inline = inline.withColumns({"proximity": F.lit(1_000_000).cast("long"), "kind": F.lit("inline"), "direction": F.lit("inline"), "same_line": F.lit(True)})
    bare = ma.pattern_hits(whole, specs, [*meta, "hits"]).where(~_no(F.array_contains("hits.field", F.col("field")))).drop("hits").withColumnRenamed("value", "raw")
    bare = bare.withColumns({"similarity": none, "proximity": none, "kind": F.lit("pattern_only"), "direction": F.lit(""), "same_line": F.lit(False)})
    near = beside(base, specs).withColumn("kind", F.lit("adjacent"))
    rows = inline.unionByName(bare).unionByName(near)

    rows = ma.derived_values(rows, specs)
    patterned = F.col("field").isin(*[s.key for s in specs if s.patterns])
    rows = ma.without_excluded(rows.where((F.col("value") != "") & (F.col("matched") | ~patterned)), specs)
    # in doubt is what lies beside captions of fields without patterns: other fields have their match, or are out
    like = few_or_merged(ma.label_like(near.where(~patterned).select(tx.clean_label(F.col("raw")).alias("key")), specs))
    if like is None:
        rows = rows.withColumn("_like", F.lit(False))
    else:
        rows = rows.withColumn("key", F.when((F.col("kind") != "inline") & ~F.col("matched"), tx.clean_label(F.col("raw"))))
        rows = rows.withColumn("part", F.pmod(F.xxhash64(*SPAN), F.lit(PARTS)).cast("int"))
        rows = rows.join(like.withColumn("_like", F.lit(True)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["key", "part"], "left")
    expected = _by_field(specs, lambda s: F.col("doc_type").isin(*s.expected_documents) if s.expected_documents else None, F.lit(None).cast("boolean"))
    foreign = ma.foreign_field(F.col("value"), F.col("field"), specs).isNotNull()
    short = ~patterned & F.col("field").isin(*[s.key for s in specs if s.value_type == "text"]) & (F.length("value") < 3)
    total = ma.score(F.col("similarity"), F.col("proximity"), F.col("matched"), patterned, F.col("conf"), F.col("kind"), F.col("same_line"), expected, _no(F.col("_like")), foreign, short)
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(rs.KINDS)])
    # the order of arrival: document, page, span, kind
    seq = F.struct("doc", "page", "ord", kind.alias("k"), "value", "direction")
    # a generator gives the score, as the optimizer would repeat it wherever what follows names it
    return rows.select("set_id", "field", "doc", "doc_type", seq.alias("seq"), "value", F.inline(F.array(F.struct(total.alias("score")))), "kind", "direction", "page")


def _findings(results: DataFrame, specs: Sequence[ma.FieldSpec], rules: Sequence[va.Rule], pins: DataFrame | None) -> DataFrame:
    """(set_id, field, rule, severity, ok) over the sets' wide records, so that rules see the other fields."""
    wide = rs.canonical(results, [s.key for s in ma.by_priority(specs)])
    wide = va.with_pin_state(wide, pins) if pins is not None and "pin_code" in wide.columns else wide.withColumn("pin_state", F.lit(None).cast("string"))
    return va.findings(wide, ["set_id"], rules)


def combined_address(results: DataFrame, pins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, flags): an address printed on one line gives city, state and PIN where they are blank, and its lines.

    It counts as combined while one of the three is missing and it has a comma or a digit; a PIN found by its
    shape alone, or below half the score, is not trusted: it counts as missing, and is cleared if the address has none.
    """
    names = [F.col("field") == n for n in ADDRESS]
    pick = lambda c: [F.max(F.when(t, F.col(c))).alias(f"{n}.{c}".replace(".", "_")) for n, t in zip(ADDRESS, names, strict=True)]
    wide = results.where(F.col("field").isin(*ADDRESS)).groupBy("set_id").agg(*pick("value"), *pick("score"), *pick("kind"))
    has = lambda n: F.coalesce(F.trim(f"{n}_value"), F.lit("")) != ""
    solid = has("pin_code") & (F.coalesce("pin_code_kind", F.lit("")) != "pattern_only") & (F.col("pin_code_score") >= SOLID)
    blob = has("address_1") & ~(has("city") & has("state") & solid) & F.col("address_1_value").rlike("[,0-9]")
    wide = wide.withColumns({"has_pin": has("pin_code"), "solid": _no(solid), "has_city": has("city"), "has_state": has("state")}).where(blob)
    found = ad.segment_lines(wide.select("set_id", F.col("address_1_value").alias("a"), "has_pin", "solid", "has_city", "has_state"), "a", "set_id", pins=pins, keep=("a", "has_pin", "solid", "has_city", "has_state"))
    found = found.where((F.col("city") != "") | (F.col("state") != "") | (F.col("pin") != "") | (F.size("lines") > 1))
    line = lambda i: F.coalesce(F.get("lines", F.lit(i)), F.lit(""))
    new = {f"address_{i + 1}": F.when(line(i) != "", line(i)) for i in range(1, 4)}
    new |= {n: F.when(~F.col(f"has_{n}") & (F.col(n) != ""), F.col(n)) for n in ("city", "state")}
    new["pin_code"] = F.when(~F.col("has_pin") & (F.col("pin") != ""), F.col("pin"))
    trimmed = F.when((line(0) != "") & (line(0) != F.col("a")), line(0))
    cleared = F.when((F.col("pin") == "") & F.col("has_pin") & ~F.col("solid"), F.lit(""))
    entry = lambda n, v, how: F.when(v.isNotNull(), F.struct(F.lit(n).alias("field"), v.alias("new"), F.lit(how).alias("how")))
    every = [*[entry(n, v, "resolved") for n, v in new.items()], entry("address_1", trimmed, "trimmed"), entry("pin_code", cleared, "cleared")]
    changes = settled(found.select("set_id", F.explode(F.array_compact(F.array(*every))).alias("c")).select("set_id", "c.*"))
    rows = results.join(by_merge(changes), ["set_id", "field"], "left")
    filled = F.col("how").eqNullSafe("resolved")
    rows = rows.withColumns({
        "value": F.coalesce("new", "value"), "score": F.when(filled, F.greatest(F.coalesce("score", F.lit(0)), F.lit(RESOLVED))).otherwise(F.col("score")).cast("long"),
        "source": F.when(filled, "address_resolver").otherwise(F.col("source")),
    })
    flags = changes.where("how = 'resolved'").select("set_id", "field", F.lit("value_resolved_from_combined_address").alias("reason"), F.lit("warning").alias("severity"))
    return rows.drop("new", "how"), flags


def derived_values(results: DataFrame, specs: Sequence[ma.FieldSpec]) -> tuple[DataFrame, DataFrame]:
    """(results, flags): blank fields that are configured to follow from another field's e-mail address."""
    wanted = [(s.key, s.derive_from) for s in specs if s.derive_from]
    none = results.select("set_id", "field", F.lit("").alias("reason"), F.lit("").alias("severity")).where("false")
    if not wanted:
        return results, none
    made = reduce(DataFrame.unionByName, [results.where(F.col("field") == source).select("set_id", F.lit(key).alias("field"), tx.email_domain(F.col("value")).alias("new"), F.lit(f"derived_from_{source}").alias("from")) for key, source in wanted]).where("new is not null")
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    rows = results.join(by_merge(made), ["set_id", "field"], "left").withColumn("_use", blank & F.col("new").isNotNull())
    flags = rows.where("_use").select("set_id", "field", F.lit("value_derived_not_printed").alias("reason"), F.lit("warning").alias("severity"))
    rows = rows.withColumns({"value": F.when(F.col("_use"), F.col("new")).otherwise(F.col("value")), "score": F.when(F.col("_use"), DERIVED).otherwise(F.col("score")).cast("long"), "source": F.when(F.col("_use"), F.col("from")).otherwise(F.col("source"))})
    return rows.drop("new", "from", "_use"), flags


def pin_mismatches(results: DataFrame, found: DataFrame) -> DataFrame:
    """(set_id, field, reason, severity): a state that isn't the PIN's puts the PIN in doubt too."""
    sets = found.where("field = 'state' and rule = 'pin_matches_state' and not ok").select("set_id").distinct()
    pins = results.where((F.col("field") == "pin_code") & (F.coalesce(F.trim("value"), F.lit("")) != ""))
    return pins.join(by_merge(sets), "set_id", "left_semi").select("set_id", "field", F.lit("pin_state_mismatch").alias("reason"), F.lit("warning").alias("severity"))


def extract(
    spans: DataFrame, specs: Sequence[ma.FieldSpec], rules: Sequence[va.Rule], precedence: Sequence[str] = (),
    profiles: Sequence[tuple[str, str, str]] = (), pins: DataFrame | None = None, required: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, review, summary). results: (set_id, field, value, score, doc, page, kind, source, status, consistency, alternatives),
    a row for each set and field.

    spans: (set_id, doc, page, ord, text, x1, y1, x2, y2, confidence), with ``doc_type``, or without it to be
    classified by ``profiles``. Candidates of all documents of a set are pooled; junk goes unless a field has
    nothing else; a field's own rules bias the scores; one candidate wins; then come defaults, a combined
    address, derived values, validation, review and agreement across documents.
    """
    typed = spans if "doc_type" in spans.columns else typed_spans(spans, profiles)
    typed = typed if "doc_type" in spans.columns or _by_names(profiles) else settled(typed)
    found = candidates(typed, specs)
    junk = _by_field(specs, lambda s: F.lower(F.trim("value")).isin(*s.junk) if s.junk else None, F.lit(False))
    own = {s.key: [r for r in rules if r.field == s.key and not r.derived] for s in specs}
    failed = lambda severity: _by_field(specs, lambda s: reduce(Column.__or__, [~_no(r.check(F.col("value"))) for r in own[s.key] if r.severity == severity], F.lit(False)), F.lit(False))
    judged = F.col("field").isin(*[k for k, r in own.items() if r])
    # the rules judge a value by itself, so that the order of scores is known before junk goes
    found = rs.pooled(found.withColumn("score", va.bias(F.col("score"), failed("error"), failed("warning"), judged)))
    found = rs.drop_junk(found, junk) if any(s.junk for s in specs) else found
    agreeing = [s.key for s in specs if s.consistent]
    found = settled(found) if agreeing else found
    expected = _by_field(specs, lambda s: F.col("doc_type").isin(*s.expected_documents) if s.expected_documents else None, F.lit(False))
    won = rs.winners(found, expected, precedence, ["value", "score", "doc", "page", "kind"])
    least = _by_field(specs, lambda s: F.lit(int(s.min_accept * 1_000_000)), F.lit(0))
    trusted = found.where(F.col("field").isin(*agreeing) & (F.col("score") >= least) & ~junk)
    every = spans.select("set_id").distinct().withColumn("field", F.explode(F.array(*[F.lit(s.key) for s in specs])))
    results = every.join(by_merge(won), ["set_id", "field"], "left")
    default = _by_field(specs, lambda s: F.lit(s.default) if s.default else None, F.lit(None).cast("string"))
    empty = F.col("value").isNull() & default.isNotNull()
    results = results.withColumns({"source": F.when(empty, "config_default").when(F.col("value").isNotNull(), F.col("doc").cast("string")), "score": F.when(empty, DEFAULT).otherwise(F.col("score")).cast("long"), "value": F.when(empty, default).otherwise(F.col("value"))})
    flags = []
    if any(s.key == "address_1" for s in specs):
        results, more = combined_address(settled(results), pins)
        flags.append(more)
    results, more = derived_values(results, specs)
    results = settled(results)
    found = settled(_findings(results, specs, rules, pins))
    results = results.join(by_merge(va.status_by(found, ["set_id", "field"])), ["set_id", "field"], "left")
    swap = (F.col("status") == "invalid") & default.isNotNull()
    present = F.coalesce(F.trim("value"), F.lit("")) != ""
    # a refused value's score stays, but not where it was found, and it isn't judged by it
    results = results.withColumns({
        "value": F.when(swap, default).otherwise(F.col("value")), "source": F.when(swap, "config_default").otherwise(F.col("source")), "page": F.when(~swap, F.col("page")), "doc": F.when(~swap, F.col("doc")), "kind": F.when(~swap, F.col("kind")),
        "status": F.when(~present, "missing").when(swap, "valid").otherwise(F.coalesce("status", F.lit("not_validated"))), "swapped": F.coalesce(swap, F.lit(False)),
    })
    if agreeing:
        results = results.join(by_merge(rs.consistency(trusted).select("set_id", "field", "consistency")), ["set_id", "field"], "left")
    results = settled(results.withColumn("consistency", F.coalesce("consistency" if agreeing else F.lit(None), F.lit("not_checked"))))
    flagged = rs.review(results, [*required, *[s.key for s in specs if s.required]], F.when(F.col("swapped"), 0).otherwise(least))
    results = results.drop("swapped")
    for more in (*flags, more, pin_mismatches(results, found)):
        flagged = flagged.unionByName(more)
    return results, flagged, rs.summary(results, flagged)


def registration(results: DataFrame, flagged: DataFrame, specs: Sequence[ma.FieldSpec]) -> tuple[DataFrame, DataFrame]:
    """(records, flags): the registration form's record of each set, from ``extract``'s results.

    A name that is a leaked caption takes its best alternative that is none, which is flagged; invalid identifiers are blank. Flags: (set_id, fields_needing_review), the
    form's names of all flagged fields.
    """
    clean, leaked = rs.without_leaks(results, ["vendor_name"], [x for s in specs for x in s.labels])
    wide = rs.canonical(ob.valid_results(clean), [s.key for s in ma.by_priority(specs)])
    every = flagged.unionByName(leaked).withColumn("seq", F.struct(F.col("severity") != "error", "field", "reason"))
    return rc.onboarding(wide), ob.review_names(every)


def extract_files(
    spark: SparkSession, path: str, specs: Sequence[ma.FieldSpec], rules: Sequence[va.Rule], recognise: Callable[[DataFrame], DataFrame] | None = None, set_id: int = 0, **options,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(results, review, summary, unread): the files of a folder as one set, its documents by the order of their names. ValueError
    without a supported file; files that can't be read are in ``unread`` (path, reason), unsupported ones too. options: those of ``extract``."""
    good, other = fl.list_inputs(spark, path)
    if good.isEmpty():
        raise ValueError(f"no supported file in {path}")
    loaded = fl.load(good, recognise)
    documents = with_row_number(good.select("path").repartitionByRange("path").sortWithinPartitions("path"), "doc")
    named = documents.select(F.col("path").alias("doc_id"), F.col("doc").cast("int").alias("doc"), F.element_at(F.split("path", "/"), -1).alias("name"))
    spans = loaded.spans.join(named, "doc_id").select(F.lit(set_id).alias("set_id"), "doc", "name", "page", "ord", "text", *BOX, F.lit(1.0).alias("confidence"))
    unread = loaded.unread.unionByName(other.select("path", F.lit("unsupported").alias("reason")))
    return *extract(settled(spans), specs, rules, **options), unread
