"""Address lines: fragments classified by a taxonomy of words, glued words split, boundaries found, groups packed into lines.

Classification, boundaries and grouping are columns and windows; only splitting glued words is a search in Python, and
only rows that can hold such a word reach it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from spanforge.functions.places import is_in
from spanforge.functions.text import bind

# Fixed values, in hundredths: confidences of fragments, gap strengths, levels of confidence and the lines they allow.
WORD, PHRASE, MERGED, ORDINAL, NUMBERED, DESIGNATOR, DESIGNATED, CONFLICT, UNKNOWN = 100, 90, 75, 85, 80, 70, 80, 50, 55
STEP, LONG_STEP, BACK_NEAR, BACK, TIER_CHANGE, INJECTED, CUT, INJECTED_CONF = 50, 60, 20, 40, 20, 15, 50, 10
PREMISES_BAND, UNKNOWN_LEVEL, TAIL_RUN, LEAST_WORDS, DESIGNATORS = 2, 4, 4, 4, 4
LEVELS, LEVEL_FROM, LINE_CAP = ("low", "medium", "high"), (45, 70), (2, 3, 4)
# Fixed values of splitting: what a strong and a weak piece are worth, what a cut costs, the least gain; the lengths of runs and
# pieces, of keywords that count, and of words that can stand by themselves; levels up to this name components.
STRONG, WEAK, PER_CUT, MARGIN, UNLIKELY = 2.0, 0.8, 0.5, 0.75, -3.0
SHORTEST_RUN, LONGEST_RUN, LONGEST_PIECE, KEYWORD, PLAUSIBLE, FACILITY = 6, 40, 18, 4, 4, 3


@dataclass(frozen=True)
class Tier:
    """Words of one kind of fragment. lettered: its head words take a letter or a Roman number (BLOCK B)."""

    name: str
    level: int
    head: Sequence[str] = ()
    tail: Sequence[str] = ()
    phrases: Sequence[str] = ()
    lettered: bool = False


@dataclass(frozen=True)
class Taxonomy:
    """Tiers; the order in which they win a conflict (others come behind, by name); words between a head and its number."""

    tiers: Sequence[Tier]
    priority: Sequence[str] = ()
    connectors: Sequence[str] = ("no", "nos", "of", "at", "the", "and", "&")

    @cached_property
    def heads(self) -> frozenset[str]:
        return frozenset(w for t in self.tiers for w in t.head)

    @cached_property
    def tails(self) -> frozenset[str]:
        return frozenset(w for t in self.tiers for w in t.tail)

    @cached_property
    def ranked(self) -> list[Tier]:
        at = {n: i for i, n in enumerate(self.priority)}
        return sorted(self.tiers, key=lambda t: (at.get(t.name, len(at)), t.name))

    @property
    def locality_level(self) -> int:
        return next((t.level for t in self.tiers if t.name == "locality"), UNKNOWN_LEVEL)


BUILT_IN = Taxonomy(
    (
        Tier("premises", 1, head=("flat", "plot", "shop", "unit", "door", "room"), tail=("floor",)),
        Tier("structure", 1, head=("block", "wing", "phase", "part"), lettered=True),
        Tier("building", 2, tail=("tower", "heights", "complex", "building", "house")),
        Tier("estate", 2, tail=("park", "estate"), phrases=("industrial area", "udyog nagar")),
        Tier("road", 3, tail=("road", "street", "lane", "marg")),
        Tier("landmark", 3, head=("near", "opposite", "behind")),
        Tier("locality", 4, head=("sector", "pocket"), tail=("colony", "nagar", "layout")),
        Tier("village", 5, tail=("gram", "village"), phrases=("post office",)),
    ),
    priority=("premises", "structure", "estate", "building", "road", "locality", "village", "landmark"),
)


def bare_word(c: Column) -> Column:
    """A lookup key: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def _any_of(words: Sequence[str]) -> str:
    return "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w)))


def _glued_in(t: Tier) -> str | None:
    """A pattern of words that begin with the tier's head words or end in its tail words, but are none."""
    heads, tails = [w for w in t.head if len(w) >= KEYWORD], [w for w in t.tail if len(w) >= KEYWORD]
    parts = ([f"^(?:{_any_of(heads)})."] if heads else []) + ([f".(?:{_any_of(tails)})$"] if tails else [])
    return "|".join(parts) or None


def classify(text: Column, taxonomy: Taxonomy = BUILT_IN) -> Column:
    """struct(tier, level, conf) of a fragment, by its own text alone.

    The first word is a tier's head word or the last its tail word (100), or a phrase occurs (90). Else the first
    word of five letters and more that such a word is merged into (75). Else a shape: an ordinal (85), a number behind # or
    No (80), a designator such as B-12 (70), a tail word with a short designator (80). Else unknown, at the
    locality's level (55). Where several tiers fit, the first by priority wins with 50.
    """
    tiers = taxonomy.tiers
    result = lambda name, level, conf: F.struct(F.lit(name).alias("tier"), F.lit(level).cast("int").alias("level"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("int").alias("conf"))

    def decide(found: Column) -> Column:
        one = F.size(F.filter(found, lambda x: x > 0)) == 1
        conf = F.when(one, F.array_max(found)).otherwise(CONFLICT)
        at = [tiers.index(t) for t in taxonomy.ranked]
        return F.coalesce(*[F.when(F.get(found, F.lit(i)) > 0, result(tiers[i].name, tiers[i].level, conf)) for i in at])

    def fits(words: Column) -> Column:
        first, last, whole = F.get(words, F.lit(0)), F.element_at(words, -1), F.array_join(words, " ")
        phrase = lambda t: reduce(Column.__or__, [whole.contains(p) for p in t.phrases], F.lit(False))
        exact = F.array(*[F.when(is_in(first, t.head) | is_in(last, t.tail), WORD).when(phrase(t), PHRASE).otherwise(0) for t in tiers])
        patterns = [_glued_in(t) for t in tiers]
        every = "|".join(p for p in patterns if p)
        glued = F.filter(words, lambda w: (F.length(w) > KEYWORD) & w.rlike(every)) if every else F.array().cast("array<string>")
        merged = bind(F.get(glued, F.lit(0)), lambda w: F.array(*[F.when(w.rlike(p), MERGED).otherwise(0) if p else F.lit(0) for p in patterns]))
        one, joined = F.size(words) == 1, F.array_join(words, "")
        shape = (
            F.when(one & first.rlike(r"^[0-9]+(st|nd|rd|th)$"), result("premises", 1, ORDINAL))
            .when(F.lower(F.trim(text)).rlike(r"^#|^no\.?\s*[0-9]"), result("premises", 1, NUMBERED))
            .when(joined.rlike(r"^[a-z]?[0-9]+[a-z]?$"), result("premises", 1, DESIGNATOR))
            .when((F.size(words) == 2) & last.rlike("^[a-z0-9]{1,3}$") & is_in(first, tuple(taxonomy.tails)), result("structure", 1, DESIGNATED))
            .otherwise(result("unknown", taxonomy.locality_level, UNKNOWN))
        )
        some = lambda x: F.exists(x, lambda v: v > 0)
        return bind(exact, lambda e: F.when(some(e), decide(e)).otherwise(bind(merged, lambda m: F.when(some(m), decide(m)).otherwise(shape))))

    if not tiers:
        return result("unknown", UNKNOWN_LEVEL, UNKNOWN)
    return bind(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), bare_word), fits)


def classify_fragments(frags: DataFrame, taxonomy: Taxonomy = BUILT_IN) -> DataFrame:
    """Fragments (.., text, perhaps injected) with tier, level and conf in hundredths; a found boundary costs ten."""
    lost = F.when(F.col("injected"), INJECTED_CONF).otherwise(0) if "injected" in frags.columns else F.lit(0)
    rows = frags.withColumn("_kind", bind(classify(F.col("text"), taxonomy), lambda k: k))
    return rows.select(*frags.columns, "_kind.tier", "_kind.level", (F.col("_kind.conf") - lost).alias("conf"))


def bounded(segment: Column, taxonomy: Taxonomy = BUILT_IN) -> Column:
    """A comma-less text as an array of parts, each word kept and in order.

    One fold over the words. It cuts behind a tail word unless another follows, before a head word unless another or
    a connector stands before, and behind the designators that a head word takes, four short words at most
    (BLOCK B, PLOT NO 7).
    """
    mark = lambda t: bind(bare_word(t), lambda w: F.struct(t.alias("t"), is_in(w, tuple(taxonomy.heads)).alias("head"), is_in(w, tuple(taxonomy.tails)).alias("tail"), is_in(w, tuple(taxonomy.connectors)).alias("link"), w.rlike("^[a-z0-9]{1,3}$").alias("short")))
    words = F.transform(F.split(F.trim(segment), r"\s+"), mark)
    # taken: designators taken since the last head word, -1 where none can be
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(-1).alias("taken"), F.lit(False).alias("head"), F.lit(False).alias("tail"), F.lit(False).alias("link"))

    def step(s: Column, x: Column) -> Column:
        takes = s["taken"].between(0, DESIGNATORS - 1) & x["short"] & ~x["head"] & ~x["tail"]
        cut = (s["tail"] & ~x["tail"]) | (x["head"] & ~s["head"] & ~s["link"]) | ((s["taken"] > 0) & ~takes)
        cut = cut & s["now"].isNotNull()
        done = F.when(cut, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        now = F.when(cut | s["now"].isNull(), x["t"]).otherwise(F.concat(s["now"], F.lit(" "), x["t"]))
        taken = F.when(takes, s["taken"] + 1).when(x["head"], 0).otherwise(-1)
        return F.struct(done.alias("done"), now.alias("now"), taken.alias("taken"), x["head"].alias("head"), x["tail"].alias("tail"), x["link"].alias("link"))

    return F.aggregate(words, start, step, lambda s: F.concat(s["done"], F.array(s["now"])))


@dataclass(frozen=True)
class Piece:
    """What a stretch of a glued run is. credit: its worth where its place is right; role: head or tail; digits: it is all digits; lettered: a letter may follow as its
    designator; letter: it is one itself. starts, ends: the roles of keywords at its edges."""

    credit: float
    role: str
    digits: bool
    lettered: bool
    letter: bool
    starts: frozenset[str]
    ends: frozenset[str]

    @property
    def strong(self) -> bool:
        return self.credit == STRONG and not self.letter


class Lexicon:
    """Splits glued runs by a taxonomy; what it found for pieces and runs is remembered, up to a bound."""

    REMEMBERED = 1 << 16

    def __init__(self, taxonomy: Taxonomy):
        self.roles: dict[str, set[str]] = {}
        self.known: dict[str, tuple[str, bool, bool]] = {}  # word -> (role, whether it has worth, whether its letter follows)
        fused = {w for t in taxonomy.tiers if t.level > FACILITY for w in t.tail}  # endings of place names
        for t in taxonomy.tiers:
            for role, words in (("head", t.head), ("tail", t.tail)):
                for w in (w for w in words if len(w) >= 3):
                    self.roles.setdefault(w, set()).add(role)
                    self.known.setdefault(w, (role, len(w) >= KEYWORD and not (role == "tail" and w in fused), t.lettered and role == "head"))
        for w in (w for t in taxonomy.tiers for p in t.phrases for w in p.split() if len(w) >= 3):
            self.known.setdefault(w, ("any", len(w) >= KEYWORD, False))
        for w in taxonomy.connectors:
            if w.isalpha():
                self.known.setdefault(w, ("any", False, False))
        self.pieces: dict[str, Piece | None] = {}
        self.runs: dict[str, list[str]] = {}

    def _edges(self, core: str, test: Callable[[str, str], bool]) -> frozenset[str]:
        if core in self.roles:
            return frozenset(self.roles[core])
        return frozenset(r for w, roles in self.roles.items() if len(w) < len(core) and test(core, w) for r in roles)

    def piece(self, core: str) -> Piece | None:
        """None if no split may have it."""
        if core not in self.pieces:
            if len(self.pieces) >= self.REMEMBERED:
                self.pieces.clear()
            self.pieces[core] = self._piece(core)
        return self.pieces[core]

    def _piece(self, core: str) -> Piece | None:
        edges = self._edges(core, str.startswith), self._edges(core, str.endswith)
        if re.fullmatch(r"[0-9]+(?:st|nd|rd|th)|[0-9]{2,}[a-z]?|[a-z]?[0-9][a-z]", core):
            return Piece(STRONG, "", core.isdigit(), False, False, *edges)
        if re.fullmatch("[0-9]", core):
            return Piece(WEAK, "", True, False, False, *edges)
        if re.fullmatch("[a-rt-z]|ii|iii|iv|vi|vii|viii|ix|xi|xii", core):
            return Piece(STRONG, "", False, False, True, *edges)
        if core in self.known:
            role, worth, lettered = self.known[core]
            credit = 0.0 if not worth else WEAK if role == "any" else STRONG
            return Piece(credit, role if worth else "", False, lettered, False, *edges)
        if len(core) >= PLAUSIBLE and re.search("[aeiouy]", core) and not re.search("[bcdfghjklmnpqrstvwxz]{4}", core):
            return Piece(0.0, "", False, False, False, *edges)
        return None

    @staticmethod
    def allowed(a: Piece, b: Piece) -> bool:
        """No cut between keywords of one role or within a number; a letter only behind a word that takes one."""
        return not (a.digits and b.digits) and not a.ends & b.starts and (a.lettered or not b.letter)

    @staticmethod
    def worth(before: Piece | None, p: Piece, after: Piece | None) -> float:
        """A tail word counts at the end, or before a strong piece, a head word or a number; a head word at the start or behind a strong piece."""
        if p.credit == STRONG and p.role == "tail" and after is not None and not (after.strong or after.letter and p.lettered or after.role == "head" or after.digits):
            return 0.0
        if p.credit == STRONG and p.role == "head" and before is not None and not before.strong:
            return 0.0
        return p.credit

    def split(self, run: str) -> list[str]:
        if run not in self.runs:
            if len(self.runs) >= self.REMEMBERED:
                self.runs.clear()
            self.runs[run] = self._split(run)
        return self.runs[run]

    def _split(self, run: str) -> list[str]:
        """The pieces of the cover with the largest worth, of such the one with the fewest; the run alone if that has no strong piece in its right place
        or gains less than ``MARGIN``.

        A lattice over (end, last piece, the worth it has gained so far): what comes next can see the last piece only, so
        for each of these the best way is enough.
        """
        n = len(run)
        if not SHORTEST_RUN <= n <= LONGEST_RUN:
            return [run]
        core = lambda a, b: re.sub("[^a-z0-9]+", "", run[a:b].casefold())
        # at an end: (last piece, the piece before it is strong or it is the first) -> (settled worth, cuts, anchored, way)
        ways: list[dict] = [{} for _ in range(n + 1)]
        ways[0][None, True] = (0.0, 0, False, None)
        for at in range(n):
            for (last, led), (worth, cuts, anchored, way) in ways[at].items():
                for end in range(at + 1, min(n, at + LONGEST_PIECE) + 1):
                    word = core(at, end)
                    p = self.piece(word) if word else None
                    if p is None or (p.letter if last is None else not self.allowed(last, p)):
                        continue
                    gain = 0.0 if last is None else self._settled(last, led, p)
                    new = (worth + gain - (PER_CUT if last else 0.0), cuts + 1, anchored or gain == STRONG, (way, at))
                    key = (p, last is None or last.strong)
                    old = ways[end].get(key)
                    if old is None or (new[0], -new[1]) > (old[0], -old[1]):
                        ways[end][key] = new
        best = None
        for (last, led), (worth, cuts, anchored, way) in ways[n].items():
            gain = self._settled(last, led, None)
            if best is None or (worth + gain, -cuts) > (best[0], -best[1]):
                best = (worth + gain, cuts, anchored or gain == STRONG, way)
        alone = self.piece(core(0, n)) if core(0, n) else None
        if best is None or best[1] < 2 or not best[2] or best[0] < (alone.credit if alone and not alone.letter else UNLIKELY) + MARGIN:
            return [run]
        starts, way = [], best[3]
        while way:
            way, at = way
            starts.append(at)
        return [run[a:b] for a, b in zip(starts[::-1], [*starts[-2::-1], n], strict=True)]

    @classmethod
    def _settled(cls, last: Piece, led: bool, after: Piece | None) -> float:
        return 0.0 if last.role == "head" and not led and last.credit == STRONG else cls.worth(None, last, after)


def can_be_glued(text: Column, taxonomy: Taxonomy = BUILT_IN) -> Column:
    """Whether a text may hold a run that ``Lexicon.split`` splits: a keyword, or a digit, next to something else but a comma."""
    words = [w for t in taxonomy.tiers for w in (*t.head, *(t.tail if t.level <= FACILITY else ())) if len(w) >= KEYWORD]
    word = f"(?i:{_any_of(words)})" if words else "(?!)"
    return F.coalesce(text.rlike(rf"{word}(?=[^\s,])|(?<=[^\s,]){word}|[0-9](?=[^\s,0-9])|[^\s,0-9](?=[0-9])"), F.lit(False))


def deglued(segments: Column, taxonomy: Taxonomy = BUILT_IN) -> Column:
    """An array of texts, with the glued runs in them split."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(taxonomy)

        def split(text: str) -> str:
            runs = text.split()
            parts = [lexicon.split(r) for r in runs]
            return " ".join(p for ps in parts for p in ps) if any(len(ps) > 1 for ps in parts) else text

        for batch in batches:
            yield pa.array([None if x is None else [None if t is None else split(t) for t in x] for x in batch.to_pylist()], pa.list_(pa.string()))

    return run(segments)


def gap_groups(frags: DataFrame, key: str = "k", order: str = "i") -> DataFrame:
    """Classified fragments with ``gap`` (hundredths, null for the first) and ``grp``: gaps of 50 and more cut."""
    w = Window.partitionBy(key).orderBy(order)
    up = F.col("level") - F.lag("level").over(w)
    injected = F.coalesce(F.col("injected") | F.lag("injected").over(w), F.lit(False)) if "injected" in frags.columns else F.lit(False)
    near = (F.col("level") <= PREMISES_BAND) & (F.lag("level").over(w) <= PREMISES_BAND)
    gap = F.when(up == 1, STEP).when(up > 1, LONG_STEP).when((up < 0) & near, BACK_NEAR).when(up < 0, BACK).otherwise(0)
    gap = gap + F.when(F.col("tier") != F.lag("tier").over(w), TIER_CHANGE).otherwise(0) - F.when(injected, INJECTED).otherwise(0)
    rows = frags.withColumn("gap", F.when(up.isNotNull(), F.greatest(gap, F.lit(0))))
    return rows.withColumn("grp", F.sum(F.when(F.col("gap") >= CUT, 1).otherwise(0)).over(w).cast("int"))


def trusted(frags: DataFrame, key: str = "k") -> DataFrame:
    """Classified fragments with ``trust`` of their address (0 low, 1 medium, 2 high): by the mean confidence; medium at most if boundaries
    were found, and low if nothing is known besides. Fragments without a text don't count."""
    w = Window.partitionBy(key)
    mean = F.coalesce(F.avg(F.when(F.col("text").isNotNull(), F.col("conf"))).over(w), F.lit(0.0))
    trust = F.when(mean >= LEVEL_FROM[1], 2).when(mean >= LEVEL_FROM[0], 1).otherwise(0)
    if "injected" in frags.columns:
        found, unknown = F.coalesce(F.max("injected").over(w), F.lit(False)), F.min(F.col("tier") == "unknown").over(w)
        trust = F.when(found & unknown, 0).when(found, F.least(trust, F.lit(1))).otherwise(trust)
    return frags.withColumn("trust", trust)


def tail_split(groups: DataFrame, key: str = "k", order: str = "i", locality_level: int = UNKNOWN_LEVEL) -> DataFrame:
    """The last fragment leaves the last group if that ends in four locality-level ones or more and isn't the only group; addresses
    of low ``trust`` stay, and of others it is medium at most from then on."""
    back = Window.partitionBy(key).orderBy(F.col(order).desc())
    whole = Window.partitionBy(key)
    rows = groups.withColumns({"_last": F.max("grp").over(whole), "_n": F.row_number().over(back)})
    rows = rows.withColumn("_in", (F.col("grp") == F.col("_last")) & (F.col("level") >= locality_level))
    run = rows.withColumn("_run", F.min(F.col("_in").cast("int")).over(back))
    length = F.sum("_run").over(whole)
    size = F.sum(F.when(F.col("grp") == F.col("_last"), 1)).over(whole)
    able = F.col("trust") > 0 if "trust" in groups.columns else F.lit(True)
    peeled = (F.col("_n") == 1) & (F.col("_last") > 0) & (length >= TAIL_RUN) & (size > 1) & able
    out = run.withColumns({"peeled": peeled, "grp": F.when(peeled, F.col("grp") + 1).otherwise(F.col("grp"))})
    if "trust" in groups.columns:
        out = out.withColumn("trust", F.when(F.max("peeled").over(whole), F.least("trust", F.lit(1))).otherwise(F.col("trust")))
    return out.drop("_last", "_n", "_in", "_run")


def pack_lines(groups: DataFrame, key: str = "k", order: str = "i", cap: int = 4, more: str | None = None) -> DataFrame:
    """(key, lines, n_groups, confidence): at most ``cap`` lines, and as many as the address's ``trust`` allows; the weakest boundary (the first of equals) gives way
    first, a peeled last fragment's only at the end. A fold over an address's few groups."""
    none = F.lit(None).alias("_more") if more is None else F.first(more).alias("_more")
    lines = groups.groupBy(key, "grp").agg(none, F.array_join(F.sort_array(F.collect_list(F.struct(order, "text")))["text"], ", ").alias("text"), F.min_by("gap", order).alias("gap"), F.max("peeled").alias("peeled"), F.max("trust").alias("trust"), F.count("text").alias("n"))
    cost = F.when(F.col("grp") == 0, 10_000).when(F.col("peeled"), 5_000).otherwise(F.coalesce("gap", F.lit(0)))
    has = F.col("n") > 0
    allowed = F.least(F.lit(cap), F.get(F.array(*[F.lit(c) for c in LINE_CAP]), F.max("trust")))
    packed = lines.groupBy(key).agg(F.first("_more").alias("_more"), F.sort_array(F.collect_list(F.when(has, F.struct("grp", cost.alias("cost"), "text")))).alias("g"), F.max("trust").alias("trust"), allowed.alias("cap"), F.count_if(has).alias("n_groups"))

    def merge(s: Column, _: Column) -> Column:
        costs = F.transform(s, lambda x: x["cost"])
        at = F.array_position(costs, F.array_min(costs)).cast("int")
        a, b = F.element_at(s, at - 1), F.element_at(s, at)
        one = F.struct(a["grp"].alias("grp"), a["cost"].alias("cost"), F.concat(a["text"], F.lit(", "), b["text"]).alias("text"))
        return F.concat(F.slice(s, F.lit(1), F.greatest(at - 2, F.lit(0))), F.array(one), F.slice(s, at + 1, F.size(s)))

    over = F.size("g") - F.col("cap")
    folded = F.aggregate(F.when(over > 0, F.sequence(F.lit(1), over)).otherwise(F.array().cast("array<int>")), F.col("g"), merge)
    return packed.select(key, *([] if more is None else [F.col("_more").alias(more)]), F.transform(folded, lambda x: x["text"]).alias("lines"), "n_groups", F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("trust")).alias("confidence"))


def fragments(rows: DataFrame, segments: str, keep: Sequence[str], taxonomy: Taxonomy = BUILT_IN) -> DataFrame:
    """(*keep, i, text, injected): the segments one by one; a single one of four words and more goes through ``bounded``. A
    row without segments keeps one fragment without a text."""
    found = F.when((F.size(segments) == 1) & (F.size(F.split(F.trim(F.get(segments, F.lit(0))), r"\s+")) >= LEAST_WORDS), bounded(F.get(segments, F.lit(0)), taxonomy))
    parts = bind(found, lambda p: F.when(F.size(p) > 1, F.struct(p.alias("p"), F.lit(True).alias("injected"))).otherwise(F.struct(F.col(segments).alias("p"), F.lit(False).alias("injected"))))
    return rows.select(*keep, parts.alias("_p")).select(*keep, F.posexplode_outer("_p.p").alias("i", "text"), F.col("_p.injected").alias("injected"))
