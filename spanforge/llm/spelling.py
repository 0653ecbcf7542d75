"""Spelling variant grouping: pairs of words one edit apart, by merging the light subtrees of an errata trie."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import ascii_lower, written

#: What runs are made of, and the rule for runs that lose a code point.
LETTERS = "[A-Za-zÀ-ÿ]"
EVERY = 199
#: Texts longer than this many code points are taken in pieces.
PIECE = 1 << 20
#: A trie node is known by a hash of its prefix. Two nodes with one hash only share the choice of their heavy child.
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
_GAP = "*"


def pieces(text: Column, most: int = PIECE) -> Column:
    """A text as an array of pieces that cut no run, of about ``most`` code points; runs that go on beyond stay whole."""

    def piece(i: Column) -> Column:
        at, whole = i * most, F.length(text)
        body = F.substring(text, at + 1, F.lit(most))
        within = (i > 0) & F.substring(text, at, F.lit(1)).rlike(LETTERS)
        body = F.when(within, F.regexp_replace(body, f"^{LETTERS}+", "")).otherwise(body)
        rest = F.regexp_extract(F.substring(text, at + most + 1, whole), f"^{LETTERS}+", 0)
        return F.when(body.rlike(f"{LETTERS}$"), F.concat(body, rest)).otherwise(body)

    cuts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / most).cast("int"))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.transform(cuts, piece))


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_length: int, least_n: int, piece: int = PIECE) -> DataFrame:
    """(word, n): the runs of letters, A-Z lower-cased, some with a code point taken out by the rule, that are long and frequent enough."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    runs = rows.select("doc", F.explode(pieces(F.col("text"), piece)).alias("text")).select("doc", F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}+)"))).alias("run"))
    # a run loses a code point at most, so shorter ones can go at once
    runs = runs.where(F.length("run") >= least_length).select(ascii_lower(F.col("run")).alias("run"), "doc")
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substring("run", F.lit(1), F.col("at")), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie edges on each word's way: (id, p, node, c), c empty where the word ends."""
    names = ["id", "p", "node", "c"]
    cols: list[list] = [[], [], [], []]

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names)
        for c in cols:
            c.clear()
        return out

    for b in batches:
        for i, word in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            node = 0
            for p, c in enumerate([*word.as_py(), ""]):
                for col, x in zip(cols, (i, p, node, c)):
                    col.append(x)
                node = (node * _BASE + ord(c or "\0") + 1) % _PRIME
                if len(cols[0]) >= 1 << 16:
                    yield batch()
    if cols[0]:
        yield batch()


def light_marks(words: DataFrame) -> DataFrame:
    """``words(id, word)`` -> (id, marks): the places where each word leaves the heavy path, with the heavy child's character there.

    A node's heavy child is that with most words (the end of a word is a child as well, the empty string), so a
    word leaves a heavy path at most log2(words) times. Nodes with many words can number four for each shuffle
    partition at most, as all nodes together have no more words than there are edges; these are broadcast,
    and the others meet their edges in an equi-join.
    """
    spark = words.sparkSession
    edges = written(words.select("id", "word").mapInArrow(_edges, "id long, p int, node long, c string"), "spelling-edges")
    nodes = edges.groupBy("node", "c").agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("c", F.struct("k", "c")).alias("h"), F.sum("k").alias("k"), F.count("*").alias("kids"))
    nodes = written(nodes.where("kids > 1").select("node", "h", "k"), "spelling-nodes")
    many = edges.count() / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(nodes.where(F.col("k") >= many).select("node", "h"))
    cold = nodes.where(F.col("k") < many).select("node", "h")
    light = edges.join(hot, "node").unionByName(edges.join(hot, "node", "left_anti").join(cold, "node")).where("c <> h")
    return light.groupBy("id").agg(F.collect_list(F.struct("p", "h")).alias("marks"))


def near_words(words: DataFrame) -> DataFrame:
    """``words(id, word, n)`` -> (word, n_near, best): for words with others one insertion, deletion or replacement away their
    number, and the first of these by falling n and then code points, as (m = -n, near).

    Where a word leaves the heavy path, its light subtree is merged into the heavy one and its siblings, the word's next
    character skipped, replaced by the heavy one, or the heavy one put before it. Terminals that coincide
    are pairs: in the trie itself by an equi-join, among light siblings (an alphabet of them at most) by grouping. Two words
    part at one node, where one of them is light, so each pair is met once, by one of these rules.
    """
    spots = words.join(light_marks(words), "id").select("word", "n", F.inline("marks"))
    parts = spots.select("word", "n", "h", F.expr("substring(word, 1, p)").alias("head"), F.expr("substring(word, p + 1, 1)").alias("c"), F.expr("substring(word, p + 2)").alias("rest"))
    skipped = F.when((F.col("c") != "") & ~F.col("rest").startswith(F.col("c")), F.concat("head", "rest"))
    replaced = F.when((F.col("c") != "") & (F.col("h") != ""), F.concat("head", "h", "rest"))
    inserted = F.when(F.col("h") != "", F.concat("head", "h", "c", "rest"))
    merged = parts.select("word", "n", F.explode(F.array_compact(F.array(skipped, replaced, inserted))).alias("near"))
    pairs = merged.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    ways = F.array(F.struct("word", (-F.col("near_n")).alias("m"), "near"), F.struct(F.col("near").alias("word"), (-F.col("n")).alias("m"), F.col("word").alias("near")))
    found = pairs.select(F.inline(ways)).withColumn("k", F.lit(1).cast("long"))

    siblings = parts.where("c <> ''").groupBy(F.concat("head", F.lit(_GAP), "rest").alias("key")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("word").alias("near")))).alias("s")).where(F.size("s") > 1)
    each = siblings.select("s", F.posexplode("s").alias("i", "own")).withColumn("first", F.get("s", F.when(F.col("i") == 0, 1).otherwise(0)))
    found = found.unionByName(each.select(F.col("own.near").alias("word"), F.col("first.m").alias("m"), F.col("first.near").alias("near"), (F.size("s") - 1).cast("long").alias("k")))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct("m", "near")).alias("best"))


def followed(links: DataFrame) -> DataFrame:
    """``links(word, form)``, without cycles -> (word, root): the last form that each word leads to. Each pass doubles the way, so
    passes are few; the join's left side may be hot in a root, which adaptive execution splits."""
    now = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not now.join(on, "root", "left_semi").limit(1).count():
            return now
        now = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, times: int = 5, piece: int = PIECE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every frequent word.

    Words are maximal runs of letters with A-Z lower-cased; a run whose CRC32 of ``id:run`` 199 divides has lost
    its code point at that CRC32 modulo its length. Words of ``least_length`` code points or more that occur ``least_n`` times
    or more count. ``n_near``: words one inserted, deleted or replaced code point away. ``form``: the most frequent of
    these (ties: the first by code points) if it is ``times`` as frequent as the word, else null. ``root``: the last of the
    forms' forms; the word itself if it has none.

    A null text has no words, a null id counts as an empty string, rows that repeat count each; texts and words of any length count
    whole; extra columns play no part; an empty table gives no rows.
    """
    counts = word_counts(docs, id_col, text_col, least_length, least_n, piece)
    words = written(counts.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = near_words(words).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    taken = F.col("near_n") >= times * F.col("n")
    forms = words.join(near, "word", "left").select("word", F.when(taken, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("near_n")).alias("form_n"))
    forms = written(forms, "spelling-forms")
    roots = followed(forms.where("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
