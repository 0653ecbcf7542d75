"""Secret scans, whitening and spelling groups against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import spelling, whitening
from spanforge.llm.secrets import BASE62, base62_crc32, scan_secrets, secret_digests
from spanforge.llm.spelling import group_spellings
from spanforge.llm.whitening import whitened_rows

DOC = "doc_id long, text string"
LETTERS = "[A-Za-zÀ-ÿ]+"


def wide(spark, rows, names):
    """Rows of DOC with further columns of the given names."""
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], ", ".join([DOC, *[f"{n} string" for n in names]]))


# secrets


def checked(prefix, body):
    return prefix + body + base62_crc32(body.encode()).decode()


def brute_secrets(text):
    found = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    for i, (kind, prefix) in enumerate((("github", "gh[pousr]_"), ("npm", "npm_"))):
        for m in re.finditer(prefix + "([A-Za-z0-9]{36})(?![A-Za-z0-9])", text):
            crc, digits = zlib.crc32(m[1][:30].encode()), ""
            while crc:
                digits, crc = BASE62[crc % 62] + digits, crc // 62
            if digits.rjust(6, "0") == m[1][30:]:
                found.append((m.start(), 3 + i, m.end(), kind))
    count = lambda k: sum(x[3] == k for x in found)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def secret_texts():
    rng = random.Random(5)
    body = "".join(rng.choice(BASE62) for _ in range(30))
    good, bad = checked("ghp_", body), checked("ghp_", body)[:-1] + "_"
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", ":", "=", '"', "'", " ", "   ", "é", "ſecret", "Key", "AKIA", "AKIAABCDEFGHIJKL", "akia", "0123456789abcdef", "0123456789abcdef0123456789abcdef", "ABCDEF", "zz", "\n", "漢", "a/b+c.d-e_f", "token: token=short", good, bad, good + "x", checked("npm_", body), "😀", "\x00", "hunter22"]
    fixed = [None, "", "password=12345678", "password=1234567", "ſecret=abcdefgh", "toKen = 'abcdefgh'", "tokentoken=abcdefgh", "secret:password:abcdefgh", "password= password=abcdefgh", "AKIAAKIA" + "A" * 8, "AKIA" + "A" * 11, "AKIA" + "A" * 12, "0" * 31, "0" * 32, "0" * 31 + "A" + "f" * 40 + "G" + "1" * 31, "é😀" + good + ",", "gh_" + good, good + good, checked("npm_", body) + "-" + checked("ghs_", body[::-1]), "a" * 100_000 + " token=" + "b" * 100_000]
    return fixed + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(600)]


def test_secrets(spark):
    texts = secret_texts()
    rows = list(enumerate(texts)) + [(None, "password=12345678"), (3, "secret=12345678"), (3, "secret=12345678")]
    got = secret_digests(wide(spark, rows, ["spans", "kind", "start", "secrets", "n_hex"])).collect()
    assert sorted((r.doc_id is not None, r.doc_id, *tuple(r)[1:]) for r in got) == sorted((i is not None, i, *brute_secrets(t or "")) for i, t in rows)
    kinds = collections.Counter(k.split(":")[0] for r in got for k in r.spans.split(",") if k)
    assert set(kinds) == {"assign", "access", "hex", "github", "npm"} and min(kinds.values()) >= 10
    assert secret_digests(spark.createDataFrame([], DOC)).count() == 0
    first = scan_secrets(spark.createDataFrame([(1, "é token=abcdefgh")], DOC)).first().secrets
    assert [tuple(s) for s in first] == [("assign", 2, 16)]


def test_checksum_of_a_known_token():
    # the empty payload has checksum 0; a payload's digits carry its whole CRC32
    assert base62_crc32(b"") == b"000000"
    n = 0
    for c in base62_crc32(b"zQWBuTSOoRi4A9spHcVY5ncnsDkxkJ").decode():
        n = n * 62 + BASE62.index(c)
    assert n == zlib.crc32(b"zQWBuTSOoRi4A9spHcVY5ncnsDkxkJ")


# whitening


def brute_whitening(vectors, k=16):
    """(id, component) -> values, by exact whole numbers and the covariance's eigenvectors."""
    ok = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = collections.defaultdict(list)
    for d in {len(x) for _, x in ok if x}:
        fit = sorted({tuple(x) for _, x in ok if len(x) == d})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
        e, v = np.linalg.eigh(centred.T @ centred / n)
        e, v = e[::-1], v[:, ::-1]
        for i, x in ok:
            if len(x) == d:
                dev = [n * a - b for a, b in zip(x, s)]
                for c in range(min(k, d)):
                    if e[c] > 1e-9 * e[0] and e[0] > 0:
                        out[i, c + 1].append((n, sum(a * a for a in dev), float(np.array(dev) / n @ v[:, c] / math.sqrt(e[c])), e[c] / e.sum()))
    return out


def compare_whitening(rows, vectors):
    want = brute_whitening(vectors)
    signs = {}
    got = collections.defaultdict(list)
    for r in rows:
        got[r.vec_id, r.component].append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for key, found in got.items():
        for r, (n, dev, w, ex) in zip(sorted(found, key=lambda r: r.deviation), sorted(want[key], key=lambda x: x[1])):
            assert (r.n, r.deviation) == (n, dev)
            assert math.isclose(r.explained, ex, rel_tol=1e-6) and r.identity_error < 1e-8
            assert math.isclose(abs(r.whitened), abs(w), rel_tol=1e-6, abs_tol=1e-6)
            if abs(w) > 1e-3:
                assert signs.setdefault((n, key[1]), r.whitened * w > 0) == (r.whitened * w > 0)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 24)) * np.geomspace(40, 0.5, 24)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    vectors += [(1000 + i, vectors[i % 3][1]) for i in range(200)]  # repeats weigh nothing in the fit
    vectors += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24)]
    vectors += [(3000 + i, [float(c) for c in rng.standard_normal(5) * [9, 7, 5, 3, 1]]) for i in range(30)]  # another length
    vectors += [(4000, vectors[7][1]), (4000, vectors[8][1])]
    schema = "vec_id long, embedding array<double>, x string, d string, component string, n int, v int, part int, m int"
    df = spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3, 4) for r in vectors], schema).repartition(7)
    compare_whitening(whitened_rows(df).collect(), vectors)


def test_whitening_of_few_and_many_parts(spark):
    rng = np.random.default_rng(4)
    assert whitened_rows(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitened_rows(one).count() == 0  # no variance
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]  # one direction alone
    compare_whitening(whitened_rows(spark.createDataFrame(line, "vec_id long, embedding array<double>")).collect(), line)
    far = [(i, [float(c) for c in v]) for i, v in enumerate(1e6 + rng.standard_normal((90, 4)) * [9, 5, 3, 2])]
    compare_whitening(whitened_rows(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect(), far)
    huge = [(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)]
    got = whitened_rows(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {2**63 - 1} and {r.component for r in got} == {1}
    parts = [rng.standard_normal((3, 5)) for _ in range(100)]  # more parts than one level takes
    rows = spark.createDataFrame([(5, i, 5, [float(c) for c in p.ravel()]) for i, p in enumerate(parts)], whitening._PARTS)
    r = whitening.in_tree(rows, whitening.merge_factors, "r")[5]
    assert np.allclose(r.T @ r, np.vstack(parts).T @ np.vstack(parts))
    blocks = [whitening.moments(p) for p in parts]
    rows = spark.createDataFrame([(5, i, 6, [float(c) for c in p.ravel()]) for i, p in enumerate(blocks)], whitening._PARTS)
    m, whole = whitening.in_tree(rows, whitening.merge_moments, "m")[5], np.vstack(parts)
    assert m[0, 0] == 300 and np.allclose(m[1:, 1:] / 300, np.cov(whole.T, bias=True)) and np.allclose(m[0, 1:], whole.mean(axis=0))


def test_lots_of_lengths():
    assert whitening.lots_of([4, 2, 10**9, 3], 16, 2000) == [[2, 3], [4], [10**9]]


# spelling


def brute_spelling(rows, least_n=5, least_length=6, times=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = collections.Counter()
    for i, text in rows:
        for m in re.finditer(LETTERS, text or ""):
            run = m[0].translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if n >= least_n and len(w) >= least_length}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]

    # neighbours by lengths, so that the loop stays small
    by = collections.defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    nears = {w: [o for k in (-1, 0, 1) for o in by[len(w) + k] if near(w, o)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(nears[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(nears[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def plain(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def spelling_rows(seed=7):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(120)]
    words = []
    for s in stems:
        words += [s] * rng.choice([5, 30, 160, 900])
        for _ in range(4):
            p, c = rng.randrange(len(s)), rng.choice("abÀÿ")
            words += [rng.choice([s[:p] + s[p + 1 :], s[:p] + c + s[p:], s[:p] + c + s[p + 1 :]])] * rng.choice([1, 5, 6, 30])
    words += ["aaaaaa"] * 5 + ["aaaaaaa"] * 25 + ["aaaaaaaa"] * 125 + ["aaaaaaaaa"] * 625  # runs of one letter, and a chain of forms
    words += ["prefix"] * 6 + ["prefixe"] * 6 + ["prefixes"] * 6 + ["XPrefix"] * 30 + ["Ünique×÷"] * 7
    rng.shuffle(words)
    return [(i, rng.choice([" ", "-", "1", "\n", "漢", "_"]).join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]


def test_spelling(spark):
    rows = spelling_rows() + [(None, "nullable " * 7), (None, None), (5, ""), (9, "repeated doubled"), *[(9, "repeated doubled")] * 5, (10**6, "x" * 3000 + " "), *[(10**6 + i, "y" * 3000 + "z" * (i % 2)) for i in range(12)]]
    want = brute_spelling(rows)
    assert sum(1 for w in want if w[1]) > 40 and any(w[1] and w[1] != w[2] for w in want) and max(w[4] for w in want) >= 5
    got = group_spellings(wide(spark, rows, ["word", "n", "id", "h", "run", "doc", "at"]).repartition(5))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert plain(got) == want
    assert group_spellings(spark.createDataFrame([], DOC)).count() == 0
    assert group_spellings(spark.createDataFrame([(1, None), (2, "a b")], DOC)).count() == 0


def test_spelling_without_hot_nodes(spark):
    """With many shuffle partitions no node is broadcast; with one, most are."""
    rows = spelling_rows(8)[:60]
    want = brute_spelling(rows, least_n=2)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert plain(group_spellings(spark.createDataFrame(rows, DOC), least_n=2)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("most", [1, 2, 3, 7, 50])
def test_pieces_cut_no_run(spark, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice("aé-Z 1") for _ in range(rng.randrange(0, 40))) for _ in range(200)] + ["", "a" * 30, "-" * 30, "a" * 7 + "-" + "b" * 7]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC)
    runs = df.select("doc_id", F.flatten(F.transform(spelling.pieces(F.col("text"), most), lambda p: F.regexp_extract_all(p, F.lit(f"({spelling.LETTERS}+)")))).alias("runs"))
    assert [r.runs for r in runs.orderBy("doc_id").collect()] == [re.findall(LETTERS, t) for t in texts]


# mends of earlier operators


def test_mix_keeps_its_budget_whatever_ids_are_shared(spark):
    from spanforge.llm.mixing import Mix, mix_counts, mixed

    rows = [(None, "ten words " * 5, "en", "s") for _ in range(20)] + [(7, "a b c " + "d " * (i % 5), "de", "s") for i in range(60)] + [(i, "x " * (i % 9), "fr", "t") for i in range(100, 160)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, row int, c0 int, m0 int").repartition(6)
    mix = Mix((F.lit("d"), F.col("lang"), F.col("source")), max_epochs=3, total_tokens=330, seed=2)
    counts = mix_counts(docs, mix).groupBy("lang").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.sum("copies").alias("n")).collect()
    out = mixed(docs, mix)
    assert out.columns == docs.columns
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    got = {r.lang: r for r in out.groupBy("lang").agg(F.sum(words).alias("t"), F.count("*").alias("n")).collect()}
    assert {r.lang: (r.t, r.n) for r in counts if r.lang != "de"} == {k: (r.t, r.n) for k, r in got.items() if k != "de"}
    totals = [{r.lang: r.t for r in counts}, {k: r.t for k, r in got.items()}]  # which of the rows of one id come first is open
    assert all(t["en"] == 110 and 103 <= t["de"] <= 110 and 102 <= t["fr"] <= 110 for t in totals)
    assert mixed(docs.where("false"), mix).count() == 0


def test_mix_of_very_long_texts(spark):
    from spanforge.llm.mixing import Mix, mix_counts

    rows = [(1, "w " * 300_000, "en", "s"), (2, "w", "en", "s"), (3, None, "en", "s")]
    got = {r.doc_id: r.n_tokens for r in mix_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), Mix((F.lit("d"), F.col("lang"), F.col("source")))).collect()}
    assert got == {1: 300_000, 2: 1, 3: 0}


def test_warc_with_a_very_long_url(spark, tmp_path):
    from spanforge.llm import warc

    rows = [(1, "http://x/" + "u" * 2_000_000, "body"), (2, "http://y/", "body"), (3, "http://z/" + "é" * 70_000, "other"), (4, "\r\n" * 40_000, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(spark, df, f"file://{tmp_path}/a").collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes, r.intact) for i, r in got.items()} == {1: ("revisit", 2, 4, True), 2: ("response", None, 4, True), 3: ("response", None, 5, True), 4: ("response", None, 0, True)}
    # lines that end anywhere in the parts that the reader gets, and archives that break off
    for size in (1, 7, warc.LINE_KEPT - 1, warc.LINE_KEPT, warc.LINE_KEPT + 1, 3 * warc.LINE_KEPT):
        data = b"WARC/1.1\r\nA: " + b"v" * size + b"\r\nContent-Length: 5\r\n\r\nrest"
        for step in (1 if size < 100 else 997, warc.READ_BYTES, len(data)):
            r = warc._Reader(data[i : i + step] for i in range(0, len(data), step))
            fields, n = r.header()
            assert fields["content-length"] == "5" and n == len(data) - 4 and r.take(9)[:1] == b"r"
        with pytest.raises(ValueError):
            warc._Reader(iter([data[: 20 + size // 2]])).header()
    assert warc._Reader(iter([])).header() is None
