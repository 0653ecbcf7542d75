"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanforge.llm import bpe, hmm
from spanforge.llm.common import connected_components
from spanforge.llm.embedding_dedup import near_vectors
from spanforge.llm.line_dedup import dedup_lines, kept_text, stream_repeats
from spanforge.llm.mixing import Mix, leaf_budgets, mix_counts, mixed
from spanforge.llm.simhash import drop_near_copies, fingerprint, near_groups
from spanforge.llm.toxicity import ToxicityChain, drop_toxic
from spanforge.llm.url_filter import BloomCascade, Rule, filter_urls
from spanforge.llm.vectors import top_k
from spanforge.llm.warc import archive_round_trip, read_chunks, write_archives

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string"
WIDE = "doc_id long, text string, n_lines string, keep int, fp string, c0 int, id int, tokens int, _x int"


def wide(spark, rows):
    """Columns whose names the operators use within."""
    return spark.createDataFrame([(i, t, "old", 1, "z", 2, 3, 4, 5) for i, t in rows], WIDE)


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(200, 260)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    want = groups(261, links)
    assert all(got.get(i, i) == want[i] for i in range(261))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, is_query, k=5):
    ok = [(i, np.floor(256 * np.array(v, "f4").astype("f8")).astype("i8")) for i, v, _ in rows if i is not None and v is not None and None not in v and not any(math.isnan(x) for x in v)]
    want = []
    for a, (q, x) in enumerate(ok):
        if is_query(q):
            best = sorted((-int(x @ y), i) for b, (i, y) in enumerate(ok) if a != b and len(x) == len(y))[:k]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(want)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=12)], 0) for i in range(300)]
    rows += [(300, None, 0), (301, [float("nan")] * 12, 0), (302, [None] + [1.0] * 11, 0), (None, [1.0] * 12, 0), (303, rows[5][1], 0), (304, [1.0, 2.0], 0), (350, [], 0), (400, [3.0, 1.0], 0), (401, [-3.0, 1.0], 0)]
    rows += [(100, rows[7][1], 0), (100, rows[8][1], 0), (100, rows[100][1], 0)]  # a query's id again, one of them the same row
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, d int").withColumn("row", F.lit(1)).withColumn("least", F.lit(2))
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, data_block=64, query_block=4).collect())
    assert got == brute_top(rows, lambda i: i % 50 == 0)
    assert top_k(df.where("false"), F.lit(True)).count() == 0


def test_top_k_of_clusters(spark):
    """Rows far from a block of queries aren't sent to it, and none is missing; huge components, long vectors."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 40)) * 4
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=40)], 0) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, d int")
    assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, data_block=50, query_block=8).collect()) == brute_top(rows, lambda i: i % 20 == 0)
    big = [(i, [float(x) for x in rng.integers(-1e5, 1e5, 300)], 0) for i in range(40)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<float>, d int")
    got = top_k(df, F.col("vec_id") % 5 == 0, data_block=16, query_block=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(big, lambda i: i % 5 == 0)


@pytest.mark.parametrize("dims", [64, 256, 768])
def test_embedding_recall(spark, dims):
    """Of 300 random pairs at the threshold itself nearly all are linked, and nothing else is."""
    rng = np.random.default_rng(dims)
    a, noise = rng.standard_normal((2, 300, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.98001 * a + np.sqrt(1 - 0.98001**2) * noise
    rows = [(2 * i + j, [float(v) for v in x[i]], 0) for i in range(300) for j, x in enumerate((a, b))]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 600 and all(r.n_links <= 1 and r.component_id in (r.vec_id, r.vec_id - r.vec_id % 2) for r in got)
    assert sum(r.n_links for r in got) / 600 >= 0.99


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 32))
    rows = []
    for i in range(240):
        v = base[i % 6] + rng.normal(size=32) * (0.02 if i % 3 else 0.12)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(240, rows[0][1], 0), (241, rows[0][1], None), (242, [0.0] * 32, 0), (243, None, 0), (244, [float("inf")] * 32, 0), (245, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cid", F.lit(1)).withColumn("h", F.lit(2))
    got = {r.vec_id: r for r in near_vectors(df, block=40).collect()}
    ok = [(i, np.array(v) / np.linalg.norm(v), lb) for i, v, lb in rows if lb is not None and v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for n, (a, x, la) in enumerate(ok) for b, y, lb in ok[:n] if la == lb and x @ y >= 0.98]
    found = sum(got[i].n_links for i in got) / 2
    assert len(got) == len(rows) and 0.97 * len(links) <= found <= len(links)
    assert got[240].n_links >= 1 and got[240].component_id == got[0].component_id
    for i in (241, 242, 243, 244, 245):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert near_vectors(df.where("false")).count() == 0


def brute_lines(rows, min_chars, min_docs):
    strip = " \t\n\x0b\f\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    where = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(x.strip(strip).translate(low), set()).add(i if i is not None else -(2**63))
    top = {k: max(v) for k, v in where.items() if len(k) >= min_chars and len(v) >= min_docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if top.get(x.strip(strip).translate(low), i if i is not None else -(2**63)) == (i if i is not None else -(2**63)))) for i, t in rows]


def test_line_dedup(spark):
    rng = random.Random(2)
    lines = [f"Line number {i} " + "x" * (i % 9) for i in range(30)] + ["short", "", "  LINE NUMBER 3 xxx\t"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(8)))) for i in range(150)] + [(None, lines[0] + "\n" + lines[1]), (500, None), (501, ""), (7, lines[0]), (7, lines[0]), (502, "\n".join(lines * 3000))]
    out = dedup_lines(wide(spark, rows), min_chars=12, min_docs=5)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(brute_lines(rows, 12, 5))
    assert out.columns.count("n_lines") == 1 and dict(out.dtypes)["keep"] == "binary" and "c0" in out.columns
    for r in out.where("n_dropped > 0").limit(20).collect():
        assert kept_text(dict(rows).get(r.doc_id) or "", bytes(r.keep)) == r.text or r.doc_id == 7
    assert dedup_lines(spark.createDataFrame([], DOC)).count() == 0


def test_line_stream_over_any_cut():
    """The same drops however the sorted rows are cut into partitions and batches."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted({(rng.randrange(6), 0, rng.randrange(14)) for _ in range(90)}, key=lambda r: (r[0], -r[2]))
    rows = [(*r, 1, p) for r in rows for p in range(rng.randrange(1, 3))]
    by = {}
    for h, _, d, _, _ in rows:
        by.setdefault(h, set()).add(d)
    want = {(d, p) for h, _, d, _, p in rows if len(by[h]) >= 5 and d != max(by[h])}
    docs_at = [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]]
    for _ in range(60):
        cuts = [0, *sorted(rng.sample(docs_at, rng.randrange(0, 6))), len(rows)]
        drops, late, sums = set(), [], []
        for a, b in zip(cuts, cuts[1:]):
            part, batches = rows[a:b], []
            while part:
                n = rng.randrange(1, 9)
                batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part[:n]), (pa.int64(),) * 4 + (pa.int32(),))], ["h1", "h2", "doc", "th", "pos"]))
                part = part[n:]
            for o in stream_repeats(iter(batches), 5):
                for kind, h1, _, doc, _, pos, n in zip(*(c.to_pylist() for c in o.columns)):
                    if kind == 0:
                        drops.add((doc, pos))
                    elif kind == 1:
                        late.append((h1, doc, pos))
                    else:
                        sums.append((h1, doc, n))
        for h, doc, pos in late:
            if sum(n for x, _, n in sums if x == h) >= 5 and doc != max(d for x, d, _ in sums if x == h):
                drops.add((doc, pos))
        assert drops == want


def test_bpe_remembers_little(monkeypatch):
    """Small memories, cleared and rotated over and over, change no token."""
    tiktoken = pytest.importorskip("tiktoken")
    t = bpe.Tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 7)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 11)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.vocabulary.ranks, special_tokens={})
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abenß漢9") for _ in range(rng.randrange(90))) for _ in range(30)) for _ in range(40)]
    for some in (texts[:1], texts[1:30], texts[30:] + texts[:5] + [""]):
        assert [np.frombuffer(x, "<u4").tolist() for x in t.encode_many(some)] == [enc.encode_ordinary(x) for x in some]
    assert len(t._cache) <= 7 and len(t._older) <= 7


def test_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    t = bpe.tokenizer(path, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.vocabulary.ranks, special_tokens={})
    rng = random.Random(4)
    letters = "abeAZ  \n\t'sßé漢🎉19.,-_\r\u3000"
    texts = ["", "a" * 3000, " " * 500, "x y " * 400_000, "<|endoftext|>"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(300)]
    for x in texts:
        assert t.encode(x).tolist() == enc.encode_ordinary(x)
        assert t.decode(t.encode(x)).decode() == x
    e = bpe.EncodedText(t, texts[7] * 50)
    whole = e.encoded_chars
    for _ in range(60):
        a = rng.randrange(len(e.text) + 1)
        e.replace(a, min(len(e.text), a + rng.randrange(4)), rng.choice(texts[5:]))
        e.append(rng.choice(texts[5:]))
        assert e.tokens() == enc.encode_ordinary(e.text)
    p = bpe.Prefixes(t.vocabulary, b"inter")
    p.append(b"nationalisation")
    assert p.tokens() == t.piece("internationalisation") and whole
    p.truncate(5)
    assert p.tokens() == t.piece("inter")
    got = {r.doc_id: r for r in bpe.round_trip_digests(wide(spark, [(1, texts[9]), (2, None), (None, "")]), path, P.PATTERN).collect()}
    assert got[1].ids_sha256 == hashlib.sha256(np.array(enc.encode_ordinary(texts[9]), "<u4").tobytes()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(texts[9].encode()).hexdigest() and got[2].n_tokens == 0 and got[None].n_tokens == 0
    assert bpe.decode_documents(bpe.encode_documents(spark.createDataFrame([(1, "ab c")], DOC), path, P.PATTERN), path, P.PATTERN).first().decoded == b"ab c"


def test_warc(spark, tmp_path):
    big = "<html>" + "é" * 700_000
    rows = [(1, "http://a/ b\n", big), (2, None, None), (3, "http://c/", ""), (4, "u", "same"), (9, "u", "same"), (9, "v", "same"), (None, "u", "same"), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("x"))
    got = Counter(tuple(r) for r in archive_round_trip(spark, df, f"file://{tmp_path}/a").collect())
    digest = lambda h: __import__("base64").b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    refers = {2: 3, 4: 9, None: 9}
    assert got == Counter((i, len((h or "").encode()), digest(h), "revisit" if i in refers else "response", refers.get(i), True) for i, _, h in rows)
    archives = write_archives(df.where("page_id = 1"), f"file://{tmp_path}/b", chunk_bytes=100_000)
    chunks = read_chunks(archives, chunk_bytes=65_536).orderBy("chunk").collect()
    assert b"".join(bytes(c.data) for c in chunks) == big.encode() and max(len(c.data) for c in chunks) <= 65_536
    assert [c.payload_digest for c in chunks][-1] == digest(big) and [c.last for c in chunks] == [False] * (len(chunks) - 1) + [True]
    raw = b"".join(gzip.open(p).read() for p in (tmp_path / "b").glob("*.warc.gz"))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")
    assert archive_round_trip(spark, df.where("false"), f"file://{tmp_path}/c").count() == 0


def test_toxicity(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(400):
        bad = i % 8 == 0
        text = [rng.choice(words) for _ in range(40)] + ([rng.choice(["vilea", "vileb", "vilec", "nastyx"])] if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(bad)))
    docs = wide(spark, [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "vilea"), (1002, "ok " * 20_000)])
    labels = spark.createDataFrame([(i, b, b) for i, _, b in rows if i < 320] + [(1, None, 1), (None, 1, 1)], "doc_id long, rude int, toxic int")
    chain = ToxicityChain(categories=("rude", "toxic"), train_rows=1000).fit(docs, labels)
    got = {r.doc_id: r for r in chain.transform(docs).collect()}
    held = [(got[i].is_toxic, bool(b)) for i, _, b in rows if i >= 320]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(got) == docs.count()
    assert not got[1000].is_toxic and not got[1002].is_toxic
    kept = drop_toxic(docs, labels.select("doc_id", (1 - F.col("rude")).alias("quality"), "toxic"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    none = ToxicityChain(categories=("rude", "toxic")).fit(docs, labels.where("false")).transform(docs)
    assert none.where("p_toxic <> 0").count() == 0


def test_budgets(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 100), ("a", "x", "2", 10), ("a", "y", "3", 50), ("b", "z", "4", 1000)], "domain string, lang string, source string, tokens long")
    mix = Mix((), weights={("a",): 3, ("b",): 1}, max_epochs=1, total_tokens=200)
    got = {r.source: r.budget for r in leaf_budgets(leaves, mix).collect()}
    # domain a is owed 150; its languages 75 each: y holds 50, x takes the rest; source 2 holds 10, source 1 takes it
    assert got == {"1": 90, "2": 10, "3": 50, "4": 50}
    got = {r.source: r.budget for r in leaf_budgets(leaves, Mix((), weights={("a",): 9, ("b",): 1}, max_epochs=1, total_tokens=400)).collect()}
    assert got == {"1": 100, "2": 10, "3": 50, "4": 240}


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), "en" if i % 3 else None, f"s{i % 2}") for i in range(200)] + [(None, None, None, None), (3, "a b", "de", "s9"), (3, "a b", "de", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("budget", F.lit(1))
    mix = Mix((F.lit("d"), F.col("lang"), F.col("source")), weights={("d", "en"): 5}, max_epochs=3, seed=1)
    counts = mix_counts(docs, mix)
    assert counts.count() == len(rows)
    budget = {(r.lang, r.source): (r.budget, r.tokens) for r in leaf_budgets(counts.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens")), mix).collect()}
    for r in counts.groupBy("lang", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("most")).collect():
        b, tokens = budget[r.lang, r.source]
        assert b - 6 <= r.t <= b or not tokens
        assert r.most <= 3
    out = mixed(docs, mix)
    assert out.columns == docs.columns
    assert out.where("doc_id <> 3").count() == counts.where("doc_id <> 3").agg(F.sum("copies")).first()[0]
    assert mix_counts(docs.where("false"), mix).count() == 0


def test_hmm(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the cat", "Der Hund", "sat", "rare%d" % rng.randrange(400)]) for _ in range(rng.randrange(30)))) for i in range(300)]
    rows += [(700, None), (701, ""), (702, "\u00a0nbsp is no space"), (5, rows[5][1]), (None, "the cat")]
    s = hmm.HmmSettings(states=3, own_words=3, known_words=40, endings=8, shards=2, batch_tokens=16)
    got = hmm.score_documents(wide(spark, rows), s).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update((t or "").encode().lower().split())
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert hmm.score_documents(spark.createDataFrame([], DOC), s).count() == 0
    assert hmm.score_documents(spark.createDataFrame([(5, "no training")], DOC).where(hmm.held_out(F.col("doc_id")) | F.lit(True)), s).count() == 1


def test_hmm_recursions():
    """Against sums over all state paths."""
    from itertools import product

    s = hmm.HmmSettings(states=2, own_words=2, endings=2)
    rng = np.random.default_rng(7)
    m = hmm.Hmm.begin(np.full(s.symbols, 1 / s.symbols), s)
    sequences = [rng.integers(0, s.symbols, n) for n in (1, 4, 6, 3, 4)] + [np.zeros(0, int)]
    total, moves, emits = [], np.zeros((2, 2)), np.zeros((s.symbols, 2))
    for x in sequences[:5]:
        paths = {p: m.start[p[0]] * m.emit[x[0], p[0]] * np.prod([m.move[a, b] * m.emit[o, b] for a, b, o in zip(p, p[1:], x[1:])]) for p in product(range(2), repeat=len(x))}
        total.append(math.log10(sum(paths.values())))
        for p, w in paths.items():
            w /= sum(paths.values())
            for a, b in zip(p, p[1:]):
                moves[a, b] += w
            for o, k in zip(x, p):
                emits[o, k] += w
    assert np.allclose(m.log10_likelihoods(sequences, 8)[:5], total)
    _, mv, em = m.expected_counts(sequences, 8)
    assert np.allclose(mv, moves, rtol=1e-3) and np.allclose(em, emits, rtol=1e-3)


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("busy", [1, 64])
def test_simhash(spark, busy):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randrange(1, 14)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "A b"), (n + 3, "a\tB"), (None, "a b")]
    got = {r.doc_id: r for r in near_groups(wide(spark, rows), busy=busy).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    assert [got[i].fp % 2**64 for i, _ in rows] == fps
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    ids = [i if i is not None else 10**9 for i, _ in rows]
    root = groups(len(rows), links)
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, 10**9), ids[k])
    assert [got[i].component_id for i, _ in rows] == [least[root[k]] for k in range(len(rows))]
    assert near_groups(spark.createDataFrame([], DOC)).count() == 0 and fingerprint("x") == brute_fingerprint("x")


@pytest.mark.parametrize("busy", [1, 64])
def test_near_copies_of_the_pipeline(spark, busy):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    rows, family = [], {}
    for f in range(30):
        base = [rng.choice(words) for _ in range(200)]
        for k in range(4):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(200)] = rng.choice(words)
            family[len(rows)] = f
            rows.append((len(rows), " ".join(own)))
    docs = wide(spark, [*rows, (None, "x"), (None, "x"), (900, None), (901, "")])
    kept = drop_near_copies(docs, busy=busy)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 900 in ids and 901 not in ids
    per = Counter(family[i] for i in ids if i in family)
    assert set(per) == set(range(30)) and sum(per.values()) <= 33


@pytest.mark.parametrize("busy", [1, 64])
def test_near_copies_are_all_pairs_of_jaccard_four_fifths(spark, busy):
    rng = random.Random(10)
    rows, n = [], 200
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    for f in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        own = list(base)
        for at in rng.sample(range(0, n, 5), rng.randrange(1, 8)):
            own[at] = f"x{rng.randrange(10**6)}"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(own))]
    rows += [(len(rows) + i, " ".join(["same"] * 4 + [f"tail{i // 2}"])) for i in range(6)]
    sets = [shingles(t) for _, t in rows]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    near = [jaccard(sets[i], sets[i + 1]) for i in range(0, 300, 2)]
    assert sum(0.8 <= j < 0.9 for j in near) > 30 and sum(0.7 <= j < 0.8 for j in near) > 20
    root = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])
    got = sorted(r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, DOC), busy=busy).collect())
    assert got == [i for i in range(len(rows)) if root[i] == i]


def test_near_copies_of_a_busy_shingle(spark):
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join(shared + [f"g{i % 9}-{k}" for k in range(30)] + [f"o{rng.randrange(10**6)}" for _ in range(4)])) for i in range(120)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    root = groups(120, [(a, b) for a in range(120) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    assert len(set(root)) == 9
    for busy in (4, 64):
        assert sorted(r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, DOC), busy=busy).collect()) == sorted(set(root))


def test_urls(spark):
    rules = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow")]
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/71?x", "x://example.com/en/6#a://b", "x://notexample.com/en/7", "x://com/en/", "x://q.org/list", "x://q.org/list?t=1", "x://q.org/free"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string").withColumn("key", F.lit(0)).withColumn("_f", F.lit(0)).withColumn("passes", F.lit(0))
    got = {r.page_id: tuple(r)[1:] for r in filter_urls(pages, rules, F.col("url").contains("?t=1")).collect()}
    assert [got[i] for i in range(4)] == [("", "", None, "allow", False)] * 4
    assert got[4] == ("a.example.com", "/en/71", "example.com/en/7", "allow", False)
    assert got[5] == ("example.com", "/en/6", "com/en/", "block", False)
    assert got[6][2:4] == ("com/en/", "block") and got[7][2:4] == ("com/en/", "block")
    assert got[8] == got[9] == ("q.org", "/list", None, "block", True) and got[10][3] == "allow"
    assert filter_urls(pages.where("false"), rules, F.lit(True)).count() == 0


@pytest.mark.parametrize("inline", [0, 1 << 20])
def test_cascade_is_exact(spark, inline):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    c = BloomCascade(keys, bits_per_key=4, n_hashes=2, keys_per_shard=150, inline_bytes=inline)
    assert len(c.levels) > 2
    assert c.member(keys, "key", "found").where("found <> listed").count() == 0
    assert c.member(spark.createDataFrame([(None,)], "key string"), "key", "found").first().found is False
