"""What SQL can't express, worked out once more by plain loops: the chain, the HMM's score, the whole pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import hmm
from spanforge.llm.toxicity import Linear, ToxicityChain, words_and_stems

P = pytest.importorskip("public_tokenizers")


def test_linear_is_optimal():
    """The fit meets the conditions of the L1 optimum, worked out on the dense, standardised matrix."""
    rng = np.random.default_rng(3)
    x = (rng.random((60, 9)) < 0.3).astype(float)
    dense = rng.random((60, 1))
    y = (x[:, 0] + x[:, 3] + rng.random(60) > 1.1).astype(float)
    rows, columns = np.nonzero(x)
    m = Linear(0.02, 20_000, 0.0).fit(rows, columns, dense, y, 9)
    whole = np.hstack([x, dense])
    p = 1 / (1 + np.exp(-(whole @ m.weights + m.bias)))
    gradient = ((whole - whole.mean(axis=0)) / whole.std(axis=0)).T @ (p - y) / 60
    w = m.weights * whole.std(axis=0)
    assert abs((p - y).mean()) < 1e-6 and (np.abs(gradient) <= 0.02 + 1e-6).all()
    assert np.allclose(gradient[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-6) and 0 < (w != 0).sum() < 10
    assert np.allclose(m.proba(rows, columns, dense, 60), p)


def test_chain_by_loops(spark):
    """Features, out-of-fold columns and probabilities of 50 documents; repeated documents weigh once, empty tables pass."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta", "gamma-ray", "delta9", "vileness", "vilely"][: 4 + 2 * (i % 5 == 0)]) for _ in range(9))) for i in range(50)]
    labels = [(i, int("beta" in t), int("vile" in t)) for i, t in docs]
    table = spark.createDataFrame(docs + docs[:20], "id long, text string").withColumn("p_b", F.lit("x")).withColumn("fold", F.lit(1))
    chain = ToxicityChain(categories=("a", "b"), n_features=40, min_docs=2, iterations=4000, tolerance=0.0, penalty=1e-3)
    chain.fit(table, spark.createDataFrame(labels + labels[:3], "id long, a int, b int"), "id")
    features = {i: set().union(*words_and_stems(t)) for i, t in docs}
    n = Counter(f for own in features.values() for f in own)
    assert set(chain.names) <= {f for f in n if n[f] >= 2}
    fold = {r.id: r.f for r in spark.range(50).select("id", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)).cast("int").alias("f")).collect()}
    at = [sorted(chain.names[f] for f in features[i] if f in chain.names) for i, _ in docs]

    def fit(some, y, dense):
        rows, columns = np.repeat(np.arange(len(some)), [len(at[i]) for i in some]), np.array([c for i in some for c in at[i]])
        return Linear(1e-3, 4000, 0.0).fit(rows, columns, dense[some], y[some], len(chain.names))

    def says(m, i, dense):
        return 1 / (1 + math.exp(-(m.bias + sum(m.weights[c] for c in at[i]) + float(np.dot(m.weights[len(chain.names):], dense[i])))))

    none = np.zeros((50, 0))
    y = [np.array([row[k] for row in labels], float) for k in (1, 2)]
    ahead = np.zeros((50, 1))
    for f in range(4):
        m = fit([i for i in range(50) if fold[i] != f], y[0], none)
        for i in range(50):
            if fold[i] == f:
                ahead[i] = says(m, i, none)
    first, second = fit(range(50), y[0], none), fit(range(50), y[1], ahead)
    got = {r.id: (r.p_a, r.p_b, r.is_b) for r in chain.transform(table).collect()}
    for i in range(50):
        a = says(first, i, none)
        b = says(second, i, {i: [a]})
        assert got[i] == pytest.approx((a, b, b > 0.5), abs=1e-6)
    empty = table.where("false")
    assert ToxicityChain(categories=("a", "b")).fit(empty, spark.createDataFrame(labels, "id long, a int, b int"), "id").transform(empty).count() == 0
    assert chain.transform(empty).columns == ["id", "text", "fold", "p_a", "p_b", "is_a", "is_b"]
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "vilely " * 200_000)], "id long, text string")
    assert sorted(r.is_b for r in chain.transform(odd).collect()) == [False, False, True]


def brute_em(m, sequences):
    """Expected starts, moves and emissions by every path of states."""
    k = len(m.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape)
    for x in sequences:
        paths = {p: m.start[p[0]] * m.emit[x[0], p[0]] * np.prod([m.move[a, b] * m.emit[o, b] for a, b, o in zip(p, p[1:], x[1:])]) for p in product(range(k), repeat=len(x))}
        total = sum(paths.values())
        for p, w in paths.items():
            start[p[0]] += w / total
            for a, b in zip(p, p[1:]):
                move[a, b] += w / total
            for o, b in zip(x, p):
                emit[o, b] += w / total
    return start, move, emit


def test_hmm_score_by_paths(spark):
    """Two passes of Baum-Welch and the final probability over a table, by every path of states."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "a", "cat", "dog", "sat", "ran", "zebra"]) for _ in range(rng.randrange(1, 6)))) for i in range(30)] + [(60, None)]
    s = hmm.HmmSettings(states=2, own_words=2, known_words=4, endings=4, shards=1, smoothing=3.0)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = {i: [*(t or "").encode().split(), b""] for i, t in docs}
    c = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    ranked = sorted((w for w in c if w), key=lambda w: (-c[w], w))
    own = ranked[:2]
    in_class = defaultdict(list)
    for w in ranked[2:]:
        in_class[hmm.ending(w, 4)].append(w)
    symbol = lambda w: 0 if w == b"" else 1 + own.index(w) if w in own else 3 + hmm.ending(w, 4)
    overall = np.array([c[b""], *(c[w] for w in own), *(sum(c[w] for w in in_class[k]) for k in range(4))], float) + 0.5
    overall /= overall.sum()
    train = [[symbol(w) for w in ws] for i, ws in tokens.items() if not held(i)]
    m = hmm.Hmm.begin(overall, s)
    first = brute_em(m, train)
    m = hmm.Hmm.from_counts(*first, overall, s)
    m = hmm.Hmm.from_counts(*brute_em(m, train), overall, s)
    got = {r.doc_id: r.score for r in hmm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), s).collect()}
    for i, ws in tokens.items():
        x = [symbol(w) for w in ws]
        p = sum(m.start[q[0]] * m.emit[x[0], q[0]] * np.prod([m.move[a, b] * m.emit[o, b] for a, b, o in zip(q, q[1:], x[1:])]) for q in product(range(2), repeat=len(x)))
        for w in ws:
            if w and w not in own:
                k = hmm.ending(w, 4)
                p *= (c[w] + 0.5) / (sum(c[v] for v in in_class[k]) + 0.5 * (len(in_class[k]) + 1))
        assert got[i] == pytest.approx(math.log10(p), abs=1e-4)


def test_hmm_long_sequences():
    """A text beyond a batch trains as one sequence: the same counts, whatever the blocks."""
    s = hmm.HmmSettings(states=3, own_words=4, endings=2)
    rng = np.random.default_rng(4)
    m = hmm.Hmm.begin(np.full(s.symbols, 1 / s.symbols), s)
    sequences = [rng.integers(0, s.symbols, n) for n in (200, 7, 64, 65, 1)]
    whole = m.expected_counts(sequences, 1 << 12)
    for batch in (64, 33):
        for a, b in zip(whole, m.expected_counts(sequences, batch), strict=True):
            assert np.allclose(a, b, rtol=1e-3, atol=1e-3)


ENDS = " \t\n\x0b\f\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_repeated_lines(docs):
    where = defaultdict(set)
    for d in docs:
        for x in (d["text"] or "").split("\n"):
            where[x.strip(ENDS).translate(LOW)].add(d["doc_id"])
    top = {k: max(v) for k, v in where.items() if len(k) >= 40 and len(v) >= 5}
    keep = lambda x, i: top.get(x.strip(ENDS).translate(LOW), i) == i
    return [d | {"text": "\n".join(x for x in (d["text"] or "").split("\n") if keep(x, d["doc_id"]))} for d in docs]


def first_of_near_copies(docs):
    def shingles(t):
        w = (t or "").translate(LOW).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(d["text"]) for d in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            either = len(sets[a] | sets[b])
            if root[a] != root[b] and (not either or len(sets[a] & sets[b]) * 5 >= 4 * either):
                root = [root[b] if r == root[a] else r for r in root]
    least = {}
    for r, d in zip(root, docs):
        least[r] = min(least.get(r, d["doc_id"]), d["doc_id"])
    return [d for r, d in zip(root, docs) if d["doc_id"] == least[r]]


def mix(docs):
    """Water-filling down the tree, then prefixes of seeded epochs."""
    words = lambda d: len((d["text"] or "").split())
    number = lambda s: next((int(x) for x in ["".join(c for c in (s or "") if c.isdigit())] if x), -1)
    domain = lambda d: "web" if (n := number(d["source"])) == 0 else "reference" if 1 <= n <= 9 else "forum" if n >= 10 else "other"
    path = lambda d: (domain(d), d["lang"] or "", d["source"] or "")
    weights = [{"web": 8, "reference": 6, "forum": 6, "other": 1}, {"en": 60, "de": 15, "fr": 14, "es": 11}, {}]
    tokens = Counter()
    for d in docs:
        tokens[path(d)] += words(d)
    budget = {(): sum(tokens.values())}
    for depth in range(3):
        for parent in [p for p in budget if len(p) == depth]:
            caps = Counter()
            for leaf, n in tokens.items():
                if leaf[:depth] == parent:
                    caps[leaf[: depth + 1]] += 2 * n
            weight, full = {k: weights[depth].get(k[-1], 1) for k in caps}, set()
            while True:
                rest, open_ = budget[parent] - sum(caps[k] for k in full), sum(w for k, w in weight.items() if k not in full)
                more = {k for k in caps if k not in full and caps[k] * open_ <= rest * weight[k]}
                if not more:
                    break
                full |= more
            budget |= {k: caps[k] if k in full else rest * weight[k] // open_ for k in caps}
    out = []
    for leaf, n in tokens.items():
        epochs, rest = divmod(budget[leaf], n) if n else (0, -1)
        upto = 0
        for d in sorted((d for d in docs if path(d) == leaf), key=lambda d: (hashlib.md5(f"7:{epochs}:{d['doc_id']}".encode()).hexdigest(), d["doc_id"])):
            upto += words(d)
            out += [d] * (epochs + (upto <= rest))
    return out


def test_pipeline_by_loops(spark, tmp_path):
    """run() over documents with toxic ones, shared lines, exact and near copies, nulls, empty and long texts, clashing columns."""
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefghij") + "".join(rng.choice("klmnop") for _ in range(rng.randrange(2, 7)))
    shared = [" ".join(word() for _ in range(12)) + f" shared line {n}" for n in range(4)]
    docs = []
    for i in range(240):
        body = [word() for _ in range(rng.randrange(20, 60))]
        if i % 9 == 4:
            body[3:3] = ["grimvile", "grimvilest", "foulgrot"][: 1 + i % 3] + ["foulgrots"]
        text = " ".join(body) + ("\n" + "\n".join(rng.sample(shared, 2)) if i % 4 == 0 else "")
        if i % 10 == 7:
            text = docs[i - 5]["text"]
        elif i % 10 == 8 and len(docs[i - 6]["text"].split()) > 30:
            near = docs[i - 6]["text"].split(" ")
            near[-2] = "changed"
            text = " ".join(near)
        docs.append({"doc_id": i, "text": text, "lang": ["en", "de", None, "fr"][i % 4], "source": f"src{i % 13}", "n_chars": len(text)})
    docs += [{"doc_id": 300 + n, "text": t, "lang": "en", "source": None, "n_chars": None} for n, t in enumerate([None, "", " \n ", "long " + " ".join(f"w{j}" for j in range(30_000))])]
    spec = "doc_id long, text string, lang string, source string, n_chars long"
    extra = {"gone": 1, "keep": 2, "features": 3}
    spark.createDataFrame([tuple(d.values()) + tuple(extra.values()) for d in docs], spec + ", gone int, keep int, features int").write.parquet(f"{tmp_path}/documents.parquet")
    toxic = lambda d: any(w.startswith(("grimvile", "foulgrot")) for w in (d["text"] or "").split())
    spark.createDataFrame([(d["doc_id"], 1 - int(toxic(d)), int(toxic(d))) for d in docs if d["doc_id"] % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [d for d in docs if not toxic(d)]
    assert 0 < len(left) < len(docs) - 15
    deduped = without_repeated_lines(left)
    assert sum(a["text"] != (b["text"] or "") for a, b in zip(deduped, left)) > 10
    single = first_of_near_copies(deduped)
    assert len(single) < len(deduped) - 10
    mixed = mix(single)
    ranks = corpus_pipeline_ranks()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d in mixed:
        ids = enc.encode_ordinary(d["text"] or "")
        want[d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def corpus_pipeline_ranks():
    from spanforge.llm.bpe import Vocabulary

    return Vocabulary.read(P.path("byte_bpe_multi_50k.tiktoken")).ranks


def test_stages_of_an_empty_table(spark, tmp_path):
    spec = "doc_id long, text string, lang string, source string, n_chars long, id long"
    empty = spark.createDataFrame([], spec)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "bpe" or out.columns == empty.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_parity_bits(spark):
    from spanforge.llm.simhash import parity_bits, parity_distance

    rng = np.random.default_rng(5)
    rows = []
    for n in (0, 1, 60, 70, 200, 1500):
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        b = np.unique(np.r_[a[: int(n * 0.9)], rng.integers(-(2**62), 2**62, n // 7)])
        rows.append((parity_bits(a).tolist(), parity_bits(b).tolist(), len(np.setxor1d(a, b))))
    for r in spark.createDataFrame(rows, "a array<long>, b array<long>, d int").select(parity_distance(F.col("a"), F.col("b")).alias("n"), "d").collect():
        assert r.n <= r.d and (r.d - r.n) % 2 == 0
