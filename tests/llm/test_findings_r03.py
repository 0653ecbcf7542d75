"""What the review of round 3 found in the training-data operators."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm.queries import op10_url_filter
from spanforge.llm.simhash import fingerprint_pairs, near_groups, set_fingerprint, shingle_set


def test_url_rules_are_the_contract(spark, tmp_path):
    """Each rule's word, on its host, a subdomain and where a longer rule decides."""
    urls = {
        "x://a.com/en/1": ("com/en/", "block"), "x://example.com/en/71": ("example.com/en/7", "allow"), "x://example.com/en/6": ("com/en/", "block"),
        "x://net/de/": ("net/de/", "allow"), "x://A.Example.NET/de/7?utm_source=a": ("net/de/", "allow"), "x://example.net/de/81": ("example.net/de/8", "block"), "x://b.org/es/": ("org/es/", "block"),
    }
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in op10_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())


def test_components_are_never_broadcast(spark, capsys):
    """Joins of what grows with the documents: under the bound for broadcasts too, the driver gathers none of it."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four "), F.col("id") % 7).alias("text"))
    groups = near_groups(docs)
    groups.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert {r.doc_id % 7 for r in groups.select("component_id").distinct().withColumnRenamed("component_id", "doc_id").collect()} <= set(range(7))


def test_pipeline_takes_pairs_from_fingerprints(spark):
    """Of sets whose SimHash is at most three bits apart each gets a pair that joins it to the others; the sets' own check follows."""
    rng = random.Random(3)
    base = [rng.randrange(-(2**62), 2**62) for _ in range(400)]
    sets = [np.unique(np.array([*base[: 400 - k], *(rng.randrange(2**62) for _ in range(k))], "i8")) for k in (0, 0, 1, 2, 399)]
    fps = [set_fingerprint(s) for s in sets]
    links = {(a, b) for a in range(5) for b in range(a + 1, 5) if (fps[a] % 2**64 ^ fps[b] % 2**64).bit_count() <= 3}
    pairs = {(r.a, r.b) for r in fingerprint_pairs(spark.createDataFrame(list(enumerate(fps)), "id long, fp long")).collect()}
    assert (0, 1) in pairs and pairs <= links and {b for _, b in links} == {b for _, b in pairs}
    text = " ".join(f"w{i}" for i in range(50))
    want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in shingle_set(text).view("u8")) > len(shingle_set(text)))
    assert set_fingerprint(shingle_set(text)) % 2**64 == want


def test_components_are_worked_out_once_between_near_copies(spark, monkeypatch):
    """Once for the pairs verified first and once with the rest added to their stars; it was three times, each from all links."""
    from spanforge.llm import simhash as sh

    runs, real = [], sh.connected_components
    monkeypatch.setattr(sh, "connected_components", lambda edges: runs.append(1) or real(edges))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:-1], "x"]), "quite another text of six words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in sh.drop_near_copies(docs).collect()) == [0, 3] and len(runs) == 2
