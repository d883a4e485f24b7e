"""Near-duplicates of the pipeline against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import pytest
from cargolens.llm import shingles, simhash
from pyspark.sql import functions as F

from tests.llm import data


def slow_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)])


def slow_pairs(texts):
    own = [slow_set(t) for t in texts]
    return [(i, j) for i, a in enumerate(own) for j in range(i) if len(a & (b := own[j])) >= 0.8 * len(a | b)]


def slow_kept(ids, texts):
    """Least ids of the groups."""
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in slow_pairs(texts):
        up[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), (True, 0)), (x is None, x or 0))
    return sorted(least.values())


def edited(rng, n=40):
    """Texts of 60 to 400 words, each with copies that have up to 4 % of the words changed: similarities of 0.7 to 1."""
    out = []
    for k in range(n):
        w = [f"k{k}w{rng.randrange(9999)}" for _ in range(rng.randint(60, 400))]
        out.append(" ".join(w))
        for _ in range(3):
            copy = list(w)
            for at in rng.sample(range(len(w)), rng.randint(0, len(w) // 25)):
                copy[at] = "changed"
            out.append(" ".join(copy).title())
    return out


@pytest.mark.parametrize("block", [4, 512])
def test_pipeline_finds_pairs_of_similarity_four_fifths(spark, block):
    rng = random.Random(11)
    start = [f"s{rng.randrange(9999)}" for _ in range(100)]
    shared = [" ".join(start + [f"e{i}x{rng.randrange(9999)}" for _ in range(rng.randint(20, 30))]) for i in range(30)]  # a large bucket, most pairs below 0.8
    rows = data.rows(60) + [(20_000 + i, t, "en", None, None, "b", "b", "f", "p", "k") for i, t in enumerate(edited(rng) + shared)]
    docs = spark.createDataFrame(rows, data.SCHEMA).repartition(3)
    kept = shingles.representatives(docs, block=block)
    assert kept.columns == docs.columns
    want = slow_kept([r[0] for r in rows], [r[1] for r in rows])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want
    assert len(want) < len(rows) - 60  # there are groups
    assert data.bag(corpus_pipeline.near_duplicates(spark, docs, "").collect()) == data.bag(kept.collect())
    assert shingles.representatives(data.empty(spark)).count() == 0


def test_pipeline_bands_meet_pairs_of_the_least_similarity():
    """Recall of the bands alone over pairs of 0.8 to 0.82: the chance to miss one is 3e-6."""
    rng, met, n = random.Random(12), 0, 300
    for _ in range(n):
        w = [f"w{rng.randrange(99999)}" for _ in range(229)]
        a, b = " ".join(w), " ".join([*w[:204], *(f"v{x}" for x in range(25))])
        x, y = slow_set(a), slow_set(b)
        assert 0.8 <= len(x & y) / len(x | y) < 0.82
        met += bool(set(shingles.bands(shingles.shingles(a))) & set(shingles.bands(shingles.shingles(b))))
    assert met == n


def test_pipeline_links_by_fingerprints(spark):
    """SimHash buckets alone link all similar texts whose five-word fingerprints differ in few bits, and texts of dissimilar sets never."""
    rng = random.Random(13)
    texts = edited(rng, 30)
    rows = [(i, t) for i, t in enumerate(texts)]
    sketched = shingles.sketched(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("uid", F.col("doc_id")).collect()
    sid, keys = {r.doc_id: r.sid for r in sketched}, {r.doc_id: r["keys"] for r in sketched}
    n = len(simhash.masks(shingles.RADIUS))
    assert all(len(k) == n + shingles.BANDS for k in keys.values())
    prints = [simhash.majority(shingles.shingles(t)) for t in texts]
    near = [(i, j) for i, j in slow_pairs(texts) if (prints[i] ^ prints[j]).bit_count() <= shingles.RADIUS and sid[i] != sid[j]]
    assert len(near) > 5
    assert all(set(keys[i][:n]) & set(keys[j][:n]) for i, j in near)
    alone = spark.createDataFrame([(i, sid[i], keys[i][:n], t) for i, t in rows], "uid long, sid string, keys array<long>, text string")
    links = [tuple(r) for r in shingles.links(alone).collect()]
    similar = {frozenset((sid[i], sid[j])) for i, j in slow_pairs(texts)}
    assert all(frozenset(x) in similar for x in links)
    up = {s: s for s in sid.values()}
    find = lambda s: s if up[s] == s else find(up[s])
    for a, b in links:
        up[find(a)] = find(b)
    assert all(find(sid[i]) == find(sid[j]) for i, j in near)
