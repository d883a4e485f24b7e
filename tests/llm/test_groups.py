"""Near-duplicates, leaks and the pipeline against brute force."""

import random
import re

import corpus_pipeline
import pytest
import xxhash
from cargolens.llm import components, decontaminate, quality, secret_scan, simhash
from pyspark.sql import functions as F

from tests.llm import data
from tests.llm.test_quality import brute as rules
from tests.llm.test_shingles import slow_set


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)])] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints, radius):
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def near_copies(rng, n=4, each=25):
    """Texts with chains of small edits."""
    out = []
    for _ in range(n):
        w = [f"w{rng.randrange(9999)}" for _ in range(400)]
        for _ in range(each):
            w = list(w)
            w[rng.randrange(400)] = f"v{rng.randrange(9999)}"
            out.append(" ".join(w))
    return out


def test_op3_fingerprints_and_components(spark):
    extra = [(20_000 + i, t, "en", None, None, "b", "b", "f", "p", "k") for i, t in enumerate(near_copies(random.Random(2)))]
    rows = data.rows(60) + extra
    docs = spark.createDataFrame(rows, data.SCHEMA).repartition(3)
    prints = [slow_fingerprint(r[1]) for r in rows]
    group = slow_groups(prints, 4)
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least.get(g), r[0]) if x is not None), default=None)
    got = simhash.groups(docs).collect()
    want = [(r[0], p, least[g]) for r, p, g in zip(rows, prints, group, strict=True)]
    assert data.bag((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == data.bag(want)
    assert len(set(group)) < len(rows) - 60  # there are groups
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert data.bag(r.doc_id for r in kept.collect()) == data.bag(least.values())
    assert simhash.groups(data.empty(spark)).count() == 0 and simhash.representatives(data.empty(spark)).count() == 0


def test_op3_masks_cover_every_pair():
    masks = [m % 2**64 for m in simhash.masks(4)]
    rng = random.Random(3)
    for _ in range(20_000):
        change = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & change for m in masks)


@pytest.mark.parametrize("block", [8, 4096])
def test_op3_blocks_lose_no_link(spark, block):
    rng = random.Random(4)
    prints = set()
    for _ in range(5):
        x = rng.getrandbits(64)
        for _ in range(50):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
            prints.add(x)
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, block).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 4 for r in got)
    forest = simhash.Forest()
    for r in got:
        forest.join(r.a, r.b)
    want, found = slow_groups(prints, 4), [forest.find(p) for p in signed]
    assert len(set(zip(want, found, strict=True))) == len(set(want)) == len(set(found))


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(299)] + [(500, 400), (400, 450)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 300)} | {450: 400, 500: 400}


def leaky(rng, items):
    """(text, items it holds): whole, edited and no copies."""
    noise = lambda n: " ".join(f"n{rng.randrange(500)}" for _ in range(n))
    out = [(noise(50), set()), (None, set()), ("", set())]
    for k, t in items.items():
        w = t.split()
        edited = [x if rng.random() > 0.1 else "changed" for x in w]
        del edited[len(w) // 3]
        out += [(f"{noise(30)} {t.upper()}! {noise(9)}", {k}), (f"{noise(5)} {' '.join(edited)} {noise(40)}", {k}), (f"{noise(20)} {' '.join(w[:4])} {noise(20)}", set())]
    return out


def test_op9_finds_copies_and_edits(spark):
    rng = random.Random(7)
    items = {i: " ".join(f"t{i}x{rng.randrange(60)}" for _ in range(30)) for i in range(6)}
    texts = leaky(rng, items)
    rows = [(i, t, "x") for i, (t, _) in enumerate(texts)] + [(99, texts[3][0], "x"), (None, texts[3][0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    bench = spark.createDataFrame([*items.items(), (77, None), (78, ""), (79, "two words")], "item_id long, text string")
    found = decontaminate.leaks(docs, bench, bits=16)
    got = {(r.text, r.item_id) for r in docs.withColumn("k", decontaminate.key_of(F.col("text"))).join(found.withColumnRenamed("key", "k"), "k").collect()}
    assert got == {(t, k) for t, own in texts for k in own}
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert data.bag(r.text for r in clean.collect()) == data.bag(t for t, own in texts if not own)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def slow_score(a, b):
    h, best, end = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0, 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            if h[i + 1][j + 1] > best:
                best, end = h[i + 1][j + 1], j
    return best / (2 * len(a)), end


def test_op9_equals_all_pairs(spark):
    """Every text against every item: a pair counts if it shares a seed and the whole text's best alignment reaches the score."""
    rng = random.Random(11)
    items = {i: [f"t{i % 5}x{rng.randrange(40)}" for _ in range(rng.choice([4, 9, 20, 70, 130]))] for i in range(24)}
    texts = []
    for k in range(120):
        w = [f"n{rng.randrange(300)}" for _ in range(rng.randint(0, 80))]
        for i in rng.sample(range(24), rng.randint(0, 2)):
            keep = rng.choice([1, 0.9, 0.75, 0.6, 0.4])
            at = rng.randint(0, len(w))
            w[at:at] = [x if rng.random() < keep else f"c{k}" for x in items[i]]
        texts.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = decontaminate.leaks(docs, bench)
    got = {(r.doc_id, r.item_id): (round(r.score, 6), r.start) for r in docs.withColumn("key", decontaminate.key_of(F.col("text"))).join(found, "key").collect()}
    grams = lambda w: set(zip(w, w[1:], w[2:], strict=False))
    want = {}
    for d, w in enumerate(texts):
        for i, item in items.items():
            if grams(w) & grams(item) and (best := slow_score(item, w))[0] >= decontaminate.SCORE:
                want[d, i] = best
    assert {k: round(s, 6) for k, (s, _) in want.items()} == {k: s for k, (s, _) in got.items()} and 40 < len(want) < 240
    assert all(got[k][1] <= end for k, (_, end) in want.items())  # the passage starts before the best alignment's end


def test_op9_score_is_smith_waterman():
    rng = random.Random(8)
    pairs = [([rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(1, 20))]) for _ in range(200)]
    for (a, b), got in zip(pairs, decontaminate.align(*map(list, zip(*pairs, strict=True))), strict=True):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        assert got == max(map(max, h))


def test_pipeline_stages(spark, tmp_path):
    rows = [r[:5] for r in data.rows(120)]
    rng = random.Random(9)
    rows += [(30_000 + i, t, "en", "s", 1) for i, t in enumerate(near_copies(rng, 2, 5))]
    item = " ".join(f"q{rng.randrange(90)}" for _ in range(30))
    plain = next(r for r in rows if r[1] and len(r[1]) > 2000 and r[2] == "en")
    rows += [(40_000, plain[1] + " " + item, "en", "s", 1), (40_001, "Other " + plain[1][300:] + ' token = "abcdefghijk" end', "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, rules_), (_, near), (_, leaks_), (_, secrets_), (_, pack_) = corpus_pipeline.STAGES

    kept = rules_(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    verdicts = {(r.doc_id, r.text): r.kept for r in quality.judge(docs.withColumn("t", F.col("text"))).withColumnRenamed("t", "text").collect()}
    assert data.bag(tuple(r) for r in kept.collect()) == data.bag(r for r in rows if verdicts[r[0], r[1]])
    assert not any(rules(r.text)[-1] for r in kept.collect())

    once = near(spark, kept, str(tmp_path))
    texts = kept.collect()
    # The stage's contract: five-word shingles and a Jaccard similarity of 0.8.
    sets_ = [slow_set(r.text) for r in texts]
    up = list(range(len(texts)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i, a in enumerate(sets_):
        for j in range(i):
            if a == sets_[j] or len(a & sets_[j]) >= 0.8 * len(a | sets_[j]):
                up[find(i)] = find(j)
    group = [find(i) for i in range(len(texts))]
    least = {g: min((r.doc_id is None, r.doc_id or 0) for r, h in zip(texts, group, strict=True) if h == g) for g in set(group)}
    assert data.bag((r.doc_id is None, r.doc_id or 0) for r in once.collect()) == data.bag(least.values()) and len(least) < len(texts)

    clean = leaks_(spark, once, str(tmp_path))
    assert {r.doc_id for r in once.collect()} - {r.doc_id for r in clean.collect()} <= {40_000}
    assert all(item not in r.text for r in clean.collect())

    masked = secrets_(spark, clean, str(tmp_path))
    assert masked.columns == docs.columns and masked.count() == clean.count()
    assert all("abcdefghijk" not in r.text for r in masked.collect())
    assert all(r.n_chars == len(r.text) for r in masked.where("text like '%[SECRET]%'").collect())

    packed = pack_(spark, masked, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in masked.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda found: data.bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    assert key(whole) == key(packed)
    assert secret_scan.RULES


def test_pipeline_of_no_rows_and_of_clashing_columns(spark, tmp_path):
    names = ["row", "key", "sid", "uid", "blob", "found", "kept", "ref", "item", "ids"]
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    long_ = " ".join(f"w{i * i % 977}" for i in range(200))
    rows = [(i, t, "en", None, 1, *names) for i, t in enumerate([long_, long_, None, "", long_ + " more words", long_[::-1] + ' password = "abcdefgh1"'])]
    bench = spark.createDataFrame([(1, "q r s t u v w x y z")], "item_id long, text string")
    for k, some in enumerate(([], rows)):
        at = f"{tmp_path}/{k}"
        spark.createDataFrame(some, fields).write.parquet(f"{at}/documents.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
            assert all(r[n] == n for r in docs.collect() for n in names)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
        assert {r.doc_id for r in packed} == ({0, 5} if some else set())


def test_op9_finds_edited_copies_in_any_number(spark):
    """Each fourth word changed: few trigrams survive, and those stand in all the copies."""
    rng = random.Random(13)
    items = {i: [f"t{i}x{k}" for k in range(40)] for i in range(3)}
    noise = lambda: " ".join(f"n{rng.randrange(5000)}" for _ in range(90))
    copies = [(i, f"{noise()} {' '.join('changed' if k % 4 == 3 else x for k, x in enumerate(items[i]))} {noise()}") for i, n in ((0, 8), (1, 9), (2, 200)) for _ in range(n)]
    copies.append((2, " ".join(items[2])))
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(copies)], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"), bits=16)
    got = docs.withColumn("key", decontaminate.key_of(F.col("text"))).join(found, "key").select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == [(k, i) for k, (i, _) in enumerate(copies)]
