"""URL filter, language identification and language-model scores."""

import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as public
from cargolens.llm import language, lm_score, url_filter
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import data

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.EXAMPLE.NET/en/1?q#f", "http://net", "http://net/", "x://a..net/p", "x://net./p", "http://example.com/de/x#y", "http://example.community/de/", "http://Ä.org/fr/", "http://a.b.c.org/fr", "a://b://c.net/x", "http://example.net?/en/", "http://example.net/en", "http://" + "a." * 5000 + "net/", "\nhttp://example.net/en/\n"]


def test_op6_against_sql(spark, tmp_path):
    rows = [(i, u, "h") for i, u in enumerate([*URLS, URLS[4], None])] + [(None, URLS[4], "h")]
    spark.createDataFrame(rows, "page_id long, url string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op6_url_filter(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert data.bag(map(tuple, got)) == data.bag(con.execute(url_filter.OP6_SQL).fetchall())
    assert len(got) == len(rows)


def test_op6_many_nested_rules(spark):
    rng = random.Random(4)
    hosts = [".".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(40)]
    paths = ["/", *("/" + "/".join(rng.choices("xy", k=rng.randint(1, 3))) for _ in range(30))]
    rules = {(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(120)}
    urls = [(".".join(rng.choices("abc", k=rng.randint(1, 4))), rng.choice(["", "/", "/x", *(p + rng.choice(["", "/", "y/z"]) for p in paths)])) for _ in range(800)]
    frame = spark.createDataFrame(urls, "host string, path string")
    listed = spark.createDataFrame([(v, h, p) for (h, p), v in rules.items()], "verdict string, host string, path string")
    got = {(r.host, r.path): (r.rule, r.verdict) for r in url_filter.judge(frame, listed, ranges=7).collect()}
    for h, p in set(urls):
        fits = [(len(rh + rp), len(rh), rh + rp, v) for (rh, rp), v in rules.items() if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        assert got.get((h, p)) == (max(fits)[2:] if fits else None)
    assert url_filter.judge(frame, listed.limit(0)).count() == 0 and url_filter.judge(frame.limit(0), listed).count() == 0


def test_op5_held_out_accuracy(spark):
    got = language.op5_language(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and len(got) == len(docs)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_op5_odd_rows(spark, tmp_path):
    data.documents(spark).drop("blob", "base", "fp", "piece", "key").withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op5_language(spark, str(tmp_path)).collect()
    assert len(got) == len(data.rows())
    assert {r.lang_pred for r in got if r.doc_id in (10_000, 10_001, 10_002, 10_007, 10_008)} == {"und"}
    assert language.train(data.empty(spark), F.col("doc_id")) is None
    assert {r.lang_pred for r in language.predict(data.documents(spark), None).collect()} == {"und"}


def test_op5_features_of_long_texts():
    text = "".join(random.Random(2).choices("abc é1\n", k=5000))
    old = language.STRETCH
    try:
        language.STRETCH = 37
        some = language.presence([text, "", "xyz"])
    finally:
        language.STRETCH = old
    whole = language.presence([text, "", "xyz"])
    assert (some[0] == whole[0]).all() and some[1].tolist() == whole[1].tolist() == [True, False, True]


def small_network(rng, n=23, width=3):
    counts = rng.integers(0, 200, n)
    tree = lm_score.tree_of(counts)
    weights = lm_score.start(tree, width).astype(np.float64)
    return lm_score.Network(weights + rng.normal(0, 0.3, weights.shape), tree), counts


def slow_log(net, ids, at, token):
    """The log-probability of a token at a place, by walking down its path."""
    width = net.embed.shape[1]
    beside = [at + d for d in (-2, -1, 1, 2)]
    h = [math.tanh(net.shift[j] + sum(net.embed[ids[p]][j] * net.places[k][j] for k, p in enumerate(beside))) for j in range(width)] + [1.0]
    out = 0.0
    for d in range(net.tree.depth[token]):
        turn = net.tree.signs[d][token] * sum(a * b for a, b in zip(net.nodes[net.tree.nodes[d][token]], h, strict=True))
        out -= math.log1p(math.exp(-turn))
    return out


def test_op4_tree_gives_the_counts_shares():
    rng = np.random.default_rng(3)
    for n in (2, 3, 50):
        counts = rng.integers(0, 1000, n)
        tree = lm_score.tree_of(counts)
        net = lm_score.Network(lm_score.start(tree, 4) * np.r_[np.zeros(4), 1], tree)  # biases alone
        ids = np.array([n, n, 0, n, n])
        for t in range(n):
            assert abs(math.exp(slow_log(net, ids, 2, t)) - (counts[t] + 1) / (counts + 1).sum()) < 1e-5


def test_op4_probabilities_and_gradients():
    rng = np.random.default_rng(1)
    net, counts = small_network(rng)
    n = len(counts)
    rows = [rng.integers(0, n, k).astype("<u2").tobytes() for k in (9, 0, 1, 6)]
    ids, places, each = lm_score.joined(rows, n)
    assert each.tolist() == [9, 0, 1, 6] and (np.delete(ids, places) == n).all() and ids[places].tolist() == np.frombuffer(b"".join(rows), "<u2").tolist()
    logs = net.step(ids, places)
    assert np.allclose(logs, [slow_log(net, ids, p, ids[p]) for p in places], atol=1e-5)
    for p in places[:4]:  # the probabilities of all tokens add up to 1
        total = 0.0
        for t in range(n):
            other = ids.copy()
            other[p] = t
            total += math.exp(net.step(other, np.array([p]))[0])
        assert abs(total - 1) < 1e-5
    made = []
    net._learn = lambda *x: made.append(net.gradient(*x))
    net.step(ids, places, learn=True)
    some = [(i, j) for i in range(len(net.weights)) for j in range(net.weights.shape[1]) if (i, j) and made[0][i, j]]
    for i, j in rng.permutation(some)[:60].tolist() + [[len(net.weights) - 1, 0], [len(net.weights) - 3, 1]]:
        was, e = net.weights[i, j], 1e-3
        net.weights[i, j] = was + e
        up = net.step(ids, places).mean()
        net.weights[i, j] = was - e
        down = net.step(ids, places).mean()
        net.weights[i, j] = was
        assert abs((up - down) / (2 * e) - made[0][i, j]) < 1e-3


def test_op4_frequent_turns_are_not_gathered(monkeypatch):
    """Most turns are at frequent nodes and come from products of matrices; values and gradients are those of a walk down each path."""
    rng = np.random.default_rng(5)
    n = 3000
    counts = (2e6 / np.arange(1, n + 1)).astype(np.int64)
    tree = lm_score.tree_of(counts)
    weights = lm_score.start(tree, 3).astype(np.float64)
    net = lm_score.Network(weights + rng.normal(0, 0.3, weights.shape), tree)
    rows = [rng.choice(n, k, p=counts / counts.sum()).astype("<u2").tobytes() for k in (900, 0, 1, 600)]
    ids, places, _ = lm_score.joined(rows, n)
    gathered, plain = [], lm_score.rows_at
    monkeypatch.setattr(lm_score, "rows_at", lambda array, i, out=None: (gathered.append(len(i) if array is net.nodes else 0), plain(array, i, out))[1])
    logs = net.step(ids, places)
    turns = tree.depth[ids[places]].sum()
    assert 0 < sum(gathered) < turns / 3, (sum(gathered), turns)
    some = np.append(rng.choice(places, 200, replace=False), places[np.argsort(tree.depth[ids[places]])[-20:]])
    assert np.allclose(logs[np.searchsorted(places, some)], [slow_log(net, ids, p, ids[p]) for p in some], atol=1e-9)
    made = []
    net._learn = lambda *x: made.append(net.gradient(*x))
    for learn in (True, True):  # a second step in the same memory gives the same
        assert np.allclose(net.step(ids, places, learn=learn), logs, atol=1e-12)
    assert np.array_equal(made[0], made[1])
    slow = np.zeros_like(net.nodes)
    for p in places.tolist():
        h = np.tanh(net.shift + sum(net.embed[ids[p + d]] * net.places[k] for k, d in enumerate((-2, -1, 1, 2))))
        path = tree.nodes[: tree.depth[ids[p]], ids[p]]
        sign = tree.signs[: len(path), ids[p]]
        slow[path] += (sign / (1 + np.exp(sign * (net.nodes[path] @ np.append(h, 1)))))[:, None] * np.append(h, 1)
    assert np.allclose(made[0][n + 1 : n + 1 + len(slow)], slow / len(places), atol=1e-12)
    moved = np.flatnonzero(np.abs(made[0][:n, :3]).max(axis=1))
    for i, j in [(i, j) for i in moved[[0, 1, 2, 50, -1]] for j in range(3)] + [(len(weights) - 1, 1), (len(weights) - 4, 2)]:
        was, e = net.weights[i, j], 1e-5
        net.weights[i, j] = was + e
        up = net.step(ids, places).mean()
        net.weights[i, j] = was - e
        down = net.step(ids, places).mean()
        net.weights[i, j] = was
        assert abs((up - down) / (2 * e) - made[0][i, j]) < 1e-8


def test_op4_scores_documents(spark):
    path, ranks = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
    docs = data.documents(spark, 40).withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("row", F.lit("clash"))
    rows = data.rows(40)
    rounds = lm_score.rounds_of(0)
    ids = lm_score.encoded(docs, path, ranks, rounds)
    lib = Tokenizer.from_file(path)
    tokens_ = [lib.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    counts = lm_score.counts_of(ids, lib.get_vocab_size())
    assert counts.tolist() == np.bincount([t for r in tokens_ for t in r], minlength=lib.get_vocab_size()).tolist()
    tree = lm_score.tree_of(counts)
    before = lm_score.start(tree)
    weights = lm_score.train(ids, tree, rounds)
    net = lm_score.Network(weights, tree)
    edge = [lib.get_vocab_size()] * 2

    def slow(t):
        row = [*edge, *t, *edge]
        return sum(slow_log(net, row, i + 2, x) for i, x in enumerate(t))

    found = lm_score.score(ids, tree, weights)
    assert found.columns == [c for c in docs.columns if c != "text"] + ["n_tokens", "log_likelihood", "mean_log_likelihood"]
    got = found.collect()
    near = lambda x: round(x, 1)  # noqa: E731  sums of single-precision turns
    assert data.bag((r.doc_id, r.n_tokens) for r in got) == data.bag((r[0], len(t)) for r, t in zip(rows, tokens_, strict=True))
    short = {(r[0], len(t)): slow(t) for r, t in zip(rows, tokens_, strict=True) if len(t) < 400}
    assert len(short) > 20
    for r in got:
        if (r.doc_id, r.n_tokens) in short:
            assert abs(r.log_likelihood - short[r.doc_id, r.n_tokens]) < 1e-3 * (1 + r.n_tokens), near(r.log_likelihood)
        assert r.mean_log_likelihood is None if r.n_tokens == 0 else abs(r.mean_log_likelihood - r.log_likelihood / r.n_tokens) < 1e-9
    first = lm_score.score(ids, tree, before).agg(F.sum("log_likelihood")).first()[0]
    assert sum(r.log_likelihood for r in got) > first + 1000  # training helps
    assert lm_score.rounds_of(1 << 40) > lm_score.rounds_of(1 << 30) > rounds
    assert lm_score.scored(data.empty(spark)).count() == 0


def test_op4_trains_on_every_place(spark):
    """Weights after one round and one step are those of a step over all places."""
    n = 40
    rows = [np.arange(i, i + k, dtype="<u2") % n for i, k in ((0, 9), (3, 1), (5, 0), (11, 30))]
    ids = spark.createDataFrame([(0, bytearray(r.astype("<u2").tobytes())) for r in rows], "part int, ids binary").coalesce(1)
    tree = lm_score.tree_of(np.bincount(np.concatenate(rows), minlength=n))
    net = lm_score.Network(lm_score.start(tree), tree)
    joined, places, _ = lm_score.joined([r.astype("<u2").tobytes() for r in rows], n)
    assert len(places) == 40
    net.step(joined, places, learn=True)
    assert np.allclose(lm_score.train(ids, tree, 1), net.weights, atol=1e-6)


def slow_kernel_model(texts, names):
    """Scores by dictionaries of n-grams and one ridge system, without the Nyström map's shortcuts."""
    grams = []
    for t in texts:
        clean = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        grams.append({clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1)})
    k = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    return k


def test_op5_kernel_and_ridge_by_brute_force():
    """With all texts as landmarks the Nyström map gives the exact kernel, and the fit is kernel ridge regression."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcde ", k=40)) if i % 2 else "".join(rng.choices("defgh ", k=40)) for i in range(40)]
    names = np.array(["x" if i % 2 else "y" for i in range(40)])
    k = slow_kernel_model(texts, names)
    x, good = language.presence(texts)
    own = language.kernel(x, language.unit(x).T)
    assert good.all() and np.abs(own - k).mean() < 0.02 and np.corrcoef(own.ravel(), k.ravel())[0, 1] > 0.99  # features are hashed to 2^12 places
    model = language.fit(x, names)
    # Centred kernel ridge regression in its dual form; both languages have equal shares.
    n = len(texts)
    centre = np.eye(n) - 1 / n
    y = np.where(names[:, None] == np.array(["x", "y"])[None, :], 1.0, -1.0)
    exact = own.astype(np.float64)
    kc = centre @ exact @ centre
    alpha = np.linalg.solve(kc + language.RIDGE * np.eye(n), y - y.mean(0))
    want = kc @ alpha + y.mean(0)
    assert np.abs(model.scores(x) - want).max() < 1e-2
