"""Secrets and personal data against plain regular expressions."""

import hashlib
import random
import re
import time
from pathlib import Path

import duckdb
from cargolens.functions.staging import shared_dir
from cargolens.llm import pii, secret_scan, shingles
from cargolens.llm.common import matches, table
from pyspark.sql import functions as F

from tests.llm import data

SECRET = {"assign": r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m[0])
    return {
        "assign": lambda: len(m[2]) >= 8,
        "access": lambda: len(m[0]) >= 16,
        "hex": lambda: len(m[0]) >= 32,
        "email": lambda: True,
        "ip": lambda: all(int(x.lstrip("0") or "0") <= 255 if len(x.lstrip("0")) < 4 else False for x in m[0].split(".")),
        "card": lambda: 13 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def spans(text, kinds, by):
    found = [(m.start(), k, m.end(), i) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if passes(k, m)]
    return [f"{k}:{s}:{e}" for s, k, e, i in sorted(found, key=lambda f: (f[0], f[3]) if by == "start" else (f[3], f[0]))]


def digest(text, kinds, by):
    return hashlib.sha256(",".join(spans(text, kinds, by)).encode()).hexdigest()


def query(spark, tmp_path, f, docs):
    docs.drop("blob", "base", "fp", "piece", "key").write.parquet(f"{tmp_path}/documents.parquet")
    return f(spark, str(tmp_path))


def test_op1_matches_plain_search(spark, tmp_path):
    docs = data.documents(spark)
    found = query(spark, tmp_path, secret_scan.op1_secret_scan, docs).collect()
    want = [(r[0], digest(r[1], SECRET, "start")) for r in data.rows()]
    assert data.bag((r.doc_id, r.base_sha256) for r in found) == data.bag(want)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert data.bag(map(tuple, found)) == data.bag(con.execute(secret_scan.OP1_SQL).fetchall())
    assert sum(r.n_assign for r in found) == sum(s.startswith("assign") for r in data.rows() for s in spans(r[1], SECRET, "start"))


def test_op1_scans_only_what_the_ledger_lacks(spark):
    docs = data.documents(spark)
    half = docs.where("doc_id % 2 = 0")
    _, ledger = secret_scan.scan_versions(half)
    found, new = secret_scan.scan_versions(docs, ledger)
    blobs = {r[0] for r in docs.select(secret_scan.blob_of(F.col("text"))).collect()}
    old = {r.blob for r in ledger.collect()}
    assert {r.blob for r in new.collect()} == blobs - old
    whole, _ = secret_scan.scan_versions(docs)
    key = lambda rows: data.bag((r.doc_id, r.found) for r in rows)
    assert key(found.collect()) == key(whole.collect())
    rules = (*secret_scan.RULES[:1], secret_scan.Rule("hex", 2, "[0-9a-f]{40,}"))
    _, newer = secret_scan.scan_versions(half, ledger, rules)
    assert {a.rule for r in newer.collect() for a in r.applied} == {"hex"}


def test_op1_redacts_and_keeps_columns(spark):
    docs = data.documents(spark)
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text like '%AKIA%'").count() == 0
    untouched = {r[1] for r in data.rows() if r[1] and not spans(r[1], SECRET, "start")}
    assert untouched <= {r.text for r in out.collect()}
    assert secret_scan.redact(data.empty(spark)).count() == 0


def test_op10_matches_plain_search(spark, tmp_path):
    docs = data.documents(spark)
    found = query(spark, tmp_path, pii.op10_pii, docs).collect()
    want = [(r[0], digest(r[1], PERSONAL, "kind")) for r in data.rows()]
    assert data.bag((r.doc_id, r.base_sha256) for r in found) == data.bag(want)


def test_op10_learns_contexts(spark):
    seeds = [(i, f"reach: +49 30 12345{i:03d} now. filler words here of no account", None) for i in range(9)]
    unseen = [(100, "please reach: KX-8812745 today", None), (101, "of 1234567 things", None)]
    docs = spark.createDataFrame([*seeds, *unseen], "doc_id long, text string, base string")
    out = {r.doc_id: r.context for r in pii.extract(docs).collect()}
    text = unseen[0][1]
    assert [text[c.start : c.end] for c in out[100]] == ["KX-8812745"]
    assert out[101] == [] and all(out[i] == [] for i in range(9))


def labelled_corpus(rng, n=400):
    """(id, text) rows and, for each id, the identifiers that no base rule finds: behind labels that also stand in prose, or before one."""
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, hidden = [], {}
    for i in range(n):
        w = rng.choices(plain, k=rng.randint(40, 90))
        at = rng.randrange(5, 30)
        ip, code = ".".join(str(rng.randrange(256)) for _ in range(4)), f"{rng.choice('XYZ')}K-{rng.randrange(10**6, 10**7)}"
        kind = i % 8
        if kind == 0:
            w[at:at] = ["terminal", ip]  # a seed
        elif kind == 1:
            w[at:at] = ["terminal", code]  # to be found on the left word's word
            hidden[i] = [code]
        elif kind == 2:
            w[at:at] = [f"{rng.choice('abc')}{i}@mail{i % 7}.org", "replied,"]
        elif kind == 3:
            w[at:at] = [code, "replied,"]  # on the right word's word
            hidden[i] = [code]
        elif kind == 4:
            w[at:at] = ["terminal", "was", "off"]
        elif kind == 5:
            w[at:at] = [f"{rng.randrange(10**7)}"]  # a number in prose
        elif kind == 6:
            w[at:at] = ["terminal", "300.1.1.1"]  # fails its check
        rows.append((i, " ".join(w), "clash", "clash", "clash"))
    return rows, hidden


def slow_patterns(rows, rounds, support, lift):
    """Confidences by plain Python: tokens by split, matches by re."""
    graph, total, words, found = {}, {}, 0, 0
    for text in {t for _, t, *_ in rows}:
        spans_ = [(m.start(), m.end(), m[0], k, passes(k, m)) for k, p in PERSONAL.items() for m in re.finditer(p, text) if k != "card" or len(re.sub("[^0-9]", "", m[0])) >= 13]
        toks = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^ \t-\r]+", text)]
        beside = lambda i: toks[i][2].lower() if 0 <= i < len(toks) and not re.search("[0-9@]", toks[i][2]) else ""
        for a, z, word, _, good in spans_:
            i = next(i for i, t in enumerate(toks) if t[0] <= a < t[1])
            j = next(i for i, t in enumerate(toks) if t[0] <= z - 1 < t[1])
            for side, n in (("left", beside(i - 1)), ("right", beside(j + 1))):
                graph.setdefault((side, n, word), [0, set()])[1].add("seed" if good else "bad")
                graph[side, n, word][0] += 1
        for i, (a, z, word) in enumerate(toks):
            word = word.strip(pii.EDGES)
            shaped = len(re.findall("[0-9]", word)) >= 5 or re.search("[^@]@[^@]", word)
            if shaped and not any(s < z and a < e for s, e, *_ in spans_):
                for side, n in (("left", beside(i - 1)), ("right", beside(i + 1))):
                    graph.setdefault((side, n, word), [0, set()])[0] += 1
    for _, t, *_ in rows:
        for w in t.lower().split():
            total[w] = total.get(w, 0) + 1
            words += 1
    graph = {k: v for k, v in graph.items() if k[1]}
    label = {}
    for (_, _, w), (_, kinds) in graph.items():
        label.setdefault(w, set()).update(kinds)
    found = sum(n for (s, _, _), (n, _) in graph.items() if s == "left")
    patterns = {}
    for (s, n, w), (count, _) in graph.items():
        patterns.setdefault((s, n), [0, []])[0] += count
        patterns[s, n][1].append(w)
    patterns = {p: ws for p, (count, ws) in patterns.items() if count >= total.get(p[1], 0) * min(0.5, lift * found / words)}
    fixed = lambda w, x: 1.0 if "seed" in label[w] else 0.0 if "bad" in label[w] else x
    score = {w: fixed(w, 0.0) for ws in patterns.values() for w in ws}
    for _ in range(rounds):
        good = {p: sum(score[w] for w in ws) for p, ws in patterns.items()}
        conf = {p: good[p] / len(ws) if good[p] >= support else 0.0 for p, ws in patterns.items()}
        score = {w: fixed(w, max(conf[p] for p, ws in patterns.items() if w in ws)) for w in score}
    return conf


def test_op10_scores_and_rediscovers(spark):
    rows, hidden = labelled_corpus(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, row string, tokens string").repartition(4)
    annotated = table(pii.annotate(docs), "test-annotated")
    for lift in (2, 20):
        got = {(r.side, r.neighbour): round(r.confidence, 9) for r in pii.patterns(pii.occurrences(annotated), docs, lift=lift).collect()}
        want = {p: round(c, 9) for p, c in slow_patterns(rows, pii.ROUNDS, pii.SUPPORT, lift).items()}
        assert got == want and any(0 < c < 1 for c in got.values())
    found = pii.extract(docs, confident=0.4, lift=2)
    assert found.columns == ["doc_id", "row", "tokens", "base", "context"]
    right = wrong = 0
    for r in found.collect():
        text = rows[r.doc_id][1]
        cut = [text[c.start : c.end] for c in r.context]
        right += sum(c in hidden.get(r.doc_id, []) for c in cut)
        wrong += sum(c not in hidden.get(r.doc_id, []) for c in cut)
    assert right == sum(map(len, hidden.values())) == 100 and wrong == 0  # recall and precision 1


def test_op10_time_is_linear_in_the_text(spark):
    mails = " ".join(f"a{i}@b{i}.org" for i in range(32_000))
    docs = spark.createDataFrame([(1, mails), (2, "x" * 300_000), (3, "9." * 100_000), (4, "word " * 60_000 + "12345")], "doc_id long, text string")
    began = time.perf_counter()
    rows = docs.transform(pii.annotate).select("row.doc_id", F.size(F.filter("base", lambda b: b["good"])).alias("n"), F.size("tokens").alias("t")).collect()
    assert {r.doc_id: (r.n, r.t) for r in rows} == {1: (32_000, 32_000), 2: (0, 0), 3: (25_000, 1), 4: (0, 1)}
    assert time.perf_counter() - began < 30


def test_op1_findings_follow_the_rules_in_force(spark):
    text = "x " + "ab12" * 9 + " and " + "cd34" * 11 + " password=abcdefgh12"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "plain")], "doc_id long, text string")
    old = (secret_scan.RULES[0], secret_scan.Rule("hex", 1, "[0-9a-f]{32,}+"))
    new = (secret_scan.RULES[0], secret_scan.Rule("hex", 2, "[0-9a-f]{40,}+"), secret_scan.Rule("word", 1, "plain"))
    first, ledger = secret_scan.scan_versions(docs, rules=old)
    spans_ = lambda df: {r.doc_id: [(s.rule, s.version, text[s.start : s.end][:4]) for s in r.found] for r in df.collect()}
    assert spans_(first)[1] == [("hex", 1, "ab12"), ("hex", 1, "cd34"), ("assign", 1, "pass")]
    second, more = secret_scan.scan_versions(docs, ledger, new)
    assert spans_(second) == {1: [("hex", 2, "cd34"), ("assign", 1, "pass")], 2: [("hex", 2, "cd34"), ("assign", 1, "pass")], 3: [("word", 1, text[:4])]}
    assert {(a.rule, a.version) for r in more.collect() for a in r.applied} == {("hex", 2), ("word", 1)}
    # A third run scans nothing, and going back to the old rules gives the old findings.
    both = table(ledger.unionByName(more), "test-ledger")
    again, none = secret_scan.scan_versions(docs, both, new)
    assert none.count() == 0 and spans_(again) == spans_(second)
    assert spans_(secret_scan.scan_versions(docs, both, old)[0]) == spans_(first)


def test_no_rows(spark):
    assert secret_scan.scan_versions(data.empty(spark))[0].count() == 0
    assert pii.extract(data.empty(spark)).count() == 0


def test_matches_of_many(spark):
    text = "ab1" * 700
    got = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), "[0-9]").alias("m")).first().m
    assert [(m.start, m.end) for m in got] == [m.span() for m in re.finditer("[0-9]", text)]
    assert table(spark.range(3), "x").count() == 3


def test_pipeline_stages_leave_only_tables_that_their_results_read(spark):
    """Names of tables in the shared folder after near-duplicates and masking; few rows move where few have findings."""
    at = Path(shared_dir(spark).removeprefix("file://")) / "cargolens"
    before = set(at.iterdir()) if at.exists() else set()
    docs = data.documents(spark, 40)
    kept, clean = shingles.representatives(docs), secret_scan.redact(docs)
    assert {p.name.rsplit("-", 1)[0] for p in set(at.iterdir()) - before} == {"sketched", "shingle-links", "rest-of-groups", "ledger"}
    assert 0 < kept.count() < docs.count() == clean.count()
