"""Quality rules against plain Python."""

import math
import re
from collections import Counter

from cargolens.llm import quality
from pyspark.sql import functions as F

from tests.llm import data


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(w, w[1:], w[2:], strict=False))
    seen = Counter(windows)
    covered = {p for i, x in enumerate(windows) if seen[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_op8_counts(spark):
    got = quality.judge(data.documents(spark)).collect()
    assert data.bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == data.bag((r[0], *brute(r[1])) for r in data.rows())
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(data.empty(spark)).count() == 0


def test_op8_counts_of_small_words(spark):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "b", " ", "  ", "\n", "|"], k=rng.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)


def test_op8_rejects_what_is_far_from_its_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = docs.where("n_chars > 1500").orderBy("doc_id").limit(1).select(F.lit(-1).cast("long").alias("doc_id"), "text", "lang")
    loud = base.select("doc_id", F.upper("text").alias("text"), "lang")
    odd = base.select(F.lit(-2).cast("long").alias("doc_id"), F.regexp_replace("text", " ", "### ").alias("text"), "lang")
    got = {r.doc_id: r for r in quality.judge(docs.select("doc_id", "text", "lang").union(loud).union(odd)).collect()}
    assert not got[-1].kept and not got[-2].kept
    prose = [r for r in docs.collect() if not re.search(r"[|]|!!|[#*$%&]{3}", r.text) and not brute(r.text)[-1]]
    assert all(got[r.doc_id].kept for r in prose) and len(prose) > 500


def test_op8_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    got = spark.range(1).select(quality.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    half = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    assert abs(got - math.sqrt((half(p) + half(q)) / 2)) < 1e-12


def test_op8_judges_no_document_by_words_of_other_languages(spark):
    """Plain prose stays, whatever the number of languages, and where the language is null."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    prose = [r for r in docs.collect() if not re.search(r"[|]|!!|[#*$%&]{3}", r.text) and len(r.text.split()) >= 100 and not brute(r.text)[-1]]
    few = [r for r in prose if r.lang != "en"]
    unnamed = [(r.doc_id, r.text, None if r.lang == "en" or i % 2 else r.lang) for i, r in enumerate(prose)]
    many = [(r.doc_id, r.text, f"{r.lang}{i % 40}") for i, r in enumerate(few)]  # over 100 languages
    for rows in (unnamed, many):
        got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
        assert len(got) == len(rows) > 100 and all(r.kept for r in got)
    assert len({r[2] for r in many}) > 64
    loud = quality.judge(spark.createDataFrame([*unnamed, (-1, prose[0].text.upper(), None)], "doc_id long, text string, lang string")).where("doc_id = -1").first()
    assert not loud.kept


def slow_verdicts(rows):
    """(id, class_distance, word_distance, kept) for (id, text, lang) rows, in plain Python."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    counted = {}
    for _, t, lang in rows:
        if lang is not None and t:
            counted.setdefault(lang, Counter()).update(split(t.lower()))
    usual = {k: sorted(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]) for k, c in counted.items() if c}
    import regex

    def measure(t, lang):
        t = t or ""
        classes = [len(regex.findall(c, t)) for c in quality.CLASSES.values()]
        own = Counter(w.lower() for w in split(t))
        return len(t), classes, len(split(t)), [own[w] for w in usual.get(lang, [])]

    rest = lambda c, n: [x / max(n, 1) for x in (*c, n - sum(c))]
    measured = [measure(t, lang) for _, t, lang in rows]
    sums = {}
    for (_, _, lang), (chars, classes, words, common) in zip(rows, measured, strict=True):
        if words >= 50:
            for ref in {lang if lang in usual else "*", "*"}:
                s = sums.setdefault(ref, [0, [0] * len(classes), 0, [0] * len(common)])
                s[0], s[1], s[2] = s[0] + chars, [a + b for a, b in zip(s[1], classes, strict=True)], s[2] + words
                if ref != "*":
                    s[3] = [a + b for a, b in zip(s[3], common, strict=True)]

    def far(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        half = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return math.sqrt(max(0, (half(p) + half(q)) / 2))

    out = []
    for (i, t, lang), (chars, classes, words, common) in zip(rows, measured, strict=True):
        s = sums.get(lang if lang in usual else "*")
        of_classes = far(rest(classes, chars), rest(s[1], s[0])) if s else None
        of_words = far(rest(common, words), rest(s[3], s[2])) if s and lang in usual else None
        odd = chars >= quality.LEAST_CHARS and (of_classes or 0) > quality.FAR_CLASSES or words >= quality.LEAST_WORDS and (of_words or 0) > quality.FAR_WORDS
        out.append((i, of_classes, of_words, not brute(t)[-1] and not odd))
    return out


def test_op8_verdicts_and_distances(spark):
    rows = [(r[0], r[1], r[2]) for r in data.rows()]
    rows += [(-k, rows[k][1] and (rows[k][1].upper() if k % 2 else rows[k][1].replace(" ", " # ")), rows[k][2]) for k in range(1, 60)]
    names = ["row", "ref", "of", "w", "own", "common", "ref_words", "ref_classes", "word_counts", "class_counts", "hashes", "kept"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names)).repartition(5)
    found = quality.judge(docs)
    assert found.columns == ["doc_id", "lang", *names[:-1], *quality.RESULTS]
    near = lambda x: x is not None and round(x, 9)
    got = [(r.doc_id, near(r.class_distance), near(r.word_distance), r.kept) for r in found.collect()]
    want = [(i, near(a), near(b), k) for i, a, b, k in slow_verdicts(rows)]
    assert data.bag(got) == data.bag(want)
    assert 20 < sum(not r[3] for r in want) < len(rows) - 20
