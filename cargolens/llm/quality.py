"""Quality rules: word and line counts, and divergence from language references.

The references are learned from the corpus, over all documents: for each language its most common words, and the shares of
character classes and of those words. A document is compared with the reference of its language by Jensen-Shannon distance
(base 2, 0 to 1) over both histograms; one without a language only by its character classes, with those of all languages, as the
words of other languages say nothing about it. Documents too short for a histogram to mean anything are not judged by it.
References are a joined table, one row for each language.

Native: DataFrame functions only.

Defined results: a null text has no words and fails. Rows are never merged: repeated rows, and rows with null or repeated ids,
each get a verdict. Texts of any length are measured whole. Of words that tie in a language's counts the first by name are its common
ones. With a null language, or one without a word in the corpus, word_distance is null. An empty table gives an empty result. Other
columns are kept, whatever their names, but for those with the name of a result column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargolens.llm.common import let, split_words, table

SYMBOLS = r"[#*$%&|<>]"
#: Character classes, besides the rest (letters in lower case, mostly).
CLASSES = {"upper": r"\p{Lu}", "digit": "[0-9]", "blank": r"[\x20\x09-\x0D]", "symbol": SYMBOLS, "point": r"""[.,;:!?'"()\-]"""}
#: Common words to a language.
COMMON = 32
#: A document is judged by its characters from so many on, by its words from so many on.
LEAST_CHARS, LEAST_WORDS = 200, 100
FAR_CLASSES, FAR_WORDS = 0.3, 0.36
ALL = "*"
#: Columns of the result; those of the input with these names are replaced.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def repeat_words(w: Column, hashes: Column) -> Column:
    """Words in windows of three words that occur twice or more. Windows are hashed; only texts with equal hashes sort them."""
    at = lambda i: F.get(w, i)

    def exact(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda a, b: (a["h"] == b["h"]) & (at(a["i"]) == at(b["i"])) & (at(a["i"] + 1) == at(b["i"] + 1)) & (at(a["i"] + 2) == at(b["i"] + 2))
        twice = let(order, lambda s: F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["upto"], p)).alias("n"), (p + 3).alias("upto")), lambda a: a["n"])

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), exact(hashes)).otherwise(F.lit(0))


def measures(documents: DataFrame, common: DataFrame) -> DataFrame:
    """Rows (row, text, lang) with row, ref, counts, class counts, and counts of the common words of their reference; one pass over the texts.

    Each step takes columns that the one before has made, so that nothing is made twice."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rare = "".join(c[1:-1] if c[0] == "[" else c for name, c in CLASSES.items() if name != "blank")
    first = documents.select("row", F.col("lang").alias("of"), split_words(text).alias("w"), lines.alias("lines"), F.length(text).cast("long").alias("chars"), F.regexp_replace(text, f"[^{rare}]++", "").alias("rare"))
    at = lambda i: F.get("w", i)
    hashes = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, at(i + 1), at(i + 2)))
    second = first.select(
        "row",
        "of",
        "w",
        hashes.alias("hashes"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "chars",
        *(F.regexp_count("rare", F.lit(c)).cast("long").alias(f"in_{name}") for name, c in CLASSES.items() if name != "blank"),
        F.lower(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).alias("own"),
    )
    third = second.select(*(c for c in second.columns if c not in ("w", "hashes")), repeat_words(F.col("w"), F.col("hashes")).cast("long").alias("n_repeat_words"))
    either = F.concat(F.lit(" ("), F.array_join(F.transform("common", lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}])", r"\\$1")), "|"), F.lit(")(?= )"))
    joined = third.join(common.withColumn("either", either), F.col("of") == F.col("ref"), "left")
    fourth = joined.withColumn("usual", F.when(F.col("ref").isNotNull(), F.regexp_extract_all("own", "either")).otherwise(F.array().cast("array<string>")))
    counts = F.transform(F.coalesce("common", F.array().cast("array<string>")), lambda c: (F.size("usual") - F.size(F.array_remove("usual", c))).cast("long"))
    kinds = F.array(*(F.col(f"in_{name}") if name != "blank" else F.col("chars") - F.col("word_chars") for name in CLASSES))
    return fourth.select("row", F.coalesce("ref", F.lit(ALL)).alias("ref"), "n_words", "word_chars", F.col("in_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "chars", kinds.alias("class_counts"), counts.alias("word_counts"))


def common_words(documents: DataFrame) -> DataFrame:
    """(ref, common): the most common words of each language. Ranks are taken within salted parts of a language first, so that no task gets all of a hot one's words."""
    spark = documents.sparkSession
    counts = documents.where((F.col("lang").isNotNull()) & (F.col("lang") != ALL)).select(F.col("lang").alias("ref"), F.explode(split_words(F.lower(F.coalesce("text", F.lit(""))))).alias("word")).groupBy("ref", "word").agg(F.count(F.lit(1)).alias("n"))
    salts = math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    for part in (["ref", F.pmod(F.xxhash64("word"), F.lit(salts))], ["ref"]):
        rank = Window.partitionBy(*part).orderBy(F.desc("n"), "word")
        counts = counts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= COMMON).drop("rank")
    return counts.groupBy("ref").agg(F.sort_array(F.collect_list("word")).alias("common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of equal length, each summing to 1."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    total = F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)
    return F.sqrt(F.when(total > 0, total).when(total.isNotNull(), 0.0) / 2)


def shares(counts: Column, total: Column) -> Column:
    """Shares of each count, and last the rest of the total."""
    return let(counts, lambda c: F.transform(F.concat(c, F.array(total - F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y))), lambda x: x.cast("double") / F.greatest(total, F.lit(1))))


def judge(documents: DataFrame) -> DataFrame:
    """Rows of documents without text, with the counts, base_failed, both distances, and kept."""
    keep = [c for c in documents.columns if c.lower() not in ("text", *RESULTS)]
    # The rows' own columns go along as one struct, so that their names clash with none here.
    documents = documents.select(F.struct(*keep).alias("row"), "text", "lang")
    common = table(common_words(documents), "common-words")
    rows = table(measures(documents, common), "quality-measures")
    sums = lambda name, n: F.array(*(F.sum(F.get(name, F.lit(i))).cast("long") for i in range(n)))
    big = rows.where(F.col("n_words") >= 50)
    own = big.where(F.col("ref") != ALL).groupBy("ref").agg(F.sum("chars").alias("c"), F.sum("n_words").alias("w"), sums("class_counts", len(CLASSES)).alias("cc"), sums("word_counts", COMMON).alias("wc"))
    # The reference over all takes every document's classes, and has no words.
    whole = big.agg(F.sum("chars").alias("c"), sums("class_counts", len(CLASSES)).alias("cc"))
    refs = own.unionByName(whole.select(F.lit(ALL).alias("ref"), "c", F.lit(None).cast("long").alias("w"), "cc", F.lit(None).cast("array<long>").alias("wc")))
    refs = refs.select("ref", shares(F.col("cc"), F.col("c")).alias("ref_classes"), shares(F.filter("wc", lambda x: x.isNotNull()), F.col("w")).alias("ref_words"))
    rows = rows.join(table(refs, "quality-references"), "ref", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumns(
        {
            "class_distance": distance(shares(F.col("class_counts"), F.col("chars")), F.col("ref_classes")),
            "word_distance": distance(shares(F.col("word_counts"), F.col("n_words")), F.col("ref_words")),
            "base_failed": failed,
        }
    )
    odd = (F.col("chars") >= LEAST_CHARS) & (F.col("class_distance") > FAR_CLASSES) | (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > FAR_WORDS)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).select("row.*", *RESULTS)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
