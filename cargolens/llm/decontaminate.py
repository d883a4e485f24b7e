"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

One pass over the documents keeps the passages around word n-grams that may be an item's (bit maps say so, one for each size of items). All
n-grams of an item are seeds, however many documents have them: those that survive in a copy may be just the frequent ones, as
when many documents hold the same edited copy. Distinct passages meet items on seeds; pairs with too few words in common to reach the
score drop out, and local alignment of their words scores the rest: copies with words changed, left out or put in still align. A
pair is a leak if its score is at least SCORE of a whole copy's.

Defined results: a null text has no passages. Leaks are per text: repeated rows and equal texts all get them, and rows with
null ids, too. Texts of any length are searched whole. Of passages with the same score the first counts. Other columns are kept by
without_leaks(), whatever their names. Items with fewer words than an n-gram have none; they, null and empty items are never found. Items with null
id count. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import common
from cargolens.llm.common import scratch, ship, table
from cargolens.llm.tokens import slices
from cargolens.operators.joins import without

WORD = re.compile(r"\w+")
#: Words to a seed; the least score, of that of a whole copy.
GRAM, SCORE = 3, 0.5
#: Bits of a map for each gram in it; the least and greatest sizes (as powers of two). A gram is looked up in two maps: one in ROOM^2
#: others passes. Fuller maps let more passages through, to be sorted out later.
ROOM, LEAST_BITS, MOST_BITS = 256, 16, 28
MATCH, OTHER, GAP = 2, -1, 1
#: Cells of the alignment that one task holds at a time.
CELLS = 2_000_000


def word_hashes(texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Words of each text, the hashes of all, and the place of each text's first word."""
    words = [WORD.findall(t.lower()) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    hash_ = xxhash.xxh3_64_intdigest
    return words, np.fromiter((hash_(x) for w in words for x in w), np.uint64, starts[-1]), starts


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each row of gram neighbouring words."""
    out = np.zeros(max(0, len(h) - gram + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            out = (out ^ h[k : len(h) - gram + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def item_grams(items: DataFrame, gram: int) -> DataFrame:
    """(item_id, n_words, gram) for each distinct n-gram of an item."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            _, h, starts = word_hashes(f["text"].tolist())
            for item, a, z in zip(f["item_id"], starts, starts[1:], strict=False):
                grams = np.unique(gram_hashes(h[a:z], gram)).view(np.int64)
                yield pd.DataFrame({"item_id": pd.array([item] * len(grams), "Int64"), "n_words": z - a, "gram": grams})

    return items.mapInPandas(run, "item_id long, n_words long, gram long")


def places_of(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A gram's places in its two maps: its highest bits, and its lowest."""
    return grams >> np.uint64(64 - bits), grams & np.uint64((1 << bits) - 1)


def in_map(known: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def maps_of(grams: DataFrame, bits: int = LEAST_BITS) -> list[tuple[int, int, list[np.ndarray]]]:
    """(margin, bits, two maps) for each power of two that some item's length comes to: a gram needs no more words around it than its item has.

    A map's size follows the number of its grams, from 2^bits to 2^MOST_BITS bits."""
    power = F.pow(F.lit(2), F.ceil(F.log2("n_words"))).cast("int")
    counts = {r.margin: r.n for r in grams.groupBy(power.alias("margin")).agg(F.count_distinct("gram").alias("n")).collect()}
    sizes = {margin: min(MOST_BITS, max(bits, (ROOM * n).bit_length())) for margin, n in sorted(counts.items())}
    if not sizes:
        return []
    # All maps in one job, as 64-bit words: at most 2^(bits-6) rows for a map, however many grams there are.
    own = F.element_at(F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)), power)
    high = F.call_function("shiftrightunsigned", F.col("gram"), F.lit(64) - own)
    low = F.col("gram").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), own) - 1)
    placed = grams.select(power.alias("margin"), F.posexplode(F.array(high, low)).alias("which", "at"))
    words = placed.groupBy("margin", "which", F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b")).toArrow().to_pandas()
    out = {margin: [np.zeros(1 << (own - 6), np.int64) for _ in range(2)] for margin, own in sizes.items()}
    for (margin, which), part in words.groupby(["margin", "which"]):
        out[margin][which][part["w"].to_numpy()] = part["b"].to_numpy()
    return [(margin, sizes[margin], [m.view(np.uint8) for m in maps]) for margin, maps in out.items()]


def stretches(hits: np.ndarray, margins: np.ndarray, gram: int, starts: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(text, first, end, hits in it) of the words around hits, each with its own margin, within its text; those that meet are one."""
    of = np.searchsorted(starts, hits, "right") - 1
    a, z = np.maximum(hits - margins, starts[of]), np.minimum(hits + gram + margins, starts[of + 1])
    order = np.argsort(a, kind="stable")
    of, a, upto, hits = of[order], a[order], np.maximum.accumulate(z[order]), hits[order]
    cuts = np.flatnonzero((of[1:] != of[:-1]) | (a[1:] > upto[:-1])) + 1
    edges = [0, *cuts.tolist(), len(hits)]
    return [(int(of[i]), int(a[i]), int(upto[j - 1]), hits[i:j]) for i, j in zip(edges, edges[1:], strict=False)] if len(hits) else []


def passages(texts: DataFrame, maps: list[tuple[int, int, list[np.ndarray]]], gram: int) -> DataFrame:
    """(key, start, words, hits): stretches of a text around n-grams in a map, with that map's margin of words on each side; those that meet are one."""
    spark = texts.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", chars=1_000_000):
            words, h, starts = word_hashes(b.column("text").to_pylist())
            grams = gram_hashes(h, gram)
            margins = np.zeros(len(grams), np.int64)
            for margin, bits, (high, low) in shared.value:  # from short items to long ones
                first, second = places_of(grams, bits)
                some = np.flatnonzero(in_map(high, first))
                margins[some[in_map(low, second[some])]] = margin
            hit = np.flatnonzero(margins)
            hit = hit[hit + gram <= starts[np.searchsorted(starts, hit, "right")]]
            keys, rows = b.column("key").to_pylist(), []
            for d, a, z, own in stretches(hit, margins[hit], gram, starts):
                first = int(starts[d])
                rows.append((keys[d], a - first, " ".join(words[d][a - first : z - first]), np.unique(grams[own]).view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "start", "words", "hits"])

    return texts.mapInArrow(run, "key string, start long, words string, hits array<long>")


def align(items: list[list[int]], texts: list[list[int]]) -> np.ndarray:
    """Best local alignment score of each item with its text, for a batch of pairs."""
    n, m = max(map(len, items)), max(map(len, texts))
    a, b = np.full((len(items), n), -1, np.int64), np.full((len(texts), m), -2, np.int64)
    for k, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    slope = GAP * np.arange(m + 1, dtype=np.int32)
    row, best = np.zeros((len(items), m + 1), np.int32), np.zeros(len(items), np.int32)
    for i in range(n):
        new = np.zeros_like(row)
        new[:, 1:] = row[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, OTHER)
        np.maximum(new, row - GAP, out=new)
        np.maximum(new, 0, out=new)
        # Gaps along the row: the best start to the left, less a gap for each step.
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        np.maximum(best, row.max(axis=1), out=best)
    return best


def _score(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for f in frames:
        ids: dict[str, int] = {}
        number = lambda t: [ids.setdefault(w, len(ids)) for w in t]
        pairs = [(number(WORD.findall(x.lower())), number(y.split(" "))) for x, y in zip(f["item"], f["words"], strict=True)]
        # No alignment matches more words than both have; pairs that can't reach the least score stay at 0.
        able = [k for k, (x, y) in enumerate(pairs) if (Counter(x) & Counter(y)).total() >= least * len(x)]
        order = sorted(able, key=lambda k: len(pairs[k][1]))
        scores, some, wide = np.zeros(len(pairs)), [], 0
        for k in [*order, None]:
            if some and (k is None or (len(some) + 1) * max(wide, len(pairs[k][1])) > CELLS):
                best = align([pairs[j][0] for j in some], [pairs[j][1] for j in some])
                scores[some] = best / np.array([MATCH * len(pairs[j][0]) for j in some])
                some, wide = [], 0
            if k is not None:
                some.append(k)
                wide = max(wide, len(pairs[k][1]))
        yield pd.DataFrame({"passage": f["passage"], "item_id": f["item_id"], "score": scores})


def key_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def leaks(documents: DataFrame, items: DataFrame, gram: int = GRAM, bits: int = LEAST_BITS, least: float = SCORE, table: Callable[[DataFrame, str], DataFrame] = common.table) -> DataFrame:
    """(key, item_id, score, start): texts, by key_of(), that hold a copy of an item; start: of the passage with that score (the first of them), in words. table: writes the tables that the result reads."""
    ship(documents.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    grams = table(item_grams(items, gram), "item-grams")
    texts = documents.select(key_of(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = table(passages(texts, maps_of(grams, bits), gram), "passages")
    found = found.withColumn("passage", F.md5("words"))
    once = table(found.groupBy("passage").agg(F.first("words").alias("words"), F.first("hits").alias("hits")), "distinct-passages")
    hits = once.select("passage", F.explode("hits").alias("gram"))
    pairs = table(hits.join(grams.select("gram", "item_id"), "gram").select("passage", "item_id").distinct(), "seed-pairs")
    named = items.select(F.col("item_id").alias("of"), F.col("text").alias("item"))
    met = pairs.join(once.select("passage", "words"), "passage").join(named, F.col("item_id").eqNullSafe(F.col("of"))).select("passage", "item_id", "item", "words")
    good = met.mapInPandas(lambda frames: _score(frames, least), "passage string, item_id long, score double").where(F.col("score") >= least)
    scored = found.select("passage", "key", "start").join(table(good, "copies"), "passage")
    return scored.groupBy("key", "item_id").agg(F.max("score").alias("score"), F.max_by("start", F.struct("score", -F.col("start"))).alias("start"))


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents whose text holds no item's copy."""
    with scratch(documents.sparkSession) as step:
        bad = table(leaks(documents, items, table=step).select("key").distinct(), "leaked")
    # The rows' own columns go along as one struct, so that their names clash with none here.
    return without(documents.select(F.struct(*documents.columns).alias("row"), key_of(F.col("text")).alias("key")), "key", bad).select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with scratch(spark) as step:
        found = table(leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), table=step), "leaks")
    return docs.select("doc_id", key_of(F.col("text")).alias("key")).join(found, "key").select("doc_id", "item_id", "score", "start")
