"""Language identification by a string kernel.

A text's features are which of its n-grams of one to three letters it has (hashed; letters in lower case, other characters
as blanks): a blended-spectrum presence kernel, normalised. Landmark texts give a Nyström map of that kernel, and ridge regression on it
learns one function for each language against the rest. Texts are scored by products of batches of presence rows with the
landmarks.

The sample that is learned from is bounded: PER_LANGUAGE texts of each of the LANGUAGES most frequent languages, and LANDMARKS
landmarks among them. Tasks compute the features; the driver holds their bits only, and solves.

Defined results: null texts and texts without a letter are `und`, score 0; so is everything if there is nothing to learn from.
Of languages with equal scores the first by name wins. A null id is neither held out nor learned from. Rows are never merged
or dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargolens.llm.common import ship, with_fields
from cargolens.llm.tokens import slices

PER_LANGUAGE, LANGUAGES, LANDMARKS, RIDGE = 250, 256, 128, 0.3
#: Features (a power of two); characters handled at a time.
BITS, STRETCH = 12, 500_000

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once in each worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of features (0 or 1), and whether each text has a letter."""
    size = 1 << BITS
    out, any_ = np.zeros((len(texts), size), bool), np.zeros(len(texts), bool)

    def add(rows: list[int], parts: list[str]) -> None:
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.array(rows), [len(p) for p in parts])
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        letter = letters()[code]
        any_[row[letter]] = True
        code = np.where(letter, code, np.uint32(32)).astype(np.uint64)
        hashed = np.zeros(len(code), np.uint64)
        for n in range(3):
            hashed = (hashed[: len(code) - n] * np.uint64(0x110001) + code[n:]) if n else code
            inside = part[: len(code) - n] == part[n:]
            with np.errstate(over="ignore"):
                at = (hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            out[row[: len(code) - n][inside], at[inside]] = True

    rows, parts, held = [], [], 0
    for i, t in enumerate(texts):
        padded = f" {t.lower()} "
        for a in range(0, len(padded), STRETCH):  # neighbouring stretches share two characters
            rows.append(i)
            parts.append(padded[a : a + STRETCH + 2])
            held += len(parts[-1])
            if held > STRETCH:
                add(rows, parts)
                rows, parts, held = [], [], 0
    if parts:
        add(rows, parts)
    return out, any_


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # features by landmarks, each column of length 1
    weights: np.ndarray  # landmarks by languages: the Nyström map and the ridge solution in one
    shift: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.landmarks) @ self.weights + self.shift


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    return unit(x) @ landmarks


def fit(x: np.ndarray, names: np.ndarray) -> Model | None:
    """Ridge regression on a Nyström map; landmarks are spread evenly over the languages."""
    languages = sorted(set(names))
    if not languages:
        return None
    order = np.argsort(np.concatenate([np.arange((names == n).sum()) for n in languages]), kind="stable")
    grouped = np.concatenate([np.flatnonzero(names == n) for n in languages])
    z = unit(x[grouped[order][: max(LANDMARKS, len(languages))]]).T
    value, vector = np.linalg.eigh((z.T @ z).astype(np.float64))
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    phi = kernel(x, z) @ whiten
    y = np.where(names[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = 1 / np.array([(names == n).sum() for n in names])  # languages weigh alike
    mean, target = (share[:, None] * phi).sum(0) / share.sum(), (share[:, None] * y).sum(0) / share.sum()
    centred = (phi - mean) * np.sqrt(share)[:, None]
    solved = np.linalg.solve(centred.T @ centred + RIDGE * share.mean() * np.eye(len(mean)), centred.T @ ((y - target) * np.sqrt(share)[:, None]))
    return Model(languages, z, (whiten @ solved).astype(np.float32), (target - mean @ solved).astype(np.float32))


def train(labelled: DataFrame, order: Column) -> Model | None:
    """Learns from (text, lang) rows with non-null lang: of each language the PER_LANGUAGE first ones by order."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where("lang is not null and text is not null").select("text", "lang", order.alias("order"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    # Twice as many as are wanted pass by their order's hash, so that few texts go on.
    rate = F.element_at(F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 2.0 * PER_LANGUAGE / n)))), F.col("lang"))
    rows = rows.where(F.col("lang").isin(*counts)).where(F.pmod(F.xxhash64("order"), F.lit(1_000_000)) <= 1_000_000 * rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 500, STRETCH):
            x, good = presence(b.column("text").to_pylist())
            bits = [r.tobytes() for r in np.packbits(x, axis=1)]
            kept = b.drop_columns(["text"]).append_column("bits", pa.array(bits, pa.binary()))
            yield kept.filter(pa.array(good))

    found = rows.mapInArrow(run, with_fields(rows.drop("text"), "bits binary"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("order"), "order")
    sample = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PER_LANGUAGE).select("lang", "rank", "bits").toPandas().sort_values(["lang", "rank"])
    if not len(sample):
        return None
    x = np.unpackbits(np.frombuffer(b"".join(sample["bits"]), np.uint8).reshape(len(sample), -1), axis=1)
    return fit(x, sample["lang"].to_numpy(str))


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """Rows of documents without text, with lang_pred and score."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in documents.columns if c.lower() not in ("text", "lang_pred", "score")]
    rows = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text", 500, STRETCH):
            x, good = presence(b.column("text").to_pylist())
            names, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if m is not None and good.any():
                s = m.scores(x[good])
                names[good] = np.array(m.languages, object)[s.argmax(axis=1)]
                score[good] = np.clip((s.max(axis=1) + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["text"]).columns, pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, with_fields(rows.drop("text"), "lang_pred string, score double"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs.where(fold != 1), F.col("doc_id"))
    return predict(docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text"), model)
