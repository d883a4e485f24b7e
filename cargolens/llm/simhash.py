"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits, each set if it is set in over half of the hashes of the text's word shingles. Each of its bits gets a
vector of radius + 1 bits; each vector but zero makes a table whose mask keeps the fingerprint's bits with an odd product. If
two fingerprints differ in no more bits than the radius, some vector is orthogonal to those of all these bits, so that its mask
drops them all: the pair meets in that table, always. Distinct fingerprints meet in 2^(radius+1) - 1 tables; within a bucket
links are searched among its fingerprints, and only a forest of them goes on: pairs of a large group of copies are never
listed. Buckets of more than BLOCK fingerprints are dealt to tasks by pairs of blocks. Components come from the forest.

Defined results: rows are never merged; equal texts, repeated rows, null or repeated ids each get a row. A text without words
(null, empty, blank) has fingerprint zero and is linked like any other. component_id is the least id reachable over all rows,
null only where all ids reachable are. An empty table gives an empty result. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.common import ship, table, with_fields
from cargolens.llm.components import components
from cargolens.llm.tokens import slices

BITS = 64
#: Fingerprints of a bucket that one task compares at once.
BLOCK = 2048
#: Bits set in each byte value, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """SimHash of the lower-cased word shingles of a text. bytes.lower and bytes.split know ASCII only, as the contract does."""
    w = text.encode().lower().split()
    if not w:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(w) <= width:
        hashes = [hash_(b" ".join(w), seed)]
    else:
        hashes = [hash_(b" ".join(s), seed) for s in zip(*(w[i:] for i in range(width)), strict=False)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    raw = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    set_ = np.concatenate([np.bincount(raw[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """Rows of documents without text, with fp: the fingerprint as a signed long."""
    ship(documents.sparkSession)
    keep = [c for c in documents.columns if c.lower() not in ("text", "fp")]
    rows = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["text"]).columns, pa.array(fps)], names=[*keep, "fp"])

    return rows.mapInArrow(run, with_fields(rows.drop("text"), "fp long"))


def masks(radius: int) -> list[int]:
    """The bit masks of all tables, as signed longs. Bit i has vector i mod (2^d - 1) + 1, so that vectors are spread evenly."""
    d = radius + 1
    vector = [i % (2**d - 1) + 1 for i in range(BITS)]
    out = [sum(1 << i for i in range(BITS) if (v & vector[i]).bit_count() % 2) for v in range(1, 2**d)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


class Forest:
    """Union and find over fingerprints."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.up.get(root, root)) != root:
            root = up
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def close(fps: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A forest of the links in a cell, as places: among all its fingerprints if they are of one side, else between the sides."""
    first = np.flatnonzero(side == side[0])
    two = len(first) < len(fps)
    group = np.arange(len(fps))  # by the links found so far
    for i in first.tolist():
        rest = slice(len(first) if two else i + 1, None)
        for j in np.flatnonzero((np.bitwise_count(fps[rest] ^ fps[i]) <= radius) & (group[rest] != group[i])).tolist():
            j += rest.start
            if group[i] != group[j]:
                yield i, j
                group[group == group[j]] = group[i]


def _links(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Frames sorted by (t, key, cell, side): the fingerprints of a bucket, or of two blocks of it (side 0 and 1)."""
    forest, left = Forest(), None

    def search(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        fps, side = f["fp"].to_numpy(np.int64).view(np.uint64), f["side"].to_numpy()  # bitwise_count takes absolute values
        ends = np.append(starts[1:], len(f))
        two = starts[ends - starts == 2]
        two = two[(np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius)]
        found = list(zip(two.tolist(), (two + 1).tolist(), strict=True))
        for k in np.flatnonzero(ends - starts > 2).tolist():
            found += [(starts[k] + i, starts[k] + j) for i, j in close(fps[starts[k] : ends[k]], side[starts[k] : ends[k]], radius)]
        signed = fps.view(np.int64)
        pairs = ((int(signed[i]), int(signed[j])) for i, j in found)
        return pd.DataFrame([x for x in pairs if forest.join(*x)], columns=["a", "b"], dtype="int64")

    for f in frames:
        f = f if left is None else pd.concat([left, f], ignore_index=True)
        keys = f[["t", "key", "cell"]].to_numpy(np.int64)
        starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
        left = f.iloc[starts[-1] :]  # the last cell may go on in the next frame
        yield search(f.iloc[: starts[-1]], starts[:-1])
    if left is not None and len(left):
        yield search(left, np.array([0]))


def links(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """A forest (a, b) over distinct fingerprints (fp) with the same components as all pairs within the radius."""
    ship(prints.sparkSession)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))))
    met = prints.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    size = met.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
    # Only a bucket of more than one block is large enough to be looked up; a table of few rows.
    large = table(size.where(F.col("n") > block), "large-buckets").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    cells = met.join(large, ["t", "key"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    k = F.col("blocks")
    # A cell is a pair of blocks; a fingerprint goes to all pairs that have its block.
    pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((F.least("own", j) * k + F.greatest("own", j)).alias("cell"), (F.col("own") > j).cast("int").alias("side")))
    one = F.array(F.struct(F.lit(0).alias("cell"), F.lit(0).alias("side")))
    dealt = cells.select("t", "key", "fp", F.explode(F.when(k.isNull(), one).otherwise(pairs)).alias("c")).select("t", "key", "fp", "c.cell", "c.side")
    dealt = dealt.repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell", "side", "fp")
    return dealt.mapInPandas(lambda frames: _links(frames, radius), "a long, b long")


def components_of(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id, component) for a written table with doc_id and fp; component names a group even where it has no id."""
    prints = table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = table(components(links(prints.select("fp"), radius)), "roots")
    rooted = table(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("component")), "rooted")
    least = table(rooted.groupBy("component").agg(F.min("least").alias("component_id")), "least-ids")
    return table(rooted.join(least, "component").select("fp", "component_id", "component"), "components")


def groups(documents: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """Rows of documents without text, with fp, component_id and component; columns of these names are replaced."""
    rows = table(fingerprints(documents.drop("component_id", "component"), width), "fingerprints")
    return rows.join(components_of(rows, radius), "fp")


def representatives(documents: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of documents for each group: the one with the least id (null: last)."""
    whole = documents.select(F.struct(*documents.columns).alias("row"), "doc_id", "text")
    rows = table(fingerprints(whole, width).withColumn("uid", F.monotonically_increasing_id()), "fingerprinted")
    light = rows.select("uid", "doc_id", "fp")
    light = light.join(components_of(light, radius), "fp").select("uid", "component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid").alias("rank"))
    first = table(light.groupBy("component").agg(F.min("rank")["uid"].alias("uid")), "first-of-groups")
    rest = table(rows.select("uid").join(first, "uid", "left_anti"), "rest-of-groups")
    return rows.join(rest, "uid", "left_anti").select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
