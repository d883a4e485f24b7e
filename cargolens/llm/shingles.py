"""Near-duplicates by Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands find pairs, whole shingle sets decide.

A text is the set of its five-word shingles (as 64-bit hashes). Its SimHash fingerprint has the bits that over half of them have;
operator 3's masks put it into a bucket for each, so that fingerprints within RADIUS bits always meet. Pairs of 0.8 mostly differ in
more bits, and masks for so many would be too many: bands find those. A band is ROWS minima of the set under random hashes; texts that
agree in a band meet in its bucket. A pair of similarity s misses all bands with probability (1 - s^ROWS)^BANDS: 3e-6 at 0.8,
1e-12 at 0.9. Pairs that meet are linked only if the Jaccard similarity of their whole sets is LEAST or more. Equal sets are one
node; buckets with the same members are searched once; only a forest of a bucket's links goes on, so that pairs of a large group
are never listed. Buckets of more than BLOCK sets are dealt to tasks by pairs of blocks. Texts stay where they are: a bounded bit map tells
which of them met another, and only the sets of these travel. Tables that no result reads are removed at the end of the stage.

Defined results: a text of fewer words than a shingle is one shingle; texts without words (null, empty, blank) are equal. Rows
with null or repeated ids count one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import scratch, ship, table, with_fields
from cargolens.llm.components import components
from cargolens.llm.decontaminate import gram_hashes
from cargolens.llm.simhash import Forest, majority, masks
from cargolens.llm.tokens import slices
from cargolens.operators.joins import likely, without

#: Words to a shingle; the least similarity of a near-duplicate.
WIDTH, LEAST = 5, 0.8
#: Bits in which fingerprints that always meet may differ.
RADIUS = 4
MASKS = np.array(masks(RADIUS), np.int64).view(np.uint64)
#: Bands, and minima in each.
BANDS, ROWS = 32, 5
#: Sets of a bucket that one task compares at once; shingles hashed at once.
BLOCK, CHUNK = 512, 1024
_random = np.random.default_rng(5)
FLIP, TIMES = _random.integers(0, 2**64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of the lower-cased words of a text, as sorted hashes; words are those of simhash.fingerprint."""
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in text.encode().lower().split()], np.uint64)
    return np.unique(gram_hashes(h, min(width, len(h)))) if len(h) else h


def print_keys(own: np.ndarray) -> list[int]:
    """The bucket of a set's SimHash fingerprint under each mask, as signed longs; the empty set has none."""
    if not len(own):
        return []
    kept = np.uint64(majority(own)) & MASKS
    return ((kept ^ FLIP[: len(MASKS)]) * TIMES[: len(MASKS)]).view(np.int64).tolist()


def bands(own: np.ndarray) -> list[int]:
    """The bucket of a set in each band, as signed longs; the empty set has none."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(own), CHUNK):
        np.minimum(least, ((own[a : a + CHUNK, None] ^ FLIP) * TIMES).min(axis=0), out=least)
    return np.array([xxhash.xxh3_64_intdigest(m.tobytes(), b) for b, m in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def sketched(documents: DataFrame) -> DataFrame:
    """Rows of documents without text, with sid, which names the set of shingles, and its buckets."""
    ship(documents.sparkSession)
    keep = [c for c in documents.columns if c != "text"]
    rows = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own = [shingles(t) for t in b.column("text").to_pylist()]
            sids = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in own], pa.string())
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["text"]).columns, sids, pa.array([print_keys(s) + bands(s) for s in own], pa.list_(pa.int64()))], names=[*keep, "sid", "keys"])

    return rows.mapInArrow(run, with_fields(rows.drop("text"), "sid string, keys array<long>"))


def sets(texts: DataFrame) -> DataFrame:
    """(uid, sid, shingles) of texts (uid, sid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("sid"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["uid", "sid", "shingles"])

    return texts.select("uid", "sid", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "uid long, sid string, shingles binary")


def close(own: list[np.ndarray], side: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """A forest of the links in a cell, as places: among all its sets if they are of one side, else between the sides."""
    sizes = np.array([len(s) for s in own])
    starts = np.cumsum(sizes) - sizes
    values, at = np.unique(np.concatenate(own), return_inverse=True)
    first = np.flatnonzero(side == side[0])
    two = len(first) < len(own)
    group = np.arange(len(own))  # by the links found so far
    for i in first.tolist():
        rest = len(first) if two else i + 1
        if not (group[rest:] != group[i]).any():
            continue
        mark = np.zeros(len(values), np.int64)
        mark[at[starts[i] : starts[i] + sizes[i]]] = 1
        shared = np.add.reduceat(mark[at[starts[rest] :]], starts[rest:] - starts[rest])
        similar = shared >= least * (sizes[i] + sizes[rest:] - shared) - 1e-9
        for j in (rest + np.flatnonzero(similar)).tolist():
            if group[i] != group[j]:
                yield i, j
                group[group == group[j]] = group[i]


def _links(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Frames sorted by (key, cell, side): the sets of a bucket, or of two blocks of it (side 0 and 1)."""
    forest, left = Forest(), None

    def search(f: pd.DataFrame) -> list[tuple[str, str]]:
        sid = f["sid"].tolist()
        if len(sid) < 2:
            return []
        found = close([np.frombuffer(x, np.uint64) for x in f["shingles"]], f["side"].to_numpy(), least)
        return [(sid[i], sid[j]) for i, j in found if forest.join(sid[i], sid[j])]

    for f in frames:
        f = f if left is None else pd.concat([left, f], ignore_index=True)
        keys = f[["key", "cell"]].to_numpy(np.int64)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        left = f.iloc[starts[-1] :]  # the last cell may go on in the next frame
        yield pd.DataFrame([x for a, z in zip(starts, starts[1:], strict=False) for x in search(f.iloc[a:z])], columns=["a", "b"], dtype="object")
    if left is not None and len(left):
        yield pd.DataFrame(search(left), columns=["a", "b"], dtype="object")


def links(rows: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """A forest (a, b) over the sids of a written table (uid, sid, keys, text), as a written table, with the components of all linked pairs."""
    with scratch(rows.sparkSession) as step:
        # The row with the least uid stands for its set.
        one = rows.groupBy("sid").agg(F.min("uid").alias("uid"), F.first("keys").alias("keys"))
        met = step(one.select("uid", F.explode("keys").alias("key")), "bands")
        size = step(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
        met = step(likely(met, "key", size).join(size, "key"), "meetings")
        small = met.where(F.col("n") <= block).groupBy("key").agg(F.sort_array(F.collect_list("uid")).alias("uids"))
        small = small.groupBy("uids").agg(F.min("key").alias("key")).select("key", F.explode("uids").alias("uid"), F.lit(0).alias("cell"), F.lit(0).alias("side"))
        # A cell is a pair of blocks; a set goes to all pairs that have its block.
        k = F.ceil(F.col("n") / block).cast("int")
        own = F.pmod(F.xxhash64("uid"), k).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((F.least("own", j) * k + F.greatest("own", j)).alias("cell"), (F.col("own") > j).cast("int").alias("side")))
        large = met.where(F.col("n") > block).withColumn("own", own).select("key", "uid", F.explode(pairs).alias("c")).select("key", "uid", "c.cell", "c.side")
        dealt = step(small.unionByName(large), "cells")
        whole = step(sets(likely(rows.select("uid", "sid", "text"), "uid", met.select("uid").distinct())), "sets")
        dealt = dealt.join(whole, "uid").repartition("key", "cell").sortWithinPartitions("key", "cell", "side", "uid")
        return table(dealt.mapInPandas(lambda frames: _links(frames, least), "a string, b string"), "shingle-links")


def representatives(documents: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """One row of documents for each group: the one with the least id (null: last)."""
    whole = documents.select(F.struct(*documents.columns).alias("row"), "doc_id", "text")
    rows = table(sketched(whole).withColumn("uid", F.monotonically_increasing_id()), "sketched")
    found = links(rows.select("uid", "sid", "keys", F.col("row.text").alias("text")), least, block)
    with scratch(rows.sparkSession) as step:
        roots = step(components(found, step), "roots")
        light = rows.select("uid", "doc_id", "sid").join(roots, F.col("sid") == F.col("node"), "left")
        light = light.select("uid", F.coalesce("root", "sid").alias("component"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid").alias("rank"))
        first = step(light.groupBy("component").agg(F.min("rank")["uid"].alias("uid")), "first-of-groups")
        rest = table(rows.select("uid").join(first, "uid", "left_anti"), "rest-of-groups")
    return without(rows.select("uid", "row"), "uid", rest).select("row.*")
