"""Best-fit packing of token pieces into sequences, planned over the histogram of their lengths.

The driver sees only how many pieces each length has (at most one row for each length up to the sequence size). It places
lengths from long to short, each into the open sequences with the least room that holds it, whole runs of equal sequences at
a time. The plan says which ranks of a length go to which sequences; a piece finds its slot by its rank within its length.

Defined results: repeated rows are pieces of their own. Null texts are empty and have the end id only; null ids stay. Texts of any
length are encoded whole. Pieces that tie in length are ranked by their order columns; any two of them may change places. An empty
table gives an empty result. Other columns are kept, whatever their names; those with the name of a result column are replaced.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargolens.llm.common import table
from cargolens.llm.tokens import pieces

PLAN = "length long, first long, upto long, sequence long, each long, offset long"


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN: ranks first to upto - 1 of a length go to sequences from `sequence` on, `each` to one, from offset on.

    The result of best-fit decreasing, one piece at a time: a piece of the length at hand goes on filling the sequence that the
    one before went to, as none has less room."""
    room: list[int] = []  # the amounts of room that some open sequences have, sorted
    open_: dict[int, list[tuple[int, int]]] = {}  # runs of sequences (first, number) with that room
    rows, fresh = [], 0

    def keep(left: int, first: int, n: int) -> None:
        if left > 0 and n > 0:
            if left not in open_:
                bisect.insort(room, left)
                open_[left] = []
            open_[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                space = room[at]
                first, n = open_[space].pop()
                if not open_[space]:
                    del open_[space], room[at]
            else:
                space, first = size, fresh
                n = -(-(count - rank) // (size // length))
                fresh += n
            each = space // length
            full = min(n, (count - rank) // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, size - space))
                rank += full * each
                keep(space - each * length, first, full)
            if full < n and rank < count:
                some = count - rank
                rows.append((length, rank, count, first + full, some, size - space))
                rank = count
                keep(space - some * length, first + full, 1)
                full += 1
            keep(space, first + full, n - full)
    return rows


def pack(items: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with a length column; columns with these names are replaced. order: columns that tell pieces apart.

    Ranks are counted within salted parts of a length, so that a length which a third of all pieces have is no one task's. A piece's
    own columns go along as one struct, so that their names clash with none here."""
    spark = items.sparkSession
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    salted = items.select(F.struct(*keep).alias("item"), "length", F.struct(*order).alias("order")).withColumn("salt", F.pmod(F.xxhash64("order"), F.lit(salts)))
    parts = table(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = F.broadcast(spark.createDataFrame(plan(histogram, size), PLAN))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("order")) - 1
    ranked = salted.withColumn("within", within).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within"))
    at = F.col("rank") - F.col("first")
    slotted = ranked.join(slots, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("upto")))
    placed = slotted.select("item", (F.col("sequence") + F.floor(at / F.col("each"))).alias("sequence_id"), (F.col("offset") + F.pmod(at, F.col("each")) * F.col("length")).alias("offset"))
    return placed.select("item.*", "sequence_id", "offset")


def packed(documents: DataFrame, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of documents, with ids_crc32 (and ids), sequence_id and offset."""
    import public_tokenizers as public

    cut = pieces(documents, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), size, end_id, with_ids)
    cut = table(cut, "pieces")
    return pack(cut, size, [c for c in cut.columns if c in ("doc_id", "piece", "start", "ids_crc32")])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
