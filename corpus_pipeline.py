"""A corpus pipeline: quality rules, near-duplicates, benchmark leaks, secrets, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
table; all but the last keep the columns of documents. run() writes each stage's table to the shared folder and reads it for
the next one.

Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Operator 3's method, SimHash
fingerprints under covering masks, finds pairs; as its four bits miss many of those, MinHash bands find pairs, too; whole sets decide.

Defined results: a null or empty text fails the quality rules. Repeated rows are near-duplicates of each other; of a group the row with the
least id stays, one with a null id only where no other has one. Texts of any length go through whole. An empty table gives no rows in any
stage. Further columns of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import decontaminate, packing, quality, secret_scan, shingles
from cargolens.llm.common import table


def _keyed(docs: DataFrame) -> DataFrame:
    """docs as one struct column, row, with the text beside it, so that operators' columns can't clash with theirs."""
    return docs.select(F.struct(*docs.columns).alias("row"), *(c for c in ("doc_id", "text", "lang") if c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.judge(_keyed(docs)).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id, and of those with the same id the one with the least row."""
    return shingles.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secret_scan.redact(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts, packed into sequences."""
    pieces = packing.packed(docs.select("doc_id", "text"))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secrets),
    ("best-fit packing", best_fit),
]
#: Fingerprints, alignment and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
