"""URL filters: rules on hosts and path prefixes, by a sort-merge range join.

A rule (host, path, verdict) fits a URL if its host is the URL's or a parent domain, and its path a prefix of the URL's. The
canonical key `reversed.host#path` turns a rule's path into an interval of keys: all that start with the rule's key. Each
distinct URL sends one key for each of its domains that has as many labels as some rule; keys and rules are dealt by ranges of
the key, rules to all ranges that their interval meets, and one sorted sweep over each range keeps a stack of the active
nested rules: its top is the longest. The longest of what a URL's domains get is the verdict: by host and path together, then by the
host.

Defined results: null, empty or malformed URLs have empty host and path and no rule. Repeated rows, null and repeated ids all get
a row. Of rules with the same host and path, block wins over allow. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.common import ship, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: What URLs that no rule fits get.
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column, path: Column) -> Column:
    """Neither host nor path can hold a #."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("#"), path)


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by range, key, and rules first: each URL key gets the top of the stack of rules whose keys start its own."""
    stack: list[tuple[str, str, str]] = []
    at = None
    for frame in frames:
        out = []
        for part, key, rule, verdict, host, path in zip(frame["part"], frame["key"], frame["rule"], frame["verdict"], frame["host"], frame["path"], strict=True):
            if part != at:
                stack, at = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule, verdict))
            elif stack:
                top = stack[-1]
                out.append((host, path, len(top[0]), top[0].index("#"), *top[1:]))
        yield pd.DataFrame(out, columns=["host", "path", "size", "host_size", "rule", "verdict"])


def judge(urls: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """(host, path, rule, verdict) for each distinct (host, path) of urls that some rule fits."""
    spark = urls.sparkSession
    ship(spark)
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    rules = table(rules.select(key_of(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels")), "url-rules")
    labels = rules.select("labels").distinct().agg(F.sort_array(F.collect_set("labels"))).first()[0]
    if not labels:
        return urls.select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict")).where(F.lit(False))
    parts = F.split("host", r"\.")
    own = F.transform(F.filter(F.lit(labels), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    urls = table(urls.where("host != ''").groupBy("host", "path").count().select("host", "path", F.explode(own).alias("domain")).withColumn("key", key_of(F.col("domain"), F.col("path"))), "url-keys")

    # Boundaries of about equal ranges of the keys, as Spark's range partitioning samples them; one for each task.
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = urls.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    bounds = [r.key for r in first.orderBy("key").collect()][1:]
    shared = spark.sparkContext.broadcast(bounds)
    part = F.pandas_udf(lambda keys: pd.Series([bisect.bisect_right(shared.value, k) for k in keys], dtype="int32"), "int")
    upto = F.concat("key", F.lit("\U0010ffff"))
    none = F.lit(None).cast("string")
    starts = rules.select(F.explode(F.sequence(part(F.col("key")), part(upto))).alias("part"), "key", "rule", "verdict", none.alias("host"), none.alias("path"))
    asked = urls.select(part(F.col("key")).alias("part"), "key", none.alias("rule"), none.alias("verdict"), "host", "path")
    dealt = starts.unionByName(asked).repartition(n, "part").sortWithinPartitions("part", "key", F.col("rule").isNull(), "host", "path")
    hits = dealt.mapInPandas(sweep, "host string, path string, size int, host_size int, rule string, verdict string")
    return hits.groupBy("host", "path").agg(F.max(F.struct("size", "host_size", "rule", "verdict")).alias("best")).select("host", "path", "best.rule", "best.verdict")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    # A written table, so that Spark can split the shuffles of a URL which many pages have.
    found = table(judge(pages.select("host", "path"), rules), "url-verdicts")
    return pages.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))


OP6_SQL = """
WITH p AS (
  SELECT page_id,
         coalesce(CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
         coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT host, path, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), (length(rhost) + length(rpath)) * 1000 + length(rhost)) AS b
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""
