"""Joins against brute force, on tables with nulls and repeated rows."""

import random

import duckdb
import pytest
from cargolens.operators import joins
from cargolens.plans import registry
from pyspark.sql import functions as F


def some(rng, values, n):
    return [tuple(rng.choice([*v, None]) for v in values) for _ in range(n)]


def bag(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_disjunctive_match_of_nulls_and_repeated_rows(spark):
    rng = random.Random(2)
    left, right = some(rng, [range(9), "abcd", "xyz", "uv"], 60), some(rng, ["abce", "xyw", "ut", range(3)], 50)
    a, b = spark.createDataFrame(left, "k int, a string, b string, c string"), spark.createDataFrame(right, "x string, y string, z string, w int")
    meets = lambda m, r, n: any(m[i + 1] is not None and m[i + 1] == r[i] for i in range(n))
    for n in (1, 2, 3):
        pairs = [("a", "x"), ("b", "y"), ("c", "z")][:n]
        want = {m + r for m in left for r in right if meets(m, r, n)}
        assert bag(joins.disjunctive_match(a, b, pairs).collect()) == bag(want)
        met = {k: {r for m in left for r in right if m[0] == k and meets(m, r, n)} for k in {m[0] for m in left}}
        want = [(k, len(s), min((r[3] for r in s if r[3] is not None), default=None)) for k, s in met.items() if s]
        assert bag(joins.disjunctive_counts(a, b, "k", pairs, F.col("w")).collect()) == bag(want)


@pytest.mark.parametrize("n", [0, 300])
def test_disjunctive_match_query_of_odd_parts(spark, tmp_path, n):
    """Null brands and types, a null key and repeated keys."""
    rng = random.Random(3)
    spark.createDataFrame(some(rng, [range(200), ["Brand#1", "Brand#2", "", "A B"], ["T1", "T2", "t 3"]], n), "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = registry.QUERIES["disjunctive_match"](spark, str(tmp_path))
    assert bag(got.select("p_partkey", "n", "least").collect()) == bag(con.sql(registry.ORACLES["disjunctive_match"]).fetchall())


@pytest.mark.parametrize("bits", [6, 8, 26])
def test_maps_of_keys_leave_out_only_what_no_key_equals(spark, bits):
    """Full maps and roomy ones; nulls and repeated rows on both sides."""
    rng = random.Random(5)
    left, right = some(rng, [range(300), "ab"], 400), some(rng, [range(0, 300, 7)], 60)
    rows, keys = spark.createDataFrame(left, "k long, v string"), spark.createDataFrame(right, "k long")
    have = {r[0] for r in right}
    may, cannot = joins.likely(rows, "k", keys, bits).collect(), joins.unlikely(rows, "k", keys, bits).collect()
    assert bag([*may, *cannot]) == bag(left)
    assert not have & {r.k for r in cannot if r.k is not None}
    assert bits < 26 or len(may) < len(left) / 2
    assert bag(joins.without(rows, "k", keys, bits).collect()) == bag(r for r in left if r[0] is None or r[0] not in have)
    assert bag(joins.without(rows, "k", keys.limit(0), bits).collect()) == bag(left)
