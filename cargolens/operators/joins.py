"""Joins that container listings need: references that must hold, matches that must be unique, ranges, ordinals.

All are generic over DataFrames; keys name the columns of the scope (such as the file a row is from)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.staging import table

#: Rows of bounds up to which every task gets them all.
FEW_BOUNDS = 10_000
#: Bits of a map of keys, as a power of two: at most 2^20 rows of 64 bits.
MAP_BITS = 26


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows of child whose key no parent has; a null key refers to nothing and is no orphan."""
    keys = parent.select(F.col(pk).alias("_pk"))
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def checked_join(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Inner join that fails the query where a child's key has no parent."""
    joined = child.join(parent.withColumn("_there", F.lit(True)), F.col(fk) == F.col(pk), "left")
    return joined.where(F.assert_true(F.col("_there"), F.concat(F.lit(f"{fk} without {pk}: "), F.col(fk).cast("string"))).isNull()).drop("_there")


def exactly_one(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur once; what is ambiguous is as good as absent."""
    return matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def lower_bounds(bounds: DataFrame, last: str, order: str, keys: list[str]) -> DataFrame:
    """Adds lower: the last value of the row before, 0 for the first.

    Without keys the rows are dealt by ranges of their order, and each range takes the last value of the ranges before it."""
    if keys:
        return bounds.withColumn("lower", F.lag(last, 1, 0).over(Window.partitionBy(*keys).orderBy(order)))
    dealt = table(bounds.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "bounds")
    ends = dealt.groupBy("_range").agg(F.max_by(last, order).alias("_end"))
    # One row for each range.
    before = ends.select("_range", F.coalesce(F.lag("_end").over(Window.orderBy("_range")), F.lit(0)).alias("_before"))
    own = F.lag(last).over(Window.partitionBy("_range").orderBy(order))
    return dealt.join(before, "_range").withColumn("lower", F.coalesce(own, "_before")).drop("_range", "_before")


def range_join(items: DataFrame, bounds: DataFrame, value: str, last: str, order: str, keys: list[str] = (), how: str = "inner") -> DataFrame:
    """Items with the row of bounds whose half-open interval (row before's last, last] holds their value; how: inner or left.

    Few bounds go to every task. More meet their items in cells as wide as an average interval: an item is in one cell, an
    interval in all cells that it meets."""
    within = (F.col(value) > F.col("lower")) & (F.col(value) <= F.col(last))
    same = [F.col(f"i.{k}") == F.col(f"b.{k}") for k in keys]
    few = not keys and bounds.count() <= FEW_BOUNDS
    ranges = bounds.withColumn("lower", F.lag(last, 1, 0).over(Window.orderBy(order))) if few else lower_bounds(bounds, last, order, list(keys))
    kept = [f"b.{c}" for c in ranges.columns if c not in keys]
    if keys or few:
        side = ranges if keys else F.broadcast(ranges)
        return items.alias("i").join(side.alias("b"), [*same, within] if same else within, how).select("i.*", *kept)
    width = ranges.agg((F.max(last) - F.min("lower")) / F.count(F.lit(1))).first()[0] or 1
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    celled = ranges.where(F.col(last) > F.col("lower")).withColumn("_cell", F.explode(F.sequence(cell("lower"), cell(last))))
    # The interval is part of the join's condition, so that a left join keeps items that only share a cell with one.
    met = items.withColumn("_own", cell(value)).alias("i").join(celled.alias("b"), [F.col("_own") == F.col("_cell"), within], how)
    return met.select(*(f"i.{c}" for c in items.columns), *kept)


def disjunctive_match(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that agree on any pair of columns, once each: a union of equi-joins, so that each of them is a hash or merge join.

    A join leaves out what an earlier one has, so that only the two sides are freed of repeated rows, never the matches."""
    left, right = left.distinct(), right.distinct()
    out, had = None, F.lit(False)
    for a, b in pairs:
        same = F.col(a) == F.col(b)
        part = left.join(right, same & ~had)
        out = part if out is None else out.unionByName(part)
        had = had | F.coalesce(same, F.lit(False))
    return out


def disjunctive_counts(left: DataFrame, right: DataFrame, key: str, pairs: list[tuple[str, str]], value: Column) -> DataFrame:
    """(key, n, least) of disjunctive_match by a key of the left: how many distinct rows of the right its rows meet, and the least value of these.

    Matches are counted, not listed: inclusion and exclusion over the pairs. What agrees on some pairs at once are the right's rows, counted by
    these columns, that have a combination of the key's values there; a key that occurs once has one combination."""
    right = right.select("*", value.alias("_value")).distinct()
    left = left.select(key, *(a for a, _ in pairs)).repartition(key)  # a key's rows are in one task from here on, and a task has a partition's
    terms = []
    for size in range(1, len(pairs) + 1):
        for some in combinations(pairs, size):
            own = None
            for a, _ in some:
                values = left.where(F.col(a).isNotNull()).select(F.col(key).alias(f"_key_{a}"), a).distinct()
                own = values.withColumnRenamed(f"_key_{a}", "_key") if own is None else own.join(values, F.col("_key").eqNullSafe(F.col(f"_key_{a}"))).drop(f"_key_{a}")
            counts = right.groupBy(*(b for _, b in some)).agg(F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_least"))
            on = [F.col(a) == F.col(b) for a, b in some]
            terms.append(own.join(counts, on).select("_key", (F.col("_n") * (-1) ** (size + 1)).alias("_n"), "_least"))
    every = reduce(DataFrame.unionByName, terms)
    return every.groupBy(F.col("_key").alias(key)).agg(F.sum("_n").alias("n"), F.min("_least").alias("least"))


def bijection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(matched, only_left, only_right) counts of distinct keys; a bijection has no leftovers."""
    a, b = left.select(F.col(key).alias("a")).distinct(), right.select(F.col(key).alias("b")).distinct()
    count = lambda c: F.count_if(c).cast("long")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").agg(
        count(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"),
        count(F.col("b").isNull()).alias("only_left"),
        count(F.col("a").isNull()).alias("only_right"),
    )


def first_wins(references: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, not a window: rows of a hot key meet their task's first one before the shuffle."""
    rest = [c for c in references.columns if c not in keys and c not in order]
    return references.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def ordinal_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], how: str = "left") -> DataFrame:
    """The n-th row of a key on the left with its n-th on the right: each takes the first one still free."""
    n = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return left.withColumn("ordinal", n(left_order)).join(right.withColumn("ordinal", n(right_order)), [*keys, "ordinal"], how)


def permutations(entries: DataFrame, keys: list[str], index: str, first: int = 0) -> DataFrame:
    """For each scope, whether its indexes are first, first + 1, ... without gaps or repeats."""
    n = F.count(F.lit(1))
    whole = (F.min(index) == first) & (F.max(index) == first + n - 1) & (F.count_distinct(index) == n)
    return entries.groupBy(*keys).agg(n.cast("long").alias("n"), whole.alias("permutation"))


def by_index(entries: DataFrame, parts: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Entries with the part that their index points to; an index without a part drops out."""
    return entries.join(parts, [*keys, index])


def by_permutation(entries: DataFrame, manifest: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Entries with the manifest's row of their index; a scope whose indexes are no permutation of the manifest's loses all its rows."""
    sizes = manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    whole = permutations(entries, keys, index).join(sizes, keys).where(F.col("permutation") & (F.col("n") == F.col("_size"))).select(*keys)
    return entries.join(whole, keys, "left_semi").join(manifest, [*keys, index])


def first_source(wanted: DataFrame, sources: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """wanted with value and source: of the first source that has the key. Sources have one row for a key."""
    out = wanted
    for name, rows in sources.items():
        own = rows.select(F.col(key).alias(f"_key_{name}"), F.struct(F.lit(name).alias("source"), F.col(value).alias(value)).alias(f"_{name}"))
        out = out.join(own, F.col(key) == F.col(f"_key_{name}"), "left").drop(f"_key_{name}")
    found = F.coalesce(*(F.col(f"_{name}") for name in sources))
    return out.withColumn("_found", found).select(*wanted.columns, "_found.source", f"_found.{value}")


def dictionary_decode(cells: DataFrame, pool: DataFrame, reference: str, keys: list[str], out: str) -> DataFrame:
    """String references to a pool (keys, string_id, value); 0 is the empty string, a dangling reference null."""
    p = pool.select(*keys, F.col("string_id").alias(reference), F.col("value").alias("_value"))
    value: Column = F.when(F.col(reference) == 0, F.lit("")).otherwise(F.col("_value"))
    return cells.join(p, [*keys, reference], "left").withColumn(out, value).drop("_value")


def likely(rows: DataFrame, column: str, keys: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """Rows whose column may have one of the keys (column of that name): all that have, and few others while keys are few beside 2^bits.

    A bit map says so, broadcast as words of 64 bits, so that rows without a key need no shuffle however many keys there are."""
    return _mapped(rows, column, keys, bits, True)


def unlikely(rows: DataFrame, column: str, keys: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """The rows that likely() leaves out: none has one of the keys. A null counts as a value here, which no key equals."""
    return _mapped(rows, column, keys, bits, False)


def without(rows: DataFrame, column: str, keys: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """Rows with none of the keys: an anti join, exact, that moves only rows whose key is likely."""
    return unlikely(rows, column, keys, bits).unionByName(likely(rows, column, keys, bits).join(keys.select(column), column, "left_anti").select(*rows.columns))


def _mapped(rows: DataFrame, column: str, keys: DataFrame, bits: int, there: bool) -> DataFrame:
    place = F.call_function("shiftrightunsigned", F.xxhash64(column), F.lit(64 - bits))
    bit = lambda at: F.pmod(at, F.lit(64)).cast("int")
    placed = keys.select(place.alias("_at"))
    words = placed.groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("_at")))).alias("_bits"))
    marked = rows.withColumn("_at", place).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word", "inner" if there else "left")
    set_ = F.call_function("shiftrightunsigned", F.coalesce("_bits", F.lit(0).cast("long")), bit(F.col("_at"))).bitwiseAND(F.lit(1).cast("long")) == 1
    return marked.where(set_ if there else ~set_).select(*rows.columns)
