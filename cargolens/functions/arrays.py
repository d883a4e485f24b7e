"""Folds over arrays, in time linear in their length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements to a block: within one, and over the blocks, a fold copies its growing array.
BLOCK = 64


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row: lambdas would compute an inlined expression for each element, and take a binary column out of its row each time."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column) -> Column:
    """Running sums of an array of longs. Two levels of folds, so that the copying stays small for thousands of elements."""

    def fold(x: Column, start: Column) -> Column:
        acc = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, acc, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"] + v)).alias("out")), lambda a: a["out"])

    def blocks(x: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))
        return let(
            starts,
            lambda s: let(
                fold(F.transform(s, lambda y: F.aggregate(y, F.lit(0).cast("bigint"), lambda a, v: a + v)), F.lit(0).cast("bigint")),
                lambda ends: F.flatten(F.transform(s, lambda y, i: fold(y, F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, i - 1))))),
            ),
        )

    return let(values, lambda x: F.when(F.size(x) == 0, x).otherwise(blocks(x)))


def fold_rows(n: Column, state: Column, step, none: Column, block: int = 256) -> Column:
    """(state, rows) after steps 0 to n - 1, n at least 1: step(state, i) gives a struct of the next state and an array of rows to add. none: an empty array of rows."""

    def within(acc: Column, b: Column) -> Column:
        numbers = F.sequence(b * block, F.least(b * block + block, n) - 1)
        begin = F.struct(acc["state"].alias("state"), none.alias("rows"))
        return F.aggregate(numbers, begin, lambda a, i: let(step(a["state"], i), lambda r: F.struct(r["state"].alias("state"), F.concat(a["rows"], r["rows"]).alias("rows"))))

    begin = F.struct(state.alias("state"), F.slice(F.array(none), 1, 0).alias("rows"))
    blocks = F.sequence(F.lit(0), (F.ceil(n / block) - 1).cast("int"))
    add = lambda acc, b: let(within(acc, b), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["rows"], F.array(r["rows"])).alias("rows")))
    return F.aggregate(blocks, begin, add, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["rows"]).alias("rows")))
