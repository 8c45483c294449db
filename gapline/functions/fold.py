"""Folds over arrays as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outputs are appended to arrays of so many, and those to each other: appending to one long array would copy it each time.
PART = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, state: Column, state_type: str, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str, last: Callable[[Column], Column] | None = None) -> Column:
    """One output for each item of an array, in order, from a state that goes from item to item.

    ``step(state, item)`` gives the next state and the output; ``last(state)`` one more output at the end. All of it is an expression
    over the array, without shuffle or Python.
    """
    whole = f"struct<state:{state_type},out:array<{out_type}>>"
    outer = f"struct<state:{state_type},parts:array<array<{out_type}>>>"
    none = F.array().cast(f"array<{out_type}>")

    def inner(acc: Column, item: Column) -> Column:
        after, out = step(acc["state"], item)
        return F.struct(after.cast(state_type).alias("state"), F.array_append(acc["out"], out.cast(out_type)).alias("out")).cast(whole)

    def over(a: Column) -> Column:
        def part(acc: Column, at: Column) -> Column:
            done = F.aggregate(F.slice(a, at * PART + 1, F.lit(PART)), F.struct(acc["state"].alias("state"), none.alias("out")).cast(whole), inner)
            return let(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(acc["parts"], d["out"]).alias("parts")).cast(outer))

        parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(a) / PART).cast("int") - 1))
        start = F.struct(state.cast(state_type).alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("parts")).cast(outer)
        return F.aggregate(parts, start, part, finish)

    def finish(acc: Column) -> Column:
        made = F.flatten(acc["parts"])
        return made if last is None else F.array_append(made, last(acc["state"]).cast(out_type))

    return let(items, over)
