"""Folds over long arrays, as columns.

Appending to an array in `aggregate` copies it every time. Here the array is cut into blocks: a block's output is
gathered on its own, and only whole blocks are appended, so the work is n * sqrt(n) small copies at worst.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once: what a lambda refers to is evaluated anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], emitted: str, close: Callable[[Column, Column], Column] | None = None) -> Column:
    """Runs step(state, value) -> (next state, array of what it emits) over values; returns all that was emitted.

    emitted is the array's type. close(state, all) makes the result of the last state and what was emitted.
    """
    none = F.array().cast(emitted)
    pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def one(acc: Column, value: Column) -> Column:
        state, new = step(acc["state"], value)
        return pair(state, F.concat(acc["out"], new))

    def of_block(acc: Column, block: Column) -> Column:
        return F.aggregate(block, pair(acc["state"], none), one, lambda done: pair(done["state"], F.concat(acc["out"], done["out"])))

    def run(bound: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(bound) / BLOCK).cast("int") - 1), lambda i: F.slice(bound, i * BLOCK + 1, F.lit(BLOCK)))
        folded = F.aggregate(blocks, pair(start, none), of_block, lambda done: close(done["state"], done["out"]) if close else done["out"])
        return F.when(F.size(bound) > 0, folded).otherwise(close(start, none) if close else none)

    return let(values, run)  # the array's expression stands in the plan once
