"""Folds over a conversation's rows whose state is small and whose output is as long as the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: rows of a block: each step copies what its block has put out so far, each block what the blocks have
BLOCK = 256


def folded(rows: str, begin: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` appends to the field ``out`` of its state, over all ``rows`` (the name of an array column).

    The state goes through all rows, but ``out`` grows within a block of rows only; blocks are
    joined at the end.  So n rows cost n * BLOCK / 2 copied places and (n / BLOCK)^2 / 2 copied
    blocks, where one growing array would cost n^2 / 2."""
    last = F.floor((F.size(rows) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.when(F.size(rows) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
    fresh = F.slice(begin["out"], 1, 0)

    def over(now: Column, block: Column) -> Column:
        done = F.aggregate(block, now["state"], step)
        return F.transform(F.array(done), lambda x: F.struct(x.withField("out", fresh).alias("state"), F.array_append(now["outs"], x["out"]).alias("outs")))[0]

    none = F.slice(F.array(begin["out"]), 1, 0)
    return F.flatten(F.aggregate(blocks, F.struct(begin.alias("state"), none.alias("outs")), over)["outs"])
