"""Folds in blocks: the same rows as one fold, in time that grows with the rows."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from dialoom.functions import folds


def step(now, x):
    total = (now["total"] * 3 + x) % 1000003
    return F.struct(total.alias("total"), F.array_append(now["out"], total).alias("out"))


def begin():
    return F.struct(F.lit(7).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("out"))


@pytest.mark.parametrize("block", [1, 3, 256])
def test_blocks_change_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(folds, "BLOCK", block)
    df = spark.range(12).select((F.col("id") * 5 - 3).alias("n")).selectExpr("n", "CASE WHEN n < 0 THEN array() ELSE sequence(0L, n) END AS xs")
    for r in df.select("xs", folds.folded("xs", begin(), step).alias("out")).collect():
        total, want = 7, []
        for x in r["xs"]:
            total = (total * 3 + x) % 1000003
            want.append(total)
        assert r["out"] == want


def test_a_long_fold_takes_linear_time(spark):
    took = []
    for n in (100_000, 400_000):
        df = spark.range(1).selectExpr(f"sequence(1L, {n}L) AS xs")
        began = time.time()
        assert df.select(F.size(folds.folded("xs", begin(), step)).alias("n")).first()["n"] == n
        took.append(time.time() - began)
    assert took[1] < 30
