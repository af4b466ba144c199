"""Phases of conversations whose starts go back, and of long ones."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from dialoom.operators import cleanup, phases, roles
from dialoom.sources import segments as S

SEGMENTS = "conv_id bigint, idx bigint, id string, start double, end double, speaker string, text string"


def plain_begin(rows, i, seconds):
    b = i
    while b > 0 and not rows[i][1] - rows[b - 1][0] > seconds:
        b -= 1
    return b


@pytest.mark.parametrize("order", ["along", "back", "mixed", "ties", "outliers"])
def test_runs_begin_where_a_plain_walk_ends(spark, order):
    rng = random.Random(order)
    rows = []
    for k in range(300):
        start = {"along": 3.0 * k, "back": 900.0 - 3 * k, "mixed": rng.choice([0.0, 3.0 * k, 1000.0 - k]), "ties": float(k // 20), "outliers": 5000.0 if k == 3 else 0.0 if k == 299 else 2.5 * k}[order]
        rows.append((start, start + rng.choice([0.0, 1.5, 44.999])))
    df = spark.createDataFrame([(rows,)], "r array<struct<start:double,end:double>>").withColumn("m", phases.range_minima(F.transform("r", lambda x: x["start"])))
    for seconds in (45.0, 20.0):
        got = df.select(F.transform("r", begin_at(seconds))).first()[0]
        assert got == [plain_begin(rows, i, seconds) for i in range(len(rows))]


def begin_at(seconds):
    return lambda x, i: phases.run_begin(F.col("m"), i, x["end"], seconds)


def talk(spark, n, last_start=None):
    pool = F.array(*[F.lit(t) for _, t in S.POOL])
    start = F.col("id") * 4.0
    end = start + 3.0
    if last_start is not None:
        start, end = (F.when(F.col("id") == n, x).otherwise(y) for x, y in ((last_start, start), (last_start + 1.0, end)))
    text = F.get(pool, ((F.col("id") * 7 + F.col("id") / 11).cast("bigint") % len(S.POOL)).cast("int"))
    rows = spark.range(1, n + 1).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("idx"), F.format_string("seg_%04d", "id").alias("id"), start.alias("start"), end.alias("end"), F.lit("speaker_0").alias("speaker"), text.alias("text"))
    return phases.with_phases(cleanup.annotate(rows))


def test_a_late_row_of_start_zero_costs_no_more(spark):
    """100,000 rows of which the last starts at 0: the others' labels stay as without it, in linear time."""
    n = 100_000
    began = time.time()
    got = talk(spark, n, 0.0).groupBy("phase").count()
    got = {r["phase"]: r["count"] for r in got.collect()}
    took = time.time() - began
    want = {r["phase"]: r["count"] for r in talk(spark, n - 1).groupBy("phase").count().collect()}
    assert sum(got.values()) == n and got.pop("END") == want.pop("END") + 1 and got == want and len(got) > 3
    assert took < 60


def test_no_rows_and_no_valid_rows(spark):
    empty = phases.with_phases(cleanup.annotate(spark.createDataFrame([], SEGMENTS)))
    assert empty.count() == 0
    noise = phases.with_phases(cleanup.annotate(spark.createDataFrame([(1, 1, "a", 0.0, 1.0, "s", "。，，。"), (2, 1, "a", 500.0, 400.0, "s", "")], SEGMENTS)))
    assert {r["phase"] for r in noise.collect()} == {"INTRO"}


def test_rounding_equals_the_languages_own(spark):
    """Random values, decimal half-way cases (mostly not half-way in binary) and binary ones (to even)."""
    rng = random.Random(8)
    values = [rng.random() for _ in range(3000)] + [k / 1000 + 0.0005 * (k % 2) for k in range(1000)] + [k / 200 for k in range(201)] + [k / 64 for k in range(65)] + [0.0, 1.0, 0.5, 12.345, 2.675, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (2, 4):
        got = [r[0] for r in df.select(roles.rounded(F.col("x"), places)).collect()]
        assert got == [None if v is None else round(v, places) for v in values]
