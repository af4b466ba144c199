"""A task's share of the conversations' rows stays the same as the tables grow."""

import pytest
from pyspark.sql import functions as F

from dialoom.sources import segments as S


def rows_of(spark, n):
    at = F.timestamp_seconds(F.col("id"))
    return spark.range(n).select((F.col("id") % (n // 60)).alias("conv_id"), at.alias("ts"), F.col("id").alias("event_id"), F.lit("text").alias("text"))


@pytest.mark.parametrize("n", [300_000, 900_000])
def test_a_tasks_rows_do_not_grow(spark, n):
    out = S.numbered(rows_of(spark, n))
    held = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in held) == n
    assert max(r.n for r in held) < 1.3 * S.MOST_ROWS


def test_few_and_no_rows(spark):
    assert S.partitions_for(spark.range(0)) == 1
    assert S.partitions_for(spark.range(10)) == 1
    assert S.numbered(rows_of(spark, 120)).count() == 120
    assert S.numbered(rows_of(spark, 120).limit(0)).count() == 0
