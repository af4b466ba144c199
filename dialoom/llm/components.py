"""Connected components of a link table by randomised contraction, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of ``links`` (a, b): one root per component.

    A round sends each vertex to the neighbour (or itself) of least keyed hash, maps links
    through that and drops loops; the links shrink by a constant share a round, chains
    included.  The rounds' maps are composed once, at the end.  Minima are partial sums,
    and joins shuffle on both sides, so a hub is split.
    """
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    turns: list[DataFrame] = []
    while not turns or not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(turns)), F.col(c)).alias("h"), F.col(c).alias("v"))
        moved = both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a"))).alias("to"))
        moved = materialize(moved.select(F.col("a").alias("id"), F.col("to.v").alias("root")), "moves")
        turns.append(moved)
        for end in ("a", "b"):
            edges = edges.join(moved.select(F.col("id").alias(end), F.col("root").alias("_root")), end).withColumn(end, F.col("_root")).drop("_root")
        edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialize(edges.distinct(), "links")
    labels = turns.pop()
    while turns:  # from the last and smallest turn back to the first
        step = labels.select(F.col("id").alias("root"), F.col("root").alias("_to"))
        labels = turns.pop().join(step, "root", "left").select("id", F.coalesce("_to", "root").alias("root"))
    return materialize(labels, "labels")
