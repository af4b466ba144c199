"""Points within intervals: an exact range join in work of the order of what it puts out.

Points of a key are ranked in time by one sort that bounds of intervals take part in, so an
interval is a run of ranks.  Ranks are cut into cells of equally many points; an interval meets
the cells that it covers by equality, and all but its first and last lie in it whole.
Intervals may overlap, hold each other or be empty, and points may come in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CELL = 256
POINT, FROM, UNTIL, KEPT = 1, 2, 3, 4


def points_within(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """Which points lie in [from, until) of an interval.

    ``rows``: conv_id, and ``entries``, an array of structs of kind, no, at, item, of which
    POINT has ``at``, ``item`` (any type that has an order) and a number of its own; FROM and UNTIL have an
    interval's number and a bound in ``at`` (of several UNTILs the least holds, without any the
    interval is open; without FROM there is no interval); KEPT has an interval's number and an ``item`` that
    is put out with it.  Points at infinity, NaN or null lie in no interval.

    Returns rows of conv_id, no, items (points, at most ``cell``, in order of ``at``) and kept; an interval has
    as many rows as cells it covers, and one for what is kept.  All steps need no other
    partitioning than by conv_id.  No row of an empty table; null entries are none."""
    each = rows.select("conv_id", F.explode("entries").alias("e")).select("conv_id", "e.*").filter("kind is not null")
    endless = F.lit(float("inf"))
    is_point = F.col("kind") == POINT
    # A bound comes before the points at its time: of them, FROM takes all and UNTIL none.
    in_time = W.partitionBy("conv_id").orderBy("at", is_point, "no").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("n", F.sum(F.when(is_point & (F.col("at") < endless), 1).otherwise(0)).over(in_time))
    ends = F.min(F.when(F.col("kind") == UNTIL, F.col("n"))).over(W.partitionBy("conv_id", is_point, "no"))
    each = each.withColumn("stop", ends).filter(F.col("kind") != UNTIL)
    covered = F.when(F.col("stop") > F.col("n"), F.sequence(F.floor(F.col("n") / cell), F.floor((F.col("stop") - 1) / cell)))
    cells = F.when(is_point, F.when(F.col("at") < endless, F.array(F.floor((F.col("n") - 1) / cell)))).when(F.col("kind") == FROM, covered).otherwise(F.array(-F.col("no").cast("long") - 1))
    each = each.withColumn("cell", F.explode(cells))
    point, piece = F.struct("n", "item"), F.struct("no", F.col("n").alias("after"), "stop")
    held = each.groupBy("conv_id", "cell").agg(
        F.array_sort(F.collect_list(F.when(is_point, point))).alias("points"), F.collect_list(F.when(F.col("kind") == FROM, piece)).alias("pieces"),
        F.collect_list(F.when(F.col("kind") == KEPT, F.col("item"))).alias("kept"),
    )
    nothing = F.array(F.struct((-F.col("cell") - 1).cast("long").alias("no"), F.lit(0).cast("long").alias("after"), F.lit(0).cast("long").alias("stop")))
    held = held.withColumn("p", F.explode(F.when(F.col("cell") < 0, nothing).otherwise(F.col("pieces"))))
    inside = F.filter("points", lambda x: (x["n"] > F.col("p.after")) & (x["n"] <= F.col("p.stop")))
    return held.select("conv_id", "p.no", F.transform(inside, lambda x: x["item"]).alias("items"), "kept")


def entry(kind: int, no, at, item):
    """One of ``entries``."""
    return F.struct(F.lit(kind).alias("kind"), no.cast("long").alias("no"), at.cast("double").alias("at"), item.alias("item"))
