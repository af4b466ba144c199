"""Events of the coding phases: noise, low speech density and silence, merged when close in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.operators import phases


def coding_events(phased: DataFrame, least_silence: float = 8.0) -> DataFrame:
    """An event per invalid row of the coding phases and per silence between two of their rows.
    A row gives at most one of each: both are built in one pass and exploded."""
    after = F.lead(F.struct("start", "phase", "id")).over(phases.in_order())
    rows = phased.withColumns({"after": after, "coding": F.col("phase").startswith("CODING")})
    sparse = F.exists("reasons", lambda r: r.startswith("long_duration"))
    kind = F.when(sparse, "coding_low_speech_density").otherwise("coding_noise")
    invalid = F.when(F.col("coding") & ~F.col("valid"), F.struct(kind.alias("event_type"), "phase", "start", "end", F.array("id").alias("segment_ids"), "reasons"))
    quiet = F.col("coding") & F.col("after.phase").startswith("CODING") & (F.col("after.start") - F.col("end") >= least_silence)
    why = F.array(F.lit("gap_between_coding_segments"))
    silent = F.when(quiet, F.struct(F.lit("coding_silence").alias("event_type"), F.lit("CODING").alias("phase"), F.col("end").alias("start"), F.col("after.start").alias("end"), F.array("id", "after.id").alias("segment_ids"), why.alias("reasons")))
    return rows.select("conv_id", "idx", F.explode(F.array_compact(F.array(invalid, silent))).alias("e")).select("conv_id", "idx", "e.*")


def merged_events(events: DataFrame, gap: float = 3.0) -> DataFrame:
    """Runs of one event type, in order of start and end, in which each starts at most ``gap``
    seconds after all before it have ended.  The first gives the phase; segment ids are appended,
    repeats included, and reasons united.  All windows share one exchange on conv_id."""
    order = ["start", "end", (F.col("event_type") == "coding_silence").cast("int"), "idx"]
    by_time = W.partitionBy("conv_id").orderBy(*order)
    kinds = F.coalesce(F.col("event_type") != F.lag("event_type").over(by_time), F.lit(True)).cast("int")
    rows = events.withColumns({"_at": F.row_number().over(by_time), "_kind": kinds})
    along = W.partitionBy("conv_id").orderBy("_at")
    rows = rows.withColumn("_kind", F.sum("_kind").over(along))
    ended = F.max("end").over(W.partitionBy("conv_id", "_kind").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_fresh", F.coalesce(F.col("start") > ended + gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("event_no", F.sum("_fresh").over(along))
    parts = F.sort_array(F.collect_list(F.struct("_at", "segment_ids")))
    out = rows.groupBy("conv_id", "event_no").agg(
        F.first("event_type").alias("event_type"), F.min_by("phase", "_at").alias("phase"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.flatten(F.transform(parts, lambda x: x["segment_ids"])).alias("segment_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
    )
    return out.withColumns({"id": F.format_string("event_%03d", "event_no"), "duration_seconds": F.round(F.col("end") - F.col("start"), 3)})
