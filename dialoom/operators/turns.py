"""Second-version turns: segments of one role and phase family that follow each other closely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.folds import folded
from dialoom.operators.phases import family
from dialoom.operators.roles import rounded


def v2_turns(roled: DataFrame, gap: float = 1.2, unknown_gap: float = 0.7) -> DataFrame:
    """conv_id, turn_no, start, end, speaker_ids, role, role_confidence, phase, text, segment_ids.

    A turn takes the next valid segment if it is of the same phase family, starts within ``gap`` of
    the turn's latest end, and has the turn's role, or no known role, little of a question and a
    gap within ``unknown_gap``.  A taken segment without role has the turn's, so runs depend on what
    was decided before: the turn's role and end are folded, turns are grouped by the number found."""
    names = ["idx", "id", "speaker", "role", "role_confidence", "phase", "start", "end", "text", "strength"]
    rows = roled.filter("valid").select("conv_id", F.struct(*names, family(F.col("phase")).alias("family")).alias("r"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    begin = F.struct(F.lit(0).alias("no"), F.lit("").alias("role"), F.lit("").alias("family"), F.lit(0.0).alias("end"), F.array().cast("array<int>").alias("out"))

    def step(turn: Column, r: Column) -> Column:
        wait = r["start"] - turn["end"]
        loose = (r["role"] == "unknown") & (turn["role"] != "unknown") & (wait <= min(unknown_gap, gap)) & (r["strength"] < 2.0)
        joins = (turn["no"] > 0) & (turn["family"] == r["family"]) & (wait <= gap) & (((turn["role"] == r["role"]) & (r["role"] != "unknown")) | loose)

        def numbered(joined: Column) -> Column:
            no = turn["no"] + F.when(joined, 0).otherwise(1)
            return F.struct(
                no.alias("no"), F.when(joined, turn["role"]).otherwise(r["role"]).alias("role"), F.when(joined, turn["family"]).otherwise(r["family"]).alias("family"),
                F.when(joined, F.greatest(turn["end"], r["end"])).otherwise(r["end"]).alias("end"), F.array_append(turn["out"], no).alias("out"),
            )

        return F.transform(F.array(joins), numbered)[0]

    talks = talks.withColumn("nos", folded("rows", begin, step))
    each = talks.select("conv_id", F.explode(F.arrays_zip("nos", "rows")).alias("p")).select("conv_id", F.col("p.nos").alias("turn_no"), F.col("p.rows").alias("r"))
    found = each.groupBy("conv_id", "turn_no").agg(F.array_sort(F.collect_list("r")).alias("m"), F.max("r.end").alias("end"), F.min("r.role_confidence").alias("sure"))
    of = lambda field: F.transform("m", lambda x: x[field])
    return found.select(
        "conv_id", "turn_no", F.col("m")[0]["start"].alias("start"), "end", F.array_distinct(of("speaker")).alias("speaker_ids"), F.col("m")[0]["role"].alias("role"),
        rounded(F.col("sure"), 2).alias("role_confidence"), F.col("m")[0]["phase"].alias("phase"), F.array_join(of("text"), "").alias("text"), of("id").alias("segment_ids"),
    )
