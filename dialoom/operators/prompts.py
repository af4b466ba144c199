"""Prompts and their answers: anchors, spans around them, merged spans, as-of joined answers.

Every step is a window or a grouping within conversations, on the exchange that numbered the
segments: spans take their members from range frames, and an answer's segments meet their
prompts by ranks in time, never all with all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.operators.intervals import FROM, KEPT, POINT, UNTIL, entry, points_within
from dialoom.operators.phases import family, in_order, so_far
from dialoom.operators.roles import rounded


def with_anchors(roled: DataFrame) -> DataFrame:
    """Adds family, asked_by (null: no anchor) and anchor: whether a segment opens a prompt."""
    s, phase = F.col("strength"), F.col("phase")
    barred = F.col("ack") | F.col("admin") | F.col("invitation") | (F.col("no_more") & ~F.col("direct"))
    explicit = F.col("marked") & (F.col("m") >= 4) & (F.col("word") | F.col("direct"))
    coding = F.when((s >= 3.0) | F.col("direct"), "interviewer")
    asked = F.when((s >= 2.5) | (explicit & (s >= 2.0)) | F.col("direct"), "interviewer")
    other = F.when(F.col("direct") | (F.col("precise") & (s >= 2.0)), "interviewer")
    own = F.when((s >= 2.5) | F.col("marker"), "candidate")
    by = F.when(phase == "CANDIDATE_QUESTIONS", own).when(phase.startswith("CODING"), coding).when(F.col("role") == "interviewer", asked).otherwise(other)
    # What follows an example is part of it, unless it addresses someone.
    vetoed = F.coalesce(F.lag("example").over(in_order()), F.lit(False)) & ~F.col("direct")
    open_ = F.col("valid") & (phase != "END") & ~barred & ~vetoed
    return roled.withColumns({"family": family(phase), "asked_by": F.when(open_, by)}).withColumn("anchor", F.col("asked_by").isNotNull())


def with_spans(anchored: DataFrame, longest: float = 8.0, gap: float = 1.2, back_gap: float = 0.8) -> DataFrame:
    """Adds to anchors ``members``, the segments of their span, from one before to some after.

    The run after an anchor ends before the first row that stops it, and with the first row that
    bears a question mark.  What stops any run (an anchor, an invalid or responding row, a pause, another
    family) parts the rows, so a frame lies between two such rows, whatever the starts; in it, rows within
    ``longest`` seconds: the greatest start so far never falls and passes the anchor's by that at most."""
    me = F.struct("pos", "id", "speaker", "text", "role_confidence", "start", "end")
    rows = anchored.withColumns(
        {
            "_reach": F.max(F.rint(F.col("start") * 1000).cast("long")).over(so_far()), "_wait": F.col("start") - F.lag("end").over(in_order()),
            "_before": F.lag(F.struct(me.alias("me"), "valid", "anchor", "family", "role", "response", "end")).over(in_order()),
        }
    )
    rows = rows.withColumns({"_me": me, "_look": F.struct("pos", "role", "role_confidence", "speaker", "end", "marked", me.alias("me"))})
    cut = F.col("anchor") | ~F.col("valid") | (F.col("_wait") > gap) | F.col("response") | (F.col("family") != F.lag("family").over(in_order()))
    rows = rows.withColumn("_part", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("_part", F.sum("_part").over(so_far()))
    frame = W.partitionBy("conv_id", "_part").orderBy("_reach").rangeBetween(0, int(longest * 1000) + 2)
    rows = rows.withColumn("_after", F.when(F.col("anchor"), F.array_sort(F.filter(F.collect_list("_look").over(frame), lambda x: x["pos"] > F.col("pos")))))
    stops = F.filter(
        "_after",
        lambda x: (x["end"] - F.col("start") > longest)
        | ((x["role"] != F.col("asked_by")) & (x["role_confidence"] >= 0.6) & (x["speaker"] != F.col("speaker"))),
    )
    last = F.when(F.col("marked"), F.col("pos")).otherwise(
        F.least(
            F.coalesce(F.array_min(F.transform(stops, lambda x: x["pos"])) - 1, F.lit(1 << 30)),
            F.coalesce(F.array_min(F.transform(F.filter("_after", lambda x: x["marked"]), lambda x: x["pos"])), F.lit(1 << 30)),
        )
    )
    b = F.col("_before")
    joins = b["valid"] & ~b["anchor"] & (b["family"] == F.col("family")) & (F.col("start") - b["end"] <= back_gap) & (b["role"] == F.col("asked_by")) & ~b["response"]
    rows = rows.withColumns({"_last": last, "_back": F.when(joins, F.array(b["me"])).otherwise(F.array().cast(rows.select(F.array("_me")).schema[0].dataType))})
    members = F.concat("_back", F.array("_me"), F.transform(F.filter("_after", lambda x: x["pos"] <= F.col("_last")), lambda x: x["me"]))
    return rows.withColumn("members", F.when(F.col("anchor"), members)).drop("_reach", "_part", "_wait", "_before", "_me", "_look", "_after", "_last", "_back")


def with_prompt_numbers(spanned: DataFrame, gap: float = 0.5) -> DataFrame:
    """Adds prompt_no, p_start, p_end to anchors: spans of one asker and family that overlap or
    nearly touch are one prompt, which starts with the first and ends with the latest."""
    key = F.struct("asked_by", "family")
    rows = spanned.withColumns({"_from": F.get("members", F.lit(0))["start"], "_to": F.get("members", F.size("members") - 1)["end"], "_key": F.when(F.col("anchor"), key)})
    rows = rows.withColumn("_turn", F.when(F.col("anchor") & ~F.col("_key").eqNullSafe(F.last("_key", ignorenulls=True).over(so_far(-1))), 1).otherwise(0))
    rows = rows.withColumn("_turn", F.sum("_turn").over(so_far()))
    ended = F.max("_to").over(W.partitionBy("conv_id", "_turn").orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("anchor") & F.coalesce(F.col("_from") > ended + gap, F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("prompt_no", F.when(F.col("anchor"), F.sum("_new").over(so_far())))
    mine = W.partitionBy("conv_id", "prompt_no")
    rows = rows.withColumns({"p_start": F.when(F.col("anchor"), F.min_by("_from", "pos").over(mine)), "p_end": F.when(F.col("anchor"), F.max("_to").over(mine))})
    return rows.drop("_from", "_to", "_key", "_turn", "_new")


def prompts_with_answers(roled: DataFrame) -> DataFrame:
    """A row per prompt: conv_id, prompt_no, start, end, speaker_ids, asked_by, role_confidence,
    phase, family, text, segment_ids, new flags of its text, and ``answer`` (null: none) as
    role, role_confidence, start, end, speaker_ids, segment_ids, text.

    A segment answers the prompts that have ended by its start and whose successor starts after it,
    save those it is part of; starts may come in any order and prompts may overlap, so it
    may answer several."""
    rows = with_prompt_numbers(with_spans(with_anchors(roled)))
    fits = F.col("valid") & (F.col("phase") != "END") & ~F.col("ack") & ~F.col("admin")
    seg = F.struct("pos", "id", "speaker", "text", "role_confidence", "start", "end")
    anchor = F.struct("pos", F.col("p_start").alias("start"), F.col("p_end").alias("end"), "members", "asked_by", "phase", "family")
    shapes = rows.select(seg, anchor).schema
    item = lambda s=None, p=None: F.struct(*[(F.lit(None).cast(shapes[k].dataType) if x is None else x).alias("sp"[k]) for k, x in enumerate((s, p))])
    rows = rows.withColumn("_first", F.col("anchor") & ~F.col("prompt_no").eqNullSafe(F.last("prompt_no", ignorenulls=True).over(so_far(-1))))
    no, none = F.col("prompt_no"), F.lit(None)
    entries = F.array(
        F.when(fits, entry(POINT, F.col("pos"), F.col("start"), item(s=seg))),
        F.when(F.col("anchor"), entry(KEPT, no, none, item(p=anchor))),
        F.when(F.col("_first"), entry(FROM, no, F.col("p_end"), item())),
        # A prompt's first row ends the one before; the last prompt ends never.
        F.when(F.col("_first"), entry(UNTIL, no - 1, F.col("p_start"), item())),
        F.when(F.col("_first"), entry(UNTIL, no, F.lit(float("inf")), item())),
    )
    each = points_within(rows.select("conv_id", F.array_compact(entries).alias("entries")))
    found = each.select("conv_id", F.col("no").alias("prompt_no"), F.transform("items", lambda x: x["s"]).alias("s"), F.transform("kept", lambda x: x["p"]).alias("p"))
    found = found.groupBy("conv_id", "prompt_no").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("a"), F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    first = F.get("p", F.lit(0))
    members = F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: x["members"]))))
    sure = F.array_max(F.transform(first["members"], lambda x: x["role_confidence"]))
    found = found.select("conv_id", "prompt_no", members.alias("m"), "a", F.struct(first["start"].alias("start"), first["end"].alias("end"), first["asked_by"].alias("asked_by"), first["phase"].alias("phase"), first["family"].alias("family"), sure.alias("sure")).alias("p"))
    found = found.withColumn("a", F.filter("a", lambda x: ~F.exists("m", lambda y: y["pos"] == x["pos"])))
    of = lambda c, field: F.transform(c, lambda x: x[field])
    mean = F.aggregate(of("a", "role_confidence"), F.lit(0.0), lambda t, x: t + x) / F.size("a")
    answer = F.struct(
        F.when(F.col("p.asked_by") == "interviewer", "candidate").otherwise("interviewer").alias("role"), rounded(mean, 2).alias("role_confidence"), F.get("a", F.lit(0))["start"].alias("start"),
        F.get("a", F.size("a") - 1)["end"].alias("end"), F.array_distinct(of("a", "speaker")).alias("speaker_ids"), of("a", "id").alias("segment_ids"), F.array_join(of("a", "text"), "").alias("text"),
    )
    return found.select(
        "conv_id", "prompt_no", "p.start", "p.end", F.array_distinct(of("m", "speaker")).alias("speaker_ids"), "p.asked_by", rounded(F.greatest(F.lit(0.55), "p.sure"), 2).alias("role_confidence"),
        "p.phase", "p.family", F.array_join(of("m", "text"), "").alias("text"), of("m", "id").alias("segment_ids"), F.when(F.size("a") > 0, answer).alias("answer"),
    )


def prompt_spans(roled: DataFrame) -> DataFrame:
    return prompts_with_answers(roled).drop("answer", "family")
