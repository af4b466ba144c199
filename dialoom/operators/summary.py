"""Statistics of a conversation: one row each, from its segments, questions and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REASONS = ("long_duration_low_text_density", "long_duration_very_little_text", "pure_or_repeated_punctuation", "repetitive_noise_transcription")
FROM_TREE = ("question_count", "main_question_count", "follow_up_count", "clarification_count", "topic_switch_count")


def statistics(roled: DataFrame, tree: DataFrame, events: DataFrame, v1: DataFrame) -> DataFrame:
    """The sixteen counters; ``roled`` bears v1_role.  Each input is summed to a row a conversation
    before the four meet, so the joins are of narrow, unique rows."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    valid, role = F.col("valid"), F.col("role")
    known = F.col("v1_role").isin("interviewer", "candidate") & role.isin("interviewer", "candidate")
    reasons = F.map_from_arrays(F.array(*[F.lit(r) for r in REASONS]), F.array(*[n(F.array_contains("reasons", r)) for r in REASONS]))
    segments = roled.groupBy("conv_id").agg(
        F.count("*").alias("raw_segment_count"), n(valid).alias("valid_segment_count"), n(~valid).alias("invalid_segment_count"), n(role == "unknown").alias("unknown_role_count"),
        n(valid & (role == "unknown")).alias("valid_unknown_role_count"), n(valid & known & (role != F.col("v1_role"))).alias("role_correction_count"), reasons.alias("cleanup_reason_counts"),
    )
    segments = segments.withColumn("cleanup_reason_counts", F.map_filter("cleanup_reason_counts", lambda k, v: v > 0))
    kind, root = F.col("node_type"), F.col("child_no") == 0
    nodes = tree.groupBy("conv_id").agg(
        F.count("*").alias("question_count"), n(root).alias("main_question_count"), n(kind == "follow_up").alias("follow_up_count"), n(kind == "clarification").alias("clarification_count"),
        n(root & (F.col("relation_to_previous") == "topic_switch")).alias("topic_switch_count"),
    )
    happened = events.groupBy("conv_id").agg(F.count("*").alias("coding_event_count"), n(F.col("event_type") == "coding_silence").alias("coding_silence_event_count"))
    listed = v1.groupBy("conv_id").agg(F.count("*").alias("v1_qa_count"))
    out = segments.join(nodes, "conv_id", "left").join(happened, "conv_id", "left").join(listed, "conv_id", "left")
    counts = [*FROM_TREE, "coding_event_count", "coding_silence_event_count", "v1_qa_count"]
    return out.na.fill(0, counts).withColumn("qa_count", F.col("main_question_count"))
