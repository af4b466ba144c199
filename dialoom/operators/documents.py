"""Documents of the first and second version: a conversation's tables nested in order, as their contracts
(``functions.contracts``) say.  ``created_at`` is one moment for a whole run, taken when it is planned,
unless given."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import contracts as C

METHOD = "deterministic_local_heuristics"
#: what a source may tell of a conversation beside its segments, all optional
SOURCE = {"source_audio": "string", "audio": "variant", "pipeline": "variant", "preprocessing": "variant"}
NODE_FIELDS = ("node_type", "relation_to_previous", "asked_by", "role_confidence", "phase", "start", "end", "speaker_ids", "segment_ids", "text", "topic")


def moment(created_at: str | None) -> Column:
    return F.lit(created_at or datetime.now(UTC).isoformat())


def nested(df: DataFrame, order: str, name: str, *drop: str) -> DataFrame:
    """conv_id and an array of the other columns in ``order``."""
    kept = [c for c in df.columns if c not in ("conv_id", *drop)]
    first = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)  # noqa: E731  # maps have no order
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*kept).alias("x"))), first)
    return df.groupBy("conv_id").agg(F.transform(rows, lambda p: p["x"]).alias(name))


def with_lists(rows: DataFrame, **lists: DataFrame) -> DataFrame:
    """Joins tables of one array a conversation; where there is none the array is empty."""
    for name, df in lists.items():
        rows = rows.join(df, "conv_id", "left")
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return rows


def with_source(rows: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Adds what ``sources`` (conv_id and some of SOURCE) tell; the rest is null."""
    rows = rows if sources is None else rows.join(sources, "conv_id", "left")
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in SOURCE.items() if c not in rows.columns})


def v1_documents(segments: DataFrame, questions: DataFrame, created_at: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """conv_id, document: the first-version transcript."""
    body = nested(segments.select("conv_id", "idx", "id", "start", "end", "speaker", F.col("v1_role").alias("role"), "text"), "idx", "segments", "idx")
    speakers = segments.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(F.col("speaker").alias("id"), F.col("v1_role").alias("role")))).alias("speakers"))
    asked = nested(questions.select("conv_id", "id", "main_question", "follow_ups", "candidate_answers", "segment_ids", "topic"), "id", "qa_pairs")
    out = with_source(with_lists(body.join(speakers, "conv_id"), qa_pairs=asked), sources)
    return out.select("conv_id", F.struct(F.lit("0.1.0").alias("schema_version"), moment(created_at).alias("created_at"), "source_audio", "audio", "pipeline", "speakers", "segments", "qa_pairs").alias("document"))


def nodes(tree: DataFrame) -> DataFrame:
    """conv_id, question_tree: roots in order, each with its answers and its children."""
    node = F.struct(F.col("node_id").alias("id"), *NODE_FIELDS, F.array_compact(F.array("answer")).alias("answers"))
    roots = tree.groupBy("conv_id", "root_no").agg(F.array_sort(F.collect_list(F.struct("child_no", node.alias("n")))).alias("n"))
    bare = lambda n: [n[c].alias(c) for c in ("id", *NODE_FIELDS, "answers")]
    leaf = lambda x: F.struct(*bare(x["n"]), F.array().cast("array<string>").alias("children"))
    root = F.struct(*bare(F.col("n")[0]["n"]), F.transform(F.slice("n", F.lit(2), F.size("n")), leaf).alias("children"))
    return nested(roots.select("conv_id", "root_no", root.alias("r")), "root_no", "question_tree", "root_no").withColumn("question_tree", F.transform("question_tree", lambda x: x["r"]))


def v2_documents(roled: DataFrame, spans: DataFrame, events: DataFrame, turns: DataFrame, tree: DataFrame, flat: DataFrame, speakers: DataFrame, priors: DataFrame, statistics: DataFrame, created_at: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """conv_id, document: the repaired conversation; every source segment stays."""
    cleanup = F.struct("valid", "reasons", F.round("seconds", 3).alias("duration_seconds"), F.col("m").alias("meaningful_char_count"), F.round("density", 3).alias("text_density"), F.round("strength", 2).alias("question_strength"))
    segments = roled.select("conv_id", "idx", "id", "start", "end", "speaker", F.col("speaker").alias("speaker_id"), "v1_role", "role", "role_confidence", "phase", cleanup.alias("cleanup"), "text")
    counts = F.map_filter(F.create_map(*[x for r in ("interviewer", "candidate", "unknown") for x in (F.lit(r), F.col(f"n_{r}"))]), lambda k, v: v > 0)
    speakers = speakers.select("conv_id", F.col("speaker").alias("id"), "dominant_role", "role_confidence", counts.alias("role_counts"))
    own = priors.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", F.struct("interviewer", "candidate"))))).alias("speaker_role_priors"))
    out = with_lists(
        nested(segments, "idx", "segments", "idx"), speakers=nested(speakers, "id", "speakers"), phase_spans=nested(spans, "span_no", "phase_spans", "span_no"), events=nested(events, "event_no", "events", "event_no"),
        turns=nested(turns, "turn_no", "turns", "turn_no"), question_tree=nodes(tree), qa_pairs=nested(flat, "id", "qa_pairs"),
    )
    out = out.join(own, "conv_id", "left").join(statistics.select("conv_id", F.struct(*[c for c in statistics.columns if c != "conv_id"]).alias("statistics")), "conv_id", "left")
    structure = F.struct(
        F.lit("V2").alias("version"), F.lit(METHOD).alias("method"), F.lit(True).alias("speaker_diarization_is_weak_evidence"),
        *[F.array(*[F.lit(x) for x in sorted(values["enum"])]).alias(name) for name, values in (("valid_roles", C.ROLE), ("valid_phases", C.PHASE))],
    )
    preserved = F.coalesce(F.try_variant_get("pipeline", "$.raw_output_preserved", "boolean"), F.lit(False))
    derived = F.struct(F.lit("0.1.0").alias("schema_version"), "source_audio", preserved.alias("raw_output_preserved"))
    fields = ["speakers", "speaker_role_priors", "segments", "phase_spans", "events", "turns", "question_tree", "qa_pairs", "statistics"]
    document = F.struct(F.lit("0.2.0").alias("schema_version"), moment(created_at).alias("created_at"), derived.alias("derived_from"), *SOURCE, structure.alias("conversation_structure"), *fields)
    return with_source(out, sources).select("conv_id", document.alias("document"))
