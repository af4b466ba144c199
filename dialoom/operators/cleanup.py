"""Annotates segments without deleting any: validity, reasons, densities, question strength."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions import lexicon as X
from dialoom.functions import text as T


def has(pattern: str):
    return lambda text: T.matches(text, pattern)


#: flag: what it tests in a segment's text
FLAGS = {
    "marked": has(X.QUESTION_MARK), "word": has(X.QUESTION_WORD), "control": has(X.INTERVIEWER_CONTROL), "evidence": has(X.CANDIDATE_EVIDENCE), "direct": has(X.DIRECT_ADDRESS),
    "affirmative": has(X.AFFIRMATIVE_START), "response": has(X.RESPONSE_START), "marker": has(X.PROMPT_MARKER), "precise": has(X.PRECISE_MARKER), "example": has(X.EXAMPLE_CUE),
    "ack": T.is_acknowledgement, "admin": has(X.ADMIN), "invitation": has(X.INVITATION), "no_more": lambda text: T.matches(T.compact(text), X.NO_MORE_QUESTIONS),
    "project_prompt": has(X.PROJECT_PROMPT), "coding_strong": has(X.CODING_STRONG), "coding_talk": has(X.CODING_DISCUSSION), "asks_first": has(X.CANDIDATE_QUESTION_START),
    "closing": has(X.END), "behavioral": has(X.BEHAVIORAL), "tech": has(X.TECH), "v1_score": T.v1_question_score,
}


@dataclass(frozen=True)
class CleanupConfig:
    long_seconds: float = 12.0
    extreme_seconds: float = 25.0
    least_density: float = 0.5


def annotate(segments: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """Adds m (meaningful characters), strength, seconds, density, reasons, valid and the flags.
    A map: no exchange.  Put it below the numbering of segments, so that no later filter or
    window makes Catalyst repeat its expressions; flags that nobody reads are pruned."""
    return judged(with_features(segments), config)


def annotated_once(segments: DataFrame, config: CleanupConfig = CleanupConfig()) -> DataFrame:
    """The same by a join: what a text alone tells is found once for each distinct text. Pays where all flags
    are read and texts come again; where none does it costs an exchange of the texts."""
    own = with_features(segments.select("text").distinct()).withColumnRenamed("text", "_text")
    return judged(segments.join(own, F.col("text").eqNullSafe(F.col("_text")), "left").drop("_text"), config)


def with_features(segments: DataFrame) -> DataFrame:
    """Adds what a text alone tells: strength, m, the flags, and whether it is noise."""
    out = segments.withColumn("bare", T.stripped(F.col("text")))
    chars = F.lower(F.regexp_replace("bare", f"[^{X.MEANINGFUL[1:]}", ""))
    out = out.withColumns({"chars": chars, "strength": T.question_strength(F.col("bare"))})
    out = out.withColumns({"m": F.length("chars"), **{name: flag(F.col("bare")) for name, flag in FLAGS.items()}})
    noise = F.when(F.col("m") >= 8, T.mostly_one(F.col("chars"), 0.68) | T.matches(F.col("bare"), X.REPEATED_CHARACTER))
    return out.withColumn("noise", noise).drop("bare", "chars")


def judged(segments: DataFrame, config: CleanupConfig) -> DataFrame:
    """Adds seconds, density, reasons and valid to segments with features."""
    out = segments.withColumn("seconds", F.greatest(F.lit(0.0), F.col("end") - F.col("start")))
    out = out.withColumn("density", F.col("m") / F.greatest(F.col("seconds"), F.lit(0.001)))
    short_question = (F.col("seconds") <= 8.0) & (F.col("strength") >= 2.0)
    sparse = (F.col("seconds") >= config.extreme_seconds) & (F.col("density") < config.least_density)
    little = ~sparse & (F.col("seconds") >= config.long_seconds) & (F.col("m") <= 5)
    some = F.col("m") > 0
    reasons = F.array_compact(
        F.array(
            F.when(~some, "pure_or_repeated_punctuation"),
            F.when(some & F.col("noise"), "repetitive_noise_transcription"),
            F.when(some & ~short_question & sparse, "long_duration_low_text_density"),
            F.when(some & ~short_question & little, "long_duration_very_little_text"),
        )
    )
    return out.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0).drop("noise")
