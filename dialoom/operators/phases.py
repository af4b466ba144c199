"""Phases of an interview, sticky labels and their spans, with one exchange on conv_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.functions import lexicon as X
from dialoom.functions import text as T

FAR = 1 << 30


def by_conv():
    return W.partitionBy("conv_id")


def in_order():
    return by_conv().orderBy("idx")


def so_far(last: int = 0):
    return in_order().rowsBetween(W.unboundedPreceding, last)


def family(phase: Column) -> Column:
    """Phases between which a question goes on."""
    return F.when(phase.startswith("CODING"), "CODING").when(phase.isin("PROJECT", "TECH_QA"), "INTERVIEW_QA").otherwise(phase)


def two_to(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def range_minima(starts: Column) -> Column:
    """Arrays of minima: the k-th holds, for each place, the least of the 2^k values up to it."""
    wider = lambda low, k: F.transform(low, lambda x, i: F.least(x, F.coalesce(F.get(low, i - two_to(k - 1)), x)))
    turns = F.ceil(F.log2(F.size(starts) + F.lit(1))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), turns), F.array(starts), lambda made, k: F.array_append(made, wider(F.get(made, k - 1), k)))


def run_begin(minima: Column, at: Column, end: Column, seconds: float) -> Column:
    """The place where the unbroken run back from place ``at`` begins whose starts lie within ``seconds`` of
    ``end``: binary lifting, by the longest step first that meets no earlier start."""
    steps = F.sequence(F.size(minima) - 1, F.lit(0))
    stays = lambda j, k: (j >= 0) & ~(end - F.get(F.get(minima, k), j) > seconds)
    before = F.aggregate(steps, at - 1, lambda j, k: F.when(stays(j, k), j - two_to(k)).otherwise(j))
    return F.greatest(before, F.lit(-1)) + 1


def phase_cues(talks: DataFrame) -> DataFrame:
    """Adds to rows of a conversation and its segments ``r``, in order, the positions where its phases may begin:
    c0 (coding), q0 (candidate's questions), e0 (end), sticky (the first of these) and leave (introduction
    over), in n log n steps however its starts are ordered."""
    given = talks.columns
    talks = talks.withColumn("duration", F.array_max(F.transform("r", lambda x: x["end"]))).withColumn("minima", range_minima(F.transform("r", lambda x: x["start"])))
    late = lambda x: x["valid"] & (x["start"] >= 120.0)
    half = lambda x: x["valid"] & (x["start"] >= F.col("duration") * 0.5)
    contextual = lambda t: T.matches(t, X.PROJECT) & T.matches(t, X.PROJECT_ADDRESSED) & (T.question_strength(t) >= 2.0)
    asking = lambda t: T.matches(t, X.CANDIDATE_QUESTION_CUE) & T.matches(t, X.CANDIDATE_QUESTION_TOPIC)

    def first_run(asked, seconds: float, fits) -> Column:
        """Where the first run begins, of those back from the rows asked, whose joined text fits."""
        begin = F.struct(F.lit(0).alias("i"), F.lit(None).cast("int").alias("pos"))
        text = lambda b, i: F.array_join(F.transform(F.slice("r", b + 1, i - b + 1), lambda x: x["text"]), "")

        def step(now: Column, x: Column) -> Column:  # runs are joined up to the first that fits
            told = F.transform(F.array(run_begin(F.col("minima"), now["i"], x["end"], seconds)), lambda b: F.struct((b + 1).alias("pos"), text(b, now["i"]).alias("text")))
            pos = F.when(now["pos"].isNotNull() | ~F.coalesce(asked(x), F.lit(False)), now["pos"]).otherwise(F.transform(told, lambda y: F.when(fits(y["text"]), y["pos"]))[0])
            return F.struct((now["i"] + 1).alias("i"), pos.alias("pos"))

        return F.aggregate("r", begin, step)["pos"]

    first = lambda cue: F.array_min(F.transform("r", lambda x, i: F.when(cue(x), i + 1)))
    cues = talks.withColumns(
        {
            "p0": F.least(first(lambda x: x["valid"] & (x["start"] >= 45.0) & x["project_prompt"]), first_run(late, 45.0, contextual)),
            "c0": first(lambda x: late(x) & x["coding_strong"]),
            "q0": F.coalesce(first(lambda x: half(x) & x["asks_first"]), first_run(half, 20.0, asking)),
            "e0": first(lambda x: x["valid"] & (x["start"] >= F.col("duration") * 0.65) & x["closing"]),
        }
    ).drop("minima", "duration")
    # A phase begins up to ten seconds before its cue: behind the last row too early for that.
    for name in ("p0", "c0"):
        cues = cues.withColumn("at", F.get("r", F.col(name) - 1)["start"])
        cues = cues.withColumn(name, F.when(F.col(name).isNotNull(), F.coalesce(F.array_max(F.transform("r", early_rows(name))) + 1, F.lit(1))))
    sticky = F.least(*[F.coalesce(c, F.lit(FAR)) for c in ("c0", "q0", "e0")])
    cues = cues.withColumn("sticky", sticky)
    told = F.array_min(F.transform("r", lambda x, i: F.when((i + 1 < F.col("sticky")) & (x["behavioral"] | x["project_prompt"]), i + 1)))
    return cues.select(*given, "c0", "q0", "e0", "sticky", F.least(F.coalesce("p0", F.lit(FAR)), F.coalesce(told, F.lit(FAR))).alias("leave"))


def early_rows(name: str):
    return lambda x, i: F.when((i + 1 < F.col(name)) & (x["start"] < F.col("at") - 10.0), i + 1)


def with_phases(cleaned: DataFrame) -> DataFrame:
    """Adds ``pos`` and ``phase`` to cleaned segments (idx may have holes, starts may go back): a conversation's
    rows become one, which tells where its phases may begin, and rows again, so they are cleaned and dealt once."""
    others = [c for c in cleaned.columns if c != "conv_id"]
    talks = cleaned.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in others if c != "idx"]))).alias("r"))
    cues = phase_cues(talks)
    each = cues.select(*[c for c in cues.columns if c != "r"], F.posexplode("r").alias("at", "x"))
    pos = F.col("pos")
    rows = each.select("conv_id", *[F.col(f"x.`{c}`") for c in others], (F.col("at") + 1).alias("pos"), *[c for c in cues.columns if c not in ("conv_id", "r")])
    tech = F.col("tech") & (F.col("strength") >= 2.5) & (pos >= F.col("leave"))
    event = F.when(F.col("behavioral"), "BEHAVIORAL").when(F.col("project_prompt"), "PROJECT").when(tech, "TECH_QA").when(pos == F.col("leave"), "PROJECT")
    active = F.coalesce(F.last(F.when(pos < F.col("sticky"), event), ignorenulls=True).over(so_far()), F.lit("INTRO"))
    coding = F.when(F.col("coding_talk") & (F.col("strength") >= 2.0), "CODING_DISCUSSION").otherwise("CODING")
    phase = F.when(pos >= F.col("e0"), "END").when(pos >= F.col("q0"), "CANDIDATE_QUESTIONS").when(pos >= F.col("c0"), coding).otherwise(active)
    return rows.withColumn("phase", phase).drop("c0", "q0", "e0", "leave", "sticky")


def islands(df: DataFrame, start_new: Column, name: str) -> DataFrame:
    """Numbers runs of rows within conversations; ``start_new`` marks a run's first row."""
    return df.withColumn("_new", F.coalesce(start_new, F.lit(True)).cast("int")).withColumn(name, F.sum("_new").over(in_order())).drop("_new")


def phase_spans(phased: DataFrame) -> DataFrame:
    """conv_id, span_no, phase, start, end (of the last row), segment_ids of runs of one phase."""
    runs = islands(phased, F.col("phase") != F.lag("phase").over(in_order()), "span_no")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"])
    return runs.groupBy("conv_id", "span_no").agg(F.first("phase").alias("phase"), F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), ids.alias("segment_ids"))


def coding_silences(phased: DataFrame, least: float = 8.0) -> DataFrame:
    """Gaps of ``least`` seconds or more between adjacent rows of the coding phases."""
    after = F.lead(F.struct("start", "phase", "id")).over(in_order())
    pairs = phased.withColumn("after", after).filter(F.col("phase").startswith("CODING") & F.col("after.phase").startswith("CODING") & (F.col("after.start") - F.col("end") >= least))
    return pairs.select("conv_id", "idx", "phase", F.col("end").alias("start"), F.col("after.start").alias("end"), F.array("id", "after.id").alias("segment_ids"))
