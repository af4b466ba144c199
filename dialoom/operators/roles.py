"""Speaker roles: first-version election, priors, the role of each segment, and summaries.

All of it works within conversations, on the one exchange that numbered them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.functions.folds import folded
from dialoom.operators.phases import by_conv, in_order

ROLES = ("interviewer", "candidate")


def by_speaker():
    return W.partitionBy("conv_id", "speaker")


def v1_roles(cleaned: DataFrame, least_score: int = 1) -> DataFrame:
    """conv_id, speaker, score, role: the speaker who asks most interviews; the first by name if none asks enough."""
    scores = cleaned.filter("speaker <> 'speaker_unknown'").groupBy("conv_id", "speaker").agg(F.sum("v1_score").cast("long").alias("score"))
    best = F.row_number().over(by_conv().orderBy(F.col("score").desc(), "speaker"))
    first = F.row_number().over(by_conv().orderBy("speaker"))
    scores = scores.withColumns({"best": best, "first": first, "top": F.max("score").over(by_conv()), "n": F.count("*").over(by_conv())})
    asked = (F.col("top") >= least_score) | (F.col("n") == 1)
    return scores.select("conv_id", "speaker", "score", F.when(F.when(asked, F.col("best")).otherwise(F.col("first")) == 1, "interviewer").otherwise("candidate").alias("role"))


def with_v1_roles(cleaned: DataFrame, least_score: int = 1) -> DataFrame:
    """Adds v1_role to each segment, by the same election over windows of the conversation."""
    known = F.col("speaker") != "speaker_unknown"
    rows = cleaned.withColumn("_score", F.sum("v1_score").over(by_speaker()))
    best = F.min(F.when(known, F.struct((-F.col("_score")).alias("less"), F.col("speaker")))).over(by_conv())
    rows = rows.withColumns({"_best": best, "_first": F.min(F.when(known, F.col("speaker"))).over(by_conv())})
    elected = F.when(-F.col("_best.less") >= least_score, F.col("_best.speaker")).otherwise(F.col("_first"))
    role = F.when(~known, "unknown").when(F.col("speaker") == elected, "interviewer").otherwise("candidate")
    return rows.withColumn("v1_role", role).drop("_score", "_best", "_first")


def rounded(c: Column, places: int) -> Column:
    """Rounded to the nearer decimal as the exact value of the binary number decides, half-way cases to the
    even one: twice the scaled number is split into a product and that product's error, both exact."""
    k = float(2 * 10**places)

    def of(x: Column) -> Column:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        product = x * k
        low, error = F.floor(product / 2), (high * k - product) + (x - high) * k
        over = product - (2 * low + 1)
        up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
        return (low + F.when(up, 1).otherwise(0)) / float(10**places)

    return F.get(F.transform(F.array(c), of), F.lit(0))  # the number is computed once


def prior_sums() -> dict[str, Column]:
    """What of a speaker's valid rows decides the priors; all whole numbers."""
    s, one = F.col("strength"), lambda c: F.when(c, 1).otherwise(0)
    return {
        "_asked": F.when(s >= 2.5, F.round(F.least(s, F.lit(5.0)) * 10).cast("long")).otherwise(0), "_controls": one(F.col("control")), "_chars": F.col("m"),
        "_evidence": one(F.col("evidence")), "_long": one(F.col("m") >= 60),
    }


def with_shares(rows: DataFrame, total: Callable[[str], Column]) -> DataFrame:
    """Priors, rounded to four places, of rows that bear their speaker's sums; ``total`` of a column counts each
    speaker of the conversation with valid rows once."""
    rows = rows.withColumns({"_i": 1.0 + F.col("_asked") * 0.15 + 3.0 * F.col("_controls"), "_c": 1.0 + F.col("_chars") / 45.0 + 3.0 * F.col("_evidence") + 2.0 * F.col("_long")})
    rows = rows.withColumns({k: F.col(k) / total(k) for k in ("_i", "_c")})
    rows = rows.withColumns({"_si": F.col("_i") + F.greatest(F.lit(0.0), 0.5 - F.col("_c")), "_sc": F.col("_c") + F.greatest(F.lit(0.0), 0.5 - F.col("_i"))})
    total_of = F.col("_si") + F.col("_sc")
    return rows.withColumns({"p_interviewer": rounded(F.col("_si") / total_of, 4), "p_candidate": rounded(F.col("_sc") / total_of, 4)}).drop(*prior_sums(), "_i", "_c", "_si", "_sc")


def with_priors(cleaned: DataFrame) -> DataFrame:
    """Adds p_interviewer and p_candidate of the row's speaker, from the speaker's valid rows (null without any)."""
    rows = cleaned.withColumns({k: F.sum(F.when(F.col("valid"), v)).over(by_speaker()) for k, v in prior_sums().items()})
    # One row a speaker counts in the conversation's totals.
    rows = rows.withColumn("_head", F.col("valid") & (F.row_number().over(by_speaker().orderBy(F.col("valid").desc(), "idx")) == 1))
    return with_shares(rows, lambda k: F.sum(F.when(F.col("_head"), F.col(k))).over(by_conv())).drop("_head")


def speakers_with_priors(cleaned: DataFrame, **more: Column) -> DataFrame:
    """A row per speaker: conv_id, speaker, the aggregates ``more``, p_interviewer and p_candidate. Speakers are
    grouped, so windows are of speakers, not of segments; totals are summed in the order of speakers."""
    rows = cleaned.groupBy("conv_id", "speaker").agg(*[F.sum(F.when(F.col("valid"), v)).alias(k) for k, v in prior_sums().items()], *[c.alias(k) for k, c in more.items()])
    along = by_conv().orderBy("speaker").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return with_shares(rows, lambda k: F.sum(k).over(along))


def speaker_priors(cleaned: DataFrame) -> DataFrame:
    """conv_id, speaker, interviewer, candidate of speakers with valid rows."""
    rows = speakers_with_priors(cleaned, n_valid=F.sum(F.col("valid").cast("long")))
    return rows.filter("n_valid > 0").select("conv_id", "speaker", F.col("p_interviewer").alias("interviewer"), F.col("p_candidate").alias("candidate"))


def with_evidence(phased: DataFrame) -> DataFrame:
    """Adds what a segment alone says: ``base``, twice its speaker's prior and its cues for either
    role; ``asks``; and what each state that the conversation can be in would add to either role."""
    s = F.col("strength")
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    rows = with_priors(phased).withColumns({c: F.coalesce(c, F.lit(0.5)) for c in ("p_interviewer", "p_candidate")})
    asks, own = s >= 2.5, F.col("phase") == "CANDIDATE_QUESTIONS"
    rows = rows.withColumns(
        {
            "base_i": one(asks, 0.0) + F.when(asks, s + one(F.col("control"), 1.5)).otherwise(0.0) + 2.0 * F.col("p_interviewer"),
            "base_c": one(F.col("evidence"), 3.0) + one(F.col("m") >= 30, 1.0) + one(F.col("m") >= 80, 1.0) + one(F.col("affirmative"), 1.0) + 2.0 * F.col("p_candidate"),
            "asks": asks, "own": own,
            # A question without mark or address, where an answer is expected, may be part of the answer.
            "echo": one(asks & ~F.col("marked") & ~F.col("direct"), 2.0),
            "answers": F.col("evidence") | (F.col("m") >= 35),
            "prior_gap": F.abs(F.col("p_interviewer") - F.col("p_candidate")),
        }
    )
    before = F.lag(F.struct("speaker", "end")).over(W.partitionBy("conv_id", "valid").orderBy("idx"))
    return rows.withColumn("goes_on", F.coalesce((F.col("speaker") == before["speaker"]) & (F.col("start") - before["end"] <= 1.0), F.lit(False)))


def with_roles(phased: DataFrame) -> DataFrame:
    """Adds role and role_confidence.

    A segment's role depends on three things decided before it: who is expected to answer, who
    asked last, and the role before.  Everything else is a column; only that state is folded, over
    a conversation's array of small structs.  Rows come back by position, without a join."""
    rows = with_evidence(phased)
    kept = [c for c in phased.columns if c != "conv_id"]
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.struct("speaker", "valid", "base_i", "base_c", "asks", "own", "echo", "answers", "prior_gap", "goes_on").alias("e"), F.struct(*kept).alias("r")))).alias("rows"))
    begin = F.struct(
        F.lit("").alias("expected"), F.lit("").alias("asker"), F.lit("").alias("last"), F.array().cast("array<struct<role:string,sure:double>>").alias("out")
    )

    def step(state: Column, row: Column) -> Column:
        e = row["e"]
        waiting = state["expected"]
        # What the state adds to (interviewer, candidate).
        owed = (waiting != "") & ~e["asks"] & ((e["speaker"] != state["asker"]) | e["answers"]) & ~(e["own"] & e["asks"])
        gain = lambda role: F.when(owed & (waiting == role), 1.25).otherwise(0.0) + F.when(e["goes_on"] & (state["last"] == role), 0.4).otherwise(0.0)
        own_question = e["own"] & e["asks"]
        i = e["base_i"] - F.when(own_question, 1.0).otherwise(0.0) + gain("interviewer")
        c = e["base_c"] + F.when(waiting == "candidate", e["echo"]).otherwise(0.0) + F.when(own_question, 4.0).otherwise(0.0) + gain("candidate")
        return decide(state, e, i, c)

    def decide(state: Column, e: Column, i: Column, c: Column) -> Column:
        scored = F.array(F.struct(i.alias("i"), c.alias("c")))  # bound once, read below

        def from_scores(s: Column) -> Column:
            apart = F.abs(s["i"] - s["c"])
            unsure = (F.greatest(s["i"], s["c"]) < 0.75) | ((apart < 0.2) & (e["prior_gap"] < 0.08))
            sure = F.least(F.lit(0.98), 0.54 + apart * 0.09 + e["prior_gap"] * 0.15)
            role = F.when(unsure, "unknown").when(s["i"] > s["c"], "interviewer").otherwise("candidate")
            return F.struct(role.alias("role"), F.when(unsure, 0.45).otherwise(rounded(sure, 2)).alias("sure"))

        def onward(found: Column) -> Column:
            role = found["role"]
            asked = e["asks"] & ((role == "interviewer") | ((role == "candidate") & e["own"]))
            expected = F.when(~asked, state["expected"]).when(role == "interviewer", "candidate").otherwise("interviewer")
            return F.struct(expected.alias("expected"), F.when(asked, e["speaker"]).otherwise(state["asker"]).alias("asker"), role.alias("last"), F.array_append(state["out"], found).alias("out"))

        unknown = F.struct(F.lit("unknown").alias("role"), F.lit(0.0).alias("sure"))
        skipped = F.struct(state["expected"].alias("expected"), state["asker"].alias("asker"), state["last"].alias("last"), F.array_append(state["out"], unknown).alias("out"))
        return F.when(e["valid"], F.transform(F.transform(scored, from_scores), onward)[0]).otherwise(skipped)

    talks = talks.withColumn("found", folded("rows", begin, step))
    pairs = F.transform("rows", lambda row, k: F.struct(row["r"].alias("r"), F.get(F.col("found"), k).alias("f")))
    out = talks.select("conv_id", F.explode(pairs).alias("p"))
    return out.select("conv_id", "p.r.*", F.col("p.f.role").alias("role"), F.col("p.f.sure").alias("role_confidence"))


def v1_turns(segments: DataFrame, gap: float = 0.8) -> DataFrame:
    """Runs of one speaker whose gaps stay within ``gap`` of the run's latest end."""
    rows = segments.withColumn("same", F.coalesce((F.col("speaker") != F.lag("speaker").over(in_order())).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("same").over(in_order()))
    before = F.max("end").over(W.partitionBy("conv_id", "run").orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("start") - before > gap).cast("int"), F.lit(1))).withColumn("turn_no", F.sum("new").over(in_order()))
    parts = F.sort_array(F.collect_list(F.struct("idx", "id", "text")))
    more = [F.first("v1_role").alias("role")] if "v1_role" in segments.columns else []
    out = rows.groupBy("conv_id", "turn_no").agg(F.first("speaker").alias("speaker"), *more, F.min_by("start", "idx").alias("start"), F.max("end").alias("end"), parts.alias("p"))
    named = ["role"] if more else []
    return out.select("conv_id", "turn_no", "speaker", *named, "start", "end", F.transform("p", lambda x: x["id"]).alias("segment_ids"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def speaker_summary(roled: DataFrame) -> DataFrame:
    """conv_id, speaker, dominant_role (the larger prior, interviewer on ties), role_confidence (that
    prior to two places; 0 and unknown without valid rows), counts of roles over valid rows."""
    n = lambda role: F.sum((F.col("valid") & (F.col("role") == role)).cast("long"))
    out = speakers_with_priors(roled, **{f"n_{role}": n(role) for role in (*ROLES, "unknown")}).withColumnsRenamed({"p_interviewer": "i", "p_candidate": "c"})
    role = F.when(F.col("i").isNull(), "unknown").when(F.col("i") >= F.col("c"), "interviewer").otherwise("candidate")
    return out.select("conv_id", "speaker", role.alias("dominant_role"), F.coalesce(rounded(F.greatest("i", "c"), 2), F.lit(0.0)).alias("role_confidence"), "n_interviewer", "n_candidate", "n_unknown")
