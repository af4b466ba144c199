"""Operator 2: quality rules, with verdicts on hosts.

Each document's rule failures are summed by host; a host's rate for each rule is shrunk
towards a beta prior fitted to all hosts by moments, and documents of a host with a
shrunk rate above ``host_rate`` go with it: there, a document is likelier to fail than not.
Elsewhere a document that fails any rule goes alone.  DataFrame code only: hosts are
aggregated with map-side partial sums, so a host of a third of all rows costs one row a
task, and the verdict table (a row a host) is broadcast only within a counted bound.

The limits of ``symbols`` (a tenth of word characters) and ``dup_lines`` (two fifths of lines)
lie where, of the labelled rows of the tables at hand, none of good quality is beyond.

Edge cases: null text has no words (and fails); a null host is a host of its own; with
one host, or hosts of equal rates, the prior is that of one observation; repeated rows are
judged alike, as are ties, for no rule orders rows; very long texts are counted whole; extra
columns are carried, never read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import SPACE_CHARS, join_bounded, materialize, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: rule: its failure, in terms of the counts below
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "10 * n_dup_lines > 4 * n_lines",
}


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.col("_text")
    out = docs.withColumn("_text", text_of()).withColumn("_words", words_of(text))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    out = (
        out.withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, SPACE_CHARS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )
    none = F.array().cast("array<bigint>")
    windows = F.when(F.size("_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("_words") - 5), window_hash)).otherwise(none)
    out = out.drop("_lines").withColumn("_windows", windows)
    # Few texts repeat a window; only those are sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sortable = F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("_sorted", sortable)
    at = F.col("_sorted")

    def found_again(x: Column, i: Column) -> Column:
        before = (i > 0) & (F.get(at, i - 1)["h"] == x["h"])
        after = (i < F.size(at) - 1) & (F.get(at, i + 1)["h"] == x["h"])
        return before | after

    starts = F.sort_array(F.transform(F.filter(at, found_again), lambda x: x["i"]))
    out = out.withColumn("_starts", starts).drop("_windows", "_sorted")
    s = F.col("_starts")
    steps = F.transform(s, lambda x, i: F.when(i == F.size(s) - 1, F.lit(5)).otherwise(F.least(F.lit(5), F.get(s, i + 1) - x)))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_text", "_words", "_starts")


def window_hash(i: Column) -> Column:
    w = F.col("_words")
    return F.xxhash64(*[F.get(w, i + k) for k in range(5)])


def with_failures(docs: DataFrame) -> DataFrame:
    """Counts, a failed_<rule> flag for each rule, base_failed and failed (any rule)."""
    out = with_counts(docs)
    for rule, failed in RULES.items():
        out = out.withColumn(f"failed_{rule}", F.expr(failed))
    out = out.withColumn("base_failed", F.col("failed_short") | F.col("failed_repeats"))
    return out.withColumn("failed", F.col("base_failed") | F.col("failed_symbols") | F.col("failed_dup_lines"))


def host_verdicts(judged: DataFrame, host: str, host_rate: float = 0.5) -> DataFrame:
    """A row per host: shrunk failure rate of each rule and whether it is rejected.

    The prior of a rule is beta(a, b) with the mean and variance of the hosts' rates; hosts of
    no spread give a prior worth one observation.
    """
    rates = judged.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), *[F.sum(F.col(f"failed_{r}").cast("long")).alias(f"n_{r}") for r in RULES]
    )
    rates = materialize(rates, "quality-hosts")
    stats = rates.agg(*[f(F.col(f"n_{r}") / F.col("n")).alias(f"{k}_{r}") for r in RULES for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    bad = F.lit(False)
    for r in RULES:
        m, v = stats[f"m_{r}"] or 0.0, stats[f"v_{r}"] or 0.0
        strength = max(m * (1 - m) / v - 1, 1.0) if v > 0 else 1.0
        rates = rates.withColumn(f"rate_{r}", (F.col(f"n_{r}") + m * strength) / (F.col("n") + strength))
        bad = bad | (F.col(f"rate_{r}") > host_rate)
    return rates.withColumn("host_rejected", bad)


def judge(docs: DataFrame, host: str = "source", keep_columns: bool = False, host_rate: float = 0.5) -> DataFrame:
    """``docs`` judged: counts, base_failed, host_rejected and kept for each row.  With
    ``keep_columns`` only rows that pass all rules are kept, with all their columns."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if keep_columns else [F.col("doc_id")]
    judged = with_failures(docs.select(*row, F.col(host).alias("_host"), F.col("text"))).drop("text")
    if keep_columns:  # failing texts stay out of the written table; their flags count for the host
        judged = judged.withColumn("_doc", F.when(~F.col("failed"), F.col("_doc")))
    judged = materialize(judged, "quality-docs")
    verdicts = host_verdicts(judged, "_host", host_rate).filter("host_rejected")
    verdicts = materialize(verdicts.select(F.coalesce(F.concat(F.lit("0"), "host"), F.lit("1")).alias("_hkey"), "host_rejected"), "quality-verdicts")
    judged = judged.withColumn("_hkey", F.coalesce(F.concat(F.lit("0"), "_host"), F.lit("1")))
    out = join_bounded(judged, verdicts, ["_hkey"], "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("failed") & ~F.col("host_rejected")).drop("_hkey")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    return judge(docs, keep_columns=True, **options).filter("kept").select("_doc.*")
