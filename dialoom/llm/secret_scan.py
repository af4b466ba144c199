r"""Operator 3: secret scans with corpus-wide ownership of candidates.

Base spans are whole matches of three patterns, leftmost and non-overlapping within a
kind; a fourth kind, ``token``, holds vendor-style tokens and is added where the corpus
shows that only one owner uses the value.  Each candidate's digest is counted over
distinct repositories and owners: values that several owners share are copied examples,
values of one owner look live.

A match's place comes from splitting the text at the matches: a match starts after the
pieces and matches before it, counted in code points.  DataFrame code only.  Counting goes
through distinct (digest, owner, repository) rows and partial sums, and the join back
shuffles both sides, so adaptive execution splits a digest that is everywhere.

Edge cases: null text is empty; a text without spans has the digest of the empty string;
repeated rows are scanned alike; null owners count as one owner; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import materialize, text_of

#: kind: pattern, group that holds the secret, its least length
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "token": (r"(?:gh[opsu]_|glpat-|xox[abps]-|sk_live_|eyJ)[A-Za-z0-9_.-]{16,}", 0, 20),
}
BASE = ("assign", "access", "hex")
#: cheap tests that any text with a match of the kind passes
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "token": r"gh[opsu]_|glpat-|xox[abps]-|sk_live_|eyJ"}


def hinted(kind: str, text: Column) -> Column:
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    pattern = HINTS.get(kind, KINDS[kind][0])
    return F.regexp_like(text, F.lit(pattern))


def with_matches(docs: DataFrame, kind: str) -> DataFrame:
    """Adds ``kind``: the array of (start, kind_no, end, value) of its matches that pass."""
    pattern, group, least = KINDS[kind]
    no = list(KINDS).index(kind)
    text = F.when(hinted(kind, F.col("text")), F.col("text")).otherwise(F.lit(""))
    out = docs.withColumn("_t", text).withColumn("_whole", F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
    value = F.regexp_extract_all("_t", F.lit(pattern), F.lit(group)) if group else F.col("_whole")
    out = out.withColumn("_value", value)
    out = out.withColumn("_gaps", F.when(F.size("_whole") > 0, F.transform(F.split("_t", pattern, -1), F.length)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("_lengths", F.transform("_whole", F.length))
    # Running places: (end so far, spans so far), a match at a time.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def take(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.get(F.col("_gaps"), i)
        end = start + F.get(F.col("_lengths"), i)
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    places = F.when(F.size("_whole") > 0, F.aggregate(F.sequence(F.lit(0), F.size("_whole") - 1), begin, take)["spans"]).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    out = out.withColumn("_places", places)
    spans = F.transform("_places", lambda p, i: F.struct(p["start"].alias("start"), F.lit(no).alias("kind_no"), p["end"].alias("end"), F.get(F.col("_value"), i).alias("value")))
    out = out.withColumn(kind, F.filter(spans, lambda s: F.length(s["value"]) >= least))
    return out.drop("_t", "_whole", "_value", "_gaps", "_lengths", "_places")


def label(span: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), span["kind_no"] + 1)
    return F.concat_ws(":", kind, span["start"].cast("string"), span["end"].cast("string"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), label), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", shared_owners: int = 2) -> DataFrame:
    """A row per document: its base counts and digest, all spans, and how many of its candidates
    are live-looking (fewer than ``shared_owners`` owners) or copied examples."""
    found = docs.select("doc_id", text_of().alias("text"), F.col(owner).alias("owner"), F.col(repository).alias("repository"))
    for kind in KINDS:
        found = with_matches(found, kind)
    found = found.drop("text").withColumn("_row", F.monotonically_increasing_id())
    kept = materialize(found, "secret-spans")  # row numbers are fixed from here on
    every = F.concat(*[F.col(k) for k in KINDS])
    spread = kept.filter(F.size(every) > 0).select("_row", "owner", "repository", F.explode(every).alias("span"))
    spread = materialize(spread.select("*", F.sha2(F.col("span.value"), 256).alias("digest")), "secret-candidates")
    per_owner = spread.groupBy("digest", "owner").agg(F.count_distinct("repository").alias("n_repos"))
    use = per_owner.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"))
    use = materialize(use, "secret-use")
    verdicts = spread.join(use, "digest").withColumn("live", F.col("n_owners") < shared_owners)
    token = list(KINDS).index("token")
    per_row = verdicts.groupBy("_row").agg(
        F.collect_list(F.when((F.col("span.kind_no") != token) | F.col("live"), F.col("span"))).alias("spans"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_shared"),
        F.max("n_repos").alias("most_repositories"),
    )
    base = F.concat(*[F.col(k) for k in BASE])
    out = kept.join(per_row, "_row", "left")
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_shared", "most_repositories")],
    )
