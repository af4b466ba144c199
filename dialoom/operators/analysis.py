"""Analysis of question trees: minimised and redacted payloads, batches, provider results
checked, normalised and merged.  Only the question tree and six counters ever leave."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.functions import lexicon as X
from dialoom.functions.folds import folded
from dialoom.operators.documents import moment
from dialoom.sources.ledger import Ledger
from dialoom.sources.stored import stored

SCHEMA_VERSION, ANALYSIS_VERSION = "0.2.0", "0.1.0"
# What a payload says of a conversation, and what a result may score.
PAYLOAD_COUNTS = ("clarification_count", "coding_event_count", "follow_up_count", "main_question_count", "unknown_role_count", "valid_segment_count")
SCORES = ("relevance", "technical_depth", "clarity", "structure")
NONE_SUMMARY = "未启用语义分析模型；仅保留可追溯的结构化问答。"
NONE_OVERVIEW = "语义分析未启用；报告仅包含本地确定性结构结果。"
NONE_WARNING = "No semantic model was enabled; scores and coaching were not generated."
ASSESSED = ("summary", "scores", "strengths", "risks", "suggestions", "improved_answer", "evidence_segment_ids")
KEEP_NULLS = {"ignoreNullFields": "false"}


def marked(kind: str):
    """What follows a match, behind the match's placeholder."""
    return lambda part, k: F.when(k == 0, part).otherwise(F.concat(F.lit(f"[REDACTED_{kind.upper()}_"), F.col("_before") + k, F.lit("]"), part))


def with_numbered_redactions(texts: DataFrame, order: list[str], terms: list[str] | None = None) -> DataFrame:
    """Redacts ``text`` of (conv_id, *order, text): each match becomes [REDACTED_KIND_n], n counting
    the kind's matches over the conversation's texts in order.  Adds n_<kind>.

    A kind's number is a running sum of its counts in earlier texts, plus its place in this one.
    Only texts with a match are split: a split compiles its pattern for each row, a search does once."""
    custom = sorted({t.strip() for t in terms or [] if t and t.strip()}, key=lambda t: (-len(t), t))
    kinds = [(k, "(?U)" + p) for k, p in X.PERSONAL] + ([("custom", "|".join(re.escape(t) for t in custom))] if custom else [])
    before = W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    for kind, pattern in kinds:
        texts = texts.withColumn("_parts", F.when(F.regexp_like("text", F.lit(pattern)), F.split("text", pattern, -1)).otherwise(F.array("text"))).withColumn(f"n_{kind}", (F.size("_parts") - 1).cast("long"))
        texts = texts.withColumn("_before", F.coalesce(F.sum(f"n_{kind}").over(before), F.lit(0)))
        texts = texts.withColumn("text", F.array_join(F.transform("_parts", marked(kind)), "")).drop("_parts", "_before")
    return texts


def payload_questions(tree: DataFrame, terms: list[str] | None = None, redact: bool = True, answer_chars: int = 2400) -> DataFrame:
    """conv_id, prompt_no, question, counts: what a provider may see of a node.  Texts are redacted in
    the order answer, topic, question of each node, and only then cut; fields are in alphabetical order."""
    if answer_chars < 1:
        raise ValueError("answer_chars must be above 0")
    slots = F.array(F.struct(F.lit(0).alias("slot"), F.coalesce("answer.text", F.lit("")).alias("text")), F.struct(F.lit(1).alias("slot"), F.col("topic.label").alias("text")), F.struct(F.lit(2).alias("slot"), "text"))
    node = F.struct("node_id", "node_type", "phase", "segment_ids", F.col("answer.role").alias("role"), F.col("answer.segment_ids").alias("answer_ids"), F.col("answer").isNotNull().alias("answered"))
    texts = tree.select("conv_id", "prompt_no", node.alias("node"), F.explode(slots).alias("x")).select("conv_id", "prompt_no", "node", "x.*")
    kinds = [k for k, _ in X.PERSONAL] + (["custom"] if terms else [])
    if redact:
        texts = with_numbered_redactions(texts, ["prompt_no", "slot"], terms)
    else:
        texts = texts.withColumns({f"n_{k}": F.lit(0).cast("long") for k in kinds})
    rows = texts.groupBy("conv_id", "prompt_no").agg(
        F.first("node").alias("n"), *[F.max(F.when(F.col("slot") == k, F.col("text"))).alias(name) for k, name in enumerate(("answer", "topic", "question"))], *[F.sum(f"n_{k}").alias(k) for k in kinds if f"n_{k}" in texts.columns]
    )
    answer = F.struct(F.col("n.role").alias("role"), F.col("n.answer_ids").alias("segment_ids"), F.substring("answer", 1, answer_chars).alias("text"))
    answers = F.filter(F.array(answer), lambda a: F.col("n.answered"))
    question = F.struct(
        answers.alias("answers"), F.col("n.node_type").alias("node_type"), F.col("n.phase").alias("phase"), F.col("question"), F.col("n.node_id").alias("question_id"), F.col("n.segment_ids").alias("question_segment_ids"), F.col("topic")
    )
    return rows.select("conv_id", "prompt_no", question.alias("question"), F.struct(*[k for k in kinds if k in rows.columns]).alias("counts"))


def payloads(questions: DataFrame, statistics: DataFrame) -> DataFrame:
    """conv_id, payload (fields in alphabetical order), canonical JSON, its digest, and the counts of
    redactions; a conversation without questions has an empty list."""
    kinds = questions.select("counts.*").columns
    per = questions.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("prompt_no", "question"))).alias("q"), *[F.sum(f"counts.{k}").alias(k) for k in kinds])
    empty = F.array().cast(per.select(F.transform("q", lambda x: x["question"]).alias("q")).schema["q"].dataType)
    rows = statistics.select("conv_id", F.struct(*PAYLOAD_COUNTS).alias("statistics")).join(per, "conv_id", "left")
    listed = F.coalesce(F.transform("q", lambda x: x["question"]), empty)
    payload = F.struct(F.lit(SCHEMA_VERSION).alias("conversation_schema_version"), listed.alias("questions"), F.col("statistics"))
    counts = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in sorted(kinds)]), F.array(*[F.coalesce(k, F.lit(0)) for k in sorted(kinds)])), lambda k, v: v > 0)
    rows = rows.select("conv_id", payload.alias("payload"), counts.alias("redaction_counts")).withColumn("json", F.to_json("payload", KEEP_NULLS))
    return rows.withColumn("request_sha256", F.sha2("json", 256))


def payload_batches(payloads: DataFrame, most_questions: int = 12, most_chars: int = 160_000) -> DataFrame:
    """conv_id, batch_no, n_questions, n_chars, question_ids, payload: consecutive questions, as many as fit both bounds.

    A batch's JSON is as long as the payload without questions, its questions and the commas
    between them, so lengths alone are folded.  A question that fits no batch is one of its own,
    told by n_chars above the bound: ``refuse_oversize`` finds it."""
    if most_questions < 1 or most_chars < 1:
        raise ValueError("both bounds must be above 0")
    bare = F.length(F.to_json(F.col("payload").withField("questions", F.slice("payload.questions", 1, 0)), KEEP_NULLS))
    rows = payloads.withColumns({"bare": bare, "sizes": F.transform("payload.questions", lambda q: F.length(F.to_json(q, KEEP_NULLS)))})
    begin = F.struct(F.lit(0).alias("no"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<struct<no:int,chars:int>>").alias("out"))

    def step(now: Column, size: Column) -> Column:
        more = now["chars"] + size + 1
        opens = (now["n"] == 0) | (now["n"] + 1 > most_questions) | (more > most_chars)
        no, chars = now["no"] + F.when(opens, 1).otherwise(0), F.when(opens, F.col("bare") + size).otherwise(more)
        return F.struct(no.alias("no"), F.when(opens, 1).otherwise(now["n"] + 1).alias("n"), chars.alias("chars"), F.array_append(now["out"], F.struct(no.alias("no"), chars.alias("chars"))).alias("out"))

    rows = rows.withColumn("place", folded("sizes", begin, step))
    alone = F.array(F.struct(F.lit(1).alias("no"), F.col("bare").alias("chars")))
    numbers = F.when(F.size("place") == 0, alone).otherwise(F.col("place"))
    each = rows.select("conv_id", "payload", F.posexplode(numbers).alias("at", "p")).groupBy("conv_id", F.col("p.no").alias("batch_no")).agg(
        F.first("payload").alias("payload"), F.min("at").alias("at"), F.count("*").alias("n"), F.max("p.chars").cast("long").alias("n_chars")
    )
    own = F.slice("payload.questions", F.col("at") + 1, F.col("n").cast("int"))
    out = each.select("conv_id", "batch_no", "n_chars", F.col("payload").withField("questions", own).alias("payload"))
    return out.select("conv_id", "batch_no", F.size("payload.questions").cast("long").alias("n_questions"), "n_chars", F.transform("payload.questions", lambda q: q["question_id"]).alias("question_ids"), "payload")


def none_results(batches: DataFrame) -> DataFrame:
    """The result of the provider that doesn't analyse, as (conv_id, batch_no, result JSON): all
    questions with their evidence and no scores."""
    evidence = lambda q: F.array_distinct(F.concat(q["question_segment_ids"], F.flatten(F.transform(q["answers"], lambda a: a["segment_ids"]))))
    none, no_score = F.array().cast("array<string>"), F.struct(*[F.lit(None).cast("int").alias(s) for s in SCORES])
    item = lambda q: F.struct(
        q["question_id"].alias("question_id"), F.lit(NONE_SUMMARY).alias("summary"), no_score.alias("scores"), none.alias("strengths"), none.alias("risks"), none.alias("suggestions"),
        F.lit(None).cast("string").alias("improved_answer"), evidence(q).alias("evidence_segment_ids"),
    )
    overview = F.struct(F.lit(NONE_OVERVIEW).alias("summary"), none.alias("strengths"), none.alias("risks"), none.alias("suggested_focus"))
    result = F.struct(overview.alias("overview"), F.transform("payload.questions", item).alias("questions"), F.array().cast("array<string>").alias("review_plan"), F.array(F.lit(NONE_WARNING)).alias("warnings"))
    return batches.select("conv_id", "batch_no", F.to_json(result, KEEP_NULLS).alias("result"))


def provided_results(batches: DataFrame, analyze: Callable[[str], str], provider: str = "", ledger: Ledger | None = None) -> DataFrame:
    """Results of a provider, a callable from payload JSON to result text, called in the tasks once a
    distinct request: requests are known by the digest of ``provider`` and their JSON, and a ledger keeps their answers."""
    asked = batches.select("conv_id", "batch_no", F.to_json("payload", KEEP_NULLS).alias("json"))
    asked = asked.withColumn("digest", F.sha2(F.concat(F.lit(provider + "\n"), "json"), 256))
    answers = (ledger or Ledger(batches.sparkSession)).ask(asked, analyze)
    return asked.join(answers, "digest").select("conv_id", "batch_no", "result")


def bare_json(text: Column) -> Column:
    """A model's answer without white space and code fence around it."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(bare, r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1")


STRINGS = "array<string>"
ITEM = "question_id string, summary string, scores struct<relevance:int,technical_depth:int,clarity:int,structure:int>, strengths array<string>, risks array<string>, suggestions array<string>, improved_answer string, evidence_segment_ids array<string>"


def checked_results(results: DataFrame, batches: DataFrame, evidence: DataFrame) -> DataFrame:
    """conv_id, batch_no, errors, overview, questions, review_plan, warnings of provider results.

    ``errors`` lists all that is wrong, in the order of the result: it must be an object with an
    overview and questions; every question asked must come once and no other; evidence must be
    the question's own; scores are whole numbers from 1 to 5 or null; lists are of strings; a
    plan may name asked questions only.  What is known of a conversation's questions joins by
    key; the sets are compared as arrays of one batch, which its bounds keep small."""
    known = evidence.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "evidence"))).alias("known"))
    rows = results.join(batches.select("conv_id", "batch_no", "question_ids"), ["conv_id", "batch_no"]).join(known, "conv_id", "left")
    rows = rows.withColumn("v", F.try_parse_json(bare_json(F.col("result"))))
    kind = lambda v: F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("MISSING")), "^[A-Z]+", 0)
    get = lambda v, path, t="variant": F.try_variant_get(v, path, t)
    is_null = lambda v: kind(v).isin("MISSING", "VOID")
    # Lists of strings: absent, or an array whose elements all are strings.
    listed = lambda v: kind(v).isin("MISSING") | ((kind(v) == "ARRAY") & F.forall(F.coalesce(get(v, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: kind(x) == "STRING"))
    strings = lambda v: F.coalesce(get(v, "$", STRINGS), F.array().cast(STRINGS))
    error = lambda wrong, *what: F.when(wrong, F.concat(*[F.lit(w) if isinstance(w, str) else w for w in what]))
    v = F.col("v")
    rows = rows.withColumns({"o": get(v, "$.overview"), "qs": get(v, "$.questions"), "plan": get(v, "$.review_plan"), "warn": get(v, "$.warnings")})
    each = lambda name: F.coalesce(get(F.col(name), "$", "array<variant>"), F.array().cast("array<variant>"))
    rows = rows.withColumns({"items": each("qs"), "plans": each("plan")})
    name_of = lambda q: F.coalesce(get(q, "$.question_id", "string"), F.lit(""))
    rows = rows.withColumn("names", F.transform("items", name_of))
    own = lambda q: F.coalesce(F.try_element_at("known", name_of(q)), F.array().cast(STRINGS))

    def item_errors(q: Column, k: Column) -> Column:
        name = name_of(q)
        at = F.concat(F.lit("questions["), k, F.lit("]"))
        foreign = F.array_except(strings(get(q, "$.evidence_segment_ids")), own(q))
        score = lambda s: get(q, f"$.scores.{s}")
        bad = lambda s: ~is_null(score(s)) & ((kind(score(s)) != "BIGINT") | ~F.coalesce(get(score(s), "$", "int").between(1, 5), F.lit(False)))
        return F.array(
            error(kind(q) != "OBJECT", at, ": not an object"),
            error(~F.array_contains(F.map_keys(F.coalesce("known", F.create_map().cast("map<string,array<string>>"))), name), at, ": unknown question ", name),
            error(F.map_contains_key("known", name) & ~F.array_contains("question_ids", name), at, ": not of this batch: ", name),
            error(F.array_contains(F.slice("names", F.lit(1), k), name), at, ": repeated: ", name),
            error(~listed(get(q, "$.evidence_segment_ids")), at, ": evidence_segment_ids must be strings"),
            error(F.size(foreign) > 0, name, ": foreign evidence ", F.array_join(F.array_sort(foreign), ", ")),
            error(~is_null(get(q, "$.scores")) & (kind(get(q, "$.scores")) != "OBJECT"), name, ": scores must be an object"),
            *[error(bad(s), name, f": {s} must be 1 to 5 or null") for s in SCORES],
            error(~is_null(get(q, "$.improved_answer")) & (kind(get(q, "$.improved_answer")) != "STRING"), name, ": improved_answer must be a string or null"),
            *[error(~listed(get(q, f"$.{f}")), name, f": {f} must be strings") for f in ("strengths", "risks", "suggestions")],
        )

    missing = F.array_sort(F.array_except("question_ids", "names"))
    lost = lambda p: F.array_except(strings(get(p, "$.question_ids")), F.col("question_ids"))
    errors = F.concat(
        F.array(error(v.isNull() | (kind(v) != "OBJECT"), "not a JSON object"), error(kind(F.col("o")) != "OBJECT", "overview missing")),
        F.array(*[error(~listed(get(F.col("o"), f"$.{f}")), f"overview.{f} must be strings") for f in ("strengths", "risks", "suggested_focus")]),
        F.array(error(kind(F.col("qs")) != "ARRAY", "questions missing")),
        F.flatten(F.transform("items", item_errors)),
        F.array(error(F.size(missing) > 0, "missing questions: ", F.array_join(missing, ", ")), error(~is_null(F.col("plan")) & (kind(F.col("plan")) != "ARRAY"), "review_plan must be an array")),
        F.transform("plans", lambda p: error((kind(p) != "OBJECT") | ~listed(get(p, "$.question_ids")), "review_plan must be objects with strings")),
        F.transform("plans", lambda p: error(F.size(lost(p)) > 0, "review_plan names unknown questions: ", F.array_join(F.array_sort(lost(p)), ", "))),
        F.array(error(~listed(F.col("warn")), "warnings must be strings")),
    )
    text = lambda x, path, default="": F.coalesce(F.when(get(x, path, "string") != "", get(x, path, "string")), F.lit(default))
    overview = F.struct(text(F.col("o"), "$.summary").alias("summary"), *[strings(get(F.col("o"), f"$.{f}")).alias(f) for f in ("strengths", "risks", "suggested_focus")])
    question = lambda q: F.struct(
        name_of(q).alias("question_id"), text(q, "$.summary").alias("summary"), F.struct(*[get(q, f"$.scores.{s}", "int").alias(s) for s in SCORES]).alias("scores"),
        *[strings(get(q, f"$.{f}")).alias(f) for f in ("strengths", "risks", "suggestions")], get(q, "$.improved_answer", "string").alias("improved_answer"), strings(get(q, "$.evidence_segment_ids")).alias("evidence_segment_ids"),
    )
    planned = lambda p: F.struct(text(p, "$.priority", "medium").alias("priority"), text(p, "$.topic").alias("topic"), text(p, "$.action").alias("action"), strings(get(p, "$.question_ids")).alias("question_ids"))
    return rows.select(
        "conv_id", "batch_no", F.array_compact(errors).alias("errors"), overview.alias("overview"), F.transform("items", question).alias("questions"), F.transform("plans", planned).alias("review_plan"), strings(F.col("warn")).alias("warnings")
    )


def merged_results(checked: DataFrame, evaluated: bool) -> DataFrame:
    """A row per conversation: lists of its batches united in order, summaries joined.  Raises if
    any batch has errors."""
    parts = checked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("batch_no", "errors", "overview", "questions", "review_plan", "warnings"))).alias("b"))
    failed = F.filter(F.flatten(F.transform("b", lambda x: x["errors"])), lambda e: e.isNotNull())
    parts = parts.withColumn("b", F.when(F.size(failed) > 0, F.raise_error(F.concat_ws("; ", failed)).cast(parts.schema["b"].dataType)).otherwise(F.col("b")))
    n = F.size("b")
    union = lambda field: F.array_distinct(F.filter(F.flatten(F.transform("b", lambda x: x["overview"][field])), lambda s: s != ""))
    said = F.array_join(F.filter(F.transform("b", lambda x: x["overview"]["summary"]), lambda s: s != ""), " ")
    first = F.col("b")[0]
    summary = F.when(n == 1, said).otherwise(F.concat(F.lit("已分 "), n, F.lit(" 批完成语义分析。"), said))
    told = F.concat(F.flatten(F.transform("b", lambda x: x["warnings"])), F.array(F.concat(F.lit("Semantic analysis used "), n, F.lit(" requests."))))
    status = F.lit("evaluated" if evaluated else "not_evaluated")
    overview = F.struct(status.alias("assessment_status"), summary.alias("summary"), *[F.when(n == 1, first["overview"][f]).otherwise(union(f)).alias(f) for f in ("strengths", "risks", "suggested_focus")])
    return parts.select(
        "conv_id", n.cast("long").alias("request_count"), overview.alias("overview"), F.flatten(F.transform("b", lambda x: x["questions"])).alias("questions"),
        F.flatten(F.transform("b", lambda x: x["review_plan"])).alias("review_plan"), F.when(n == 1, first["warnings"]).otherwise(F.array_distinct(F.filter(told, lambda s: s != ""))).alias("warnings"),
    )


def refuse_oversize(batches: DataFrame, most_chars: int) -> None:
    """Raises where a question alone exceeds the bound, before any request is made."""
    over = batches.filter((F.col("n_questions") == 1) & (F.col("n_chars") > most_chars)).select("conv_id", F.col("question_ids")[0].alias("question"), "n_chars").first()
    if over:
        raise ValueError(f"question {over['question']} of conversation {over['conv_id']} takes {over['n_chars']} characters, the bound is {most_chars}; lower answer_chars")


def analyses(tree: DataFrame, statistics: DataFrame, evidence: DataFrame, analyze: Callable[[str], str] | None = None, name: str = "none", remote: bool = False, allow_remote: bool = False, redact: bool = True, terms: list[str] | None = None, answer_chars: int = 2400, most_questions: int = 12, most_chars: int = 160_000, model: str | None = None, endpoint: str | None = None, created_at: str | None = None, ledger: Ledger | None = None) -> DataFrame:
    """The analysis document of each conversation.  Without ``analyze`` nothing is evaluated and each
    conversation is one request.  Payloads are redacted once, and written.  A remote provider needs consent and redaction: refused before any job;
    a question beyond the bound of a request: before any request.  Requests are written first and answers
    kept in ``ledger`` (one of the run by default), so that neither a retried task nor a reader calls again."""
    if remote and not (allow_remote and redact):
        raise ValueError("a remote provider needs allow_remote and redact")
    whole = stored(payloads(payload_questions(tree, terms, redact, answer_chars), statistics).drop("json"), "analysis-payloads")
    if analyze:
        batches = stored(payload_batches(whole, most_questions, most_chars), "analysis-requests")
        refuse_oversize(batches, most_chars)
        results = stored(provided_results(batches, analyze, f"{name}\n{model}\n{endpoint}", ledger), "analysis-results")
    else:
        batches = payload_batches(whole, 1 << 30, (1 << 31) - 2)
        results = none_results(batches)
    found = merged_results(checked_results(results, batches, evidence), analyze is not None)
    about = whole.select("conv_id", F.size("payload.questions").cast("long").alias("question_count"), "redaction_counts", "request_sha256")
    out = found.join(about, "conv_id")
    source = F.struct(F.lit(SCHEMA_VERSION).alias("conversation_schema_version"), "question_count", "request_count")
    provider = F.struct(F.lit(name).alias("name"), F.lit(model).cast("string").alias("model"), F.lit(remote).alias("remote"), F.lit(endpoint).cast("string").alias("endpoint"))
    privacy = F.struct(
        F.lit(remote and allow_remote).alias("remote_consent"), F.lit(redact).alias("redaction_enabled"), "redaction_counts", F.lit(False).alias("sent_audio"), F.lit(False).alias("sent_full_transcript"),
        F.lit("question_tree_only").alias("payload_scope"), "request_sha256",
    )
    status = F.lit("evaluated" if analyze else "not_evaluated").alias("assessment_status")
    assessed = F.transform("questions", lambda q: F.struct(q["question_id"].alias("question_id"), status, *[q[c].alias(c) for c in ASSESSED]))
    return out.select("conv_id", F.lit(ANALYSIS_VERSION).alias("schema_version"), moment(created_at).alias("created_at"), source.alias("source"), provider.alias("provider"), privacy.alias("privacy"), "overview", assessed.alias("questions"), "review_plan", "warnings")
