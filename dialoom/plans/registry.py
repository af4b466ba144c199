"""Registered queries of the conversation engine."""

from __future__ import annotations

from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import contracts as C
from dialoom.functions import text as T
from dialoom.operators import analysis, cleanup, conformance, dictionaries, documents, events, phases, prompts, questions, reports, roles, summary, turns
from dialoom.plans.oracles import ORACLES
from dialoom.sources import documents as D
from dialoom.sources import files
from dialoom.sources import segments as S
from dialoom.sources.stored import fresh_path, stored

#: the moment that documents of registered queries bear, so that runs agree
MOMENT = "2024-01-01T00:00:00+00:00"


def joined(df: DataFrame, *names: str, by: str = ",") -> DataFrame:
    """Arrays of strings as one string, for results that are compared."""
    return df.withColumns({n: F.array_join(n, by) for n in names})


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_events(spark, sf_dir)


def cleaned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned below the numbering, each expression once, and above the one exchange, in as many tasks as the rows need."""
    return S.numbered(S.event_rows(spark, sf_dir), cleanup.annotate)


def phased_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phases.with_phases(cleaned_segments(spark, sf_dir))


def roled(phased: DataFrame) -> DataFrame:
    return roles.with_roles(roles.with_v1_roles(phased))


def roled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roled(phased_segments(spark, sf_dir))


def prompts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.prompts_with_answers(roled_segments(spark, sf_dir))


def tree_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.question_tree(prompts_of(spark, sf_dir))


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.merged_events(events.coding_events(phased_segments(spark, sf_dir)))


class Talks:
    """What queries over whole conversations read: roled segments, question trees, events and statistics,
    each written once, and tables that follow from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        rows = S.event_rows(spark, sf_dir)
        parts = S.partitions_for(rows)
        cleaned = S.numbered(cleanup.annotated_once(rows), partitions=parts)
        self.roled = S.by_conversation(stored(roled(phases.with_phases(cleaned)), "talk-segments"), parts)
        self.tree = S.by_conversation(stored(questions.question_tree(prompts.prompts_with_answers(self.roled)), "talk-questions"), parts)
        self.spans = phases.phase_spans(self.roled)
        self.v1 = questions.v1_questions(self.roled)
        self.evidence = questions.evidence(self.tree)

    @cached_property
    def events(self) -> DataFrame:
        return stored(events.merged_events(events.coding_events(self.roled)), "talk-events")

    @cache
    def statistics(self) -> DataFrame:
        return stored(summary.statistics(self.roled, self.tree, self.events, self.v1), "talk-statistics")

    def payloads(self) -> DataFrame:
        return analysis.payloads(analysis.payload_questions(self.tree), self.statistics())

    def analyses(self) -> DataFrame:
        return analysis.analyses(self.tree, self.statistics(), self.evidence, created_at=MOMENT)

    def documents(self) -> DataFrame:
        r = self.roled
        return documents.v2_documents(r, self.spans, self.events, turns.v2_turns(r), self.tree, questions.flat_questions(self.tree), roles.speaker_summary(r), roles.speaker_priors(r), self.statistics(), MOMENT)


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numbered(S.event_rows(spark, sf_dir).withColumn("text", T.normalize_text(F.col("text")))).select("conv_id", "idx", "text")


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned_segments(spark, sf_dir)
    return rows.select("conv_id", "idx", "m", "v1_score", "ack", "strength", T.format_timestamp(F.col("start")).alias("stamp"))


def cleanup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(cleaned_segments(spark, sf_dir).select("conv_id", "idx", "m", "strength", "reasons", "valid"), "reasons", by="|")


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser documents made of events, as S.from_raw reads them: blanks leave holes in idx."""
    return S.from_raw(raw_documents(spark, sf_dir))


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.by_conversation(S.event_rows(spark, sf_dir))
    n = F.row_number().over(phases.by_conv().orderBy("ts", "event_id"))
    spk = F.when(F.col("speaker") != "speaker_unknown", F.substring("speaker", 9, 9).cast("int"))
    text = F.when(F.col("event_id") % 13 == 0, "  ").otherwise(F.col("text"))
    item = F.struct(text.alias("text"), F.rint(F.col("start") * 1000).cast("long").alias("start"), F.rint(F.col("end") * 1000).cast("long").alias("end"), spk.alias("spk"), F.lit(None).cast("array<array<bigint>>").alias("timestamp"))
    info = F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("x")))), lambda p: p["x"])
    docs = rows.withColumn("n", n).groupBy("conv_id").agg(info.alias("info"))
    whole = F.struct(F.lit("").alias("text"), F.lit(None).cast("array<array<bigint>>").alias("timestamp"), F.col("info").alias("sentence_info"))
    return docs.select("conv_id", F.array(whole).alias("result"))


def role_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a segment alone says of its speaker's role, priors included."""
    rows = roles.with_evidence(phased_segments(spark, sf_dir))
    return rows.select("conv_id", "idx", "p_interviewer", "p_candidate", "base_i", "base_c")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a conversation, by validity and reason: one partial-sum aggregate."""
    out = cleaned_segments(spark, sf_dir)
    n = lambda c: F.sum(c.cast("long"))
    why = lambda r: n(F.array_contains("reasons", r))
    return out.groupBy("conv_id").agg(
        F.count("*").alias("segment_count"), n(F.col("valid")).alias("valid_count"), n(~F.col("valid")).alias("invalid_count"), n(F.col("speaker") == "speaker_unknown").alias("unknown_speaker_count"),
        why("pure_or_repeated_punctuation").alias("n_punctuation"), why("repetitive_noise_transcription").alias("n_noise"), why("long_duration_low_text_density").alias("n_sparse"), why("long_duration_very_little_text").alias("n_little"),
        F.max("end").alias("duration"), F.sum("m").cast("long").alias("meaningful_chars"),
    )


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Talks(spark, sf_dir).statistics()
    reasons = F.array_join(F.transform(F.map_entries("cleanup_reason_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumn("cleanup_reason_counts", reasons)


def topic_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.numbered(S.event_rows(spark, sf_dir).withColumn("t", T.topic(F.col("text"))))
    return out.select("conv_id", "idx", F.col("t.label").alias("label"), F.array_join("t.keywords", "|").alias("keywords"))


def benchmark_words(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """A dictionary that grows with the data: each benchmark item's distinct words of so many letters, numbered in its text's order."""
    words = F.array_distinct(F.filter(F.split("text", r"[ \n.,;:!?]+"), lambda w: F.length(w) >= least))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(words).alias("pos", "word"))
    return items.withColumn("word_no", F.col("item_id").cast("long") * 1000000 + F.col("pos"))


def dictionary_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark item's words a document holds most of, as substrings, case aside."""
    topics = benchmark_words(spark, sf_dir, 5).selectExpr("concat('item_', item_id) AS label", "item_id AS label_no", "word", "word_no")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return joined(dictionaries.topics_of(docs, ["doc_id"], "text", topics), "keywords", by="|")


def dictionary_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which benchmark items' words are spelled backwards, longest first."""
    words = benchmark_words(spark, sf_dir, 5).groupBy("word").agg(F.min("word_no").alias("no"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dictionaries.spelled(docs, ["doc_id"], "text", words.select(F.col("word").alias("key"), F.reverse("word").alias("value"), "no"))


def keyword_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a segment's topic words with the segment's before it."""
    out = S.numbered(S.event_rows(spark, sf_dir).withColumn("k", F.transform(T.topic(F.col("text"))["keywords"], F.lower)))
    before = F.lag("k").over(phases.in_order())
    return out.withColumn("b", before).filter("b is not null").select("conv_id", "idx", T.keyword_similarity(F.col("k"), F.col("b")).alias("similarity"))


def v1_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.v1_roles(cleaned_segments(spark, sf_dir))


def v1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(roles.v1_turns(segments(spark, sf_dir)), "segment_ids")


def v1_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = questions.v1_questions(cleaned_segments(spark, sf_dir))
    flat = lambda c, name: F.array_join(F.transform(c, lambda x: F.concat_ws("|", x[name], F.array_join(x["segment_ids"], ","), x["text"])), ";")
    return out.select(
        "conv_id", "id", F.array_join("main_question.segment_ids", ",").alias("question_ids"), F.col("main_question.text").alias("question"), flat("follow_ups", "id").alias("follow_ups"), flat("candidate_answers", "for_question").alias("answers"),
        F.array_join("segment_ids", ",").alias("segment_ids"), F.col("topic.label").alias("label"), F.array_join("topic.keywords", "|").alias("keywords"), F.col("topic.relation_to_previous").alias("relation"),
    )


def speaker_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.speaker_priors(cleaned_segments(spark, sf_dir))


def phase_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phased_segments(spark, sf_dir).select("conv_id", "idx", "phase")


def phase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(phases.phase_spans(phased_segments(spark, sf_dir)), "segment_ids")


def coding_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(phases.coding_silences(phased_segments(spark, sf_dir)), "segment_ids")


def events_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(joined(events_of(spark, sf_dir), "segment_ids"), "reasons", by="|")


def role_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.with_roles(phased_segments(spark, sf_dir)).select("conv_id", "idx", "role", "role_confidence")


def speaker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.speaker_summary(roles.with_roles(phased_segments(spark, sf_dir)))


def v2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(turns.v2_turns(roles.with_roles(phased_segments(spark, sf_dir))), "speaker_ids", "segment_ids")


def prompt_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prompts.with_anchors(roles.with_roles(phased_segments(spark, sf_dir)))
    return rows.filter("anchor").select("conv_id", "idx", "asked_by")


def prompt_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(prompts_of(spark, sf_dir).drop("answer", "family"), "speaker_ids", "segment_ids")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prompts_of(spark, sf_dir).filter("answer is not null").select("conv_id", "prompt_no", "answer.*")
    return joined(out, "speaker_ids", "segment_ids")


def question_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree_of(spark, sf_dir).withColumn("label", F.col("topic.label"))
    return out.select("conv_id", "prompt_no", "node_id", "parent_id", "node_type", "relation_to_previous", "label", "text")


def flat_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = questions.flat_questions(tree_of(spark, sf_dir))
    flat = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[x[k] for k in f], F.array_join(x["segment_ids"], ","))), ";")
    return out.select(
        "conv_id", "id", "root_question_id", F.array_join("main_question.segment_ids", ",").alias("question_ids"), flat("follow_ups", "id", "type").alias("follow_ups"), flat("candidate_answers", "for_question").alias("answers"),
        F.array_join("segment_ids", ",").alias("segment_ids"), F.col("topic.label").alias("label"), "relation_to_previous",
    )


def evidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(questions.evidence(tree_of(spark, sf_dir)), "evidence")


def payload_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysis.payload_questions(tree_of(spark, sf_dir))
    return rows.select("conv_id", "prompt_no", F.to_json("question", {"ignoreNullFields": "false"}).alias("question"), "counts.*")


def payload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds low enough that most conversations need several requests."""
    return joined(analysis.payload_batches(Talks(spark, sf_dir).payloads(), 5, 2000).drop("payload"), "question_ids")


def stage_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Talks(spark, sf_dir).payloads().select("conv_id", "json", "request_sha256")


def none_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = Talks(spark, sf_dir).analyses().select("conv_id", "source.question_count", F.posexplode("questions").alias("at", "q"))
    return each.select("conv_id", "question_count", (F.col("at") + 1).alias("place"), "q.question_id", "q.summary", F.array_join("q.evidence_segment_ids", ",").alias("evidence"))


def provider_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of which two in five are spoilt by conversation: a question renamed, foreign evidence."""
    talks = Talks(spark, sf_dir)
    batches = stored(analysis.payload_batches(talks.payloads(), 5, 1 << 30), "talk-batches")
    renamed = F.regexp_replace("result", '"question_id":"Q1"', '"question_id":"Q0"')
    foreign = F.regexp_replace("result", '"seg_0001"', '"seg_9999"')
    spoilt = F.when(F.col("conv_id") % 5 == 1, renamed).when(F.col("conv_id") % 5 == 2, foreign).otherwise(F.col("result"))
    out = analysis.checked_results(analysis.none_results(batches).withColumn("result", spoilt), batches, talks.evidence)
    return out.select("conv_id", "batch_no", F.array_join("errors", "; ").alias("errors"), F.size("questions").cast("long").alias("n_questions"))


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = Talks(spark, sf_dir)
    return reports.analysis_report(talks.tree, talks.statistics(), talks.analyses())


def v1_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.with_v1_roles(cleaned_segments(spark, sf_dir))
    return reports.v1_markdown(rows, questions.v1_questions(cleaned_segments(spark, sf_dir)))


def v2_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = Talks(spark, sf_dir)
    return reports.v2_markdown(talks.roled, talks.spans, talks.events, talks.tree, talks.statistics())


def v1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaned_segments(spark, sf_dir)
    out = documents.v1_documents(roles.with_v1_roles(cleaned), questions.v1_questions(cleaned), MOMENT)
    return out.select("conv_id", F.size("document.segments").cast("long").alias("n_segments"), F.size("document.qa_pairs").cast("long").alias("n_questions"), F.sha2(F.to_json("document"), 256).alias("document_sha256"))


def v2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Talks(spark, sf_dir).documents()
    return out.select("conv_id", F.size("document.segments").cast("long").alias("n_segments"), F.size("document.turns").cast("long").alias("n_turns"), F.size("document.question_tree").cast("long").alias("n_roots"), F.sha2(F.to_json("document"), 256).alias("document_sha256"))


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and analyses of all conversations against their contracts, with a fault planted in each
    by the last digit of conv_id: every planted fault is found at its path, and beside those only merged
    events that name a segment twice, as the merge makes them."""
    t = Talks(spark, sf_dir)
    digit, n = F.col("conv_id") % 10, F.size("d.segments")
    hurt = lambda x, field, value: x.withField(field, F.lit(value))
    segment = lambda s, i: F.when((digit == 1) & (i == 0), hurt(s, "role", "judge")).when((digit == 2) & (i == n - 1), hurt(s, "end", -1.0)).when((digit == 4) & (i == 0), hurt(s, "role_confidence", 1.5)).otherwise(s)
    span = lambda s, i: F.when((digit == 6) & (i == 0), s.withField("segment_ids", F.concat(s["segment_ids"], s["segment_ids"]))).otherwise(s)
    rows = t.documents().withColumnRenamed("document", "d")
    hurt_document = F.col("d").withField("segments", F.transform("d.segments", segment)).withField("phase_spans", F.transform("d.phase_spans", span))
    text = F.to_json(hurt_document, {"ignoreNullFields": "false"})
    put = lambda d, pattern, instead: F.when(digit == d, F.regexp_replace(text, pattern, instead))
    spoilt = F.coalesce(
        put(0, '"schema_version":"0.2.0"', '"schema_version":"0.9.0"'), put(3, '"statistics":[{].*[}]([}])$', '"statistics":null$1'), F.when(digit == 5, F.substring(text, 1, 100)),
        put(7, '"raw_segment_count":[0-9]+', '"raw_segment_count":"many"'), put(8, '"method":"[a-z_]+",', ""), text,
    )
    texts = stored(rows.select("conv_id", F.lit("conversation").alias("contract"), spoilt.alias("document")), "talk-documents")
    found = conformance.violations(texts, C.CONVERSATION)
    analyses = t.analyses()
    told = F.to_json(F.struct(*[c for c in analyses.columns if c != "conv_id"]), {"ignoreNullFields": "false"})
    more = F.when(digit == 9, F.regexp_replace(told, "^[{]", '{"extra":1,')).otherwise(told)
    analysed = conformance.violations(analyses.select("conv_id", F.lit("analysis").alias("contract"), more.alias("document")), C.ANALYSIS)
    return found.unionByName(analysed)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-version documents written, a file a conversation, read back, and their question trees."""
    at = fresh_path(spark, "documents")
    files.write_documents(Talks(spark, sf_dir).documents(), at, D.output_name(F.concat(F.lit("talk-"), F.col("conv_id"), F.lit(".json")), "v2"))
    rows = files.tree_of(by_name(files.of_version(files.read_documents(spark, at), "0.2.0"))).withColumn("label", F.col("topic.label"))
    return rows.select("conv_id", "prompt_no", "node_id", "parent_id", "node_type", "relation_to_previous", "label", "text")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw recogniser files, their results in lists of one to three levels, written and read back as segments;
    one in seven conversations has a truncated file beside its own, which is quarantined."""
    at = fresh_path(spark, "raw")
    rows = raw_documents(spark, sf_dir).select("conv_id", F.to_json("result", {"ignoreNullFields": "false"}).alias("result"))
    deep = F.col("conv_id") % 3
    wrapped = F.concat(F.repeat(F.lit("["), deep.cast("int")), "result", F.repeat(F.lit("]"), deep.cast("int")))
    content = F.concat(F.lit('{"schema_version":"0.1.0","source_audio":null,"result":'), wrapped, F.lit("}"))
    named = lambda kind: D.output_name(F.concat(F.lit(kind), F.col("conv_id"), F.lit(".16k.wav")), "raw")
    good = rows.select(named("talk-").alias("name"), content.alias("content"))
    bad = rows.filter("conv_id % 7 = 0").select(named("broken-").alias("name"), F.substring(content, 1, 60).alias("content"))
    files.write_files(good.unionByName(bad), at)
    return S.from_raw(files.raw_results(by_name(files.read_documents(spark, at))))


def by_name(documents: DataFrame) -> DataFrame:
    """Takes conv_id from the number in the file's name."""
    return documents.withColumn("conv_id", F.regexp_extract("path", "-([0-9]+)[.][^/]*$", 1).cast("bigint"))


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return T.with_redactions(docs, "text").drop("text")


def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.numbered(S.event_rows(spark, sf_dir).withColumn("text", F.substring(T.redacted(F.col("text")), 1, 2400)))
    return rows.select("conv_id", "idx", "text")


def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", T.markdown_escaped(F.coalesce("text", F.lit(""))).alias("text"))


def inline_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", F.sha2(T.inline_code(F.coalesce("html", F.lit(""))), 256).alias("code_sha256"))


def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", T.session_id(F.coalesce("url", F.lit(""))).alias("session_id"))


def dedupe_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of a conversation in order of their first segment."""
    rows = segments(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "speaker"))).alias("p"))
    return rows.select("conv_id", F.array_join(T.distinct_strings(F.transform("p", lambda x: F.when(x["speaker"] == "speaker_unknown", "").otherwise(x["speaker"]))), ",").alias("speakers"))


def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    parts = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))
    return rows.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def queries() -> dict:
    own = [
        segments, raw_segments, normalized_text, text_features, statistics, run_statistics, topic_classify, dictionary_topics, dictionary_spellings, keyword_similarity, v1_roles, v1_turns, v1_qa, speaker_priors, role_scores, phase_labels, phase_spans,
        coding_silence, events_merged, role_fold, speaker_summary, v2_turns, prompt_anchors, prompt_spans, answers, question_tree, flat_qa, evidence_sets, payload_min, payload_batches, stage_signature,
        none_analysis, provider_validate, report_markdown, v1_markdown, v2_markdown, v1_documents, v2_documents, contract_violations, document_files, raw_files, redaction_counts, redacted_text, markdown_escape, inline_code, session_ids,
        dedupe_ordered, ordered_concat,
    ]
    return {f.__name__: f for f in own} | {"cleanup": cleanup_query}


def oracle_sql() -> dict:
    return dict(ORACLES)
