"""Documents and Markdown of conversations: lines are built as arrays where their rows are,
ordered and joined per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import text as T

NO_LINES = "array<string>"


def lines(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def listed(heading: str, values: Column) -> Column:
    some = F.concat(lines(f"**{heading}**", ""), F.transform(values, lambda v: say("- ", T.markdown_escaped(v))), lines(""))
    return F.when(F.size(values) > 0, some).otherwise(F.array().cast(NO_LINES))


def if_any(condition: Column, made: Column) -> Column:
    return F.when(condition, made).otherwise(F.array().cast(NO_LINES))


def stamp(start: Column, end: Column) -> Column:
    return say(T.format_timestamp(start), "–", T.format_timestamp(end))


def two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def gathered(rows: DataFrame, order: str, made: Column, name: str) -> DataFrame:
    """conv_id and all lines of its rows in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), made.alias("x"))))
    return rows.groupBy("conv_id").agg(F.flatten(F.transform(parts, lambda p: p["x"])).alias(name))


def text_of(*blocks: Column) -> Column:
    """Joined by line feeds, no white space at the end, one line feed."""
    return F.concat(F.regexp_replace(F.array_join(F.concat(*[F.coalesce(b, F.array().cast(NO_LINES)) for b in blocks]), "\n"), r"(?U)\s+$", ""), F.lit("\n"))


def v1_markdown(segments: DataFrame, questions: DataFrame, audio: Column | None = None) -> DataFrame:
    """conv_id, markdown of first-version transcripts (segments bear v1_role)."""
    spoken = lines(say("**[", stamp(F.col("start"), F.col("end")), "] ", F.col("speaker"), " (", F.col("v1_role"), ")**  "), F.col("text"), "")
    head = segments.groupBy("conv_id").agg(F.count_distinct("speaker").alias("speakers"), F.count("*").alias("n"))
    follow = F.transform("follow_ups", lambda f: say("- Follow-up：", f["text"]))
    answers = F.transform("candidate_answers", lambda a: say("- Candidate answer (", a["for_question"], ")：", a["text"]))
    item = F.concat(lines(say("### ", F.col("id"), " · ", F.col("topic.label")), "", say("- 与上一题关系：", F.col("topic.relation_to_previous")), say("- 主问题：", F.col("main_question.text"))), follow, answers, lines(""))
    out = head.join(gathered(segments, "idx", spoken, "body"), "conv_id").join(gathered(questions, "id", item, "qa"), "conv_id", "left")
    top = lines("# 技术面试转写", "", say("- 音频：`", audio if audio is not None else "unknown", "`"), say("- 说话人：", F.col("speakers")), say("- Segments：", F.col("n")), "", "## 完整转写", "")
    return out.select("conv_id", text_of(top, F.col("body"), if_any(F.size("qa") > 0, lines("## Q&A 初分段", "")), F.col("qa")).alias("markdown"))


def v2_markdown(roled: DataFrame, spans: DataFrame, events: DataFrame, tree: DataFrame, statistics: DataFrame, audio: Column | None = None) -> DataFrame:
    """conv_id, markdown of repaired conversations."""
    ids = lambda c: F.array_join(c, ", ")
    span = lines(say("- ", stamp(F.col("start"), F.col("end")), " · ", F.col("phase"), " · ", F.size("segment_ids"), " segments"))
    event = lines(say("- ", F.col("id"), " · ", stamp(F.col("start"), F.col("end")), " · ", F.col("event_type"), " · ", F.format_string("%.1f", "duration_seconds"), "s · ", ids(F.col("segment_ids"))))
    spoken = lines(say("**[", stamp(F.col("start"), F.col("end")), "] ", F.col("speaker"), " · ", F.col("role"), " (", two(F.col("role_confidence")), ") · ", F.col("phase"), "**  "), F.col("text"), "")
    a, q = F.col("answer"), F.col("segment_ids")
    root = F.concat(
        lines(say("### ", F.col("node_id"), " · ", F.col("node_type"), " · ", F.col("phase"), " · ", F.col("topic.label")), "", say("- asked_by: ", F.col("asked_by"), " (", two(F.col("role_confidence")), ")"),
              say("- relation: ", F.col("relation_to_previous")), say("- segment_ids: ", ids(q)), say("- question: ", F.col("text"))),
        if_any(a.isNotNull(), lines(say("- answer [", a["role"], "] (", ids(a["segment_ids"]), "): ", a["text"]))),
    )
    child = F.concat(
        lines(say("  - ", F.col("node_id"), " · ", F.col("node_type"), " · ", F.col("text"), " [", ids(q), "]")), if_any(a.isNotNull(), lines(say("    - answer [", a["role"], "]: ", a["text"], " [", ids(a["segment_ids"]), "]")))
    )
    nodes = tree.withColumn("made", F.when(F.col("child_no") == 0, root).otherwise(child))
    roots = nodes.groupBy("conv_id", "root_no").agg(F.array_sort(F.collect_list(F.struct("child_no", "made"))).alias("m"))
    questions = gathered(roots, "root_no", F.concat(F.flatten(F.transform("m", lambda x: x["made"])), lines("")), "questions")
    out = statistics.join(gathered(spans, "span_no", span, "spans"), "conv_id", "left").join(gathered(events, "event_no", event, "happened"), "conv_id", "left")
    out = out.join(gathered(roled.filter("valid"), "idx", spoken, "body"), "conv_id", "left").join(questions, "conv_id", "left")
    top = lines(
        "# Conversation Structure V2", "", say("- 音频：`", audio if audio is not None else "unknown", "`"), say("- Segments：", F.col("raw_segment_count"), " raw / ", F.col("valid_segment_count"), " valid"),
        say("- Question Tree：", F.col("main_question_count"), " main / ", F.col("follow_up_count"), " follow-up / ", F.col("clarification_count"), " clarification"), say("- Coding events：", F.col("coding_event_count")),
        "", "## Phase spans", "",
    )
    return out.select(
        "conv_id", text_of(top, F.col("spans"), if_any(F.size("happened") > 0, lines("", "## Events", "")), F.col("happened"), lines("", "## Cleaned transcript", ""), F.col("body"), lines("## Question Tree", ""), F.col("questions")).alias("markdown")
    )


def analysis_report(tree: DataFrame, statistics: DataFrame, analyses: DataFrame) -> DataFrame:
    """conv_id, markdown of analysis documents; all text of models and speakers is escaped."""
    code, safe, yes = T.inline_code, T.markdown_escaped, lambda c: F.when(c, "True").otherwise("False")
    found = analyses.select("conv_id", F.explode("questions").alias("i")).select("conv_id", F.col("i.question_id").alias("node_id"), "i")
    nodes = tree.join(found, ["conv_id", "node_id"], "left")
    a, i = F.col("answer"), F.col("i")
    answered = lines("**回答**", "", say("- [", stamp(a["start"], a["end"]), "; ", safe(F.array_join(a["segment_ids"], ", ")), "] ", safe(a["text"])), "")
    scores = F.array_compact(F.array(*[F.when(i["scores"][s].isNotNull(), say(f"{label} ", i["scores"][s], "/5")) for s, label in (("relevance", "相关性"), ("technical_depth", "技术深度"), ("clarity", "清晰度"), ("structure", "结构"))]))
    some = lambda c: c.isNotNull() & (c != "")
    none = F.array().cast(NO_LINES)
    item = F.concat(
        lines(say("### ", safe(F.col("node_id")), " · ", safe(F.col("topic.label"))), "", say("- 类型：`", code(F.col("node_type")), "`"), say("- 阶段：`", code(F.col("phase")), "`"),
              say("- 时间：`", stamp(F.col("start"), F.col("end")), "`"), say("- 问题 segments：`", code(F.array_join("segment_ids", ", ")), "`"), "", say("**问题**：", safe(F.col("text"))), ""),
        F.when(a.isNotNull(), answered).otherwise(lines("**回答**：未检测到可关联回答。", "")), if_any(F.size(scores) > 0, lines(say("**评分**：", F.array_join(scores, "；")), "")),
        if_any(some(i["summary"]), lines(say("**分析**：", safe(i["summary"])), "")), *[listed(h, F.coalesce(i[f], none)) for h, f in (("回答优势", "strengths"), ("风险与缺口", "risks"), ("改进建议", "suggestions"))],
        if_any(some(i["improved_answer"]), lines("**改进版回答**", "", safe(i["improved_answer"]), "")),
        if_any(F.size(F.coalesce(i["evidence_segment_ids"], none)) > 0, lines(say("证据 segments：`", code(F.array_join(i["evidence_segment_ids"], ", ")), "`"), "")),
    )
    out = analyses.drop("questions").join(statistics, "conv_id").join(gathered(nodes, "prompt_no", item, "body"), "conv_id", "left")
    p, v, o = F.col("provider"), F.col("privacy"), F.col("overview")
    top = lines(
        "# Interview Recap", "", say("- Provider：`", code(p["name"]), "`"), say("- Model：`", code(F.coalesce(p["model"], F.lit("none"))), "`"), say("- 远程传输：", F.when(p["remote"], "是（已显式授权）").otherwise("否")),
        say("- 分析状态：`", code(o["assessment_status"]), "`"), "", "## 对话结构摘要", "", say("- 有效 segments：", F.col("valid_segment_count")), say("- 主问题：", F.col("main_question_count")),
        say("- 追问：", F.col("follow_up_count")), say("- 澄清：", F.col("clarification_count")), say("- Coding events：", F.col("coding_event_count")), say("- Unknown role：", F.col("unknown_role_count")),
        "", "## 总体分析", "", safe(F.when(o["summary"] != "", o["summary"]).otherwise("暂无总体分析。")), "",
    )
    plan = F.transform("review_plan", lambda x: say("- **", safe(x["priority"]), " · ", safe(x["topic"]), "**：", safe(x["action"]), "（", safe(F.array_join(x["question_ids"], ", ")), "）"))
    counts = say("{", F.array_join(F.transform(F.map_entries(v["redaction_counts"]), lambda e: say("'", e["key"], "': ", e["value"])), ", "), "}")
    foot = lines(
        "## 隐私与追溯", "", say("- 发送音频：", yes(v["sent_audio"])), say("- 发送完整 transcript：", yes(v["sent_full_transcript"])), say("- Provider payload：`", code(v["payload_scope"]), "`"),
        say("- 本地脱敏：", yes(v["redaction_enabled"])), say("- 脱敏计数：`", code(counts), "`"), say("- Request SHA-256：`", code(v["request_sha256"]), "`"), "",
    )
    return out.select(
        "conv_id", text_of(top, listed("优势", o["strengths"]), listed("风险", o["risks"]), listed("建议重点", o["suggested_focus"]), lines("## 问题与回答", ""), F.col("body"),
                           if_any(F.size("review_plan") > 0, F.concat(lines("## 复习计划", ""), plan, lines(""))), foot, listed("Warnings", F.col("warnings"))).alias("markdown"),
    )
