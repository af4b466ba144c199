"""The conversation engine against SQL, plain Python folds and small expected cases."""

from __future__ import annotations

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from dialoom.functions import lexicon as X
from dialoom.functions import text as T
from dialoom.operators import analysis, cleanup, phases, prompts, questions, reports, roles
from dialoom.plans import registry
from dialoom.sources import documents as D
from dialoom.sources import files
from dialoom.sources import segments as S

TABLES = ("events", "conversations", "documents", "pages", "benchmark")


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_agrees(spark, sf_dir, db, name):
    out = registry.queries()[name](spark, sf_dir)
    found = db.execute(registry.ORACLES[name])
    columns = sorted(out.columns)
    at = {d[0]: k for k, d in enumerate(found.description)}
    assert columns == sorted(at)
    assert plain(out.select(*columns).collect()) == plain([[r[at[c]] for c in columns] for r in found.fetchall()])


def frame(spark, rows):
    out = [(1, k + 1, f"seg_{k + 1:04d}", float(a), float(b), s, t) for k, (a, b, s, t) in enumerate(rows)]
    return spark.createDataFrame(out, "conv_id bigint, idx int, id string, start double, end double, speaker string, text string")


def test_cleanup_cases(spark):
    rows = [(0, 2, "a", "。，，。"), (0, 40, "a", "小问题？"), (0, 2, "a", "为什么？"), (0, 2, "a", "怎么做？"), (0, 2, "a", "复杂度呢？"), (0, 4, "a", "哒" * 9)]
    out = [r["reasons"] for r in cleanup.annotate(frame(spark, rows)).orderBy("idx").collect()]
    assert out == [["pure_or_repeated_punctuation"], ["long_duration_low_text_density"], [], [], [], ["repetitive_noise_transcription"]]


def test_normalize_and_stamps(spark):
    cases = ["redis 和 HTTPS", "  瑞迪斯   持久化 。 ", "xredis my sql", ""]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select(T.normalize_text(F.col("t")))
    assert [r[0] for r in df.collect()] == ["Redis 和 HTTPS", "Redis 持久化。", "xredis MySQL", ""]
    assert spark.range(1).select(T.format_timestamp(F.lit(61.234))).first()[0] == "00:01:01.234"


def test_redaction(spark):
    text = "a.b@example.com 13800138000 10.0.0.1 password=abc 11010519491231002X"
    df = spark.createDataFrame([(text,)], "t string")
    row = T.with_redactions(df.withColumn("r", T.redacted(F.col("t"), ["10", "zz"])), "t").first()
    assert row["r"] == row["t"] == "[REDACTED_EMAIL] [REDACTED_PHONE] [REDACTED_IPV4] [REDACTED_CREDENTIAL] [REDACTED_CN_ID]"
    assert [row[f"n_{k}"] for k, _ in X.PERSONAL] == [1, 1, 1, 1, 1]


def test_markdown(spark):
    df = spark.createDataFrame([("<script> [click](x)\n# in **u**",)], "t string").select(T.markdown_escaped(F.col("t")))
    assert df.first()[0] == r"&lt;script&gt; \[click\](x)<br># in \*\*u\*\*"


def test_raw_source(spark):
    raw = spark.createDataFrame([(1, [{"text": "x", "timestamp": None, "sentence_info": [{"text": "你好。", "start": 120, "end": 2340, "spk": 1, "timestamp": [[120, 500]]}, {"text": " ", "start": 1, "end": 2, "spk": None, "timestamp": None}]}]), (2, [{"text": "whole", "timestamp": [[10, 20], [30, 45]], "sentence_info": None}])], S.RAW)
    out = {r["conv_id"]: r for r in S.from_raw(raw).collect()}
    assert (out[1]["id"], out[1]["start"], out[1]["end"], out[1]["speaker"], out[1]["text"]) == ("seg_0001", 0.12, 2.34, "speaker_1", "你好。")
    assert (out[2]["start"], out[2]["end"], out[2]["speaker"]) == (0.01, 0.045, "speaker_unknown")


def cleaned(spark, rows):
    """Rows (start, end, speaker, text) of one conversation, cleaned; idx as given or by place."""
    return cleanup.annotate(frame(spark, rows))


def roled(spark, rows):
    return roles.with_roles(roles.with_v1_roles(phases.with_phases(cleaned(spark, rows))))


def test_phases_with_holes_and_late_numbers(spark):
    """idx 1, 2, 5, 6, 7, 8; the prompt at 6 backtracks ten seconds, to the row numbered 5."""
    rows = [(1, 0, "开始"), (2, 50, "好的"), (5, 110, "那个"), (6, 115, "请介绍一下你的项目"), (7, 130, "我负责后端"), (8, 140, "嗯嗯好")]
    out = [(1, i, f"seg_{i:04d}", float(a), a + 3.0, "speaker_0", t) for i, a, t in rows]
    df = spark.createDataFrame(out, "conv_id bigint, idx int, id string, start double, end double, speaker string, text string")
    found = {r["idx"]: r["phase"] for r in phases.with_phases(cleanup.annotate(df)).collect()}
    assert found == {1: "INTRO", 2: "INTRO", 5: "PROJECT", 6: "PROJECT", 7: "PROJECT", 8: "PROJECT"}


def test_roles_follow_the_talk_not_the_speaker(spark):
    rows = [(0, 3, "speaker_0", "请你介绍一下项目？"), (4, 20, "speaker_1", "我负责系统设计和性能优化，当时我设计了缓存方案，延迟降低了一半。"), (21, 24, "speaker_1", "为什么选择这个方案？"), (25, 40, "speaker_0", "因为读流量很大，我们当时比较了三种方案，最后选择了这一种，效果不错。")]
    found = {r["idx"]: r["role"] for r in roled(spark, rows).collect()}
    assert found[1] == "interviewer" and found[2] == "candidate" and found[3] == "interviewer"


def test_invalid_rows_stay_without_role(spark):
    out = roled(spark, [(0, 2, "speaker_0", "。，，。"), (3, 6, "speaker_0", "请你介绍一下项目？")]).orderBy("idx").collect()
    assert [(r["role"], r["role_confidence"]) for r in out][0] == ("unknown", 0.0) and out[1]["role"] == "interviewer"


def test_question_tree_cases(spark):
    def tree(rows):
        return questions.question_tree(prompts.prompts_with_answers(roled(spark, rows))).orderBy("prompt_no").collect()

    asked = [(0, 3, "speaker_0", "请你介绍一下 Redis 的持久化机制？"), (4, 12, "speaker_1", "RDB 是快照，AOF 是日志，我会先看数据量，再决定。"), (13, 15, "speaker_0", "那为什么选择 AOF？"), (16, 25, "speaker_1", "因为数据不能丢，我们当时比较了三种方案。")]
    out = tree(asked)
    assert [(r["node_id"], r["parent_id"], r["node_type"]) for r in out] == [("Q1", None, "main_question"), ("Q1.1", "Q1", "follow_up")]
    assert out[1]["segment_ids"] == ["seg_0003"] and out[1]["answer"]["segment_ids"] == ["seg_0004"] and out[1]["answer"]["role"] == "candidate"
    out = tree([*asked[:2], (13, 15, "speaker_0", "你是说只更新变化的索引吗？")])
    assert out[1]["node_type"] == "clarification" and out[1]["answer"] is None
    assert questions.question_tree(prompts.prompts_with_answers(roled(spark, [(0, 3, "speaker_0", "今天天气不错。")]))).count() == 0


def test_v1_questions_cases(spark):
    rows = [(0, 2, "speaker_0", "请你介绍一下 Redis"), (2.1, 4, "speaker_0", "的持久化机制？"), (5, 9, "speaker_1", "RDB 是快照。"), (10, 11, "speaker_0", "那为什么"), (11.2, 12, "speaker_0", "用 AOF？"), (13, 16, "speaker_1", "不能丢数据。"), (17, 19, "speaker_0", "下一个问题，HTTP 和 HTTPS 有什么区别？"), (20, 25, "speaker_1", "多了加密。")]
    out = questions.v1_questions(cleaned(spark, rows)).orderBy("id").collect()
    assert [r["main_question"]["segment_ids"] for r in out] == [["seg_0001", "seg_0002"], ["seg_0007"]]
    assert [f["segment_ids"] for f in out[0]["follow_ups"]] == [["seg_0004", "seg_0005"]] and out[1]["topic"]["label"] == "网络"
    assert [(a["for_question"], a["text"]) for a in out[0]["candidate_answers"]] == [("main", "RDB 是快照。"), ("follow_up_1", "不能丢数据。")]


def test_redactions_are_numbered_through_a_conversation(spark):
    texts = spark.createDataFrame([(1, 1, "a.b@example.com 13800138000"), (1, 2, "none"), (1, 3, "x@y.org, a@b.de 10.0.0.1 Kunde"), (2, 1, "q@r.net")], "conv_id bigint, n int, text string")
    out = {(r["conv_id"], r["n"]): r["text"] for r in analysis.with_numbered_redactions(texts, ["n"], ["Kunde"]).collect()}
    assert out[1, 1] == "[REDACTED_EMAIL_1] [REDACTED_PHONE_1]" and out[1, 3] == "[REDACTED_EMAIL_2], [REDACTED_EMAIL_3] [REDACTED_IPV4_1] [REDACTED_CUSTOM_1]"
    assert out[1, 2] == "none" and out[2, 1] == "[REDACTED_EMAIL_1]"


@pytest.fixture(scope="module")
def talks(spark, sf_dir):
    return registry.Talks(spark, sf_dir)


def test_batches_are_as_full_as_both_bounds_allow(spark, talks):
    whole = talks.payloads().cache()
    out = analysis.payload_batches(whole, 3, 900).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["conv_id"], r["batch_no"])):
        by.setdefault(r["conv_id"], []).append(r)
    compact = lambda p, qs: len(json.dumps({**p, "questions": qs}, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    for r in whole.collect():
        payload = json.loads(r["json"])
        assert hashlib.sha256(r["json"].encode()).hexdigest() == r["request_sha256"] and list(payload) == sorted(payload)
        left = payload["questions"]
        for b in by[r["conv_id"]]:
            n = b["n_questions"]
            assert [q["question_id"] for q in left[:n]] == b["question_ids"] and b["n_chars"] == compact(payload, left[:n])
            assert n == 1 or (n <= 3 and b["n_chars"] <= 900)
            assert n == len(left) or n == 3 or compact(payload, left[: n + 1]) > 900
            left = left[n:]
        assert not left


def good(ids):
    return {"overview": {"summary": "s", "strengths": ["a"], "risks": [], "suggested_focus": []}, "questions": [{"question_id": i, "summary": "x", "scores": {"clarity": 3}, "evidence_segment_ids": []} for i in ids], "review_plan": [], "warnings": ["w"]}


def test_results_are_checked(spark):
    batches = spark.createDataFrame([(1, 1, ["Q1", "Q2"])], "conv_id bigint, batch_no int, question_ids array<string>")
    evidence = spark.createDataFrame([(1, "Q1", ["s1"]), (1, "Q2", ["s2"]), (1, "Q3", [])], "conv_id bigint, node_id string, evidence array<string>")

    def errors(change, text=None):
        result = good(["Q1", "Q2"])
        change(result)
        given = spark.createDataFrame([(1, 1, text or "```json\n" + json.dumps(result) + "\n```")], "conv_id bigint, batch_no int, result string")
        return analysis.checked_results(given, batches, evidence).first()["errors"]

    assert errors(lambda r: None) == []
    cases = [
        (lambda r: r.pop("overview"), "overview missing"), (lambda r: r["overview"].update(risks=[1]), "overview.risks"), (lambda r: r.update(questions={}), "questions missing"),
        (lambda r: r["questions"].pop(), "missing questions: Q2"), (lambda r: r["questions"][0].update(question_id="Q9"), "unknown question Q9"), (lambda r: r["questions"].append(r["questions"][0]), "repeated: Q1"),
        (lambda r: r["questions"].append({"question_id": "Q3"}), "not of this batch: Q3"), (lambda r: r["questions"][0].update(evidence_segment_ids=["s2"]), "foreign evidence s2"),
        (lambda r: r["questions"][0]["scores"].update(clarity=6), "clarity must be"), (lambda r: r["questions"][0]["scores"].update(clarity=True), "clarity must be"), (lambda r: r["questions"][0]["scores"].update(structure=2.5), "structure must be"),
        (lambda r: r["questions"][0].update(improved_answer=3), "improved_answer"), (lambda r: r["review_plan"].append({"question_ids": ["Q7"]}), "unknown questions: Q7"), (lambda r: r.update(warnings="w"), "warnings must be"),
    ]
    for change, told in cases:
        assert any(told in e for e in errors(change)), told
    assert "not a JSON object" in errors(lambda r: None, "no json")[0]


def test_providers_and_merged_batches(spark, talks):
    def ask(payload):  # all of it goes to the workers by value
        items = [{"question_id": q["question_id"], "scores": {"clarity": 3}} for q in json.loads(payload)["questions"]]
        return json.dumps({"overview": {"summary": "s", "strengths": ["a"]}, "questions": items, "warnings": ["w"]})

    out = analysis.analyses(talks.tree, talks.statistics(), talks.evidence, ask, "own", most_questions=4).collect()
    many = [r for r in out if r["source"]["request_count"] > 1]
    assert many and all(r["overview"]["strengths"] == ["a"] and r["warnings"][-1] == f"Semantic analysis used {r['source']['request_count']} requests." for r in many)
    assert all(len(r["questions"]) == r["source"]["question_count"] for r in out)
    with pytest.raises(ValueError):
        analysis.analyses(talks.tree, talks.statistics(), talks.evidence, ask, "far", remote=True)
    none = analysis.analyses(talks.tree, talks.statistics(), talks.evidence)
    assert {r["overview"]["assessment_status"] for r in none.collect()} == {"not_evaluated"}
    text = [r["markdown"] for r in reports.analysis_report(talks.tree, talks.statistics(), none).collect()]
    assert all(t.startswith("# Interview Recap\n\n- Provider：`none`") and t.endswith("scores and coaching were not generated.\n") and "\n\n\n" not in t for t in text)


def test_reports_hold_every_row(talks):
    rows = {r["conv_id"]: r["markdown"] for r in reports.v2_markdown(talks.roled, talks.spans, talks.events, talks.tree, talks.statistics()).collect()}
    spoken = talks.roled.filter("valid").groupBy("conv_id").count().collect()
    assert all(rows[r["conv_id"]].count("\n**[") == r["count"] for r in spoken)
    asked = talks.tree.filter("child_no = 0").groupBy("conv_id").count().collect()
    assert all(rows[r["conv_id"]].count("\n### Q") == r["count"] for r in asked)


def test_sources(spark, tmp_path):
    (tmp_path / "knowledge").mkdir()
    write = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    topics = D.read_topics(spark, write("topics.yaml", "topics:\n  网络: [HTTP, TCP]\n  其他: [x]\n"))
    assert topics == {"网络": ["HTTP", "TCP"], "其他": ["x"]}
    assert D.read_replacements(spark, write("spell.yaml", "replacements:\n  redis: Redis\n")) == {"redis": "Redis"}
    assert D.redaction_terms(spark, ["b", " "], write("terms.txt", "# no\n a \n\nb\n")) == ["b", "a"]
    with pytest.raises(ValueError):
        D.read_settings(spark, write("settings.yaml", "project: {}\n"))
    assert D.resolved("knowledge/t.yaml", "/r", "/p", lambda p: p.startswith("/p")) == "/p/knowledge/t.yaml" and D.resolved("/abs", "/r") == "/abs"
    write("knowledge/a.json", json.dumps({"schema_version": "0.1.0", "segments": [{"id": "seg_0001", "start": 0.0, "end": 1.0, "speaker": "speaker_0", "role": "candidate", "text": "x"}], "qa_pairs": []}))
    docs = files.of_version(files.read_documents(spark, str(tmp_path / "knowledge")), "0.1.0")
    assert [r["v1_role"] for r in files.segments_of(docs).collect()] == ["candidate"]
    names = spark.createDataFrame([("a.16k.wav", "a.funasr.json", "a.v2.json")], "a string, b string, c string")
    row = names.select(D.output_name(F.col("a"), "raw"), D.output_name(F.col("b"), "structured"), D.output_name(F.col("c"), "v2"), D.output_name(F.col("c"), "analysis")).first()
    assert tuple(row) == ("a.funasr.json", "a.json", "a.v2.json", "a.analysis.json")
    assert D.file_digests(spark, str(tmp_path / "terms.txt")).first()["sha256"] == hashlib.sha256((tmp_path / "terms.txt").read_bytes()).hexdigest()


def test_events_equal_a_plain_walk(spark, sf_dir):
    phased = registry.phased_segments(spark, sf_dir)
    talks = {}
    for r in sorted(phased.collect(), key=lambda r: (r["conv_id"], r["idx"])):
        talks.setdefault(r["conv_id"], []).append(r)
    expected = []
    for conv, rows in talks.items():
        raw = []
        for r in rows:
            if r["phase"].startswith("CODING") and r["reasons"]:
                kind = "coding_low_speech_density" if any("long_duration" in x for x in r["reasons"]) else "coding_noise"
                raw.append([r["start"], r["end"], 0, kind, r["phase"], [r["id"]], set(r["reasons"])])
        for a, b in zip(rows, rows[1:], strict=False):
            if a["phase"].startswith("CODING") and b["phase"].startswith("CODING") and b["start"] - a["end"] >= 8.0:
                raw.append([a["end"], b["start"], 1, "coding_silence", "CODING", [a["id"], b["id"]], {"gap_between_coding_segments"}])
        out = []
        for e in sorted(raw, key=lambda e: e[:3]):
            if out and out[-1][3] == e[3] and e[0] <= out[-1][1] + 3.0:
                out[-1][1] = max(out[-1][1], e[1])
                out[-1][5] = out[-1][5] + e[5]
                out[-1][6] = out[-1][6] | e[6]
            else:
                out.append(list(e))
        expected += [(conv, f"event_{k:03d}", e[3], e[4], e[0], e[1], ",".join(e[5]), "|".join(sorted(e[6]))) for k, e in enumerate(out, 1)]
    found = registry.events_merged(spark, sf_dir).collect()
    assert expected and any("," in e[6] and e[2] != "coding_silence" for e in expected)
    assert sorted(tuple(r[c] for c in ("conv_id", "id", "event_type", "phase", "start", "end", "segment_ids", "reasons")) for r in found) == sorted(expected)
