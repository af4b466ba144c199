"""Contracts, phases and analyses do their costly work once, and only where it decides."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from dialoom.functions import contracts as C
from dialoom.functions import text as T
from dialoom.operators import analysis, cleanup, conformance, roles
from dialoom.plans import registry

SPAN = {"start": 0.0, "end": 1.5, "segment_ids": ["a", "b"]}
SEGMENT = {"id": "a", "start": 0, "end": 1.5, "speaker_id": "s", "role": "candidate", "role_confidence": 0.5, "phase": "INTRO", "text": "", "cleanup": {"valid": True, "reasons": ["x"], "duration_seconds": 1.5, "meaningful_char_count": 0, "text_density": 0.1, "question_strength": 2}, "more": {"a": [1, None]}}
ANSWER = {"role": "candidate", "role_confidence": 1, **SPAN, "speaker_ids": [], "text": "x"}
LEAF = {"id": "Q1.1", "node_type": "follow_up", "relation_to_previous": "same_topic", "asked_by": "interviewer", "role_confidence": 0.5, "phase": "CODING", **SPAN, "speaker_ids": ["s"], "text": "x", "answers": [ANSWER], "children": [], "topic": {}}
QUESTION = LEAF | {"id": "Q1", "children": [LEAF, LEAF]}
ASSESSED = {"question_id": "Q1", "assessment_status": "evaluated", "summary": "", "scores": {"relevance": 5, "technical_depth": None, "clarity": 1, "structure": 2}, "strengths": [], "risks": ["x"], "suggestions": [], "improved_answer": None, "evidence_segment_ids": ["a"]}
ODD = [None, "", "x", -1, 0.5, 2, 7.0, 1e3, True, [], {}, [1, 1], ["a", None], ["a", "a"], [{}], {"a": -1}]


def places(value):
    for k in list(value) if isinstance(value, dict) else range(len(value)):
        yield value, k
        if isinstance(value[k], dict | list):
            yield from places(value[k])


def changed(value, rng):
    value = copy.deepcopy(value)
    at, k = rng.choice(list(places(value)))
    what = rng.randrange(3)
    if what == 0:
        del at[k]
    elif what == 1 or isinstance(at, list):
        at[k] = rng.choice(ODD)
    else:
        at[f"more{rng.randrange(9)}"] = rng.choice(ODD)
    return value


@pytest.mark.parametrize(("whole", "part", "good"), [(C.CONVERSATION, C.SEGMENT, SEGMENT), (C.CONVERSATION, {"$ref": "#/$defs/question"}, QUESTION), (C.ANALYSIS, C.ASSESSED, ASSESSED)])
def test_sound_is_told_of_values_without_violations_only(spark, whole, part, good, monkeypatch):
    rng = random.Random(3)
    contract = conformance.Contract(whole)
    texts = [json.dumps(good), *[json.dumps(changed(good, rng)) for _ in range(400)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, document string")
    told = {r.n for r in rows.select("n", F.try_parse_json("document").alias("v")).filter(F.expr(contract.sound(part, "v", 2))).collect()}
    monkeypatch.setattr(conformance.Contract, "sound", lambda *_: None)  # all are walked
    wrong = {r.n for r in conformance.violations(rows, {"$defs": whole.get("$defs", {}), **part}).collect()}
    assert 0 in told and not told & wrong and wrong
    assert len(told) > 0.8 * (len(texts) - len(wrong))


def test_values_told_sound_are_not_put_off(spark, monkeypatch):
    kept, stored = [], conformance.stored
    monkeypatch.setattr(conformance, "stored", lambda df, name: kept.append(name) or stored(df, name))
    schema = {"type": "array", "items": {"$ref": "#/$defs/question"}, "$defs": {"question": C.QUESTION}}
    late = QUESTION | {"children": [LEAF | {"children": [LEAF, LEAF | {"phase": "LATER"}]}]}
    rows = spark.createDataFrame([(1, json.dumps([QUESTION] * 5)), (2, json.dumps([QUESTION, QUESTION | {"text": 3}]))], "n int, document string")
    assert [tuple(r) for r in conformance.violations(rows.filter("n = 1"), schema).collect()] == [] and len(kept) == 1
    assert [tuple(r) for r in conformance.violations(rows, schema).collect()] == [(2, "$[1].text", "type string")]
    deep = spark.createDataFrame([(1, json.dumps([QUESTION, late]))], "n int, document string")
    assert [tuple(r) for r in conformance.violations(deep, schema).collect()] == [(1, "$[1].children[0].children[1].phase", "enum")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_phases_deal_and_clean_once(spark, sf_dir):
    plan = plan_of(registry.phased_segments(spark, sf_dir))
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan


TEXTS = ["", " ", "嗯。", "。，，。", "哒哒哒哒哒哒哒哒哒", "请你介绍一下项目？", "aaaaaaab 1", "abcdefgh", "我们采用 kafka", "AAaaAAaabb", "今天面试先到这里，拜拜。"]


def test_features_of_distinct_texts_equal_those_of_each(spark):
    rng = random.Random(4)
    rows = [(k, float(at := rng.randrange(100)), at + rng.choice([0.0, 9.0, 13.0, 30.0]), rng.choice([*TEXTS, None])) for k in range(400)]
    df = spark.createDataFrame(rows, "idx int, start double, end double, text string")
    one, each = cleanup.annotated_once(df), cleanup.annotate(df)
    assert one.columns == each.columns
    assert one.orderBy("idx").collect() == each.orderBy("idx").collect()


def test_a_character_that_makes_up_most_of_a_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aaaaaab题") for _ in range(rng.randrange(1, 20))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.mostly_one(F.col("t"), 0.68).alias("x")).collect()
    assert [(r.t, r.x) for r in got] == [(t, max(map(t.count, t)) / len(t) >= 0.68) for t in texts]
    assert {r.x for r in got} == {True, False}


def test_analyses_redact_once(spark, sf_dir):
    talks = registry.Talks(spark, sf_dir)
    assert talks.statistics() is talks.statistics()
    plan = plan_of(talks.analyses())
    assert "Window" not in plan and "api[_-]?key" not in plan


def test_texts_without_a_match_are_not_split(spark):
    rows = spark.createDataFrame([(1, 1, "电话 13800138000"), (1, 2, ""), (1, 3, "没有"), (1, 4, "13800138000 与 13900139000 a@b.cn")], "conv_id bigint, n int, text string")
    out = analysis.with_numbered_redactions(rows, ["n"], ["没"])
    assert [(r.text, r.n_phone, r.n_custom) for r in out.orderBy("n").collect()] == [
        ("电话 [REDACTED_PHONE_1]", 1, 0), ("", 0, 0), ("[REDACTED_CUSTOM_1]有", 0, 1), ("[REDACTED_PHONE_2] 与 [REDACTED_PHONE_3] [REDACTED_EMAIL_1]", 2, 0),
    ]


def test_priors_of_grouped_speakers_equal_those_of_rows(spark):
    """Speakers are grouped before any window, also where a speaker or a whole conversation has no valid row."""
    rng = random.Random(6)
    rows = [(rng.randrange(9), k, float(k), k + 2.0, rng.choice(["speaker_0", "speaker_1", "speaker_unknown"]), "。" if k % 9 == 0 else rng.choice(TEXTS)) for k in range(300)]
    rows += [(99, 1, 0.0, 1.0, "speaker_0", "。"), (98, 1, 0.0, 1.0, "speaker_0", "。"), (98, 2, 1.0, 2.0, "speaker_1", "我负责系统")]
    cleaned = cleanup.annotate(spark.createDataFrame(rows, "conv_id bigint, idx int, start double, end double, speaker string, text string")).cache()
    each = {(r.conv_id, r.speaker): (r.p_interviewer, r.p_candidate) for r in roles.with_priors(cleaned).collect()}
    got = roles.speaker_priors(cleaned)
    assert "row_number" not in plan_of(got)
    assert {(r.conv_id, r.speaker): (r.interviewer, r.candidate) for r in got.collect()} == {k: v for k, v in each.items() if v[0] is not None}
    told = roles.speaker_summary(cleaned.withColumn("role", F.lit("candidate")))
    assert {(r.conv_id, r.speaker) for r in told.filter("dominant_role = 'unknown'").collect()} == {k for k, v in each.items() if v[0] is None}


def test_events_are_written_once(spark, sf_dir):
    talks = registry.Talks(spark, sf_dir)
    assert "Window" not in plan_of(talks.events) and talks.events is talks.events
