"""Documents, their contracts, and their files: read, written, checked."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from dialoom.functions import contracts as C
from dialoom.operators import analysis, conformance, questions
from dialoom.plans import registry
from dialoom.sources import documents as D
from dialoom.sources import files
from dialoom.sources import segments as S
from dialoom.sources.ledger import Ledger

rng = random.Random(3)


def kind(v):
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "integer" if v == int(v) else "number"
    return {str: "string", type(None): "null", dict: "object", list: "array"}[type(v)]


def brute(schema, node, v, path):
    """A plain validator: the set of (path, rule)."""
    if "$ref" in node:
        at = schema
        for name in node["$ref"][2:].split("/"):
            at = at[name]
        return brute(schema, at, v, path)
    out, k = set(), kind(v)
    types = [node["type"]] if isinstance(node.get("type"), str) else node.get("type", [])
    if types and k not in types and not (k == "integer" and "number" in types):
        out.add((path, "type " + "|".join(types)))
    same = lambda a, b: type(a) is type(b) and a == b
    if "enum" in node and not any(same(v, x) for x in node["enum"]):
        out.add((path, "enum"))
    if "const" in node and not same(v, node["const"]):
        out.add((path, "const"))
    if k in ("integer", "number"):
        out |= {(path, f"minimum {node['minimum']}") for _ in [0] if v < node.get("minimum", v)} | {(path, f"maximum {node['maximum']}") for _ in [0] if v > node.get("maximum", v)}
    if k == "string":
        out |= {(path, f"minLength {node['minLength']}") for _ in [0] if len(v) < node.get("minLength", 0)} | {(path, "pattern") for _ in [0] if not re.search(node.get("pattern", ""), v)}
    if k == "object":
        named, more = node.get("properties", {}), node.get("additionalProperties", True)
        out |= {(f"{path}.{n}", "required") for n in node.get("required", []) if n not in v}
        for n, x in v.items():
            if n in named:
                out |= brute(schema, named[n], x, f"{path}.{n}")
            elif more is False:
                out.add((f"{path}.{n}", "not allowed"))
            elif more is not True:
                out |= brute(schema, more, x, f"{path}.{n}")
    if k == "array":
        if node.get("uniqueItems") and len({json.dumps(x) for x in v}) < len(v):
            out.add((path, "uniqueItems"))
        for i, x in enumerate(v):
            out |= brute(schema, node.get("items", {}), x, f"{path}[{i}]")
    return out


def node(depth):
    ids = [f"seg_{rng.randint(1, 99)}"]
    return {
        "id": "Q1", "node_type": "follow_up", "relation_to_previous": "same_topic", "asked_by": "interviewer", "role_confidence": 0.5, "phase": "INTRO", "start": 1, "end": 2.5, "speaker_ids": ["a"], "segment_ids": ids, "text": "x", "topic": {},
        "answers": [{"role": "candidate", "role_confidence": 1, "start": 1.0, "end": 2, "speaker_ids": [], "segment_ids": ids, "text": ""}], "children": [node(depth - 1) for _ in range(2)] if depth else [],
    }


def conversation():
    segment = {"id": "seg_0001", "start": 0, "end": 1.5, "speaker_id": "s", "role": "unknown", "role_confidence": 0, "phase": "END", "text": "t", "cleanup": {"valid": True, "reasons": [], "duration_seconds": 1.5, "meaningful_char_count": 1, "text_density": 0.5, "question_strength": 0}}
    structure = {"version": "V2", "method": "m", "speaker_diarization_is_weak_evidence": True, "valid_roles": ["unknown"], "valid_phases": ["END"]}
    statistics = dict.fromkeys(C.COUNTED, 3)
    return {"schema_version": "0.2.0", "conversation_structure": structure, "segments": [segment, dict(segment)], "phase_spans": [], "events": [], "question_tree": [node(5)], "statistics": statistics, "audio": None}


def assessed():
    item = {"question_id": "Q1", "assessment_status": "evaluated", "summary": "", "scores": {"relevance": 1, "technical_depth": None, "clarity": 5, "structure": 2}, "strengths": [], "risks": ["r"], "suggestions": [], "improved_answer": None, "evidence_segment_ids": ["a", "b"]}
    return {
        "schema_version": "0.1.0", "created_at": "now", "source": {"conversation_schema_version": "0.2.0", "question_count": 1, "request_count": 1}, "provider": {"name": "n", "model": None, "remote": False, "endpoint": None},
        "privacy": {"remote_consent": False, "redaction_enabled": True, "redaction_counts": {"email": 2}, "sent_audio": False, "sent_full_transcript": False, "payload_scope": "question_tree_only", "request_sha256": "0" * 64},
        "overview": {"assessment_status": "evaluated", "summary": "", "strengths": [], "risks": [], "suggested_focus": []}, "questions": [item], "review_plan": [{"priority": "p", "topic": "t", "action": "a", "question_ids": ["Q1"]}], "warnings": [],
    }


def spoilt(document):
    """One value of the document, anywhere, removed, replaced, added or doubled."""
    places = []

    def walk(x):
        for k in list(x) if isinstance(x, dict) else range(len(x)):
            places.append((x, k))
            if isinstance(x[k], dict | list):
                walk(x[k])

    walk(document)
    at, k = rng.choice(places)
    what = rng.randrange(4)
    if what == 0:
        del at[k]
    elif what == 1:
        at[k] = rng.choice([None, "", "x", -1, 0.5, 2, 7.0, True, [], {}, [1, 1], {"a": -1}])
    elif isinstance(at, dict):
        at[f"more{what}"] = rng.choice([1, "x", None])
    else:
        at.append(at[k])
    return document


@pytest.mark.parametrize(("schema", "make"), [(C.CONVERSATION, conversation), (C.ANALYSIS, assessed)])
def test_contracts_equal_a_plain_validator(spark, schema, make):
    texts = [json.dumps(make())] + [json.dumps(spoilt(spoilt(make()))) for _ in range(150)] + ['{"a": ', None, "[1]", '"x"', "null", "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, document string")
    got = {}
    for r in conformance.violations(df, schema).collect():
        got.setdefault(r["n"], []).append((r["path"], r["rule"]))
    assert 0 not in got and len(got) > 80
    for n, t in enumerate(texts):
        want = {("$", "not JSON")} if t in ('{"a": ', None) else brute(schema, schema, json.loads(t), "$")
        assert sorted(got.get(n, [])) == sorted(want), t


def test_keywords_that_are_unknown_fail_when_compiled(spark):
    with pytest.raises(ValueError, match="multipleOf"):
        conformance.Contract({"type": "object", "properties": {"a": {"multipleOf": 2}}})
    df = spark.createDataFrame([(1, "[[3, [4, 'x']]]".replace("'", '"'))], "n int, document string")
    deep = {"$ref": "#/$defs/n", "$defs": {"n": {"type": ["array", "integer"], "items": {"$ref": "#/$defs/n"}}}}
    assert [tuple(r) for r in conformance.violations(df, deep).collect()] == [(1, "$[0][1][1]", "type array|integer")]


def raw(result):
    return json.dumps({"schema_version": "0.1.0", "source_audio": "a.wav", "result": result})


def test_raw_files_of_any_shape(spark, tmp_path):
    talk = {"text": "all", "sentence_info": [{"text": " hello ,  you ", "start": 1500, "end": 2750.4, "spk": 0}, {"text": "", "start": 1, "end": 2, "spk": 1}, {"text": "b", "timestamp": [[3000, 3100], [3200, 3300]], "spk": "speaker_x"}, {"text": "c", "spk": None}]}
    shapes = {"a": talk, "b": [talk], "c": [[[talk, {}]]], "d": [], "e": [[]], "f": [{"text": "whole", "timestamp": [[100, 200], [300, 950]]}], "g": 7, "h": [{"text": "t", "sentence_info": [{"text": "x"}], "timestamp": [[5, 6]]}]}
    for name, result in shapes.items():
        (tmp_path / f"{name}.funasr.json").write_text(raw(result), encoding="utf-8")
    (tmp_path / "z.funasr.json").write_text('{"result": [', encoding="utf-8")
    (tmp_path / "y.funasr.json").write_text("[1, 2]", encoding="utf-8")
    documents = files.read_documents(spark, str(tmp_path))
    assert {r["path"][-13:] for r in files.quarantined(documents).collect()} == {"z.funasr.json", "y.funasr.json"}
    assert documents.select("conv_id").distinct().count() == 10
    rows = S.from_raw(files.raw_results(documents)).join(documents.select("conv_id", F.regexp_extract("path", r"(\w)\.funasr", 1).alias("file")), "conv_id")
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r["file"], r["idx"])):
        got.setdefault(r["file"], []).append((r["id"], r["start"], r["end"], r["speaker"], r["text"]))
    first = got["a"]
    assert [x[:4] for x in first] == [("seg_0001", 1.5, 2.75, "speaker_0"), ("seg_0003", 3.0, 3.3, "speaker_x"), ("seg_0004", 0.0, 0.0, "speaker_unknown")]
    assert got == {"a": first, "b": first, "c": first, "f": [("seg_0001", 0.1, 0.95, "speaker_unknown", "whole")], "h": [("seg_0001", 0.005, 0.006, "speaker_unknown", "x")]}


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("t-"), "id", F.lit(".md")).alias("name"), F.concat(F.lit("# "), "id", F.lit("\n\nb\n")).alias("content")).repartition(5)
    files.write_files(rows, str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f"t-{k}.md": f"# {k}\n\nb\n" for k in range(40)}
    files.write_markdown(spark.createDataFrame([(3, "new")], "conv_id int, markdown string"), f"file://{tmp_path}/out", F.lit("t-3.md"))
    assert (tmp_path / "out/t-3.md").read_text() == "new" and len(list((tmp_path / "out").iterdir())) == 40
    broken = rows.withColumn("content", F.when(F.col("name") == "t-7.md", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        files.write_files(broken, str(tmp_path / "never"))
    assert not (tmp_path / "never").exists() or not list((tmp_path / "never").iterdir())
    with pytest.raises(Exception, match="name"):
        files.write_files(rows.withColumn("name", F.lit("same.md")), str(tmp_path / "never"))
    assert not (tmp_path / "never").exists() or not list((tmp_path / "never").iterdir())
    files.write_files(rows.limit(0), str(tmp_path / "none"))


@pytest.fixture(scope="module")
def talks(spark, sf_dir):
    return registry.Talks(spark, sf_dir)


def test_second_version_files_feed_the_analysis(spark, talks, tmp_path):
    """What the analysis makes of files equals what it makes of the tables they were written from."""
    at = str(tmp_path / "v2")
    files.write_documents(talks.documents(), at, D.output_name(F.concat(F.lit("talk-"), F.col("conv_id"), F.lit(".json")), "v2"))
    read = registry.by_name(files.of_version(files.read_documents(spark, at), "0.2.0"))
    tree = files.tree_of(read)
    found = analysis.analyses(tree, files.statistics_of(read, list(analysis.PAYLOAD_COUNTS)), questions.evidence(tree), created_at=registry.MOMENT)
    plain = lambda df: sorted(str(r) for r in df.collect())
    assert plain(found) == plain(talks.analyses()) and found.count() > 3
    assert files.segments_of(read).count() == talks.roled.count()
    one = json.loads(next((tmp_path / "v2").iterdir()).read_text(encoding="utf-8"))
    assert {"derived_from", "conversation_structure", "speakers", "speaker_role_priors", "created_at", "source_audio", "audio", "pipeline"} <= set(one) and set(one["speakers"][0]) == {"id", "dominant_role", "role_confidence", "role_counts"}
    with pytest.raises(Exception, match="not schema_version"):
        files.of_version(files.read_documents(spark, at), "0.1.0").collect()


def test_oversize_questions_are_refused_before_any_request(spark, talks, tmp_path):
    mark = tmp_path / "asked"

    def ask(payload):
        mark.write_text("x")
        return "{}"

    with pytest.raises(ValueError, match=r"question Q\d.* of conversation \d+ takes \d+ characters, the bound is 100"):
        analysis.analyses(talks.tree, talks.statistics(), talks.evidence, ask, "own", most_chars=100)
    assert not mark.exists()


def test_a_retried_task_calls_no_provider_twice(spark, talks, tmp_path):
    """A task fails behind its third call; the job is run again on the same ledger, then once more."""
    calls = tmp_path / "calls"
    calls.mkdir()
    requests = spark.createDataFrame([(f"{k:064x}", f'{{"k": {k}}}') for k in [*range(20), 3, 3, 7]], "digest string, json string").coalesce(1)

    def ask(payload, limit=3):
        import json as J
        import uuid

        if len(list(calls.iterdir())) == limit:
            raise RuntimeError("provider lost")
        (calls / f"{J.loads(payload)['k']}-{uuid.uuid4().hex}").write_text("")
        return payload.replace("k", "answer")

    ledger = Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(Exception, match="provider lost"):
        ledger.ask(requests, ask)
    assert len(list(calls.iterdir())) == 3 and ledger.answers().count() == 3
    found = ledger.ask(requests, lambda p: ask(p, None))
    assert sorted(int(p.name.split("-")[0]) for p in calls.iterdir()) == list(range(20))
    assert {(int(r["digest"], 16), r["result"]) for r in found.collect()} == {(k, f'{{"answer": {k}}}') for k in range(20)}
    assert Ledger(spark, str(tmp_path / "ledger")).ask(requests, lambda p: ask(p, 20)).count() == 20 and len(list(calls.iterdir())) == 20


def test_analyses_ask_once_a_distinct_request(spark, talks, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def ask(payload):
        import json as J
        import uuid

        (calls / uuid.uuid4().hex).write_text("")
        return J.dumps({"overview": {"summary": "s"}, "questions": [{"question_id": q["question_id"]} for q in J.loads(payload)["questions"]]})

    ledger = Ledger(spark, str(tmp_path / "ledger"))
    run = lambda: analysis.analyses(talks.tree, talks.statistics(), talks.evidence, ask, "own", most_questions=4, ledger=ledger, created_at="now")
    first = sorted(str(r) for r in run().collect())
    n = len(list(calls.iterdir()))
    assert n == ledger.answers().count() > 3 and sorted(str(r) for r in run().collect()) == first and len(list(calls.iterdir())) == n
    assert conformance.violations(run().select("conv_id", F.struct("schema_version", "created_at", "source", "provider", "privacy", "overview", "questions", "review_plan", "warnings").alias("document")), C.ANALYSIS).count() == 0
