"""The range join of points and intervals: equal to the nested loop, in work of its result's order."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from dialoom.operators import prompts
from dialoom.operators.intervals import FROM, KEPT, POINT, UNTIL, points_within

ENTRIES = "conv_id bigint, entries array<struct<kind int, no bigint, at double, item string>>"


def joined(df, cell):
    each = points_within(df, cell).groupBy("conv_id", "no").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("kept")).alias("kept"))
    return {(r["conv_id"], r["no"]): (r["items"], r["kept"]) for r in each.collect()}


@pytest.mark.parametrize(("seed", "cell"), [(1, 1), (2, 7), (3, 256)])
def test_equal_to_the_nested_loop(spark, seed, cell):
    """Overlapping, nested, empty, backward and open intervals, ties with bounds, points without order, several keys."""
    rng, rows, want = random.Random(seed), [], {}
    for conv in (1, 2, None):
        points = [(k, rng.choice([rng.randrange(60) * 1.0, rng.uniform(0, 60), math.inf, math.nan])) for k in range(1, 200)]
        spans = [(k, rng.randrange(60) * 1.0, rng.choice([rng.randrange(70) * 1.0, math.inf])) for k in range(1, 40)]
        rows += [(conv, [(POINT, k, at, f"i{k:03}"), None]) for k, at in points]
        rows += [(conv, [(FROM, k, a, None), (UNTIL, k, b, None), (UNTIL, k, b + 5, None), (KEPT, k, None, f"kept{k}")]) for k, a, b in spans]
        want |= {(conv, k): ([f"i{p:03}" for p, at in points if a <= at < b], [f"kept{k}"]) for k, a, b in spans}
    rng.shuffle(rows)
    got = joined(spark.createDataFrame(rows, ENTRIES).repartition(4), cell)
    assert got == want and any(not v[0] for v in want.values())
    assert joined(spark.createDataFrame([], ENTRIES), cell) == {}


def test_many_short_intervals_cost_what_they_hold(spark):
    """Every one of 100,000 intervals overlaps its neighbours; all pairs would be 10 billion."""
    n = 100_000
    k = F.col("id")
    null = F.lit(None).cast("string")
    s = lambda kind, at, item: F.struct(F.lit(kind).alias("kind"), (k + 1).alias("no"), at.cast("double").alias("at"), item.alias("item"))
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.array(s(POINT, n - k, k.cast("string")), s(FROM, n - k - 2, null), s(UNTIL, n - k + 2, null)).alias("entries"))
    began = time.time()
    sizes = points_within(df).groupBy("no").agg(F.sum(F.size("items")).alias("n")).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in sizes} == {4: n - 3, 3: 2, 2: 1} and time.time() - began < 60


ROLED = "conv_id bigint, idx bigint, pos bigint, id string, start double, end double, speaker string, text string, role string, role_confidence double, valid boolean, phase string, ack boolean, admin boolean"
SPANNED = ROLED + ", family string, asked_by string, anchor boolean, members array<struct<pos bigint, id string, speaker string, text string, role_confidence double, start double, end double>>"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_answers_equal_a_plain_walk(spark, monkeypatch, seed):
    """Starts in any order, prompts that overlap: each prompt takes what lies between its end and its successor's start."""
    rng, rows = random.Random(seed), []
    for k in range(150):
        at, anchor = rng.choice([k * 1.0, rng.uniform(0, 150)]), rng.random() < 0.2
        row = {"conv_id": 1, "idx": k + 1, "pos": k + 1, "id": f"s{k}", "start": at, "end": at + rng.choice([0.5, 1.0, 30.0]), "speaker": rng.choice("ab"), "text": f"t{k}", "role": "candidate", "role_confidence": rng.choice([0.5, 0.7, 0.9])}
        row |= {"valid": rng.random() < 0.9, "phase": rng.choice(["X", "X", "X", "END"]), "ack": rng.random() < 0.1, "admin": rng.random() < 0.1, "family": rng.choice("XY"), "anchor": anchor, "asked_by": "interviewer" if anchor else None}
        rows.append(row | {"members": [{f: row[f] for f in ("pos", "id", "speaker", "text", "role_confidence", "start", "end")}] if anchor else None})
    monkeypatch.setattr(prompts, "with_anchors", lambda x: x)
    monkeypatch.setattr(prompts, "with_spans", lambda x: x)
    got = prompts.prompts_with_answers(spark.createDataFrame(rows, SPANNED)).orderBy("prompt_no").collect()

    spans = []
    for r in rows:
        if r["anchor"]:
            if spans and spans[-1]["family"] == r["family"] and r["start"] <= spans[-1]["end"] + 0.5:
                spans[-1]["end"] = max(spans[-1]["end"], r["end"])
                spans[-1]["ids"].append(r["id"])
            else:
                spans.append({"start": r["start"], "end": r["end"], "family": r["family"], "ids": [r["id"]]})
    assert [(p["start"], p["end"], p["segment_ids"]) for p in got] == [(p["start"], p["end"], p["ids"]) for p in spans]
    twice = set()
    for k, (p, g) in enumerate(zip(spans, got, strict=True)):
        until = spans[k + 1]["start"] if k + 1 < len(spans) else math.inf
        held = [r for r in rows if r["valid"] and r["phase"] != "END" and not r["ack"] and not r["admin"] and r["id"] not in p["ids"] and p["end"] <= r["start"] < until]
        assert (g["answer"]["segment_ids"] if g["answer"] else []) == [r["id"] for r in held]
        if held:
            assert (g["answer"]["start"], g["answer"]["end"], g["answer"]["text"]) == (held[0]["start"], held[-1]["end"], "".join(r["text"] for r in held))
        twice |= {r["id"] for r in held for j, q in enumerate(spans) if j != k and q["end"] <= r["start"] < (spans[j + 1]["start"] if j + 1 < len(spans) else math.inf)}
    assert twice  # some segments answer several prompts
