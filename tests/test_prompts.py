"""Spans of prompts where starts go back: equal to a plain walk, and in linear time."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from dialoom.operators import prompts

ROWS = "conv_id bigint, idx bigint, pos bigint, id string, start double, end double, speaker string, text string, role string, role_confidence double, valid boolean, family string, response boolean, marked boolean, anchor boolean, asked_by string"


def plain_members(rows, k, longest=8.0, gap=1.2, back_gap=0.8):
    a, out = rows[k], [rows[k]]
    b = rows[k - 1] if k else None
    if b and b["valid"] and not b["anchor"] and b["family"] == a["family"] and a["start"] - b["end"] <= back_gap and b["role"] == a["asked_by"] and not b["response"]:
        out.insert(0, b)
    if not a["marked"]:
        for p, x in zip(rows[k:], rows[k + 1 :], strict=False):
            other = x["role"] != a["asked_by"] and x["role_confidence"] >= 0.6 and x["speaker"] != a["speaker"]
            if x["anchor"] or not x["valid"] or x["family"] != a["family"] or x["start"] - p["end"] > gap or x["end"] - a["start"] > longest or x["response"] or other:
                break
            out.append(x)
            if x["marked"]:
                break
    return [x["id"] for x in out]


def talk(rng, n):
    rows, at = [], 0.0
    for k in range(n):
        at += rng.choice([0.0, 0.5, 1.0, 1.0, 4.0])
        anchor = rng.random() < 0.3
        role = rng.choice(["interviewer", "candidate", "unknown"])
        rows.append({
            "conv_id": 1, "idx": k + 1, "pos": k + 1, "id": f"s{k}", "start": at, "end": at + rng.choice([0.4, 1.0, 3.0]), "speaker": rng.choice("ab"), "text": "t", "role": role, "role_confidence": rng.choice([0.5, 0.7]),
            "valid": rng.random() < 0.9, "family": rng.choice(["X", "X", "X", "Y"]), "response": rng.random() < 0.1, "marked": rng.random() < 0.2, "anchor": anchor, "asked_by": rng.choice(["interviewer", "candidate"]) if anchor else None,
        })
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_a_plain_walk(spark, seed):
    """In order of starts, and with one early row of a very late start before it all."""
    rows = talk(random.Random(seed), 400)
    late = [dict(rows[0], start=1e6, end=1e6 + 1, anchor=False, asked_by=None), *[dict(r, pos=r["pos"] + 1, idx=r["idx"] + 1) for r in rows]]
    for given in (rows, late):
        got = {r["pos"]: [m["id"] for m in r["members"]] for r in prompts.with_spans(spark.createDataFrame(given, ROWS)).filter("anchor").collect()}
        want = {r["pos"]: plain_members(given, k) for k, r in enumerate(given) if r["anchor"]}
        assert got == want and max(map(len, want.values())) > 2


def test_an_early_row_of_late_start_costs_no_more(spark):
    n = 60_000
    at = F.when(F.col("k") == 0, 1e6).otherwise(F.col("k") * 1.0)
    df = spark.range(n).withColumnRenamed("id", "k").select(
        F.lit(1).cast("bigint").alias("conv_id"), (F.col("k") + 1).alias("idx"), (F.col("k") + 1).alias("pos"), F.concat(F.lit("s"), "k").alias("id"), at.alias("start"), (at + 0.9).alias("end"), F.lit("a").alias("speaker"), F.lit("t").alias("text"),
        F.lit("interviewer").alias("role"), F.lit(0.9).alias("role_confidence"), F.lit(True).alias("valid"), F.lit("X").alias("family"), F.lit(False).alias("response"), F.lit(False).alias("marked"), (F.col("k") % 9 == 3).alias("anchor"),
        F.when(F.col("k") % 9 == 3, "interviewer").alias("asked_by"),
    )
    began = time.time()
    sizes = prompts.with_spans(df).filter("anchor").groupBy(F.size("members").alias("n")).count().collect()
    assert sum(r["count"] for r in sizes) == len(range(3, n, 9)) and max(r["n"] for r in sizes) >= 8 and time.time() - began < 30
