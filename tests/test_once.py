"""Costly expressions of a text or a file stand in the plan once, whoever reads them."""

from pyspark.sql import functions as F

from dialoom.functions import lexicon as X
from dialoom.functions import text as T
from dialoom.plans import registry
from dialoom.sources import files
from dialoom.sources import segments as S

TEXTS = ["", "Redis 和 mysql 的事务", "b+ 树 与 KAFKA，RPC", "用 GoLang 写 http 服务", "普通的话", "Java java 线程", None]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def told(text, topics):
    best = (0, "", [])
    for label, words in topics.items():
        hits = [w for w in words if w.lower() in (text or "").lower()]
        best = (len(hits), label, hits) if len(hits) > best[0] else best
    return (best[1] or X.UNCLASSIFIED, best[2])


def test_a_topic_lowers_its_text_once(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for topics in (X.TOPICS, {"none": [], "one": ["JAVA", "普通"]}):
        out = rows.select("text", T.topic(F.col("text"), topics).alias("t"))
        assert plan_of(out).count("lower(") == 1
        assert [(r.t.label, r.t.keywords) for r in out.collect()] == [told(t, topics) for t in TEXTS]


def test_spellings_are_passed_by_where_there_are_none(spark):
    texts = ["redis 和 RED IS", "瑞迪斯 ，b+树", "普通 的 话 。", "redisx xredis", "c  plus plus", "b 加树", ""]
    want = ["Redis 和 Redis", "Redis，B+ 树", "普通 的 话。", "redisx xredis", "C++", "B+ 树", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    out = rows.select(T.normalize_text(F.col("text")).alias("x"))
    assert "\\Qredis\\E|" in plan_of(out)
    assert [r.x for r in out.collect()] == want
    own = rows.select(T.normalize_text(F.col("text"), {"普通": "", "A": "b"}).alias("x"))
    assert [r.x for r in own.collect()][2] == "的 话。"


def test_a_raw_file_is_parsed_and_spelt_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"result": [[{"text": "", "sentence_info": [{"text": "redis ，好", "start": 1, "end": 2, "spk": 0}, {"text": " ", "start": 2, "end": 3}]}]]}')
    (tmp_path / "b.json").write_text('{"result": ')
    out = S.from_raw(files.raw_results(files.read_documents(spark, str(tmp_path))))
    plan = plan_of(out)
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 2  # the file, and the null of empty lists
    assert plan.count("\\Qpostgresql\\E(?![") == 1
    assert [(r.idx, r.text) for r in out.collect()] == [(1, "Redis，好")]


def test_segments_are_cleaned_where_they_are_dealt(spark, sf_dir):
    """Above the exchange, whose tasks grow with the rows, and below the numbering, which keeps each expression single."""
    plan = plan_of(registry.cleaned_segments(spark, sf_dir)).splitlines()
    at = lambda word: [i for i, line in enumerate(plan) if word in line]
    (dealt,), numbered = at("RepartitionByExpression"), at("Window")
    cleaned = at("介绍")
    assert cleaned and max(i for i in cleaned if "RLIKE" in plan[i]) < dealt
    assert min(i for i in cleaned if "RLIKE" in plan[i]) > numbered[0]
