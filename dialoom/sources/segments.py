"""Segments of conversations: derived from ``events``, or read from recogniser output.

Every table is keyed by (conv_id, idx); ``idx`` is the source order and is never replaced by time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import text as T

# The utterances that events stand for, by number.
POOL = [
    ("A", "请你介绍一下项目？"), ("B", "我负责系统设计和性能优化，最后把延迟降低了一半。"), ("A", "那为什么选择这个方案？"), ("B", "因为读流量很大，我们当时比较了三种方案。"),
    ("A", "下一个问题，Redis 的持久化机制有什么区别？"), ("B", "RDB 是快照，AOF 是日志，我会先看数据量。"), ("A", "你是说只更新变化的索引吗？"), ("B", "对，不需要全量重建。"),
    ("A", "下面开始做题，代码用 Python。"), ("A", "复杂度呢？"), ("B", "时间复杂度是线性的，边界我会单独处理。"), ("A", "你遇到的最大的困难是什么？"),
    ("B", "首先我会先和团队沟通，然后我把方案拆成三步，主要是先保证核心链路稳定，再逐步优化缓存和索引，最后补齐监控。"), ("B", "我想问一下这个岗位具体做什么？"),
    ("A", "主要负责搜索系统，团队方向是大模型推理。"), ("A", "今天面试先到这里，拜拜。"), ("B", "嗯。"), ("A", "能听到吗？"), ("B", "。，，。"), ("B", "哒哒哒哒哒哒哒哒哒"),
    ("B", "小问题"), ("B", "比如说分布式事务。"), ("B", "邮箱 a.b@example.com 手机 13800138000 地址 10.0.0.1 password=abc"), ("A", "我们采用 kafka 和 redis ， 用 http 与 https 通信。"),
]

#: rows of a task, at least and at most, in the operators of conversations
LEAST_ROWS, MOST_ROWS = 2_000, 32_000

#: raw documents as columns, as ``from_raw`` takes them
RAW = "conv_id bigint, result array<struct<text:string,timestamp:array<array<bigint>>,sentence_info:array<struct<text:string,start:bigint,end:bigint,spk:int,timestamp:array<array<bigint>>>>>>"


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that ``events`` describe, not yet numbered: conv_id, ts, event_id, start, end, speaker, text.

    The pool is an indexed literal, so this is a map over the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 6000000")
    length = F.floor(F.col("value") * F.when(F.col("event_type") == "error", 120).otherwise(40)).cast("long")
    k = ((F.col("event_id") * 7 + F.col("user_id") * 3) % len(POOL) + 1).cast("int")
    pool = F.array(*[F.struct(F.lit(s).alias("spk"), F.lit(t).alias("text")) for s, t in POOL])
    e = e.withColumns({"start_ms": ms, "dur_ms": length, "p": F.element_at(pool, k)})
    same = (F.col("p.spk") == "A") == (F.col("event_id") % 11 != 0)
    speaker = F.when(F.col("event_id") % 37 == 0, "speaker_unknown").when(same, "speaker_0").otherwise("speaker_1")
    rows = e.select(F.col("user_id").alias("conv_id"), "ts", "event_id", "start_ms", "dur_ms", speaker.alias("speaker"), F.col("p.text").alias("text"))
    return rows.selectExpr("conv_id", "ts", "event_id", "start_ms / 1000D AS start", "(start_ms + dur_ms) / 1000D AS end", "speaker", "text")


def partitions_for(rows: DataFrame) -> int:
    """Into how many partitions ``rows`` go, so that a task's share stays the same however many rows there are;
    few rows give each core two. The count reads no column of a Parquet table."""
    n = rows.count()
    share = min(max(n // (2 * rows.sparkSession.sparkContext.defaultParallelism), LEAST_ROWS), MOST_ROWS)
    return max(1, -(-n // share))


def by_conversation(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt by conv_id. A given number of partitions is not merged again by their compressed size, which
    says little of the memory that their rows take: segments compress to some hundredth of that."""
    return rows.repartition(partitions or partitions_for(rows), "conv_id")


def numbered(rows: DataFrame, made: Callable[[DataFrame], DataFrame] = lambda dealt: dealt, partitions: int | None = None) -> DataFrame:
    """Adds idx and id in order of time: the one exchange of a conversation's operators.

    ``made`` is a map over the rows, applied once they are dealt and before they are numbered: in as many tasks
    as the rows need, where a scan of well compressed files has few."""
    dealt = made(by_conversation(rows, partitions))
    others = [c for c in dealt.columns if c not in ("ts", "event_id")]
    out = dealt.selectExpr(*others, "row_number() OVER (PARTITION BY conv_id ORDER BY ts, event_id) AS idx")
    return out.withColumn("id", F.format_string("seg_%04d", "idx"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, start, end, speaker, text, idx, id of the interviews that ``events`` describe."""
    return numbered(event_rows(spark, sf_dir))


def speaker_name(raw) -> object:
    label = F.trim(raw.cast("string"))
    return F.when(label.isNull() | (label == ""), "speaker_unknown").when(label.startswith("speaker_"), label).otherwise(F.concat(F.lit("speaker_"), label))


def from_raw(raw: DataFrame, replacements: dict[str, str] | None = None) -> DataFrame:
    """Sentences of the first result (``files.raw_results``) as segments; ids count source sentences,
    blanks leave holes.  A result without sentences is one segment of its whole text."""
    r, kinds = F.col("result")[0], raw.schema["result"].dataType.elementType["sentence_info"].dataType.elementType
    whole = F.array(F.struct(r["text"].alias("text"), *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in ("start", "end", "spk")], r["timestamp"].alias("timestamp")))
    info = F.when(F.size(r["sentence_info"]) > 0, r["sentence_info"]).otherwise(whole)
    rows = raw.filter(F.size("result") > 0).select("conv_id", r["timestamp"].alias("ts"), F.posexplode(info).alias("pos", "s"))
    spans = F.coalesce(F.when(F.size("s.timestamp") > 0, F.col("s.timestamp")), F.when(F.size("ts") > 0, F.col("ts")))
    start = F.coalesce(F.col("s.start"), spans[0][0], F.lit(0)) / F.lit(1000.0)
    end = F.coalesce(F.col("s.end"), F.element_at(F.element_at(spans, -1), -1), F.lit(0)) / F.lit(1000.0)
    out = rows.select("conv_id", (F.col("pos") + 1).alias("idx"), F.format_string("seg_%04d", F.col("pos") + 1).alias("id"), F.round(start, 3).alias("start"), F.round(F.greatest(start, end), 3).alias("end"), speaker_name(F.col("s.spk")).alias("speaker"), F.explode(F.array(T.normalize_text(F.coalesce("s.text", F.lit("")), replacements))).alias("text"))
    return out.filter("text <> ''")  # on the exploded text: the chain of spellings is not repeated for the filter
