"""The question tree of a conversation, its flat list, and the first-version question list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import lexicon as X
from dialoom.functions.folds import folded
from dialoom.functions import text as T
from dialoom.operators.phases import by_conv
from dialoom.operators.roles import v1_turns, with_v1_roles

IDS = "array<string>"


def question_tree(prompts: DataFrame, topics: dict[str, list[str]] | None = None, age: float = 240.0, short: int = 16) -> DataFrame:
    """Prompts as nodes: adds root_no, child_no (0: a root), node_id, parent_id, node_type,
    relation_to_previous and topic.

    A prompt opens a root or joins the open one, as its own text says and as the root's asker,
    family, topic, age and children do: those five are the state that is folded."""
    t = F.col("text")
    told = prompts.withColumns({"topic": T.topic(t, topics), "n": T.meaningful_count(t)})
    told = told.withColumn(
        "own",
        F.when(T.matches(t, X.NEW_TOPIC), "main_question").when(T.matches(t, X.CLARIFICATION), "clarification").when(T.matches(t, X.FOLLOW_UP) | (F.col("n") <= short), "follow_up"),
    )
    told = told.withColumn("imperative", T.matches(t, X.IMPERATIVE_START)).drop("n")
    kept = [c for c in told.columns if c not in ("conv_id", "prompt_no", "own", "imperative")]
    talks = told.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("prompt_no", F.struct("asked_by", "family", "topic.label", "start", "own", "imperative").alias("e"), F.struct(*kept).alias("r")))).alias("rows"))
    place = "root_no int, child_no int, node_type string, relation string"
    begin = F.struct(
        F.lit(0).alias("root"), F.lit(0).alias("children"), F.lit("").alias("asked_by"), F.lit("").alias("family"), F.lit("").alias("label"), F.lit(0.0).alias("start"), F.array().cast(f"array<struct<{place.replace(' ', ':').replace(',:', ',')}>>").alias("out"),
    )

    def step(root: Column, row: Column) -> Column:
        e = row["e"]
        elsewhere = (e["asked_by"] != root["asked_by"]) | (e["family"] != root["family"])
        strays = (root["label"] != X.UNCLASSIFIED) & (e["label"] != X.UNCLASSIFIED) & (root["label"] != e["label"])
        strays = strays | (e["start"] - root["start"] >= age) | (e["imperative"] & (root["children"] > 0))
        kind = F.when((root["root"] == 0) | elsewhere, "main_question").when(e["own"].isNotNull(), e["own"]).when(strays, "main_question").otherwise("follow_up")

        def placed(kind: Column) -> Column:
            opens = kind == "main_question"
            no, child = root["root"] + F.when(opens, 1).otherwise(0), F.when(opens, 0).otherwise(root["children"] + 1)
            relation = F.when(root["root"] == 0, "first_question").when(opens, "topic_switch").otherwise("same_topic")
            now = lambda field: F.when(opens, e[field]).otherwise(root[field]).alias(field)
            found = F.struct(no.alias("root_no"), child.alias("child_no"), kind.alias("node_type"), relation.alias("relation"))
            return F.struct(no.alias("root"), child.alias("children"), now("asked_by"), now("family"), now("label"), now("start"), F.array_append(root["out"], found).alias("out"))

        return F.transform(F.array(kind), placed)[0]

    talks = talks.withColumn("found", folded("rows", begin, step))
    each = talks.select("conv_id", F.explode(F.transform("rows", lambda row, k: F.struct(row["prompt_no"].alias("prompt_no"), row["r"].alias("r"), F.get(F.col("found"), k).alias("f")))).alias("p"))
    root = F.concat(F.lit("Q"), F.col("p.f.root_no"))
    child = F.col("p.f.child_no")
    return each.select(
        "conv_id", "p.prompt_no", "p.f.root_no", "p.f.child_no", F.when(child == 0, root).otherwise(F.concat_ws(".", root, child)).alias("node_id"), F.when(child > 0, root).alias("parent_id"),
        "p.f.node_type", F.col("p.f.relation").alias("relation_to_previous"), "p.r.*",
    )


def flat_questions(tree: DataFrame) -> DataFrame:
    """A row per root: id, root_question_id, its question, follow-ups, candidates' answers, all
    segment ids in order of first mention, topic, relation."""
    answer = F.when(F.col("answer.role") == "candidate", F.struct(F.col("node_id").alias("for_question"), F.col("answer.segment_ids").alias("segment_ids"), F.col("answer.text").alias("text")))
    node = F.struct("child_no", "node_id", "node_type", "segment_ids", "text", answer.alias("answer"), F.coalesce("answer.segment_ids", F.array().cast(IDS)).alias("answer_ids"), "topic", "relation_to_previous")
    rows = tree.groupBy("conv_id", "root_no").agg(F.array_sort(F.collect_list(node)).alias("n"))
    follow = F.transform(F.filter("n", lambda x: x["child_no"] > 0), lambda x: F.struct(x["node_id"].alias("id"), x["node_type"].alias("type"), x["segment_ids"].alias("segment_ids"), x["text"].alias("text")))
    return rows.select(
        "conv_id", F.format_string("qa_v2_%03d", "root_no").alias("id"), F.col("n")[0]["node_id"].alias("root_question_id"),
        F.struct(F.col("n")[0]["segment_ids"].alias("segment_ids"), F.col("n")[0]["text"].alias("text")).alias("main_question"), follow.alias("follow_ups"),
        F.array_compact(F.transform("n", lambda x: x["answer"])).alias("candidate_answers"),
        F.array_distinct(F.flatten(F.transform("n", lambda x: F.concat(x["segment_ids"], x["answer_ids"])))).alias("segment_ids"),
        F.col("n")[0]["topic"].alias("topic"), F.col("n")[0]["relation_to_previous"].alias("relation_to_previous"),
    )


def evidence(tree: DataFrame) -> DataFrame:
    """conv_id, node_id, evidence: segments that a claim about the node may cite, sorted."""
    return tree.select("conv_id", "node_id", F.array_sort(F.array_union("segment_ids", F.coalesce("answer.segment_ids", F.array().cast(IDS)))).alias("evidence"))


def v1_questions(cleaned: DataFrame, similar: float = 0.25, topics: dict[str, list[str]] | None = None) -> DataFrame:
    """The first version's list: conv_id, id, main_question, follow_ups, candidate_answers,
    segment_ids, topic (label, keywords, relation_to_previous).

    Turns of the elected interviewer open an item or continue it; the candidate's answer the
    prompt before them.  Whether a turn continues depends on the topic of all that the item has
    asked so far, so that text is folded; item and prompt numbers, once known, are grouped."""
    turns = v1_turns(with_v1_roles(cleaned)).withColumn("text", T.stripped(F.col("text")))
    t = F.col("text")
    asks = (F.col("role") == "interviewer") & ~t.isin(*X.ACKNOWLEDGEMENTS)
    new = lambda cues: F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(t, c))
    follows = F.exists(F.array(*[F.lit(c) for c in X.V1_FOLLOW_UPS]), lambda c: F.startswith(t, c))
    turns = turns.withColumns({"asks": asks, "switches": new(X.V1_NEW_TOPICS), "follows": follows, "topic": T.topic(t, topics)}).filter("asks or role = 'candidate'")
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "asks", "switches", "follows", "topic", "text", "segment_ids"))).alias("rows"))
    low = lambda words: F.transform(words, F.lower)
    begin = F.struct(F.lit(0).alias("item"), F.lit(0).alias("prompt"), F.lit("").alias("asked"), F.array().cast("array<struct<item:int,prompt:int>>").alias("out"))

    def step(now: Column, row: Column) -> Column:
        def like(old: Column) -> Column:
            left, right = low(old["keywords"]), low(row["topic"]["keywords"])
            same = (old["label"] != X.UNCLASSIFIED) & (old["label"] == row["topic"]["label"])
            return same | (T.keyword_similarity(left, right) >= similar)

        # The topic of what was asked is looked for only where it decides: a turn without keywords is like none.
        first, bare = (now["item"] == 0) | row["switches"], (F.size(row["topic"]["keywords"]) == 0) & F.lit(similar > 0)
        decided = F.when(first, False).when(row["follows"], True).when(bare, False).otherwise(F.transform(F.array(T.topic(now["asked"], topics)), like)[0])

        def asked(goes_on: Column) -> Column:
            text = F.when(goes_on, F.concat_ws(" ", now["asked"], row["text"])).otherwise(row["text"])
            item, prompt = now["item"] + F.when(goes_on, 0).otherwise(1), F.when(goes_on, now["prompt"] + 1).otherwise(0)
            return F.struct(item.alias("item"), prompt.alias("prompt"), text.alias("asked"), F.array_append(now["out"], F.struct(item.alias("item"), prompt.alias("prompt"))).alias("out"))

        told = F.struct(now["item"].alias("item"), now["prompt"].alias("prompt"), now["asked"].alias("asked"), F.array_append(now["out"], F.struct(now["item"].alias("item"), now["prompt"].alias("prompt"))).alias("out"))
        return F.when(row["asks"], F.transform(F.array(decided), asked)[0]).otherwise(told)

    talks = talks.withColumn("found", folded("rows", begin, step))
    each = talks.select("conv_id", F.explode(F.transform("rows", lambda row, k: F.struct(F.get(F.col("found"), k).alias("f"), row.alias("r")))).alias("p"))
    each = each.select("conv_id", F.col("p.f.item").alias("item"), F.col("p.f.prompt").alias("prompt"), "p.r.*").filter("item > 0")
    # Turns to prompts, with the text asked and the answers joined; prompts to items.
    part = lambda asking: F.filter("m", lambda x: x["asks"] == asking)
    ids = lambda rows: F.flatten(F.transform(rows, lambda x: x["segment_ids"]))
    spoken = lambda rows: F.array_join(F.transform(rows, lambda x: x["text"]), " ")
    prompts = each.groupBy("conv_id", "item", "prompt").agg(F.array_sort(F.collect_list(F.struct("turn_no", "asks", "text", "segment_ids"))).alias("m"))
    name = F.when(F.col("prompt") == 0, "main").otherwise(F.concat(F.lit("follow_up_"), F.col("prompt")))
    answer = F.when(F.size(part(False)) > 0, F.struct(name.alias("for_question"), ids(part(False)).alias("segment_ids"), spoken(part(False)).alias("text")))
    prompts = prompts.select("conv_id", "item", F.struct("prompt", F.struct(name.alias("id"), ids(part(True)).alias("segment_ids"), spoken(part(True)).alias("text")).alias("q"), answer.alias("answer"), ids(F.col("m")).alias("ids")).alias("x"))
    items = prompts.groupBy("conv_id", "item").agg(F.array_sort(F.collect_list("x")).alias("x"))
    items = items.withColumn("topic", T.topic(F.array_join(F.transform("x", lambda x: x["q"]["text"]), " "), topics))
    before = F.lag("topic").over(by_conv().orderBy("item"))
    shared = F.arrays_overlap(low(F.col("topic.keywords")), low(before["keywords"])) | ((F.col("topic.label") != X.UNCLASSIFIED) & (F.col("topic.label") == before["label"]))
    relation = F.when(F.col("item") == 1, "first_topic").when(shared, "same_topic").otherwise("new_or_unknown_topic")
    items = items.withColumn("relation", relation)
    follow_ups = F.transform(F.filter("x", lambda x: x["prompt"] > 0), lambda x: x["q"])
    return items.select(
        "conv_id", F.format_string("qa_%03d", "item").alias("id"), F.struct(F.col("x")[0]["q"]["segment_ids"].alias("segment_ids"), F.col("x")[0]["q"]["text"].alias("text")).alias("main_question"), follow_ups.alias("follow_ups"),
        F.array_compact(F.transform("x", lambda x: x["answer"])).alias("candidate_answers"), F.flatten(F.transform("x", lambda x: x["ids"])).alias("segment_ids"),
        F.struct("topic.label", "topic.keywords", F.col("relation").alias("relation_to_previous")).alias("topic"),
    )
