r"""Operator 10: chat formatting in budgeted windows.

Prefix sums of turn tokens give each turn its window.  What the budget leaves beside the
conversation's system turn and the history is a cell; turns that lie wholly within a cell of
the prefix sums are one window, and a turn that crosses cells is one alone.  A later window
opens with the system turn, repeats earlier turns that begin within ``history`` tokens of its
first turn, as far as the budget allows, and then holds its own turns.  So a window exceeds
the budget only where one own turn and the system turn do.  Repeated turns are marked and
carry no loss, so each assistant text is a target once.

Format: ``<turn ROLE<text>TEXT</turn>\n``, with ``<again `` for repeated turns.  In roles
and texts ``\`` becomes ``\b`` and ``<`` becomes ``\l``: no control string can occur inside
a text, and unescaping is exact.  Loss spans are [start, length] in code points.

DataFrame code only; a window's size is bounded by the budget and its longest turn.  A
conversation's digests need its whole text in one row, so one conversation is one task's work.
Edge cases: null text or role is empty; a null conv_id is a conversation; turns sort by
turn, role and text, so ties and repeated rows stay, side by side; a very long turn is a
window alone, whole; extra columns are never read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.llm.common import WORD, materialize

BUDGET, HISTORY, PER_TURN = 512, 128, 4
OPEN, AGAIN, TEXT, CLOSE = "<turn ", "<again ", "<text>", "</turn>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, loss): formatted training windows with their loss spans."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    by_conv = W.partitionBy("conv_id").orderBy(*order)
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + PER_TURN)
    turns = turns.withColumn("n", F.row_number().over(by_conv)).withColumn("at", F.coalesce(F.sum("tokens").over(by_conv.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    whole = W.partitionBy("conv_id")
    system = F.min(F.when(F.col("role") == "system", F.struct("n", "text", "tokens"))).over(whole)
    turns = turns.withColumn("system", system).withColumn("fixed", F.coalesce("system.tokens", F.lit(0)))
    cell = F.greatest(budget - history - F.col("fixed"), F.lit(1))
    turns = turns.withColumn("cell", F.floor(F.col("at") / cell)).withColumn("crosses", F.col("cell") < F.floor((F.col("at") + F.col("tokens") - 1) / cell))
    turns = turns.withColumn("window", 2 * F.col("cell") + F.col("crosses").cast("long"))
    mine = W.partitionBy("conv_id", "window")
    turns = turns.withColumns({"begin": F.min("at").over(mine), "own": F.sum("tokens").over(mine), "system_window": F.first(F.when(F.col("n") == F.col("system.n"), F.col("window")), ignorenulls=True).over(whole)})
    # Each window's first turn offers room for what comes before it; earlier turns find it in a range of places.
    room = F.least(F.lit(history).cast("long"), budget - F.col("own") - F.when(F.col("window") > F.col("system_window"), F.col("fixed")).otherwise(0))
    offer = F.when((F.col("at") == F.col("begin")) & (room > 0), F.struct("window", "begin", room.alias("room")))
    later = F.collect_list(offer).over(W.partitionBy("conv_id").orderBy("at").rangeBetween(1, history))
    repeats = F.filter(later, lambda x: (x["window"] > F.col("window")) & (x["begin"] - F.col("at") <= x["room"]) & (F.col("role") != "system"))
    turns = turns.withColumn("repeats", F.transform(repeats, lambda x: F.struct(x["window"].alias("w"), F.lit(1).alias("part"))))
    homes = F.concat(F.array(F.struct(F.col("window").alias("w"), F.lit(2).alias("part"))), "repeats")
    spread = turns.select("conv_id", F.explode(homes).alias("home"), "n", "role", "text").select("conv_id", F.col("home.w").alias("window"), F.col("home.part").alias("part"), "n", "role", "text")
    # The system turn opens every later window too.
    opened = turns.filter((F.col("at") == F.col("begin")) & (F.col("window") > F.col("system_window")))
    system = opened.select("conv_id", "window", F.lit(0).alias("part"), F.col("system.n").alias("n"), F.lit("system").alias("role"), F.col("system.text").alias("text"))
    lines = spread.unionByName(system)
    again = F.col("part") < 2
    head = F.concat(F.when(again, F.lit(AGAIN)).otherwise(F.lit(OPEN)), escaped(F.col("role")), F.lit(TEXT))
    body = escaped(F.col("text"))
    target = ~again & (F.col("role") == "assistant")
    lines = lines.select(
        "conv_id", "window", F.struct("part", "n", F.concat(head, body, F.lit(CLOSE)).alias("line"), F.length(head).alias("head"), F.length(body).alias("body"), target.alias("target")).alias("x")
    )
    rows = lines.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("x")).alias("x"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans"))

    def take(acc: Column, x: Column) -> Column:
        span = F.when(x["target"], F.array(F.array(acc["at"] + x["head"], x["body"]))).otherwise(F.array().cast("array<array<int>>"))
        return F.struct((acc["at"] + F.length(x["line"])).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    return rows.select("conv_id", "window", F.array_join(F.transform("x", lambda x: x["line"]), "").alias("formatted"), F.aggregate("x", begin, take)["spans"].alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Read formatted windows back: a row per conversation with its turns' digest, its loss text's
    length and digest, and its formatted length."""
    parts = F.filter(F.split("formatted", CLOSE, -1), lambda p: F.startswith(p, F.lit(OPEN)))
    bare = F.transform(parts, lambda p: F.substring(F.element_at(F.split(p, TEXT, 2), 1), len(OPEN) + 1, 1 << 30))
    texts = F.transform(parts, lambda p: F.element_at(F.split(p, TEXT, 2), 2))
    turn = F.zip_with(bare, texts, lambda r, t: F.concat(unescaped(r), F.lit("\n"), unescaped(t), F.lit("\n")))
    loss = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s[0] + 1, s[1])))
    each = windows.select("conv_id", "window", F.size(parts).alias("n"), F.array_join(turn, "").alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").alias("chars"))
    whole = each.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.count("*").cast("long").alias("n_windows"),
    )
    turns = F.array_join(F.transform("w", lambda x: x["turns"]), "")
    text = F.array_join(F.transform("w", lambda x: x["loss_text"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def format_and_read(conversations: DataFrame, **options) -> DataFrame:
    """Format, write, read back."""
    return read_windows(materialize(format_windows(conversations, **options), "chat-windows"))
