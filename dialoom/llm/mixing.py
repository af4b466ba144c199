"""Operator 1: mix sources to target weights.

Words of each source form one stream, cut into blocks of ``block_words``.  Output
shards of ``shard_slots`` slots draw multinomial counts over sources (each slot an
independent draw); the last shards take what each source still owes, so a source ends
within a block and a half of its target: half by rounding, one since its last block is short.  A source's slots run through a keyed pseudorandom
permutation of its block indexes (swap-or-not rounds), and blocks join slots by
(source, index).  Everything is DataFrame code; prefix sums are bucketed, so a source
that holds a third of all rows is spread like any other.

Edge cases: null text has size 0; null source is a source of its own, last in order;
a source without words has target 0; repeated rows are separate documents; ties in the order
of a source's stream (one doc_id and size) are equal for all that is returned; a very long
text spans many blocks; extra columns are never read, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.llm.common import WORD, join_bounded, materialize, only, running_offsets, text_of, words_of

CELLS = 1024
#: slots that one task maps through a permutation, about
RUN_SLOTS = 50_000
ROUNDS = 16


@dataclass
class Mix:
    """docs: one row per document with its place in its source's stream; sources: targets and
    slot counts; slots: (shard, skey, j, block), written: what each shard drew; draws: from the
    slots, times each block is drawn and the first and last shard that holds it."""

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame
    draws: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """A row per document and block with the times it is drawn; a document without words
        has one row of no words."""
        size, at, n = F.col("size"), F.col("at"), F.lit(self.block_words)
        cut = self.docs.withColumn(
            "block",
            F.explode(F.when(size > 0, F.sequence(F.floor(at / n), F.floor((at + size - 1) / n))).otherwise(F.array(F.lit(-1).cast("long")))),
        )
        start = F.greatest(F.col("block") * n, at)
        end = F.least((F.col("block") + 1) * n, at + size)
        cut = cut.withColumn("word_start", F.when(size > 0, start - at).otherwise(0)).withColumn("words", F.when(size > 0, end - start).otherwise(0))
        # Sizes of exploded rows are underestimated; draws grow with the corpus and must not be broadcast.
        return cut.join(self.draws.hint("merge"), ["skey", "block"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))


def source_key(name: str = "source") -> Column:
    """Not null; its binary order is code-point order with null last."""
    return F.when(F.col(name).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(name)))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Targets of (skey, source_size): 100% of all words by cycled weights, none above ``cap``
    times its source, the excess reshared by weight.  One row per source throughout."""
    everything = W.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy("skey")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int") + 1))
    level = ranked.withColumn("most", F.col("source_size") * cap).withColumn("full_at", F.col("most") / F.col("weight"))
    by_level = W.orderBy("full_at", "rank")
    level = (
        level.withColumn("pos", F.row_number().over(by_level))
        .withColumn("taken", F.coalesce(F.sum("most").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("rate", (F.sum("source_size").over(everything) - F.col("taken")) / F.col("open_weight"))
    )
    first_open = F.min(F.when(F.col("rate") < F.col("full_at"), F.struct("pos", "rate"))).over(everything)
    return level.withColumn("open", first_open).select(
        "skey", "source_size", F.coalesce(F.least(F.col("most"), F.col("open.rate") * F.col("weight")), F.col("most")).alias("target")
    )


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Place of index ``x`` in a pseudorandom permutation of 0..n-1 given by ``key``."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        return F.when(F.xxhash64(key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    block_words: int = 128,
    shard_slots: int = 4096,
    drawn_share: float = 0.75,
    seed: int = 20,
    fingerprint: bool = False,
) -> Mix:
    """Plan the mix of ``docs`` (doc_id, source, text).  ``fingerprint`` adds a row hash ``print``."""
    spark = docs.sparkSession
    own = only(docs, *dict.fromkeys(["doc_id", "source", "text", *(docs.columns if fingerprint else [])]))
    sized = own.select(
        "doc_id",
        source_key().alias("skey"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        *([row_print(docs.columns).alias("print")] if fingerprint else []),
    )
    sized = materialize(sized, "mix-sizes")
    totals = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    sources = (
        source_targets(totals, weights, cap)
        .withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
        .withColumn("n_slots", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")), cap * F.col("n_blocks"))).otherwise(0).cast("long"))
    )
    by_key = W.orderBy("skey").rowsBetween(W.unboundedPreceding, -1)
    sources = sources.withColumn("slots_before", F.coalesce(F.sum("n_slots").over(by_key), F.lit(0)))
    sources = materialize(sources, "mix-sources")
    n_slots = sources.agg(F.sum("n_slots")).first()[0] or 0

    # Drawn shards: every slot picks a source; a grid over [0, 1) turns the search into an equi-join.
    n_drawn = int(n_slots * drawn_share)
    lo, hi = F.col("slots_before") / max(n_slots, 1), (F.col("slots_before") + F.col("n_slots")) / max(n_slots, 1)
    grid = sources.filter("n_slots > 0").select("skey", lo.alias("lo"), hi.alias("hi"))
    grid = grid.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    grid = materialize(grid, "mix-grid")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52)) / float(1 << 52)
    drawn = spark.range(n_drawn).select(F.floor(F.col("id") / shard_slots).alias("shard"), u.alias("u"))
    drawn = join_bounded(drawn.withColumn("cell", F.floor(F.col("u") * CELLS)), grid, ["cell"]).filter("u >= lo and u < hi")
    counts = materialize(drawn.groupBy("shard", "skey").agg(F.count("*").alias("n")), "mix-counts")
    counts = running_offsets(counts, ["skey"], ["shard"], "n", "first")
    limits = sources.select("skey", "n_slots", "n_blocks")
    counts = join_bounded(counts, limits, ["skey"]).withColumn("n", F.least(F.col("n"), F.col("n_slots") - F.col("first"))).filter("n > 0")
    counts = materialize(counts.select("shard", "skey", "first", "n", "n_blocks"), "mix-drawn")

    # What each source still owes, in further shards.
    owed = sources.join(counts.groupBy("skey").agg(F.sum("n").alias("n_taken")), "skey", "left")
    owed = owed.withColumn("first", F.coalesce("n_taken", F.lit(0))).withColumn("n", F.col("n_slots") - F.col("first")).filter("n > 0")
    owed = owed.withColumn("before", F.coalesce(F.sum("n").over(by_key), F.lit(0)))
    drawn_shards = math.ceil(n_drawn / shard_slots)
    part = F.explode(F.sequence(F.floor(F.col("before") / shard_slots), F.floor((F.col("before") + F.col("n") - 1) / shard_slots)))
    owed = owed.withColumn("part", part)
    start, end = F.greatest(F.col("part") * shard_slots, F.col("before")), F.least((F.col("part") + 1) * shard_slots, F.col("before") + F.col("n"))
    owed = owed.select((F.col("part") + drawn_shards).alias("shard"), "skey", (F.col("first") + start - F.col("before")).alias("first"), (end - start).alias("n"), "n_blocks")

    # A run is at most a shard's slots; so many partitions that none explodes to more than RUN_SLOTS, about.
    runs = materialize(counts.unionByName(owed), "mix-runs")
    most = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(max(1, min(most, -(-n_slots // RUN_SLOTS))), "shard", "skey")
    slots = runs.select("shard", "skey", "n_blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"))
    block = permuted(F.pmod("j", F.col("n_blocks")), F.col("n_blocks"), F.xxhash64(F.lit(seed), F.col("skey")))
    slots = materialize(slots.select("shard", "skey", "j", block.alias("block")), "mix-slots")
    draws = slots.groupBy("skey", "block").agg(F.count("*").alias("drawn"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    order = ["doc_id", "size", *(["print"] if fingerprint else [])]
    placed = running_offsets(sized, ["skey"], order, "size", "at")
    return Mix(placed, sources, slots, draws, block_words)


def row_print(columns: list[str]) -> Column:
    """Hash of a row; nulls count by their place."""
    return F.xxhash64(*[c for n in columns for c in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())])


def taken_words(planned: Mix) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, source, and the first and last
    output shard that holds words of it (null: none)."""
    per = planned.pieces().groupBy("skey", "doc_id", "at", "size").agg(F.sum(F.col("words") * F.col("drawn")).cast("long").alias("taken"), F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard"))
    totals = planned.sources.select("skey", "source_size", "target")
    return join_bounded(per, totals, ["skey"]).select(
        "doc_id", "size", "source_size", "target", "taken", F.when(F.col("skey") != "1", F.substring("skey", 2, 1 << 30)).alias("source"), "first_shard", "last_shard"
    )


def shard_blocks(docs: DataFrame, planned: Mix) -> DataFrame:
    """The output shards: shard, source key, block, and the block's words, a row per slot.  A shard's
    rows are told apart by their slot number within the source."""
    numbered = docs.select("doc_id", source_key().alias("skey"), words_of(text_of()).alias("_words")).withColumn("size", F.size("_words").cast("long"))
    # Equal sizes of one doc_id are interchangeable only if their texts are: such tables need unique ids.
    cut = planned.pieces().filter("words > 0 and drawn > 0").select("doc_id", "skey", "size", "block", "at", "word_start", "words").join(numbered, ["doc_id", "skey", "size"])
    piece = F.array_join(F.slice("_words", F.col("word_start").cast("int") + 1, F.col("words").cast("int")), " ")
    blocks = cut.groupBy("skey", "block").agg(F.sort_array(F.collect_list(F.struct("at", piece.alias("t")))).alias("p"))
    blocks = blocks.select("skey", "block", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))
    return planned.slots.join(blocks.hint("merge"), ["skey", "block"])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row per pass over a document, with the columns of ``docs``.  A full
    pass keeps the text; the last pass may hold only the blocks drawn once more, its words joined
    by single spaces and n_chars counted anew.  Documents without words keep their one row."""
    planned = mix(docs, fingerprint=True, **options)
    piece = F.struct("word_start", "words", "drawn")
    spans = planned.pieces().groupBy("doc_id", "print", "skey", "at", "size").agg(F.sort_array(F.collect_list(piece)).alias("parts"), F.min("drawn").alias("least"), F.max("drawn").alias("most"))
    spans = spans.withColumn("most", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("most"))).withColumn("least", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("least")))
    spans = spans.filter("most > 0").select("doc_id", "print", "parts", "least", "most")
    doc = F.col("_doc")
    texts = docs.select(row_print(docs.columns).alias("print"), F.col("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    repeated = planned.docs.groupBy("doc_id", "print").count().filter("count > 1").limit(1).count()
    if repeated:  # equal rows are interchangeable: one of them carries the passes of all
        texts = texts.dropDuplicates(["print"])
    joined = texts.join(spans.drop("doc_id"), "print").select("_doc", "parts", "least", F.explode(F.sequence(F.lit(1), F.col("most").cast("int"))).alias("pass"))
    part = F.col("pass") > F.col("least")
    joined = joined.withColumn("words", words_of(F.when(part, F.coalesce(doc["text"], F.lit(""))).otherwise(F.lit(""))))
    chosen = F.filter("parts", lambda p: p["drawn"] >= F.col("pass"))
    cut = F.array_join(F.flatten(F.transform(chosen, lambda p: F.slice(F.col("words"), p["word_start"].cast("int") + 1, p["words"].cast("int")))), " ")
    out = joined.withColumn("cut", F.when(part, cut).otherwise(doc["text"])).withColumn("_doc", doc.withField("text", F.col("cut")))
    if "n_chars" in docs.columns:
        n = F.when(part, F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(doc["n_chars"])
        out = out.withColumn("_doc", doc.withField("n_chars", n))
    return out.select("_doc.*")
