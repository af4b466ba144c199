"""Operator 12: how filters interact, audited over all orders of applying them.

Documents are counted by mask cell: a part of the corpus and the set of filters that the
document fails.  Partial sums make that one small row a cell, whatever the corpus.  A
Gray-code walk over the 32 subsets of filters then toggles one filter at a time.  Each
cell keeps a counter of its active failures; a cell whose counter leaves or reaches zero
is taken from or given back to the running survivors.  The 32 states are stored, and each
step of each order is the difference of two of them.

Filter E (a copy of a text of smaller doc_id) is settled on counts: rows are counted by text
digest, doc_id and part, then by digest and part, where the rows of the least doc_id are
known; the least of a digest meets these narrow rows in a join that adaptive execution
splits.  No group of copies is gathered.

Edge cases: null text is empty (no words: fails A alone, and E); a null source is the part
of the empty string; a null doc_id has no label, never fails E and is no one's earlier copy;
rows of one doc_id and text are not each other's copies; a document of several label rows is
good or toxic if any says so, and null labels say nothing; very long texts are read whole;
extra columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import materialize, text_of, words_of

FILTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: parts that a worker lays out at a time
PARTS_A_SLICE = 256
RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = words_of(text)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 2 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters."""
    text = text_of()
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    own = own.join(said, "doc_id", "left").withColumn("good", F.coalesce("good", no)).withColumn("toxic", F.coalesce("toxic", no))
    kind = ["part", "mask", "good", "toxic"]
    rows = own.groupBy("digest", *kind, "doc_id").agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    texts = rows.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    texts = materialize(texts, "audit-texts")
    least = texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    texts = texts.join(least, "digest").withColumn("copies", F.col("known") - firsts)
    counted = texts.groupBy(*kind).agg(F.sum("copies").alias("copies"), F.sum(F.col("n") - F.col("copies")).alias("others"))
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("others").alias("n")), F.struct((F.col("mask") + 16).alias("m"), F.col("copies").alias("n"))))
    counted = counted.select("part", "good", "toxic", split.alias("c"))
    n = F.col("c.n")
    return counted.groupBy("part", F.col("c.m").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def gray_states(counts: np.ndarray, filters: int = 5) -> np.ndarray:
    """Survivors of every subset of filters.  counts: (parts, masks, measures); the result has
    the subset in the place of the mask."""
    masks = np.arange(1 << filters)
    active = np.zeros(len(masks), np.int64)
    running = counts.sum(axis=1)
    states = np.empty_like(counts)
    states[:, 0] = running
    subset = 0
    for turn in range(1, 1 << filters):
        bit = turn & -turn  # the one filter in which neighbours of a Gray code differ
        subset ^= bit
        failing = (masks & bit) > 0
        if subset & bit:
            running = running - counts[:, failing & (active == 0)].sum(axis=1)
            active += failing
        else:
            active -= failing
            running = running + counts[:, failing & (active == 0)].sum(axis=1)
        states[:, subset] = running
    return states


def order_rows(parts: list[str], states: np.ndarray) -> pd.DataFrame:
    """A row per part, order and step, from stored states of (n, good, toxic)."""
    orders = list(permutations(range(len(FILTERS))))
    bits = 1 << np.array(orders)
    after = np.cumsum(bits, axis=1)
    before, chosen = after - bits, np.array(orders)
    lost = states[:, before] - states[:, after]  # parts x orders x steps x measures
    single = 1 << np.arange(len(FILTERS))
    full = (1 << len(FILTERS)) - 1
    fails = states[:, [0], 0] - states[:, single, 0]
    alone = states[:, full ^ single, 0] - states[:, [full], 0]
    shapley = np.stack([lost[..., 0][:, chosen == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    removed = lost[..., 0]
    n = len(orders) * len(FILTERS)
    names = np.repeat(["".join(FILTERS[f] for f in o) for o in orders], len(FILTERS))
    flat = lambda x: x.reshape(-1)
    return pd.DataFrame({
        "part": np.repeat(np.array(parts, object), n), "filter_order": np.tile(names, len(parts)), "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders) * len(parts)),
        "kept": flat(states[:, after, 0]), "removed": flat(removed), "redundant": flat(fails[:, chosen] - removed), "unique_fails": flat(alone[:, chosen]),
        "good_lost": flat(lost[..., 1]), "toxic_lost": flat(lost[..., 2]), "shapley": flat(shapley[:, chosen]),
    })


def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), PARTS_A_SLICE):
            rows = batch.iloc[at : at + PARTS_A_SLICE]
            counts = np.zeros((len(rows), 1 << len(FILTERS), 3), np.int64)
            for k, held in enumerate(rows["cells"]):
                for c in held:
                    counts[k, c["mask"]] = c["n"], c["good"], c["toxic"]
            yield order_rows(rows["part"].tolist(), gray_states(counts))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the five filters and step: documents kept after it, removed
    here, redundant, failing this filter only, good and toxic ones lost, and the filter's sum
    of removals over all orders."""
    held = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return held.mapInPandas(walked, RESULT)
