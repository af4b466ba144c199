"""Operator 11: hard negatives from a forest of STR-packed R-trees.

Vectors are dealt to slabs by range of their most spread coordinate; a slab of some
``TREE_ROWS`` rows is one tree, packed by sort-tile-recursion over the coordinates of most
spread into leaves of ``LEAF_ROWS`` rows, and written as one row.  Upper levels are boxes over
``FAN_OUT`` neighbours.  The minimum bounding box of a node bounds the inner product with
an anchor from both sides, coordinate by coordinate.

A search walks a tree best first: nodes wait in a queue by upper bound; a node is dropped if
its bounds lie outside all score windows still open, or its upper bound is strictly below
the worst of a full result (an equal score may win by its smaller id).  First each anchor's
positives are searched (one window, all scores, its label), then the negatives (a window
for each positive, other labels).

Anchors are the stated query set: blocks of ``BLOCK_ROWS`` anchors meet every tree, so a task
holds one block and one tree at a time.  Blocks are copied to groups of trees and joined
there by group; each tree's best few rows of a window meet in a ranked window, of which
Spark keeps those few before it shuffles.

Edge cases: rows with a null label, a null vector or any null or non-finite component take no
part; a null id is never an anchor and orders last; vectors of unequal lengths are filled up
with zeros, an empty one is all zeros; ties go to the smaller id; exactly repeated rows
count once, and rows that share an id only are rows of their own; components too large for
exact doubles are multiplied as Python integers, and a score beyond a long is given as the
nearest long; very long vectors make smaller trees; extra columns are not read, whatever
their names; an empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.llm.common import materialize

#: numbers that a tree holds, and so its rows: some 8 MB
TREE_NUMBERS = 1 << 20
TREE_ROWS = 4096
LEAF_ROWS = 64
FAN_OUT = 8
BLOCK_ROWS = 256
#: trees that share a copy of the anchors
GROUP_TREES = 16
LAST = (1 << 63) - 1


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): rows that take part, components floor(scale * x); written."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(good)
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return materialize(own.select("vec_id", moved.alias("label"), v.alias("v")).distinct(), "negatives-vectors")


def str_order(rows: np.ndarray, leaf: int) -> np.ndarray:
    """Sort-tile-recursion: an order of rows of which each ``leaf`` neighbours are one tile."""
    out: list[np.ndarray] = []
    waiting = [(np.arange(len(rows)), 0)]
    by = np.argsort(-rows.var(axis=0), kind="stable") if rows.size else np.zeros(0, int)
    while waiting:
        mine, depth = waiting.pop()
        tiles = -(-len(mine) // leaf)
        if tiles <= 1 or depth >= len(by):
            out.append(mine)
            continue
        left = max(1, min(len(by) - depth, tiles.bit_length() - 1))  # coordinates that the tiles are still cut along
        cuts = max(2, round(tiles ** (1 / left)))
        width = -(-tiles // cuts) * leaf
        mine = mine[np.argsort(rows[mine, by[depth]], kind="stable")]
        waiting += [(mine[at : at + width], depth + 1) for at in range(0, len(mine), width)][::-1]
    return np.concatenate(out) if out else np.zeros(0, int)


def boxes(low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Boxes over each ``n`` neighbouring rows or boxes."""
    at = np.arange(0, len(low), n)
    return np.minimum.reduceat(low, at, axis=0), np.maximum.reduceat(high, at, axis=0)


TREE = "tree int, width int, ids array<bigint>, labels array<bigint>, v binary"


def packer(width: int, rows: int):
    """Trees of at most ``rows`` rows from each partition, each a row of ``TREE`` in STR order."""

    def tree(n: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        by = str_order(v, LEAF_ROWS)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))
        columns = [pa.array([n], pa.int32()), pa.array([width], pa.int32()), one(ids[by]), one(labels[by]), pa.array([v[by].tobytes()], pa.binary())]
        return pa.record_batch(columns, names=[x.split()[0] for x in TREE.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 12
        held: list[tuple] = []
        size = 0
        for batch in batches:
            own = filled(batch.column(2), width)
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(ids), rows):
                held.append((ids[at : at + rows], labels[at : at + rows], own[at : at + rows]))
                size += len(held[-1][0])
                while size >= rows:
                    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield tree(n, *[x[:rows] for x in whole])
                    held, size, n = [tuple(x[rows:] for x in whole)], size - rows, n + 1
        if size:
            yield tree(n, *[np.concatenate(x) for x in zip(*held, strict=True)])

    return pack


def filled(lists: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers, zeros behind shorter ones."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def plant(vectors: DataFrame, width: int, count: int) -> DataFrame:
    """The forest over written ``vectors``."""
    rows = max(LEAF_ROWS, min(TREE_ROWS, TREE_NUMBERS // max(width, 1)))
    spread = vectors.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.var_pop("x").alias("s"))
    widest = spread.orderBy(F.desc("s"), "k").limit(1).collect()
    first = F.get("v", F.lit(widest[0]["k"] if widest else 0))
    ordered = vectors.select(F.coalesce("vec_id", F.lit(LAST)).alias("id"), "label", "v").repartitionByRange(max(1, -(-count // rows)), first, F.xxhash64("id"))
    return materialize(ordered.sortWithinPartitions(first).mapInArrow(packer(width, rows), TREE), "negatives-forest")


class Tree:
    """One tree of the forest, its boxes from the leaves up to the root."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.most = np.abs(v).max(initial=0)
        self.levels = [boxes(v, v, LEAF_ROWS)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(boxes(*self.levels[-1], FAN_OUT))

    def exact(self, anchors: np.ndarray) -> bool:
        """Inner products with ``anchors`` are exact in doubles, whatever the order of their sums."""
        return float(max(self.most, np.abs(anchors).max(initial=0))) ** 2 * anchors.shape[-1] < 2**53

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(upper, lower) bounds of each anchor's inner products with each node, by level; widened
        where doubles may round."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        exact, out = self.exact(anchors), []
        for low, high in self.levels:
            slack = 0 if exact else 1e-9 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
            out.append((up @ high.T + down @ low.T + slack, up @ low.T + down @ high.T - slack))
        return out

    def search(self, anchor: np.ndarray, label: int, same: bool, own: int | None, windows: list[list], k: int, bounds: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple]]:
        """The first ``k`` rows of each window (least and most score): (-score, id)."""
        best: list[list[tuple]] = [[] for _ in windows]

        def open_to(most: float, least: float) -> bool:
            return any(most >= w[0] and least <= w[1] and (len(b) < k or most >= -b[-1][0]) for w, b in zip(windows, best, strict=True))

        exact, top = self.exact(anchor), len(self.levels) - 1
        queue = [(-bounds[top][0][n], top, n) for n in range(len(self.levels[top][0]))]
        while queue:
            most, level, n = heapq.heappop(queue)
            if not open_to(-most, bounds[level][1][n]):
                continue
            if level:
                for child in range(n * FAN_OUT, min((n + 1) * FAN_OUT, len(self.levels[level - 1][0]))):
                    if open_to(bounds[level - 1][0][child], bounds[level - 1][1][child]):
                        heapq.heappush(queue, (-bounds[level - 1][0][child], level - 1, child))
                continue
            at = slice(n * LEAF_ROWS, min((n + 1) * LEAF_ROWS, len(self.ids)))
            scores, ids = self.v[at] @ anchor if exact else whole(self.v[at], anchor), self.ids[at]
            fits = (self.labels[at] == label) == same
            if own is not None:
                fits &= ~((ids == own) & (self.v[at] == anchor).all(axis=1))
            for w, b in zip(windows, best, strict=True):
                least = w[0] if len(b) < k else max(w[0], -b[-1][0])
                hits = np.flatnonzero(fits & (scores >= least) & (scores <= w[1]))
                if len(hits):
                    b += [(-s, i) for s, i in zip(scores[hits].tolist(), ids[hits].tolist(), strict=True)]
                    b.sort()
                    del b[k:]
        return best


def whole(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products in Python integers, where doubles would round."""
    given = [int(x) for x in anchor]
    return np.array([sum(int(x) * y for x, y in zip(r, given, strict=True)) for r in rows], object)


FOUND = "key string, place int, score bigint, id bigint"


def searcher(same: bool, k: int):
    """Searches each (tree, block of anchors) of its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Tree] = {}
        for batch in batches:
            names = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                if (number := names["tree"][r].as_py()) not in held:
                    if len(held) >= GROUP_TREES:
                        held.pop(next(iter(held)))
                    v = np.frombuffer(names["v"][r].as_buffer()).reshape(-1, names["width"][r].as_py())
                    held[number] = Tree(names["ids"][r].values.to_numpy(), names["labels"][r].values.to_numpy(), v)
                tree = held[number]
                block = names["anchors"][r].values
                column = {f.name: block.field(i) for i, f in enumerate(block.type)}
                anchors = filled(column["v"], tree.v.shape[1])
                keys, ids, labels = column["key"].to_pylist(), column["id"].to_pylist(), column["label"].to_pylist()
                windows = [[[-float("inf"), float("inf")]]] * len(keys) if same else [[[x["least"], x["most"]] for x in ws] for ws in column["windows"].to_pylist()]
                bounds = tree.bounds(anchors)
                out: tuple[list, ...] = ([], [], [], [])
                for a in range(len(keys)):
                    best = tree.search(anchors[a], labels[a], same, ids[a] if same else None, windows[a], k, [(u[a], d[a]) for u, d in bounds])
                    for place, rows in enumerate(best):
                        for s, i in rows:
                            for to, x in zip(out, (keys[a], place, min(max(int(-s), -LAST - 1), LAST), i), strict=True):
                                to.append(x)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["key", "place", "score", "id"])

    return run


def searched(forest: DataFrame, anchors: DataFrame, count: int, same: bool, k: int) -> DataFrame:
    """(key, place, score, id, rank): the first ``k`` rows of each anchor's windows, over all trees."""
    trees = forest.count()
    most = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-trees // GROUP_TREES), min(trees, most))
    dealt = forest.withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(groups))).repartition(groups, "g")
    blocks = max(1, -(-count // BLOCK_ROWS))
    held = anchors.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
    copied = held.withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))).repartition(groups, "g")
    pairs = dealt.hint("shuffle_hash").join(copied, "g").select("tree", "width", "ids", "labels", "v", "anchors")
    found = pairs.mapInArrow(searcher(same, k), FOUND)
    rank = F.row_number().over(W.partitionBy("key", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def row_key() -> Column:
    return F.sha2(F.concat_ws(",", "vec_id", "label", F.col("v").cast("array<string>")), 256)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id
    ``every`` divides, with least * positive <= 100 * negative <= most * positive."""
    own = prepared(vectors)
    told = own.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    forest = plant(own, max(told["width"] or 0, 1), told["n"])
    anchors = own.filter(F.col("vec_id") % every == 0).select(row_key().alias("key"), F.col("vec_id").alias("id"), "label", "v")
    anchors = materialize(anchors, "negatives-anchors")
    count = anchors.count()
    first = materialize(searched(forest, anchors, count, True, positives).select("key", "rank", "score", "id"), "negatives-positives")
    # least * p <= 100 * n is n >= ceil(least * p / 100); decimals keep the products whole
    p = F.col("score").cast("decimal(20,0)")
    window = F.struct(F.col("rank"), F.ceil(p * least / 100).cast("bigint").alias("least"), F.floor(p * most / 100).cast("bigint").alias("most"))
    windows = first.groupBy("key").agg(F.sort_array(F.collect_list(window)).alias("windows"))  # of each positive one
    asked = anchors.join(windows, "key")
    found = searched(forest, asked, count, False, negatives)
    given = first.withColumn("place", F.col("rank") - 1).select("key", "place", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    out = found.join(given, ["key", "place"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    id_of = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select("anchor_id", id_of("positive").alias("positive_id"), "rank", id_of("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
