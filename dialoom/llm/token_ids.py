"""Operator 9: token ids in shards with minimal perfect hash indexes.

Documents are range-partitioned and sorted by doc_id; each task encodes its texts, appends
the end id and cuts its stream into shards of about ``SHARD_BYTES`` raw id payload.  A shard
row carries its payload, the places of its rows, and an index: keys hash to buckets, a
bucket's displacement sends its keys to free slots (hash and displace), and a slot holds a
fingerprint, the first row and the number of rows of its key.  A lookup is two hashes and
one comparison, whatever the shard's size.  Shards are Parquet rows, written and read
through Spark alone.

Edge cases: null text is empty; a null doc_id sorts first and is kept under the least long,
which itself reads back as null; repeated doc_ids lie side by side, in text order, under one
key of each shard they reach, so ties are settled by text and equal rows are interchangeable;
a text longer than a shard is a shard of its own; columns other than doc_id and text are not
read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.llm.common import join_bounded, materialize, text_of
from dialoom.llm.tokenizing import encoder, public_path

SHARD_BYTES = 2 << 20
END = 2
NONE = -(1 << 63)
PER_BUCKET = 3
SHARD = "part int, shard int, width int, n_ids bigint, payload binary, row_ends array<bigint>, row_keys array<bigint>, moves array<int>, prints array<bigint>, first_rows array<int>, row_counts array<int>"


def hashed(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes of signed 64-bit keys; ``seed`` is one number or one a key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed).astype(np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prints_of(keys: np.ndarray) -> np.ndarray:
    return (hashed(keys, -1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each key); keys are distinct, slots 0..n-1.

    Buckets are placed by size, largest first, each with its least displacement that sends its
    keys to free, distinct slots.  A displacement of -s-1 names slot s outright: for buckets of
    one key.
    """
    n = len(keys)
    buckets = max(1, -(-n // PER_BUCKET))
    home = (hashed(keys, 0) % np.uint64(buckets)).astype(np.int64)
    held = np.bincount(home, minlength=buckets)
    moves, slots, taken = np.zeros(buckets, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    order = np.argsort(home, kind="stable")  # a bucket's keys side by side
    ends = np.cumsum(held)
    for b in np.argsort(-held, kind="stable")[: int((held > 1).sum())].tolist():
        mine = order[ends[b] - held[b] : ends[b]]
        move, tries = 1, 16
        while True:
            want = (hashed(keys[mine], np.arange(move, move + tries)[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[want].any(axis=1) & (np.diff(np.sort(want, axis=1), axis=1) > 0).all(axis=1)
            if good.any():
                break
            move, tries = move + tries, 2 * tries
        k = int(np.argmax(good))
        moves[b], slots[mine], taken[want[k]] = move + k, want[k], True
    lone = order[held[home[order]] == 1]
    slots[lone] = np.flatnonzero(~taken)[: len(lone)]
    moves[home[lone]] = -slots[lone] - 1
    return moves, slots


def slots_of(keys: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    """The only slot where each key can be."""
    move = moves[(hashed(keys, 0) % np.uint64(len(moves))).astype(np.int64)]
    return np.where(move < 0, -move - 1, (hashed(keys, np.maximum(move, 0)) % np.uint64(n)).astype(np.int64))


def shard_batch(part: int, shard: int, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One shard of rows in key order: their ids end to end and how many each has."""
    width = 4 if ids.max() > 0xFFFF else 2
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    distinct, n = keys[first], len(first)
    moves, slots = build_index(distinct)
    prints, rows, held = (np.zeros(n, np.int64) for _ in range(3))
    prints[slots], rows[slots], held[slots] = prints_of(distinct), first, np.diff(np.append(first, len(keys)))
    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
    i64, i32 = pa.int64(), pa.int32()
    columns = [pa.array([part], i32), pa.array([shard], i32), pa.array([width], i32), pa.array([len(ids)], i64), pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary()), one(np.cumsum(counts), i64), one(distinct, i64), one(moves, i32), one(prints, i64), one(rows, i32), one(held, i32)]
    return pa.record_batch(columns, names=[x.split()[0] for x in SHARD.split(", ")])


def write_shards(docs: DataFrame, tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shard rows in ascending doc_id order; written."""
    path = tokenizer or public_path("byte_bpe_50k.json")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        coder = encoder(path)
        keys, ids, counts = np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        for batch in batches:
            for first, more, places in coder.encode_batch(batch.column(1), END):
                keys = np.append(keys, batch.column(0).slice(first, len(places) - 1).fill_null(NONE).to_numpy())
                ids, counts = np.append(ids, more), np.append(counts, np.diff(places))
                # A shard ends behind the row at which it is full; rows of one key may lie in several.
                while True:
                    starts = np.concatenate(([0], np.cumsum(counts)))
                    full = np.flatnonzero(starts[1:-1] * 4 >= shard_bytes)
                    if not len(full):
                        break
                    k = int(full[0]) + 1
                    yield shard_batch(part, shard, keys[:k], ids[: starts[k]], counts[:k])
                    keys, ids, counts, shard = keys[k:], ids[starts[k] :], counts[k:], shard + 1
        if len(keys):
            yield shard_batch(part, shard, keys, ids, counts)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(encode, SHARD), "token-shards")


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds ``start``: ids in all shards before."""
    sizes = shards.select("part", "shard", "n_ids")
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    starts = materialize(starts.select("part", "shard", (F.col("base") + F.col("own")).alias("start")), "token-starts")
    return join_bounded(shards, starts, ["part", "shard"])


FOUND = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            listed = lambda name, r: column[name][r].values.to_numpy()
            for r in range(batch.num_rows):
                width = column["width"][r].as_py()
                ids = np.frombuffer(column["payload"][r].as_buffer(), f"<u{width}").astype("<u4")
                ends = np.concatenate(([0], listed("row_ends", r)))
                keys, prints = listed("keys", r), listed("prints", r)
                slots = slots_of(keys, listed("moves", r).astype(np.int64), len(prints))
                here = prints[slots] == prints_of(keys)  # the shard holds these keys
                keys, slots = keys[here], slots[here]
                n = listed("row_counts", r)[slots].astype(np.int64)
                rows = np.repeat(listed("first_rows", r)[slots] - np.cumsum(n) + n, n) + np.arange(n.sum())
                begin, end = ends[rows], ends[rows + 1]
                own = [ids[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                told = pa.array([x.tobytes() for x in own], pa.binary()) if with_ids else pa.array([zlib.crc32(x) for x in own], pa.int64())
                found = np.repeat(keys, n)
                columns = [pa.array(found, mask=found == NONE), pa.array(begin + column["start"][r].as_py()), pa.array(end - begin), told]
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])

    return read


def read_all(shards: DataFrame) -> DataFrame:
    """Every document of the shards, each looked up by its key: doc_id, start, n_tokens, ids_crc32."""
    rows = with_starts(shards).withColumnRenamed("row_keys", "keys")
    return rows.mapInArrow(_reader(False), FOUND.replace("ids binary", "ids_crc32 bigint"))


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents of the given doc_ids (column doc_id): doc_id, start, n_tokens, ids.  Keys meet shards
    by equality with the shards' key lists, and only payloads asked for are read further."""
    wanted = keys.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("key")).distinct()
    held = shards.select("part", "shard", F.explode("row_keys").alias("key"))
    asked = held.join(wanted, "key").groupBy("part", "shard").agg(F.collect_list("key").alias("keys"))
    rows = with_starts(shards).drop("row_keys").join(asked, ["part", "shard"])
    return rows.mapInArrow(_reader(True), FOUND)
