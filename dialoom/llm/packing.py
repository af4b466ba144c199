"""Operator 8: pack documents into sequences by non-negative least squares.

Documents become ids plus an end id, cut at the window.  A piece's length is rounded down to
whole granules and what is over goes to the residue, so combinations of at most ``DEPTH``
lengths fill a window exactly.  The histogram of granule counts (at most 128 numbers) is all
the driver sees: it solves for repeat counts of the combinations by non-negative least
squares, rounds them, and fits them to the stock.  Each kind's pieces are numbered by
bucketed prefix sums and take the places of their combinations; the residue is laid end to
end and packed greedily, pieces cut at window borders, and its last window is cut into
powers of two, so that no sequence is padded.

Ids are written once; pieces join them by document for their checksums.
Edge cases: null or empty text is the end id alone; repeated rows are documents of their
own; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import materialize, running_offsets, text_of
from dialoom.llm.tokenizing import encoder, public_path

WINDOW, GRANULE, DEPTH, END = 4096, 32, 3, 2
KINDS = WINDOW // GRANULE


def combinations() -> np.ndarray:
    """A row per multiset of at most DEPTH granule counts that sum to a window; DEPTH columns, 0 for none."""
    out = [(KINDS, 0, 0)]
    out += [(a, KINDS - a, 0) for a in range((KINDS + 1) // 2, KINDS)]
    out += [(a, b, KINDS - a - b) for a in range(1, KINDS - 1) for b in range(1, a + 1) if 1 <= KINDS - a - b <= b]
    return np.array(out)


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that minimises |ax - b|, by active sets (Lawson and Hanson)."""
    x = np.zeros(a.shape[1])
    on = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[on] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        on[best] = True
        while True:
            s = np.zeros_like(x)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s[on].min() > 0:
                x = s
                break
            low = on & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            on &= x > 1e-9
            x[~on] = 0
            if not on.any():
                break
    return x


def plan(histogram: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(combinations used, times each): whole repeats that the stock allows."""
    stock = np.zeros(KINDS + 1, np.int64)
    for k, n in histogram.items():
        stock[k] = n
    combos = combinations()
    combos = combos[(stock[combos] > 0).all(axis=1, where=combos > 0)]
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    a = np.zeros((KINDS + 1, len(combos)))
    for c in range(combos.shape[1]):
        np.add.at(a, (combos[:, c], np.arange(len(combos))), 1)
    a[0] = 0
    wanted = np.rint(least_squares(a, stock.astype(float)))
    times = np.zeros(len(combos), np.int64)
    need = a.astype(np.int64)
    # Rounded repeats first, then any that the stock still allows.
    for most in (wanted, np.full(len(combos), np.inf)):
        for j in np.argsort(-wanted, kind="stable"):
            used = need[:, j] > 0
            n = int(min(most[j] - times[j] if np.isfinite(most[j]) else np.inf, (stock[used] // need[used, j]).min()))
            if n > 0:
                times[j] += n
                stock -= need[:, j] * n
    return combos[times > 0], times[times > 0]


def places(combos: np.ndarray, times: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """kind: (first number, first sequence, offset) of each run of its places, by first number."""
    first = np.concatenate([[0], np.cumsum(times)[:-1]]) if len(times) else times
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    for combo, n, sequence in zip(combos.tolist(), times.tolist(), first.tolist(), strict=True):
        offset = 0
        for kind in combo:
            if kind:
                runs.setdefault(kind, []).append((given.get(kind, 0), sequence, offset))
                given[kind] = given.get(kind, 0) + n
                offset += kind * GRANULE
    return {k: (*(np.array(x, np.int64) for x in zip(*v, strict=True)), given[k]) for k, v in runs.items()}


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(row, doc_id, doc_tokens, ids): every row encoded once and written, ids as unsigned 16-bit
    bytes where they fit and 32-bit else (wide)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for first, ids, places in coder.encode_batch(batch.column(1), END):
                n = len(places) - 1
                wide = bool(len(ids) and ids.max() > 0xFFFF)
                raw = ids if wide else ids.astype("<u2")
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(places * raw.itemsize), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.record_batch([batch.column(0).slice(first, n), pa.array(np.diff(places)), pa.array(np.full(n, wide)), cells], names=["doc_id", "doc_tokens", "wide", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", text_of().alias("text")).mapInArrow(encode, f"doc_id {kind}, doc_tokens bigint, wide boolean, ids binary")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "pack-ids")


def pack(docs: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces: row, doc_id, start, length, sequence_id, offset; ids: row, doc_id, doc_tokens, ids)."""
    ids = tokenized(docs, tokenizer or public_path("word_bpe_49k.json"))
    cut = ids.select("row", "doc_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("doc_tokens") - 1) / WINDOW))).alias("k"))
    start = F.col("k") * WINDOW
    cut = cut.select("row", start.cast("long").alias("start"), F.least(F.col("doc_tokens") - start, F.lit(WINDOW)).cast("long").alias("length"))
    cut = materialize(cut.withColumn("kind", F.floor(F.col("length") / GRANULE).cast("int")), "pack-pieces")
    histogram = {r["kind"]: r["n"] for r in cut.filter("kind > 0").groupBy("kind").agg(F.count("*").alias("n")).collect()}  # at most KINDS rows
    combos, times = plan(histogram)
    spots, n_full = places(combos, times), int(times.sum())
    whole = running_offsets(cut.withColumn("one", F.lit(1)), ["kind"], ["row", "start"], "one", "number")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.full(len(b), -1, np.int64), np.full(len(b), -1, np.int64)
            kinds, numbers = b["kind"].to_numpy(), b["number"].to_numpy()
            for kind in np.unique(kinds):
                if kind in spots:
                    first, begin, at, total = spots[kind]
                    mine = np.flatnonzero((kinds == kind) & (numbers < total))
                    run = np.searchsorted(first, numbers[mine], "right") - 1
                    sequence[mine] = begin[run] + numbers[mine] - first[run]
                    offset[mine] = at[run]
            b["sequence_id"], b["offset"] = sequence, offset
            yield b[["row", "start", "length", "kind", "sequence_id", "offset"]]

    placed = whole.select("row", "start", "length", "kind", "number").mapInPandas(place, "row bigint, start bigint, length bigint, kind int, sequence_id bigint, offset bigint")
    placed = materialize(placed, "pack-placed")
    taken = F.col("kind") * GRANULE
    fitted = placed.filter("sequence_id >= 0").select("row", "start", taken.cast("long").alias("length"), "sequence_id", "offset")
    used = F.when(F.col("sequence_id") >= 0, taken).otherwise(0)
    rest = placed.select("row", (F.col("start") + used).alias("start"), (F.col("length") - used).alias("length")).filter("length > 0")
    rest = running_offsets(materialize(rest, "pack-rest"), [], ["row", "start"], "length", "at")
    total = rest.agg(F.sum("length")).first()[0] or 0
    full, last = divmod(total, WINDOW)
    tail = [1 << b for b in range(WINDOW.bit_length()) if last >> b & 1][::-1]
    borders = full * WINDOW + np.concatenate([[0], np.cumsum(tail)]).astype(np.int64)

    def residue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, length = b["at"].to_numpy(), b["length"].to_numpy()
            end = at + length
            while len(b):
                late = at >= full * WINDOW
                slot = np.searchsorted(borders, at, "right") - 1
                border = np.where(late, borders[np.minimum(slot + 1, len(borders) - 1)], (at // WINDOW + 1) * WINDOW)
                begin = np.where(late, borders[np.maximum(slot, 0)], at // WINDOW * WINDOW)
                sequence = np.where(late, full + slot, at // WINDOW) + n_full
                n = np.minimum(end, border) - at
                yield pd.DataFrame({"row": b["row"], "start": b["start"], "length": n, "sequence_id": sequence, "offset": at - begin})
                more = end > at + n
                b = b.assign(start=b["start"] + n)[more]
                at, end = (at + n)[more], end[more]

    poured = rest.select("row", "start", "length", "at").mapInPandas(residue, "row bigint, start bigint, length bigint, sequence_id bigint, offset bigint")
    return fitted.unionByName(poured), ids


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, ids (unsigned 32-bit), doc_tokens, sequence_id, offset."""
    pieces, ids = pack(docs, tokenizer)
    per_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    kind = ids.schema["doc_id"].dataType.simpleString()

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            parts = batch.column(4)
            per_row = pc.list_value_length(parts).to_numpy().astype(np.int64)
            start, length, sequence, offset = (x.to_numpy() for x in parts.flatten().flatten())
            row = np.repeat(np.arange(batch.num_rows), per_row)
            crc = np.zeros(len(row), np.int64)
            at = 0
            for wide, raw, n in zip(batch.column(2).to_pylist(), batch.column(3), per_row.tolist(), strict=True):
                ids32 = np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2").astype("<u4")
                for k in range(at, at + n):
                    crc[k] = zlib.crc32(ids32[start[k] : start[k] + length[k]])
                at += n
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc), batch.column(1).take(pa.array(row)), pa.array(sequence), pa.array(offset)]
            yield pa.record_batch(columns, names=names)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ids.join(per_row, "row").select("doc_id", "doc_tokens", "wide", "ids", "pieces").mapInArrow(slices, schema)


def sequences(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array, lengths of its pieces in order."""
    pieces, ids = pack(docs, tokenizer)
    per_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for wide, raw, parts in zip(b["wide"], b["ids"], b["pieces"], strict=True):
                all_ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.int64)
                out += [(p["sequence_id"], p["offset"], all_ids[p["start"] : p["start"] + p["length"]]) for p in parts]
            yield pd.DataFrame(out, columns=["sequence_id", "offset", "ids"])

    flat = ids.join(per_row, "row").select("wide", "ids", "pieces").mapInPandas(slices, "sequence_id bigint, offset bigint, ids array<bigint>")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    out = flat.groupBy("sequence_id").agg(ordered.alias("p"))
    return out.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: F.size(x["ids"])).alias("lengths"))
