"""Operator 13: scores of texts under an interpolated modified Kneser-Ney n-gram model.

Counting takes two passes.  In both, workers cut whole texts into words and hash those
in numpy, add up what is equal within a slice of tokens, and Spark shuffles these partial
counts by shard, a range of hashes, and sums them; a frequent word or n-gram is one row a slice
before it meets the shuffle.  The first pass counts words and writes each shard's sorted
array of hashes; a word's place in them is its id.  The second counts n-grams of ids.  From the
sums of one length follow, again as partial sums, what the next shorter length needs:
different left neighbours, and totals and counts of counts of what follows.  Each shard is
written sorted, as arrays of hashes and values.

Scoring: a worker maps the arrays of the model into its memory and looks words and n-grams up by
binary search, the sorted ones of a slice at a time, so pages are touched in order and
only those needed are read.  No text is shuffled.  The folder must be one that workers can
open by path (a mounted one on a cluster); it lies below ``spark.checkpoint.dir``.

An n-gram begins with as many marks of a text's begin as it needs, and an end follows the
last word.  With discounts D1, D2, D3+ of each length from its counts of counts,
p(w | context) = (a - D(a)) / T + g * p(w | shorter context), down to 1 / (V + 1): words that
training lacks share one class, and all classes sum to one in every context.

The order is a parameter, 2 by default: at 3 the shuffle of counts and the model would take
more than four times the size of the input, for two thirds of the trigrams are distinct.

Edge cases: null text is empty (an end alone); a null doc_id counts as empty text for the
crc, so it trains; repeated rows count and are scored each; no training text gives a vocabulary
of none, where every token has probability one; equal n-grams have one count, so there are
no ties; very long texts are scored whole (a slice holds at least one text); extra columns
are not read, whatever their names; an empty table gives no rows.  Different words of one
64-bit hash would count as one word: for a billion words, a chance of 3 %.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import materialize, text_of
from dialoom.sources.stored import shared_dir

ORDER = 2
#: tokens whose n-grams a task adds up, or looks up, at a time, and bytes of text that it hashes
SLICE_TOKENS, SLICE_BYTES = 1 << 20, 1 << 21
#: training tokens to a shard of the model, at most about
PER_SHARD = 1 << 21
END = np.uint64(2)
#: fallback where too few counts of counts are there to tell discounts
DISCOUNTS = (0.5, 1.0, 1.5)
#: of an n-gram: its count for the next word (raw at full order, else different left neighbours), and as a
#: context: the total of what follows and how many of it have a count of 1, 2, 3 or more
SUMS = ["a", "t", "n1", "n2", "n3"]
GRAMS = ", ".join(["level int", "shard int", "context bigint", "word bigint", *[f"{c} bigint" for c in SUMS]])
COUNTS = "shard int, context bigint, word bigint, n bigint"
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTES = np.arange(256)
SPACES = (BYTES == 32) | ((BYTES >= 9) & (BYTES <= 13))
#: a number for each byte, capital letters as small ones
LETTERS = mix((np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES) + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE ** k and its inverse for k < n, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' words, words of each text).  A word's hash is a polynomial of its bytes."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[-1] == at[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = ~SPACES[data]
    fresh = np.ones(len(data) + 1, bool)  # no word goes on to here: a text begins, or white space came before
    fresh[1:-1] = ~inside[:-1]
    fresh[at] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    ends = np.flatnonzero(inside & (fresh[1:] | ~np.append(inside[1:], False))) + 1
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[data] * up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.diff(np.searchsorted(starts, at))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, hashes of their words and ends, tokens of each row); the text is the last column."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        lengths = np.cumsum(pc.binary_length(texts).to_numpy())
        rows, at, hashes, sizes, tokens = 0, 0, [], [], 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + SLICE_BYTES, "right")))
            words, n = hashed_words(texts.slice(at, stop - at))
            own = np.full(len(words) + len(n), END, np.uint64)
            own[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
            hashes.append(own)
            sizes.append(n + 1)
            tokens += len(own)
            at = stop
            if tokens >= SLICE_TOKENS or at == batch.num_rows:
                yield batch.slice(rows, at - rows), np.concatenate(hashes), np.concatenate(sizes)
                rows, hashes, sizes, tokens = at, [], [], 0


def padded(ids: np.ndarray, sizes: np.ndarray, pad: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with ``pad`` marks of the begin before each text, the places of the given ids)."""
    places = np.arange(len(ids)) + np.repeat(pad * np.arange(1, len(sizes) + 1), sizes)
    out = np.full(len(ids) + pad * len(sizes), begin, np.int64)
    out[places] = ids
    return out, places


def gram_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context.view(np.uint64) * np.uint64(BASE) + mix(word.view(np.uint64) + np.uint64(1)))


def shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of hashes."""
    return (hashes >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int32)


def groups(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of n-grams, where each distinct one begins in it)."""
    by = np.lexsort((word, context))
    first = np.zeros(len(by), bool)
    first[:1] = True
    for x in (context[by], word[by]):
        first[1:] |= x[1:] != x[:-1]
    return by, np.flatnonzero(first)


def store(path: str, columns: list[np.ndarray]) -> None:
    """The columns one behind the other, each but the first in the least width that holds it; a retried
    task replaces the file by an equal one."""
    columns = [columns[0].astype(np.uint64), *[c.astype(np.min_scalar_type(max(int(c.max(initial=0)), 1))) for c in columns[1:]]]
    head = np.array([len(columns), len(columns[0]), *[c.itemsize for c in columns]], "<i8")
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(head.tobytes())
        for c in columns:
            f.write(np.ascontiguousarray(c).tobytes())
            f.write(bytes(-f.tell() % 8))
    os.replace(part, path)


def mapped(path: str) -> list[np.ndarray]:
    """The columns of a stored shard, mapped."""
    raw = np.memmap(path, np.uint8, "r")
    k, n = raw[:16].view("<i8").tolist()
    sizes, at, out = raw[16 : 16 + 8 * k].view("<i8").tolist(), 16 + 8 * k, []
    for size in sizes:
        out.append(raw[at : at + n * size].view(f"<u{size}"))
        at += n * size + -(n * size) % 8
    return out


def shard_file(folder: str, name: str) -> list[np.ndarray] | None:
    """A shard's columns, mapped anew: a worker has no more of a model in memory than the shard it reads,
    however large the model is; what the system's cache holds costs only page faults."""
    path = f"{folder}/{name}"
    return mapped(path) if os.path.exists(path) else None


def search(folder: str, level: str, bits: int, asked: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in its shard or -1, values) of each of the sorted hashes ``asked``."""
    found, place, own = np.zeros((values, len(asked)), np.int64), np.full(len(asked), -1), shard(asked, bits)
    for s in np.unique(own).tolist():
        if (columns := shard_file(folder, f"{level}-{s}")) is None:
            continue
        at, to = np.searchsorted(own, s), np.searchsorted(own, s, "right")
        here = np.minimum(np.searchsorted(columns[0], asked[at:to]), len(columns[0]) - 1)
        hit = columns[0][here] == asked[at:to]
        place[at:to] = np.where(hit, here, -1)
        for k in range(values):
            found[k, at:to] = np.where(hit, columns[k + 1][here], 0)
    return place, found


@dataclass
class Vocabulary:
    """Words of the training texts by hash: an id is a place in the sorted arrays."""

    folder: str
    bits: int
    firsts: list[int]  # the first id of each shard, and their number
    tokens: int

    @property
    def words(self) -> int:
        return self.firsts[-1]

    @property
    def begin(self) -> int:  # the id behind the last; the next one is that of unknown words
        return self.words

    @property
    def id_bits(self) -> int:
        return (self.words + 1).bit_length()

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count in training) of each word."""
        asked, back = np.unique(hashes, return_inverse=True)
        place, found = search(self.folder, "words", self.bits, asked, 1)
        ids = np.where(place < 0, self.words + 1, place + np.array(self.firsts)[shard(asked, self.bits)])
        return ids[back], found[0][back]

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        """The shard of words by id; the mark of the begin lies in the last one."""
        return np.minimum(np.searchsorted(self.firsts, ids, "right") - 1, len(self.firsts) - 2).astype(np.int32)


def word_counter(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, _ in slices(batches):
            words, n = np.unique(hashes, return_counts=True)
            yield pa.record_batch([pa.array(shard(words, bits)), pa.array(np.zeros(len(words), np.int64)), pa.array(words.view(np.int64)), pa.array(n)], names=["shard", "context", "word", "n"])

    return count


def gathered(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """A partition's columns whole: some shards, each of a bounded share of all n-grams."""
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else []


def word_writer(folder: str):
    """Writes the words of each shard, sorted; gives (shard, words, tokens)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if columns := gathered(batches):
            places, words, n = columns[0], columns[2].view(np.uint64), columns[3]
            for s in np.unique(places).tolist():
                mine = np.flatnonzero(places == s)
                mine = mine[np.argsort(words[mine])]
                store(f"{folder}/words-{s}", [words[mine], n[mine]])
                yield pa.record_batch([pa.array([s], pa.int32()), pa.array([len(mine)], pa.int64()), pa.array([int(n[mine].sum())], pa.int64())], names=["shard", "words", "tokens"])

    return write


def summed(rows: DataFrame, shards: int, keys: list[str], values: list[str]) -> DataFrame:
    """Partial sums by shard: one exchange, by shard alone, which deals n-grams evenly."""
    return rows.repartition(shards, "shard").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def count_words(texts: DataFrame, folder: str) -> Vocabulary:
    spark = texts.sparkSession
    bits = max(0, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    rows = summed(texts.mapInArrow(word_counter(bits), COUNTS), 1 << bits, ["shard", "context", "word"], ["n"])
    told = materialize(rows.mapInArrow(word_writer(folder), "shard int, words bigint, tokens bigint"), "kneser-ney-words")
    shards = {r["shard"]: r for r in told.collect()}  # a row a shard
    firsts = np.concatenate(([0], np.cumsum([shards[s]["words"] if s in shards else 0 for s in range(1 << bits)])))
    return Vocabulary(folder, bits, firsts.tolist(), sum(r["tokens"] for r in shards.values()))


def gram_counter(known: Vocabulary, order: int, bits: int):
    """Distinct n-grams of each slice of tokens, with their counts; a context is its ids side by side."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, sizes in slices(batches):
            ids, places = padded(known.look_up(hashes)[0], sizes, order - 1, known.begin)
            context = np.zeros(len(places), np.int64)
            for k in range(order - 1, 0, -1):
                context = (context << known.id_bits) | ids[places - k]
            word = ids[places]
            by, at = groups(context, word)
            context, word, n = context[by[at]], word[by[at]], np.diff(np.append(at, len(by)))
            own = shard(gram_hash(context, word), bits)
            by = np.argsort(own, kind="stable")
            yield pa.record_batch([pa.array(x[by]) for x in (own, context, word, n)], names=["shard", "context", "word", "n"])

    return count


def gram_writer(known: Vocabulary, level: int, order: int, bits: int):
    """Writes each shard's n-grams of ``level`` words, sorted by hash, or single words by id; gives partial
    sums for the next shorter length, and two rows of totals a length, without a word: a: sum of counts,
    t: n-grams, n1, n2, n3: those of count 1, 2, 3; under the negative length, a: those of count 4."""
    wide = known.id_bits

    def rows_of(own: int, places: np.ndarray, context: np.ndarray, word: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(sums), own, np.int32)), pa.array(places), pa.array(context), pa.array(word), *[pa.array(np.ascontiguousarray(x)) for x in sums.T]], names=["level", "shard", "context", "word", *SUMS])

    def totals(own: int, values: list[int]) -> pa.RecordBatch:
        none = pa.array([None], pa.int64())
        return pa.record_batch([pa.array([own], pa.int32()), pa.array([0], pa.int32()), none, none, *[pa.array([v], pa.int64()) for v in values]], names=["level", "shard", "context", "word", *SUMS])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = []
        for batch in batches:
            if level < order:  # totals of longer n-grams pass through
                here = batch.column(0).to_numpy() == level
                yield batch.filter(pa.array(~here))
                batch = batch.filter(pa.array(here)).drop_columns(["level"])
            mine.append(batch)
        columns = gathered(iter(mine))
        mine.clear()
        if not columns:
            return
        places, context, word, a, *rest = columns
        for s in np.unique(places).tolist():
            at = np.flatnonzero(places == s)
            if level > 1:
                keys = gram_hash(context[at], word[at])
                by = np.argsort(keys)
                store(f"{known.folder}/{level}-{s}", [keys[by], *[c[at][by] for c in (a, *rest)]])
            else:
                first, last = known.firsts[s], known.firsts[s + 1] + (s == len(known.firsts) - 2)
                dense = [np.zeros(last - first, np.int64) for _ in SUMS]
                for to, c in zip(dense, (a, *rest), strict=True):
                    to[word[at] - first] = c[at]
                store(f"{known.folder}/1-{s}", dense)
        given = a > 0
        tally = [int((a == k).sum()) for k in (1, 2, 3, 4)]
        yield totals(level, [int(a.sum()), int(given.sum()), *tally[:3]])
        yield totals(-level, [tally[3], 0, 0, 0, 0])
        if level > 1:
            a, context, word = a[given], context[given], word[given]
            del columns, rest, places, given
            below = (context & ((1 << wide * (level - 2)) - 1)) if level > 2 else np.zeros(len(a), np.int64)
            # what begins with the mark of the begin has one left neighbour only: its count stands for it
            left = np.where(below >> (wide * (level - 3)) == known.begin, a, 1) if level > 2 else np.ones(len(a), np.int64)
            by, at = groups(below, word)
            ends = below[by[at]], word[by[at]], [np.add.reduceat(left[by], at)]
            del below, left, word
            head, last = context >> wide, context & ((1 << wide) - 1)
            by, at = groups(head, last)
            heads, a = (head[by[at]], last[by[at]]), a[by]
            follow = [np.add.reduceat(x.astype(np.int64), at) for x in (a, a == 1, a == 2, a >= 3)]
            del by, at, a, head, last, context
            sums = np.zeros((len(ends[0]) + len(heads[0]), len(SUMS)), np.int64)
            sums[: len(ends[0]), 0] = ends[2][0]
            for k, x in enumerate(follow, 1):
                sums[len(ends[0]) :, k] = x
            context, word = np.concatenate((ends[0], heads[0])), np.concatenate((ends[1], heads[1]))
            by, at = groups(context, word)
            context, word, sums = context[by[at]], word[by[at]], np.add.reduceat(sums[by], at, axis=0)
            places = shard(gram_hash(context, word), bits) if level > 2 else known.shard_of(word)
            yield rows_of(level - 1, places, context, word, sums)

    return write


def local_folder(uri: str) -> str:
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files: {uri} must be a folder that they can open by path")
    return at.path


@dataclass
class Model:
    """What a worker needs to find and weigh the n-grams of a trained model."""

    known: Vocabulary
    order: int
    bits: int
    discounts: list[tuple[float, float, float]]  # by length, from 1
    total: int  # sum of the counts of single words
    rest: float  # their share that goes to the uniform distribution

    def sums(self, level: int, context: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """The values of n-grams; 0 for those that training lacks."""
        if level > 1:
            asked, back = np.unique(gram_hash(context, ids), return_inverse=True)
            return list(search(self.known.folder, str(level), self.bits, asked, 1 if level == self.order else len(SUMS))[1][:, back])
        asked, back = np.unique(ids, return_inverse=True)
        found = np.zeros((len(SUMS), len(asked)), np.int64)
        own = self.known.shard_of(asked)
        for s in np.unique(own).tolist():
            here = np.flatnonzero((own == s) & (asked <= self.known.begin))
            if (columns := shard_file(self.known.folder, f"1-{s}")) is not None:
                found[:, here] = [c[asked[here] - self.known.firsts[s]] for c in columns]
        return list(found[:, back])

    def less(self, level: int, a: np.ndarray) -> np.ndarray:
        """Counts less their discounts."""
        return a - np.array([0.0, *self.discounts[level - 1]])[np.minimum(a, 3)]

    def log_probabilities(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 probability of the ids at ``places``."""
        p = np.full(len(places), 1.0 / (self.known.words + 1))
        context, before = np.zeros(len(ids), np.int64), None
        for level in range(1, self.order + 1):
            if level > 1:
                context = np.concatenate((context[:1], (context[:-1] << self.known.id_bits) | ids[:-1])) & ((1 << self.known.id_bits * (level - 1)) - 1)
            # shorter n-grams at every place, as contexts too; those of full order only where a token is scored
            own = self.sums(level, context, ids) if level < self.order else self.sums(level, context[places], ids[places])
            a = own[0][places] if level < self.order else own[0]
            if level == 1:
                p = (self.less(1, a) / self.total if self.total else 0.0) + self.rest * p
            else:
                t, *n = [x[places - 1] for x in before]
                seen, total = t > 0, np.maximum(t, 1)
                rest = np.where(seen, sum(d * x for d, x in zip(self.discounts[level - 1], n, strict=True)) / total, 1.0)
                p = np.where(seen, self.less(level, a) / total, 0.0) + rest * p
            before = own[1:]
        return np.log10(p)


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams of count 1, 2, 3, 4; fixed ones where those don't tell."""
    if min(n) == 0:
        return DISCOUNTS
    y = n[0] / (n[0] + 2 * n[1])
    own = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return tuple(d if 0 < d < k else f for k, d, f in zip((1, 2, 3), own, DISCOUNTS, strict=True))


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """Counts the words and n-grams of ``texts`` (one column) and writes the model."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    folder = local_folder(shared_dir(texts.sparkSession)) + f"/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    known = count_words(texts, folder)
    bits = max(known.bits, max(0, -(-known.tokens // PER_SHARD) - 1).bit_length())  # as many shards as partitions at least
    if (order - 1) * known.id_bits > 63:
        raise ValueError(f"contexts of {order - 1} of {known.words} words exceed 63 bits")
    if not known.tokens:
        return Model(known, order, bits, [DISCOUNTS] * order, 0, 1.0)
    rows = summed(texts.mapInArrow(gram_counter(known, order, bits), COUNTS), 1 << bits, ["shard", "context", "word"], ["n"])
    for level in range(order, 0, -1):
        rows = rows.mapInArrow(gram_writer(known, level, order, bits), GRAMS)
        if level > 1:
            shards = 1 << (known.bits if level == 2 else bits)
            rows = summed(rows, shards, ["level", "shard", "context", "word"], SUMS).select("level", "shard", "context", "word", *SUMS)
    told = materialize(rows.groupBy("level").agg(*[F.sum(c).alias(c) for c in SUMS]), "kneser-ney-totals")
    totals = {r["level"]: r for r in told.collect()}  # two rows a length
    discounts = [discounts_of([totals[k]["n1"], totals[k]["n2"], totals[k]["n3"], totals[-k]["a"]]) for k in range(1, order + 1)]
    one, d = totals[1], discounts[0]
    more = one["t"] - one["n1"] - one["n2"]
    return Model(known, order, bits, discounts, one["a"], (d[0] * one["n1"] + d[1] * one["n2"] + d[2] * more) / one["a"])


SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scorer(model: Model):
    known = model.known

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, sizes in slices(batches):
            ids, raw = known.look_up(hashes)
            logs = model.log_probabilities(*padded(ids, sizes, model.order - 1, known.begin))
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            base = np.log10((raw + 0.5) / (known.tokens + 0.5 * (known.words + 1)))
            columns = [rows.column(0), rows.column(1), pa.array(sizes), pa.array(np.add.reduceat((raw > 0).astype(np.int64), at)), pa.array(np.full(len(sizes), known.tokens, np.int64))]
            columns += [pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at))]
            yield pa.record_batch(columns, names=["doc_id", "held_out", *[c.split()[0] for c in SCORES.split(", ")]])

    return score


def held_out() -> Column:
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return crc % 5 == 1


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    return own.mapInArrow(scorer(model), f"doc_id {kind}, held_out boolean, {SCORES}")


def train_and_score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return score(docs, train(docs.filter(~held_out()).select(text_of().alias("text")), order))
