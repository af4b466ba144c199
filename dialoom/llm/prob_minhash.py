"""Operator 5: near-duplicates by ProbMinHash, banding and exact verification.

1. Texts of equal word sequences become one class each; only classes go on.
2. A class's shingles (five words; of a shorter text, all its words) are a set, each of
   weight one, as in the similarity that is verified: weights by count would make texts that
   repeat a passage look less alike than their sets are.  Each shingle is a Poisson process
   of rate equal to its weight; an arrival at time t falls into a uniform register, and a
   register keeps the shingle of its earliest arrival.  Arrivals later than a text's latest
   register stop early.  Two registers agree with the Jaccard similarity of the sets.
3. ``BANDS`` bands of ``ROWS`` registers give buckets.  A bucket picks its best connected
   member as pivot and pairs it with the rest.  Texts of buckets that still span components are gathered into
   clusters of overlapping buckets and held against their cluster's most central text, whole sets
   against whole sets; ``beyond_pivot`` pairs just those that can still reach the threshold.
4. Pairs are verified on their whole shingle sets (Jaccard of at least 0.8), and components
   of the verified links are the classes.  Pairs with pivots whose registers agree too little
   are put off: what they leave unjoined goes to the last turn, whose pairs are all verified.

Recall of banding at similarity 0.8 is 1 - (1 - 0.8^5)^24 = 0.9999 per pair, repeats or not;
nothing after banding loses a class.

Shingling and the sketch run in numpy on Arrow batches, all else is DataFrame code.
Edge cases: null is an empty text; empty texts form one class; repeated rows share a
class; ids need not be unique; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.llm.common import SPACE, join_bounded, materialize, text_of
from dialoom.llm.components import components

SHINGLE, BANDS, ROWS = 5, 24, 5
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
#: least share of agreeing registers of a pair that is verified before the last turn: four deviations below 0.8
AGREE = 0.64
CHUNK = 100_000

SKETCH = "digest binary, n_shingles int, bands array<bigint>, sig binary"


def digest_of(text: Column) -> Column:
    """Digest of the word sequence."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(text, SPACE, " ")), 256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of all shingles, repeats included; of under five words, one for all of them."""
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out += hashed[k : len(out) + k] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
    out = mixed(out)
    out.sort()
    return out


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (n, m) of ``n`` weighted sets laid end to end: the element whose arrival is earliest.

    Randomness depends on the element and the arrival's number alone.
    """
    best = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    latest = np.full(n, np.inf)
    at = np.zeros(len(elements))
    alive = np.arange(len(elements))
    turn = 0
    while len(alive):
        e = elements[alive]
        bits = mixed(e + np.uint64((0x9E3779B97F4A7C15 * (2 * turn + 1)) & 0xFFFFFFFFFFFFFFFF))
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))
        at[alive] += gap / weights[alive]
        own, when = owner[alive], at[alive]
        live = when < latest[own]
        alive, own, when, e, bits = alive[live], own[live], when[live], e[live], bits[live]
        slot = own * m + (mixed(bits + np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, slot, when)
        won = best[slot] == when
        who[slot[won]] = e[won]
        latest = best.reshape(n, m).max(axis=1)
        turn += 1
    return who.reshape(n, m)


def words_by_row(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """Words of each row's text (column 1): bytes split at ASCII white space alone."""
    for text in batch.column(1):
        yield (text.as_buffer().to_pybytes() if text.is_valid else b"").split()


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row's id, digest and sketch; a text without words has no bands."""
    with np.errstate(over="ignore"):
        for batch in batches:
            begin, digests, lists, held = 0, [], [], 0
            for i, words in enumerate(words_by_row(batch)):
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                lists.append(shingles(words))
                held += len(lists[-1])
                if held >= CHUNK or i + 1 == batch.num_rows:
                    yield sketch_chunk(batch.column(0).slice(begin, len(lists)), digests, lists)
                    begin, digests, lists, held = i + 1, [], [], 0


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and whole set of shingles of each row."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for words in words_by_row(batch):
                held = np.unique(shingles(words)).view(np.int64)
                cells = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(held))
                yield pa.record_batch([pa.array([hashlib.sha256(b" ".join(words)).digest()], pa.binary()), cells], names=["digest", "set"])


def sketch_chunk(ids: pa.Array, digests: list[bytes], lists: list[np.ndarray]) -> pa.RecordBatch:
    n = len(ids)
    f = np.concatenate(lists)
    o = np.repeat(np.arange(n), [len(x) for x in lists])
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
    elements, owner = f[new], o[new]
    who = prob_minhash(elements, np.ones(len(elements)), owner, n)
    bands = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        bands = mixed(bands * np.uint64(31) + who[:, r::ROWS] + np.uint64(r + 1))
    bands = mixed(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    sizes = np.bincount(owner, minlength=n).astype(np.int32)
    offsets = pa.array(np.concatenate(([0], np.cumsum((sizes > 0) * BANDS))).astype(np.int32))
    bands = bands[sizes > 0]
    sig = (who & np.uint64(0xFFFF)).astype("<u2")
    return pa.record_batch(
        [
            ids,
            pa.array(digests, pa.binary()),
            pa.array(sizes),
            pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())),
            pa.array([x.tobytes() for x in sig], pa.binary()),
        ],
        names=["doc_id", "digest", "n_shingles", "bands", "sig"],
    )


def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose registers agree enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, REGISTERS) for k in (2, 3))
            keep = (a == b).mean(axis=1) >= AGREE
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets have a Jaccard similarity of the threshold or more."""
    left = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.withColumn("shared", shared)
    return both.filter(F.col("shared") >= F.lit(THRESHOLD) * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")


def spanning(members: DataFrame, degrees: DataFrame) -> DataFrame | None:
    """(bucket, p) of the buckets that span components, or None; p: the best connected member."""
    pivot = F.max_by(F.struct("cid", "root", "n_shingles"), F.struct("degree", "cid")).alias("p")
    spans = members.join(degrees, "cid").groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), pivot).filter("lo <> hi")
    spans = materialize(spans.select("bucket", "p"), "near-spans")
    return None if spans.isEmpty() else spans


def pivot_pairs(members: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's pivot and its members of other components."""
    alike = "root <> p.root and 10 * least(n_shingles, p.n_shingles) >= 8 * greatest(n_shingles, p.n_shingles)"
    return members.join(spans, "bucket").filter(alike).select(F.least("cid", "p.cid").alias("a"), F.greatest("cid", "p.cid").alias("b")).distinct()


def beyond_pivot(members: DataFrame, spans: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with pivots, further pairs to test) among buckets that span components.

    Let P be the pivot of a cluster of overlapping buckets, k = |A & P| and u = A - P.  Texts
    A and B are alike only if |A & B| >= 4/9 (|A| + |B|), and |A & B| <= min(k) + |uA & uB|.
    So a pair shares at least ceil(0.8 |A|) - kA shingles outside P, for which prefixes of u
    by rising frequency are enough, or both k reach 4/9 (|A| + |B|); the latter pairs are
    alike to P, hence joined, or both smaller than P.  Nothing is left out by this.
    """
    left = members.join(spans, "bucket")
    clusters = components(left.select(F.col("cid").alias("a"), F.col("p.cid").alias("b")).distinct())
    clusters = clusters.select(F.col("id").alias("cid"), F.col("root").alias("cluster"))
    texts = left.select("cid", "root", "n_shingles").distinct().join(clusters, "cid").join(sets, "cid")
    texts = materialize(texts.withColumn("n_shingles", F.size("set")), "near-left")
    # The shingles that half of a cluster's texts have are at most twice a mean text's; the pivot is the text closest to them.
    frequent = texts.select("cluster", F.explode("set").alias("x")).groupBy("cluster", "x").agg(F.count("*").alias("df"))
    sizes = materialize(texts.groupBy("cluster").agg(F.count("*").alias("c")), "near-sizes")
    # Counts stay dealt by (cluster, shingle); only the few that pass are gathered by cluster.
    frequent = materialize(join_bounded(frequent, sizes, ["cluster"]).filter("2 * df >= c").select("cluster", "x"), "near-frequent")
    frequent = frequent.groupBy("cluster").agg(F.collect_list("x").alias("center"))
    central = texts.join(materialize(frequent, "near-centers"), "cluster", "left")
    score = F.coalesce(2 * F.size(F.array_intersect("set", "center")) - F.col("n_shingles"), -F.col("n_shingles"))
    best = materialize(central.select("cluster", "cid", score.alias("score")), "near-scores").groupBy("cluster").agg(F.max_by("cid", F.struct("score", "cid")).alias("pivot"))
    pivots = texts.join(best.select(F.col("pivot").alias("cid")), "cid", "left_semi")
    pivots = materialize(pivots.select("cluster", F.col("cid").alias("pivot"), F.col("root").alias("proot"), F.col("n_shingles").alias("p"), F.col("set").alias("pset")), "near-pivots")
    held = texts.join(pivots, "cluster").withColumn("u", F.array_except("set", "pset"))
    held = held.select("cluster", "cid", "root", "proot", "pivot", "p", "u", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.size("u")).alias("k"))
    held = held.withColumn("near", F.expr(f"k >= {THRESHOLD} * (n + p - k)"))
    held = materialize(held.withColumn("least", F.expr("greatest(1, cast(ceil((8 * n) / 10) as int) - k)")), "near-held")
    links = held.filter("near and root <> proot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b"))
    held = held.withColumn("root", F.expr("if(near, proot, root)"))

    each = held.filter("size(u) >= least").select("cluster", "cid", "root", "n", "least", F.explode("u").alias("x"))
    live = each.groupBy("cluster", "x").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    ranked = each.join(live.select("cluster", "x", "df"), ["cluster", "x"])
    ranked = ranked.withColumn("at", F.row_number().over(W.partitionBy("cid").orderBy("df", "x"))).withColumn("of", F.count("*").over(W.partitionBy("cid")))
    prefix = materialize(ranked.filter("at <= of - least + 1").select("cluster", "x", "cid", "root", "n"), "near-prefix")
    other = prefix.select("cluster", "x", F.col("cid").alias("oid"), F.col("root").alias("oroot"), F.col("n").alias("o"))
    alike = "root <> oroot and 10 * least(n, o) >= 8 * greatest(n, o)"
    shared = prefix.join(other, ["cluster", "x"]).filter(f"cid < oid and {alike}").select(F.col("cid").alias("a"), F.col("oid").alias("b"))

    inner = held.filter("10 * k >= 8 * n").select("cluster", "cid", "root", "n", "k", "p", "near")
    lone = inner.filter("not near").select("cluster", F.col("cid").alias("oid"), F.col("root").alias("oroot"), F.col("n").alias("o"), F.col("k").alias("ok"))
    within = inner.filter("n < p").join(lone, "cluster").filter(f"cid <> oid and {alike} and 9 * least(k, ok) >= 4 * (n + o)")
    within = within.select(F.least("cid", "oid").alias("a"), F.greatest("cid", "oid").alias("b"))
    return links, shared.union(within).distinct()


def likely_pairs(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """The pairs whose registers agree enough."""
    both = pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("ga")), "a")
    both = both.join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("gb")), "b")
    return both.select("a", "b", "ga", "gb").mapInArrow(estimate, "a bigint, b bigint")


def merged_roots(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(id, root) of all links so far: new links are contracted between the roots known before."""
    if roots is None:
        return components(found)
    ends = found
    for end in ("a", "b"):
        known = roots.select(F.col("id").alias(end), F.col("root").alias("_root"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    merged = components(ends)
    moved = roots.join(merged.select(F.col("id").alias("root"), F.col("root").alias("_to")), "root", "left")
    moved = moved.select("id", F.coalesce("_to", "root").alias("root"))
    return materialize(moved.unionByName(merged.join(roots, "id", "left_anti")), "near-roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, text_class, class_size, copies, n_links) per distinct (text, doc_id), copies
    counting repeated rows.  class_id is the least doc_id of the component."""
    read = docs.select("doc_id", text_of().cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    drawn = materialize(read.mapInArrow(sketches, f"doc_id {id_type}, {SKETCH}"), "near-sketches")
    rows = materialize(drawn.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "near-rows")
    texts = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"].alias("rep"), F.sum("copies").alias("n"))
    texts = materialize(texts.withColumn("cid", F.xxhash64("digest")), "near-texts")

    # One row a class goes on: the row of its representative.
    heads = texts.select(F.col("digest").alias("_digest"), "rep", "cid")
    sketched = drawn.filter("n_shingles > 0").join(heads, F.expr("digest = _digest and doc_id <=> rep")).select("cid", "rep", "n_shingles", "bands", "sig")
    repeats = not rows.filter("copies > 1").isEmpty()
    sketched = materialize(sketched.dropDuplicates(["cid"]) if repeats else sketched, "near-classes")

    spread = sketched.select("cid", "n_shingles", F.explode("bands").alias("bucket"))
    full = materialize(spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "near-buckets")
    members = materialize(spread.join(full, "bucket").withColumn("root", F.col("cid")), "near-members")
    degrees = materialize(members.groupBy("cid").agg(F.sum("n").alias("degree")), "near-degrees")
    members = members.drop("n")
    sig = sketched.select("cid", "sig")
    wanted = sketched.join(degrees.select("cid"), "cid", "left_semi").select(F.xxhash64("rep").alias("_k"))
    wanted = materialize(wanted.distinct(), "near-wanted")
    sets = join_bounded(read.withColumn("_k", F.xxhash64("doc_id")), wanted, ["_k"], "left_semi")
    sets = sets.select("doc_id", "text").mapInArrow(shingle_sets, "digest binary, set array<bigint>")
    sets = sets.select(F.xxhash64("digest").alias("cid"), "set").join(degrees.select("cid"), "cid", "left_semi")
    sets = materialize(sets.dropDuplicates(["cid"]) if repeats else sets, "near-sets")

    links = roots = None
    for turn in ("best", "rest"):
        spans = spanning(members, degrees)
        if spans is None:
            break
        if turn == "rest":
            sure, pairs = beyond_pivot(members, spans, sets)
            pairs = materialize(pairs, "near-pairs")
        else:
            sure, pairs = None, materialize(pivot_pairs(members, spans), "near-pairs")
            pairs = materialize(likely_pairs(pairs, sig), "near-likely")
        found = verify(pairs, sets)
        found = materialize(found if sure is None else found.union(sure).distinct(), "near-links")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        roots = merged_roots(roots, found)
        if turn != "rest":
            members = members.drop("root").join(roots.withColumnRenamed("id", "cid"), "cid", "left")
            members = materialize(members.withColumn("root", F.coalesce("root", "cid")), "near-members")

    base = texts
    if links is not None:
        ends = links.select(F.col("a").alias("cid")).union(links.select(F.col("b")))
        counts = ends.groupBy("cid").agg(F.count("*").alias("n_links"))
        base = base.join(roots.withColumnRenamed("id", "cid"), "cid", "left").join(counts, "cid", "left")
    else:
        base = base.withColumn("root", F.lit(None).cast("long")).withColumn("n_links", F.lit(None).cast("long"))
    base = base.select("digest", "rep", "n", F.coalesce("root", "cid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    base = materialize(base, "near-rooted")
    heads = base.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    heads = materialize(heads, "near-heads")
    settled = materialize(base.join(heads, "root").select("digest", "rep", "class_id", "class_size", "n_links"), "near-settled")
    return rows.join(settled, "digest").select("doc_id", "digest", "copies", "class_id", F.col("rep").alias("text_class"), "class_size", "n_links")


def near_report(docs: DataFrame) -> DataFrame:
    """A row per document with its class."""
    found = near_duplicates(docs)
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "class_id", "text_class", "class_size", "n_links", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("_copy") == 1)).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of each class, its least doc_id, with the columns of ``docs``."""
    found = materialize(near_duplicates(docs).select("doc_id", "digest", "copies", "class_id"), "near-kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("_id"), text_of().alias("_text"))
    rows = rows.withColumn("_digest", digest_of(F.col("_text"))).drop("_text")
    rows = rows.withColumn("_k", F.xxhash64("_id", "_digest"))
    goes = found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.xxhash64("doc_id", "digest").alias("_k"), F.col("digest").alias("_digest"))
    out = join_bounded(rows, materialize(goes.distinct(), "near-goes"), ["_k", "_digest"], "left_anti")
    if not found.filter("copies > 1").isEmpty():
        out = out.dropDuplicates(["_k"])
    return out.select("_doc.*")
