r"""Operator 4: exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is reduced to one row per
digest, sort-merge anti-joined with the index bucket by bucket, and what is new is
appended.  Equality is of texts with each run of ASCII white space replaced by one space.

Per-digest rows are unique before they meet the index, so no bucket is hot.  Giving every
document its keeper joins documents with the index through shuffles on both sides, which
adaptive execution splits where one digest holds many rows.

Edge cases: null counts as empty; of repeated rows (same doc_id and text) one is kept; a
null doc_id orders after all others; a digest already in the index keeps the document it
names; very long texts are digested whole; extra columns are carried, never read, whatever
their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import SPACE, join_bounded, materialize, text_of
from dialoom.sources.stored import fresh_path

#: digests a bucket holds, about; a bucket is one task of the anti-join
PER_BUCKET = 1_000_000
#: batches of ascending doc_id in which a table enters the index
BATCHES = 2
#: ids that batches are cut by
CUT_IDS = 1000


def normalised():
    return F.regexp_replace(text_of(), SPACE, " ")


class DigestIndex:
    """A table of (digest, keep_id) below ``path``, bucketed and sorted by digest.  The path alone says what
    the index is: beside the data lie its number of buckets and type of ids, so a later job, of whatever
    catalogue, opens it and goes on.  Nothing that lies there is ever written over; ``drop`` deletes it."""

    def __init__(self, spark, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.path = (path or fresh_path(spark, "digest-index")).rstrip("/")
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]

    def exists(self) -> bool:
        """Whether an index lies at the path; if so, this session's catalogue knows it from now on."""
        about = self.about()
        if about is None:
            return False
        self.buckets = about["buckets"]
        self.declare(about["kind"])
        return True

    def about(self):
        try:
            return self.spark.read.schema("buckets int, kind string").json(f"{self.path}/about").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def declare(self, kind: str) -> None:
        location = f"{self.path}/data".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {kind}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'")
        self.spark.catalog.refreshTable(self.name)  # another job may have appended

    def append(self, batch: DataFrame) -> None:
        """Adds rows of ``batch`` (digest, keep_id; digests distinct) whose digest is new, by a sort-merge
        anti-join with the buckets.  The first batch, which must be materialised, sets their number."""
        new = batch.select("digest", "keep_id")
        if self.exists():
            new = new.hint("merge").join(self.spark.table(self.name), "digest", "left_anti")
        else:
            self.buckets = self.buckets or max(16, -(-batch.count() // PER_BUCKET))
            kind = batch.schema["keep_id"].dataType.simpleString()
            self.spark.createDataFrame([(self.buckets, kind)], "buckets int, kind string").coalesce(1).write.mode("error").json(f"{self.path}/about")
            self.declare(kind)
        writer = new.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet")
        writer.saveAsTable(self.name)

    def rows(self) -> DataFrame:
        if not self.exists():
            raise ValueError(f"no index at {self.path}")
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Deletes the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def digests(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, copies): equal rows counted, written once."""
    own = docs.select(F.unhex(F.sha2(normalised(), 256)).alias("digest"), "doc_id")
    return materialize(own.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "dedup-digests")


def batches_of(rows: DataFrame, n: int) -> list[DataFrame]:
    """``rows`` in ``n`` ranges of ascending doc_id, nulls last.  Cuts come from ``CUT_IDS`` ids of least hash, so
    ids may be of any type that has an order; they settle the sizes of batches, never the result."""
    ids = rows.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CUT_IDS)
    ids = ids.agg(F.array_sort(F.collect_list("doc_id")).alias("s"))
    at = ids.select(*[F.get("s", F.floor(F.size("s") * (k / n)).cast("int")).alias(f"cut{k}") for k in range(1, n)]).first() if n > 1 else None
    if not at or at[0] is None:
        return [rows]
    cuts = sorted(set(at))
    place = F.col("doc_id").isNull().cast("int") * len(cuts)
    for cut in cuts:
        place = place + F.when(F.col("doc_id") > F.lit(cut), 1).otherwise(0)
    return [rows.filter(F.least(place, F.lit(len(cuts))) == k) for k in range(len(cuts) + 1)]


def dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(per document and text: digest, doc_id, copies, keep_id, group_size; per digest: the same counts).

    ``docs`` enters ``index`` (one of its own by default, dropped again) in batches of ascending
    doc_id: each is reduced to its distinct digests, meets the index, and leaves there what is
    new, with its least doc_id.  Keepers are what the index says."""
    mine = index or DigestIndex(docs.sparkSession)
    own = digests(docs)
    for batch in batches_of(own, batches):
        mine.append(materialize(batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), "dedup-batch"))
    sizes = own.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    settled = sizes.hint("merge").join(mine.rows(), "digest").select("digest", "group_size", "keep_id")
    settled = materialize(settled, "dedup-settled")
    if index is None:
        mine.drop()
    return own.join(settled, "digest"), settled


def row_key() -> Column:
    """A document and its text, told apart by 256 bits."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.hex("_digest")), 256)


def dedup_report(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """A row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    found, _ = dedup(docs, index)
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def kept_documents(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    found, _ = dedup(docs, index)
    found = materialize(found.select("digest", "doc_id", "copies", (~F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("goes")), "dedup-kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text", F.col("doc_id").alias("_id"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2(normalised(), 256))).drop("text")
    rows = rows.withColumn("_k", row_key())
    gone = found.filter("goes").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).withColumn("_k", row_key())
    out = join_bounded(rows, materialize(gone.select("_k").distinct(), "dedup-goes"), ["_k"], "left_anti")
    if found.filter("copies > 1 and not goes").limit(1).count():  # repeated rows: keep one of each
        out = out.dropDuplicates(["_k"])
    return out.select("_doc.*")
