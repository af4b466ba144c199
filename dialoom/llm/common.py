"""Helpers that several operators of this subpackage share.

Words are maximal runs of characters other than ASCII white space (space, tab
to carriage return) throughout.  Nothing here collects rows of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.sources.stored import stored

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

#: Rows up to which a materialised table may be broadcast; its rows are narrow.
BROADCAST_ROWS = 100_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and
    a lost executor costs nothing but a re-read."""
    return stored(df, name)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns: extra columns of an input can't clash with working names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def join_bounded(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join a materialised table: broadcast if its counted rows are within ``bound``, else a
    shuffled join of which adaptive execution splits hot keys."""
    small = dim.count() <= bound
    return df.join(F.broadcast(dim) if small else dim, list(on), how)


def running_offsets(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Exclusive prefix sums of ``value`` within ``group`` over a fixed pseudorandom order.

    Rows are dealt to about sqrt(n) buckets by a hash of ``order``; the window inside a
    bucket and the window over bucket totals each see about sqrt(n) rows even if one
    group holds every row.  ``df`` must be materialised and ``group`` not null.
    """
    buckets = max(1, math.isqrt(df.count()))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*group, "_bucket"]
    totals = dealt.groupBy(*keys).agg(F.sum(value).alias("_total"))
    over_buckets = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*keys, F.coalesce(F.sum("_total").over(over_buckets), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(base, keys).withColumn(out, F.col("_base") + F.col("_own")).drop("_bucket", "_base", "_own")
