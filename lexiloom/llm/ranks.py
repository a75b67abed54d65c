"""Ranks inside groups of any size, without ever gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import md5_int, with_counts

#: Rows of one (group, size) are cut into their root over this many blocks: blocks and the rows of a
#: block grow alike.
BLOCK_ROOT = 4


def ranked(df: DataFrame, group: str, size: str, key: str, descending: bool = False, rank: str = "rank") -> DataFrame:
    """Add ``rank`` (from 1) of each row in its ``group`` by (size, md5(key), key).

    A group is cut into blocks by size and, where many rows share a size, by leading bits of
    md5(key). Counts come from salted partial sums, a window over the few block
    rows of a group gives each block its offset, and a second window ranks rows inside a block.
    Rows that tie in every key are interchangeable. Null groups form a group of their own. All columns of ``df``
    stay, whatever they are called (one named like ``rank`` is replaced).
    """
    cols = [c for c in df.columns if c != rank]
    left = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(group).alias("_g"), F.col(size).alias("_s"), F.col(key).alias("_key"))
    left = left.withColumn("_h", md5_int(F.col("_key")))
    blocks = F.greatest(F.lit(1), F.ceil(F.sqrt("_same") / BLOCK_ROOT)).cast("bigint")
    a = with_counts(left, ["_g", "_s"], "_h", "_same").withColumn("_b", F.floor(F.col("_h") * blocks / F.lit(1 << 28)).cast("bigint")).drop("_same")
    counts = a.groupBy("_g", "_s", "_b").agg(F.count("*").alias("_n"))
    order = [F.col("_s").desc() if descending else F.col("_s"), F.col("_b")]
    w = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g", "_s", "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_g", "_s", "_b").orderBy("_h", F.md5(F.coalesce(F.col("_key").cast("string"), F.lit("")).cast("binary")), "_key")
    local = a.withColumn("_r", F.row_number().over(inside))
    out = local.alias("l").join(offsets.alias("o"), F.expr("l._g <=> o._g and l._s = o._s and l._b = o._b"))
    return out.select(*[F.col("l._row")[c].alias(c) for c in cols], (F.col("o._before") + F.col("l._r")).cast("bigint").alias(rank))
