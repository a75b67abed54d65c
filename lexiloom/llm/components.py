"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import with_group, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a bigint, b bigint) but the roots themselves; root is
    the least node of its component.

    Every round hangs each node's larger neighbours, then its smaller ones, on the least of them, and
    is written to the shared folder; rounds end when nothing changes, which the algorithm reaches in
    a number that grows with the logarithm of the nodes. The least neighbour of a hot node comes from
    salted partial minima, and only a count and a checksum reach the driver. Loops and repeats in ``edges`` do no harm.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").distinct()

    def least(e: DataFrame) -> DataFrame:
        return with_group(e, ["a"], "b", "m", F.min("b"), F.min("_n"))

    e, last = written(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "components"), None
    while True:
        both = least(e.union(e.select("b", "a"))).select("a", "b", F.least("a", "m").alias("m"))
        large = tidy(both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # the smaller neighbours of a node, and the node itself, hang on the least of them
        small = least(large).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        e = written(tidy(small), "components")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
