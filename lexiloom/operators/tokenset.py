"""Candidate token tables: filtering, union, completion, statistics, independence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytestrings import FILTERS, filter_reason, suffix_prefix_overlap


def with_reasons(tokens: DataFrame, token: str = "token") -> DataFrame:
    return tokens.withColumn("reason", filter_reason(F.col(token)))


def kept(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Single bytes are always kept; other tokens if no filter names a reason."""
    return with_reasons(tokens, token).filter((F.length(token) == 1) | F.col("reason").isNull()).drop("reason")


def filter_stats(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(reason, n) with a row for every filter and ``kept``; the reasons part the tokens."""
    names = tokens.sparkSession.createDataFrame([(name,) for name, _ in FILTERS] + [("kept",)], "reason string")
    n = with_reasons(tokens, token).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return names.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def single_bytes(spark: SparkSession) -> DataFrame:
    """The base table: every byte as a token."""
    return spark.range(256).select(F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token"))


def union_complete(*tables: DataFrame, token: str = "token") -> DataFrame:
    """(token_id, len, token): all distinct tokens and every missing byte, by length and bytes.

    token_id counts from 0 in that order; offsets come from counts by length, so only equal lengths
    are ranked together.
    """
    x = tables[0].select(F.col(token).alias("token"))
    for t in tables[1:]:
        x = x.unionByName(t.select(F.col(token).alias("token")))
    x = x.distinct()
    missing = single_bytes(x.sparkSession).join(x, "token", "left_anti")
    return numbered(x.unionByName(missing).withColumn("len", F.length("token")))


def numbered(tokens: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    before = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, -1)
    offset = tokens.groupBy("len").agg(F.count("*").alias("_n")).select("len", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("len").orderBy("token")
    x = tokens.withColumn("_r", F.row_number().over(inside) - 1).join(offset, "len")
    return x.select((F.col("_o") + F.col("_r")).cast("bigint").alias("token_id"), "len", "token")


def length_histogram(tokens: DataFrame) -> DataFrame:
    """(len, n, share): share in percent of all tokens."""
    from pyspark.sql import Window

    h = tokens.groupBy("len").agg(F.count("*").alias("n"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return h.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(whole))


def top_tokens(tokens: DataFrame, n: int = 50, least: int = 0, length: int | None = None) -> DataFrame:
    """The n most frequent tokens with a count of ``least`` or more (of one length), ties to the smaller bytes."""
    x = tokens.filter(F.col("n") >= least)
    x = x if length is None else x.filter(F.col("len") == length)
    return x.orderBy(F.desc("n"), "token").limit(n)


def summary(tokens: DataFrame) -> DataFrame:
    """One row: tokens, largest, least, summed and mean count."""
    return tokens.agg(F.count("*").alias("n_tokens"), F.max("n").alias("max_count"), F.min("n").alias("min_count"), F.sum("n").cast("bigint").alias("sum_count"), F.avg("n").alias("mean_count"), F.sum((F.col("len") > 1).cast("bigint")).alias("n_multi_byte"))


#: Accepted tokens that ``conflicts`` compares every candidate with, at most.
MOST_ACCEPTED = 10_000


def conflicts(candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """Candidates with whether some accepted token contains, is contained in, or overlaps them at an end.

    The accepted tokens of a step (a few dozen) are sent to every task and compared with each candidate, so their number
    is checked: over MOST_ACCEPTED is an error. Equal tokens conflict too.
    """
    if accepted.limit(MOST_ACCEPTED + 1).count() > MOST_ACCEPTED:
        raise ValueError(f"conflicts compares with {MOST_ACCEPTED} accepted tokens at most")
    a = accepted.select(F.col("token").alias("other"))
    x = candidates.join(a, F.expr("contains(other, token) or contains(token, other)") | suffix_prefix_overlap(F.col("token"), F.col("other")) | suffix_prefix_overlap(F.col("other"), F.col("token")), "left_semi")
    return candidates.join(x.select("token").withColumn("conflict", F.lit(True)).distinct(), "token", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def independent(candidates: list[bytes], most: int) -> list[bytes]:
    """Accept in order up to ``most`` tokens, stopping at the first that conflicts with one accepted."""
    taken: list[bytes] = []
    for c in candidates:
        if len(taken) >= most or any(c in t or t in c or _ends_meet(c, t) or _ends_meet(t, c) for t in taken):
            break
        taken.append(c)
    return taken


def _ends_meet(a: bytes, b: bytes) -> bool:
    return any(b.startswith(a[-k:]) for k in range(1, min(len(a), len(b))))


def file_order(files: DataFrame, name: str = "name") -> DataFrame:
    """Files by the number before their first extension: set_10.bin after set_9.bin."""
    return files.orderBy(file_number(name), name)


def file_number(name: str = "name"):
    return F.regexp_extract(name, r"_(\d+)\.", 1).try_cast("int")


def differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two manifests hold the same rows, repeats counted."""
    left, right = a.exceptAll(b).limit(1), b.exceptAll(a).limit(1)
    return left.unionByName(right).agg((F.count("*") == 0).alias("valid"))


def consistent(metadata: DataFrame) -> DataFrame:
    """One row: whether all tables' metadata tell the same number of files and the same seed."""
    return metadata.agg(((F.countDistinct("file_count") <= 1) & (F.countDistinct("hash_seed") <= 1)).alias("consistent"))


def samples(tokens: DataFrame, by: str = "len", token: str = "token") -> DataFrame:
    """The first token of each length, by bytes."""
    return tokens.groupBy(by).agg(F.min(token).alias(token))
