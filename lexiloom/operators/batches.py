"""Token streams: documents, shards, training batches, attention blocks and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

EOT = 50256


def document_ids(stream: DataFrame, shard: str = "shard", pos: str = "pos", eot: int = EOT) -> DataFrame:
    """doc: the running count of separators of the shard up to each token, itself included."""
    w = Window.partitionBy(shard).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("doc", F.sum((F.col("token_id") == eot).cast("int")).over(w))


def documents(stream: DataFrame, shard: str = "shard", pos: str = "pos", eot: int = EOT) -> DataFrame:
    """(shard, doc, n_tokens, token_ids): the tokens between separators; runs of separators make no empty documents."""
    x = document_ids(stream, shard, pos, eot).filter(F.col("token_id") != eot)
    x = x.groupBy(shard, "doc").agg(F.array_sort(F.collect_list(F.struct(pos, "token_id"))).alias("t"))
    return x.select(shard, "doc", F.size("t").alias("n_tokens"), F.col("t.token_id").alias("token_ids"))


def next_tokens(stream: DataFrame, shard: str = "shard", pos: str = "pos", last: int = -100) -> DataFrame:
    """label: the next token of the shard; the last has ``last``."""
    return stream.withColumn("label", F.coalesce(F.lead("token_id").over(Window.partitionBy(shard).orderBy(pos)), F.lit(last)))


def end_offsets(stream: DataFrame, shard: str = "shard", pos: str = "pos", n_bytes: str = "n_bytes", eot: int = EOT) -> DataFrame:
    """end_offset: bytes of the shard up to each token's end; separators show 0 and neither add nor reset."""
    sep = F.col("token_id") == eot
    w = Window.partitionBy(shard).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("end_offset", F.when(sep, F.lit(0)).otherwise(F.sum(F.when(sep, F.lit(0)).otherwise(F.col(n_bytes))).over(w)).cast("bigint"))


def global_offsets(docs: DataFrame, order: str, size: str, rows_at_once: int = 1 << 18) -> DataFrame:
    """offset: the summed size of all rows before each, by ``order`` and size, nulls of the order first, without one task over all.

    Rows are dealt to ranges of about ``rows_at_once`` rows by sampled quantiles of (order, size, hash), so clustered or
    repeated values make no large range, and written with the number of their range; sums by range give each
    range its offset, and a window inside the range the rest. Rows that tie in order and size are interchangeable.
    """
    n = max(1, -(-docs.count() // rows_at_once))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    x = docs.withColumn("_t", tie).repartitionByRange(n, F.asc_nulls_first(order), F.col(size), F.col("_t"))
    x = written(x.withColumn("_b", F.spark_partition_id()), "ranges")
    sums = x.groupBy("_b").agg(F.sum(size).alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_b").orderBy(F.asc_nulls_first(order), size, "_t").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_i", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(before, "_b")  # one row a range
    return x.withColumn("offset", (F.col("_o") + F.col("_i")).cast("bigint")).drop("_b", "_i", "_o", "_t")


def shard_pieces(docs: DataFrame, shard_size: int, size: str = "n_tokens") -> DataFrame:
    """Documents with an offset, cut where shards end: shard, split (the first is for validation), from, to, at."""
    first, last = F.floor(F.col("offset") / shard_size), F.floor((F.col("offset") + F.col(size) - 1) / shard_size)
    x = docs.filter(F.col(size) > 0).withColumn("shard", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    start = F.greatest(F.col("offset"), F.col("shard").cast("bigint") * shard_size)
    end = F.least(F.col("offset") + F.col(size), (F.col("shard").cast("bigint") + 1) * shard_size)
    return x.withColumns({"split": F.when(F.col("shard") == 0, "val").otherwise("train"), "from": start - F.col("offset"), "to": end - F.col("offset"), "at": start - F.col("shard").cast("bigint") * shard_size})


def training_batches(lengths: DataFrame, batch: int, ranks: int = 1, shard: str = "shard", size: str = "n_tokens") -> DataFrame:
    """(shard, batch, rank, from, to): windows of ``batch`` tokens and one more for the labels, in equal slices.

    A shard's tail that is shorter than a batch and its label is dropped.
    """
    n = F.floor((F.col(size) - 1) / batch).cast("int")
    x = lengths.filter(n > 0).select(shard, F.explode(F.sequence(F.lit(0), n - 1)).alias("batch")).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    local = batch // ranks
    start = F.col("batch").cast("bigint") * batch + F.col("rank") * local
    return x.withColumns({"from": start, "to": start + local + 1})


def wrapped(position: Column, total: int) -> tuple[Column, Column]:
    """Epoch and place of an endless cursor over ``total`` tokens."""
    return F.floor(position / total), position % total


def blocks(stream: DataFrame, block: int = 128, shard: str = "shard", pos: str = "pos") -> DataFrame:
    """(shard, b, lo, hi): the least and largest document of each whole block of a stream with ``doc``."""
    x = stream.groupBy(shard, F.floor(F.col(pos) / block).cast("int").alias("b")).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("_n"))
    return x.filter(F.col("_n") == block).drop("_n")


def block_mask(table: DataFrame, shard: str = "shard") -> DataFrame:
    """(shard, q, k, full): key blocks that a query block sees, causal and sharing a document; full: all of it.

    Documents follow each other, so an earlier block shares a document with a later one exactly if its last document
    is the later one's first: an equality join on (shard, document), besides each block with itself.
    """
    own = table.select(shard, F.col("b").alias("q"), F.col("b").alias("k"), F.lit(False).alias("full"))
    q = table.select(shard, F.col("lo").alias("doc"), F.col("b").alias("q"), (F.col("hi") == F.col("lo")).alias("_q"))
    k = table.select(shard, F.col("hi").alias("doc"), F.col("b").alias("k"), (F.col("hi") == F.col("lo")).alias("_k"))
    return own.unionByName(q.join(k, [shard, "doc"]).filter("q > k").select(shard, "q", "k", (F.col("_q") & F.col("_k")).alias("full")))


def sliding_blocks(mask: DataFrame, window: int, shard: str = "shard") -> DataFrame:
    """The latest window - 1 full blocks of each query block and its latest max(window - full, 1) partial ones."""
    w = Window.partitionBy(shard, "q", "full").orderBy(F.desc("k"))
    n = F.sum(F.col("full").cast("int")).over(Window.partitionBy(shard, "q"))
    x = mask.withColumns({"_r": F.row_number().over(w), "_n": n})
    keep = F.when(F.col("full"), F.col("_r") <= window - 1).otherwise(F.col("_r") <= F.greatest(window - F.col("_n"), F.lit(1)))
    return x.filter(keep).drop("_r", "_n")


# ---- schedules


def next_multiple(x, n: int) -> Column:
    """The least multiple of n that is not below x, n at least."""
    return (F.greatest(F.ceil(x / n), F.lit(1)) * n).cast("int")


def learning_rate(step, steps: int, cooldown: float = 0.4) -> Column:
    """1, then over the last share of the steps linearly down towards 0.1."""
    x = step / F.lit(float(steps))
    w = (1 - x) / cooldown
    return F.when(x < 1 - cooldown, F.lit(1.0)).otherwise(w + (1 - w) * 0.1)


def warm_learning_rate(step, steps: int, warm_up: int, warm_down: int) -> Column:
    """Linear up over the first steps, flat, linear down to 0 over the last ones."""
    return F.when(step < warm_up, (step + 1) / F.lit(float(warm_up))).when(step < steps - warm_down, F.lit(1.0)).otherwise((steps - step) / F.lit(float(warm_down)))


def window_blocks(step, steps: int, most: int = 1728, block: int = 128) -> Column:
    """Attention window in blocks: grows linearly over the steps."""
    return F.floor(next_multiple(F.lit(float(most)) * step / F.lit(float(steps)), block) / block).cast("int")


def momentum(step, warm: int = 300, low: float = 0.85, high: float = 0.95) -> Column:
    f = F.least(step / F.lit(float(warm)), F.lit(1.0))
    return (1 - f) * low + f * high


# ---- rolling samples


def cursor_sample(docs: DataFrame, ordinal: str, start: int, n: int, total: int) -> DataFrame:
    """The next n documents from a place of an endless pass over ``total``; turn counts full passes."""
    place = F.pmod(F.col(ordinal) - F.lit(start % total), F.lit(total))
    rounds = F.floor((F.lit(n - 1) - place) / total)
    return docs.filter(place < n).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), rounds)))


def dummy_tokens(spark, n: int, seed: int = 0, most: int = 50_000) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.floor(F.rand(seed) * most).cast("int").alias("token_id"))
