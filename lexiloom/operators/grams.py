"""Byte n-grams: counts, the most frequent ones of each length, non-overlapping counts, sketches.

A corpus is a DataFrame with a BINARY column. Texts shorter than the length give no grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytestrings import latin1
from ..session import written

#: Bytes of one numpy pass.
PIECE = 1 << 19


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _packed(data: np.ndarray, off: np.ndarray, n: int):
    """(values, counts) of n-byte windows inside rows, n <= 8, packed big-endian into 64 bits."""
    parts = []
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE + n - 1].astype(np.uint64)
        m = len(part) - n + 1
        if m <= 0:
            continue
        x = np.zeros(m, np.uint64)
        for k in range(n):
            x = (x << np.uint64(8)) | part[k : k + m]
        inside = np.ones(m, bool)
        ends = off[1:-1]
        for e in ends[(ends > a) & (ends < a + m + n)]:  # windows over the end of a row
            inside[max(0, e - a - n + 1) : max(0, e - a)] = False
        parts.append(np.unique(x[inside], return_counts=True))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    v, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    o = np.argsort(v, kind="stable")
    v = v[o]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
    return v[first], np.add.reduceat(c[o], first) if len(first) else np.zeros(0, np.int64)


def _wide(data: np.ndarray, off: np.ndarray, n: int):
    """(rows of n bytes, counts) for longer windows."""
    from numpy.lib.stride_tricks import sliding_window_view

    tally: dict[bytes, int] = {}
    for a, b in zip(off[:-1], off[1:], strict=True):
        for lo in range(a, b - n + 1, PIECE // n + 1):
            w = sliding_window_view(data[lo : min(b, lo + PIECE // n + n)], n)
            v, c = np.unique(np.ascontiguousarray(w).view(f"V{n}").ravel(), return_counts=True)
            for x, k in zip(v.tolist(), c.tolist(), strict=True):
                tally[x] = tally.get(x, 0) + k
    return tally


def gram_counts(corpus: DataFrame, lengths: list[int], data: str = "data") -> DataFrame:
    """(len, gram, n): overlapping occurrences of every byte string of the given lengths.

    Each task counts its windows by batch in numpy and sends one row for each distinct gram; Spark adds them up. Grams of up to
    eight bytes travel and are added up as whole numbers, and become bytes at the end.
    """
    out = None
    for few in (True, False):
        some = [n for n in lengths if (n <= 8) == few]
        if some:
            x = _packed_counts(corpus, some, data) if few else _wide_counts(corpus, some, data)
            out = x if out is None else out.unionByName(x)
    return out if out is not None else corpus.sparkSession.createDataFrame([], "len int, gram binary, n bigint")


#: Bytes of texts whose grams a task counts together; a longer text stands alone.
TEXTS = 8 << 20


def _packed_counts(corpus: DataFrame, lengths: list[int], data: str) -> DataFrame:
    from .matching import row_slices

    def run(batches):
        for batch in batches:
            b, off = flat(batch.column(0))
            for x, y in row_slices(off, TEXTS):
                part, o = b[off[x] : off[y]], off[x : y + 1] - off[x]
                for n in lengths:
                    v, c = _packed(part, o, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), n, np.int32)), pa.array(v.view(np.int64)), pa.array(c, pa.int64())], ["len", "v", "n"])

    sums = corpus.select(data).mapInArrow(run, "len int, v bigint, n bigint").groupBy("len", "v").agg(F.sum("n").alias("n"))
    return sums.select("len", F.unhex(F.lpad(F.hex("v"), F.col("len") * 2, F.lit("0"))).alias("gram"), "n")


def _wide_counts(corpus: DataFrame, lengths: list[int], data: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            b, off = flat(batch.column(0))
            for n in lengths:
                tally = _wide(b, off, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tally), n, np.int32)), pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["len", "gram", "n"])

    return corpus.select(data).mapInArrow(run, "len int, gram binary, n bigint").groupBy("len", "gram").agg(F.sum("n").alias("n"))


def gram_counts_sql(corpus: DataFrame, length: int, data: str = "data") -> DataFrame:
    """The same by expressions alone, for one length."""
    starts = F.sequence(F.lit(1), F.length(data) - length + 1)
    grams = corpus.filter(F.length(data) >= length).select(F.explode(F.transform(starts, lambda i: F.substring(F.col(data), i, F.lit(length)))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).select(F.lit(length).alias("len"), "gram", "n")


#: Ranks up to here come from one window: its tasks keep no more than so many rows of each length.
FEW = 1000


def top_grams(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent grams of each length, ties to the smaller bytes.

    A large k is not ranked by one task a length: grams fall into blocks of equal (length, count, first two bytes),
    running sums over the blocks' sizes tell which can hold the first k, and ranks are counted inside these.
    """
    if k <= FEW:
        w = Window.partitionBy("len").orderBy(F.desc("n"), F.asc("gram"))
        return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    x = written(counts.withColumn("_h", F.substring("gram", 1, 2)), "gram-counts")
    sizes = x.groupBy("len", "n", "_h").agg(F.count("*").alias("_m"))
    w = Window.partitionBy("len").orderBy(F.desc("n"), F.asc("_h")).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("_o", F.coalesce(F.sum("_m").over(w), F.lit(0))).filter(F.col("_o") < k).drop("_m")
    inside = Window.partitionBy("len", "n", "_h").orderBy("gram")
    x = x.join(first, ["len", "n", "_h"]).withColumn("rank", (F.col("_o") + F.row_number().over(inside)).cast("int"))
    return x.filter(F.col("rank") <= k).select(*counts.columns, "rank")


def top_grams_one(counts: DataFrame, k: int) -> DataFrame:
    """The same for counts of one length: a top-k, no sort of all grams."""
    return counts.orderBy(F.desc("n"), F.asc("gram")).limit(k)


def nonoverlapping(text, token: bytes):
    """Occurrences of ``token`` in a latin-1 view, accepted greedily from the left."""
    t = token.decode("latin-1")
    return (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / F.lit(len(token))


def nonoverlapping_counts(corpus: DataFrame, tokens: list[bytes], data: str = "data") -> DataFrame:
    """(token, n_nonoverlap) of a short list, in one scan with a column for each token."""
    spark = corpus.sparkSession
    if not tokens:
        return spark.createDataFrame([], "token binary, n_nonoverlap bigint")
    view = corpus.select(latin1(F.col(data)).alias("t"))
    sums = view.agg(*[F.coalesce(F.sum(nonoverlapping(F.col("t"), x)), F.lit(0)).cast("bigint").alias(f"c{i}") for i, x in enumerate(tokens)])
    rows = F.array(*[F.struct(F.lit(x).alias("token"), F.col(f"c{i}").alias("n_nonoverlap")) for i, x in enumerate(tokens)])
    return sums.select(F.inline(rows))


def top_grams_with_nonoverlap(corpus: DataFrame, length: int, k: int, data: str = "data") -> DataFrame:
    """(gram, n_total, n_nonoverlap) of the k most frequent grams of one length; k rows reach the driver."""
    top = top_grams_one(gram_counts(corpus, [length], data), k).collect()
    spark = corpus.sparkSession
    totals = spark.createDataFrame([(bytes(r["gram"]), r["n"]) for r in top], "gram binary, n_total bigint")
    other = nonoverlapping_counts(corpus, [bytes(r["gram"]) for r in top], data)
    return totals.join(other, totals["gram"] == other["token"]).select("gram", "n_total", "n_nonoverlap")


def miner(corpus: DataFrame, lengths: list[int], k: int, data: str = "data") -> DataFrame:
    """The top-K miner: (len, gram, n_total, n_nonoverlap, rank) of the k most frequent grams of each length.

    Few grams are a dictionary that is sent to the tasks; with more than ``Dictionary.MOST`` bytes of them they are joined.
    """
    from .matching import counts_of
    from .tokenset import numbered

    top = written(top_grams(gram_counts(corpus, lengths, data), k).select("len", "gram", F.col("n").alias("n_total"), "rank"), "miner")
    ids = numbered(top.select(F.col("gram").alias("token"), "len")).select(F.col("token_id").cast("int").alias("token_id"), "token")
    keyed = corpus.select(F.monotonically_increasing_id().alias("doc_id"), F.col(data).alias("data"))
    found = counts_of(keyed, ids).select(F.col("token").alias("gram"), "n_nonoverlap")
    return top.join(found, "gram").select("len", "gram", "n_total", "n_nonoverlap", "rank")


def merge_counts(*counts: DataFrame) -> DataFrame:
    """The counts of several corpora added up."""
    x = counts[0]
    for y in counts[1:]:
        x = x.unionByName(y)
    return x.groupBy("len", "gram").agg(F.sum("n").alias("n"))


# ---- approximate counts

#: Slots of one piece of a sketch row.
SLAB = 1 << 12


def _slots(grams: np.ndarray, row: int, width: int, seed: int) -> np.ndarray:
    """The slot of each 64-bit gram hash in one row of a sketch."""
    with np.errstate(over="ignore"):
        x = (grams ^ np.uint64((seed * 1_000_003 + row + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(width)).astype(np.int64)


def _hash_grams(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the n-byte windows inside rows."""
    if n <= 8:
        v, c = _packed(data, off, n)
        return v, c
    tally = _wide(data, off, n)
    raw = np.frombuffer(b"".join(tally), np.uint8).reshape(-1, n).astype(np.uint64)
    h = np.zeros(len(raw), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + raw[:, k] + np.uint64(1)
    return h, np.fromiter(tally.values(), np.int64, len(tally))


def count_min(corpus: DataFrame, length: int, width: int = 1 << 16, depth: int = 10, seed: int = 1, data: str = "data", conservative: bool = True) -> DataFrame:
    """(row, slab, counts): a count-min sketch of the grams of one length; counts holds SLAB slots as 64-bit numbers.

    A task fills one sketch of depth x width slots from its texts and never lists their grams. conservative: only slots
    below a gram's new estimate are raised, inside a task; sketches of tasks are added slot by slot, so an estimate
    is never below the count, and not above that of the plain sketch. The reference size is 2^24 x 10 (1.3 GB a task).
    """

    def run(batches):
        table = np.zeros((depth, width), np.int64)
        for batch in batches:
            h, c = _hash_grams(*flat(batch.column(0)), length)
            at = [_slots(h, r, width, seed) for r in range(depth)]
            low = np.min([table[r][at[r]] for r in range(depth)], 0) + c
            for r in range(depth):
                # slots that several grams of the batch share take their sum, others are raised to the new estimate
                times = np.bincount(at[r], minlength=width)
                plain = times[at[r]] > 1 if conservative else np.ones(len(h), bool)
                table[r] += np.bincount(at[r][plain], c[plain], width).astype(np.int64)
                own = at[r][~plain]
                table[r][own] = np.maximum(table[r][own], low[~plain])
        rows, slabs, parts = [], [], []
        for r in range(depth):
            for k in range(0, width, SLAB):
                if table[r, k : k + SLAB].any():
                    rows.append(r)
                    slabs.append(k // SLAB)
                    parts.append(table[r, k : k + SLAB].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(slabs, pa.int32()), pa.array(parts, pa.binary())], ["row", "slab", "counts"])

    return merge_sketches(corpus.select(data).mapInArrow(run, "row int, slab int, counts binary"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The slot-wise sum of sketches of one size and seed; each slab is added up as it streams by."""
    x = sketches[0]
    for y in sketches[1:]:
        x = x.unionByName(y)

    def add(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for r, s, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(raw, "<i8")
                held[r, s] = held[r, s] + v if (r, s) in held else v
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["row", "slab", "counts"])

    return x.select("row", "slab", "counts").repartition("row", "slab").mapInArrow(add, "row int, slab int, counts binary")


def count_min_estimates(sketch: DataFrame, grams: DataFrame, width: int = 1 << 16, depth: int = 10, seed: int = 1) -> DataFrame:
    """(gram, est): the least slot of each gram; never below its count. Grams of one length meet their slabs by a join."""

    def run(batches):
        for batch in batches:
            raw = batch.column(0).to_pylist()
            n = len(raw[0]) if raw else 0
            data, off = np.frombuffer(b"".join(raw), np.uint8), np.arange(len(raw) + 1) * n
            x = np.zeros(len(raw), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    x = (x << np.uint64(8)) | data[off[:-1] + k] if n <= 8 else x * np.uint64(0x9E3779B97F4A7C15) + data[off[:-1] + k].astype(np.uint64) + np.uint64(1)
            for r in range(depth):
                at = _slots(x, r, width, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(raw), r, np.int32)), pa.array((at // SLAB).astype(np.int32)), pa.array((at % SLAB).astype(np.int32))], ["gram", "row", "slab", "at"])

    asked = grams.select("gram").mapInArrow(run, "gram binary, row int, slab int, at int")

    def spread(batches):
        for batch in batches:
            for r, s, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), r, np.int32)), pa.array(np.full(len(n), s, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64))], ["row", "slab", "at", "n"])

    slots = sketch.select("row", "slab", "counts").mapInArrow(spread, "row int, slab int, at int, n bigint")
    return asked.join(slots, ["row", "slab", "at"]).groupBy("gram").agg(F.min("n").alias("est"))


#: Bytes of a sketch that are sent to every task at most.
MOST_SKETCH = 256 << 20


def survivors(corpus: DataFrame, length: int, least: int, width: int = 1 << 16, depth: int = 10, seed: int = 1, data: str = "data") -> DataFrame:
    """(len, gram, n) of the grams that stand ``least`` times or more, in two passes: a sketch of all grams, then exact counts
    of those whose estimate reaches ``least``. No gram is missed, since estimates are never too low; only survivors are shuffled."""
    if 8 * width * depth > MOST_SKETCH:
        raise ValueError("the sketch is too large to send to every task; use gram_counts")
    table = np.zeros((depth, width), np.int64)
    for r in count_min(corpus, length, width, depth, seed, data).toLocalIterator():
        part = np.frombuffer(r["counts"], "<i8")
        table[r["row"], r["slab"] * SLAB : r["slab"] * SLAB + len(part)] = part
    shipped = corpus.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            b, off = flat(batch.column(0))
            h, c = _hash_grams(b, off, length)
            keep = np.min([shipped.value[r][_slots(h, r, width, seed)] for r in range(depth)], 0) >= least
            if length <= 8:
                raw = h[keep].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - length :].tobytes()
                gram = pa.Array.from_buffers(pa.binary(length), int(keep.sum()), [None, pa.py_buffer(raw)]).cast(pa.binary())
            else:
                gram = pa.array([g for g, k in zip(_wide(b, off, length), keep.tolist(), strict=True) if k], pa.binary())
            yield pa.RecordBatch.from_arrays([gram, pa.array(c[keep], pa.int64())], ["gram", "n"])

    counts = corpus.select(data).mapInArrow(run, "gram binary, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least).select(F.lit(length).alias("len"), "gram", "n")


def save_sketch(sketch: DataFrame, path: str, **about) -> None:
    """Write a sketch with its width, depth, seed and length as Parquet; ``load_sketch`` gives both back."""
    x = sketch
    for name, value in about.items():
        x = x.withColumn(f"about_{name}", F.lit(int(value)))
    x.write.mode("overwrite").parquet(path)


def load_sketch(spark, path: str) -> tuple[DataFrame, dict]:
    x = spark.read.parquet(path)
    names = [c for c in x.columns if c.startswith("about_")]
    first = x.select(*names).first() if names else None
    return x.select("row", "slab", "counts"), {c.removeprefix("about_"): first[c] for c in names} if first else {}


def sketch_error(estimates: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, n, est, error): error in percent, 0 for a count of 0."""
    x = counts.join(estimates, "gram")
    return x.select("gram", "n", "est", F.when(F.col("n") == 0, 0.0).otherwise(F.abs(F.col("est") - F.col("n")) / F.col("n") * 100).alias("error"))


def weighted_strings(strings: DataFrame) -> DataFrame:
    """Add up the frequencies of equal (length, content), in the order of length and falling frequency."""
    return strings.groupBy("length", "content").agg(F.sum("frequency").cast("bigint").alias("frequency")).orderBy("length", F.desc("frequency"), "content")
