"""Operator 1: a quality classifier on random-indexing word vectors with calibrated probabilities.

Random indexing: every token has a sparse ternary index vector drawn from its hash; a token's
context vector is the sum of the index vectors of its left and right neighbours over the whole
corpus. Tokens are runs of letters, of digits or of other marks. A row of the table is chosen by the token's hash;
there are ROOT rows for the root of the number of distinct tokens (ROWS at least), so the vocabulary has no bound,
and the table grows with it, though slowly enough to be sent to every task. A document pools the vectors of its tokens (mean, spread, and the
step between neighbours); a two-layer numpy network scores it, and one temperature fitted on rows it
has not seen calibrates the probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import CHUNK, bound_batches, flat, held_out, slices, span_hashes, table

DIM, NONZERO = 32, 2
#: Rows of the table of vectors: the power of two from ROOT times the root of the distinct tokens on, ROWS at least.
#: A million tokens have 16,384 rows (2 MB), ten billion 2,097,152 (268 MB).
ROWS, ROOT = 8192, 16
SLABS = 64
#: Labelled rows that the network and its temperature are fitted on, at most.
FIT_ROWS = 12_000
HIDDEN, EPOCHS = 32, 60
THRESHOLD = 0.3

_KIND = np.full(256, 3, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token and its row, for rows of bytes."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    return span_hashes(data, starts, ends), np.searchsorted(off, starts, "right") - 1


def bucket(hashes: np.ndarray, rows: int) -> np.ndarray:
    """The table row of each token; ``rows`` is a power of two."""
    return (hashes >> np.uint64(64 - (rows.bit_length() - 1))).astype(np.int64)


def index_vectors(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each table row's index vector."""
    draw = np.random.default_rng(20)
    return draw.integers(0, DIM, (rows, NONZERO)), draw.choice([-1, 1], (rows, NONZERO))


def _pieces(data, off):
    """(a, b, bytes, offsets, goes on) of rows in pieces of about CHUNK bytes. A longer row is cut between tokens;
    the pieces after its first go on from the one before."""
    for a, b in slices(off):
        lo, end = int(off[a]), int(off[b])
        first = True
        while lo < end:
            hi = min(end, lo + 4 * CHUNK)
            if hi < end:  # a row that stands alone
                kind = _KIND[data[lo:hi]]
                change = np.flatnonzero(kind[1:] != kind[:-1])
                if len(change):
                    hi = lo + int(change[-1]) + 1
                else:  # one token: to its end
                    while hi < end and _KIND[data[hi]] == kind[-1]:
                        more = np.flatnonzero(_KIND[data[hi : hi + CHUNK]] != kind[-1])
                        hi = min(end, hi + (int(more[0]) if len(more) else CHUNK))
            yield a, b, data[lo:hi], np.clip(off[a : b + 1] - lo, 0, hi - lo), not first
            lo, first = hi, False


def _tokens(data, off):
    """(a, b, hashes, rows, led) by piece; led: the first token is the last one of the piece before, for its pair only."""
    last = None
    for a, b, part, o, goes_on in _pieces(data, off):
        t, row = tokens(part, o)
        led = goes_on and last is not None
        if not goes_on:
            last = None
        if led:
            t, row = np.concatenate([[last], t]), np.concatenate([[0], row])
        if len(t):
            last = t[-1]
            yield a, b, t, row, led


def table_rows(docs: DataFrame, text: str = "text") -> int:
    """Rows for the tokens of ``docs``, from a distinct count by a mergeable sketch (within 2 %) over every text."""

    def run(batches):
        for batch in batches:
            seen = [np.unique(t) for _, _, t, _, _ in _tokens(*flat(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(seen)).view(np.int64) if seen else [], pa.int64())], ["h"])

    n = docs.select(text).mapInArrow(run, "h bigint").agg(F.approx_count_distinct("h", 0.02)).first()[0]
    return max(ROWS, 1 << int(np.ceil(np.log2(max(1.0, ROOT * np.sqrt(n))))))


def word_vectors(docs: DataFrame, text: str = "text", rows: int | None = None) -> np.ndarray:
    """Unit context vectors of all table rows over every text of ``docs``: rows x DIM.

    Each task sums whole-number tables; slabs of them are summed in two streaming rounds, so no task
    holds more than one table. The driver receives SLABS rows (one table).
    """
    bound_batches(docs.sparkSession)
    rows = rows or table_rows(docs, text)
    per = rows // SLABS

    def count(batches):
        place, sign = index_vectors(rows)
        sums = np.zeros((rows, DIM), np.int64)
        for batch in batches:
            for _, _, t, row, _ in _tokens(*flat(batch.column(0))):
                near = row[1:] == row[:-1]
                u, at = np.unique(bucket(t, rows), return_inverse=True)
                x, y = at[:-1][near], at[1:][near]
                local = np.zeros(len(u) * DIM)
                for k in range(NONZERO):
                    p, s = place[u, k], sign[u, k]
                    for word, other in ((x, y), (y, x)):
                        local += np.bincount(word * DIM + p[other], s[other], len(local))
                sums[u] += np.rint(local).astype(np.int64).reshape(-1, DIM)
        yield out({s: v for s in range(SLABS) if (v := sums[s * per : (s + 1) * per]).any()})

    def out(slabs):
        return pa.RecordBatch.from_arrays([pa.array(list(slabs), pa.int32()), pa.array([v.tobytes() for v in slabs.values()], pa.binary())], ["slab", "sums"])

    def add(batches):
        slabs: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.frombuffer(raw, np.int64)
                slabs[s] = slabs[s] + v if s in slabs else v
        yield out(slabs)

    kind = "slab int, sums binary"
    parts = docs.select(text).mapInArrow(count, kind)
    parts = parts.withColumn("salt", F.spark_partition_id() % 32).repartition("slab", "salt").select("slab", "sums").mapInArrow(add, kind)
    sums = np.zeros((rows, DIM))
    for r in parts.repartition(SLABS, "slab").mapInArrow(add, kind).collect():
        sums[r["slab"] * per : (r["slab"] + 1) * per] += np.frombuffer(r["sums"], np.int64).reshape(per, DIM)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 3 * DIM + 2


def pool(data: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Pooled features of rows of bytes: mean, spread, step between neighbours, log length, share of steps of zero."""
    n = len(off) - 1
    first, second, step = np.zeros((n, DIM)), np.zeros((n, DIM)), np.zeros((n, DIM))
    count, still, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    for a, b, hashes, row, led in _tokens(data, off):
        t = bucket(hashes, len(vectors))
        edge = np.searchsorted(row, np.arange(b - a + 1)).tolist()
        for i, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True), a):
            if x == y:
                continue
            v = vectors[t[x:y]]
            new = v[int(led) :]
            first[i] += new.sum(0, dtype=np.float64)
            second[i] += np.einsum("ij,ij->j", new, new, dtype=np.float64)
            step[i] += np.abs(v[1:] - v[:-1]).sum(0, dtype=np.float64)
            still[i] += np.count_nonzero(hashes[x + 1 : y] == hashes[x : y - 1])
            pairs[i] += y - x - 1
            count[i] += len(new)
    c, p = np.maximum(count, 1)[:, None], np.maximum(pairs, 1)[:, None]
    mean = first / c
    return np.concatenate([mean, np.sqrt(np.maximum(second / c - mean**2, 0)), step / p, np.log1p(count)[:, None] / 10, still[:, None] / p], 1)


class Network:
    """inputs -> tanh layer -> logit; probability = sigmoid(logit / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        unseen = np.arange(len(x)) % 5 == 4
        fit = ~unseen if unseen.any() and len(x) >= 50 else np.ones(len(x), bool)
        self.w1 = draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
        z, t = self._in(x[fit]), y[fit]
        params = [self.w1, self.b1, self.w2, np.zeros(1)]
        m, v, k = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(z))
            for a in range(0, len(order), 256):
                i = order[a : a + 256]
                h = np.tanh(z[i] @ params[0] + params[1])
                e = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - t[i]) / len(i)
                back = np.outer(e, params[2]) * (1 - h * h)
                grads = [z[i].T @ back + 1e-4 * params[0], back.sum(0), h.T @ e + 1e-4 * params[2], np.array([e.sum()])]
                k += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    params[j] -= 0.005 * (m[j] / (1 - 0.9**k)) / (np.sqrt(v[j] / (1 - 0.999**k)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = params[0], params[1], params[2], float(params[3][0])
        self.temperature = 1.0
        if unseen.any():
            logit, t = self.logit(x[unseen]), y[unseen]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, np.where(t > 0.5, -1, 1) * logit / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _in(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x):
        return np.tanh(self._in(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def pooled(docs: DataFrame, vectors, extra: str, text: str = "text") -> DataFrame:
    """(extra, features) of each row."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            f = pool(data, off, vectors.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in f], pa.binary())], [extra, "features"])

    return docs.select(extra, text).mapInArrow(run, f"{extra} {docs.schema[extra].dataType.simpleString()}, features binary")


def train(docs: DataFrame, labels: DataFrame, vectors, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Network | None:
    """Fit on at most FIT_ROWS labelled rows outside the held-out fold, by smallest hash of doc_id.

    Several labels of a document count by their mean; null labels count as none. None without labels.
    """
    rows = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(doc_id), 5, 0)).groupBy(doc_id).agg(F.avg(label).alias("_y"))
    rows = rows.orderBy(F.xxhash64(F.col(doc_id), F.lit(1)), doc_id).limit(FIT_ROWS)
    # at most FIT_ROWS ids and numbers: a bounded broadcast
    chosen = docs.select(doc_id, text).join(F.broadcast(rows), doc_id).select("_y", text)
    got = pooled(chosen, vectors, "_y", text).limit(2 * FIT_ROWS).toArrow()
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got["features"].to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
    y = np.asarray(got["_y"].to_pylist(), float)
    order = np.lexsort([*x.T[:4], y])  # the same order whatever the tasks' order
    order = order[np.random.default_rng(3).permutation(len(order))]
    return Network(x[order], (y[order] >= 0.5).astype(float))


def score(docs: DataFrame, vectors, network: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of each row; without a network every score is 0.5. Null and empty texts pool to zeros, long ones are
    scored whole. Repeated rows and ids get a row each; of the other columns only ``text`` is looked at."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            p = network.probability(pool(data, off, vectors.value)) if network is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text of ``documents``, learned from the labels that are not held out.

    Word vectors come from all texts; null, empty and very long texts, repeated rows and missing labels: see ``score`` and ``train``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    network = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), vectors)
    out = score(docs, vectors, network)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
