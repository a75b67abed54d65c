"""Operator 2: approximate nearest neighbours by cosine over a hierarchical k-means tree.

The tree is fitted on a bounded sample of unit vectors; every distinct vector is indexed under its leaf. A
query walks the tree best bin first: a priority queue holds the unvisited branches by their distance
from the query, and the nearest is opened next. How many leaves it visits is calibrated: on queries
of the sample, the visits widen until the recall against brute force reaches the target.

Copies of one vector are one row of the index with its k + 1 smallest ids: no other id of theirs can be among the
k nearest of anything. Copies that ask are one query, whose k + 1 nearest serve them all.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bound_batches, table, written

#: Rows that the tree is fitted on: at least (if there are so many) and at most; in between, LEAF_SAMPLE for a leaf.
SAMPLE, MOST_SAMPLE = 20_000, 400_000
BRANCH = 8
#: Leaves: the root of the number of vectors over this. Each visit has a fixed cost besides that of its rows, and the
#: root balances the two; the sample's upper bound is met at ten billion vectors.
LEAF_ROOT = 4
LEAF_SAMPLE = 16
TARGET = 0.95
CALIBRATION = 300
#: Vectors of one leaf that a task handles together, and queries; larger leaves are split, and so are the queries that
#: visit one leaf.
CHUNK_ROWS = 4096


def valid(vector):
    """Vectors that take part: not null or empty, no null or non-finite component, some component not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, the same for equal pairs wherever they stand."""
    dot, qq, xx = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        dot += q[:, d] * x[:, d]
        xx += x[:, d] * x[:, d]
        qq += q[:, d] * q[:, d]
    return dot / (np.sqrt(qq) * np.sqrt(xx))


def nearest(qv, ids, xv, k: int):
    """(query rows, ids, scores) of the k nearest ids of each query vector, ties to the smaller id.

    ids: for each row of ``xv`` the ids that have this vector. A matrix product finds who may be among the k (all
    within rounding of the k-th row); exact cosines rank them. An id counts once, with its best score.
    """
    xu, out = unit(xv), ([], [], [])
    sizes = np.array([len(x) for x in ids], np.int64)
    start, every = np.cumsum(sizes) - sizes, np.concatenate([np.asarray(x, np.int64) for x in ids]) if len(ids) else np.zeros(0, np.int64)
    repeated = len(np.unique(every)) < len(every)
    for a in range(0, len(qv), 256):
        q = qv[a : a + 256]
        rough = unit(q) @ xu.T
        m = k
        while True:  # ids that stand under several vectors may need a wider choice
            least = np.partition(rough, rough.shape[1] - m, axis=1)[:, -m, None] if rough.shape[1] > m else np.full((len(q), 1), -2.0)
            row, col = np.nonzero(rough >= least - 1e-9)
            e = np.concatenate([exact_cosine(q[row[i : i + 16384]], xv[col[i : i + 16384]]) for i in range(0, len(row), 16384)] or [np.zeros(0)])
            n = sizes[col]
            at = np.repeat(start[col] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            r, x, v = np.repeat(row, n), every[at], np.repeat(e, n)
            if repeated:
                order = np.lexsort((-v, x, r))
                r, x, v = r[order], x[order], v[order]
                first = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])]) if len(r) else np.zeros(0, bool)
                r, x, v = r[first], x[first], v[first]
            if not repeated or m >= rough.shape[1] or np.bincount(r, minlength=len(q)).min() >= k:
                break
            m *= 2
        order = np.lexsort((x, -v, r))
        r, x, v = r[order], x[order], v[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        for part, y in zip(out, (r[top] + a, x[top], v[top]), strict=True):
            part.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


class Tree:
    """Nodes in arrays: children of node i are rows kids[i] of centres (empty: a leaf)."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.centres, self.kids, self.leaf = [np.zeros(sample.shape[1])], [[]], [-1]
        least = max(2, len(sample) // max(1, leaves))
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= least or len(self.centres) > 4 * leaves + BRANCH:
                continue
            centres, group = self._split(sample[rows], min(BRANCH, -(-len(rows) // least)), draw)
            sizes = np.bincount(group, minlength=len(centres))
            if (sizes > 0).sum() < 2:  # equal vectors
                continue
            for c in np.flatnonzero(sizes):
                self.kids[node].append(len(self.centres))
                self.centres.append(centres[c])
                self.kids.append([])
                self.leaf.append(-1)
                todo.append((len(self.centres) - 1, rows[group == c]))
        self.centres = np.array(self.centres)
        ends = [i for i, k in enumerate(self.kids) if not k]
        for n, i in enumerate(ends):
            self.leaf[i] = n
        self.n_leaves = len(ends)
        self.kids = [np.array(k, np.int64) for k in self.kids]

    @staticmethod
    def _split(x, k, draw, rounds=8):
        distinct = np.unique(x, axis=0) if len(x) <= 4096 else x
        centres = distinct[draw.choice(len(distinct), min(k, len(distinct)), replace=False)]
        group = np.zeros(len(x), np.int64)
        for _ in range(rounds):
            group = (x @ centres.T).argmax(1)
            for c in range(len(centres)):
                m = x[group == c].sum(0) if (group == c).any() else centres[c]
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
        return centres, group

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: the nearest centre at each level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.kids[node]
            if not len(kids):
                out[rows] = self.leaf[node]
                continue
            g = np.zeros(len(rows), np.int64)
            best = np.full(len(rows), -np.inf)
            for j, k in enumerate(kids):  # one centre at a time, so equal vectors always go the same way
                s = (x[rows] * self.centres[k]).sum(1)
                g[s > best], best = j, np.maximum(best, s)
            todo += [(kids[j], rows[g == j]) for j in range(len(kids)) if (g == j).any()]
        return out

    def visits(self, q: np.ndarray, counts: np.ndarray, most: int, rows: int):
        """Leaves for one unit vector, best bin first, until ``most`` leaves with rows and ``rows`` rows are met."""
        queue, out, met = [(-1.0, 0)], [], 0
        while queue and (len(out) < most or met < rows):
            _, node = heapq.heappop(queue)
            kids = self.kids[node]
            if len(kids):
                for k, s in zip(kids.tolist(), (self.centres[kids] @ q).tolist(), strict=True):
                    heapq.heappush(queue, (-s, k))
            elif counts[self.leaf[node]]:
                out.append(self.leaf[node])
                met += int(counts[self.leaf[node]])
        return out


def calibrate(tree: Tree, sample: np.ndarray, k: int, target: float = TARGET) -> int:
    """Leaves to visit so that the mean recall of sample queries against the sample reaches ``target``."""
    draw = np.random.default_rng(5)
    where = tree.assign(sample)
    counts = np.bincount(where, minlength=tree.n_leaves)
    queries = draw.choice(len(sample), min(CALIBRATION, len(sample)), replace=False)
    place = []  # for each query and true neighbour, how many leaves it takes to meet it
    for i in queries:
        s = sample @ sample[i]
        s[i] = -np.inf
        near = np.argpartition(-s, min(k, len(s) - 1))[:k] if len(s) > k else np.flatnonzero(np.isfinite(s))
        order = {leaf: n + 1 for n, leaf in enumerate(tree.visits(sample[i], counts, tree.n_leaves, 0))}
        place += [order[w] for w in where[near]]
    place = np.sort(place)
    return int(place[min(len(place) - 1, int(np.ceil(target * len(place))))]) if len(place) else 1


def distinct(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(vectors, askers) of rows (vec_id, v, q): (h1, h2, v, ids, asks) for each distinct vector and (h1, h2, query_id) of
    the asking rows of repeated ones.

    ids are the k smallest that have the vector; h1 and h2 are null where it stands once. Equal vectors meet by a
    128-bit hash that travels without them; only hashes found twice have a row to join with.
    """
    hashed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(23), "v")})
    slim = hashed.select("h1", "h2", "vec_id", "q")
    twice = slim.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.max("q").alias("asks")).filter("n > 1").drop("n")
    twice = written(twice, "op2-copies")  # read back, its joins' hot keys can be split
    marked = hashed.join(twice, ["h1", "h2"], "left")
    none = F.lit(None).cast("bigint")
    alone = marked.filter("least is null").select(none.alias("h1"), none.alias("h2"), "v", F.array("vec_id").alias("ids"), F.col("q").alias("asks"))
    copies = slim.join(twice.select("h1", "h2"), ["h1", "h2"], "left_semi")
    # ids in order, cut to k before the shuffle in each task and after it
    w = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = copies.select("h1", "h2", "vec_id").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    first = marked.filter("vec_id = least").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.first("asks").alias("asks"))
    many = first.join(ids, ["h1", "h2"]).select("h1", "h2", "v", "ids", "asks")
    return alone.unionByName(many), copies.filter("q").select("h1", "h2", F.col("vec_id").alias("query_id")).distinct()


def search(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other ids found for each id of a row that ``is_query``.

    Rows of ``vec_id`` null and vectors that are not ``valid`` take no part; vectors of several lengths are searched
    apart, each among those of its length. Ties go to the smaller vec_id. Repeated rows and several vectors under one
    id: an id stands once in an answer, with its best score, and never in its own; several query rows of one id are one
    query with several vectors. Every vector is indexed; leaves above CHUNK_ROWS vectors are split by hash and each
    part gives its own k best, and the queries of a leaf are split likewise. If fewer than k rows are met, more leaves
    are visited. Other columns are not looked at. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(F.col("vec_id").isNotNull() & valid(F.col("v")))
    found = None
    for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # one row a length
        part = _search(rows.filter(F.size("v") == r["d"]), r["d"], r["count"], k, target)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = found.filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(rows: DataFrame, dim: int, n: int, k: int, target: float) -> DataFrame:
    """(query_id, vec_id, score): k + 1 candidates or more of each asking id, itself maybe among them."""
    spark = rows.sparkSession
    leaves = max(1, int(n**0.5) // LEAF_ROOT)
    size = min(max(SAMPLE, LEAF_SAMPLE * leaves), MOST_SAMPLE)
    # the rows of smallest hash, over all partitions; the dice only spares the sort the others
    dice = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30))
    some = rows.filter(dice < int(min(1.0, 1.2 * size / n) * (1 << 30)) + 1) if n > 2 * size else rows
    got = some.orderBy(dice, "vec_id").select("v").limit(size).toArrow()["v"].combine_chunks()
    sample = unit(np.asarray(got.flatten()).reshape(-1, dim))
    # an even number of copies would hide what lies between: the tree learns from distinct vectors
    sample = np.unique(sample, axis=0)
    tree = Tree(sample, max(1, min(leaves, len(sample) // LEAF_SAMPLE)))
    most = calibrate(tree, sample, k, target)
    shipped = spark.sparkContext.broadcast(tree)  # at most 4 * MOST_SAMPLE / LEAF_SAMPLE centres, made from the sample

    def matrix(column):
        return np.asarray(column.flatten(), np.float64).reshape(-1, dim)

    def assign(batches):
        for batch in batches:
            v = matrix(batch.column(1)) if batch.num_rows else np.zeros((0, dim))
            leaf = shipped.value.assign(unit(v)) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["h1", "v", "h2", "ids", "asks", "leaf"])

    nodes, askers = distinct(rows, k + 1)
    indexed = nodes.select("h1", "v", "h2", "ids", "asks").mapInArrow(assign, "h1 bigint, v array<double>, h2 bigint, ids array<bigint>, asks boolean, leaf int")
    indexed = written(indexed.withColumn("node", F.monotonically_increasing_id()), "op2-index")  # numbers stay once written
    counts = np.zeros(tree.n_leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row a leaf
        counts[r["leaf"]] = r["count"]

    def fan(batches):
        t = shipped.value
        for batch in batches:
            v = matrix(batch.column(1)) if batch.num_rows else np.zeros((0, dim))
            leaves = [t.visits(q, counts, most, k + 1) for q in (unit(v) if len(v) else v)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaves, pa.list_(pa.int32()))], ["node", "leaves"])

    asked = written(indexed.filter("asks").select("node", "v").mapInArrow(fan, "node bigint, leaves array<int>"), "op2-visits")
    asks = np.zeros(tree.n_leaves, np.int64)
    for r in asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # one row a leaf
        asks[r["leaf"]] = r["count"]
    split = lambda n: F.element_at(F.array(*[F.lit(int(x)) for x in np.maximum(1, -(-n // CHUNK_ROWS))]), F.col("leaf") + 1) if n.max(initial=0) > CHUNK_ROWS else F.lit(1)
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    # a (leaf, part, turn) group holds a part of the leaf's vectors and a part of its queries
    base = indexed.select("leaf", own(7, split(counts)).alias("part"), "node", "v", "ids").withColumn("turn", upto(split(asks)))
    going = asked.select("node", F.explode("leaves").alias("leaf")).withColumn("turn", own(8, split(asks))).withColumn("part", upto(split(counts)))
    going = going.join(indexed.filter("asks").select("node", "v"), "node").select("leaf", "part", "node", "v", F.lit(None).cast("array<bigint>").alias("ids"), "turn")

    def answer(key, table):
        asks = np.asarray(pc.is_null(table["ids"]))
        nodes, v = np.asarray(table["node"], np.int64), matrix(table["v"].combine_chunks())
        if asks.all() or not asks.any():
            got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            got = nearest(v[asks], table["ids"].filter(pa.array(~asks)).to_pylist(), v[~asks], k + 1)
        return pa.table({"node": pa.array(nodes[asks][got[0]], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    found = base.unionByName(going).groupBy("leaf", "part", "turn").applyInArrow(answer, "node bigint, vec_id bigint, score double")
    best = found.groupBy("node", "vec_id").agg(F.max("score").alias("score")) if counts.max(initial=0) > CHUNK_ROWS else found
    w = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k + 1).select("node", "vec_id", "score")
    # the answers of a vector go to each of the ids that ask with it
    alone = indexed.filter("asks and h1 is null").select("node", F.element_at("ids", 1).alias("query_id"))
    many = askers.join(indexed.filter("h1 is not null").select("h1", "h2", "node"), ["h1", "h2"]).select("node", "query_id")
    asking = written(alone.unionByName(many), "op2-askers")  # read back, hot vectors can be split
    return asking.join(written(best, "op2-found"), "node").select("query_id", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score: the 5 nearest vectors of ``embeddings`` to each whose vec_id is divisible by 50.

    Null, zero and non-finite vectors, ties, repeated rows, other lengths and empty tables: see ``search``."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
