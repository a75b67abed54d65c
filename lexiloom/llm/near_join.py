"""Operator 6: n-gram Jaccard self-join by chosen paths.

A text is its set of five-word shingles, embedded as COORDS tokens: the shingle that comes first in each of as
many random orders (two sets share a token with the probability of their similarity). In one run, a node of
the tree holds the sets that share the tokens of its path. A node of more than LIMIT sets is split: a hash of the
node and the token chooses TOKENS of each set's tokens on the average, the same for every set that has them, and the
set goes to the child of each one chosen. So two sets of the threshold's similarity share more than one child
on the average, and some path of theirs goes on for ever with a fixed probability; sets that are far apart soon part.
Nodes of LIMIT sets or fewer are compared by brute force. So are dense nodes, where some child keeps the share DENSE
of the sets: their sets are alike, and splitting on would only compare them again and again. Runs repeat with
fresh hashes until a pair at the threshold meets with the target recall, however deep its nodes are.

Brute force goes in two steps: sketches (the tokens) rule out pairs that are far
off, then whole shingle sets are compared. A pair counts in the first node it meets only. Texts with
equal sets are one row from the start, so copies are never paired. Nodes above BLOCK rows are
compared block by block in separate tasks. Each task returns one row for each set: its links there
and the root of its links there; no pair leaves a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SALTS, bound_batches, flat, gram_hashes, mix, split_words, table, written
from .components import components
from .substring_dedup import _unzstd, _zstd

GRAM = 5
#: Similarity 4/5, as whole numbers.
TOP, BOTTOM = 4, 5
#: Tokens of a set's embedding, and how many of them a node chooses on the average.
COORDS, TOKENS = 36, 2
#: Sets that a node may hold to be compared at once.
LIMIT = 256
#: A node is dense if one child keeps this share of its sets.
DENSE = 0.6
#: Levels of splitting; nodes that are still large there are compared block by block like the dense ones.
DEPTH = 8
BLOCK = 512
TARGET = 0.9999


def survival(children: float) -> float:
    """The chance that a branching process with a Poisson number of children, so many on the average, never dies out."""
    q = 1.0
    for _ in range(200):
        q = 1 - math.exp(-children * q)
    return q


RUNS = math.ceil(math.log(1 - TARGET) / math.log(1 - survival(TOKENS * TOP / BOTTOM)))
#: Pairs whose sketches agree on fewer coordinates are ruled out (over four standard deviations below the threshold).
AGREE = math.floor(COORDS * (TOP / BOTTOM) - 4.2 * math.sqrt(COORDS * (TOP / BOTTOM) * (1 - TOP / BOTTOM)))

_DRAW = np.random.default_rng(66)
_A = _DRAW.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text; 1 to 4 words make one shingle of all of them."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, min(gram, len(words))))


def sketch(s: np.ndarray) -> np.ndarray:
    """The first token of the set in each of COORDS random orders, as 32-bit ranks."""
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(s), 2048):
            np.minimum(out, (s[a : a + 2048, None] * _A).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, h1, h2, n, sig) of (doc_id, rk, text): h1 and h2 are 128 bits of hash of the set, n its size."""
    kind = "doc_id bigint, rk int, h1 bigint, h2 bigint, n int, sig binary"
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches):
        for batch in batches:
            h, n, sig = ([], []), [], []
            for words, _, _ in split_words(*flat(batch.column(2))):
                s = shingles(words)
                with np.errstate(over="ignore"):
                    for part, salt in zip(h, (0x5DEECE66D, 0x2545F4914F6CDD1D), strict=True):
                        part.append(mix(s ^ np.uint64(salt)).sum() + np.uint64(len(s)))
                n.append(len(s))
                sig.append(sketch(s).tobytes() if len(s) else b"")
            h = [pa.array(mix(np.array(x, np.uint64)).view(np.int64)) for x in h]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *h, pa.array(n, pa.int32()), pa.array(sig, pa.binary())], names)

    return docs.select("doc_id", "rk", "text").mapInArrow(run, kind)


def children(rows: DataFrame) -> DataFrame:
    """(node, parent, psize, key): the child buckets of each set in the buckets (node, sig, parent, psize); parent null: the roots of all runs."""
    kind = "node bigint, parent bigint, psize bigint, key bigint"
    names = [x.split()[0] for x in kind.split(", ")]
    starts = mix(np.arange(1, RUNS + 1, dtype=np.uint64))

    def run(batches):
        share = np.uint64(int(TOKENS / COORDS * (1 << 64)))
        place = mix(np.arange(COORDS, dtype=np.uint64) + np.uint64(77))[None, :]
        for batch in batches:
            m = batch.num_rows
            node, sig = batch.column(0).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(m, COORDS)
            with np.errstate(over="ignore"):
                token = mix(sig.astype(np.uint64) + place)
            roots = batch.column(2).null_count > 0
            for start in starts if roots else (batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)[:, None],):
                with np.errstate(over="ignore"):
                    h = mix(token ^ mix(np.asarray(start)))
                row, col = np.nonzero(h < share)
                at = pa.array(row)
                parent = pa.nulls(len(row), pa.int64()) if roots else batch.column(2).take(at)
                yield pa.RecordBatch.from_arrays([pa.array(node[row]), parent, batch.column(3).take(at), pa.array(mix(h[row, col]).view(np.int64))], names)

    return rows.select("node", "sig", "parent", "psize").mapInArrow(run, kind)


def salt():
    return F.pmod(F.xxhash64("node", F.lit(41)), F.lit(SALTS)).cast("int")


def counted(rows: DataFrame) -> DataFrame:
    """(parent, psize, key, size, salts) of the buckets of two sets or more; sums over salts first, so a hot bucket is many tasks' work."""
    part = rows.withColumn("salt", salt()).groupBy("parent", "psize", "key", "salt").agg(F.count("*").alias("n"))
    return part.groupBy("parent", "psize", "key").agg(F.sum("n").alias("size"), F.collect_set("salt").alias("salts")).filter("size > 1")


def met(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, key, size) of the rows whose bucket is in ``sizes``, joined by bucket and salt."""
    sizes = sizes.select("key", "size", F.explode("salts").alias("salt"))
    return rows.select("node", "key", salt().alias("salt")).join(sizes, ["key", "salt"]).select("node", "key", "size")


def leaves(nodes: DataFrame) -> DataFrame:
    """(node, key, size) of the buckets to compare: small ones, dense ones, and what is left at the deepest level."""
    none = F.lit(None).cast("bigint")
    rows = written(children(nodes.select("node", "sig", none.alias("parent"), none.alias("psize"))), "op6-paths")
    sizes, out = counted(rows), None
    for depth in range(1, DEPTH + 1):
        here = written(met(rows, sizes), "op6-met")
        big = here.filter(F.col("size") > LIMIT)
        last = depth == DEPTH or not big.limit(1).count()
        done = here if last else here.filter(F.col("size") <= LIMIT)
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        rows = big.join(nodes.select("node", "sig"), "node").select("node", "sig", F.col("key").alias("parent"), F.col("size").alias("psize"))
        rows = written(children(rows), "op6-paths")
        sizes = written(counted(rows), "op6-sizes")
        dense = sizes.groupBy("parent", "psize").agg(F.max("size").alias("most")).filter(F.col("most") >= DENSE * F.col("psize")).select("parent")
        dense = written(dense, "op6-dense")  # at most one row for LIMIT rows of a level
        every = dense.select(F.col("parent").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        out = out.unionByName(big.withColumn("salt", salt()).join(every, ["key", "salt"]).select("node", "key", "size"))
        sizes = sizes.join(dense, "parent", "left_anti")
    return out


def groups(batches, keys: int):
    """Complete groups of rows with equal leading ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        if held:
            h = held[-1]
            same = all(h.column(i)[-1].as_py() == k[i][0] for i in range(keys))
            if not same:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], 0)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks() if len(held) > 1 else pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of the column ``leaf``."""
    x = g["leaf"].combine_chunks()
    n = pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(n)]), np.asarray(x.flatten(), np.int64)


def _fresh(off: np.ndarray, buckets: np.ndarray, key: int) -> np.ndarray:
    """Mask of the pairs of rows that share no bucket before ``key`` in the order of keys; buckets: those of each row."""
    m = len(off) - 1
    who = np.repeat(np.arange(m), np.diff(off))
    before = buckets < key
    who, b = who[before], buckets[before]
    order = np.argsort(b, kind="stable")
    who, b = who[order], b[order]
    fresh = np.ones((m, m), bool)
    edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if y - x > 1:
            fresh[np.ix_(who[x:y], who[x:y])] = False
    return fresh


def _pairs(g: pa.Table, key: int, own: np.ndarray, i: int, j: int) -> np.ndarray:
    """Mask of the pairs of a block task: across blocks i and j, or inside one; fresh ones, never of a row with itself."""
    ok = _fresh(*_lists(g), key)
    if i != j:
        ok &= own[:, None] != own[None, :]
    np.fill_diagonal(ok, False)
    return ok


def blocks(rows: DataFrame) -> DataFrame:
    """Deal each bucket (key, size, node) to tasks (key, i, j) of two blocks of BLOCK rows at most, about; own: the row's block."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    x = rows.withColumns({"_n": n}).withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("_n")).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return x.withColumns({"i": F.least("own", "_o"), "j": F.greatest("own", "_o")}).drop("_n", "_o")


def _dealt(x: DataFrame) -> DataFrame:
    return x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def close(rows: DataFrame) -> DataFrame:
    """(key, i, j, node) with a fresh partner whose sketch is near; rows also hold own, leaf and sig."""
    kind = "key bigint, i int, j int, node bigint"

    def run(batches):
        out: list[list] = [[], [], [], []]
        for g in groups(batches, 3):
            if g.num_rows < 2:
                continue
            key, i, j = (g[c][0].as_py() for c in ("key", "i", "j"))
            ok = _pairs(g, key, np.asarray(g["own"]), i, j)
            todo = np.flatnonzero(ok.any(1))  # the others have met all of this bucket before
            if not len(todo):
                continue
            sig = np.frombuffer(b"".join(g["sig"].to_pylist()), np.uint32).reshape(g.num_rows, COORDS)[todo]
            same = np.zeros((len(todo), len(todo)), np.int16)
            for c in range(COORDS):
                same += sig[:, c][:, None] == sig[:, c][None, :]
            near = todo[((same >= AGREE) & ok[np.ix_(todo, todo)]).any(1)]
            if len(near):
                nodes = np.asarray(g["node"])[near]
                for k, v in enumerate((key, i, j)):
                    out[k].append(np.full(len(near), v))
                out[3].append(nodes)
            if len(out[0]) >= 5000:
                yield batch(out)
                out = [[], [], [], []]
        yield batch(out)

    def batch(out):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], t) for v, t in zip(out, kinds, strict=True)], ["key", "i", "j", "node"])

    return _dealt(rows.select("key", "i", "j", "node", "own", "leaf", "sig")).mapInArrow(run, kind)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct sets."""
    m = len(sets)
    if m <= 6:
        out = np.zeros((m, m), np.int64)
        for a in range(m):
            for b in range(a):
                out[a, b] = out[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    some = n[at] > 1
    col, who = number[at[some]], who[some]
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    out = np.zeros((m, m), np.float32)
    for a in range(0, int(number[-1]) + 1, 4096):
        x, y = np.searchsorted(col, [a, a + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[who[x:y], col[x:y] - a] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def roots(ok: np.ndarray) -> np.ndarray:
    """The first row of each row's component under a symmetric mask."""
    root = np.full(len(ok), -1)
    for a in range(len(ok)):
        if root[a] < 0:
            root[a], todo = a, [a]
            while todo:
                new = np.flatnonzero(ok[todo].any(0) & (root < 0))
                root[new] = a
                todo = new.tolist()
    return root


def compare(rows: DataFrame) -> DataFrame:
    """(node, root, links): links counts the documents of linked nodes; rows hold key, i, j, node, own, leaf, members, shingles."""
    kind = "node bigint, root bigint, links bigint"

    def run(batches):
        for g in groups(batches, 3):
            if g.num_rows < 2:
                continue
            key, i, j = (g[c][0].as_py() for c in ("key", "i", "j"))
            nodes = np.asarray(g["node"])
            first = np.unique(nodes, return_index=True)[1]  # repeated rows of one text
            if len(first) < len(nodes):
                g, nodes = g.take(pa.array(first)), nodes[first]
            ok = _pairs(g, key, np.asarray(g["own"]), i, j)
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"].to_pylist()]
            n = np.array([len(s) for s in sets])
            both = intersections(sets)
            # both / (n + n' - both) >= TOP / BOTTOM
            ok &= (TOP + BOTTOM) * both >= TOP * (n[:, None] + n[None, :])
            links = ok @ np.asarray(g["members"], np.int64)
            at = np.flatnonzero(links)
            if len(at):
                root = nodes[roots(ok)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at], pa.int64()), pa.array(root[at], pa.int64()), pa.array(links[at], pa.int64())], ["node", "root", "links"])

    return _dealt(rows.select("key", "i", "j", "node", "own", "leaf", "members", "shingles")).mapInArrow(run, kind)


def shingle_sets(packed: DataFrame) -> DataFrame:
    """(node, shingles) of (node, z, size)."""

    def run(batches):
        for batch in batches:
            out = []
            for z, size in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = np.frombuffer(_unzstd(z, size), np.uint8)
                out.append(shingles(next(split_words(raw, np.array([0, len(raw)])))[0]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "shingles"])

    return packed.select("node", "z", "size").mapInArrow(run, "node bigint, shingles binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, class_id, n_links, root) for each row of (doc_id, text); rk is hash(text, 6).

    class_id is the least doc_id that links of similarity 4/5 or more lead to (its own without any);
    n_links counts the other documents that a row is linked with directly; root is a number that a class's rows
    share. Texts without words (null, empty, white space) have no links and a null root; rows with a null doc_id take
    no part and have class_id null. Texts of 1 to 4 words are one shingle. Repeated rows count as documents of their
    own. Other columns are not looked at; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text", F.lit(6)).alias("rk"), "text")
    known = written(sketches(rows.filter("doc_id is not null")), "op6-sketches")
    one = F.min(F.struct("doc_id", "rk")).alias("one")
    nodes = known.filter("n > 0").groupBy("h1", "h2").agg(one, F.count("*").alias("members"), F.first("sig").alias("sig"))
    # numbers stay once written
    nodes = written(nodes.select("h1", "h2", "members", "sig", "one.doc_id", "one.rk").withColumn("node", F.monotonically_increasing_id()), "op6-nodes")
    found = written(leaves(nodes), "op6-leaves")
    own = found.groupBy("node").agg(F.collect_list("key").alias("leaf"))
    about = nodes.join(own, "node").select("node", "members", "sig", "leaf")
    dealt = blocks(found).join(about, "node")
    near = written(close(dealt), "op6-near")
    # whole sets of the texts that have a near partner
    packed = _zstd(rows.filter("doc_id is not null"))
    wanted = near.select("node").distinct().join(nodes.select("node", "doc_id", "rk"), "node")
    sets = shingle_sets(packed.join(wanted, ["doc_id", "rk"]))
    tasks = near.join(blocks(found).select("key", "i", "j", "node", "own"), ["key", "i", "j", "node"]).join(about.drop("sig"), "node")
    links = written(compare(tasks.join(sets, "node")), "op6-links")
    star = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    count = links.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("h1", "h2", "node", "members", "doc_id").join(count, "node", "left").join(star, "node", "left")
    info = info.withColumn("root", F.coalesce("root", "node"))
    info = written(info, "op6-info")
    least = info.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("_k"))
    # only classes of several nodes need the join; the others are their own
    least = written(least.filter("_k > 1").drop("_k"), "op6-classes")  # read back, a hot class can be split
    info = info.join(least, "root", "left").select("h1", "h2", "root", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    done = known.filter("n > 0").select("doc_id", "rk", "h1", "h2").join(info, ["h1", "h2"]).select("doc_id", "rk", "class_id", "n_links", "root")
    zero, none = F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint")
    alone = known.filter("n = 0").select("doc_id", "rk", F.col("doc_id").alias("class_id"), zero, none.alias("root"))
    lost = rows.filter("doc_id is null").select("doc_id", "rk", none.alias("class_id"), zero, none.alias("root"))
    return done.unionByName(alone).unionByName(lost)


def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document of ``documents``: doc_id, class_id and n_links at a similarity of 0.8 of five-word shingles.

    Nulls, empty and very long texts, repeated rows and empty tables: see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "n_links")


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, that of the least doc_id (one of them if the row is repeated), and so do rows
    without words and rows with a null doc_id. Texts of one doc_id that are not alike are classes of their own."""
    found = near_duplicates(docs.select("doc_id", "text"))
    rows = found.filter("root is not null").groupBy("root", "doc_id", "rk").agg(F.count("*").alias("_n"))
    keep = rows.groupBy("root").agg(F.min(F.struct("doc_id", "rk", "_n")).alias("k")).select("k.*")
    empty = found.filter("root is null and doc_id is not null").select("doc_id", "rk", F.lit(1).cast("bigint").alias("_n")).distinct()
    keep = written(keep.unionByName(empty), "op6-keep")
    x = docs.withColumn("_rk", F.hash("text", F.lit(6)))
    whole = x.alias("d").join(keep.alias("k"), F.expr("d.doc_id = k.doc_id and d._rk = k.rk")).select("d.*", "k._n")
    if keep.filter("_n > 1").limit(1).count():
        whole = whole.filter("_n = 1").unionByName(whole.filter("_n > 1").dropDuplicates(["doc_id", "_rk"]))
    return whole.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


#: Every pair of texts that share a shingle, compared as whole sets; for tables of a few thousand documents.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT id, md5(array_to_string(words[i:i + 4], ' ')) AS gram FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0 AND doc_id IS NOT NULL)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS hits FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 5 * hits >= 4 * (x.n + y.n - hits)),
s AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS id, a AS met FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.met = s.a),
k AS (SELECT r.id, min(w.doc_id) AS class_id FROM r JOIN w ON w.id = r.met GROUP BY r.id),
m AS (SELECT a AS id, count(*) AS n_links FROM s GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM w LEFT JOIN k USING (id) LEFT JOIN m USING (id)
"""
