"""Operator 4: packing by optimal length buckets.

Dynamic programming over the global length histogram chooses the bucket boundaries that minimise
padding; inside each bucket, batches hold as many rows as the token budget allows at the bucket's
padded length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, written
from .mixing import word_count
from .ranks import ranked

BUCKETS = 16
#: Tokens of a batch, padding included.
BUDGET = 65_536


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` buckets over ascending distinct lengths, minimising the padding exactly.

    counts: rows of each length. Of equal costs the fewest buckets win, then the smaller boundaries. The cost of a
    bucket satisfies the quadrangle inequality, so the best last cut never moves back as the end moves on: each layer
    of the program is filled by halves, in about m log m whole-number steps.
    """
    m = len(lengths)
    if not m:
        return []
    up, counts = lengths.astype(np.int64), counts.astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(counts * up)])
    whole = up * rows[1:] - total[1:]
    best, back, costs = np.concatenate([[0], whole]), [np.zeros(m + 1, np.int64)], [int(whole[-1])]
    for _ in range(1, min(buckets, m)):
        if not costs[-1]:
            break
        arg = np.zeros(m + 1, np.int64)
        now = best.copy()
        # spans (first, last) of ends still to fill, between known best cuts (low, high)
        first, last, low, high = (np.array([x], np.int64) for x in (1, m, 0, m - 1))
        while len(first):
            mid = (first + last) // 2
            top = np.minimum(high, mid - 1)
            n = top - low + 1
            at = np.cumsum(n) - n
            cut = np.arange(n.sum()) - np.repeat(at, n) + np.repeat(low, n)
            end = np.repeat(mid, n)
            cost = best[cut] + up[end - 1] * (rows[end] - rows[cut]) - (total[end] - total[cut])
            least = np.minimum.reduceat(cost, at)
            hit = np.flatnonzero(cost == np.repeat(least, n))
            chosen = cut[hit[np.searchsorted(hit, at)]]
            arg[mid], now[mid] = chosen, least
            left, right = first < mid, mid < last
            first, last, low, high = (np.concatenate(x) for x in ((first[left], mid[right] + 1), (mid[left] - 1, last[right]), (low[left], chosen[right]), (chosen[left], high[right])))
        back.append(arg)
        costs.append(int(now[m]))
        best = now
    k = int(np.argmin(costs))
    out, j = [], m
    for layer in range(k, -1, -1):
        out.append(int(up[j - 1]))
        j = int(back[layer][j])
        if j == 0:
            break
    return sorted(set(out))


def pack(docs: DataFrame, length: str = "length", doc_id: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Add bucket_length, batch_id and batch_row to ``docs`` (any columns, with a whole-number ``length``).

    Buckets come from the histogram of all distinct lengths, one row each: m distinct lengths need m^2 / 2 words
    of text at least, so the driver gets no more than the root of twice the corpus's words. Rows stand in the order of
    (length, md5(doc_id), doc_id) in their bucket; batch_id counts from 0
    in each bucket. A batch holds max(1, budget div bucket_length) rows, so only a row that alone
    passes the budget makes a batch over it. Lengths are >= 0 (null: 0); rows of length 0 are packed
    too. Repeated rows are packed each. An empty table gives an empty result. Columns named like a result are replaced,
    others stay whatever they are called.
    """
    results = ("bucket_length", "batch_id", "batch_row")
    cols = [c for c in docs.columns if c not in results]
    sizes = F.coalesce(F.col(f"`{length}`"), F.lit(0)).cast("bigint")
    rows = docs.select(F.struct(*[(sizes if c == length else F.col(f"`{c}`")).alias(c) for c in cols]).alias("row"), sizes.alias("size"), F.col(f"`{doc_id}`").alias("id"))
    hist = rows.groupBy("size").agg(F.count("*").alias("n")).toArrow().sort_by("size")
    ends = boundaries(hist["size"].to_numpy(), hist["n"].to_numpy(), buckets)
    end = F.lit(ends[-1] if ends else 0)
    for e in reversed(ends[:-1]):
        end = F.when(F.col("size") <= e, F.lit(e)).otherwise(end)
    x = ranked(rows.withColumn("bucket_length", end.cast("bigint")), "bucket_length", "size", "id", rank="place")
    fit = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))))
    at = F.col("place") - 1
    return x.select(*[F.col("row")[c].alias(c) for c in cols], "bucket_length", F.floor(at / fit).cast("bigint").alias("batch_id"), (at % fit).cast("int").alias("batch_row"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of every document: doc_id, length (words), bucket_length, batch_id in the bucket and row in the batch.

    Null texts have length 0; repeated rows and empty tables as in ``pack``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    slim = written(docs.select("doc_id", word_count(F.col("text")).alias("length")), "op4")
    return pack(slim).select("doc_id", "length", "bucket_length", "batch_id", "batch_row")


def _op4_sql(buckets: int, budget: int) -> str:
    """The dynamic programme as one layer of SQL for each bucket, over the distinct lengths."""
    layers = ["l1 AS MATERIALIZED (SELECT j, up * rows - total AS cost, [up] AS ends FROM p UNION ALL SELECT 0, 0, [])"]
    for k in range(2, buckets + 1):
        best = f"SELECT h.j, h.up, min({{'cost': l.cost + h.up * (h.rows - q.rows) - (h.total - q.total), 'i': l.j}}) AS b FROM p h JOIN l{k - 1} l ON l.j < h.j JOIN z q ON q.j = l.j GROUP BY h.j, h.up"
        layers.append(f"l{k} AS MATERIALIZED (SELECT x.j, b.cost AS cost, list_append(l.ends, x.up) AS ends FROM ({best}) x JOIN l{k - 1} l ON l.j = b.i UNION ALL SELECT 0, 0, [])")
    last = " UNION ALL ".join(f"SELECT {k} AS k, cost, ends FROM l{k} WHERE j = (SELECT max(j) FROM z)" for k in range(1, buckets + 1))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS length FROM documents),
h AS (SELECT length AS up, count(*)::BIGINT AS n FROM d GROUP BY length),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY up) AS j, up, (sum(n) OVER (ORDER BY up))::BIGINT AS rows, (sum(n * up) OVER (ORDER BY up))::BIGINT AS total FROM h),
z AS MATERIALIZED (SELECT j, rows, total FROM p UNION ALL SELECT 0, 0, 0), {", ".join(layers)},
e AS (SELECT unnest(ends) AS top FROM (SELECT ends FROM ({last}) ORDER BY cost, k LIMIT 1)),
x AS (SELECT doc_id, length, (SELECT min(top) FROM e WHERE top >= length)::BIGINT AS bucket_length FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket_length ORDER BY length, md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS k, greatest(1, {budget} // greatest(bucket_length, 1)) AS fit FROM x)
SELECT doc_id, length, bucket_length, (k // fit)::BIGINT AS batch_id, (k % fit)::INT AS batch_row FROM r
"""


OP4_SQL = _op4_sql(BUCKETS, BUDGET)
