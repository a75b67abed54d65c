"""Operator 3: mixing sources to target weights by systematic sampling (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, md5_int, table, written
from .ranks import ranked

#: Fixed-point scale of expected copies, so that running sums are exact integers.
SCALE = 1 << 24
#: Bounds of the strata by words, in eighths of the source: the largest texts that hold half of its words, those of the
#: next three eighths, and the smallest ones that hold the last eighth.
STRATA = (4, 7)
#: A source is repeated at most so many times.
MOST = 3


def word_count(text):
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, source: str = "source", size: str = "size", most: int = MOST) -> DataFrame:
    """(source, source_size, target) with weights 1, 2, 3 repeating in code-point order, null last.

    Targets share the whole size by weight; one that would pass ``most`` times its source's size
    stops there and the excess goes to the others by weight. In the order of (cap / weight) the
    stopped sources are a prefix, so running sums over one row a source find the level at once.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("bigint").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_w", (F.row_number().over(by_name) - 1) % 3 + 1)
    by_level = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = per.withColumns({
        "_total": F.sum("source_size").over(everything),
        "_capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most,
        "_left": F.sum("_w").over(after),
    })
    level = (F.col("_total") - F.col("_capped")) / F.col("_left")
    fits = level * F.col("_w") <= F.col("source_size") * most
    # the first source that fits tells the level; those before it are stopped
    ratio = F.col("source_size") / F.col("_w")
    x = x.withColumn("_first", F.min(F.when(fits, F.struct(ratio.alias("free"), (-level).alias("level")))).over(everything))
    target = F.when(ratio >= F.col("_first.free"), -F.col("_first.level") * F.col("_w")).otherwise((F.col("source_size") * most).cast("double"))
    return x.select("source", "source_size", target.cast("double").alias("target"))


def strata(rows: DataFrame, source: str) -> DataFrame:
    """(s, size, part, n, words, before, offset): part 0, 1 or 2 of each size in its source, larger texts first.

    A size is in the part that the words before it reach to. One row a distinct size: partial counts come before the
    shuffle. before: rows of larger parts; the last rows of ``words`` and ``n`` are sums over the part.
    """
    hist = rows.groupBy(F.col(source).alias("s"), "size").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    larger = Window.partitionBy("s").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("s")
    reach = F.coalesce(F.sum("words").over(larger), F.lit(0)) * 8
    total = F.sum("words").over(whole)
    part = sum(((reach >= total * e).cast("int") for e in STRATA), F.lit(0))
    return hist.withColumn("part", part).select("s", "size", "n", "words", "part")


def copies(docs: DataFrame, seed: int = 0, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` (any columns, with a whole-number ``size``) with source_size, target and copies of each row.

    Systematic sampling: in a source, rows stand in the order of falling size (then md5(doc_id), doc_id); the prefix
    sum of their expected copies plus one random offset in [0, 1), drawn from the seed and the source's name, is cut at
    integers, and a row is emitted once for each integer crossed. Expected copies are target / source_size for the
    largest texts, which hold half of the source's words. Since a large text is taken whole or not, the words taken
    so far miss their share by up to one large text; the expected copies of the next texts (three eighths of the
    words), and then of the smallest ones (the last eighth), make up for it: (target - words taken so far) / words
    left, within 0 and 3. So a source misses its target by about one of its smallest texts, however large its
    largest is. Rows of size 0 take part; a source without words has target 0 and is not taken. Null ids and
    null sources count as values of their own; rows equal in all keys are interchangeable. Columns named source_size,
    target or copies are replaced, others stay whatever they are called.
    """
    results = ("source_size", "target", "copies")
    cols = [c for c in docs.columns if c not in results]
    goal = targets(docs.select(F.col(source).alias("source"), F.col("size").cast("bigint").alias("size")))
    u = md5_int(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\0")))) % SCALE
    goal = written(goal.select(F.col("source").alias("s"), "source_size", "target", u.alias("u")), "mix-goal")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(source).alias("s"), F.col("size").cast("bigint").alias("size"), F.col(doc_id).alias("id"))
    hist = written(strata(rows, "s"), "mix-strata")
    rows = written(ranked(rows, "s", "size", "id", descending=True, rank="k"), "mix-ranks")
    parts = hist.groupBy("s", "part").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    # one row a source: for each part its rows, its words and the place of its last row before it
    wide = parts.groupBy("s").agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col(c))), F.lit(0)).alias(f"{c}{p}") for p in range(3) for c in ("n", "words")])
    plan = goal.alias("g").join(wide.alias("w"), F.expr("g.s <=> w.s")).select("g.*", *[f"w.{c}{p}" for p in range(3) for c in ("n", "words")])
    rate = lambda left, words: F.when(words > 0, F.floor(F.least(F.greatest(left / words, F.lit(0.0)), F.lit(float(MOST))) * SCALE)).otherwise(0).cast("bigint")
    plan = plan.withColumns({"b0": F.col("u"), "r0": rate(F.col("target"), F.col("source_size")), "a0": F.lit(0).cast("bigint")})
    for p in (1, 2):
        taken = _taken(rows, plan, p - 1)
        plan = plan.withColumns({f"a{p}": F.col(f"a{p - 1}") + F.col(f"n{p - 1}"), f"b{p}": F.col(f"b{p - 1}") + F.col(f"n{p - 1}") * F.col(f"r{p - 1}")})
        done = plan.alias("p").join(taken.alias("t"), F.expr("p.s <=> t.s"), "left").select("p.*", (F.coalesce("t.got", F.lit(0)) + (F.col("p.done") if p > 1 else F.lit(0))).alias("now"))
        left = sum((F.col(f"words{q}") for q in range(p, 3)), F.lit(0))
        done = done.withColumn(f"r{p}", rate(F.col("target") - F.col("now"), left)).drop("done").withColumnRenamed("now", "done")
        plan = written(done, "mix-plan")
    x = rows.alias("r").join(plan.alias("t"), F.expr("r.s <=> t.s")).select("r.*", "t.*", F.col("r.s").alias("rs"))
    out = x.withColumn("copies", _copies(F.col("k")).cast("int"))
    return out.select(*[F.col("row")[c].alias(c) for c in cols], "source_size", "target", "copies")


def _place(k):
    """Where the running sum of expected copies stands after row ``k`` of a source, in 1 / SCALE; the offset included."""
    def at(p):
        return F.col(f"b{p}") + (k - F.col(f"a{p}")) * F.col(f"r{p}")

    return F.when(k <= F.col("n0"), at(0)).when(k <= F.col("n0") + F.col("n1"), at(1)).otherwise(at(2))


def _copies(k):
    return F.shiftright(_place(k), 24) - F.shiftright(_place(k - 1), 24)


def _taken(rows: DataFrame, plan: DataFrame, part: int) -> DataFrame:
    """(s, got): words that the mix takes of each source's texts in ``part``."""
    x = rows.alias("r").join(plan.alias("t"), F.expr("r.s <=> t.s"))
    k, a, n = F.col("r.k"), F.col(f"t.a{part}"), F.col(f"t.n{part}")
    at = lambda i: F.shiftright(F.col(f"t.b{part}") + (i - a) * F.col(f"t.r{part}"), 24)
    x = x.filter((k > a) & (k <= a + n)).select(F.col("r.s").alias("s"), ((at(k) - at(k - 1)) * F.col("r.size")).alias("w"))
    return x.groupBy("s").agg(F.sum("w").cast("bigint").alias("got"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it.

    Null texts have size 0; nulls, ties, repeated rows and empty tables as in ``copies``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    slim = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "op3")
    return copies(slim).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
q AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM p),
r AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest FROM q),
s AS (SELECT *, (total - capped) / rest AS level, (total - capped) / rest * w <= 3 * source_size AS fits FROM r),
f AS (SELECT -min({'free': source_size / w, 'level': -level}).level AS level, min(source_size / w) AS free FROM s WHERE fits),
t AS (SELECT s.source, s.source_size, CASE WHEN s.source_size / s.w >= f.free THEN f.level * s.w ELSE (3 * s.source_size)::DOUBLE END::DOUBLE AS target FROM s, f),
h AS (SELECT source, size, count(*) AS n, (count(*) * size)::BIGINT AS words FROM d GROUP BY source, size),
hp AS (SELECT *, 8 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach, sum(words) OVER (PARTITION BY source) AS total FROM h),
hq AS (SELECT source, size, n, words, (reach >= 4 * total)::INT + (reach >= 7 * total)::INT AS part FROM hp),
w AS (SELECT t.source, any_value(target) AS target, any_value(t.source_size) AS source_size, ('0x' || substr(md5('0:' || coalesce(t.source, chr(0))), 1, 7))::BIGINT % 16777216 AS u,
    sum(n) FILTER (part = 0)::BIGINT AS n0, coalesce(sum(n) FILTER (part = 1), 0)::BIGINT AS n1, coalesce(sum(words) FILTER (part > 0), 0)::BIGINT AS words1, coalesce(sum(words) FILTER (part = 2), 0)::BIGINT AS words2
    FROM t JOIN hq ON t.source IS NOT DISTINCT FROM hq.source GROUP BY t.source),
x AS (SELECT d.doc_id, d.source, d.size, hq.part, row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) AS k
    FROM d JOIN hq ON d.source IS NOT DISTINCT FROM hq.source AND d.size = hq.size),
w0 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(least(greatest(target / source_size, 0), 3) * 16777216)::BIGINT ELSE 0 END AS r0 FROM w),
x0 AS (SELECT w0.source, sum((((u + k * r0) >> 24) - ((u + (k - 1) * r0) >> 24)) * size)::BIGINT AS got FROM x JOIN w0 ON x.source IS NOT DISTINCT FROM w0.source WHERE part = 0 GROUP BY w0.source),
w1 AS (SELECT w0.*, got AS got0, u + n0 * r0 AS b1, CASE WHEN words1 > 0 THEN floor(least(greatest((target - got) / words1, 0), 3) * 16777216)::BIGINT ELSE 0 END AS r1 FROM w0 JOIN x0 ON w0.source IS NOT DISTINCT FROM x0.source),
x1 AS (SELECT w1.source, sum((((b1 + (k - n0) * r1) >> 24) - ((b1 + (k - 1 - n0) * r1) >> 24)) * size)::BIGINT AS got FROM x JOIN w1 ON x.source IS NOT DISTINCT FROM w1.source WHERE part = 1 GROUP BY w1.source),
w2 AS (SELECT w1.*, b1 + n1 * r1 AS b2, CASE WHEN words2 > 0 THEN floor(least(greatest((target - got0 - coalesce(got, 0)) / words2, 0), 3) * 16777216)::BIGINT ELSE 0 END AS r2 FROM w1 LEFT JOIN x1 ON w1.source IS NOT DISTINCT FROM x1.source)
SELECT doc_id, size, source_size, target, (size * CASE part WHEN 0 THEN ((u + k * r0) >> 24) - ((u + (k - 1) * r0) >> 24)
    WHEN 1 THEN ((b1 + (k - n0) * r1) >> 24) - ((b1 + (k - 1 - n0) * r1) >> 24)
    ELSE ((b2 + (k - n0 - n1) * r2) >> 24) - ((b2 + (k - 1 - n0 - n1) * r2) >> 24) END)::BIGINT AS taken
FROM x JOIN w2 ON x.source IS NOT DISTINCT FROM w2.source
"""
