"""Operator 8: substring dedup by seed and extend.

A window is 50 consecutive words. A word goes if a window over it also starts in a document with a
smaller doc_id. Every window holds at least one *anchor*: a 26-word gram whose hash is the least of
25 consecutive ones (winnowing), chosen by content alone, so equal windows hold equal anchors.

1. Seed: documents are joined on anchors (pre-aggregated: an anchor counts if two doc_ids have it).
2. Extend along anchors: from each shared anchor, the stretch up to an anchor 75 words or more on is
   one key; a stretch that a smaller document has too settles all windows inside it. Whole copies
   and the inside of long repeats need no more than this, one row for about thirteen words.
3. Extend both ways at the ends of repeats: only anchors with unsettled windows stay active; each
   document that has an active anchor gives the 25 windows over it, and a window goes if the least
   doc_id with its words is smaller. Keys of windows are 128-bit hashes, those of stretches too.
4. The words under settled stretches and removed windows are the maximal repeats over the threshold.

No pairs are made: a group of any size is one minimum of doc_id, taken before the shuffle. So a match is not extended
word by word against one partner (a window may be shared with one smaller document and the next window with
another, and trying all partners would take all pairs of a group): each step of the extension is a key of the words it
adds, and all documents that can take the step meet in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, flat, gram_hashes, mix, powers, split_words, table, written

WINDOW = 50
GRAM = 26
REACH = WINDOW - GRAM  # an anchor lies in the windows that start at most so many words before it
STRETCH = WINDOW + REACH + 1


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    n, step = len(x) - width + 1, 1
    y = x
    while 2 * step <= width:
        y = op(y[:-step], y[step:])
        step *= 2
    return op(y[:n], y[width - step : width - step + n])


def anchors(grams: np.ndarray) -> np.ndarray:
    """Positions of grams that are least in some window of REACH + 1 grams.

    Where the least hash repeats (runs and cycles of words), only so many of its places stay that no
    REACH + 1 of them in a row are passed over: every window keeps one, with the same hash.
    """
    w = REACH + 1
    if len(grams) < w:
        return np.zeros(0, np.int64)
    least = _sliding(grams, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    pos = np.flatnonzero(_sliding(padded, w, np.maximum) == grams)
    order = np.lexsort((pos, grams[pos]))
    p, v = pos[order], grams[pos][order]
    edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
    many = np.flatnonzero(np.diff(edge) > 2)
    if not len(many):
        return pos
    keep = np.ones(len(p), bool)
    for a, b in zip(edge[many].tolist(), edge[many + 1].tolist(), strict=True):
        last = p[a]
        for k in range(a + 1, b - 1):
            if p[k + 1] - last <= w:
                keep[k] = False
            else:
                last = p[k]
    return np.sort(p[keep])


def stretch_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        p, inverse = powers(0x94D049BB133111EB, len(words) + 1)
        c = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * p[: len(words)], out=c[1:])
        return mix((c[b] - c[a]) * inverse[a])


SEEDS = "doc_id bigint, rk int, n int, pos int, h bigint, t bigint, tend int"


def seeds(docs: DataFrame) -> DataFrame:
    """Anchors of (doc_id, rk, text): position, hash, and the stretch from it (tend 0: there is none)."""
    names = [x.split()[0] for x in SEEDS.split(", ")]

    def run(batches):
        for batch in batches:
            ids, rks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, off = flat(batch.column(2))
            out: list[list] = [[] for _ in names]
            for i, (words, _, _) in enumerate(split_words(data, off)):
                if len(words) < WINDOW:
                    continue
                g = gram_hashes(words, GRAM)
                pos = anchors(g)
                far = np.searchsorted(pos, pos + (STRETCH - GRAM))
                some = far < len(pos)
                tend = np.zeros(len(pos), np.int64)
                tend[some] = pos[far[some]] + GRAM
                t = np.zeros(len(pos), np.uint64)
                t[some] = stretch_hashes(words, pos[some], tend[some])
                for k, v in enumerate((np.full(len(pos), ids[i]), np.full(len(pos), rks[i]), np.full(len(pos), len(words)), pos, g[pos].view(np.int64), t.view(np.int64), tend)):
                    out[k].append(v)
            if out[0]:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), k) for v, k in zip(out, kinds, strict=True)], names)

    return docs.select("doc_id", "rk", "text").mapInArrow(run, SEEDS)


def _covered(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions below ``size`` inside the half-open ranges from ``a`` to ``b``."""
    size = max(size, 0)
    a, b = np.clip(a, 0, size), np.clip(b, 0, size)
    some = a < b
    d = np.bincount(a[some], minlength=size + 1) - np.bincount(b[some], minlength=size + 1)
    return np.cumsum(d[:size]) > 0


def unsettled(n: int, pos: np.ndarray, tend: np.ndarray) -> np.ndarray:
    """Mask over window starts: over a shared anchor, not inside a settled stretch (tend 0: none)."""
    starts, some = n - WINDOW + 1, tend > 0
    return _covered(pos - REACH, pos + 1, starts) & ~_covered(pos[some], tend[some] - WINDOW + 1, starts)


def _rows(column) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column; null lists are empty."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(n)]), column.flatten()


def _zstd(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, z): texts under zstd, for the shuffle."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            data, off = flat(batch.column(2))
            raw, o = data.tobytes(), off.tolist()
            z = [codec.compress(raw[a:b], asbytes=True) if b > a else b"" for a, b in zip(o[:-1], o[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary()), pa.array(np.diff(off), pa.int64())], ["doc_id", "rk", "z", "size"])

    return docs.select("doc_id", "rk", "text").mapInArrow(run, "doc_id bigint, rk int, z binary, size bigint")


def _unzstd(z: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(z, decompressed_size=size, asbytes=True) if size else b""


def removals(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(doc_id, rk, from, to): word ranges to remove, for rows that lose any."""
    s = written(seeds(docs), "op8-seeds")
    shared = s.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("_most")).filter("least < _most").drop("_most")
    shared = written(shared, "op8-repeated")  # read back, its join's hot keys can be split
    s1 = written(s.join(shared, "h"), "op8-shared")
    repeated = s1.filter("tend > 0").groupBy("h", "t").agg(F.min("doc_id").alias("tleast"), F.max("doc_id").alias("_most")).filter("tleast < _most").drop("_most")
    repeated = written(repeated, "op8-stretches")
    x = s1.join(repeated, ["h", "t"], "left")
    settled = F.when(F.coalesce(F.col("tleast") < F.col("doc_id"), F.lit(False)), F.col("tend")).otherwise(0)
    by_doc = x.groupBy("doc_id", "rk").agg(F.first("n").alias("n"), F.array_sort(F.collect_set(F.struct("pos", "h", (F.col("least") < F.col("doc_id")).alias("asks"), settled.alias("tend")))).alias("seeds"))
    by_doc = written(by_doc, "op8-by-doc")

    def active(batches):
        for batch in batches:
            off, all_seeds = _rows(batch.column(1))
            h, pos, asks, tend = (all_seeds.field(all_seeds.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "pos", "asks", "tend"))
            pos, tend, out = pos.astype(np.int64), tend.astype(np.int64), []
            for n, x, y in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                p = pos[x:y]
                open_at = np.concatenate([[0], np.cumsum(unsettled(n, p, tend[x:y]))])
                top = len(open_at) - 1
                left = open_at[np.minimum(top, p + 1)] > open_at[np.clip(p - REACH, 0, top)]
                out.append(h[x:y][left & asks[x:y]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else [], pa.int64())], ["h"])

    asked = written(by_doc.select("n", "seeds").mapInArrow(active, "h bigint").distinct(), "op8-active")
    each = by_doc.select("doc_id", "rk", F.explode("seeds").alias("s")).select("doc_id", "rk", "s.h", "s.pos")
    places = each.join(asked, "h", "left_semi").groupBy("doc_id", "rk").agg(F.collect_list("pos").alias("at"))

    names = ["w1", "w2", "doc_id", "rk", "s"]

    def windows(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            ids, rks, zs, sizes = (c.to_pylist() for c in batch.columns[:4])
            off, places = _rows(batch.column(4))
            places = places.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, r, z, size, x, y in zip(ids, rks, zs, sizes, off[:-1].tolist(), off[1:].tolist(), strict=True):
                raw, at = np.frombuffer(_unzstd(z, size), np.uint8), places[x:y]
                words = next(split_words(raw, np.array([0, len(raw)])))[0]
                near = np.flatnonzero(_covered(at - REACH, at + 1, len(words) - WINDOW + 1))
                for k, v in enumerate((gram_hashes(words, WINDOW)[near].view(np.int64), gram_hashes(words, WINDOW, 1)[near].view(np.int64), np.full(len(near), i), np.full(len(near), r), near)):
                    out[k].append(v)
            if out[0]:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), k) for v, k in zip(out, kinds, strict=True)], names)

    w = packed.join(places, ["doc_id", "rk"]).select("doc_id", "rk", "z", "size", "at").mapInArrow(windows, "w1 bigint, w2 bigint, doc_id bigint, rk int, s int")
    w = written(w, "op8-windows")
    first = w.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("_most")).filter("least < _most").drop("_most")
    first = written(first, "op8-first")
    single = w.join(first, ["w1", "w2"]).filter("least < doc_id").select("doc_id", "rk", F.col("s").alias("from"), (F.col("s") + WINDOW).alias("to"))
    inside = by_doc.select("doc_id", "rk", F.explode(F.filter("seeds", lambda s: s["tend"] > 0)).alias("s")).select("doc_id", "rk", F.col("s.pos").alias("from"), F.col("s.tend").alias("to"))
    return single.unionByName(inside)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Add n_words, n_removed, kept (the kept words joined by a space) to rows of (doc_id, text, any other columns).

    Null and empty texts have no words; texts of fewer than 50 words lose none. Rows of one doc_id
    do not count against each other, whatever their texts; rows with a null doc_id stay whole and
    count against none. Columns of ``docs`` named like a result are replaced.
    """
    bound_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed", "kept")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.hash("text", F.lit(8)).alias("rk"), F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("rest"))
    slim = rows.select("doc_id", "rk", "text").filter("doc_id is not null and text is not null")
    gone = removals(slim, _zstd(slim)).groupBy("doc_id", "rk").agg(F.collect_list("from").alias("from"), F.collect_list("to").alias("to"))
    x = rows.join(gone, ["doc_id", "rk"], "left")
    schema = x.select("doc_id", "text", "rest").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    names = [f.name for f in schema]

    def cut(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            raw, n, m, kept = data.tobytes(), [], [], []
            (at, a), (_, b) = _rows(batch.column(3)), _rows(batch.column(4))
            a, b = (v.to_numpy(zero_copy_only=False).astype(np.int64) for v in (a, b))
            for i in range(batch.num_rows):
                words, x, y = raw[off[i] : off[i + 1]].split(), at[i], at[i + 1]
                n.append(len(words))
                if x < y:
                    keep = ~_covered(a[x:y], b[x:y], len(words))
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                m.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.string())], names)

    done = x.select("doc_id", "text", "rest", "from", "to").mapInArrow(cut, schema)
    return done.select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in rest], "n_words", "n_removed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every whole text of ``documents``, without the words of 50-word
    windows that start in a document of smaller doc_id too. Nulls, ties, repeated rows: see ``substring_dedup``."""
    out = substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def stage_substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a text that loses nothing stays as it is, one that loses every word goes."""
    out = substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT id, doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS w FROM (SELECT id, doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM d WHERE len(words) >= 50)),
m AS (SELECT id, s FROM (SELECT id, s, doc_id, min(doc_id) OVER (PARTITION BY w) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT id, unnest(range(s, s + 50)) AS i FROM m),
k AS (SELECT d.id, count(c.i)::BIGINT AS n_removed, list(i) AS gone FROM d JOIN c USING (id) GROUP BY d.id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE (SELECT list(w ORDER BY i) FROM (SELECT unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i) t
        WHERE i NOT IN (SELECT unnest(gone))) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (id)
"""
