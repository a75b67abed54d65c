"""Shared pieces of the training-data operators: session bounds, the shared folder, and vectorised words.

A *word* is a run of bytes outside ``\\x20 \\x09-\\x0D`` everywhere in this subpackage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

#: Java and DuckDB pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass holds at a time (about forty bytes of working memory for each).
CHUNK = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, so a run of long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a fresh one only where it is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Tables that this process has written and not removed.
_made: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make, label: str) -> DataFrame:
    """``make()`` written as a table; every other table that was written for it is removed, since nothing reads it any more."""
    mark = len(_made)
    out = written(make(), label)
    for path in _made[mark:-1]:
        remove(spark, path)
    del _made[mark:-1]
    return out


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Parts that the rows of one key are spread over where they meet a row of their key.
SALTS = 64


def with_group(rows: DataFrame, keys: list[str], by, name: str, part, whole) -> DataFrame:
    """Add ``name``, an aggregate over the rows that share ``keys`` (null is a value), without gathering a key's rows in one task.

    Rows are salted by a hash of ``by``; ``part`` aggregates a salt's rows and ``whole`` the column ``_n`` of these, and
    the result is sent to the salts that a key has, so the join deals a hot key to SALTS tasks.
    """
    x = rows.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(41)), F.lit(SALTS)).cast("int"))
    total = x.groupBy(*keys, "_salt").agg(part.alias("_n")).groupBy(*keys).agg(whole.alias(name), F.collect_set("_salt").alias("_salts"))
    total = total.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name, F.explode("_salts").alias("_ks"))
    on = F.col("_salt") == F.col("_ks")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return x.join(total, on).select(*rows.columns, name)


def with_counts(rows: DataFrame, keys: list[str], by, name: str) -> DataFrame:
    """Add the number of rows that share ``keys``; see ``with_group``."""
    return with_group(rows, keys, by, name, F.count("*"), F.sum("_n"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns dealt to all cores (see ``spread``)."""
    x = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(x.select(*columns)) if columns else x


def held_out(doc_id, modulus: int, remainder: int):
    """``crc32(doc_id as text) mod modulus = remainder``; a null id counts as an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def md5_int(col):
    """28 bits of md5 of a column as text (null: empty), the same in Spark and DuckDB, monotone in the md5 string."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("bigint")


# ---------------------------------------------------------------- flat byte views of Arrow strings


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array and n + 1 offsets into them; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = pa.large_binary()
    array = array.cast(kind) if array.type != kind else array
    if array.null_count:
        array = pc.fill_null(array, b"")
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = CHUNK):
    """Ranges of rows that hold about ``limit`` bytes each; a longer row stands alone."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte past the end of each word; words never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    at = off[:-1][off[:-1] < off[1:]]
    first[at] = solid[at]
    end = off[1:][off[:-1] < off[1:]] - 1
    last[end] = solid[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_P, _Q = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < 2**bits."""
    n, out = 1 << bits, []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        step, k = np.uint64(b), 1
        while k < n:
            p[k : 2 * k] = p[:k] * step
            step, k = step * step, 2 * k
        out.append(p)
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(int(base), max(10, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial over pieces of about CHUNK bytes."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
            lo, hi = starts[a], ends[b - 1]
            p, inverse = powers(_P, hi - lo)
            c = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=c[1:])
            s, e = starts[a:b] - lo, ends[a:b] - lo
            out[a:b] = mix((c[e] - c[s]) * inverse[s])
            a = b
    return out


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive word hashes (none if there are fewer)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.empty(n - k + 1, np.uint64)
        for a in range(0, len(out), CHUNK):
            part = words[a : min(n, a + CHUNK + k - 1)]
            p, inverse = powers(_Q if not salt else _P, len(part) + 1)
            if salt:
                part = mix(part + np.uint64(salt))
            c = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * p[: len(part)], out=c[1:])
            m = len(part) - k + 1
            out[a : a + m] = mix((c[k : k + m] - c[:m]) * inverse[:m])
    return out


def split_words(data: np.ndarray, off: np.ndarray):
    """For each row: hashes, first bytes and end bytes of its words."""
    for a, b in slices(off):
        part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        s, e = word_spans(part, o)
        h = span_hashes(part, s, e)
        cut = np.searchsorted(s, o)
        for i in range(b - a):
            x, y = cut[i], cut[i + 1]
            yield h[x:y], s[x:y] - o[i], e[x:y] - o[i]


_WORD_BYTES = re.compile(rb"[^\x20\x09-\x0d]+")


def words_of(text: str | None) -> list[str]:
    """Words of one text, for small inputs and brute-force checks."""
    return [w.decode("utf-8") for w in _WORD_BYTES.findall((text or "").encode("utf-8"))]
