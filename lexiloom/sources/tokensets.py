"""Binary token tables: the legacy set, the counted set (version 3), learned vocabularies, statistics; and text sources.

Readers take (name, content) of whole files, as ``binaryFile`` gives them; such files are vocabularies, not corpora.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- legacy: 256 counts (slot i: tokens of length i + 1), then the bytes by length


def pack_legacy(tokens: list[bytes]) -> bytes:
    """Tokens of 1 to 256 bytes, by length in the order given; others are refused."""
    if any(not 1 <= len(t) <= 256 for t in tokens):
        raise ValueError("tokens have 1 to 256 bytes")
    by = [[t for t in tokens if len(t) == n] for n in range(1, 257)]
    return struct.pack("<256I", *map(len, by)) + b"".join(b"".join(x) for x in by)


def unpack_legacy(content: bytes, most: int = 256, need_bytes: bool = False) -> list[bytes]:
    counts, at, out = struct.unpack_from("<256I", content), 1024, []
    for n, k in enumerate(counts, 1):
        for _ in range(k):
            if at + n > len(content):
                raise ValueError("the token table is cut short")
            if n <= most:
                out.append(content[at : at + n])
            at += n
    if need_bytes and len({t for t in out if len(t) == 1}) != 256:
        raise ValueError("some single bytes are missing")
    return out


# ---- version 3: version, 256 counts (slot i: tokens of length i), metadata, then tokens with 64-bit counts


def pack_counted(rows: list[tuple[bytes, int]], timestamp_ms: int = 0, seed: int = 0, hashes: list[int] = ()) -> bytes:
    """All lengths up to 255, by length in the order given."""
    if any(not 1 <= len(t) <= 255 for t, _ in rows):
        raise ValueError("tokens have 1 to 255 bytes")
    by = [[r for r in rows if len(r[0]) == n] for n in range(256)]
    head = struct.pack("<257I", 3, *map(len, by)) + struct.pack("<IQQ", len(hashes), timestamp_ms, seed) + struct.pack(f"<{len(hashes)}Q", *hashes)
    return head + b"".join(t + struct.pack("<Q", n) for x in by for t, n in x)


def unpack_counted(content: bytes) -> tuple[list[tuple[bytes, int]], dict]:
    version, *counts = struct.unpack_from("<257I", content)
    if version < 3:
        raise ValueError(f"version {version}")
    n_files, timestamp, seed = struct.unpack_from("<IQQ", content, 1028)
    hashes = list(struct.unpack_from(f"<{n_files}Q", content, 1048))
    at, out = 1048 + 8 * n_files, []
    for n, k in enumerate(counts):
        for _ in range(k):
            out.append((content[at : at + n], struct.unpack_from("<Q", content, at + n)[0]))
            at += n + 8
    return out, {"file_count": n_files, "timestamp_ms": timestamp, "hash_seed": seed, "file_hashes": hashes}


# ---- learned vocabularies: VOCA, size, 20 spare bytes, then (id, length, bytes)


def pack_vocabulary(tokens: list[bytes]) -> bytes:
    return b"VOCA" + struct.pack("<I", len(tokens)) + bytes(20) + b"".join(struct.pack("<II", i, len(t)) + t for i, t in enumerate(tokens))


def unpack_vocabulary(content: bytes) -> tuple[list[bytes], list[str]]:
    """Tokens and warnings; ids out of sequence are an error."""
    warnings = [] if content[:4] == b"VOCA" else ["the magic number is wrong"]
    size, at, out = struct.unpack_from("<I", content, 4)[0], 28, []
    for want in range(size):
        i, n = struct.unpack_from("<II", content, at)
        if i != want:
            raise ValueError(f"token {want} has id {i}")
        if at + 8 + n > len(content):
            raise ValueError("the vocabulary is cut short")
        out.append(content[at + 8 : at + 8 + n])
        at += 8 + n
    return out, warnings + ([f"{len(content) - at} bytes follow"] if at < len(content) else [])


# ---- token statistics: TOKSTAT, counts, file hashes, then (id, total, apart, savings)


def pack_stats(rows: list[tuple[int, int, int, float]], hashes: list[int]) -> bytes:
    return b"TOKSTAT\0" + struct.pack("<QQ", len(rows), len(hashes)) + struct.pack(f"<{len(hashes)}Q", *sorted(hashes)) + b"".join(struct.pack("<IQQd", *r) for r in rows)


def unpack_stats(content: bytes, n_tokens: int | None = None, hashes: list[int] | None = None) -> list[tuple[int, int, int, float]] | None:
    """The rows, or None if they are of other tokens or another corpus."""
    if content[:8] != b"TOKSTAT\0":
        return None
    n, k = struct.unpack_from("<QQ", content, 8)
    found = list(struct.unpack_from(f"<{k}Q", content, 24))
    if (n_tokens is not None and n != n_tokens) or (hashes is not None and found != sorted(hashes)):
        return None
    return [struct.unpack_from("<IQQd", content, 24 + 8 * k + 28 * i) for i in range(n)]


# ---- DataFrames


def read_tokens(content: DataFrame, kind: str, most: int = 256) -> DataFrame:
    """(name, token_id, len, token, n) of files (name, content); kind: legacy, counted, vocabulary or auto.

    auto takes files of version 3 or more as counted; a legacy file whose first count is 3 or more looks
    the same, so name the kind where it is known. n is null where the format has no counts.
    """

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                form = kind if kind != "auto" else "vocabulary" if raw[:4] == b"VOCA" else "counted" if struct.unpack_from("<I", raw)[0] >= 3 else "legacy"
                if form == "counted":
                    rows = [(t, n) for t, n in unpack_counted(raw)[0] if len(t) <= most]
                else:
                    rows = [(t, None) for t in (unpack_vocabulary(raw)[0] if form == "vocabulary" else unpack_legacy(raw, most))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([len(t) for t, _ in rows], pa.int32()), pa.array([t for t, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["name", "token_id", "len", "token", "n"])

    return content.select("name", "content").mapInArrow(run, "name string, token_id int, len int, token binary, n bigint")


def unzstd(content: DataFrame) -> DataFrame:
    """(name, content): files that end in .zst are decompressed and lose the ending."""

    def run(batches):
        import zstandard

        for batch in batches:
            names, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raws = [zstandard.ZstdDecompressor().decompressobj().decompress(r) if n.endswith(".zst") else r for n, r in zip(names, raws, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([n.removesuffix(".zst") for n in names]), pa.array(raws, pa.binary())], ["name", "content"])

    return content.select("name", "content").mapInArrow(run, "name string, content binary")


def vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token) of a JSON object from printable strings to ids, back to bytes."""
    from ..functions.codec import bytes_udf

    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("letters", "token_id"))
    return x.select("token_id", bytes_udf("letters").alias("token"))


def weighted_lines(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad) of ``length,string,frequency`` lines: good (length, content, frequency) keeps the declared length.

    Blank lines go; a line that has no three fields (a comma in the string makes four) or no whole numbers is bad.
    """
    x = lines.select(F.trim(value).alias("line")).filter("line <> ''").withColumn("p", F.split("line", ",", -1))
    n, f = F.trim(F.col("p")[0]).try_cast("int"), F.trim(F.get("p", F.lit(2))).try_cast("bigint")
    ok = (F.size("p") == 3) & n.isNotNull() & f.isNotNull()
    good = x.filter(F.coalesce(ok, F.lit(False))).select(n.alias("length"), F.trim(F.get("p", F.lit(1))).alias("content"), f.alias("frequency"))
    return good, x.filter(~F.coalesce(ok, F.lit(False))).select("line")


def fingerprints(content: DataFrame) -> DataFrame:
    """(name, hash): the first 64 bits of each file's SHA-1, as hexadecimal digits."""
    return content.select("name", F.substring(F.sha1("content"), 1, 16).alias("hash"))


def align(vocab: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, strange): vocabulary tokens with their candidate ids, and those that are no candidate."""
    known = vocab.select("token").join(candidates.select("token_id", "token"), "token")
    return known, vocab.select("token").join(candidates, "token", "left_anti")
