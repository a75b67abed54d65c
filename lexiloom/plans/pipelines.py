"""Programs composed of the operators: the top-K miner, token table preparation, corpus to shards, evaluation."""

from __future__ import annotations

import hashlib
import uuid

from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches, bpb, grams, learner, matching, segment, tokenset
from ..session import shared_folder, written
from ..sources import shards, tokensets


def mine(corpus: DataFrame, lengths: list[int], k: int, out: str) -> DataFrame:
    """Top k grams of each length with both counts, written as Parquet by length."""
    x = grams.miner(corpus, lengths, k)
    x.write.mode("overwrite").partitionBy("len").parquet(out)
    return corpus.sparkSession.read.parquet(out)


def prepare(tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(kept, statistics): the union of token tables, filtered, and how many tokens each filter met."""
    x = tokenset.union_complete(*tables)
    return tokenset.kept(x), tokenset.filter_stats(x)


def combine(tables: list[DataFrame]) -> tuple[bytes, bytes]:
    """(token table, statistics) as files: the union of counted tables (token, n) in the plain form with every single
    byte, counts of 0 where a table has none, and statistics of the same ids. A vocabulary reaches the driver."""
    x = tables[0].select("token", "n")
    for t in tables[1:]:
        x = x.unionByName(t.select("token", "n"))
    counts = x.groupBy("token").agg(F.sum("n").cast("bigint").alias("n"))
    rows = tokenset.union_complete(counts).join(counts, "token", "left").orderBy("token_id").select("token_id", "token", F.coalesce("n", F.lit(0)).alias("n")).collect()
    stats = [(r["token_id"], r["n"], r["n"], float(r["n"] * (len(r["token"]) - 1))) for r in rows]
    return tokensets.pack_legacy([bytes(r["token"]) for r in rows]), tokensets.pack_stats(stats, [])


def _put(folder: str, name: str, content: bytes) -> None:
    where, root = pa_fs.FileSystem.from_uri(folder if ":" in folder else "file://" + folder)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(spare := f"{root}/.{uuid.uuid4().hex}") as f:
        f.write(content)
    where.move(spare, f"{root}/{name}")


def _fingerprints(corpus: DataFrame, parts: int = 64) -> list[int]:
    """A 63-bit number for each of some parts of a corpus: sums of the texts' hashes, whatever their order."""
    h = F.conv(F.substring(F.sha1("data"), 1, 14), 16, 10).cast("bigint")
    x = corpus.select(h.alias("h")).groupBy(F.pmod("h", F.lit(parts)).alias("part")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return sorted((int(r["s"]) * 1_000_003 + r["n"] * 64 + r["part"]) % (1 << 63) for r in x.collect())  # one row a part


def _file_statistics(corpus: DataFrame, tokens: list[bytes], cache: str) -> DataFrame:
    """Statistics as one file of fixed-size rows, valid for the same number of tokens and the same texts."""
    spark, hashes = corpus.sparkSession, _fingerprints(corpus)
    # the tokens count as a part of the corpus: ids mean nothing without them
    hashes.append(int.from_bytes(hashlib.sha1(b"\0".join(tokens)).digest()[:7], "big"))
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "token_stats.bin").load(cache).select("content").first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    rows = tokensets.unpack_stats(bytes(found["content"]), len(tokens), hashes) if found else None
    if rows is None:
        x = matching.match_counts(corpus, matching.Dictionary(tokens)).select("token_id", "n_total", "n_nonoverlap", "est_savings").orderBy("token_id").collect()
        rows = [(r[0], r[1], r[2], float(r[3])) for r in x]  # a vocabulary
        _put(cache, "token_stats.bin", tokensets.pack_stats(rows, hashes))
    table = [(i, tokens[i], total, apart, int(saved)) for i, total, apart, saved in rows]
    return spark.createDataFrame(table, "token_id int, token binary, n_total long, n_nonoverlap long, est_savings long")


def statistics(corpus: DataFrame, tokens: list[bytes], cache: str | None = None, form: str = "parquet") -> DataFrame:
    """Counts of each token over the corpus; read from ``cache`` if it is of the same texts and tokens.

    form: ``parquet`` keeps the counts and a manifest of all texts as tables, ``file`` one file of statistics.
    """
    if cache and form == "file":
        return _file_statistics(corpus, tokens, cache)
    spark = corpus.sparkSession
    manifest = corpus.select(F.sha1("data").alias("hash")).unionByName(spark.createDataFrame([(t.hex(),) for t in tokens], "hash string"))
    if cache:
        try:
            if tokenset.differ(manifest, spark.read.parquet(f"{cache}/manifest")).first()[0]:
                return spark.read.parquet(f"{cache}/stats")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    x = matching.match_counts(corpus, matching.Dictionary(tokens))
    if not cache:
        return x
    x.write.mode("overwrite").parquet(f"{cache}/stats")
    manifest.write.mode("overwrite").parquet(f"{cache}/manifest")
    return spark.read.parquet(f"{cache}/stats")


def tokenize(docs: DataFrame, tokens: list[bytes], key: str = "doc_id", data: str = "data", eot: int = batches.EOT, whole: bool = False) -> DataFrame:
    """(key, token_ids): a separator and each document's canonical tokens; whole: without cutting it into segments first."""
    x = (segment.encode_bytes if whole else segment.encode_texts)(docs, tokens, key, data)
    return x.select(F.col(key), F.concat(F.array(F.lit(eot)), "token_ids").alias("token_ids"))


def build_shards(docs: DataFrame, tokens: list[bytes], folder: str, shard_size: int, key: str = "doc_id", data: str = "data", eot: int = batches.EOT, whole: bool = False) -> DataFrame:
    """Encode documents, a separator before each, and write them as shards of a fixed size in the order of ``key``.

    Returns (shard, file, n_tokens). The first shard is for validation.
    """
    x = tokenize(docs, tokens, key, data, eot, whole)
    x = written(x.withColumn("n_tokens", F.size("token_ids").cast("bigint")), "encoded")
    p = batches.shard_pieces(batches.global_offsets(x, key, "n_tokens"), shard_size)
    cut = p.select("shard", "split", "at", F.slice("token_ids", (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")).alias("token_ids"))
    return shards.write_shards(cut, folder)


def evaluate(docs: DataFrame, tokens: list[bytes], p: list[float], key: str = "doc_id", data: str = "data", whole: bool = False) -> DataFrame:
    """(key, n_bytes, bpb, all_paths_bpb): canonical bits per byte beside those of all paths, which are no more."""
    ids = (segment.encode_bytes if whole else segment.encode_texts)(docs, tokens, key, data)
    table = docs.sparkSession.createDataFrame(list(enumerate(map(float, p))), "token_id int, p double")
    one = ids.select(key, F.explode("token_ids").alias("token_id")).join(table, "token_id").groupBy(key).agg(F.sum(-F.log2("p")).alias("bits"))
    every = bpb.all_paths_bpb(docs, tokens, p, key, data).withColumnRenamed("bpb", "all_paths_bpb")
    return every.join(one, key, "left").select(key, "n_bytes", (F.col("bits") / F.col("n_bytes")).alias("bpb"), "all_paths_bpb")


def report(rows: DataFrame, folder: str) -> None:
    """Write a report as lines of JSON."""
    rows.write.mode("overwrite").json(folder)


def learn_vocabulary(spark: SparkSession, corpus: DataFrame, size: int, lengths=(2, 3, 4, 5, 6), k: int = 200, steps: int = 20) -> learner.State:
    """Mine candidates, filter them, and learn a vocabulary of ``size`` tokens."""
    found = grams.top_grams(grams.gram_counts(corpus, list(lengths)), k).select(F.col("gram").alias("token"))
    rows = tokenset.kept(found).orderBy("token").collect()  # at most k of each length
    return learner.learn(corpus, [bytes(r["token"]) for r in rows], size, steps)


def shard_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lexiloom/shards-{uuid.uuid4().hex}"
