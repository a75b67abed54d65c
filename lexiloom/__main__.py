"""Command line: ``python -m lexiloom COMMAND ...``; ``--help`` after a command tells its options."""

from __future__ import annotations

import argparse
import sys
import time

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bytestrings import printable, utf8
from .operators import grams, learner, tokenset
from .plans import pipelines
from .session import resident, session, written
from .sources import tokensets

PANGRAM = "The quick brown fox jumps over the lazy dog."


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiloom", description="Text corpora and token tables on Spark")
    s = p.add_subparsers(dest="command", required=True)
    x = s.add_parser("top", help="the most frequent byte strings of some lengths")
    x.add_argument("lengths", help="for example 2,3,4")
    x.add_argument("--k", type=int, default=50)
    x.add_argument("--output", help="a folder for the rows (Parquet by length) and tokenset_LENGTH.bin files with counts")
    x = s.add_parser("learn", help="learn a vocabulary")
    x.add_argument("--tokenset", help="candidates: a token table; else they are mined from the corpus")
    x.add_argument("--kind", choices=["legacy", "counted", "vocabulary", "auto"], default="auto")
    x.add_argument("--size", type=int, default=300)
    x.add_argument("--steps", type=int, default=20)
    x.add_argument("--stats-path", help="a folder that keeps the candidates' counts between runs")
    x.add_argument("--in-memory", action="store_true", help="keep the corpus in memory between steps")
    x.add_argument("--load-vocab", help="a vocabulary file to go on from")
    x.add_argument("--refresh", type=int, help="cover the corpus anew after so many new tokens")
    x.add_argument("--output", help="write the vocabulary file")
    x = s.add_parser("shards", help="encode a corpus and write token shards")
    x.add_argument("--vocab", required=True)
    x.add_argument("--shard-size", type=int, default=100_000_000)
    x.add_argument("--output", required=True)
    x = s.add_parser("evaluate", help="bits per byte of texts, of one encoding and of all")
    x.add_argument("--vocab", required=True, help="a vocabulary file")
    x.add_argument("--probabilities", help="Parquet (token_id, p); else all tokens are equally probable")
    x.add_argument("--output", help="a folder for the report (JSON lines)")
    x.add_argument("--skip-standard", action="store_true")
    x.add_argument("--skip-all-paths", action="store_true")
    for name in ("top", "learn", "shards", "evaluate"):
        x = s.choices[name]
        x.add_argument("--corpus", required=name != "evaluate", nargs="+", help="Parquet files, or text files (.txt), each a document" + (f" (default: {PANGRAM!r})" if name == "evaluate" else ""))
        x.add_argument("--text", default="text", help="the text column of Parquet files")
    x = s.add_parser("tokens", help="show, filter or sum up a token table")
    x.add_argument("file")
    x.add_argument("--length", type=int)
    x.add_argument("--min-count", type=int, default=0)
    x.add_argument("--top", type=int, default=50)
    x.add_argument("--filter", action="store_true", help="keep only tokens that no filter names")
    x.add_argument("--summary", action="store_true")
    x.add_argument("--output", help="write the tokens as a plain token table")
    x = s.add_parser("combine", help="unite token tables, with every single byte")
    x.add_argument("files", nargs="+")
    x.add_argument("--output-tokenset", required=True)
    x.add_argument("--output-stats", help="statistics with the same ids")
    x = s.add_parser("prepare", help="unite and filter token tables; tells times and sizes")
    x.add_argument("files", nargs="+")
    x.add_argument("--output", required=True)
    for name in ("tokens", "combine", "prepare"):
        s.choices[name].add_argument("--kind", choices=["legacy", "counted", "vocabulary", "auto"], default="auto")
    return p


def corpus(spark: SparkSession, paths: list[str], text: str) -> DataFrame:
    """(doc_id, data) of Parquet tables and of text files, which are a document each; ids follow the given order of kinds."""
    plain, tables = [p for p in paths if p.endswith(".txt")], [p for p in paths if not p.endswith(".txt")]
    out = None
    if tables:
        out = spark.read.parquet(*tables).select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    if plain:
        x = spark.read.text(plain, wholetext=True).select(F.col("value").alias("t"))
        out = x if out is None else out.unionByName(x)
    return out.select(F.monotonically_increasing_id().alias("doc_id"), utf8("t").alias("data"))


def token_files(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """(name, token_id, len, token, n) of token tables, compressed or not, numbered files in the order of their numbers."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("name"), "content")
    return tokensets.read_tokens(tokensets.unzstd(tokenset.file_order(files)), kind)


def put(path: str, content: bytes) -> int:
    where, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    with where.open_output_stream(root) as f:
        f.write(content)
    return len(content)


def vocabulary(path: str) -> list[bytes]:
    where, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    with where.open_input_stream(root) as f:
        tokens, warnings = tokensets.unpack_vocabulary(f.read())
    for w in warnings:
        print(f"{path}: {w}", file=sys.stderr)
    return tokens


def tokens_command(spark: SparkSession, a) -> None:
    t = token_files(spark, [a.file], a.kind)
    t = tokenset.kept(t) if a.filter else t
    t = t.filter(F.col("len") == a.length) if a.length else t
    t = t.filter(F.coalesce("n", F.lit(0)) >= a.min_count)
    if a.output:
        rows = t.orderBy("len", "token").select("token").collect()  # a vocabulary
        print(f"{len(rows)} tokens, {put(a.output, tokensets.pack_legacy([bytes(r['token']) for r in rows]))} bytes")
    elif a.summary:
        tokenset.length_histogram(t).orderBy("len").show(300)
        tokenset.summary(t).show()
    else:
        t.orderBy(F.desc_nulls_last("n"), "token").limit(a.top).select("token_id", "len", printable(F.col("token")).alias("token"), "n").show(a.top, False)


def combine_command(spark: SparkSession, a) -> None:
    t = token_files(spark, a.files, a.kind).select("token", F.coalesce("n", F.lit(0)).alias("n"))
    raw, stats = pipelines.combine([t])
    print(f"{put(a.output_tokenset, raw)} bytes of tokens")
    if a.output_stats:
        print(f"{put(a.output_stats, stats)} bytes of statistics")


def prepare_command(spark: SparkSession, a) -> None:
    began = time.time()
    t = written(token_files(spark, a.files, a.kind).select("token"), "tokens")
    n, read = t.count(), time.time()
    kept, stats = pipelines.prepare([t])
    rows = kept.orderBy("len", "token").select("token").collect()  # a vocabulary
    size = put(a.output, tokensets.pack_legacy([bytes(r["token"]) for r in rows]))
    print(f"{n} tokens read in {read - began:.1f} s; {len(rows)} kept, {size} bytes, in {time.time() - read:.1f} s")
    stats.orderBy(F.desc("n")).show(20, False)


def top_command(spark: SparkSession, a, data: DataFrame) -> None:
    lengths = [int(n) for n in a.lengths.split(",")]
    x = grams.miner(data, lengths, a.k)
    if a.output:
        x = pipelines.mine(data, lengths, a.k, f"{a.output}/top.parquet")
        for n in lengths:
            rows = x.filter(F.col("len") == n).orderBy("rank").select("gram", "n_nonoverlap").collect()  # k rows
            put(f"{a.output}/tokenset_{n}.bin", tokensets.pack_counted([(bytes(r["gram"]), r["n_nonoverlap"]) for r in rows], int(time.time() * 1000)))
    x.orderBy("len", "rank").select("len", "rank", printable(F.col("gram")).alias("gram"), "n_total", "n_nonoverlap").show(a.k * len(lengths), False)


def learn_command(spark: SparkSession, a, data: DataFrame) -> None:
    data = resident(data) if a.in_memory else written(data, "corpus")
    if a.tokenset:
        rows = token_files(spark, [a.tokenset], a.kind).filter("len > 1").select("token").distinct().orderBy("token").collect()  # a vocabulary
    else:
        found = grams.top_grams(grams.gram_counts(data, [2, 3, 4, 5, 6]), 200).select(F.col("gram").alias("token"))
        rows = tokenset.kept(found).orderBy("token").collect()  # at most 200 of each length
    candidates = [bytes(r["token"]) for r in rows]
    if a.stats_path:
        counts = pipelines.statistics(data, candidates, a.stats_path, "file").collect()  # a candidate each
        # the largest possible savings first; those that stand nowhere are left out
        candidates = [bytes(r["token"]) for r in sorted(counts, key=lambda r: (-r["est_savings"], bytes(r["token"]))) if r["n_total"]]
    start = vocabulary(a.load_vocab) if a.load_vocab else None
    state = learner.learn(data, candidates, a.size, a.steps, refresh=a.refresh, start=start)
    print(f"{len(state.vocab)} tokens after {len(state.history)} changes")
    if a.output:
        put(a.output, tokensets.pack_vocabulary(state.vocab))


def evaluate_command(spark: SparkSession, a) -> None:
    data = corpus(spark, a.corpus, a.text) if a.corpus else spark.createDataFrame([(0, PANGRAM.encode())], "doc_id long, data binary")
    data, tokens = written(data, "evaluate"), vocabulary(a.vocab)
    p = [1 / len(tokens)] * len(tokens)
    if a.probabilities:
        for r in spark.read.parquet(a.probabilities).select("token_id", "p").collect():  # a vocabulary
            p[r["token_id"]] = r["p"]
    x = pipelines.evaluate(data, tokens, p)
    if a.skip_all_paths:
        x = x.drop("all_paths_bpb")
    if a.skip_standard:
        x = x.drop("bpb")
    if a.output:
        pipelines.report(x, a.output)
        x = spark.read.schema(x.schema).json(a.output)
    x.orderBy("doc_id").show(20, False)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "tokens":
        tokens_command(spark, a)
    elif a.command == "combine":
        combine_command(spark, a)
    elif a.command == "prepare":
        prepare_command(spark, a)
    elif a.command == "evaluate":
        evaluate_command(spark, a)
    else:
        data = corpus(spark, a.corpus, a.text)
        if a.command == "top":
            top_command(spark, a, data)
        elif a.command == "learn":
            learn_command(spark, a, data)
        else:
            files = pipelines.build_shards(written(data, "corpus"), vocabulary(a.vocab), a.output, a.shard_size)
            files.orderBy("shard").show(100, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
