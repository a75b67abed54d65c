"""Byte-pair merges over a table of weighted strings, and pruning by the tokens' worth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .matching import Dictionary
from .segment import Cover


def segments(strings: DataFrame, content: str = "content", frequency: str = "frequency") -> DataFrame:
    """(string_id, seg, frequency): each distinct string as the array of its single bytes (latin-1)."""
    x = strings.groupBy(content).agg(F.sum(frequency).cast("bigint").alias("frequency"))
    latin = F.decode(F.encode(F.col(content), "utf-8"), "ISO-8859-1")
    return x.select(F.col(content).alias("string_id"), F.filter(F.split(latin, ""), lambda c: c != "").alias("seg"), "frequency")


def pair_counts(seg: DataFrame) -> DataFrame:
    """(first, second, n): adjacent pairs weighted by the string's frequency."""
    pairs = F.when(F.size("seg") > 1, F.zip_with(F.slice("seg", 1, F.size("seg") - 1), F.slice("seg", 2, F.size("seg") - 1), lambda a, b: F.struct(a.alias("first"), b.alias("second"))))
    return seg.select("frequency", F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.sum("frequency").alias("n"))


def best_pair(counts: DataFrame):
    """The most frequent pair, ties to the smaller pair; None without pairs."""
    return counts.orderBy(F.desc("n"), "first", "second").first()


def merged(seg: Column, first: str, second: str) -> Column:
    """The array with every (first, second) joined, from the left."""

    def step(acc, x):
        joins = F.coalesce((F.try_element_at(acc, F.lit(-1)) == first) & (x == second), F.lit(False))
        return F.when((F.size(acc) > 0) & joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(first + second)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(seg, F.array().cast("array<string>"), step)


def inverted_index(seg: DataFrame) -> DataFrame:
    """(token, string_id, n): how often each token stands in each string."""
    return seg.select("string_id", F.explode("seg").alias("token")).groupBy("token", "string_id").agg(F.count("*").alias("n"))


def with_both(seg: DataFrame, first: str, second: str) -> DataFrame:
    """Strings that hold both tokens."""
    return seg.filter(F.array_contains("seg", first) & F.array_contains("seg", second))


def merged_list(parts: list[str], first: str, second: str) -> list[str]:
    """``merged`` for one array."""
    out: list[str] = []
    for x in parts:
        if out and out[-1] == first and x == second:
            out[-1] = first + second
        else:
            out.append(x)
    return out


def _applied(parts: list[str], merges: list[tuple[str, str]]) -> list[str]:
    for first, second in merges:
        if first in parts and second in parts:
            parts = merged_list(parts, first, second)
    return parts


def applied(seg: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """``seg`` after some merges, in their order."""
    schema = seg.schema
    at = schema.names.index("seg")

    def run(batches):
        for batch in batches:
            done = pa.array([_applied(parts, merges) for parts in batch.column(at).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([done if i == at else c for i, c in enumerate(batch.columns)], schema.names)

    return seg.mapInArrow(run, schema) if merges else seg


def deltas(seg: DataFrame, before: list[tuple[str, str]], first: str, second: str) -> DataFrame:
    """(first, second, n): by how much each pair's weighted count changes if, after the merges ``before``, (first, second) is
    merged; only strings that hold both count, and only pairs that change have a row."""

    def run(batches):
        tally: dict[tuple[str, str], int] = {}
        for batch in batches:
            for parts, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = _applied(parts, before)
                after = _applied(parts, [(first, second)])
                if len(after) < len(parts):
                    for side, x in ((-f, parts), (f, after)):
                        for pair in zip(x[:-1], x[1:], strict=True):
                            tally[pair] = tally.get(pair, 0) + side
        rows = [(*k, v) for k, v in tally.items() if v]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["first", "second", "n"])

    found = seg.select("seg", "frequency").mapInArrow(run, "first string, second string, n bigint")
    return found.groupBy("first", "second").agg(F.sum("n").alias("n"))


def train(strings: DataFrame, merges: int, cut_every: int = 8) -> tuple[list[str], DataFrame]:
    """(merged tokens in order, final segments). The most frequent pair merges first, ties to the smaller pair.

    The driver keeps the pairs' counts (a row a pair); a merge is one job without a sort, which returns the counts that
    change. Merges are written into the table every few rounds. Stops early when no pair is left.
    """
    seg, out, since = written(segments(strings), "bpe"), [], []
    counts = {(r["first"], r["second"]): r["n"] for r in pair_counts(seg).collect() if r["n"]}
    while len(out) < merges and counts:
        # the order of UTF-8 bytes is that of code points
        first, second = min(counts, key=lambda p: (-counts[p], p))
        out.append(first + second)
        if len(out) < merges:  # nothing is asked after the last one
            for r in deltas(seg, since, first, second).collect():
                pair = (r["first"], r["second"])
                counts[pair] = counts.get(pair, 0) + r["n"]
                if not counts[pair]:
                    del counts[pair]
        since.append((first, second))
        if len(since) == cut_every:
            seg, since = written(applied(seg, since), "bpe"), []
    return out, applied(seg, since)


def worth(seg: DataFrame, tokens: list[str]) -> DataFrame:
    """(token, war, n_strings): by how much the corpus's token count rises without each merged token.

    The fewest-token cover without the token is compared with the present segmentation, string by string.
    """
    spark = seg.sparkSession
    whole = [t.encode("latin-1") for t in tokens]
    dictionary = Dictionary([bytes([b]) for b in range(256)] + whole)
    shipped = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        cover = Cover(shipped.value)
        for batch in batches:
            token, war = [], []
            for parts, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer("".join(parts).encode("latin-1"), np.uint8)
                edges = cover.edges(data)
                for p in {p for p in parts if len(p) > 1}:
                    cost = cover.costs(len(data), edges, banned=256 + tokens.index(p))[len(data)]
                    token.append(p)
                    war.append(int(cost - len(parts)) * f)
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(war, pa.int64())], ["token", "war"])

    sums = seg.select("seg", "frequency").mapInArrow(run, "token string, war bigint").groupBy("token").agg(F.sum("war").alias("war"), F.count("*").alias("n_strings"))
    names = spark.createDataFrame([(t,) for t in tokens], "token string")
    return names.join(sums, "token", "left").fillna(0, ["war", "n_strings"])


def least_worth(table: DataFrame) -> DataFrame:
    """The row of the merged token of least worth, ties to the smaller token."""
    return table.orderBy("war", "token").limit(1)


def prune(strings: DataFrame, size: int, keep: int) -> tuple[list[str], DataFrame]:
    """Train ``size`` merges, then drop the least worthy merged token until ``keep`` are left."""
    tokens, seg = train(strings, size)
    table = worth(seg, tokens)
    while len(tokens) > keep:
        low = least_worth(table).first()["token"]
        tokens = [t for t in tokens if t != low]
        table = table.filter(F.col("token") != low)
    return tokens, table
