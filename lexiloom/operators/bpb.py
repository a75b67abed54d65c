"""Bits per byte of a corpus under token probabilities: one tokenization, or all of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import flat
from .matching import Dictionary, Pieces, row_slices
from .segment import PLAIN_SEGMENT, pre_segments


def unigrams(corpus: DataFrame, text: str = "text", pattern: str = PLAIN_SEGMENT) -> DataFrame:
    """(segment, n, p): the share of each segment of the corpus."""
    n = corpus.select(F.explode(pre_segments(F.col(text), pattern)).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
    total = corpus.agg(F.sum(F.size(pre_segments(F.col(text), pattern)))).first()[0] or 0
    return n.select("segment", "n", (F.col("n") / F.lit(total)).alias("p"))


def segment_bits(corpus: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = PLAIN_SEGMENT) -> DataFrame:
    """(key, segment, p, n_bytes) of each segment; segments that the model lacks have a null p."""
    each = corpus.select(key, F.explode(pre_segments(F.col(text), pattern)).alias("segment"))
    # equal segments of one text go through the join once
    counted = each.groupBy(key, "segment").agg(F.count("*").alias("times"))
    return counted.join(model.select("segment", "p"), "segment", "left").withColumn("n_bytes", F.octet_length("segment"))


def bits_per_byte(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_tokens, n_bytes, n_unseen, loss, perplexity, bpb): loss in nats a token, over the segments that the model has;
    n_unseen counts the others. Where it has none, the figures are null."""
    known = F.col("p").isNotNull()
    x = scored.groupBy(*by).agg(
        F.sum(F.when(known, F.col("times")).otherwise(0)).cast("bigint").alias("n_tokens"), F.sum(F.when(known, F.col("times") * F.col("n_bytes")).otherwise(0)).cast("bigint").alias("n_bytes"),
        F.sum(F.when(known, 0).otherwise(F.col("times"))).cast("bigint").alias("n_unseen"), F.sum(-F.ln("p") * F.col("times")).alias("_nats"),
    )
    loss = F.col("_nats") / F.nullif("n_tokens", F.lit(0))
    return x.select(*by, "n_tokens", "n_bytes", "n_unseen", loss.alias("loss"), F.exp(loss).alias("perplexity"), (F.col("n_tokens") / F.nullif("n_bytes", F.lit(0)) * loss * F.lit(math.log2(math.e))).alias("bpb"))


def mean_loss(rows: DataFrame, p: str = "p", label: str = "label", ignore: int = -100) -> DataFrame:
    """Mean and summed loss over the rows whose label is not the ignored one, and the perplexity."""
    x = rows.filter(F.col(label) != ignore).agg(F.count("*").alias("n"), F.avg(-F.ln(p)).alias("mean_loss"), F.sum(-F.ln(p)).alias("sum_loss"))
    return x.withColumn("perplexity", F.exp("mean_loss"))


def _log2_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log2(1 + 2.0 ** (b - a))


def all_paths(data: bytes, edges, log_p, past=()) -> float:
    """log2 of the summed probability of all token paths over the text, the last of which may run past its end.

    edges: (starts, ends, tokens) by end. log_p(token, start) -> log2 probability.
    """
    n, tail = len(data), -math.inf
    at = [0.0] + [-math.inf] * n
    for s, e, t in sorted(zip(*edges, strict=True)):
        if at[s] > -math.inf:
            at[e] = _log2_add(at[e], at[s] + log_p(t, s))
    for s, _, t in past:
        if at[s] > -math.inf:
            tail = _log2_add(tail, at[s] + log_p(t, s))
    return _log2_add(at[n], tail)


def all_paths_bpb(corpus: DataFrame, tokens: list[bytes], p: list[float], key: str = "doc_id", data: str = "data", past_end: bool = True) -> DataFrame:
    """(key, n_bytes, log2_p, bpb): all paths with a probability for each token; log2_p null if no path exists.

    Probabilities stay in log2 space, so long texts do not underflow. Empty texts have log2_p 0 and a null bpb.
    """
    shipped = corpus.sparkSession.sparkContext.broadcast((Dictionary(tokens), np.log2(np.asarray(p, float)).tolist()))
    kind = corpus.schema[key].dataType.simpleString()

    def run(batches):
        d, logs = shipped.value
        tail, memo = max(d.by, default=1) if past_end else 0, {}
        for batch in batches:
            b, off = flat(batch.column(1))
            for x, y in row_slices(off):
                part, o = b[off[x] : off[y]], off[x : y + 1] - off[x]
                pieces = Pieces(d, part, o, tail)
                ends = set(o[1:].tolist()) if past_end else ()
                places, which = pieces.distinct()
                one = []
                for u, v in places:
                    raw = part[u:v].tobytes()
                    if raw not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        edges = pieces.edges(u, v)
                        # alone, and as the last piece of a text, whose tokens may run past the end
                        memo[raw] = [all_paths(raw, edges, lambda t, s: logs[t]), None, edges]
                    one.append(memo[raw])
                log2 = np.array([m[0] for m in one])[which]
                for k in np.flatnonzero(np.isin(pieces.edge[1:], list(ends))).tolist() if past_end else ():
                    m, raw = one[which[k]], part[pieces.edge[k] : pieces.edge[k + 1]].tobytes()
                    if m[1] is None:
                        m[1] = all_paths(raw, m[2], lambda t, s: logs[t], d.past_end(raw))
                    log2[k] = m[1]
                dead = np.concatenate([[0], np.cumsum(np.isinf(log2))])
                run_ = np.concatenate([[0], np.cumsum(np.where(np.isinf(log2), 0, log2))])
                got, lost = run_[pieces.row[1:]] - run_[pieces.row[:-1]], dead[pieces.row[1:]] > dead[pieces.row[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(np.diff(o), pa.int64()), pa.array(got, pa.float64(), mask=lost)], [key, "n_bytes", "log2_p"])

    x = corpus.select(key, data).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, log2_p double")
    return x.withColumn("bpb", F.when(F.col("n_bytes") > 0, -F.col("log2_p") / F.col("n_bytes")))


def all_paths_table(corpus: DataFrame, tokens: list[bytes], probabilities: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    """The same where each text has its own probabilities: (key, start, token_id, p). Tokens a text has no row for count as impossible."""
    shipped = corpus.sparkSession.sparkContext.broadcast(Dictionary(tokens))
    kind = corpus.schema[key].dataType.simpleString()
    own = probabilities.groupBy(key).agg(F.collect_list(F.struct("start", "token_id", "p")).alias("_p"))

    def run(batches):
        d = shipped.value
        for batch in batches:
            b, off = flat(batch.column(1))
            out = []
            for i, table in enumerate(batch.column(2).to_pylist()):
                p = {(r["token_id"], r["start"]): math.log2(r["p"]) for r in table or () if r["p"] > 0}
                raw = b[off[i] : off[i + 1]].tobytes()
                x = all_paths(raw, [v.tolist() for v in d.find(b[off[i] : off[i + 1]])], lambda t, s, p=p: p.get((t, s), -math.inf), d.past_end(raw))
                out.append(None if x == -math.inf else x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(out, pa.float64())], [key, "n_bytes", "log2_p"])

    x = corpus.join(own, key, "left").select(key, data, "_p").mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, log2_p double")
    return x.withColumn("bpb", F.when(F.col("n_bytes") > 0, -F.col("log2_p") / F.col("n_bytes")))


def prefix_tokens(corpus: DataFrame, tokens: list[bytes], key: str = "doc_id", data: str = "data") -> DataFrame:
    """(key, token_id, start1, end1, prefix): distinct tokens of the canonical segmentations of all prefixes.

    prefix is the shortest prefix in which the token stands there; positions count from 1, inclusive.
    Every prefix of a text is encoded, as a model that is asked at every byte would see it.
    """
    from .segment import Merges

    shipped = corpus.sparkSession.sparkContext.broadcast(tokens)
    kind = corpus.schema[key].dataType.simpleString()

    def run(batches):
        merges = Merges(shipped.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, raw in enumerate(batch.column(1).to_pylist()):
                seen = set()
                for n in range(1, len(raw or b"") + 1):
                    at = 0
                    for t in merges.encode(raw[:n]):
                        size = len(shipped.value[t]) if t >= 0 else 1
                        if (t, at) not in seen:
                            seen.add((t, at))
                            for k, v in enumerate((i, t, at + 1, at + size, n)):
                                out[k].append(v)
                        at += size
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *[pa.array(v, pa.int32()) for v in out[1:]]], [key, "token_id", "start1", "end1", "prefix"])

    return corpus.select(key, data).mapInArrow(run, f"`{key}` {kind}, token_id int, start1 int, end1 int, prefix int")


def prefix_ancestry(positions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token_id, start1, anc_id, anc_start): the tokens before each in the first prefix that has it.

    A token's ancestors are those that end before it among the tokens first met in the same or a shorter prefix.
    """
    a, b = positions.alias("a"), positions.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.end1") < F.col("a.start1")) & (F.col("b.prefix") <= F.col("a.prefix"))
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), "a.token_id", "a.start1", F.col("b.token_id").alias("anc_id"), F.col("b.start1").alias("anc_start"))


def prefix_order(positions: DataFrame, key: str = "doc_id") -> DataFrame:
    """rank of each token of a text by (end, start, id), from 1."""
    from pyspark.sql import Window

    return positions.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("end1", "start1", "token_id")))


def top_completions(rows: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc("p"), "token_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
