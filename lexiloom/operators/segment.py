"""Segmentations: pre-segments, the fewest-token cover and its uses, longest suffix, canonical byte-pair encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grams import flat
from .matching import Dictionary, Pieces, row_slices, weights

#: The byte-level pre-segmentation pattern of the public tiktoken package, with \z for the very end.
PRE_SEGMENT = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++\z|\s+(?!\S)|\s"
#: A variant without look-ahead that every regex engine shares.
PLAIN_SEGMENT = r" ?[^ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+"


def pre_segments(text, pattern: str = PRE_SEGMENT) -> Column:
    """The segments of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def segment_counts(corpus: DataFrame, text: str = "text", pattern: str = PRE_SEGMENT) -> DataFrame:
    return corpus.select(F.explode(pre_segments(F.col(text), pattern)).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))


class Cover:
    """The fewest dictionary tokens that spell a text, for texts given as bytes."""

    def __init__(self, dictionary: Dictionary):
        self.d, self.memo = dictionary, {}

    def edges(self, data: np.ndarray):
        s, e, t = self.d.find(data)
        return s.tolist(), e.tolist(), t.tolist()

    @staticmethod
    def costs(n: int, edges, banned: int | None = None, allowed=None) -> list[float]:
        """Fewest tokens that spell each prefix; inf if none do. Edges stand by end."""
        best = [0.0] + [float("inf")] * n
        for s, e, t in zip(*edges, strict=True):
            if t != banned and (allowed is None or t in allowed) and best[s] + 1 < best[e]:
                best[e] = best[s] + 1
        return best

    @staticmethod
    def path(n: int, edges, allowed=None) -> list[int]:
        """Token ids of one fewest cover: at each end the longest token on a fewest path; [] if there is none."""
        best, back = [0.0] + [float("inf")] * n, [(-1, -1)] * (n + 1)
        for s, e, t in zip(*edges, strict=True):  # by end, then start: the first of equals is the longest
            if (allowed is None or t in allowed) and best[s] + 1 < best[e]:
                best[e], back[e] = best[s] + 1, (s, t)
        out, at = [], n
        while at > 0:
            at, t = back[at]
            if t < 0:
                return []
            out.append(t)
        return out[::-1]

    def rows(self, data: np.ndarray, off: np.ndarray):
        """(n, tokens, which, at, pieces): tokens of a fewest cover of each row (-1: there is none), and the covers of its
        distinct pieces as one array with the places ``at`` where each begins."""
        pieces = Pieces(self.d, data, off)
        paths, which = pieces.solved(self.path, self.memo)
        size = np.array([len(p) for p in paths], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        tokens = np.fromiter((t for p in paths for t in p), np.int64, int(at[-1]))
        run = np.concatenate([[0], np.cumsum(size[which])])
        dead = np.concatenate([[0], np.cumsum(size[which] == 0)])
        n = run[pieces.row[1:]] - run[pieces.row[:-1]]
        n[dead[pieces.row[1:]] > dead[pieces.row[:-1]]] = -1
        return n, tokens, which, at, pieces


def covers(corpus: DataFrame, dictionary: Dictionary, key: str = "doc_id", data: str = "data") -> DataFrame:
    """(key, n_tokens, token_ids): a fewest cover of each text; n_tokens null where none exists, 0 for empty texts."""
    shipped = corpus.sparkSession.sparkContext.broadcast(dictionary)
    kind = corpus.schema[key].dataType.simpleString()

    def run(batches):
        cover = Cover(shipped.value)
        for batch in batches:
            b, off = flat(batch.column(1))
            for x, y in row_slices(off):
                n, tokens, which, at, pieces = cover.rows(b[off[x] : off[y]], off[x : y + 1] - off[x])
                size = np.diff(at)[which]
                place = np.repeat(at[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                run_ = np.concatenate([[0], np.cumsum(size)])[pieces.row]
                ids = pa.ListArray.from_arrays(pa.array(run_, pa.int32()), pa.array(tokens[place], pa.int32()))
                if (n < 0).any():
                    ids = pa.array([v if k >= 0 else [] for v, k in zip(ids.to_pylist(), n.tolist(), strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(n, pa.int32(), mask=n < 0), ids], [key, "n_tokens", "token_ids"])

    return corpus.select(key, data).mapInArrow(run, f"`{key}` {kind}, n_tokens int, token_ids array<int>")


def cover_totals(corpus: DataFrame, dictionary: Dictionary, data: str = "data", weight: str | None = None) -> DataFrame:
    """(token_id, n_uses): how often each token stands in the covers of ``covers``, added up in the tasks; unused tokens have no row.
    weight: a column that tells how often each text counts."""
    shipped = corpus.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        cover, uses = Cover(shipped.value), np.zeros(len(shipped.value.tokens), np.int64)
        for batch in batches:
            b, off = flat(batch.column(0))
            w = weights(batch, 1)
            for x, y in row_slices(off):
                n, tokens, which, at, pieces = cover.rows(b[off[x] : off[y]], off[x : y + 1] - off[x])
                times = np.zeros(len(at) - 1, np.int64)
                np.add.at(times, which, pieces.times(np.where(n >= 0, w[x:y], 0)))
                np.add.at(uses, tokens, np.repeat(times, np.diff(at)))
        i = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(uses[i])], ["token_id", "n"])

    return corpus.select(data, *[weight] * bool(weight)).mapInArrow(run, "token_id int, n bigint").groupBy("token_id").agg(F.sum("n").alias("n_uses"))


def cover_total(covered: DataFrame) -> DataFrame:
    return covered.agg(F.count("*").alias("n_texts"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))


def cover_uses(covered: DataFrame) -> DataFrame:
    return covered.select(F.explode("token_ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n_uses"))


def cover_costs_sql(data: Column, tokens: list[bytes]) -> Column:
    """The fewest-token count of a short latin-1 text by a fold over its places, for small dictionaries."""
    big = F.lit(1 << 30)

    def step(acc, i):
        ways = [F.when((i >= len(t)) & (F.substring(data, i - len(t) + 1, F.lit(len(t))) == F.lit(t.decode("latin-1"))), F.try_element_at(acc, i - len(t) + 1) + 1).otherwise(big) for t in tokens]
        return F.concat(acc, F.array(F.least(*ways) if len(ways) > 1 else ways[0]))

    filled = F.aggregate(F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data))).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), step)
    return F.element_at(filled, -1)


def longest_suffix(data: bytes, tokens: set[bytes], most: int = 32) -> list[bytes]:
    """Greedy from the right: the longest token that ends here, else the single byte."""
    out, at = [], len(data)
    while at:
        n = next((n for n in range(min(most, at), 1, -1) if data[at - n : at] in tokens), 1)
        out.append(data[at - n : at])
        at -= n
    return out[::-1]


def suffix_cuts(corpus: DataFrame, tokens: list[bytes], key: str = "doc_id", data: str = "data") -> DataFrame:
    """(key, tokens): each text cut by ``longest_suffix``."""
    shipped, most = corpus.sparkSession.sparkContext.broadcast(frozenset(tokens)), min(32, max(map(len, tokens), default=1))
    kind = corpus.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            cut = [longest_suffix(x or b"", shipped.value, most) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.binary()))], [key, "tokens"])

    return corpus.select(key, data).mapInArrow(run, f"`{key}` {kind}, tokens array<binary>")


class Merges:
    """Canonical byte-pair encoding: tokens in rank order; the pair of lowest rank merges first, from the left."""

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: i for i, t in reversed(list(enumerate(tokens)))}

    def encode(self, data: bytes) -> list[int]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts[:-1], parts[1:], strict=True)]
            low = min(ranks)
            if low == 1 << 60:
                break
            i, out = 0, []
            while i < len(parts):
                if i < len(ranks) and ranks[i] == low:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.rank.get(p, -1) for p in parts]


def encode_texts(corpus: DataFrame, tokens: list[bytes], key: str = "doc_id", data: str = "data") -> DataFrame:
    """(key, token_ids) of byte strings, invalid UTF-8 included: escape, pre-segment, then merge each segment.

    Bytes that are no token get -1. The vocabulary is shipped (bounded by its own size)."""
    from ..functions.codec import escape_udf, unescape

    shipped = corpus.sparkSession.sparkContext.broadcast(tokens)
    kind = corpus.schema[key].dataType.simpleString()

    def run(batches):
        merges, known = Merges(shipped.value), {}
        for batch in batches:
            ids = []
            for segments in batch.column(1).to_pylist():
                row: list[int] = []
                for s in segments or ():
                    if s not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[s] = merges.encode(unescape(s))
                    row += known[s]
                ids.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "token_ids"])

    return corpus.select(key, pre_segments(escape_udf(data)).alias("segments")).mapInArrow(run, f"`{key}` {kind}, token_ids array<int>")


def encode_bytes(corpus: DataFrame, tokens: list[bytes], key: str = "doc_id", data: str = "data") -> DataFrame:
    """(key, token_ids): the merges over each whole byte string, as one segment; for short strings, since merging a
    segment takes a pass for each merge."""
    shipped = corpus.sparkSession.sparkContext.broadcast(tokens)
    kind = corpus.schema[key].dataType.simpleString()

    def run(batches):
        merges, known = Merges(shipped.value), {}
        for batch in batches:
            ids = []
            for x in batch.column(1).to_pylist():
                if x not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[x] = merges.encode(x or b"")
                ids.append(known[x])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "token_ids"])

    return corpus.select(key, data).mapInArrow(run, f"`{key}` {kind}, token_ids array<int>")


def decode_tokens(stream: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, data): token ids back to bytes, ``?`` for an unknown id. vocab (token_id, token) is joined by size."""
    x = stream.select(key, F.posexplode("token_ids").alias("pos", "token_id")).join(vocab.select("token_id", "token"), "token_id", "left")
    x = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", F.lit(b"?")).alias("t")))).alias("p"))
    return x.select(key, F.aggregate("p", F.lit(b""), lambda s, t: F.concat(s, t["t"])).alias("data"))
