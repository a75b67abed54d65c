"""Where tokens of a dictionary occur in texts: all (start, end, token), counts, first places, past-the-end matches.

Positions are bytes from 0; ends are exclusive. A ``Dictionary`` is broadcast and has at most ``Dictionary.MOST``
bytes; ``counts_of`` joins larger tables on the grams by a shuffle, and so do ``matches_by_join`` and
``match_counts_by_join``.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grams import flat


#: Bytes of texts that one numpy pass holds at a time.
PIECE = 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < 2**bits."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p, k, step = np.ones(1 << bits, np.uint64), 1, np.uint64(base)
        with np.errstate(over="ignore"):
            while k < len(p):
                p[k : 2 * k] = p[:k] * step
                step, k = step * step, 2 * k
        out.append(p)
    return out[0], out[1]


def row_slices(off: np.ndarray, limit: int = PIECE):
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1))
        yield a, b
        a = b


class Dictionary:
    """Tokens by length, with hashes of their bytes, in the order they were given; token_id is the place."""

    #: Bytes of tokens that are sent to every executor at most.
    MOST = 64 << 20

    def __init__(self, tokens: list[bytes]):
        if sum(map(len, tokens)) > self.MOST:
            raise ValueError("the dictionary is too large to send to every executor; use matches_by_join")
        self.tokens = tokens
        by: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            if t:
                by.setdefault(len(t), []).append(i)
        self.by = {}
        for n, ids in sorted(by.items()):
            spelt = np.frombuffer(b"".join(tokens[i] for i in ids), np.uint8).reshape(-1, n)
            with np.errstate(over="ignore"):
                h = ((spelt.astype(np.uint64) + np.uint64(1)) * _powers(max(10, n.bit_length()))[0][:n]).sum(1, dtype=np.uint64)
                some = np.zeros(1 << 16, bool)  # places that cannot match are passed over without a search
                some[(h * _MIX) >> np.uint64(48)] = True
            o = np.argsort(h, kind="stable")
            self.by[n] = (h[o], np.array(ids, np.int64)[o], spelt[o], some)
        self.singles: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.singles.setdefault(t[0], []).append(i)
        self.sorted = sorted((t, i) for i, t in enumerate(tokens) if len(t) > 1)

    def find_rows(self, data: np.ndarray, off: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token_id) of every match of ``least`` bytes or more inside one row of ``data``, each checked byte by
        byte; by end, then start. Places count from the start of ``data``; off holds where rows begin, and the end."""
        out = []
        for a, b in row_slices(off):
            lo, part = int(off[a]), data[off[a] : off[b]]
            n = len(part)
            if not n:
                continue
            left = np.repeat(off[a + 1 : b + 1], np.diff(off[a : b + 1])) - np.arange(lo, lo + n)
            with np.errstate(over="ignore"):
                power, inverse = _powers(max(10, n.bit_length()))
                c = np.zeros(n + 1, np.uint64)
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:n], out=c[1:])
                for size, (keys, ids, spelt, some) in self.by.items():
                    m = n - size + 1
                    if m <= 0:
                        break
                    if size < least:
                        continue
                    h = (c[size:] - c[:m]) * inverse[:m]
                    at = np.flatnonzero(some[(h * _MIX) >> np.uint64(48)] & (left[:m] >= size))
                    first = np.searchsorted(keys, h[at])
                    times = np.searchsorted(keys, h[at], "right") - first
                    at, first, times = at[times > 0], first[times > 0], times[times > 0]
                    if not len(at):
                        continue
                    start = np.repeat(at, times)
                    which = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(len(start))
                    same = (np.lib.stride_tricks.sliding_window_view(part, size)[start] == spelt[which]).all(1)
                    start = start[same] + lo
                    out.append(np.stack([start, start + size, ids[which[same]]]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        s, e, t = np.concatenate(out, 1)
        o = np.lexsort((t, s, e))
        return s[o], e[o], t[o]

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for one text."""
        return self.find_rows(data, np.array([0, len(data)]))

    def past_end(self, data: bytes) -> list[tuple[int, int, int]]:
        """Tokens that begin in the text and run past its end: its last bytes begin them."""
        out = []
        for n in range(1, min(len(data), max(self.by, default=0) - 1) + 1):
            tail = data[len(data) - n :]
            for k in range(bisect_left(self.sorted, (tail, -1)), len(self.sorted)):
                token, i = self.sorted[k]
                if not token.startswith(tail):
                    break
                if len(token) > n:
                    out.append((len(data) - n, len(data) - n + len(token), i))
        return sorted(out)


class Pieces:
    """Texts cut where no token of two bytes or more lies across: every path of tokens passes there, so whatever adds up
    along paths can be found piece by piece, and equal pieces only once."""

    def __init__(self, dictionary: Dictionary, data: np.ndarray, off: np.ndarray, tail: int = 0):
        """tail: the last so many bytes of a row are not cut."""
        n = int(off[-1])
        self.data, self.singles = data, dictionary.singles
        self.s, self.e, self.t = dictionary.find_rows(data, off, 2)
        d = np.bincount(self.s + 1, minlength=n + 2) - np.bincount(self.e, minlength=n + 2)
        if tail:
            size = np.diff(off)
            at = np.maximum(off[:-1], off[1:] - tail)[size > 0]
            d += np.bincount(at + 1, minlength=n + 2) - np.bincount(off[1:][size > 0], minlength=n + 2)
        self.edge = np.flatnonzero(np.cumsum(d[: n + 1]) <= 0)
        #: pieces of row r are row[r] to row[r + 1]
        self.row = np.searchsorted(self.edge, off)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The weight of each piece's row."""
        return np.repeat(weights, np.diff(self.row))

    def distinct(self) -> tuple[list[tuple[int, int]], np.ndarray]:
        """(places, which): the first place of each distinct piece, and which of them each piece is."""
        size, start = np.diff(self.edge), self.edge[:-1]
        places, which, order = [], np.zeros(len(size), np.int64), np.argsort(size, kind="stable")
        cut = np.flatnonzero(np.diff(size[order], prepend=-1)) if len(size) else np.zeros(0, np.int64)
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(size)][: len(cut)], strict=True):
            at = order[x:y]
            n, begin = int(size[at[0]]), start[at]
            if n <= 8:
                key = np.zeros(len(at), np.uint64)
                for k in range(n):
                    key = (key << np.uint64(8)) | self.data[begin + k]
            else:
                key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, n)[begin]).view(f"V{n}").ravel()
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            which[at] = back + len(places)
            places += [(b, b + n) for b in begin[first].tolist()]
        return places, which

    def edges(self, a: int, b: int) -> tuple[list[int], list[int], list[int]]:
        """Matches inside the piece from ``a`` to ``b``, counted from its start, by end, then start."""
        x, y = np.searchsorted(self.e, [a + 1, b + 1])
        wide = zip((self.s[x:y] - a).tolist(), (self.e[x:y] - a).tolist(), self.t[x:y].tolist(), strict=True)
        short = ((i, i + 1, t) for i, byte in enumerate(self.data[a:b].tolist()) for t in self.singles.get(byte, ()))
        every = sorted((*wide, *short), key=lambda m: (m[1], m[0], m[2]))
        return tuple([m[k] for m in every] for k in range(3))

    def solved(self, solve, memo: dict) -> tuple[list, np.ndarray]:
        """(results, which): solve(size, edges) of each distinct piece; memo keeps results by bytes between batches."""
        places, which = self.distinct()
        out = []
        for a, b in places:
            raw = self.data[a:b].tobytes()
            if raw not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[raw] = solve(b - a, self.edges(a, b))
            out.append(memo[raw])
        return out, which


def piece_tally(dictionary: Dictionary, data: np.ndarray, off: np.ndarray):
    """(piece, times) of the distinct pieces of ``Pieces``, without its matches: tokens of up to eight bytes are looked up as
    whole numbers, and pieces of up to eight bytes are counted as such."""
    n = int(off[-1])
    d = np.zeros(n + 2, np.int64)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    x = data.astype(np.uint64)
    for size in range(2, 9):
        x = (x[:-1] << np.uint64(8)) | data[size - 1 :] if len(x) > 1 else x[:0]
        if size in dictionary.by and len(x):
            spelt = dictionary.by[size][2]
            keys = np.zeros(len(spelt), np.uint64)
            for k in range(size):
                keys = (keys << np.uint64(8)) | spelt[:, k]
            keys = np.unique(keys)
            some = np.zeros(1 << 16, bool)
            with np.errstate(over="ignore"):
                some[(keys * _MIX) >> np.uint64(48)] = True
                at = np.flatnonzero(some[(x * _MIX) >> np.uint64(48)])
            at = at[keys[np.minimum(np.searchsorted(keys, x[at]), len(keys) - 1)] == x[at]]
            at = at[left[at] >= size]  # a place stands once, and so does its end
            d[at + 1] += 1
            d[at + size] -= 1
    if max(dictionary.by, default=0) > 8:
        s, e, _ = dictionary.find_rows(data, off, 9)
        d += np.bincount(s + 1, minlength=n + 2) - np.bincount(e, minlength=n + 2)
    edge = np.flatnonzero(np.cumsum(d[: n + 1]) <= 0)
    size, start = np.diff(edge), edge[:-1]
    short = np.minimum(size, 9).astype(np.uint8)
    for k in range(1, 9):
        begin = start[short == k]
        if len(begin):
            key = np.zeros(len(begin), np.uint64)
            for i in range(k):
                key = (key << np.uint64(8)) | data[begin + i]
            v, times = np.unique(key, return_counts=True)
            raw = v.astype(">u8").tobytes()
            yield from ((raw[8 * i + 8 - k : 8 * i + 8], m) for i, m in enumerate(times.tolist()))
    raw = data.tobytes()
    yield from ((raw[a : a + k], 1) for a, k in zip(start[short == 9].tolist(), size[short == 9].tolist(), strict=True))


#: Entries and bytes of pieces that a task counts before it hands them on.
TALLY, TALLY_BYTES = 200_000, 32 << 20


def piece_counts(corpus: DataFrame, dictionary: Dictionary, data: str = "data") -> DataFrame:
    """(data, n): the distinct pieces of the texts and how often each occurs. Every match of the dictionary lies inside a piece,
    so counts, covers and their changes over the texts are those over the pieces times n, for all subsets of its tokens."""
    spark = corpus.sparkSession
    shipped = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        tally, size = {}, 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["data", "n"])
        for batch in batches:
            b, off = flat(batch.column(0))
            for x, y in row_slices(off, PIECE >> 2):
                for piece, k in piece_tally(shipped.value, b[off[x] : off[y]], off[x : y + 1] - off[x]):
                    if piece in tally:
                        tally[piece] += k
                    else:
                        tally[piece], size = k, size + len(piece)
                        if len(tally) >= TALLY or size >= TALLY_BYTES:
                            yield out()
                            tally, size = {}, 0
        yield out()

    # a number of parts that is asked for stays: what follows is heavy for each piece
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return corpus.select(data).mapInArrow(run, "data binary, n bigint").repartition(parts, "data").groupBy("data").agg(F.sum("n").alias("n"))


def matches(corpus: DataFrame, dictionary: Dictionary, key: str = "doc_id", data: str = "data", past_end: bool = False) -> DataFrame:
    """(key, start, end, token_id) of every match."""
    shipped = corpus.sparkSession.sparkContext.broadcast(dictionary)
    kind = corpus.schema[key].dataType.simpleString()

    def run(batches):
        d = shipped.value
        for batch in batches:
            b, off = flat(batch.column(1))
            for x, y in row_slices(off):
                part, o = b[off[x] : off[y]], off[x : y + 1] - off[x]
                s, e, t = d.find_rows(part, o)
                row = np.searchsorted(o, s, "right") - 1
                if past_end:
                    more = [(r, *m) for r in range(y - x) for m in d.past_end(part[max(o[r], o[r + 1] - longest) : o[r + 1]].tobytes())]
                    r = np.array([m[0] for m in more], np.int64)
                    shift = np.maximum(o[:-1], o[1:] - longest)[r]
                    s, e, t, row = (np.concatenate(v) for v in ((s, np.array([m[1] for m in more], np.int64) + shift), (e, np.array([m[2] for m in more], np.int64) + shift), (t, np.array([m[3] for m in more], np.int64)), (row, r)))
                for k in range(0, len(s), 1 << 18):
                    c = slice(k, k + (1 << 18))
                    at = o[row[c]]
                    keys = batch.column(0).take(pa.array(row[c] + x))
                    yield pa.RecordBatch.from_arrays([keys, pa.array((s[c] - at).astype(np.int32)), pa.array((e[c] - at).astype(np.int32)), pa.array(t[c].astype(np.int32))], [key, "start", "end", "token_id"])

    longest = max(dictionary.by, default=1)
    return corpus.select(key, data).mapInArrow(run, f"`{key}` {kind}, start int, end int, token_id int")


def matches_by_join(corpus: DataFrame, tokens: DataFrame, lengths: list[int], key: str = "doc_id", data: str = "data") -> DataFrame:
    """The same for dictionaries of any size: an equi-join on the gram at each place and length."""
    b = F.col(data)

    def grams(n: int):
        return F.transform(F.sequence(F.lit(1), F.length(b) - n + 1), lambda i: F.struct((i - 1).alias("start"), (i - 1 + n).alias("end"), F.substring(b, i, F.lit(n)).alias("token")))

    each = [corpus.filter(F.length(b) >= n).select(key, F.explode(grams(n)).alias("g")) for n in lengths]
    x = each[0]
    for y in each[1:]:
        x = x.unionByName(y)
    return x.select(key, "g.start", "g.end", "g.token").join(tokens.select("token_id", "token"), "token").select(key, "start", "end", "token_id")


def greedy(starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray, n_tokens: int, times: np.ndarray | None = None) -> np.ndarray:
    """Non-overlapping occurrences of each token, accepted from the left; starts grow along the texts. times: what each counts."""
    o = np.lexsort((starts, tokens))
    s, e, t = starts[o], ends[o], tokens[o]
    times = np.ones(len(s), np.int64) if times is None else times[o]
    # runs of occurrences of one token in which each overlaps the next; most are of one
    joined = np.zeros(len(s), bool)
    joined[1:] = (t[1:] == t[:-1]) & (s[1:] < e[:-1])
    out = np.zeros(n_tokens, np.int64)
    np.add.at(out, t[~joined], times[~joined])
    for k in np.flatnonzero(joined & ~np.append(joined[1:], False)).tolist():  # the last of each run of several
        a = k
        while joined[a]:
            a -= 1
        last = e[a]
        for i in range(a + 1, k + 1):
            if s[i] >= last:
                out[t[i]] += times[i]
                last = e[i]
    return out


def weights(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """How often each row of a batch counts: by its column, or once where it has none."""
    return batch.column(column).to_numpy(zero_copy_only=False) if batch.num_columns > column else np.ones(batch.num_rows, np.int64)


def match_counts(corpus: DataFrame, dictionary: Dictionary, data: str = "data", weight: str | None = None) -> DataFrame:
    """(token_id, token, n_total, n_nonoverlap, est_savings) of every token, 0 if it is nowhere. weight: a column that tells how
    often each text counts."""
    spark = corpus.sparkSession
    shipped = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        d = shipped.value
        for batch in batches:
            b, off = flat(batch.column(0))
            w = weights(batch, 1)
            total, apart = np.zeros(len(d.tokens), np.int64), np.zeros(len(d.tokens), np.int64)
            for x, y in row_slices(off):
                o = off[x : y + 1] - off[x]
                s, e, t = d.find_rows(b[off[x] : off[y]], o)
                times = w[x:y][np.searchsorted(o, s, "right") - 1]
                np.add.at(total, t, times)
                apart += greedy(s, e, t, len(total), times)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(apart[at])], ["token_id", "n_total", "n_nonoverlap"])

    sums = corpus.select(data, *[weight] * bool(weight)).mapInArrow(run, "token_id int, n_total bigint, n_nonoverlap bigint").groupBy("token_id").agg(F.sum("n_total").alias("n_total"), F.sum("n_nonoverlap").alias("n_nonoverlap"))
    names = spark.createDataFrame([(i, t) for i, t in enumerate(dictionary.tokens)], "token_id int, token binary")
    x = names.join(sums, "token_id", "left").fillna(0, ["n_total", "n_nonoverlap"])
    return x.withColumn("est_savings", F.col("n_nonoverlap") * (F.length("token") - 1))


def match_counts_by_join(corpus: DataFrame, tokens: DataFrame, lengths: list[int], key: str = "doc_id", data: str = "data") -> DataFrame:
    """The same as ``match_counts`` for (token_id, token) tables of any size: matches meet by a shuffle, and each text's
    places of a token are counted by a fold. Texts have distinct keys."""
    places = matches_by_join(corpus, tokens, lengths, key, data).groupBy(key, "token_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("p"))
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
    apart = F.aggregate("p", first, lambda a, p: F.when(p["start"] >= a["last"], F.struct((a["n"] + 1).alias("n"), p["end"].alias("last"))).otherwise(a))["n"]
    sums = places.select("token_id", F.size("p").alias("k"), apart.alias("n")).groupBy("token_id").agg(F.sum("k").alias("n_total"), F.sum("n").alias("n_nonoverlap"))
    x = tokens.select("token_id", "token").join(sums, "token_id", "left").fillna(0, ["n_total", "n_nonoverlap"])
    return x.withColumn("est_savings", F.col("n_nonoverlap") * (F.length("token") - 1))


def counts_of(corpus: DataFrame, tokens: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    """Counts of every token of (token_id, token), ids from 0: a dictionary of up to ``Dictionary.MOST`` bytes is sent to
    the executors, a larger one is joined by a shuffle."""
    size = tokens.agg(F.coalesce(F.sum(F.length("token")), F.lit(0)), F.array_sort(F.collect_set(F.length("token")))).first()
    if size[0] > Dictionary.MOST:
        return match_counts_by_join(corpus, tokens, list(size[1]), key, data)
    rows = tokens.select("token_id", "token").orderBy("token_id").collect()  # of checked size
    return match_counts(corpus, Dictionary([bytes(r["token"]) for r in rows]), data)


def first_places(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token_id, first_end): the least end of each token in each text."""
    return found.groupBy(key, "token_id").agg(F.min("end").alias("first_end"))


def by_first_end(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """place of each match in its text: tokens whose first match ends latest come first, then by token and end."""
    first = F.min("end").over(Window.partitionBy(key, "token_id"))
    w = Window.partitionBy(key).orderBy(F.desc("_f"), "token_id", "end")
    return found.withColumn("_f", first).withColumn("place", F.row_number().over(w)).drop("_f")


def covered(found: DataFrame, uses: DataFrame) -> DataFrame:
    """(token_id, n_covered): occurrences of each candidate inside used tokens, weighted by their uses.

    found: matches in the used tokens as texts, keyed by ``used_id``; uses: (used_id, n_uses).
    """
    return found.join(uses, "used_id").groupBy("token_id").agg(F.sum("n_uses").cast("bigint").alias("n_covered"))
