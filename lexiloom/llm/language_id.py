"""Operator 9: language identification by prediction by partial matching (PPM) under frozen statistics.

Each language has a variable-order byte context tree of depth ORDER. A byte's probability under a
language is the classical one with escape method C: at the longest context seen in training, the
byte's count over (all counts + distinct bytes); a byte not seen there costs the context's escape,
distinct / (all + distinct), and is coded by the next shorter context, down to a uniform byte.
Contexts are not narrowed by exclusion. Letters are lower-cased first (ASCII and two-byte Latin-1).

The trees are stored sparsely, as sorted context keys of each order and language: every byte value,
every context of the training sample and every language has its own place, and the size is that of
the sample. With frozen statistics the code length of a byte is a function of it and the ORDER bytes
before it, so a piece of text is scored by its *distinct* grams only: each gets its exact code length
under each language once, and the places of the text look it up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, flat, held_out, slices, table

#: Labelled rows of each language that the fit reads, about (whole texts; chosen by a hash of the id) ...
ROWS_PER_LANGUAGE = 400
#: ... and those of all languages together, about: with over a hundred languages each has a smaller share.
FIT_ROWS = 40_000
#: Depth of the context trees, in bytes.
ORDER = 4
#: Bytes scored at a time.
PIECE = 1 << 19
#: Share of the sample that is kept out of a trial fit, to see what unseen texts of a language cost.
TRIAL = 4
#: A text is refused if its code is longer than the median of its language's unseen texts by so many spreads
#: (standard deviations as told by the median deviation); texts that mix two learned languages mostly stay below ...
SPREADS = 12.0
#: ... of which each counts as so many bits a byte at least.
LEAST_SPREAD = 0.1
#: Bits beyond its limit that a text of any length may cost: a few odd words do not outweigh a short text.
SLACK = 64.0


def fold(data: np.ndarray, off: np.ndarray | None = None) -> np.ndarray:
    """Lower-case ASCII and the Latin-1 letters of two-byte UTF-8."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        after = data[1:]
        big = (data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        out[1:][big] += 32
    return out


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, n, len(u))


def _find(sorted_keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each asked key."""
    if not len(sorted_keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
    return at, sorted_keys[at] == asked


class Tree:
    """The context tree of one language: for each order, contexts with their escape costs and grams with their codes, in bits."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int):
        """grams: the ORDER + 1 bytes ending at each training place, big-endian, and their counts."""
        self.levels = []
        for k in range(order + 1):
            u, m = _sums(grams & np.uint64((1 << 8 * (k + 1)) - 1), n)
            ctx, first = np.unique(u >> np.uint64(8), return_index=True)
            kinds = np.diff(np.append(first, len(u)))
            total = np.add.reduceat(m, first) if len(u) else np.zeros(0)
            escape = np.log2(total + kinds) - np.log2(kinds)
            cost = np.repeat(np.log2(total + kinds), kinds) - np.log2(m)
            self.levels.append((ctx, escape.astype(np.float32), u, cost.astype(np.float32)))

    def costs(self, asked: list[tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
        """Code lengths of the grams of the highest order; asked: for each order its grams and where their suffixes stand."""
        below = np.full(1, 8.0)  # below order 0: a uniform byte
        for (ctx, escape, u, cost), (grams, suffix) in zip(self.levels, asked, strict=True):
            at, seen = _find(u, grams)
            out = np.where(seen, cost[at], 0).astype(np.float64) if len(u) else np.zeros(len(grams))
            rest = np.flatnonzero(~seen)
            if len(rest):
                c, known = _find(ctx, grams[rest] >> np.uint64(8))
                low = below[suffix[rest]] if suffix is not None else below[0]
                out[rest] = low + (np.where(known, escape[c], 0) if len(ctx) else 0)
            below = out
        return below


def windows(data: np.ndarray, order: int) -> np.ndarray:
    """The gram of ``order`` + 1 bytes that ends at each byte, from the ``order``-th on."""
    x = np.zeros(max(0, len(data) - order), np.uint64)
    for k in range(order + 1):
        x = (x << np.uint64(8)) | data[k : k + len(x)]
    return x


class Model:
    """A context tree for every language, and what unseen texts of it cost."""

    def __init__(self, langs: list[str], counts: dict, order: int = ORDER):
        """counts: for each language, byte gram of ``order`` + 1 bytes (big-endian) -> count over the training texts, or two arrays of these."""
        self.langs, self.order = langs, order
        self.trees = []
        for x in langs:
            c = counts[x]
            keys, n = c if isinstance(c, tuple) else (np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.float64, len(c)))
            self.trees.append(Tree(keys.astype(np.uint64), n.astype(np.float64), order))
        #: bits a byte beyond which a text is no text of the language; none known: any
        self.limits = np.full(len(langs), np.inf)

    def size(self) -> int:
        """Bytes that the trees hold."""
        return sum(x.nbytes for t in self.trees for level in t.levels for x in level)

    def _grams(self, grams: np.ndarray):
        """Code lengths of distinct grams: one row a gram, one column a language."""
        asked, g = [], grams
        for k in range(self.order, -1, -1):
            if k:
                short, suffix = np.unique(g & np.uint64((1 << 8 * k) - 1), return_inverse=True)
            asked.append((g, suffix if k else None))
            g = short if k else g
        asked.reverse()
        return np.stack([t.costs(asked) for t in self.trees], 1)

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each row of bytes under each language; ``order`` spaces stand before each row."""
        out, o = np.zeros((len(off) - 1, len(self.langs))), self.order
        pad = np.full(o, 32, np.uint8)
        for x, y in slices(off, PIECE):
            for lo in range(off[x], off[y], PIECE):  # a long row in pieces
                hi = min(off[y], lo + PIECE)
                if y - x == 1:
                    before = fold(data[max(off[x], lo - o - 1) : lo])[-o:] if lo > off[x] else pad[:0]
                    text = np.concatenate([pad[len(before) :], before, fold(data[max(off[x], lo - 1) : hi])[int(lo > off[x]) :]])
                    g = windows(text, o)
                    edge = np.array([0, len(g)])
                else:
                    # spaces before each row, whose own grams are left out
                    n = np.diff(off[x : y + 1])
                    room = np.repeat(np.arange(1, y - x + 1) * o, n) + np.arange(hi - lo)
                    text = np.full(hi - lo + (y - x) * o, 32, np.uint8)
                    text[room] = fold_rows(data[lo:hi], off[x : y + 1] - lo)
                    g = windows(text, o)[room - o]
                    edge = off[x : y + 1] - lo
                u, at = np.unique(g, return_inverse=True)
                cost = self._grams(u) if len(u) else np.zeros((0, len(self.langs)))
                for k in range(len(self.langs)):
                    run = np.zeros(len(g) + 1)
                    np.cumsum(cost[:, k][at], out=run[1:])
                    out[x:y, k] += run[edge[1:]] - run[edge[:-1]]
        return out


def fold_rows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``fold`` of each row by itself: a letter's two bytes never come from two rows."""
    out = fold(data)
    at = off[1:-1]
    at = at[(at > 0) & (at < len(data))]
    x = data[at]
    out[at] = np.where((x >= 65) & (x <= 90), x + 32, x)
    return out


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER) -> DataFrame:
    """(lang, part, gram, n): grams of ``order`` + 1 bytes of the folded texts, ``order`` spaces before each; part is a column of ``docs``."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(2))
            names, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            tally: dict[tuple, list] = {}
            for i, key in enumerate(zip(names, parts, strict=True)):
                g = windows(np.concatenate([np.full(order, 32, np.uint8), fold(data[off[i] : off[i + 1]])]), order)
                if len(g):
                    tally.setdefault(key, []).append(np.unique(g, return_counts=True))
            for (name, part), got in tally.items():
                u, n = _sums(np.concatenate([p[0] for p in got]), np.concatenate([p[1] for p in got]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(np.full(len(u), part, np.int32)), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "part", "gram", "n"])

    parts = docs.select(F.col(lang).alias("lang"), F.col("part").cast("int").alias("part"), F.col(text).alias("text")).mapInArrow(run, "lang string, part int, gram bigint, n bigint")
    return parts.groupBy("lang", "part", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE, order: int = ORDER, most: int = FIT_ROWS, calibrated: bool = True) -> Model | None:
    """Learn every language of the labelled rows from about ``rows`` of each (``most`` in all); None if there are none.

    The sample is a hash threshold on doc_id, lower for the larger languages, so its size is bounded
    whatever the table's; whole texts are read. The driver gets the sample's gram counts. A trial fit on
    three quarters of the sample tells what texts of the last quarter cost, which sets each language's limit; with
    ``calibrated`` false it is left out, and no text is beyond a limit.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows_in = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    per = rows_in.groupBy(F.col(lang).alias("lang")).count().collect()  # one row a language
    if not per:
        return None
    rows = max(1, min(rows, most // len(per)))
    share = spark.createDataFrame([(r["lang"], min(1.0, rows / r["count"])) for r in per], "_lang string, _share double")
    hashed = lambda salt: F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(salt))
    dice = F.pmod(hashed(9), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows_in.join(F.broadcast(share), F.col(lang) == F.col("_lang")).filter(dice < F.col("_share"))
    sample = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(hashed(10), F.lit(TRIAL)).cast("int").alias("part"))
    got = gram_counts(sample, order=order).toArrow()
    names, which = np.unique(np.array(got["lang"].to_pylist(), object), return_inverse=True)
    if not len(names):
        return None
    part, keys, n = (got[c].to_numpy() for c in ("part", "gram", "n"))
    langs = [str(x) for x in names]

    def counts(inside):
        return {x: _sums(keys[(which == i) & inside].astype(np.uint64), n[(which == i) & inside]) for i, x in enumerate(langs)}

    model = Model(langs, counts(np.ones(len(keys), bool)), order)
    if not calibrated:
        return model
    trial = Model(langs, counts(part > 0), order)
    model.limits = limits(identify(sample.filter("part = 0"), trial, keep_text=False).filter("lang_pred = lang"), langs)
    return model


def limits(scored: DataFrame, langs: list[str]) -> np.ndarray:
    """The largest bits a byte that a text of each language may cost: the median of its unseen texts and SPREADS
    median deviations (as standard deviations) more. With fewer than ten such texts the deviation is that of all
    languages' texts, with none the limit is the largest of the others."""
    rows = scored.select("lang", "bits").toArrow()  # at most the sample's rows, one number each
    lang, bits = np.array(rows["lang"].to_pylist(), object), rows["bits"].to_numpy()
    middle = {x: np.median(bits[lang == x]) for x in set(lang.tolist())}
    off = np.abs(bits - np.array([middle[x] for x in lang.tolist()], float))
    spread = {x: 1.4826 * np.median(off[lang == x] if (lang == x).sum() >= 10 else off) for x in middle}
    known = {x: middle[x] + SPREADS * max(LEAST_SPREAD, spread[x]) for x in middle}
    return np.array([known.get(x, max(known.values(), default=np.inf)) for x in langs])


ADDED = ("lang_pred", "score", "bits", "likely")


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add lang_pred, score, bits (a byte, under the best language) and likely to ``docs`` (without its text, if asked).

    ``und`` with score 0 stands for null texts, texts without a letter, and all texts if nothing
    could be learned. score is the posterior of the best language with equal priors, where evidence
    counts at most as that of 64 bytes, so a long text isn't called certain by length alone. likely tells
    whether the text costs no more than the best language's limit and SLACK bits (null for ``und``).
    Ties go to the first language in code-point order. Whole texts are scored, of any length; repeated rows get
    equal results; columns of ``docs`` named like a result are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    keep = [c for c in docs.columns if c not in ADDED]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep if c != text])  # one column, so no name can clash
    packed = docs.select(rest.alias("rest"), F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    schema = packed.select("rest", *["text"] * keep_text).schema.add("lang_pred", "string").add("score", "double").add("bits", "double").add("likely", "boolean")
    names = [f.name for f in schema]
    shipped = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        for batch in batches:
            letter = np.asarray(batch.column(2).to_pylist(), bool)
            n = batch.num_rows
            pred, score, bits, likely = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), np.full(n, None, object)
            if m is not None and n:
                data, off = flat(batch.column(1))
                b = m.bits(data, off)
                size = np.maximum(np.diff(off), 1)
                best = b.argmin(1)
                ev = np.exp2(-(b - b.min(1, keepdims=True)) * np.minimum(1.0, 64 / size)[:, None])
                pred[letter] = np.array(m.langs, object)[best][letter]
                score[letter] = (1 / ev.sum(1))[letter]
                bits[letter] = (b.min(1) / size)[letter]
                likely[letter] = (b.min(1) <= m.limits[best] * size + SLACK)[letter]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(1)] * keep_text, pa.array(pred, pa.string()), pa.array(score), pa.array(bits, from_pandas=True), pa.array(likely, pa.bool_())], names)

    out = packed.mapInArrow(run, schema)
    return out.select(*[(F.col("text") if c == text else F.col("rest")[c]).alias(c) for c in keep if keep_text or c != text], *ADDED)


def learned(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"), 4, 2))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text of ``documents``, learned from the rows that are not held out.

    Nulls, empty and very long texts, ties, repeated rows and clashing columns: see ``identify``; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(learned(docs), calibrated=False)
    out = identify(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model | None, wanted: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` whose predicted language is ``wanted`` (default: any that was learned) and whose code is no
    longer than texts of that language are. Without a model every row stays."""
    if model is None:
        return docs
    out = identify(docs.withColumn("_given", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_given", "text"), model)
    known = (F.col("lang_pred") != "und") & F.col("likely")
    known = known if wanted is None else known & F.col("lang_pred").isin(wanted)
    return out.filter(known).select(*[F.col("_given")[c].alias(c) for c in docs.columns])


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is ``und`` go, and those that cost more bits than texts of the nearest language do."""
    return accepted(docs, fit(learned(docs)))
