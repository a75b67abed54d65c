"""The ten operators and the pipeline stages against brute force, and on nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import components, language_id, mixing, near_join, nearest, packing, quality_model, quality_rules, ranks, substring_dedup, token_counts, warc
from lexiloom.llm import _common as c
from lexiloom.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows: nulls, empties, one very long text, repeated rows, one id twice."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 6))) for _ in range(300)]
    long = " ".join(draw.choices(words, k=30_000))
    piece = " ".join(draw.choices(words, k=80))
    rows = [
        (1, long, "en", "a", 1), (2, None, "en", None, None), (3, "", None, "b", 0), (4, " \t\n", "en", "a", 3), (5, piece, "en", "a", 1), (5, piece, "en", "a", 1),
        (6, "x y z " + piece + " w", "en", None, 1), (7, "one", "en", "b", 3), (7, "two words", "en", "b", 9), (None, piece, "en", "a", 1), (8, "élan vital \U0001F600 " * 30, None, "b", 5),
        (9, long[: len(long) // 2], "en", "c", 7), (10, "same same " * 60, "en", "c", 7), (11, "one", None, "c", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sample(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# ---------------------------------------------------------------- words and hashes


def test_word_spans_and_hashes():
    texts = ["", "a", " a  bb\n", "\x0b\x0c", "x\x1cy \xa0z", "word " * 500]
    raw = [t.encode() for t in texts]
    off = np.array([0, *np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    seen = {}
    for t, r, (h, s, e) in zip(texts, raw, c.split_words(data, off), strict=True):
        assert [r[a:b] for a, b in zip(s, e, strict=True)] == r.split() == [w.encode() for w in c.words_of(t)]
        for w, x in zip(r.split(), h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_gram_hashes_tell_grams_apart(monkeypatch):
    w = np.random.default_rng(0).integers(0, 5, 4000).astype(np.uint64)
    for salt in (0, 1):
        whole = c.gram_hashes(w, 3, salt)
        monkeypatch.setattr(c, "CHUNK", 64)
        assert (c.gram_hashes(w, 3, salt) == whole).all()
        monkeypatch.undo()
        by = defaultdict(set)
        for i, h in enumerate(whole.tolist()):
            by[h].add(tuple(w[i : i + 3]))
        assert all(len(v) == 1 for v in by.values()) and len(by) == len({tuple(w[i : i + 3]) for i in range(len(w) - 2)})


def test_ranks_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK_ROOT", 1)
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i % 4) for i in range(300)] + [(1, "hot", 1), (1, "hot", 1), (None, "hot", 2)]
    df = spark.createDataFrame(rows, "doc_id long, g string, size long")
    got = ranks.ranked(df, "g", "size", "doc_id").collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["rank"], r["size"], hashlib.md5(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"").hexdigest()))
    for v in by.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1)) and [x[1:] for x in v] == sorted(x[1:] for x in v)


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    from compare import check

    check(queries.queries()[name](spark, small), duck, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op3_mix_sources", "op4_pack", "op5_quality_rules", "op6_near_join", "op8_substring_dedup"])
def test_query_equals_sql_on_odd_rows(spark, odd, none, tmp_path, name):
    import duckdb

    from compare import check

    for k, docs in enumerate((odd, none)):
        docs.coalesce(1).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/documents.parquet/*.parquet'")
        if name == "op8_substring_dedup" and k == 0:  # SQL counts null ids as equal to none
            duck.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
            odd.filter("doc_id is not null").write.parquet(f"{tmp_path}/known/documents.parquet")
            check(queries.queries()[name](spark, f"{tmp_path}/known"), duck, queries.oracle_sql()[name])
        else:
            check(queries.queries()[name](spark, f"{tmp_path}/{k}"), duck, queries.oracle_sql()[name])


# ---------------------------------------------------------------- 1 quality model


def test_quality_model_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = quality_model.op1_quality_model(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = rows.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    bad, good = [r for r in got if r["quality"] == 0], [r for r in got if r["quality"] == 1]
    assert rows.count() == 1000 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] for r in good]) > 0.95 and np.mean([r["predicted"] for r in bad]) < 0.1


def test_quality_model_on_odd_rows(spark, odd, none):
    vectors = spark.sparkContext.broadcast(quality_model.word_vectors(odd))
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (6, None), (10, 0), (99, 1)], "doc_id long, quality int")
    net = quality_model.train(odd, labels, vectors)
    a, b = (sorted(map(tuple, quality_model.score(odd, vectors, net).collect()), key=str) for _ in range(2))
    assert a == b and len(a) == 14 and all(0 <= s <= 1 for _, s in a)
    assert quality_model.train(odd, labels.limit(0), vectors) is None
    assert {r["score"] for r in quality_model.score(odd, vectors, None).collect()} == {0.5}
    assert quality_model.score(none, vectors, net).count() == 0 and np.isfinite(quality_model.word_vectors(none)).all()


def plain_tokens(text):
    import re

    return re.findall(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0d\u0080-\U0010ffff]+", text or "")


def plain_row(word, rows):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(quality_model.bucket(c.span_hashes(raw, np.array([0]), np.array([len(raw)])), rows)[0])


def test_word_vectors_equal_brute_force(spark, sample):
    texts = [r["text"] for r in sample.limit(60).collect()] + [None, "", "x", "a1b2!! c", "one one one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = quality_model.ROWS
    place, sign = quality_model.index_vectors(rows)
    want, memo = np.zeros((rows, quality_model.DIM)), {}
    for t in texts:
        at = [memo.setdefault(w, plain_row(w, rows)) for w in plain_tokens(t)]
        for x, y in zip(at[:-1], at[1:], strict=True):
            for k in range(quality_model.NONZERO):
                want[x, place[y, k]] += sign[y, k]
                want[y, place[x, k]] += sign[x, k]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = quality_model.word_vectors(df)
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-6)


def test_the_table_grows_with_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "ROWS", 64)
    sizes = [quality_model.table_rows(spark.createDataFrame([(" ".join(f"{'x' * (i % 7)}q{i}z" for i in range(k, k + 50)),) for k in range(0, n, 50)], "text string")) for n in (50, 5000, 200_000)]
    assert sizes[0] < sizes[1] < sizes[2] and all(x & (x - 1) == 0 for x in sizes)


def test_pooling_equals_brute_force_and_is_the_same_in_pieces(monkeypatch):
    base = "alpha beta*** beta beta!! 12 gamma\n"
    texts = [base * 50, "", base * 100, "z" * 3000 + base + "9" * 700, " ", "one", "é!é " * 80]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.array([0, *np.cumsum([len(r) for r in raw])])
    v = np.random.default_rng(0).normal(size=(quality_model.ROWS, quality_model.DIM)).astype(np.float32)
    whole = quality_model.pool(data, off, v)
    for i, t in enumerate(texts):
        words = plain_tokens(t)
        x = np.array([v[plain_row(w, len(v))] for w in words], float).reshape(-1, quality_model.DIM)
        n, m = max(1, len(words)), max(1, len(words) - 1)
        mean = x.sum(0) / n
        want = np.concatenate([mean, np.sqrt(np.maximum((x**2).sum(0) / n - mean**2, 0)), np.abs(np.diff(x, axis=0)).sum(0) / m, [np.log1p(len(words)) / 10, sum(p == q for p, q in zip(words[:-1], words[1:], strict=True)) / m]])
        assert np.allclose(whole[i], want, atol=1e-4), t[:20]
    for chunk in (128, 16):
        monkeypatch.setattr(quality_model, "CHUNK", chunk)
        monkeypatch.setattr(quality_model, "slices", lambda o, chunk=chunk: c.slices(o, chunk))
        assert np.allclose(quality_model.pool(data, off, v), whole, atol=1e-4)


# ---------------------------------------------------------------- 2 nearest neighbours


def brute_nearest(rows, is_query, k=5):
    x = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(a is not None and np.isfinite(a) for a in v) and any(v)}
    out = {}
    for q in x:
        if is_query(q):
            s = [(-nearest.exact_cosine(x[q][None], x[i][None])[0], i) for i in x if i != q]
            out[q] = [(i, -v) for v, i in sorted(s)[:k]]
    return out


def test_nearest_odd_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (350, [float("nan"), 1.0, 1.0, 1.0]), (351, [float("inf"), 1.0, 1.0, 1.0]), (352, [1.0]), (400, [1e-30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None) for r in df.collect()]
    got = defaultdict(list)
    for r in nearest.search(df, F.col("vec_id") % 50 == 0, target=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest(exact, lambda q: q % 50 == 0)
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.9
    assert [i for i, _ in got[0]] == [200, 201, 202, 203, 204]
    for q, v in got.items():
        x = dict(exact)
        assert len(v) == 5 and all(s == nearest.exact_cosine(np.array([x[q]], float), np.array([x[i]], float))[0] for i, s in v)


def brute_rows(rows, is_query, k=5):
    """By rows: an id counts once with its best score, for queries and answers alike."""
    known = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    best = defaultdict(dict)
    for q, x in known:
        if is_query(q):
            best[q]
            for i, y in known:
                if i != q and len(x) == len(y):
                    best[q][i] = max(best[q].get(i, -9), nearest.exact_cosine(x[None], y[None])[0])
    return {q: [(i, v) for v, i in sorted((-v, i) for i, v in got.items())[:k]] for q, got in best.items()}


@pytest.mark.parametrize("chunk", [4096, 16])
def test_nearest_repeated_rows_ids_and_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(nearest, "CHUNK_ROWS", chunk)
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=4).round(3).tolist()) for i in range(150)]
    hot = rows[7][1]
    rows += [(50, rows[50][1]), (50, rows[3][1]), (100, rows[9][1]), (12, rows[13][1]), (12, rows[14][1])]  # repeated rows; ids with several vectors
    rows += [(1000 + i, hot) for i in range(120)] + [(1050, hot)] * 3  # a hot vector; some copies ask
    rows += [(2000 + i, draw.normal(size=3).tolist()) for i in range(20)] + [(2050, [1.0, 0.0]), (2100, [float("nan")] * 4)]  # other lengths
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in nearest.search(df, F.col("vec_id") % 50 == 0, target=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert len(got[r["query_id"]]) == r["rank"]
    want = {q: [(i, -v) for i, v in x] for q, x in brute_rows(rows, lambda q: q % 50 == 0).items()}
    assert dict(got) == {q: x for q, x in want.items() if x}


def test_the_sample_comes_from_all_of_a_sorted_table(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SAMPLE", 500)
    monkeypatch.setattr(nearest, "MOST_SAMPLE", 500)
    seen, draw = [], np.random.default_rng(4)
    centres = draw.normal(size=(40, 8))
    rows = [(i, (centres[i // 100] + draw.normal(size=8) * 0.05).tolist()) for i in range(4000)]  # in the order of clusters
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    calibrate = nearest.calibrate
    monkeypatch.setattr(nearest, "calibrate", lambda tree, x, k, target: seen.append(x) or calibrate(tree, x, k, target))
    got = defaultdict(set)
    for r in nearest.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    near = (seen[0] @ nearest.unit(centres).T).argmax(1)
    assert len(seen[0]) == 500 and len(set(near.tolist())) == 40
    m = nearest.unit(np.array([v for _, v in rows]))
    hits = 0
    for q in range(0, 4000, 20):
        s = m @ m[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / 1000 >= 0.9


def test_nearest_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in nearest.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert nearest.search(df.limit(0), F.lit(True)).count() == 0
    assert nearest.search(df.limit(1), F.lit(True)).count() == 0


def test_nearest_recall_and_split_leaves(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 50)
    folder = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    x = {r["vec_id"]: np.asarray(r["embedding"], float) for r in df.collect()}
    ids = np.array(sorted(x))
    m = nearest.unit(np.stack([x[i] for i in ids]))
    hits, rows = 0, nearest.search(df, F.col("vec_id") % 10 == 0).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["query_id"]].add(r["vec_id"])
    for q in ids[ids % 10 == 0]:
        s = m @ m[np.searchsorted(ids, q)]
        s[ids == q] = -9
        hits += len(got[q] & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hits / len(rows) >= 0.9


# ---------------------------------------------------------------- 3 mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w, total, stopped = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        level = (total - sum(3 * sizes[s] for s in stopped)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in stopped else level * w[s] for s in names}
        stopped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}": draw.choice([0, 1, 5, 50, 1000, 20]) for i in range(11)} | {None: 7}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_takes_near_its_targets(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a", "b", "b", "b", "c", None]), int(draw.lognormvariate(4, 1))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    a, b = (mixing.copies(df, 7).select("doc_id", "copies").orderBy("doc_id").collect() for _ in range(2))
    assert a == b
    got = mixing.copies(df, 7).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("t"), F.max("copies").alias("m"), F.max("size").alias("big")).collect()
    for r in got:
        assert abs(r["n"] - r["t"]) <= r["big"] and abs(r["n"] / r["t"] - 1) < 0.01 and 0 <= r["m"] <= 3
    assert mixing.copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf,most", [("0.01", 0.01), ("0.1", 0.002)])
def test_mix_is_near_its_targets_in_every_source(spark, sf, most):
    d = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.copies(d).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("t"), F.max("copies").alias("m")).collect()
    assert len(got) == 20 and all(abs(r["n"] / r["t"] - 1) < most and r["m"] <= 3 for r in got)


def test_mix_with_one_huge_text(spark):
    rows = [(i, "a", 10 + i % 7) for i in range(4000)] + [(9999, "a", 20_000)] + [(10_000 + i, "b", 12) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for seed in range(4):
        got = mixing.copies(df, seed).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("t")).collect()
        assert all(abs(r["n"] - r["t"]) <= 20 for r in got)


def test_mix_of_nothing_but_empties(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [r["copies"] for r in mixing.copies(df).collect()] == [0, 0]


# ---------------------------------------------------------------- 4 packing


def brute_padding(lengths, counts, buckets):
    """Least padding of any choice of ends, by the plain quadratic program."""
    m, best = len(lengths), {0: 0}
    for _ in range(buckets):
        now = dict(best)
        for j in range(1, m + 1):
            ways = [best[i] + sum(int(counts[x]) * int(lengths[j - 1] - lengths[x]) for x in range(i, j)) for i in range(j) if i in best]
            now[j] = min([*ways, *([best[j]] if j in best else [])])
        best = now
    return best[m]


@pytest.mark.parametrize("top", [60, 1_000_000])
def test_boundaries_are_optimal(top):
    draw = random.Random(2)
    for _ in range(15):
        n = draw.randint(1, 24)
        lengths = np.array(sorted(draw.sample(range(0, top), n)))
        counts = np.array([draw.randint(1, 9) for _ in lengths])
        for k in (1, 2, 3, 9, 30):
            got = packing.boundaries(lengths, counts, k)
            cost = sum(c * (min(e for e in got if e >= x) - x) for x, c in zip(lengths.tolist(), counts.tolist(), strict=True))
            assert cost == brute_padding(lengths, counts, k) and len(got) <= k and set(got) <= set(lengths.tolist())
    assert packing.boundaries(*[np.zeros(0, int)] * 2) == []


def test_padded_lengths_are_lengths_of_rows(spark):
    draw = random.Random(7)
    sizes = [int(draw.lognormvariate(7, 1.5)) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    got = packing.pack(df, buckets=8).select("length", "bucket_length").collect()
    lengths, counts = np.unique(sizes, return_counts=True)
    pad = sum(r["bucket_length"] - r["length"] for r in got)
    ends = packing.boundaries(lengths, counts, 8)
    assert {r["bucket_length"] for r in got} == set(ends) <= set(sizes) and max(sizes) > 1024
    # no boundary can be moved, added to another place or dropped for less padding
    for i in range(len(ends) - 1):
        for other in lengths[:: max(1, len(lengths) // 60)]:
            e = sorted({*ends[:i], *ends[i + 1 :], int(other)})
            assert sum(int(e[np.searchsorted(e, x)]) - int(x) for x in sizes) >= pad


def test_pack(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([0, 1, 7, 30, 31, 500, 1500, 70_000]), "x") for i in range(400)] + [(5, 7, "x")] * 3 + [(None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, length long, batch_id string")
    got = packing.pack(df, buckets=4, budget=1000).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["length"] <= r["bucket_length"]
        by[r["bucket_length"], r["batch_id"]].append(r["batch_row"])
    assert len({b for b, _ in by}) <= 4
    for (bucket, _), v in by.items():
        assert sorted(v) == list(range(len(v))) and (len(v) == 1 or len(v) * bucket <= 1000)
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_and_mixing_keep_columns_of_any_name(spark):
    names = ["rank", "_rank", "_row", "_g", "_s", "_h", "_b", "s", "k", "row", "u", "r0", "place", "id", "_salt", "_ks", "a.b", "target", "n0", "words2"]
    rows = [(i, i % 5, f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(40)]
    df = spark.createDataFrame(rows, ["doc_id", "size", "source", *names])
    for got in (mixing.copies(df), packing.pack(df, length="size"), ranks.ranked(df, "source", "size", "doc_id", rank="rank")):
        assert got.count() == 40 and len(set(got.columns)) == len(got.columns)
        for r in got.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names if n not in ("rank", "target") or (n == "rank" and "bucket_length" in got.columns))


# ---------------------------------------------------------------- 5 quality rules


def brute_rules(text):
    w = c.words_of(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if c.words_of(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules_on_odd_rows(spark, odd):
    clash = odd.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1))
    for name in ("_words", "_lines", "_text", "_at", "_given", "_hashes", "a.b"):
        clash = clash.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    for r in quality_rules.quality_rules(clash).collect():
        assert all(r[name] == (None if r["doc_id"] is None else f"{name}{r['doc_id']}") for name in ("_words", "_lines", "_text", "_at", "_given", "_hashes", "a.b"))
        want = brute_rules(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def test_rules_compile_from_the_table(spark, sample):
    loose = quality_rules.quality_rules(sample, rules=()).filter("kept = base_failed").count()
    assert loose == 0
    none = quality_rules.quality_rules(sample, rules=(("n_words", 1e9, None),)).filter("kept").count()
    assert none == 0


# ---------------------------------------------------------------- 6 near duplicates


def brute_classes(rows):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = c.words_of(t)
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    links = {k: {m for m in sets if m != k and sets[k] and 5 * len(sets[k] & sets[m]) >= 4 * len(sets[k] | sets[m])} if rows[k][0] is not None else set() for k in sets}
    links = {k: {m for m in v if rows[m][0] is not None} for k, v in links.items()}
    out = {}
    for k in sets:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[k] = (rows[k][0], min((rows[m][0] for m in seen), default=None) if rows[k][0] is not None else None, len(links[k]))
    return sorted(out.values(), key=str)


def near_rows(seed=4, n=240):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for i in range(n):
        if base and draw.random() < 0.6:
            w = list(draw.choice(base))
            for _ in range(draw.choice([0, 1, 2, 3, 5, 12])):
                w[draw.randrange(len(w))] = draw.choice(words)
        else:
            w = draw.choices(words, k=draw.randint(1, 160))
        base.append(w)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("limit,block", [(256, 512), (4, 8)])
def test_near_duplicates(spark, odd, monkeypatch, limit, block):
    monkeypatch.setattr(near_join, "LIMIT", limit)
    monkeypatch.setattr(near_join, "BLOCK", block)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_join.near_duplicates(df).select("doc_id", "class_id", "n_links").collect()), key=str)
    assert got == brute_classes(rows)
    if limit == 256:
        rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
        got = sorted((tuple(r) for r in near_join.near_duplicates(odd).select("doc_id", "class_id", "n_links").collect()), key=str)
        assert got == brute_classes(rows)


def test_near_duplicates_of_nothing(spark, none):
    assert near_join.near_duplicates(none).count() == 0
    assert near_join.stage_near(spark, none, "").count() == 0


def test_one_of_each_class_stays(spark, odd):
    got = near_join.stage_near(spark, odd, "")
    assert got.columns == odd.columns
    # 6 and the other row of 5 are near copies of 5; 7 has two texts of its own, one of them met again in 11
    assert sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in got.collect()), key=str) == sorted([(r["doc_id"], (r["text"] or "")[:9]) for r in odd.filter("doc_id is null or doc_id not in (5, 6, 11)").collect()] + [(5, odd.filter("doc_id = 5").first()["text"][:9])], key=str)


def test_dense_nodes_and_deep_splits(spark, monkeypatch):
    monkeypatch.setattr(near_join, "LIMIT", 10)
    monkeypatch.setattr(near_join, "BLOCK", 16)
    draw = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    base, rows = draw.choices(words, k=120), []
    for i in range(90):  # a large group of near copies ...
        w = list(base)
        for _ in range(draw.choice([1, 2, 3])):
            w[draw.randrange(120)] = draw.choice(words)
        rows.append((i, " ".join(w)))
    common = draw.choices(words, k=25)
    for i in range(150):  # ... and texts that share a passage but are no copies
        rows.append((1000 + i, " ".join(common + draw.choices(words, k=30))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_join.near_duplicates(df).select("doc_id", "class_id", "n_links").collect()), key=str)
    assert got == brute_classes(rows)


def test_recall_of_the_runs():
    assert near_join.survival(1.6) == pytest.approx(0.6420, abs=1e-3) and near_join.RUNS == 9
    assert (1 - near_join.survival(near_join.TOKENS * 0.8)) ** near_join.RUNS < 1 - near_join.TARGET


def test_intersections():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 60, draw.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    want = [[len(set(a.tolist()) & set(b.tolist())) if i != j else -1 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for part in (sets, sets[:4]):
        got = near_join.intersections(part)
        assert all(got[i, j] == want[i][j] for i in range(len(part)) for j in range(len(part)) if i != j)


def test_components(spark):
    draw = random.Random(6)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)] * 3
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 7 token counts


TEXTS = [
    None, "", "The quick, brown fox's 12 O'Neill'll HELLO", "<|endoftext|>a<|startoftext|> b<|endoftext", "Ünïcode İstanbul ΣΑΣ ﬁ ½ ² ª", "日本語 テスト 😀👍🏽", "é Å ẛ̣", "a\x1cb\x85c\xa0d e​f",
    "x" * 3000, "''s's '", "ÀÉÎ ÑÑÑ !!!??", "\x00\x7f\xad soft", "don't they're I'M we'VE", "123 4５6 Ⅷ", "한글 한",
]


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


def test_token_counts_equal_the_library(spark, sample, vocabulary):
    from tokenizers import Tokenizer

    texts = TEXTS + [r["text"] for r in sample.select("text").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    tokenizer = Tokenizer.from_str(vocabulary)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, vocabulary).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)), t
    assert token_counts.count_tokens(df.limit(0), vocabulary).count() == 0


def test_counter_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 5)
    whole = token_counts.whole_tokens(vocabulary)
    counter = token_counts.Counter(vocabulary, whole)
    assert len(whole) > 20_000 and "the" in whole
    text = " ".join(f"word{i} thing" for i in range(50)).encode()
    assert counter.count(text) == counter.count(text) and len(counter) <= 5 and len(counter.merged) <= 5


# ---------------------------------------------------------------- 8 substring dedup


def brute_substrings(rows):
    first = {}
    words = [c.words_of(t) for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - 49):
                g = tuple(w[k : k + 50])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(50)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_substrings(spark, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passages = [draw.choices(words, k=draw.randint(45, 220)) for _ in range(8)] + [["la"] * 120, ["a", "b"] * 70]
    rows = []
    for i in range(90):
        w = []
        for _ in range(draw.randint(1, 4)):
            p = draw.choice(passages)
            a = draw.randint(0, 30)
            w += p[a : a + draw.randint(20, 200)] + draw.choices(words, k=draw.randint(0, 40))
        rows.append((i if i % 11 else i + 1, " ".join(w)))
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str) == brute_substrings(rows)


def test_substrings_on_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    clash = odd.withColumn("rk", F.lit("a")).withColumn("n_removed", F.lit("b"))
    got = substring_dedup.substring_dedup(clash)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str) == brute_substrings(rows)
    assert got.filter("rk = 'a'").count() == len(rows)
    assert substring_dedup.substring_dedup(none).count() == 0
    stage = substring_dedup.stage_substring(spark, odd, "")
    assert stage.schema.simpleString() == odd.schema.simpleString() and 0 < stage.count() <= len(rows)
    assert stage.filter("doc_id = 9").count() == 0 and stage.filter("doc_id = 6").first()["text"] == "x y z w"


# ---------------------------------------------------------------- 9 language


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = language_id.op9_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert got.count() == 1000 and held.filter("lang_pred = lang").count() / held.count() > 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("order", [1, 3, 5])
def test_code_lengths_match_the_definition(order):
    text = [b"abracadabra", b"abrakadabra alakazam" + "çaçá жук".encode()]
    pad, counts = b" " * order, {}
    for lang, t in zip("xy", text, strict=True):
        counts[lang] = Counter(int.from_bytes((pad + t)[i : i + order + 1], "big") for i in range(len(t)))
    model = language_id.Model(["x", "y"], counts, order)

    def cost(lang, ctx, b, n=order):
        if n < 0:
            return 8.0
        seen = Counter()
        for g, k in counts[lang].items():
            g = g.to_bytes(order + 1, "big")
            if g[order - n : order] == ctx[order - n :]:
                seen[g[order]] += k
        if not seen:
            return cost(lang, ctx, b, n - 1)
        total, kinds = sum(seen.values()), len(seen)
        return np.log2((total + kinds) / seen[b]) if b in seen else np.log2((total + kinds) / kinds) + cost(lang, ctx, b, n - 1)

    for t in (b"abra", b"zebra kad", b"", b"\xff\xfea", "жç".encode()):
        data = np.frombuffer(t, np.uint8)
        got = model.bits(data, np.array([0, len(t)]))[0]
        for k, lang in enumerate("xy"):
            want = sum(cost(lang, (pad + t)[i : i + order], t[i]) for i in range(len(t)))
            assert got[k] == pytest.approx(want, rel=1e-4)


def test_long_rows_score_the_same_in_pieces(monkeypatch):
    texts = {"x": b"   the cat sat on the mat \xc3\xa9t\xc3\xa9", "y": b"zzzzz"}
    model = language_id.Model(["x", "y"], {k: Counter(int.from_bytes(t[i : i + 4], "big") for i in range(len(t) - 3)) for k, t in texts.items()}, 3)
    t = [b"the cat", b"", "sat on THE mat, ÉTÉ the cat".encode(), b"zz", b"\x9f", b"\xc3", b"\x89"]
    off = np.array([0, *np.cumsum([len(x) for x in t])])
    alone = np.concatenate([model.bits(np.frombuffer(x, np.uint8), np.array([0, len(x)])) for x in t])
    for piece in (1 << 19, 13, 5, 1):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "slices", lambda o, limit: c.slices(o, limit))
        assert np.allclose(model.bits(np.frombuffer(b"".join(t), np.uint8), off), alone, atol=1e-3), piece


def test_language_on_odd_rows(spark, odd, none):
    model = language_id.fit(odd)
    got = language_id.identify(odd.withColumn("score", F.lit("x")).withColumn("_letter", F.lit(1)).withColumn("a.b", F.lit(2)), model)
    assert got.count() == 14 and got.filter("lang_pred = 'und'").select("doc_id").distinct().count() == 3 and {"_letter", "a.b"} <= set(got.columns)
    assert language_id.fit(none) is None and language_id.identify(none, None).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}
    stage = language_id.stage_language(spark, odd, "")
    assert stage.columns == odd.columns and stage.filter("text is null or trim(text) = ''").count() == 0 and stage.count() >= 7


def test_every_labelled_language_is_learned(spark):
    draw, rows, texts = random.Random(4), [], {}
    for k in range(70):  # made-up languages, the last two with fewer rows
        words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)]
        rows += [(100 * k + i, " ".join(draw.choices(words, k=30)), f"l{k:02}") for i in range(3 if k < 68 else 2)]
        texts[f"l{k:02}"] = " ".join(draw.choices(words, k=30))
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(texts) and model.size() < 70 * 100_000
    got = language_id.identify(spark.createDataFrame(list(texts.items()), "lang string, text string").coalesce(1), model).collect()
    assert len(got) == 70 and all(r["lang_pred"] == r["lang"] for r in got)


SCRIPTS = {"ru": range(0x430, 0x450), "uk": [*range(0x430, 0x44A), 0x456, 0x457, 0x491], "zh": range(0x4E00, 0x4F00), "ja": [*range(0x3041, 0x3090), *range(0x4E80, 0x4EA0)], "ar": range(0x627, 0x64B), "fa": [*range(0x627, 0x63B), 0x67E, 0x686, 0x6AF], "en": range(0x61, 0x7B)}


def scripts(draw, each):
    """(lang, text): made-up texts of languages in several scripts; some share theirs."""
    for lang, letters in SCRIPTS.items():
        words = ["".join(chr(x) for x in draw.choices(list(letters), k=4)) for _ in range(80)]
        yield from ((lang, " ".join(draw.choices(words, k=60))) for _ in range(each))


def test_mixed_scripts_are_told_apart(spark):
    rows = [(i, t, x) for i, (x, t) in enumerate(scripts(random.Random(3), 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.filter("doc_id % 4 <> 0"))
    got = language_id.identify(df.filter("doc_id % 4 = 0"), model).collect()
    assert model.langs == sorted(SCRIPTS) and all(r["lang_pred"] == r["lang"] and r["likely"] for r in got)


def test_the_sample_of_all_languages_is_bounded(spark):
    rows = [(i, f"text number {i} of some words", f"l{i % 5}") for i in range(1000)]
    counts = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=100, order=2)
    assert len(counts.langs) == 5 and counts.size() < 40_000


def test_the_language_stage_drops_junk_and_foreign_scripts_and_keeps_clean_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(9)
    noise = ["".join(chr(draw.randrange(33, 127)) for _ in range(400)) for _ in range(10)] + ["".join(draw.choices("bcdfghjklmnpqrstvwxz", k=500)) for _ in range(10)]
    foreign = [t for x, t in scripts(draw, 5) if x != "en"]
    planted = [(1_000_000 + 4 * i, t, None, "src1", len(t)) for i, t in enumerate(noise + foreign)]
    whole = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = language_id.stage_language(spark, whole, "")
    assert kept.columns == docs.columns and kept.filter("doc_id >= 1000000").count() == 0
    good = docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1"), "doc_id")
    assert kept.join(good.select("doc_id"), "doc_id").count() / good.count() >= 0.98 and kept.count() >= 0.95 * docs.count()
    model = language_id.fit(language_id.learned(docs))
    assert {r["lang"] for r in language_id.accepted(docs, model, ["en"]).select("lang").distinct().collect()} >= {"en"}
    assert language_id.accepted(docs, model, ["en"]).filter("lang <> 'en'").count() < 5 and language_id.accepted(docs, None).count() == 1000


# ---------------------------------------------------------------- 10 WARC


def archive(n=40, gz=True):
    draw = random.Random(8)
    recs = [warc.record("response", str(i), f"http://x/{i}", bytes(draw.choices(range(256), k=draw.choice([0, 5, 700, 3000])))) for i in range(n)]
    return [warc.member(r) if gz else r for r in recs], recs


@pytest.mark.parametrize("gz", [True, False])
def test_whole_archives(gz):
    parts, _ = archive(gz=gz)
    got = list(warc.salvage(io.BytesIO(b"".join(parts))))
    assert [g[0] for g in got] == ["record"] * 40 and [g[3][0]["warc-record-id"] for g in got] == [f"<urn:page:{i}>" for i in range(40)]
    assert list(warc.salvage(io.BytesIO(b""))) == []


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_salvage(gz, seed):
    draw = random.Random(seed)
    parts, recs = archive(gz=gz)
    start = np.cumsum([0, *map(len, parts)])
    raw = bytearray(b"".join(parts))
    kind = seed % 3
    hurt = sorted(draw.sample(range(1, 39), 3))
    if kind == 0:  # bytes changed inside
        for i in hurt:
            at = start[i] + (len(parts[i]) // 2 if gz else 3)
            raw[at] ^= 0xFF
    elif kind == 1:  # a stretch lost
        i = hurt[0]
        del raw[start[i] + 10 : start[i] + len(parts[i]) - 3]
        hurt = [i]
    else:  # noise between records, and the end cut short
        i = hurt[0]
        raw[start[i] : start[i]] = bytes(draw.choices(range(256), k=5000)) + b"\x1f\x8b\x08 WARC/1.0\r\nnoise"
        raw = raw[:-5]
        hurt = [39]
    got = list(warc.salvage(io.BytesIO(bytes(raw))))
    seen = {int(g[3][0]["warc-record-id"][10:-1]): g[3][1] for g in got if g[0] == "record"}
    assert set(range(40)) - set(seen) <= set(hurt)
    for i, block in seen.items():
        assert block == recs[i].split(b"\r\n\r\n", 1)[1][:-4]
    edges = [x for g in got for x in g[1:3]]
    assert edges[0] == 0 and edges[-1] == len(raw) and edges[1:-1:2] == edges[2::2] and any(g[0] == "gap" for g in got)


def test_digest():
    assert warc.sha1_base32(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode() == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert zlib.decompress(warc.member(b"abc"), 31) == b"abc"


def test_round_trip_of_odd_pages(spark, tmp_path):
    rows = [(1, "u", "é<p>"), (2, None, "é<p>"), (3, "a\r\nb", None), (4, "u", ""), (5, "u", "x" * 200_000), (6, "u", "é<p>"), (6, "u", "é<p>"), (None, "u", "é<p>"), (7, "u", "WARC/1.1\r\nContent-Length: 9\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages, blocks=True).collect()
    assert len(got) == len(rows) and all(r["gap"] is None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["record_id"]].append((r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]))
    d = lambda s: warc.sha1_base32(s.encode())
    assert by["1"] == [("revisit", "6", 5, d("é<p>"))] == by["2"] and by["6"] == [("response", None, 5, d("é<p>"))] * 2
    assert by["3"] == [("revisit", "4", 0, d(""))] and by["4"] == [("response", None, 0, d(""))] and by["5"][0][:3] == ("response", None, 200_000)
    assert by["None"][0][0] == "response"
    least = warc.plan_records(pages, least=1).filter("kind = 'revisit'").collect()
    assert sorted(r["page_id"] for r in least) == [1, 2]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_files_are_read_on(spark, tmp_path):
    parts, _ = archive()
    raw = bytearray(b"".join(parts))
    raw[len(parts[0]) + 30] ^= 1
    (tmp_path / "a.warc.gz").write_bytes(bytes(raw))
    manifest = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "archive string")
    rows = warc.read_archives(manifest, str(tmp_path)).orderBy("first_byte").collect()
    assert [r["gap"] is not None for r in rows].count(True) == 1 and rows[1]["gap"] and rows[1]["first_byte"] == len(parts[0]) and len(rows) == 40


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark, small, sample):
    import corpus_pipeline as p

    docs, seen = sample, []
    for name, stage in p.STAGES:
        docs = c.written(stage(spark, docs, small), f"test-{name}")
        seen.append((name, docs.count(), docs.columns))
    assert [n for n, _, _ in seen] == ["language", "near_duplicates", "substring_dedup", "mixing", "packing"]
    assert all(cols == sample.columns for _, _, cols in seen[:4]) and seen[3][1] == seen[4][1] > 0
    before = len(c._made)
    assert p.run(spark, small).count() == seen[4][1]
    assert len(c._made) == before + 5  # a table for each stage, no other


def test_mixing_stage_repeats_rows(spark, odd, none):
    import corpus_pipeline as p

    got = p.mix_sources(spark, odd, "")
    sized = odd.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    assert got.columns == odd.columns and got.count() == mixing.copies(sized).agg(F.sum("copies")).first()[0]
    assert p.mix_sources(spark, none, "").count() == 0 and p.pack(spark, none, "").count() == 0


def test_packing_stage_keeps_every_row(spark, odd):
    import corpus_pipeline as p

    assert p.pack(spark, odd, "").count() == odd.count()
