"""Lattices handled text by text, without joins: against plain versions and the forms over lattice rows."""

import random

import pytest

from lexiloom.operators import lattice, matching

TOKENS = [b"a", b"b", b"ab", b"abc", b"bca", b"cc", b"abcabc", b" a", b"ab", b"\xff\x00"]


def texts():
    draw = random.Random(5)
    return [bytes(draw.choices(b"abc \xff\x00", [5, 5, 4, 2, 1, 1], k=draw.choice([0, 1, 2, 5, 40, 90]))) for _ in range(40)]


def places(x):
    return [(s, s + len(t), k) for k, t in enumerate(TOKENS) for s in range(len(x) - len(t) + 1) if x[s : s + len(t)] == t]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([*enumerate(texts()), (99, None)], "doc_id long, data binary").repartition(3).localCheckpoint()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return [x for x in ("Join", "Exchange", "Window") if x in plan(df)]


@pytest.mark.parametrize("batch", [1 << 18, 7])
def test_ancestry_of_texts(frame, monkeypatch, batch):
    monkeypatch.setattr(lattice, "BATCH", batch)
    d = matching.Dictionary(TOKENS)
    got = lattice.text_ancestry(frame, d)
    want = [(i, k, s + 1, k2, s2 + 1) for i, x in enumerate(texts()) for s, e, k in places(x) for s2, e2, k2 in places(x) if e2 <= s or (s2, k2) == (s, k)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    rows = lattice.ancestry(lattice.lattice(frame, d))
    assert rows.schema == got.schema and sorted(map(tuple, rows.collect())) == sorted(want)


def test_ancestry_sends_no_lattice_to_the_driver(frame):
    d = matching.Dictionary(TOKENS)
    assert not shuffles(lattice.text_ancestry(frame, d))
    assert "Broadcast" not in plan(lattice.ancestry(lattice.lattice(frame, d)))


def test_token_ancestry_has_no_join(spark, small):
    from lexiloom.plans import catalogue

    assert "Join" not in plan(catalogue.QUERIES["token_ancestry"](spark, small))


def joined_encoding(corpus, dictionary, params, most):
    """The encoding by joins and windows over lattice rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows, at = lattice.lattice(corpus, dictionary), ["doc_id", "token_id", "start1"]
    means = lattice.byte_means(lattice.non_dominated(rows), params)
    x = rows.join(lattice.ancestor_counts(rows).withColumnRenamed("position", "n_ancestors"), at).join(lattice.cumulative(rows, means), at)
    return x.withColumn("slot", F.row_number().over(Window.partitionBy("doc_id").orderBy("start1", "end1", "token_id"))).filter(F.col("slot") <= most)


@pytest.mark.parametrize("most", [1, 16, 1000])
def test_encoding_of_texts(spark, frame, monkeypatch, most):
    monkeypatch.setattr(lattice, "BATCH", 7)
    d = matching.Dictionary(TOKENS)
    # a token without a parameter, one with none but null, one with two, and one that is no token
    params = spark.createDataFrame([(0, 0.1), (1, None), (3, 0.7), (4, 1.3), (4, -0.4), (5, 0.2), (6, 0.9), (7, 2.0), (8, 5.0), (9, 0.3), (77, 9.0)], "token_id int, param double")
    got, want = lattice.encoding(frame, d, params, most), joined_encoding(frame, d, params, most)
    same = lambda df: sorted((r["doc_id"], r["slot"], r["token_id"], r["start1"], r["end1"], r["n_ancestors"], round(r["position"], 9)) for r in df.collect())
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert same(got) == same(want) and not shuffles(got)


def test_invariant_encoding_shuffles_nothing(spark, tmp_path):
    from lexiloom.plans import catalogue

    # files of as many parts as cores, so that the table itself is not dealt anew
    spark.range(8).selectExpr("id AS doc_id", "'the nan thé' AS text").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert not shuffles(catalogue.QUERIES["invariant_encoding"](spark, str(tmp_path)))
