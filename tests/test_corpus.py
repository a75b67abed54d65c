"""Grams, matches, segmentations, learning and merges against brute force."""

import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import bpb, bpe, grams, learner, matching, segment, tokenset

TEXTS = [b"banana", b"", b"aaaaa", b"ab", b"the cat \xc3\xb3 the hat", bytes(range(256)), b"x" * 3000, None]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, data binary")


def all_grams(n):
    return Counter(t[i : i + n] for t in TEXTS if t for i in range(len(t) - n + 1))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 20])
def test_gram_counts(corpus, n):
    got = {bytes(r["gram"]): r["n"] for r in grams.gram_counts(corpus, [n]).collect()}
    assert got == dict(all_grams(n))
    if n <= 3:
        assert {bytes(r["gram"]): r["n"] for r in grams.gram_counts_sql(corpus, n).collect()} == got


def test_gram_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, data binary")
    assert grams.gram_counts(empty, [1, 4]).count() == 0
    assert grams.top_grams_with_nonoverlap(empty, 4, 5).count() == 0


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(grams, "PIECE", 7)
    data = [b"abcabcabcabcabc", b"cab", b"bcabcabca"]
    off = np.array([0, *np.cumsum([len(d) for d in data])])
    v, c = grams._packed(np.frombuffer(b"".join(data), np.uint8), off, 3)
    want = Counter(d[i : i + 3] for d in data for i in range(len(d) - 2))
    assert {int(x).to_bytes(3, "big"): int(k) for x, k in zip(v, c, strict=True)} == dict(want)


def test_top_and_nonoverlap(corpus):
    top = grams.top_grams(grams.gram_counts(corpus, [2]), 3).orderBy("rank").collect()
    want = sorted(all_grams(2).items(), key=lambda x: (-x[1], x[0]))[:3]
    assert [(bytes(r["gram"]), r["n"]) for r in top] == want
    apart = {bytes(r["token"]): r["n_nonoverlap"] for r in grams.nonoverlapping_counts(corpus, [b"aa", b"xx", b"an", b"\xb3 ", b"."]).collect()}
    assert apart == {t: sum((x or b"").count(t) for x in TEXTS) for t in apart}


def test_sketch_never_underestimates(corpus):
    exact = grams.gram_counts(corpus, [2]).select("gram", "n")
    est = grams.count_min_estimates(grams.count_min(corpus, 2, width=64), exact.select("gram"), width=64)
    rows = grams.sketch_error(est, exact).collect()
    assert len(rows) == len(all_grams(2)) and all(r["est"] >= r["n"] and r["error"] >= 0 for r in rows)


@pytest.mark.parametrize("length", [3, 9])
def test_conservative_sketches_are_no_worse_and_merge(corpus, tmp_path, length):
    exact = grams.gram_counts(corpus, [length]).select("gram", "n")
    size = {"width": 97, "depth": 3}
    plain = grams.count_min(corpus, length, conservative=False, **size)
    kind = grams.count_min(corpus, length, **size)
    a, b = ({bytes(r["gram"]): r["est"] for r in grams.count_min_estimates(x, exact.select("gram"), **size).collect()} for x in (plain, kind))
    n = {bytes(r["gram"]): r["n"] for r in exact.collect()}
    assert all(n[g] <= b[g] <= a[g] for g in n) and set(a) == set(n)
    grams.save_sketch(kind, str(tmp_path / "s"), length=length, **size)
    back, about = grams.load_sketch(corpus.sparkSession, str(tmp_path / "s"))
    twice = {bytes(r["gram"]): r["est"] for r in grams.count_min_estimates(grams.merge_sketches(back, kind), exact.select("gram"), **size).collect()}
    assert about == {"length": length, **size} and twice == {g: 2 * v for g, v in b.items()}


@pytest.mark.parametrize("length", [2, 10])
def test_survivors_of_two_passes(corpus, monkeypatch, length):
    got = {bytes(r["gram"]): r["n"] for r in grams.survivors(corpus, length, 2, width=50, depth=3).collect()}
    assert got == {g: n for g, n in all_grams(length).items() if n >= 2}
    monkeypatch.setattr(grams, "MOST_SKETCH", 10)
    with pytest.raises(ValueError):
        grams.survivors(corpus, length, 2)


def test_many_ranks_equal_few(corpus, monkeypatch):
    counts = grams.gram_counts(corpus, [1, 2, 5])
    few = sorted(map(tuple, grams.top_grams(counts, 7).collect()))
    monkeypatch.setattr(grams, "FEW", 3)
    assert sorted(map(tuple, grams.top_grams(counts, 7).collect())) == few


TOKENS = [b"an", b"nan", b"ban", b"a", b"aa", b"the", b" ", b"\xc3", b"xx", b"zzz"]


def brute(text):
    return sorted((i, i + len(t), k) for k, t in enumerate(TOKENS) for i in range(len(text) - len(t) + 1) if text[i : i + len(t)] == t)


def test_matches(corpus):
    d = matching.Dictionary(TOKENS)
    got = matching.matches(corpus, d).collect()
    want = sorted((i, *m) for i, t in enumerate(TEXTS) for m in brute(t or b""))
    assert sorted(tuple(r) for r in got) == want
    table = corpus.sparkSession.createDataFrame(list(enumerate(TOKENS)), "token_id int, token binary")
    by_join = matching.matches_by_join(corpus, table, [1, 2, 3])
    assert sorted(tuple(r) for r in by_join.collect()) == want


def test_match_counts(corpus):
    rows = {bytes(r["token"]): (r["n_total"], r["n_nonoverlap"], r["est_savings"]) for r in matching.match_counts(corpus, matching.Dictionary(TOKENS)).collect()}
    for t in TOKENS:
        apart = sum((x or b"").count(t) for x in TEXTS)
        assert rows[t] == (all_grams(len(t))[t], apart, apart * (len(t) - 1))


def test_past_the_end():
    d = matching.Dictionary([b"dog", b"do", b"og"])
    assert d.past_end(b"ado") == [(1, 4, 0), (2, 4, 2)]
    assert d.past_end(b"") == []


def test_fewest_tokens(corpus):
    d = matching.Dictionary([b"an", b"nan", b"ban", b"a", b"b", b"n"])
    rows = {r["doc_id"]: r for r in segment.covers(corpus, d).collect()}
    assert rows[0]["n_tokens"] == 3 and rows[1]["n_tokens"] == 0 and rows[3]["n_tokens"] == 2 and rows[4]["n_tokens"] is None and rows[7]["n_tokens"] == 0
    cover = segment.Cover(d)
    x = np.frombuffer(b"banana", np.uint8)
    assert cover.costs(6, cover.edges(x)) == [0, 1, 2, 1, 2, 2, 3]


def test_pre_segments_cover_the_text(spark):
    texts = ["Hello world's  end\n ", "", "été 12  34!?\t", "  ", "I'll  x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", segment.pre_segments(F.col("t")).alias("s"), segment.pre_segments(F.col("t"), segment.PLAIN_SEGMENT).alias("p"))
    for r in df.collect():
        assert "".join(r["s"]) == r["t"] == "".join(r["p"])
    assert df.collect()[0]["s"] == ["Hello", " world", "'s", " ", " end", "\n "]


def test_canonical_encoding_of_any_bytes(spark):
    data = [(1, bytes(range(256))), (2, b"\xe2\x82 the the"), (3, b"")]
    df = spark.createDataFrame(data, "doc_id long, data binary")
    tokens = [*learner.BYTES, b"th", b"the", b" the"]
    x = segment.encode_texts(df, tokens)
    vocab = spark.createDataFrame(list(enumerate(tokens)), "token_id int, token binary")
    back = {r["doc_id"]: bytes(r["data"]) for r in segment.decode_tokens(x, vocab).collect()}
    assert back == {1: data[0][1], 2: data[1][1]}
    unknown = segment.decode_tokens(spark.createDataFrame([(1, [65, 99999])], "doc_id long, token_ids array<int>"), vocab)
    assert bytes(unknown.first()["data"]) == b"A?"


def test_longest_suffix():
    assert segment.longest_suffix(b"abcab", {b"ab", b"cab", b"bc"}) == [b"ab", b"cab"]


def test_learner(spark):
    draw = random.Random(3)
    words = [b"banana", b"bandana", b"canal", b"analog"]
    df = spark.createDataFrame([(i, b" ".join(draw.choices(words, k=6))) for i in range(20)], "doc_id long, data binary")
    asked = [b"an", b"ana", b"ban", b"zz"]
    base = learner.total_tokens(df, learner.BYTES)
    for r in learner.candidate_savings(df, learner.BYTES, asked).collect():
        assert r["savings"] == base - learner.total_tokens(df, [*learner.BYTES, bytes(r["token"])]) >= 0
    vocab = [*learner.BYTES, *asked]
    whole = learner.total_tokens(df, vocab)
    for r in learner.removal_loss(df, vocab, asked).collect():
        assert r["loss"] == learner.total_tokens(df, [t for t in vocab if t != bytes(r["token"])]) - whole
    counts = grams.top_grams(grams.gram_counts(df, [2, 3, 4, 5]), 10).collect()
    state = learner.learn(df, [bytes(r["gram"]) for r in counts], 262, 6)
    assert len(state.vocab) <= 262 and learner.total_tokens(df, state.vocab) < base and state.history
    again = learner.learn(df, [bytes(r["gram"]) for r in counts], 262, 6)
    assert again.vocab == state.vocab


def test_independence():
    assert tokenset.independent([b"ab", b"xy", b"bc", b"zz"], 10) == [b"ab", b"xy"]
    assert tokenset.independent([b"ab", b"xy", b"zz"], 2) == [b"ab", b"xy"]


def test_merges(spark):
    words = Counter({"banana": 3, "bandana": 2, "aaaa": 5, "b": 9})
    df = spark.createDataFrame(list(words.items()), "content string, frequency long")
    seg, want = {w: list(w) for w in words}, []
    for _ in range(5):
        pairs = Counter()
        for w, s in seg.items():
            for p in zip(s, s[1:]):
                pairs[p] += words[w]
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        want.append(a + b)
        for w, s in seg.items():
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == (a, b):
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seg[w] = out
    got, table = bpe.train(df, 5, cut_every=2)
    assert got == want and {r["string_id"]: r["seg"] for r in table.collect()} == seg
    war = {r["token"]: r["war"] for r in bpe.worth(table, got).collect()}
    assert all(x >= 0 for x in war.values())
    kept, _ = bpe.prune(df, 5, 3)
    assert len(kept) == 3 and set(kept) <= set(want)
    assert bpe.train(spark.createDataFrame([("a", 1)], "content string, frequency long"), 3)[0] == []


def test_all_paths_against_decimals(spark):
    tokens, p = [b"a", b"b", b"ab", b"bc", b"abab"], [0.3, 0.25, 0.2, 0.15, 0.1]

    def brute(text):
        at = [Decimal(1)] + [Decimal(0)] * (len(text) + 4)
        for i in range(len(text)):
            for t, x in zip(tokens, p, strict=True):
                if (text[i:] + b"?" * 9)[: len(t)] == t or (len(text) - i < len(t) and t.startswith(text[i:])):
                    at[i + len(t)] += at[i] * Decimal(x)
        return sum(at[len(text) :])

    texts = [b"ab", b"abab", b"ababab" * 200, b"c", b""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, data binary")
    for r in bpb.all_paths_bpb(df, tokens, p).collect():
        want = brute(texts[r["doc_id"]])
        if want == 0:
            assert r["log2_p"] is None
        else:
            assert r["log2_p"] == pytest.approx(float(want.ln() / Decimal(2).ln()), rel=1e-9, abs=1e-12)
    rows = [(i, s, k, p[k]) for i, t in enumerate(texts) for s in range(len(t)) for k in range(len(tokens))]
    table = spark.createDataFrame(rows, "doc_id long, start int, token_id int, p double")
    same = {r["doc_id"]: r["log2_p"] for r in bpb.all_paths_table(df, tokens, table).collect()}
    for r in bpb.all_paths_bpb(df, tokens, p).collect():
        assert same[r["doc_id"]] == (pytest.approx(r["log2_p"]) if r["log2_p"] is not None else None)


def test_prefix_positions(spark):
    df = spark.createDataFrame([(1, b"abc")], "doc_id long, data binary")
    rows = sorted(tuple(r)[1:] for r in bpb.prefix_tokens(df, [b"a", b"b", b"c", b"ab", b"bc"]).collect())
    assert rows == [(0, 1, 1, 1), (2, 3, 3, 3), (3, 1, 2, 2)]
    anc = bpb.prefix_ancestry(bpb.prefix_tokens(df, [b"a", b"b", b"c", b"ab", b"bc"])).collect()
    assert sorted((r["token_id"], r["anc_id"]) for r in anc) == [(2, 0), (2, 3)]


def test_ignored_labels(spark):
    r = bpb.mean_loss(spark.createDataFrame([(0.5, 1), (0.25, 2), (0.9, -100)], "p double, label int")).first()
    assert r["n"] == 2 and r["mean_loss"] == pytest.approx((np.log(2) + np.log(4)) / 2) and r["perplexity"] == pytest.approx(8**0.5)


def test_sql_names(spark):
    from lexiloom.functions.register import register

    register(spark, matching.Dictionary([b"an", b"nax"]))
    rows = spark.sql("SELECT * FROM token_matches(encode('banan', 'utf-8'), true)").collect()
    assert sorted(map(tuple, rows)) == [(1, 3, 0), (3, 5, 0), (4, 7, 1)]
    assert bytes(spark.sql("SELECT unescape_bytes(escape_bytes(x'41FF'))").first()[0]) == b"A\xff"
    assert spark.sql("SELECT byte_letters(x'2041')").first()[0] == "\u0120A"


def test_metadata_and_samples(spark):
    m = spark.createDataFrame([(1, 5), (1, 5)], "file_count int, hash_seed long")
    assert tokenset.consistent(m).first()[0] and not tokenset.consistent(m.union(spark.createDataFrame([(2, 5)], m.schema))).first()[0]
    t = spark.createDataFrame([(1, b"b"), (1, b"a"), (2, b"xy")], "len int, token binary")
    assert sorted((r["len"], bytes(r["token"])) for r in tokenset.samples(t).collect()) == [(1, b"a"), (2, b"xy")]
