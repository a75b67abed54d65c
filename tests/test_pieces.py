"""Matches of many rows at once, and covers and path sums piece by piece, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lexiloom.operators import bpb, learner, matching, segment

TOKENS = [b"a", b"b", b"c", b"ab", b"abc", b"bca", b"cc", b"abcabc", b" ", b" a", b"ab", b"\xff\x00", b"bb b"]


def texts(seed):
    draw = random.Random(seed)
    return [bytes(draw.choices(b"abc \xff\x00", [5, 5, 4, 2, 1, 1], k=draw.choice([0, 1, 2, 5, 40, 300]))) for _ in range(60)]


def plain(data, tokens):
    return sorted(((i, i + len(t), k) for k, t in enumerate(tokens) for i in range(len(data) - len(t) + 1) if t and data[i : i + len(t)] == t), key=lambda m: (m[1], m[0], m[2]))


def rows(raw):
    return np.frombuffer(b"".join(raw), np.uint8), np.array([0, *np.cumsum([len(r) for r in raw])])


@pytest.mark.parametrize("piece", [1 << 20, 64, 7])
def test_matches_of_rows(monkeypatch, piece):
    monkeypatch.setattr(matching, "PIECE", piece)
    monkeypatch.setattr(matching, "row_slices", lambda off, limit=piece, f=matching.row_slices: f(off, limit))
    raw, d = texts(1), matching.Dictionary(TOKENS)
    data, off = rows(raw)
    got = list(zip(*(x.tolist() for x in d.find_rows(data, off)), strict=True))
    assert got == [(s + o, e + o, t) for r, o in zip(raw, off.tolist(), strict=False) for s, e, t in plain(r, TOKENS)]
    for r in raw:
        assert sorted(d.past_end(r)) == sorted((len(r) - n, len(r) - n + len(t), k) for k, t in enumerate(TOKENS) for n in range(1, len(t)) if n <= len(r) and r.endswith(t[:n]))


def test_greedy_counts():
    raw = [b"aaaaaa", b"abababa", b"", b"aa", b"aaa" * 9]
    tokens = [b"aa", b"aba", b"aaa", b"b"]
    data, off = rows(raw)
    d = matching.Dictionary(tokens)
    assert matching.greedy(*d.find_rows(data, off), len(tokens)).tolist() == [sum(r.count(t) for r in raw) for t in tokens]


def test_covers_of_pieces():
    raw, d = texts(2), matching.Dictionary(TOKENS)
    data, off = rows(raw)
    cover = segment.Cover(d)
    n, tokens, which, at, pieces = cover.rows(data, off)
    for r, x in enumerate(raw):
        edges = cover.edges(np.frombuffer(x, np.uint8))
        want = cover.path(len(x), edges)
        ids = [t for k in which[pieces.row[r] : pieces.row[r + 1]] for t in tokens[at[k] : at[k + 1]].tolist()]
        if want or not x:
            assert ids == want and n[r] == len(want)
        else:
            assert n[r] == -1 and math.isinf(cover.costs(len(x), edges)[len(x)])


def test_cover_totals_equal_the_covers(spark):
    df = spark.createDataFrame(list(enumerate(texts(3))) + [(99, None)], "doc_id long, data binary")
    d = matching.Dictionary(TOKENS)
    each = segment.covers(df, d).collect()
    want = Counter(t for r in each for t in r["token_ids"])
    assert {r["token_id"]: r["n_uses"] for r in segment.cover_totals(df, d).collect()} == dict(want) and any(r["n_tokens"] is None for r in each)


@pytest.mark.parametrize("past", [True, False])
def test_path_sums_of_pieces(spark, past):
    p = [0.1 + 0.05 * i for i in range(len(TOKENS))]
    raw = texts(4)
    df = spark.createDataFrame(list(enumerate(raw)), "doc_id long, data binary")
    d, logs = matching.Dictionary(TOKENS), np.log2(p).tolist()
    for r in bpb.all_paths_bpb(df, TOKENS, p, past_end=past).collect():
        x = raw[r["doc_id"]]
        want = bpb.all_paths(x, [v.tolist() for v in d.find(np.frombuffer(x, np.uint8))], lambda t, s: logs[t], d.past_end(x) if past else ())
        assert (r["log2_p"] is None and want == -math.inf) or r["log2_p"] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_changes_by_piece_equal_whole_texts(spark):
    raw = [r for r in texts(5) if set(r) <= set(b"abc ")]
    vocab, asked = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"cc"], [b"bca", b"cab", b" a", b"ab"]
    df = spark.createDataFrame(list(enumerate(raw)), "doc_id long, data binary")

    def total(tokens):
        c = segment.Cover(matching.Dictionary(tokens))
        return sum(c.costs(len(r), c.edges(np.frombuffer(r, np.uint8)))[len(r)] for r in raw)

    got = {bytes(r["token"]): r["savings"] for r in learner.candidate_savings(df, vocab, asked).collect()}
    assert got == {t: total(vocab) - total([*vocab, t]) for t in asked}
    got = {bytes(r["token"]): r["loss"] for r in learner.removal_loss(df, vocab, [b"ab", b"abc", b"cc"]).collect()}
    assert got == {t: total([v for v in vocab if v != t]) - total(vocab) for t in got}
    assert learner.total_tokens(df, vocab) == total(vocab)


def test_counts_by_join_equal_those_of_a_dictionary(spark, monkeypatch):
    raw = [*texts(6), b"aaaa", None]
    df = spark.createDataFrame(list(enumerate(raw)), "doc_id long, data binary")
    tokens = [t for i, t in enumerate(TOKENS) if t not in TOKENS[:i]]
    table = spark.createDataFrame(list(enumerate(tokens)), "token_id int, token binary")
    want = sorted(map(tuple, matching.match_counts(df, matching.Dictionary(tokens)).select("token_id", "n_total", "n_nonoverlap", "est_savings").collect()))
    assert sorted(map(tuple, matching.counts_of(df, table).select("token_id", "n_total", "n_nonoverlap", "est_savings").collect())) == want
    monkeypatch.setattr(matching.Dictionary, "MOST", 5)
    assert sorted(map(tuple, matching.counts_of(df, table).select("token_id", "n_total", "n_nonoverlap", "est_savings").collect())) == want


def test_conflicts_check_the_size_of_what_is_sent(spark, monkeypatch):
    from lexiloom.operators import tokenset

    tokens = spark.createDataFrame([(b"ring",), (b"ingot",), (b"x",)], "token binary")
    got = {bytes(r["token"]): r["conflict"] for r in tokenset.conflicts(tokens, tokens.filter("token = cast('ring' AS binary)")).collect()}
    assert got == {b"ring": True, b"ingot": True, b"x": False}
    monkeypatch.setattr(tokenset, "MOST_ACCEPTED", 2)
    with pytest.raises(ValueError):
        tokenset.conflicts(tokens, tokens)
