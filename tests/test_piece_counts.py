"""Learning over distinct pieces that count more than once against the same over the texts."""

import random
from collections import Counter

import numpy as np
import pytest

from lexiloom.operators import grams, learner, matching, segment

TOKENS = [b"ab", b"abc", b"bca", b"cc", b"aa", b"aaa", b" a", b"abcabc", b"\xff\x00"]


def texts():
    draw = random.Random(8)
    return [bytes(draw.choices(b"abc \xff\x00", [5, 4, 3, 2, 1, 1], k=draw.choice([0, 1, 2, 5, 40, 300]))) for _ in range(60)] * 2 + [b"aaaaaaa", None]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, data binary").repartition(3).localCheckpoint()


@pytest.fixture(scope="module", params=[200_000, 5])
def pieces(frame, request):
    kept, matching.TALLY = matching.TALLY, request.param
    try:
        return matching.piece_counts(frame, matching.Dictionary([*learner.BYTES, *TOKENS])).localCheckpoint()
    finally:
        matching.TALLY = kept


def test_pieces_are_distinct_and_whole(frame, pieces):
    rows = {bytes(r["data"]): r["n"] for r in pieces.collect()}
    assert len(rows) == pieces.count() and sum(len(p) * n for p, n in rows.items()) == sum(len(t or b"") for t in texts())
    assert max(rows.values()) > 1


def test_counts_over_pieces(frame, pieces):
    vocab, d = [*learner.BYTES, *TOKENS[:5]], matching.Dictionary(TOKENS)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(matching.match_counts(frame, d), matching.match_counts(pieces, d, weight="n"))
    assert same(learner.candidate_savings(frame, vocab, TOKENS[5:]), learner.candidate_savings(pieces, vocab, TOKENS[5:], weight="n"))
    assert same(learner.removal_loss(frame, vocab, TOKENS[:5]), learner.removal_loss(pieces, vocab, TOKENS[:5], weight="n"))
    d = matching.Dictionary(vocab)
    assert same(segment.cover_totals(frame, d), segment.cover_totals(pieces, d, weight="n"))
    assert learner.total_tokens(frame, vocab) == learner.total_tokens(pieces, vocab, weight="n")


def test_learning_reads_the_texts_once(spark, frame):
    """Steps over the texts themselves give the same vocabulary; ``learn`` goes over the texts in one job."""
    found = [bytes(r["gram"]) for r in grams.top_grams(grams.gram_counts(frame, [2, 3, 4]), 6).collect()]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = frame.select("data").mapInArrow(count, "data binary")
    state = learner.learn(counted, found, 260, 6)
    assert read.value == len(texts())
    plain, best = learner.State(), None
    for step in range(6):
        room = 260 - len(plain.vocab)
        if room > 0 and learner.grow(frame, plain, found, accept=min(10, room)):
            continue
        now = learner.total_tokens(frame, plain.vocab)
        if best is not None and now >= best[0]:
            break
        best = (now, list(plain.vocab))
        if step + 2 < 6:
            learner.shrink(frame, plain, seed=step)
    assert state.history == plain.history and any(h[2] for h in state.history)
    assert learner.total_tokens(frame, state.vocab) == min(best[0], learner.total_tokens(frame, plain.vocab))


@pytest.mark.parametrize("tokens", [TOKENS, [*TOKENS, b"abcabcabc", b"aaaaaaaaaaaa"], [b"aaaaaaaaaa"], [b"a"]])
def test_tally_of_pieces(tokens):
    raw, d = [t or b"" for t in texts()], matching.Dictionary([*learner.BYTES, *tokens])
    for rows in (raw, [b""], [b"a"], [b"ab", b"c"], []):
        data, off = np.frombuffer(b"".join(rows), np.uint8), np.array([0, *np.cumsum([len(r) for r in rows])], np.int64)
        pieces, got = matching.Pieces(d, data, off), Counter()
        for piece, n in matching.piece_tally(d, data, off):
            got[piece] += n
        assert got == Counter(data[a:b].tobytes() for a, b in zip(pieces.edge[:-1].tolist(), pieces.edge[1:].tolist(), strict=True))


@pytest.mark.parametrize("limit", [1, 50, 8 << 20])
def test_grams_of_slices(frame, monkeypatch, limit):
    monkeypatch.setattr(grams, "TEXTS", limit)
    monkeypatch.setattr(grams, "PIECE", 64)
    want = Counter((n, t[i : i + n]) for t in texts() if t for n in (1, 2, 6) for i in range(len(t) - n + 1))
    assert {(r["len"], bytes(r["gram"])): r["n"] for r in grams.gram_counts(frame, [1, 2, 6]).collect()} == want
