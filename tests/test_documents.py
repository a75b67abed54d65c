"""The queries over the documents that have no SQL against brute force, and that the documents reach each of them."""

from collections import Counter

import pytest

from lexiloom.operators import learner, segment
from lexiloom.plans import catalogue

TEXTS = ["the nan thé", "", "banana and the ring", "enen", "été on the\n  canal"]
COMMON = [t.encode() for t in catalogue.COMMON]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def fewest(text: bytes, tokens) -> int:
    best = [0]
    for e in range(1, len(text) + 1):
        best.append(min(best[e - len(t)] + 1 for t in tokens if len(t) <= e and text[e - len(t) : e] == t))
    return best[-1]


def total(tokens) -> int:
    return sum(fewest(t.encode(), tokens) for t in TEXTS)


def places(i):
    b = TEXTS[i].encode()
    return [(s, s + len(t), k) for k, t in enumerate(COMMON) for s in range(len(b) - len(t) + 1) if b[s : s + len(t)] == t]


def rows(spark, folder, name):
    return catalogue.QUERIES[name](spark, folder).collect()


def test_costs_and_totals(spark, folder):
    spelling = [*learner.BYTES, *COMMON]
    costs = {r["doc_id"]: r["n_tokens"] for r in rows(spark, folder, "optimal_segmentation_cost_documents")}
    assert costs == {i: fewest(t.encode(), spelling) for i, t in enumerate(TEXTS)}
    assert [tuple(r) for r in rows(spark, folder, "corpus_token_total_documents")] == [(len(TEXTS), total(spelling))]


def test_savings_and_losses(spark, folder):
    spelling, texts = [*learner.BYTES, *COMMON], [t.encode() for t in TEXTS]
    times = lambda t: sum(x[i : i + len(t)] == t for x in texts for i in range(len(x)))
    for r in rows(spark, folder, "candidate_savings_documents"):
        t = bytes.fromhex(r["token"])
        assert (r["n_occurrences"], r["savings"]) == (times(t), total(learner.BYTES) - total([*learner.BYTES, t]))
    for r in rows(spark, folder, "removal_loss_documents"):
        t = bytes.fromhex(r["token"])
        assert (r["n_occurrences"], r["loss"]) == (times(t), total([x for x in spelling if x != t]) - total(spelling))


def test_paths(spark, folder):
    spelling = [*learner.BYTES, *COMMON]
    p = 1 / len(spelling)
    import math

    for r in rows(spark, folder, "all_paths_bpb_documents"):
        b = TEXTS[r["doc_id"]].encode()
        at = [1.0]
        for e in range(1, len(b) + 1):
            at.append(sum(at[e - len(t)] * p for t in spelling if len(t) <= e and b[e - len(t) : e] == t))
        past = sum(at[len(b) - k] * p for t in spelling for k in range(1, len(t)) if k <= len(b) and b[len(b) - k :] == t[:k])
        assert r["n_bytes"] == len(b) and (not b or r["bpb"] == pytest.approx(-math.log2(at[-1] + past) / len(b), abs=1e-7))


def test_matches(spark, folder):
    want = sorted((i, *m) for i in range(len(TEXTS)) for m in places(i))
    assert sorted(tuple(r) for r in rows(spark, folder, "dictionary_matches_documents")) == want
    past = [(i, len(b) - k, len(b) - k + len(t), n) for i, b in enumerate(x.encode() for x in TEXTS) for n, t in enumerate(COMMON) for k in range(1, len(t)) if k <= len(b) and b[len(b) - k :] == t[:k]]
    assert past and sorted(tuple(r) for r in rows(spark, folder, "dictionary_matches_past_end_documents")) == sorted(want + past)
    first = {(i, k): min(e for i2, _, e, k2 in want if (i2, k2) == (i, k)) for i, _, _, k in want}
    assert {(r["doc_id"], r["token_id"]): r["first_end"] for r in rows(spark, folder, "first_match_position_documents")} == first
    lattice = sorted((r["doc_id"], r["start1"] - 1, r["end1"], r["token_id"]) for r in rows(spark, folder, "token_lattice_documents"))
    assert lattice == want


def test_lattice(spark, folder):
    rank, free, mean, position = set(), set(), {}, set()
    for i in range(len(TEXTS)):
        m = places(i)
        rank |= {(i, k, s + 1, sum(e2 <= s for _, e2, _ in m)) for s, _, k in m}
        own = [(s, e, k) for s, e, k in m if not any(s2 <= s and e <= e2 and k2 != k for s2, e2, k2 in m)]
        free |= {(i, s + 1, e, k) for s, e, k in own}
        for at in range(1, len(TEXTS[i].encode()) + 1):
            if over := [(k + 1) / 10 for s, e, k in own if s < at <= e]:
                mean[i, at] = sum(over) / len(over)
        position |= {(i, k, s + 1, round(sum(v for (j, at), v in mean.items() if j == i and at <= e), 6)) for s, e, k in m}
    assert {tuple(r) for r in rows(spark, folder, "ancestor_counts_documents")} == rank
    assert {(r["doc_id"], r["start1"], r["end1"], r["token_id"]) for r in rows(spark, folder, "non_dominated_tokens_documents")} == free
    assert {(r["doc_id"], r["byte"]): r["mean"] for r in rows(spark, folder, "byte_coverage_mean_documents")} == pytest.approx(mean)
    assert {(r["doc_id"], r["token_id"], r["start1"], round(r["position"], 6)) for r in rows(spark, folder, "cumulative_position_documents")} == position
    got = {(r["doc_id"], r["slot"], r["token_id"], r["start1"], r["n_ancestors"]) for r in rows(spark, folder, "invariant_encoding")}
    want = {(i, n + 1, k, s + 1, sum(e2 <= s for _, e2, _ in places(i))) for i in range(len(TEXTS)) for n, (s, e, k) in enumerate(sorted(places(i))[:16])}
    assert got == want


def test_encodings(spark, folder):
    got = {r["doc_id"]: r for r in rows(spark, folder, "canonical_encoding")}
    assert set(got) == set(range(len(TEXTS))) and all(r["same"] for r in got.values()) and got[1]["n_tokens"] == 0
    for r in rows(spark, folder, "greedy_longest_suffix"):
        assert [bytes.fromhex(t) for t in r["tokens"]] == segment.longest_suffix(TEXTS[r["doc_id"]].encode(), set(COMMON))


def test_learners_see_the_documents(spark, folder):
    texts = [t.encode() for t in TEXTS]
    grams = Counter(x[i : i + n] for x in texts for n in (2, 3, 4, 5, 6) for i in range(len(x) - n + 1))
    added = [(r["added"].encode("latin-1"), r["savings"]) for r in rows(spark, folder, "vocab_learn_step")]
    best = max(total(learner.BYTES) - total([*learner.BYTES, g]) for g in grams)
    assert added and added[0][1] == best and all(s == total(learner.BYTES) - total([*learner.BYTES, t]) for t, s in added)
    vocab = [bytes.fromhex(r["token"]) for r in sorted(rows(spark, folder, "vocab_learn"))]
    assert all(t in grams for t in vocab[256:]) and total(vocab) < total(learner.BYTES)
    words = Counter(w for t in TEXTS for w in segment_of(spark, t))
    pairs = Counter()
    for w, n in words.items():
        x = w.encode().decode("latin-1")
        for p in zip(x, x[1:]):
            pairs[p] += n
    first = min(pairs, key=lambda p: (-pairs[p], p))
    merged = [r["token"] for r in sorted(rows(spark, folder, "bpe_train"))]
    assert merged[0] == first[0] + first[1]
    assert {r["token"] for r in rows(spark, folder, "bpe_war")} == set(merged)


def segment_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(segment.pre_segments("t")).first()[0]
