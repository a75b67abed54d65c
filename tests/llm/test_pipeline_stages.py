"""The pipeline's rows against a brute-force version of its five stages, with a fixed language model."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np

from lexiloom.llm import _common as c
from lexiloom.llm import language_id, mixing, packing
from test_llm_operators import brute_classes, brute_padding, brute_substrings, brute_targets

WORDS = {
    "en": "the of and to in that was with for it on as his had but".split(),
    "de": "der die und das nicht ein ist von mit sich auf für dem als".split(),
}


def fixture():
    draw, rows = random.Random(17), []
    vocab = {x: w + ["".join(draw.choice(w) for _ in range(2)) for _ in range(300)] for x, w in WORDS.items()}
    passage = draw.choices(vocab["en"], k=70)
    for i in range(160):
        lang = "en" if i % 3 else "de"
        w = draw.choices(vocab[lang], k=draw.choice([3, 15, 40, 90, 200, 700]))
        if i % 7 == 1 and lang == "en":
            w[len(w) // 2 : len(w) // 2] = passage
        if i % 11 == 5 and rows:  # near copies of an earlier text
            w = rows[-4][1].split(" ")
            w[len(w) // 2] = "changed"
        rows.append((i * 3 + 1, " ".join(w), lang, f"s{i % 4}" if i % 4 else None))
    rows += [(1000 + i, "".join(chr(draw.randrange(0x3041, 0x3090)) for _ in range(90)), None, "s1") for i in range(5)]
    rows += [(1100 + i, t, None, "s2") for i, t in enumerate((None, "", " \n ", "12 34 56"))]
    return [(i, t, x, s, len(t or "")) for i, t, x, s in rows]


def model():
    counts = {}
    for lang in WORDS:
        grams = Counter()
        for _, t, x, _, _ in fixture():
            if x == lang:
                b = b" " * 3 + language_id.fold(np.frombuffer(t.encode(), np.uint8)).tobytes()
                grams.update(int.from_bytes(b[i : i + 4], "big") for i in range(len(b) - 3))
        counts[lang] = grams
    m = language_id.Model(sorted(counts), counts, 3)
    m.limits = np.array([4.0, 4.0])
    return m


def by_place(rows):
    return sorted(rows, key=lambda r: (-len(c.words_of(r[1])), hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))


def brute_mix(rows):
    """Copies of each row, one source after another: expected copies are summed up in fixed point and cut at whole numbers."""
    size = [len(c.words_of(r[1])) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    target, out = brute_targets(total), []
    for s, words in total.items():
        mine, at = by_place([r for r in rows if r[3] == s]), int(hashlib.md5(f"0:{chr(0) if s is None else s}".encode()).hexdigest()[:7], 16) % mixing.SCALE
        n, before, parts = [len(c.words_of(r[1])) for r in mine], 0, []
        for k, x in enumerate(n):
            reach = sum(n[: n.index(x)])
            parts.append(sum(8 * reach >= words * e for e in mixing.STRATA))
        taken, rate, part = 0, 0, -1
        for r, x, p in zip(mine, n, parts, strict=True):
            if p != part:
                left = sum(y for y, q in zip(n, parts, strict=True) if q >= p)
                rate, part = math.floor(min(max((target[s] - taken) / left, 0.0), 3.0) * mixing.SCALE) if left else 0, p
            copies = (at + rate >> 24) - (at >> 24)
            at += rate
            taken += copies * x
            out += [r] * copies
    return out


def brute_pipeline():
    m, rows = model(), fixture()
    kept = []
    for r in rows:
        raw = (r[1] or "").encode()
        bits = m.bits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        if any(ch.isalpha() for ch in r[1] or "") and bits.min() <= 4.0 * len(raw) + language_id.SLACK:
            kept.append(r)
    stages = [kept]
    classes = brute_classes([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if dict((i, k) for i, k, _ in classes)[r[0]] == r[0]]
    stages.append(kept)
    cut = {i: (n, gone, text) for i, n, gone, text in brute_substrings([(r[0], r[1]) for r in kept])}
    kept = [(r[0], cut[r[0]][2] if cut[r[0]][1] else r[1], *r[2:4], len(cut[r[0]][2]) if cut[r[0]][1] else r[4]) for r in kept if not cut[r[0]][1] or cut[r[0]][1] < cut[r[0]][0]]
    stages.append(kept)
    kept = brute_mix(kept)
    stages.append(kept)
    return stages


def test_stages_and_rows_equal_brute_force(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p

    monkeypatch.setattr(language_id, "fit", lambda docs, **kw: model())
    docs = spark.createDataFrame(fixture(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want, docs = brute_pipeline(), spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert len(fixture()) > len(want[0]) > len(want[1]) > 100 and sum(map(len, (r[1] for r in want[1]))) > sum(map(len, (r[1] for r in want[2])))
    for (name, stage), rows in zip(p.STAGES[:4], want, strict=True):
        docs = c.written(stage(spark, docs, ""), f"brute-{name}")
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(rows, key=str), name
    got = p.run(spark, str(tmp_path)).collect()
    sizes = [len(c.words_of(r[1])) for r in want[3]]
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((r[0], n) for r, n in zip(want[3], sizes, strict=True))
    lengths, counts = np.unique(sizes, return_counts=True)
    assert sum(r["bucket_length"] - r["length"] for r in got) == brute_padding(lengths, counts, packing.BUCKETS)
    batches = defaultdict(list)
    for r in got:
        batches[r["bucket_length"], r["batch_id"]].append(r["batch_row"])
    for (bucket, batch), rows in batches.items():
        full = max(1, packing.BUDGET // max(1, bucket))
        last = batch == max(b for k, b in batches if k == bucket)
        assert sorted(rows) == list(range(len(rows))) and (len(rows) == full or last and len(rows) < full)
