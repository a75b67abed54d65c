"""Batches, shards, formats, records and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import batches, lattice, records, tokenset
from lexiloom.operators.matching import Dictionary
from lexiloom.sources import shards, tokensets
from lexiloom.streaming import counts


def test_shard_bytes():
    t = np.array([50256, 1, 65535])
    raw = shards.pack(t)
    assert len(raw) == 1024 + 6 and list(shards.unpack(raw)) == [50256, 1, 65535]
    assert list(shards.unpack(raw[:-2], strict=False)) == [50256, 1]
    for bad in (raw[:-2], raw + b"\0", b"x" * 1030, b""):
        with pytest.raises(ValueError):
            shards.unpack(bad)
    with pytest.raises(ValueError):
        shards.pack(np.array([65536]))


def test_shard_files(spark, tmp_path):
    pieces = spark.createDataFrame([(0, "val", 2, [7, 8]), (0, "val", 0, [5, 6]), (1, "train", 0, [9])], "shard int, split string, at long, token_ids array<int>")
    files = shards.write_shards(pieces, str(tmp_path)).orderBy("shard").collect()
    assert [r["n_tokens"] for r in files] == [4, 1] and files[0]["file"].endswith("tokens_val_000000.bin")
    found = shards.files(spark, str(tmp_path))
    assert [tuple(r) for r in shards.peek(found).orderBy("n_tokens").collect()] == [("tokens_train_000001.bin", 20240520, 1, 1), ("tokens_val_000000.bin", 20240520, 1, 4)]
    rows = shards.tokens(found).filter("shard like '%val%'").orderBy("pos").collect()
    assert [r["token_id"] for r in rows] == [5, 6, 7, 8]
    spark.dataSource.register(shards.ShardSource)
    assert spark.read.format("tokenshard").option("path", str(tmp_path)).load().count() == 5
    assert shards.files(spark, str(tmp_path), first=1).count() == 1


def test_token_formats():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    assert tokensets.unpack_legacy(tokensets.pack_legacy(tokens), need_bytes=True) == tokens
    assert tokensets.unpack_legacy(tokensets.pack_legacy(tokens), most=2) == tokens[:-1]
    rows = [(b"a", 3), (b"ab", 2**40)]
    got, meta = tokensets.unpack_counted(tokensets.pack_counted(rows, 5, 7, [1, 2]))
    assert got == rows and meta == {"file_count": 2, "timestamp_ms": 5, "hash_seed": 7, "file_hashes": [1, 2]}
    raw = tokensets.pack_vocabulary([b"a", b"bc"])
    assert tokensets.unpack_vocabulary(raw) == ([b"a", b"bc"], [])
    assert len(tokensets.unpack_vocabulary(b"XXXX" + raw[4:] + b"!")[1]) == 2
    with pytest.raises(ValueError):
        tokensets.unpack_vocabulary(raw[:28] + struct.pack("<I", 4) + raw[32:])
    with pytest.raises(ValueError):
        tokensets.unpack_legacy(tokensets.pack_legacy([b"ab"])[:-1])
    stats = tokensets.pack_stats([(0, 1, 2, 3.5)], [9, 4])
    assert tokensets.unpack_stats(stats, 1, [4, 9]) == [(0, 1, 2, 3.5)]
    assert tokensets.unpack_stats(stats, 2) is None and tokensets.unpack_stats(stats, 1, [4]) is None


def test_text_sources(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"a": 0, "\\u0120the": 1, "\\u010a": 2}')
    got = {r["token_id"]: bytes(r["token"]) for r in tokensets.vocabulary_json(spark, str(tmp_path / "v.json")).collect()}
    assert got == {0: b"a", 1: b" the", 2: b"\n"}
    lines = spark.createDataFrame([(x,) for x in ("3,cat,5", "  ", "12, philosopher ,2", "x,y,z", "1,a,b,3", "4,dog", "5,e,f")], "value string")
    good, bad = tokensets.weighted_lines(lines)
    assert sorted(map(tuple, good.collect())) == [(3, "cat", 5), (12, "philosopher", 2)] and bad.count() == 4
    import zstandard

    files = spark.createDataFrame([("t.bin.zst", zstandard.compress(b"abc")), ("u.bin", b"x")], "name string, content binary")
    assert sorted((r["name"], bytes(r["content"])) for r in tokensets.unzstd(files).collect()) == [("t.bin", b"abc"), ("u.bin", b"x")]
    order = tokenset.file_order(spark.createDataFrame([("set_10.bin",), ("set_9.bin",)], "name string")).collect()
    assert [r["name"] for r in order] == ["set_9.bin", "set_10.bin"]
    known, strange = tokensets.align(spark.createDataFrame([(b"a",), (b"z",)], "token binary"), spark.createDataFrame([(7, b"a")], "token_id int, token binary"))
    assert known.first()["token_id"] == 7 and strange.count() == 1


def test_documents_between_separators(spark):
    ids = [50256, 50256, 1, 2, 50256, 3, 50256]
    s = spark.createDataFrame([("s", i, t, 2) for i, t in enumerate(ids)], "shard string, pos long, token_id int, n_bytes int")
    assert [(r["n_tokens"], r["token_ids"]) for r in batches.documents(s).orderBy("doc").collect()] == [(2, [1, 2]), (1, [3])]
    assert [r["end_offset"] for r in batches.end_offsets(s).orderBy("pos").collect()] == [0, 0, 2, 4, 0, 6, 0]
    assert [r["label"] for r in batches.next_tokens(s).orderBy("pos").collect()] == [50256, 1, 2, 50256, 3, 50256, -100]


def test_offsets_and_pieces(spark):
    d = spark.createDataFrame([(i * 7, 1 + i % 5) for i in range(500)], "doc_id long, n_tokens long")
    x = batches.global_offsets(d, "doc_id", "n_tokens", rows_at_once=40)
    total, want = 0, {}
    for i in range(500):
        want[i * 7] = total
        total += 1 + i % 5
    assert {r["doc_id"]: r["offset"] for r in x.collect()} == want
    p = batches.shard_pieces(x, 100).groupBy("shard").agg(F.sum(F.col("to") - F.col("from")).alias("n")).orderBy("shard").collect()
    assert [r["n"] for r in p] == [100] * (total // 100) + ([total % 100] if total % 100 else [])
    assert batches.global_offsets(d.limit(0), "doc_id", "n_tokens").count() == 0


def test_mask_against_tokens(spark):
    rng = np.random.default_rng(0)
    ids = np.where(rng.random(64) < 0.15, 50256, 1)
    s = spark.createDataFrame([("s", i, int(t)) for i, t in enumerate(ids)], "shard string, pos long, token_id int")
    doc = np.cumsum(ids == 50256)
    got = {(r["q"], r["k"]): r["full"] for r in batches.block_mask(batches.blocks(batches.document_ids(s), 8)).collect()}
    for q in range(8):
        for k in range(8):
            see = [(i >= j) and doc[i] == doc[j] for i in range(q * 8, q * 8 + 8) for j in range(k * 8, k * 8 + 8)]
            if (q, k) in got:
                assert q >= k and (not got[q, k] or all(see))
            else:
                assert not any(see)


def test_schedules(spark):
    x = spark.createDataFrame([(0,), (129,)], "x int").select(batches.next_multiple(F.col("x"), 128))
    assert [r[0] for r in x.collect()] == [128, 256]
    warm = spark.range(10).select(batches.warm_learning_rate(F.col("id"), 10, 2, 4))
    assert [r[0] for r in warm.collect()] == [0.5, 1, 1, 1, 1, 1, 1, 0.75, 0.5, 0.25]


def test_cursor(spark):
    o = spark.range(5).withColumnRenamed("id", "k")
    rows = batches.cursor_sample(o, "k", 3, 12, 5).collect()
    assert sorted((r["turn"], (r["k"] - 3) % 5) for r in rows) == [(0, i) for i in range(5)] + [(1, i) for i in range(5)] + [(2, 0), (2, 1)]
    assert batches.dummy_tokens(spark, 10, 1).collect() == batches.dummy_tokens(spark, 10, 1).collect()


def test_lattice_orders(spark):
    df = spark.createDataFrame([(1, b"abab"), (2, b"")], "doc_id long, data binary")
    rows = lattice.lattice(df, Dictionary([b"a", b"b", b"ab"]))
    free = lattice.non_dominated(rows).collect()
    assert sorted((r["start1"], r["end1"]) for r in free) == [(1, 2), (3, 4)]
    pairs = lattice.ancestry(rows).filter("token_id <> anc_id or start1 <> anc_start").groupBy("token_id", "start1").count()
    want = {(r["token_id"], r["start1"]): r["position"] for r in lattice.ancestor_counts(rows).collect() if r["position"]}
    assert {(r["token_id"], r["start1"]): r["count"] for r in pairs.collect()} == want


def test_significance(spark):
    r = records.significance(records.run_table(spark)).first()
    assert r["n"] == 80 and round(r["mean"], 4) == 3.2791 and round(r["std"], 4) == 0.0019
    assert f"{records.p_below(r['t'], r['df']):.4f}" == "0.0001"
    assert records.p_below(0, 5) == pytest.approx(0.5) and records.p_below(2.015, 5) == pytest.approx(0.95, abs=1e-4)


def test_logs(spark):
    lines = spark.createDataFrame([(x,) for x in ("s:250 tel:6.3097", "step:125/1390 val_loss:4.1234 train_time:5012ms step_avg:40.10ms", "noise", "step:0/9 val_loss:10.8 train_time:0ms step_avg:nanms")], "value string")
    rows = [tuple(r) for r in records.log_lines(lines).orderBy("step").collect()]
    assert rows == [(0, 10.8, 0.0, None), (125, 4.1234, 5012.0, 40.1), (250, 6.3097, None, None)] or (rows[0][:3], rows[1:]) == ((0, 10.8, 0.0), [(125, 4.1234, 5012.0, 40.1), (250, 6.3097, None, None)])
    ranks = spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 1, 4.0)], "step int, rank int, loss double")
    assert records.mean_over_ranks(ranks).first()["loss"] == 3.0


def test_manifests(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "h int")
    assert tokenset.differ(a, a).first()[0] and not tokenset.differ(a, a.distinct()).first()[0]


def test_streams(spark, tmp_path):
    for i, t in enumerate(["banana", "bandana"]):
        spark.createDataFrame([(i, t)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    s = counts.document_stream(spark, str(tmp_path / "in"), 1)
    out = {bytes(r["gram"]): r["n"] for r in counts.run_to_end(counts.streaming_gram_counts(s, 2), "grams_test").collect()}
    assert out[b"an"] == 4 and out[b"da"] == 1


def test_offsets_of_clustered_repeated_and_null_keys(spark):
    rows = [(None, 4), (None, 3)] + [(10**12 + i, 2) for i in range(300)] + [(5, i % 3) for i in range(200)]
    d = spark.createDataFrame(rows, "k long, size long")
    got = sorted((tuple(r) for r in batches.global_offsets(d, "k", "size", rows_at_once=30).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    run = 0
    for _, size, offset in got:
        assert offset == run
        run += size
    assert len(got) == len(rows) and batches.global_offsets(d.limit(0), "k", "size").count() == 0


def test_block_mask_by_plain_ranges(spark):
    import random

    draw = random.Random(1)
    doc, blocks = 0, []
    for b in range(60):
        lo = doc
        doc += draw.choice([0, 0, 0, 1, 2, 9])
        blocks.append((0, b, lo, doc))
        doc += draw.random() < 0.2
    got = {(r["q"], r["k"], r["full"]) for r in batches.block_mask(spark.createDataFrame(blocks, "shard int, b int, lo long, hi long")).collect()}
    want = {(q, k, q > k and ql == kh and qh == kl) for _, q, ql, qh in blocks for _, k, kl, kh in blocks if q >= k and ql <= kh and qh >= kl}
    assert got == want
