from pyspark.sql import functions as F

from lexiloom.__main__ import main
from lexiloom.operators import learner
from lexiloom.plans import pipelines
from lexiloom.sources import shards, tokensets


def docs(spark):
    texts = ["the cat the hat", "the hat", "", "a cat é"]
    return spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "doc_id long, data binary")


def test_mine_and_prepare(spark, tmp_path):
    x = pipelines.mine(docs(spark), [2, 3], 5, str(tmp_path / "top"))
    assert x.filter("len = 3").orderBy("rank").first()["n_total"] == 4 or x.count() == 10
    kept, stats = pipelines.prepare([x.select(F.col("gram").alias("token"))])
    assert kept.count() >= 256 and stats.agg(F.sum("n")).first()[0] >= kept.count()


def test_statistics_cache(spark, tmp_path):
    d, tokens = docs(spark), [b"the", b"at"]
    a = pipelines.statistics(d, tokens, str(tmp_path)).orderBy("token_id").collect()
    assert [r["n_total"] for r in a] == [3, 4]
    assert pipelines.statistics(d, tokens, str(tmp_path)).orderBy("token_id").collect() == a
    b = pipelines.statistics(d.filter("doc_id > 0"), tokens, str(tmp_path)).orderBy("token_id").collect()
    assert [r["n_total"] for r in b] == [1, 2]


def test_build_shards(spark, tmp_path):
    tokens = [*learner.BYTES, b"th", b"the", b" the"]
    files = pipelines.build_shards(docs(spark), tokens, str(tmp_path), 10).orderBy("shard").collect()
    ids = []
    for r in files:
        with open(r["file"], "rb") as f:
            ids += shards.unpack(f.read()).tolist()
    assert [r["n_tokens"] for r in files[:-1]] == [10] * (len(files) - 1) and ids.count(50256) == 4
    text = b"|".join(bytes().join(tokens[i] for i in part) for part in _split(ids))
    assert text == "the cat the hat|the hat||a cat é".encode()


def _split(ids):
    out = []
    for i in ids:
        if i == 50256:
            out.append([])
        else:
            out[-1].append(i)
    return out


def test_evaluate(spark):
    tokens = [*learner.BYTES, b"the", b"at"]
    rows = pipelines.evaluate(docs(spark), tokens, [1 / 258] * 258).collect()
    for r in rows:
        if r["n_bytes"]:
            assert r["all_paths_bpb"] <= r["bpb"] + 1e-12


def test_command_line(spark, small, tmp_path, capsys):
    assert main(["top", "2,3", "--k", "3", "--corpus", f"{small}/benchmark.parquet"]) == 0
    assert main(["learn", "--size", "258", "--steps", "2", "--corpus", f"{small}/benchmark.parquet", "--output", str(tmp_path / "v.bin")]) == 0
    vocab, warnings = tokensets.unpack_vocabulary((tmp_path / "v.bin").read_bytes())
    assert len(vocab) == 258 and not warnings
    assert main(["tokens", str(tmp_path / "v.bin"), "--top", "3"]) == 0
    assert main(["tokens", str(tmp_path / "v.bin"), "--summary", "--filter"]) == 0
    assert "e " in capsys.readouterr().out


def test_command_line_with_files(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("the cat the hat the cat")
    (tmp_path / "b.txt").write_text("a cat and the hat, that hat")
    texts, out = [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], str(tmp_path / "out")
    assert main(["top", "2,3", "--k", "6", "--corpus", *texts, "--output", out]) == 0
    rows, _ = tokensets.unpack_counted((tmp_path / "out" / "tokenset_3.bin").read_bytes())
    assert len(rows) == 6 and all(len(t) == 3 and n > 0 for t, n in rows) and (b"the", 4) in rows
    table, stats, kept = (str(tmp_path / n) for n in ("all.bin", "all.stats", "kept.bin"))
    files = [f"{out}/tokenset_2.bin", f"{out}/tokenset_3.bin"]
    assert main(["combine", *files, "--kind", "counted", "--output-tokenset", table, "--output-stats", stats]) == 0
    tokens = tokensets.unpack_legacy(open(table, "rb").read(), need_bytes=True)
    counts = tokensets.unpack_stats(open(stats, "rb").read(), len(tokens))
    assert len(tokens) == 268 and {tokens[i]: n for i, n, _, _ in counts}[b"the"] == 4 and sum(n == 0 for _, n, _, _ in counts) == 256
    assert main(["prepare", *files, "--kind", "counted", "--output", kept]) == 0
    assert set(tokensets.unpack_legacy(open(kept, "rb").read())) <= set(tokens)
    assert main(["tokens", table, "--kind", "legacy", "--length", "3", "--output", str(tmp_path / "three.bin")]) == 0
    assert len(tokensets.unpack_legacy((tmp_path / "three.bin").read_bytes())) == 6
    vocab = str(tmp_path / "v.bin")
    learn = ["learn", "--corpus", *texts, "--tokenset", table, "--kind", "legacy", "--stats-path", str(tmp_path / "stats"), "--steps", "3"]
    assert main([*learn, "--size", "258", "--in-memory", "--output", vocab]) == 0 and (tmp_path / "stats" / "token_stats.bin").exists()
    first = tokensets.unpack_vocabulary(open(vocab, "rb").read())[0]
    assert main([*learn, "--size", "260", "--refresh", "1", "--load-vocab", vocab, "--output", vocab + "2"]) == 0
    second = tokensets.unpack_vocabulary(open(vocab + "2", "rb").read())[0]
    assert len(first) == 258 and second[:258] == first and len(second) == 260
    assert main(["shards", "--corpus", *texts, "--vocab", vocab, "--shard-size", "20", "--output", str(tmp_path / "shards")]) == 0
    read = [shards.unpack(p.read_bytes()).tolist() for p in sorted((tmp_path / "shards").glob("*.bin"))]
    assert sum(map(len, read)) > 30 and sum(x.count(50256) for x in read) == 2
    assert main(["evaluate", "--vocab", vocab, "--corpus", *texts, "--output", str(tmp_path / "report")]) == 0
    report = spark.read.json(str(tmp_path / "report")).collect()
    assert len(report) == 2 and all(r["all_paths_bpb"] <= r["bpb"] for r in report)
    assert main(["evaluate", "--vocab", vocab, "--skip-standard"]) == 0
    assert "all_paths_bpb" in capsys.readouterr().out


def test_statistics_files_are_valid_for_their_corpus_and_tokens(spark, tmp_path):
    d, tokens, cache = docs(spark), [b"the", b"at"], str(tmp_path / "c")
    n = lambda x, t: [r["n_total"] for r in pipelines.statistics(x, t, cache, "file").orderBy("token_id").collect()]
    assert n(d, tokens) == [3, 4] == n(d, tokens) and n(d.filter("doc_id > 0"), tokens) == [1, 2] and n(d, [b"at", b"the"]) == [4, 3]


def test_refreshed_covers_change_no_result(spark):
    d = docs(spark)
    found = [b"the", b"at", b" the", b"cat", b"hat", b"t ", b"he"]
    a, b = (learner.learn(d, found, 260, 4, refresh=r).vocab for r in (None, 1))
    assert a == b and len(a) > 256
    more = learner.learn(d, found, 261, 2, start=a).vocab
    assert more[: len(a)] == a


def test_cursor(spark):
    from lexiloom.streaming.cursor import Cursor

    df = spark.createDataFrame([(i * 3, f"t{i}") for i in range(20)], "doc_id long, text string")
    c = Cursor(df, "doc_id")
    ids = lambda x: sorted(r["doc_id"] for r in x.collect())
    assert ids(c.take(4)) == [0, 3, 6, 9] and c.progress() == {"read": 4, "total": 20, "share": 0.2}
    again = Cursor.resume(df, "doc_id", c.state())
    assert ids(again.take(2)) == [12, 15] and len(ids(again.rest())) == 14 and again.take(5).count() == 0
    again.rewind()
    assert ids(again.take(1)) == [0]
