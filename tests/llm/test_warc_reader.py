"""The salvage reader on large records and bogus lengths, and the round trip's check against its manifest."""

import io
import tracemalloc

import pytest

from lexiloom.llm import warc


def test_large_plain_records_are_read_whole_in_linear_memory():
    big = bytes(range(256)) * (5 << 12)  # 5 MiB, over the 1 MiB window
    recs = [warc.record("response", str(i), "u", b) for i, b in enumerate((b"a", big, b"", big[::-1], b"z"))]
    got = list(warc.salvage(io.BytesIO(b"".join(recs))))
    assert [g[0] for g in got] == ["record"] * 5 and [len(g[3][1]) for g in got] == [1, len(big), 0, len(big), 1] and got[3][3][1] == big[::-1]


def test_a_bogus_length_is_refused_without_reading_the_file():
    bad = warc.record("response", "0", "u", b"x").replace(b"Content-Length: 1\r\n", b"Content-Length: 99999999999\r\n")
    good = warc.record("response", "1", "u", b"y")
    raw = bad + good
    for size in (None, len(raw)):
        got = list(warc.salvage(io.BytesIO(raw), size))
        assert [(g[0], g[1], g[2]) for g in got] == [("gap", 0, len(bad)), ("record", len(bad), len(raw))] and got[0][3] == "content length does not fit"


def test_a_member_that_inflates_past_its_record_is_given_up():
    bomb = warc.member(warc.record("response", "0", "u", b"x") + bytes(64 << 20))
    good = warc.member(warc.record("response", "1", "u", b"y"))
    tracemalloc.start()
    got = list(warc.salvage(io.BytesIO(bomb + good)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [g[0] for g in got] == ["gap", "record"] and got[1][3][1] == b"y" and peak < 24 << 20


def test_a_long_run_of_noise_does_not_fill_the_window():
    noise = b"no record here. " * (1 << 18)  # 4 MiB
    w = warc._Window(io.BytesIO(noise))
    assert warc._next(w, 1) == len(noise) and len(w.data) <= 2 * warc.READ


def test_the_round_trip_fails_on_a_damaged_archive(spark, monkeypatch, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(200)], "page_id long, url string, html string")
    write = warc.write_archives

    def hurt(rows, folder):
        manifest = warc.written(write(rows, folder), "hurt")
        name = manifest.first()["archive"]
        raw = bytearray(open(name, "rb").read())
        raw[len(raw) // 2] ^= 1
        open(name, "wb").write(bytes(raw))
        return manifest

    monkeypatch.setattr(warc, "write_archives", hurt)
    with pytest.raises(RuntimeError, match="differ from their manifest"):
        warc.round_trip(pages, str(tmp_path / "w"))


def test_a_lost_tail_fails_and_archives_are_dealt_to_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(200)], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    manifest = warc.written(warc.write_archives(warc.plan_records(pages), folder), "dealt")
    found = warc.read_archives(manifest, folder)
    assert found.rdd.getNumPartitions() > 8
    whole = warc.written(found, "whole")
    assert warc.verified(whole, manifest).count() == 200
    with pytest.raises(RuntimeError, match="0 of"):
        warc.verified(whole.filter(f"archive <> '{manifest.first()['archive']}'"), manifest)
