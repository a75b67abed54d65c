"""Operator 10: WARC archives, with a reader that salvages what it can of damaged files.

A record is written as one gzip member. The reader checks each member (gzip checksum, version line,
Content-Length, block digest); where a check fails it searches for the next gzip member that opens
with a version line (in plain archives: the next version line), goes on from there, and logs the
bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bound_batches, shared_dir, table, written

#: An archive file is closed after so many bytes.
FILE_BYTES = 64 << 20
#: Bytes read at a time; the reader holds one record and one block.
READ = 1 << 20
#: Bytes of archives that one reading task gets, about.
READ_BYTES = 4 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit has no block of its own; its headers tell the full payload's digest and length."""
    block = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", uri),
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8") + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 3) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


class Bad(ValueError):
    pass


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the start of ``raw``; Bad if a check fails."""
    if not _VERSION.match(raw):
        raise Bad("no version line")
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise Bad("headers do not end")
    head = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("broken header line")
        head[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", head.get("content-length", "")):
        raise Bad("no content length")
    n = end + 4 + int(head["content-length"])
    if raw[n : n + 4] != b"\r\n\r\n":
        raise Bad("content length does not fit")
    block = raw[end + 4 : n]
    told = head.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != sha1_base32(block):
        raise Bad("block digest differs")
    return head, block, n + 4


class _Window:
    """A file seen through a window that only moves forward; bytes are appended and forgotten in place."""

    def __init__(self, stream, size: int | None = None):
        self.stream, self.base, self.data, self.over, self.size = stream, 0, bytearray(), False, size

    @property
    def end(self) -> int:
        """The place past the last byte that was read."""
        return self.base + len(self.data)

    def more(self) -> bool:
        got = b"" if self.over else self.stream.read(READ)
        self.over = not got
        self.data += got
        return bool(got)

    def upto(self, end: int) -> bool:
        """Read on until ``end`` is in the window; False if the file ends before (known at once where its size is)."""
        if self.size is not None and end > self.size:
            return False
        while self.end < end and self.more():
            pass
        return self.end >= end

    def piece(self, a: int, b: int) -> bytes:
        return bytes(self.data[a - self.base : b - self.base])

    def drop(self, to: int) -> None:
        """Forget bytes before ``to``, once there are enough of them."""
        if to - self.base >= READ:
            del self.data[: to - self.base]
            self.base = to


def salvage(stream, size: int | None = None) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (headers, block)) and ("gap", start, end, reason) in the order of the file.

    Records and gaps cover every byte of the file once. A gap of one run of bad bytes is one entry.
    ``size`` is the file's, if known: a record that claims more bytes than are left is then refused at once.
    """
    w, at, gap, why = _Window(stream, size), 0, None, ""
    while True:
        w.upto(at + 16) or w.upto(w.size or 0)
        if at >= w.end and not w.more():
            break
        try:
            body, end = _member(w, at) if w.piece(at, at + 3) == _MAGIC else _plain(w, at)
        except Bad as e:
            if gap is None:
                gap, why = at, str(e)
            at = _next(w, at + 1)
            w.drop(at)
            continue
        if gap is not None:
            yield "gap", gap, at, why
            gap = None
        yield "record", at, end, body
        at = end
        w.drop(at)
    if gap is not None:
        yield "gap", gap, at, why


def _declared(head: bytes) -> int:
    """Bytes of a record up to its end, told by its headers (which stand in ``head`` up to the blank line)."""
    m = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", head, re.I)
    if not m:
        raise Bad("no content length")
    return len(head) + 2 + int(m[1]) + 4


def _member(w: _Window, at: int):
    """One gzip member. It is inflated step by step and given up once it holds more than its headers tell."""
    d, out, i, most = zlib.decompressobj(31), bytearray(), at, None
    try:
        while not d.eof:
            if not d.unconsumed_tail:
                if not w.upto(i + 1):
                    raise Bad("member is cut short")
                piece = w.piece(i, i + (READ >> 5))
                i += len(piece)
            else:
                piece = d.unconsumed_tail
            out += d.decompress(piece, READ)
            if out and not b"WARC/1.".startswith(out[:7]):
                raise Bad("no version line")
            if most is None and (blank := out.find(b"\r\n\r\n")) >= 0:
                most = _declared(bytes(out[: blank + 2]))
            if len(out) > (most or READ):
                raise Bad("member holds more than its record" if most else "headers do not end")
    except zlib.error as e:
        raise Bad("member: " + str(e).split(": ")[-1]) from None
    raw = bytes(out)
    head, block, n = parse(raw)
    if n != len(raw):
        raise Bad("member holds more than its record")
    return (head, block), i - len(d.unused_data)


def _plain(w: _Window, at: int):
    """A record that isn't compressed: its headers are read first, then as many bytes as they tell, once."""
    seen = at
    while (blank := w.data.find(b"\r\n\r\n", max(seen - 3, at) - w.base)) < 0:
        if w.end - at >= 10 and not _VERSION.match(w.data, at - w.base):
            raise Bad("no version line")
        if w.end - at > READ:
            raise Bad("headers do not end")
        seen = w.end
        if not w.more():
            break
    if not _VERSION.match(w.data, at - w.base):
        raise Bad("no version line")
    if blank < 0 or blank + w.base - at > READ:
        raise Bad("headers do not end")
    end = at + _declared(w.piece(at, w.base + blank + 2))
    if not w.upto(end):
        raise Bad("content length does not fit")
    head, block, n = parse(w.piece(at, end))
    return (head, block), at + n


def _next(w: _Window, at: int) -> int:
    """The next place from ``at`` on where a member or a version line may begin; else the end of the file.

    Bytes that were searched are forgotten, so a long run of damage needs no more memory than a block.
    """
    while True:
        from_here = max(0, at - w.base)
        line = _VERSION.search(w.data, from_here)
        found = [i for i in (w.data.find(_MAGIC, from_here), line.start() if line else -1) if i >= 0]
        if found:
            return w.base + min(found)
        at = max(at, w.end - 9)
        w.drop(at)
        if not w.more():
            return w.end


# ---------------------------------------------------------------- Spark


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, payload, kind, refers_to) as .warc.gz files in ``folder``.

    Returns the manifest (archive, n_records, n_bytes). A task names its files anew in each attempt,
    and only files of attempts that ended well are in the manifest; what a lost executor left
    behind is never read.
    """
    bound_batches(rows.sparkSession)

    def run(batches):
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        done, sink, n, size = [], None, 0, 0

        def close():
            nonlocal sink
            if sink is not None:
                sink.close()
                done.append((name, n, size))
                sink = None

        for batch in batches:
            ids, urls, payloads, kinds, refers = (c.to_pylist() for c in batch.columns)
            for i, u, p, k, r in zip(ids, urls, payloads, kinds, refers, strict=True):
                if sink is None:
                    name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = files.open_output_stream(name, compression=None)
                raw = member(record(k, str(i), u or "", p or b"", None if r is None else str(r)))
                sink.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["archive", "n_records", "n_bytes"])

    return rows.select("page_id", "url", "payload", "kind", "refers_to").mapInArrow(run, "archive string, n_records bigint, n_bytes bigint")


READ_SCHEMA = "archive string, first_byte bigint, end_byte bigint, gap string, record_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes bigint, block binary"


def read_archives(manifest: DataFrame, folder: str, blocks: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap of the archives named in ``manifest``.

    ``gap`` holds the reason of a gap and is null for records. Archives are dealt to as many tasks as there are
    archives (with ``n_bytes`` in the manifest: one for READ_BYTES of them), a number that is told to Spark, since a
    manifest is too small for it to judge by.
    """
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def run(batches):
        files, _ = _filesystem(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_file(archive) as f:
                    for what, a, b, x in salvage(f, f.size()):
                        if what == "gap":
                            rows.append((archive, a, b, x, *[None] * 7))
                        else:
                            head, block = x
                            ident = lambda k, head=head: head[k].removeprefix("<urn:page:").removesuffix(">") if k in head else None
                            rows.append((archive, a, b, None, head.get("warc-type"), ident("warc-record-id"), ident("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha1:"), int(head.get("warc-payload-length", len(block))), block if blocks else None))
                            held += len(block) if blocks else 200
                        if held >= READ * 4:
                            yield _rows(rows)
                            rows, held = [], 0
                yield _rows(rows)

    def _rows(rows):
        types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        kinds = [types[x.split()[1]] for x in READ_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    told = manifest.agg(F.count("*"), F.sum("n_bytes") if "n_bytes" in manifest.columns else F.lit(None)).first()
    tasks = max(1, told[0] if told[1] is None else min(told[0], -(-told[1] // READ_BYTES)))
    # places by a running number, so that tasks get equal shares; the row number runs over archives, not records
    dealt = manifest.select("archive", (F.row_number().over(Window.orderBy("archive")) % tasks).alias("_at"))
    return dealt.repartition(tasks, "_at").select("archive").mapInArrow(run, READ_SCHEMA)


def plan_records(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """Payload, kind and refers_to of each page: of equal payloads of ``least`` bytes or more, the one
    with the largest page_id is the response and the others are revisits of it; rows that repeat the
    largest page_id are all responses. Null html is an empty payload; a null page_id is a response.

    Equal payloads are found by SHA-1, pre-aggregated before the shuffle; the join's hot keys
    are split by adaptive execution.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.encode(F.col(html), "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload"))
    slim = pages.select(F.col(page_id).alias("page_id"), F.sha1(F.coalesce(F.encode(F.col(html), "utf-8"), F.lit(b""))).alias("_sha"))
    # only payloads found twice have a row to join with
    last = slim.groupBy("_sha").agg(F.max("page_id").alias("_last"), F.min("page_id").alias("_first")).filter("_first < _last").drop("_first")
    last = written(last, "warc-repeated")  # read back, its join's hot keys can be split
    x = rows.join(last, "_sha", "left")
    again = F.col("_last").isNotNull() & (F.col("page_id") < F.col("_last")) & (F.length("payload") >= least)
    return x.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("_last")).alias("refers_to"))


def verified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records of ``found``, or an error where they are not what the manifest tells.

    ``found`` must be a written table. An archive fails if it has a gap, or another number of records or bytes than
    were written; the message names some of the archives and their gaps. Use ``read_archives`` alone to go on
    with what can be salvaged.
    """
    got = found.groupBy("archive").agg(F.count(F.when(F.col("gap").isNull(), 1)).alias("n"), F.sum(F.col("end_byte") - F.col("first_byte")).alias("bytes"), F.count("gap").alias("gaps"), F.min("gap").alias("why"))
    bad = manifest.join(got, "archive", "left").filter("gaps > 0 or n is null or n <> n_records or bytes <> n_bytes")
    some = bad.limit(5).collect()
    if some:
        raise RuntimeError("archives differ from their manifest: " + "; ".join(f"{r['archive']}: {r['n'] or 0} of {r['n_records']} records, {r['gaps'] or 0} gaps ({r['why']})" for r in some))
    return found.filter(F.col("gap").isNull())


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0, blocks: bool = False) -> DataFrame:
    """Write ``pages`` to archives, read them back and check them against the manifest; see READ_SCHEMA.

    Every page is a record, whatever its nulls: a null url is empty, a null html an empty payload, a null page_id
    the id ``None``. Repeated rows are records of their own; other columns of ``pages`` are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/lexiloom/warc-{uuid.uuid4().hex}"
    manifest = written(write_archives(plan_records(pages, least=least), folder), "warc-manifest")
    return verified(written(read_archives(manifest, folder, blocks), "warc-records"), manifest)


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page of ``pages``, written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Fails if any archive does not read back whole. Nulls, repeated rows and empty tables: see ``round_trip``.
    """
    back = round_trip(table(spark, sf_dir, "pages"))
    return back.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


#: DuckDB has no base-32 function, so SHA-1 is spelt in groups of five bits.
OP10_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
b AS (SELECT DISTINCT h, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1), '' ORDER BY i)
    FROM range(32) t(i)) AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < last THEN last END AS refers_to FROM m JOIN b USING (h)
"""
