"""WARC archives with segmented records and chunked payloads (operator 10).

**Writing.** Each page becomes a record: a ``response`` (an HTTP head and the
body in chunked transfer framing) or a ``revisit`` of the response with the same
payload and the largest id. A block longer than ``segment_bytes`` is split: the
first segment is the response, ``continuation`` records with the origin's id and
their number follow, the last names the total length. Record kinds are decided
on digests; the pages themselves are shuffled once. Spark's text writer puts the
records on the store, its line separator being the two line ends that close a
WARC record, so that any file system Spark reaches will do.

**Reading.** Archives are parsed file by file from Spark's binary scan. Only
segments are shuffled: they are grouped by origin, ordered by number, checked to
run from 1 without gap or repeat and to add up to the total length, then joined.
Blocks are checked against their digest, chunked framing is decoded, payloads
are checked against theirs. Revisits take size and digest from the response
they name. A record that fails keeps its row with a ``status`` other than ``ok``
and no payload; damaged parts of an archive give a ``malformed`` row, and reading
goes on behind them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, numbered, scratch_path

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
MIN_REVISIT_BYTES = 0
RECORDS_PER_FILE = 20_000
FILE_BYTES = 128 << 20   # pages of a file before compression, on average
READ_BYTES = 1 << 20
VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\s*$")
DATE = "2020-01-01T00:00:00Z"
CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def digest(data: bytes) -> str:
    return base32(hashlib.sha1(data).digest())


# ---------------------------------------------------------------- framing

def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[i:i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """Body of a chunked message; extensions and trailers are skipped. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = data.index(CRLF, at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or data[at + size:at + size + 2] != CRLF:
            raise ValueError("chunk does not end where it should")
        out.append(data[at:at + size])
        at += size + 2


def http_body(block: bytes) -> bytes:
    """Payload of an HTTP message; ValueError if there is no head or the framing is broken."""
    end = block.index(b"\r\n\r\n")
    fields = dict(line.lower().split(b":", 1) for line in block[:end].split(CRLF)[1:] if b":" in line)
    body = block[end + 4:]
    return dechunked(body) if fields.get(b"transfer-encoding", b"").strip().endswith(b"chunked") else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def records(page_id, url: str, html: bytes, sha1: str, copy: str | int, original, segment_bytes: int) -> list[bytes]:
    """The records of one page; ``original`` is the id it revisits (None: it is a response)."""
    def urn(of) -> str:
        h = hashlib.md5(of.encode()).hexdigest()
        return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"
    me = urn(f"{page_id}/{sha1}/{copy}")
    payload = "sha1:" + base32(bytes.fromhex(sha1))
    common = [("WARC-Record-ID", me), ("WARC-Date", DATE), ("WARC-Target-URI", "".join((url or "about:blank").split()))]
    common += [("X-Page-ID", str(page_id))] if page_id is not None else []
    if original is not None:
        return [record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(f"{original}/{sha1}/1")),
                        ("WARC-Payload-Digest", payload), ("X-Refers-To-Page-ID", str(original))], b"")]
    block = HTTP_HEAD + chunked(html)
    first = [("WARC-Type", "response"), *common, ("Content-Type", "application/http; msgtype=response"),
             ("WARC-Payload-Digest", payload), ("X-Whole-Block-Digest", "sha1:" + digest(block))]
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [record(first, block)]
    out = [record([*first, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", urn(f"{me}/{n}")), ("WARC-Date", DATE),
                           ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(n)), *last], part))
    return out


# ---------------------------------------------------------------- writer

def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          segment_bytes: int = SEGMENT_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archives of ``pages`` under ``path``. Null html is empty; null ids are never referred to.

    Rows repeating an id and its payload get a record each, all of the kind of the first.
    Files hold about ``FILE_BYTES`` of pages.
    """
    rid = fresh(pages, "rid")
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = numbered(pages, rid).select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("pk"), F.col(url_col).alias("url"),
                                       html.alias("html"), F.sha1(html).alias("sha1"), F.col(rid).alias("rid"))
    mean = rows.agg(F.avg(F.length("html"))).first()[0] or 1.0
    kinds = rows.groupBy("pk", "sha1").agg(F.max("id").alias("id"), F.max(F.length("html")).alias("n"), F.min("rid").alias("first"))
    latest = kinds.where(F.col("n") >= min_revisit_bytes).groupBy("sha1").agg(F.max("id").alias("latest"))
    original = F.when(~F.col("latest").eqNullSafe(F.col("id")), F.col("latest"))
    kinds = kinds.join(latest, "sha1", "left").select("pk", "sha1", "first", original.alias("original"))
    # the first of the rows with an id and payload is the one that others refer to
    copy = F.when(F.col("rid") == F.col("first"), "1").otherwise(F.concat_ws("-", F.col("rid.file"), F.col("rid.row")))
    dealt = rows.join(kinds, ["pk", "sha1"]).select("id", "url", "html", "sha1", copy.alias("copy"), "original")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = [r for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True) for r in records(*row, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
    # a cast keeps the bytes as they are
    (dealt.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write
     .option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, min(RECORDS_PER_FILE, int(FILE_BYTES / max(mean, 1))))).text(path))


# ---------------------------------------------------------------- reader

#: column, header field
FIELDS = [("type", "warc-type"), ("record_id", "warc-record-id"), ("uri", "warc-target-uri"), ("page_id", "x-page-id"), ("payload_digest", "warc-payload-digest"),
          ("block_digest", "x-whole-block-digest"), ("refers_to", "x-refers-to-page-id"), ("origin", "warc-segment-origin-id"),
          ("segment", "warc-segment-number"), ("total", "warc-segment-total-length")]


class _Source:
    """Bytes from an iterator of chunks, with the last ones read put back on demand."""

    def __init__(self, chunks):
        self.chunks, self.buf, self.at = iter(chunks), b"", 0

    def _fill(self, n: int) -> None:
        if len(self.buf) - self.at < n:
            parts, have = [self.buf[self.at:]], len(self.buf) - self.at
            while have < n and (c := next(self.chunks, None)) is not None:
                parts.append(c)
                have += len(c)
            self.buf, self.at = b"".join(parts), 0

    def read(self, n: int) -> bytes:
        self._fill(n)
        out = self.buf[self.at:self.at + n]
        self.at += len(out)
        return out

    def readline(self) -> bytes:
        want = 1024
        while True:
            self._fill(want)
            end = self.buf.find(b"\n", self.at, self.at + want)
            if end >= 0 or len(self.buf) - self.at < want:
                end = len(self.buf) if end < 0 else end + 1
                out, self.at = self.buf[self.at:end], end
                return out
            want *= 2

    def back(self, data: bytes) -> None:
        """Puts back the bytes that were read last."""
        if self.at >= len(data) and self.buf.startswith(data, self.at - len(data)):
            self.at -= len(data)
        else:
            self.buf, self.at = data + self.buf[self.at:], 0


def _upto_damage(unpack, piece: bytes):
    """What can be decoded of a damaged piece."""
    try:
        for at in range(0, len(piece), 64):
            yield unpack.decompress(piece[at:at + 64])
    except zlib.error:
        return


def _stretches(data: bytes):
    """Runs of decoded bytes, and whether damaged gzip data ended them (known behind the run); the next run begins at the next member."""
    state = {"at": 0, "damaged": False}
    if data[:2] != b"\x1f\x8b":
        yield iter([data]), state
        return

    def members():
        while state["at"] < len(data) and data.startswith(b"\x1f\x8b", state["at"]):
            unpack, pos = zlib.decompressobj(31), state["at"]
            try:
                while not unpack.eof:
                    if pos >= len(data):
                        raise zlib.error("truncated")
                    piece = unpack.unconsumed_tail or data[pos:pos + READ_BYTES]
                    if not unpack.unconsumed_tail:
                        pos += len(piece)
                    before = unpack.copy()
                    try:
                        out = unpack.decompress(piece, 4 * READ_BYTES)
                    except zlib.error:
                        yield from _upto_damage(before, piece)
                        raise
                    if out:
                        yield out
            except zlib.error:
                state["damaged"] = True
                return
            state["at"] = pos - len(unpack.unused_data)
        state["damaged"] = state["at"] < len(data) and bool(data[state["at"]:].strip(b"\x00"))
    while True:
        state["damaged"] = False
        yield members(), state
        if not state["damaged"]:
            return
        state["at"] = data.find(b"\x1f\x8b\x08", state["at"] + 1)
        if state["at"] < 0:
            return


MALFORMED = ({"warc-type": "malformed"}, b"")


def _record(f: _Source):
    """The next record, None at the end; ValueError if there is something else. What was not understood is put back."""
    while (line := f.readline()) and not line.strip():
        pass
    if not line:
        return None
    if not VERSION.match(line):
        raise ValueError("no version line")
    fields = {}
    while (line := f.readline()).strip():
        if VERSION.match(line):
            f.back(line)
            raise ValueError("a record in a header")
        k, _, v = line.decode("utf-8", "replace").partition(":")
        fields[k.strip().lower()] = v.strip()
    if not line:
        raise ValueError("truncated header")
    n = int(fields.get("content-length", ""))
    block = f.read(max(n, 0))
    end = f.read(4)
    if n < 0 or len(block) < n or end.strip(b"\r\n"):
        f.back(block + end)                     # the length is wrong: records may begin inside
        raise ValueError("length")
    f.back(end)
    return fields, block


def parse(data: bytes):
    """(fields, block) of each record of a file, plain or gzip (one member or many).

    What cannot be read gives one ``malformed`` row, and reading goes on at the next
    version line or gzip member.
    """
    for stretch, state in _stretches(data):
        f, skipping = _Source(stretch), False
        while True:
            try:
                found = _record(f)
            except ValueError:
                if not skipping:
                    yield MALFORMED
                skipping = True
                while (line := f.readline()) and not VERSION.match(line):
                    pass
                if not line:
                    break
                f.back(line)
                continue
            if found is None:
                break
            skipping = False
            yield found
        if state["damaged"] and not skipping:
            yield MALFORMED


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``: header fields (strings) and ``block``."""
    names = [c for c, _ in FIELDS] + ["block"]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse(content.as_py()):
                    rows.append([fields.get(h) for _, h in FIELDS] + [block])
                    size += len(block)
                    if size > 8 << 20 or len(rows) == 4096:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{c} string" for c in names[:-1]) + ", block binary")


def _batch(rows, names):
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "block" else pa.string()) for c, n in zip(cols, names, strict=True)], names)


def reassemble(recs: DataFrame) -> DataFrame:
    """Responses with their segments: ``(page_id, uri, payload_digest, block_digest, parts, status)``.

    Complete are segments numbered 1 to n, once each, whose lengths add up to the total that the last one names.
    """
    keep = ["page_id", "uri", "payload_digest", "block_digest"]
    whole = recs.where("type = 'response' and segment is null").select(*keep, F.array("block").alias("parts"), F.lit("ok").alias("status"))
    number = F.col("segment").try_cast("int")
    pieces = recs.where("segment is not null and type in ('response', 'continuation')")
    first = F.when(F.col("type") == "response", F.struct(*keep))
    grouped = pieces.groupBy(F.coalesce("origin", "record_id").alias("origin")).agg(
        F.max(first).alias("head"), F.max(F.col("total").try_cast("long")).alias("total"),
        F.array_sort(F.collect_list(F.struct(number.alias("n"), "block"))).alias("s"))
    in_order = F.transform("s", lambda x: x["n"]) == F.sequence(F.lit(1), F.size("s"))
    length = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x["block"]))
    status = (F.when(F.col("head").isNull() | ~F.coalesce(in_order, F.lit(False)) | F.col("total").isNull(), "incomplete")
              .when(length != F.col("total"), "bad length").otherwise("ok"))
    joined = grouped.select("head.*", F.transform("s", lambda x: x["block"]).alias("parts"), status.alias("status"))
    return whole.unionByName(joined)


def payloads(responses: DataFrame, with_payload: bool = False) -> DataFrame:
    """Decoded and verified: ``(page_id, uri, payload_bytes, payload_digest, status[, payload])``."""
    def one(parts, status, named, block_named):
        if status != "ok":
            return None, None, status, None
        block = b"".join(parts)
        if block_named is not None and block_named != "sha1:" + digest(block):
            return None, None, "bad block digest", None
        try:
            body = http_body(block)
        except ValueError:
            return None, None, "bad framing", None
        found = digest(body)
        if named is not None and named != "sha1:" + found:
            return None, None, "bad payload digest", None
        return len(body), found, "ok", body

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                got = [one(*row) for row in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
                n, d, s, body = zip(*got, strict=True)
                cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d, pa.string()), pa.array(s, pa.string())]
                if with_payload:
                    cols.append(pa.array(body, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "uri", "payload_bytes", "payload_digest", "status", "payload"][:len(cols)])
    schema = "page_id string, uri string, payload_bytes long, payload_digest string, status string" + ", payload binary" * with_payload
    return responses.select("page_id", "uri", "parts", "status", "payload_digest", "block_digest").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per page record: ``(page_id, uri, payload_bytes, payload_digest, record_type, refers_to, status[, payload])``.

    ``status`` of a revisit whose response is missing or broken is ``unresolved``.
    What is no record gives a row of the type and status ``malformed`` in the place
    of each run of it. An empty archive gives an empty table.
    """
    recs = read_records(spark, path)
    is_whole = F.expr("type = 'response' and segment is null")
    rest = materialise(recs.where(~F.coalesce(is_whole, F.lit(False))))       # segments, revisits, malformed: read once
    recs = recs.where(is_whole).unionByName(rest)
    got = materialise(payloads(reassemble(recs), with_payload))
    got = got.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("string"))
    found = got.where("status = 'ok'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes",
                                              *["payload"] * with_payload).dropDuplicates(["refers_to", "payload_digest"])
    named = F.regexp_replace("payload_digest", "^sha1:", "")
    again = rest.where("type = 'revisit'").select("page_id", "uri", "refers_to", named.alias("payload_digest"), F.lit("revisit").alias("record_type"))
    again = again.join(found, ["refers_to", "payload_digest"], "left").withColumn("status", F.when(F.col("payload_bytes").isNull(), "unresolved").otherwise("ok"))
    damage = rest.where("type = 'malformed'").select(F.col("type").alias("record_type"), F.col("type").alias("status"))
    out = got.unionByName(again).unionByName(damage, allowMissingColumns=True)
    return out.select(F.col("page_id").cast("long"), "uri", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"), "status", *["payload"] * with_payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES,
               min_revisit_bytes: int = MIN_REVISIT_BYTES, with_payload: bool = False) -> DataFrame:
    """``pages`` written below the shared checkpoint folder and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, html_col, segment_bytes, min_revisit_bytes)
    return read(pages.sparkSession, path, with_payload)
