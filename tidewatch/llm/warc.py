"""WARC archives compressed with Zstandard and a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; each record is a frame of its own. The writer turns each partition of
pages into one archive, under a name of its own attempt; the manifest names the
archives of the attempts that succeeded. Records whose payload equals another's are
revisits of the record with the largest page id.

The reader takes the dictionary from the leading frame, finds each frame's end from
its block headers, decodes it, and checks: the checksum and content size of the
frame, the version line, mandatory headers, Content-Length against the block, the
payload's length and digest, and the record count of the manifest. Anything wrong
raises ``Damaged``. Archives of other writers may leave out what the format leaves to
them: a frame's content size (records are then decoded in steps, up to
``MOST_RECORD_BYTES``), HTTP's Content-Length, the payload digest or the count in the
manifest; digests may be of any algorithm, in base 32 or hex, and are checked where
hashlib knows it. Transfer codings aren't undone: such a payload is the body as stored,
and neither its HTTP length nor its digest is checked.

Defined cases: a null html is an empty payload; a null url leaves out the target; a
null page_id is written as such and is original only among nulls; rows that repeat
the largest page_id of a payload are all responses; an empty table gives no archive
and no rows; other columns of the input are not read, whatever their names. The dictionary is trained on at most ``SAMPLES`` pages; where that is
too little for training, their text itself is the dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.tokenout import opened

DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
LEVEL = 3
SAMPLES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 16_384, 65_536
#: Payloads of at least so many bytes are told apart into response and revisit.
REVISIT_FROM = 0
#: Bytes of a decoded record at most, where its frame doesn't state them.
MOST_RECORD_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Damaged(ValueError):
    """An archive that breaks the format."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def head(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def target(url: str) -> str:
    """A url in which no character can end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("X-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        lines.append(("WARC-Target-URI", target(url)))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original)), ("X-Refers-To-Page-ID", str(original))]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return head(lines) + block + b"\r\n\r\n"


def info() -> bytes:
    block = b"software: tidewatch\r\nformat: WARC File Format 1.1\r\n"
    return head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'info')}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """Dictionary bytes for pages like the samples; empty without samples."""
    some = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, some).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(some)[-DICTIONARY_BYTES:]


def compressor(dictionary_bytes: bytes) -> zstandard.ZstdCompressor:
    given = {"dict_data": zstandard.ZstdCompressionDict(dictionary_bytes)} if dictionary_bytes else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **given)


def leading_frame(dictionary_bytes: bytes) -> bytes:
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary_bytes).to_bytes(4, "little") + dictionary_bytes if dictionary_bytes else b""


MANIFEST = "path string, records bigint, bytes bigint"


def writer(folder: str, dictionary_bytes: bytes):
    """Arrow function: (page_id, url, html, digest, original, repeated) to one archive; a row of MANIFEST."""

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = opened(folder)
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.zst"
        press, out, n, size = compressor(dictionary_bytes), None, 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)  # pyarrow would compress by the name's ending
                size += out.write(leading_frame(dictionary_bytes)) or 0
                out.write(press.compress(info()))
            for page_id, url, html, digest, original, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = bool(repeated) and original is not None and page_id != original
                bare = base64.b32encode(bytes.fromhex(digest)).decode()
                frame = press.compress(record(page_id, url, (html or "").encode(), bare, original, revisit))
                out.write(frame)
                n += 1
                size += len(frame)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    return run


class Source:
    """A stream with exact reads and a look ahead."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.stream.read(max(n - len(self.held), 1 << 16))):
            self.held += more
        return self.held[:n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        if len(out) < n:
            raise Damaged("archive ends within a frame")
        self.held = self.held[n:]
        return out


def frame_of(source: Source) -> bytes:
    """The bytes of the next frame: header, blocks up to the last one, checksum."""
    start = source.peek(18)
    size = zstandard.frame_header_size(start)
    given = zstandard.get_frame_parameters(start)
    parts = [source.read(size)]
    while True:
        mark = source.read(3)
        bits = int.from_bytes(mark, "little")
        parts += [mark, source.read(1 if bits >> 1 & 3 == 1 else bits >> 3)]
        if bits & 1:
            break
    if given.has_checksum:
        parts.append(source.read(4))
    return b"".join(parts)


def decoded(reader: zstandard.ZstdDecompressor, frame: bytes, most: int = MOST_RECORD_BYTES) -> bytes:
    """Content of a frame."""
    if zstandard.frame_content_size(frame) >= 0:
        return reader.decompress(frame)
    steps, size = [], 0
    with reader.stream_reader(frame) as f:
        while step := f.read(1 << 20):
            steps.append(step)
            size += len(step)
            if size > most:
                raise Damaged(f"record of more than {most} bytes")
    return b"".join(steps)


def records(stream):
    """Decoded records of an archive, one for each frame."""
    source, reader, first = Source(stream), zstandard.ZstdDecompressor(), True
    while start := source.peek(4):
        magic = int.from_bytes(start, "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(source.read(8)[4:], "little")
            body = source.read(size)
            if first and magic == DICTIONARY_FRAME:
                if body[:4] == FRAME.to_bytes(4, "little"):
                    body = zstandard.ZstdDecompressor().decompress(body)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        elif magic == FRAME:
            try:
                yield decoded(reader, frame_of(source))
            except zstandard.ZstdError as e:
                raise Damaged(f"frame can't be decoded: {e}") from e
        else:
            raise Damaged(f"unknown frame {magic:#x}")
        first = False


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, validated."""
    top, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", version):
        raise Damaged("no WARC version line or headers not ended")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise Damaged(f"bad header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise Damaged(f"no {name}")
    if not headers["content-length"].isdecimal() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Damaged("Content-Length doesn't fit the record")
    return headers, rest[:-4]


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def digest_fits(given: str, payload: bytes) -> bool:
    """Whether a labelled digest is the payload's; True where hashlib doesn't know the algorithm."""
    name, _, value = given.partition(":")
    try:
        raw = hashlib.new(name.lower().replace("-", ""), payload, usedforsecurity=False).digest()
    except (ValueError, TypeError):
        return True
    return value.upper().rstrip("=") in (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper())


def page(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A row of READ from a response or revisit record; the digest of a response is its SHA-1 in base 32, of a revisit the given one."""
    kind, given = headers["warc-type"], headers.get("warc-payload-digest", "")
    size, payload, coded = None, block, False
    if headers.get("content-type", "application/http").partition(";")[0].strip().lower() == "application/http":
        top, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("no HTTP head")
        size = re.search(rb"(?i)\r\nContent-Length: *([0-9]+)(?:\r\n|$)", top)
        coded = re.search(rb"(?i)\r\nTransfer-Encoding:", top) is not None
    n = len(payload) if size is None else int(size[1])
    if kind == "response":
        if "warc-truncated" in headers or coded:
            n = len(payload)
        elif len(payload) != n or (given and not digest_fits(given, payload)):
            raise Damaged("payload differs from its length or digest")
        digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    else:
        if payload:
            raise Damaged("revisit with a payload")
        digest = (given.removeprefix("sha1:") or None) if given else None
    number = lambda x: int(x) if x else None
    return number(headers.get("x-page-id")), headers.get("warc-target-uri"), n, digest, kind, number(headers.get("x-refers-to-page-id")), payload if payloads and kind == "response" else None


def reader(payloads: bool):
    """Arrow function: manifest rows (path, records) to READ."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches):
        def out(rows):
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [f.split()[0] for f in READ.split(", ")])

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, base = opened(path)
                rows, seen = [], 0
                with fs.open_input_stream(base, compression=None, buffer_size=1 << 20) as f:
                    for raw in records(f):
                        headers, block = parsed(raw)
                        if headers["warc-type"] in ("response", "revisit"):
                            rows.append(page(headers, block, payloads))
                            seen += 1
                        if len(rows) >= (500 if payloads else 10_000):
                            yield out(rows)
                            rows = []
                if expected is not None and seen != expected:
                    raise Damaged(f"{seen} records in {path}, {expected} written")
                if rows:
                    yield out(rows)

    return run


def write(scratch: common.Scratch, pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives below ``folder``; the manifest."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    same = rows.filter(F.col("size") >= revisit_from).groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").select("digest", "size", "original", F.lit(True).alias("repeated"))
    same = scratch.write(same, "repeated")
    same = common.small(same)
    # about twice as many pages as wanted by a bound on the hash, so that what tasks send doesn't grow with their number
    bound = F.pmod(F.xxhash64("page_id", F.lit(7)), F.lit(1 << 30))
    n = pages.count()
    few = pages.filter(bound < int(min(1.0, 2 * SAMPLES / max(n, 1)) * (1 << 30))).select(bound.alias("h"), F.substring(html, 1, SAMPLE_CHARS).alias("t"))
    learned = dictionary([(r.t or "").encode() for r in few.orderBy("h", "t").limit(SAMPLES).collect()])
    ready = rows.join(same, ["digest", "size"], "left").select("page_id", "url", "html", "digest", "original", "repeated")
    return scratch.write(ready.mapInArrow(common.tidy(writer(folder, learned)), MANIFEST), "manifest")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every response and revisit record of the archives of ``manifest(path, records)``, records null if unknown; validated; see READ."""
    return manifest.select("path", F.col("records").cast("long").alias("records")).repartition(max(1, manifest.count())).mapInArrow(common.tidy(reader(payloads)), READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "warc")
    manifest = write(scratch, common.table(spark, sf_dir, "pages"), common.url(scratch.path("archives")))
    return read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS original FROM p),
b AS (SELECT *, (SELECT string_agg(lpad(bin(('0x' || substr(hex, k * 2 + 1, 2))::INT), 8, '0'), '' ORDER BY k) FROM range(20) r(k)) AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + list_sum(list_transform(range(5), lambda i: CAST(substr(bits, 5 * k + i + 1, 1) AS INT) * (16 >> i)))::INT, 1), '' ORDER BY k) FROM range(32) r(k)) AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM b
"""
