"""WARC archives in Zstandard: written one frame a record, read back with every header checked.

An archive starts with a skippable frame that holds the dictionary, plain or itself compressed
(or without one: then its frames need none); each record is a frame of its own, compressed with it.
Archives are read as streams, a few megabytes at a time, so they may be as long as they like.

Written here, records of equal payloads are once a ``response``; the others are ``revisit`` records
whose block keeps the HTTP head (with the length of the full payload) alone. Read are archives of any
origin: WARC/1.0 and 1.1, every record type and id, HTTP heads with folded and repeated headers.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import save, scratch

DICTIONARY_MAGIC = 0x184D2A5D
#: The sixteen magics of skippable frames.
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes that are read, and decoded, at once.
CHUNK, BITE = 1 << 20, 1 << 14
#: An archive is closed beyond so many bytes; a longer record has one for itself.
ARCHIVE_BYTES = 4 << 20
#: Payloads, and bytes of each, that the dictionary is trained on (its only use of a sample).
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 14, 1 << 15
FIELDS = "record_id string, url string, record_type string, refers_to string, date string, payload_bytes long, payload_digest string, payload binary, error string"


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary; too few or too uniform samples give none (empty)."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor().compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit names the page whose response holds its payload."""
    clean = "".join(c for c in url or "" if c >= " ")
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes, first: tuple[bytes, ...]) -> dict[str, list[str]]:
    """Headers by lower-cased name, with all their values; a line that starts with white space goes on with the one before."""
    lines = re.split(rb"\r?\n", head)
    if lines[0].rstrip() not in first and not any(lines[0].startswith(f) for f in first if f.endswith(b"/")):
        raise WarcError(f"a record starts with {lines[0][:40]!r}")
    out: dict[str, list[str]] = {}
    held: list[str] | None = None
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and held:
            held[-1] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"no header line: {line[:80]!r}")
        held = out.setdefault(name.strip().lower(), [])
        held.append(value.strip())
    return out


def only(headers: dict[str, list[str]], name: str) -> str | None:
    """The value of a header that may be there once."""
    values = headers.get(name, [])
    if len(values) > 1:
        raise WarcError(f"header {name} is repeated")
    return values[0] if values else None


def length(headers: dict[str, list[str]]) -> int:
    text = only(headers, "content-length") or ""
    if not text.isascii() or not text.isdigit():
        raise WarcError(f"Content-Length is {text!r}")
    return int(text)


def check_digest(said: str | None, data: bytes, what: str) -> None:
    """A digest's algorithm and value, in base 32 or hexadecimal; one of an algorithm that isn't known here proves nothing."""
    name, _, value = (said or "").partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return
    own = hashlib.new(name, data).digest()
    if value.lower().rstrip("=") not in (own.hex(), base64.b32encode(own).decode().lower().rstrip("=")):
        raise WarcError(f"the {what}'s digest doesn't fit")


def http_parts(block: bytes) -> tuple[dict[str, list[str]], bytes]:
    """Headers and body of an HTTP message; without an empty line all of it is the head."""
    gap = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: gap.start()], block[gap.end() :]) if gap else (block.rstrip(b"\r\n"), b"")
    start, _, rest = head.partition(b"\n")
    if not re.search(rb"HTTP/[0-9]", start):
        raise WarcError(f"an HTTP message starts with {start[:40]!r}")
    lines = [x for x in re.split(rb"\r?\n", rest) if b":" in x or x[:1] in (b" ", b"\t")]  # servers send odd lines
    return fields(b"HTTP/\r\n" + b"\r\n".join(lines) if lines else b"HTTP/", (b"HTTP/",)), body


def parse_record(raw: bytes) -> tuple:
    """The FIELDS of one record; WarcError where its headers, lengths or digests don't hold.

    The payload is the HTTP body of requests and responses and the whole block of other records; a
    revisit has none, and its length is what its HTTP head says. An HTTP body is as long as its
    Content-Length, unless it is encoded or the record cut short. Without a payload digest the
    payload's own SHA-1 is given.
    """
    gap = raw.find(b"\r\n\r\n")
    if gap < 0:
        raise WarcError("the header has no end")
    headers, rest = fields(raw[:gap], VERSIONS), raw[gap + 4 :]
    if missing := [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if only(headers, h) is None]:
        raise WarcError(f"no header {', '.join(missing)}")
    block, end = rest[: length(headers)], rest[length(headers) :]
    if len(block) != length(headers) or end != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't fit the record")
    check_digest(only(headers, "warc-block-digest"), block, "block")
    kind, said = only(headers, "warc-type"), only(headers, "warc-payload-digest")
    is_http = kind in ("request", "response", "revisit") and (only(headers, "content-type") or "application/http").lower().startswith("application/http")
    http, payload = http_parts(block) if is_http and block else ({}, block)
    size: int | None = len(payload)
    if kind == "revisit":
        if only(headers, "warc-profile") is None:
            raise WarcError("a revisit has no profile")
        size = length(http) if "content-length" in http else None
        payload = None
    elif is_http:
        told = (http.get("content-length") or [""])[-1]
        changed = {"transfer-encoding", "content-encoding"} & set(http) or "warc-truncated" in headers
        if told.isascii() and told.isdigit() and int(told) != len(payload) and not changed:
            raise WarcError("the payload's length doesn't fit")
    if payload is not None and "warc-truncated" not in headers and "warc-segment-number" not in headers:
        check_digest(said, payload, "payload")
    own = (said or "").rpartition(":")[2] or (None if payload is None else digest(payload))
    return only(headers, "warc-record-id"), only(headers, "warc-target-uri"), kind, only(headers, "warc-refers-to"), only(headers, "warc-date"), size, own, payload, None


def frames(stream: BinaryIO) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time, with the dictionary of the leading skippable frame."""
    held, at, unpack, first = stream.read(CHUNK), 0, zstandard.ZstdDecompressor(), True
    if not held:
        raise WarcError("an archive is empty")

    def more(n: int) -> bool:
        """Whether ``n`` bytes lie ahead, read on where they are not held yet."""
        nonlocal held, at
        while len(held) - at < n and (got := stream.read(max(CHUNK, n))):
            held, at = held[at:] + got, 0
        return len(held) - at >= n

    while more(1):
        magic = struct.unpack("<I", held[at : at + 4])[0] if more(4) else 0
        if magic in SKIPPABLE:
            if not more(8) or not more(8 + (size := struct.unpack("<I", held[at + 4 : at + 8])[0])):
                raise WarcError("a skippable frame is cut short")
            body, at = held[at + 8 : at + 8 + size], at + 8 + size
            if first and magic == DICTIONARY_MAGIC and body:
                if body.startswith(FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            first = False
            continue
        first, frame, parts = False, unpack.decompressobj(), []
        try:
            while not frame.eof and more(1):
                part = held[at : at + BITE]  # what a frame leaves of it is small
                parts.append(frame.decompress(part))
                at += len(part) - len(frame.unused_data if frame.eof else b"")
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be read: {e}") from e
        if not frame.eof:
            raise WarcError("the last frame is cut short")
        yield b"".join(parts)


def read_archive(stream: BinaryIO | bytes, strict: bool = True) -> Iterator[tuple]:
    """The FIELDS of an archive's records. Unless ``strict``, a record that doesn't hold gives a row with its ``error`` alone;
    after a frame that can't be decoded nothing more of the archive can be read."""
    try:
        for raw in frames(io.BytesIO(stream) if isinstance(stream, bytes) else stream):
            try:
                yield parse_record(raw)
            except WarcError as e:
                if strict:
                    raise
                yield (*[None] * 8, str(e))
    except WarcError as e:
        if strict:
            raise
        yield (*[None] * 8, str(e))


#: Names under which pyarrow knows the stores that Spark has others for.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A store and a path in it, of a URI as Spark writes it."""
    scheme, colon, rest = uri.partition(":")
    if scheme == "file" and not rest.startswith("//"):
        rest = "//" + rest
    return pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest}")


def write_archives(records: DataFrame, folder: str, dictionary: bytes) -> int:
    """Write ``page_id, url, payload, refers_to`` rows, a partition's in their order; returns the records written.

    Each file is moved to its final name when complete, and a task that runs again writes the
    same names, so that lost executors leave nothing half-written or twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
        held, size, files, n = [], 0, 0, 0

        def close() -> None:
            nonlocal held, size, files
            if held:
                name = f"{root}/part-{part:06d}-{files:06d}.warc.zst"
                with store.open_output_stream(f"{root}/_{part}-{files}-{attempt}") as out:
                    out.write(leading_frame(dictionary) + b"".join(held))
                store.move(f"{root}/_{part}-{files}-{attempt}", name)
                held, size, files = [], 0, files + 1

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c for c in b.columns)):
                frame = pack.compress(record(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py()))
                if size + len(frame) > ARCHIVE_BYTES:
                    close()
                held.append(frame)
                size, n = size + len(frame), n + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_archives(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """Every record of a folder's ``*.warc.zst`` archives (FIELDS; a revisit has no payload, ``error`` is null where ``strict``)."""
    kinds = {"record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "date": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "error": pa.string()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = store_of(path)
                held, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for row in read_archive(stream, strict):
                        held.append(row)
                        size += len(row[7] or b"")
                        if size > ARCHIVE_BYTES or len(held) >= 5000:
                            yield batch(held)
                            held, size = [], 0
                yield batch(held)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return archives.select("path").mapInArrow(run, FIELDS)


def deduplicated(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads, the largest page id keeps its own; the others refer to it.

    A null html is an empty payload. A null id sorts below all others; rows that repeat an id and
    a payload are one response and no revisit of themselves.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    largest = save(rows.groupBy("sha").agg(F.max("page_id").alias("largest")))  # written: a frequent payload's join can then be split
    roles = rows.select("page_id", "sha").distinct().join(largest, "sha").filter("page_id is null or page_id < largest").filter("largest is not null")
    roles = roles.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("largest").alias("refers_to"))
    met = rows.join(roles, rows.page_id.eqNullSafe(roles.p) & (rows.sha == roles.s), "left")
    return met.select("page_id", "url", "payload", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read them back: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``.

    An empty table gives no records; a null id stays null.
    """
    spark = pages.sparkSession
    folder = f"{scratch(spark)}/warc"
    size = pages.count()
    # the sample is spread over the table by the ids' hash; about SAMPLES rows
    share = min(1.0, SAMPLES / max(1, size))
    drawn = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < share * (1 << 30)).select(F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES).alias("x"))
    dictionary = train_dictionary([bytes(r["x"]) for r in drawn.limit(2 * SAMPLES).collect() if r["x"]])
    rows = deduplicated(pages).sortWithinPartitions("page_id", "refers_to", "url", "payload")
    written = write_archives(rows, folder, dictionary)
    found = read_archives(spark, folder) if written else spark.createDataFrame([], FIELDS)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return found.select(page("record_id").alias("page_id"), "url", "record_type", page("refers_to").alias("refers_to"), "payload_bytes", "payload_digest", "payload")


def round_trip_sql() -> str:
    """DuckDB SQL of the records of ``round_trip`` over ``pages``; base 32 comes from the hexadecimal digits, 5 bits at a time."""
    nibble = lambda at: f"(instr('0123456789abcdef', substr(s, {at}, 1)) - 1)"
    five = f"((({nibble('i * 5 // 4 + 1')} * 16 + {nibble('i * 5 // 4 + 2')}) >> (3 - i * 5 % 4)) & 31)"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), m AS (SELECT s, max(page_id) AS top FROM p GROUP BY s)
        SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({five} + 1)::BIGINT, 1)), '') AS payload_digest,
        CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p JOIN m USING (s)"""
