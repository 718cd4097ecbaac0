"""Zstandard web archives (.warc.zst): one frame a record, after a leading skippable frame that holds the dictionary.

`write_archives` turns rows into archives of bounded size, each a binary value; `read_archives` loads the dictionary
from the leading frame, decodes a frame for each record and validates headers, lengths and payload digests.
`save_archives` and `load_archives` put such values into files of a shared folder and read files back through Spark.

Defined cases: a null payload counts as empty, a null URL is written as `about:blank`; of records with equal payloads
of at least `min_bytes`, those with the largest id are responses (all of them, if a row is repeated) and the others
revisit that id (so no tie is left open); a null id is never referred to; a very long payload is one record, in an archive
of its size; empty tables give no archives; other columns are ignored. Marks have 64 bits, so of n pages two with repeated
payloads are mixed up with probability n * n / 2 ** 65.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship
from .bitmap import bitmap_of, rows_that_may_hold

# Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC, TRAINED_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

ARCHIVE_BYTES = 4 << 20
SAMPLE_PAGES, SAMPLE_PAGE_BYTES, DICTIONARY_BYTES, LEVEL = 128, 1 << 16, 64 << 10, 3
DATE = "2024-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """The archive breaks the format."""


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample payloads; empty where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def load_dictionary(archive: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame and where the records start."""
    if len(archive) < 8:
        raise ArchiveError("no leading frame")
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC or 8 + size > len(archive):
        raise ArchiveError("no dictionary frame at the start")
    held = archive[8 : 8 + size]
    if not held:
        return None, 8
    if struct.unpack_from("<I", held.ljust(4, b"\0"))[0] == FRAME_MAGIC:
        held = zstandard.ZstdDecompressor().decompress(held)
    if struct.unpack_from("<I", held.ljust(4, b"\0"))[0] != TRAINED_MAGIC:
        raise ArchiveError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(held), 8 + size


def frame_end(data: bytes, at: int) -> int:
    """End of the frame that starts at `at`, by its block headers."""
    if at + 6 > len(data) or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ArchiveError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if at + 3 > len(data):
            raise ArchiveError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last = bool(head & 1)
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ArchiveError("a frame is cut off")
    return at


def record(page_id: int | None, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without payload if refers_to is given."""
    target = urllib.parse.quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%-._~")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {payload_bytes}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode() + (payload or b"" if refers_to is None else b"")
    return VERSION + "".join(f"\r\n{line}" for line in [*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (names in lower case), HTTP head and payload of a record, after checking them."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION or not gap:
        raise ArchiveError(f"no record: {version[:20]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"header line {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [name for name in REQUIRED if name.lower() not in headers]:
        raise ArchiveError(f"no header {missing[0]}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"record {headers['warc-record-id']} has a wrong length")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ArchiveError(f"record {headers['warc-record-id']} holds no response")
    return {"headers": headers, "http": http, "payload": payload}


def _ident(value: str) -> int | None:
    body = value.removeprefix("<urn:page:").removesuffix(">")
    return None if body == "None" else int(body)


def read_record(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page_id, payload bytes, hex digest, type, refers_to, stored payload) of a record, checked."""
    found = parse_record(data)
    headers, payload = found["headers"], found["payload"]
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    size, kind = int(headers["x-payload-length"]), headers["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError(f"record {headers['warc-record-id']}: payload and digest differ")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers or "warc-profile" not in headers):
        raise ArchiveError(f"record {headers['warc-record-id']} is no right revisit")
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"record {headers['warc-record-id']}: type {kind}")
    return _ident(headers["warc-record-id"]), size, digest, kind, _ident(headers["warc-refers-to"]) if kind == "revisit" else None, payload


def records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, a frame each."""
    dictionary, at = load_dictionary(archive)
    opener = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(archive)
    while at < len(archive):
        end = frame_end(archive, at)
        yield opener.decompress(view[at:end])
        at = end


def sample_dictionary(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> bytes:
    """A dictionary from at most SAMPLE_PAGES pages of at most SAMPLE_PAGE_BYTES, those with the smallest hashed ids."""
    keyed = pages.select(F.xxhash64(id_col).alias("h"), F.col(payload_col).alias("payload")).where(F.octet_length("payload").between(1, SAMPLE_PAGE_BYTES))
    bound = keyed.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    if bound is None:
        return b""
    rows = keyed.where(F.col("h") <= bound).orderBy("h", "payload").limit(SAMPLE_PAGES).collect()
    return build_dictionary([row["payload"].encode() for row in rows])


_PLANNED = ["page_id", "url", "payload", "payload_bytes", "digest", "refers_to"]


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to) for each row; revisits have no payload.

    Only ids, URLs and digests are shuffled. Bitmaps of the revisits tell the responses, which are read from the pages as
    they are; the few of these that a bitmap can't tell are found by a join.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    rows = rows.withColumn("mark", F.xxhash64("page_id", "digest"))
    slim = materialize(rows.drop("payload"), "page-digests")
    newest = slim.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    revisits = materialize(slim.join(newest.select("digest", "newest"), "digest").where("newest is not null and not newest <=> page_id").withColumnRenamed("newest", "refers_to"), "revisits")
    broadcast = pages.sparkSession.sparkContext.broadcast
    of_revisits = broadcast(bitmap_of(revisits.select("mark")))
    plain = rows_that_may_hold(rows, "mark", of_revisits, False)
    unclear = materialize(rows_that_may_hold(slim, "mark", of_revisits, True).join(revisits.select("mark").distinct(), "mark", "left_anti").select("mark").distinct(), "unclear")
    out = plain.withColumn("refers_to", F.lit(None).cast("long")).select(*_PLANNED).unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")).select(*_PLANNED))
    if unclear.isEmpty():
        return out
    rest = rows_that_may_hold(rows, "mark", broadcast(bitmap_of(unclear)), True).join(unclear, "mark", "left_semi")
    return out.unionByName(rest.withColumn("refers_to", F.lit(None).cast("long")).select(*_PLANNED))


def write_archives(planned: DataFrame, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, data): archives of about archive_bytes from the rows of plan_records."""
    ship(planned.sparkSession)

    def run(batches):
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
        part, number = TaskContext.get().partitionId(), 0
        head = dictionary_frame(dictionary)
        frames, size = [head], 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                frame = packer.compress(record(*(value.as_py() for value in row)))
                frames.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": [f"pages-{part:05d}-{number:05d}.warc.zst"], "data": [b"".join(frames)]})
                    frames, size, number = [head], 0, number + 1
        if size:
            yield pa.RecordBatch.from_pydict({"archive": [f"pages-{part:05d}-{number:05d}.warc.zst"], "data": [b"".join(frames)]})

    return planned.select(*_PLANNED).mapInArrow(run, "archive string, data binary")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) for each record of the archives."""
    ship(archives.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + with_payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + with_payload]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for found in records(data.as_py()):
                    rows.append(read_record(found)[: len(names)])
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.select("data").mapInArrow(run, schema)


def save_archives(archives: DataFrame, folder: str) -> int:
    """Write each archive to a file of `folder`, which every executor must see at the same path; how many there are."""

    def run(rows):
        import os

        for row in rows:
            target = os.path.join(folder, row["archive"])
            with open(f"{target}.part{TaskContext.get().taskAttemptId()}", "wb") as out:
                out.write(row["data"])
            os.replace(out.name, target)
            yield 1

    return archives.rdd.mapPartitions(run).sum()


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, data) of the .warc.zst files below path, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data"))
