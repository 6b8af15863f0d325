"""WARC archives in Zstandard (operator 8): one frame a record, the dictionary in a leading skippable frame.

Writing: Python workers build whole archives of bounded size and Spark's own text writer commits each
as one file, on any file system Spark knows, so a lost executor only costs its tasks. A worker holds one
archive, of ``archive_bytes`` or a single longer record. The writer ends
each file with its line separator, which is chosen to be an empty skippable frame and thus legal.
Reading: Spark's ``binaryFile`` source hands over whole archives; headers, lengths and digests of every
record are checked, and a fault raises ``ValueError``.

Cases: a null html is an empty payload, still a record. Repeated payloads of ``min_revisit`` bytes or
more become revisits of the one with the largest id; shorter ones are all responses. Null urls give an
empty target URI. An empty table gives no archive and an empty result. Columns other than id, url and
html are ignored, whatever their names. A null id stays null and is never revisited; rows that share an id
are separate records.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

# Fixed values of the Zstandard and WARC formats.
DICT_MAGIC = 0x184D2A5D
SKIP_MAGIC_LOW, SKIP_MAGIC_HIGH = 0x184D2A50, 0x184D2A5F
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # a skippable frame without content, as ASCII text
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

STEP = 1 << 14  # bytes of an archive that are decoded at a time

ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of one WARC record; a revisit carries no block, only the length and digest of its payload."""
    digest = hashlib.sha1(payload).hexdigest().encode()
    block = b"" if refers_to is not None else payload
    name = b"<urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id)
    clean = " ".join((url or "").split()).encode()
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + name,
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + clean,
        b"WARC-Payload-Digest: sha1:" + digest,
        b"X-Payload-Length: %d" % len(payload),
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from a bounded list of samples; empty where there is too little to learn from."""
    if len(samples) < 16 or sum(map(len, samples)) < 20 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Collects records; ``finish`` gives the archive's bytes."""

    def __init__(self, dictionary: bytes, level: int = 3) -> None:
        self.parts = [struct.pack("<II", DICT_MAGIC, len(dictionary)), dictionary]
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=True)
        self.size = 0

    def add(self, raw: bytes) -> None:
        frame = self.packer.compress(raw)
        self.size += len(frame)
        self.parts.append(frame)

    def finish(self) -> bytes:
        return b"".join(self.parts)


def frames(archive: bytes) -> Iterator[bytes]:
    """The decoded content of each frame after the leading dictionary frame."""
    if len(archive) < 8:
        raise ValueError("archive shorter than a frame header")
    magic, n = struct.unpack_from("<II", archive)
    if magic != DICT_MAGIC:
        raise ValueError("archive does not start with a dictionary frame")
    at = 8 + n
    if at > len(archive):
        raise ValueError("dictionary frame is cut off")
    d = zstandard.ZstdCompressionDict(archive[8:at]) if n else None
    unpacker = zstandard.ZstdDecompressor(dict_data=d)
    view = memoryview(archive)
    while at < len(archive):
        if len(archive) - at < 4:
            raise ValueError("trailing bytes after the last frame")
        magic = struct.unpack_from("<I", archive, at)[0]
        if SKIP_MAGIC_LOW <= magic <= SKIP_MAGIC_HIGH:
            if len(archive) - at < 8:
                raise ValueError("skippable frame is cut off")
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            if at > len(archive):
                raise ValueError("skippable frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one, start, parts = unpacker.decompressobj(), at, []
        try:
            while not one.eof and at < len(archive):
                parts.append(one.decompress(view[at : at + STEP]))
                at = min(len(archive), at + STEP)
        except zstandard.ZstdError as e:
            raise ValueError(f"bad frame at byte {start}: {e}") from e
        if not one.eof:
            raise ValueError(f"frame at byte {start} is cut off")
        at -= len(one.unused_data)  # less than a step is handed over again
        yield b"".join(parts)


def page_number(urn: bytes) -> int | None:
    if not (urn.startswith(b"<urn:page:") and urn.endswith(b">")):
        raise ValueError(f"bad record id {urn[:80]!r}")
    return None if urn[10:-1] == b"null" else int(urn[10:-1])


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, str, bytes]:
    """(id, payload length, digest, type, refers_to, url, payload) of one record, after checking it."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    try:
        n, kind, total = int(fields[b"content-length"]), fields[b"warc-type"].decode(), int(fields[b"x-payload-length"])
        rid, digest = fields[b"warc-record-id"], fields[b"warc-payload-digest"].decode()
    except (KeyError, ValueError) as e:
        raise ValueError(f"missing or bad header: {e}") from e
    if rest[n:] != b"\r\n\r\n" or len(rest) != n + 4:
        raise ValueError("block length differs from Content-Length")
    payload = rest[:n]
    if not digest.startswith("sha1:"):
        raise ValueError("unknown digest algorithm")
    if kind == "response":
        if n != total or hashlib.sha1(payload).hexdigest() != digest[5:]:
            raise ValueError("payload differs from its digest or length")
        refers = None
    elif kind == "revisit":
        if n or b"warc-refers-to" not in fields:
            raise ValueError("bad revisit record")
        refers = page_number(fields[b"warc-refers-to"])
    else:
        raise ValueError(f"unknown record type {kind}")
    return page_number(rid), total, digest[5:], kind, refers, fields.get(b"warc-target-uri", b"").decode(), payload


def write_archives(
    pages: DataFrame, where: str, *, min_revisit: int = 1000, archive_bytes: int = 16 << 20,
    dict_bytes: int = 16 << 10, sample_records: int = 200, sample_bytes: int = 4096,
) -> None:
    """Write ``pages(page_id, url, html)`` as archives below ``where``.

    An archive ends once its frames reach ``archive_bytes``. Its dictionary is trained on the first
    ``sample_bytes`` of at most ``sample_records`` records that come first in it; this bound concerns
    the dictionary alone, every record is written whole.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"))
    refers = F.lit(None).cast("long").alias("refers_to")
    # Small payloads take no part in the join. Repeated ones are written first: adaptive execution can split a hot
    # payload in a join of two tables, but not in one with an aggregate on a side.
    large = base.where(F.octet_length("payload") >= min_revisit).withColumn("digest", F.sha1("payload"))
    winners = large.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1").select("digest", "winner")
    winners = Workspace(pages.sparkSession, "warc-winners").keep(winners, "winners")
    marked = large.join(winners, "digest", "left").select(
        "page_id", "url", "payload", F.when(F.col("winner") != F.col("page_id"), F.col("winner")).alias("refers_to")
    ).unionByName(base.where(F.octet_length("payload") < min_revisit).select("page_id", "url", "payload", refers))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[bytes]) -> ArchiveWriter:
            w = ArchiveWriter(train_dictionary([r[:sample_bytes] for r in held], dict_bytes))
            for r in held:
                w.add(r)
            return w

        def out(w: ArchiveWriter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.finish()], pa.binary())], ["archive"])

        held, writer, held_bytes = [], None, 0
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            for i, u, p, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = record(i, u, p, ref)
                if writer is None:
                    held.append(raw)
                    held_bytes += len(raw)
                    if len(held) < sample_records and held_bytes < archive_bytes:
                        continue
                    writer, held, held_bytes = packed(held), [], 0
                else:
                    writer.add(raw)
                if writer.size >= archive_bytes:
                    yield out(writer)
                    writer = None
        if held:
            writer = packed(held)
        if writer is not None:
            yield out(writer)

    files = marked.mapInArrow(build, "archive binary").select(F.col("archive").cast("string").alias("value"))
    files.write.mode("overwrite").option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(where)


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    """Every record of the archives below ``where``: ROW, then url and payload (null for revisits)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                got, held = [], 0
                for raw in frames(blob.as_buffer().to_pybytes()):
                    i, n, digest, kind, refers, url, payload = parse(raw)
                    got.append((i, n, digest, kind, refers, url, payload if kind == "response" else None))
                    held += len(raw)
                    if held > 4 << 20:
                        yield pack(got)
                        got, held = [], 0
                if got:
                    yield pack(got)

    def pack(got: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).where("length > 0").select("content")
    return files.mapInArrow(rows, ROW + ", url string, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read every record back (ROW, url, payload)."""
    ws = Workspace(spark, "warc")
    write_archives(pages, ws.path("archives"))
    return read_archives(spark, ws.path("archives"))
