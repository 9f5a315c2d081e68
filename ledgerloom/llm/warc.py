"""Dictionary-compressed WARC archives.

Every archive starts with a skippable Zstandard frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame; each WARC
record follows as a frame of its own, so that any record can be read alone. Payloads of at least `MIN_REVISIT` bytes that
occur more than once are stored once: the row with the largest page_id is the response, the others are revisit records without payload.

The pages are written once to the shared folder with a number for each row, so that rows are told apart whatever they repeat. Which of them are
revisits is found from digests and numbers alone; the one shuffle of the payloads is by that number, which is unique and cannot be hot.

Defined results: a null html is an empty payload; a null url becomes the empty target; payloads below the bound are always responses;
a null page_id is less than any other: its rows revisit the largest page_id with the same payload, and if there is none, one of them is the response
and the others refer to null; of rows that repeat both page_id and payload one is the response and the others revisit the same page_id; an empty table gives no
archives and no rows; columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

MIN_REVISIT = 1000
#: The dictionary is trained on whole records, drawn by a hash of their contents: so many at most, of so many bytes together.
DICTIONARY_SAMPLE = 1000
SAMPLE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
SKIPPABLE = 0x184D2A5D


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; empty if there are too few to train on."""
    if len(samples) < 16 or sum(map(len, samples)) < 20 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(kind: str, page_id, url: str, payload: bytes, digest: str, size: int, number: int, refers_to=None, refers_to_number: int | None = None) -> bytes:
    """A WARC/1.1 record. Ids are name-based, by the row's number and contents, so that a task run again writes the same bytes."""
    name = lambda n, i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{n} {i} {digest}')}>"
    shown = lambda i: "" if i is None else i
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(number, page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {shown(page_id)}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to_number, refers_to)}", f"X-Refers-To-Page-Id: {shown(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class Archive:
    """Writes one archive to memory."""

    def __init__(self, dictionary: bytes):
        self.out = io.BytesIO()
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        if dictionary:
            inner = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self.out.write(struct.pack("<II", SKIPPABLE, len(inner)) + inner)

    def add(self, rec: bytes) -> None:
        self.out.write(self.zip.compress(rec))


def read_archive(data: bytes):
    """Yield (headers, payload) of each record."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        at = 8 + size
    unzip = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(data)
    while at < len(data):
        one = unzip.decompressobj()
        parts = []
        while not one.eof:
            if not (piece := view[at : at + (1 << 16)]):
                raise ValueError("truncated archive")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        rec = b"".join(parts)
        head, _, rest = rec.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def numbered(pages: DataFrame) -> DataFrame:
    """n (a number of the row's own), page_id, url, html (not null), digest and bytes of every row, written to the shared folder."""
    d = pages.select(F.monotonically_increasing_id().alias("n"), "page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return C.stash(d.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html")), "warc-rows")


def revisits(rows: DataFrame) -> DataFrame:
    """(n, keeper, keeper_n) of the numbered rows that repeat another's payload: the page_id and the number of its response. No html is read."""
    d = rows.where(F.col("bytes") >= MIN_REVISIT).select("n", "page_id", "digest")
    many = d.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "top")
    return C.stash(d.join(many, "digest").where("n <> top.n").select("n", F.col("top.page_id").alias("keeper"), F.col("top.n").alias("keeper_n")), "warc-revisits")


def sample_records(rows: DataFrame) -> list[bytes]:
    """Whole records for training: at most `DICTIONARY_SAMPLE`, as many of these as fit `SAMPLE_BYTES`."""
    drawn = C.sample(rows.where("bytes > 0").select("digest", "page_id", "n", "bytes"), DICTIONARY_SAMPLE, "digest", "page_id", "n")
    some = drawn.where(F.col("bytes") <= SAMPLE_BYTES).withColumn("through", F.sum("bytes").over(Window.orderBy("digest", "page_id", "n"))).where(F.col("through") <= SAMPLE_BYTES).select("n")  # a window over the drawn rows alone
    return [record("response", r.page_id, r.url, r.html.encode(), r.digest, r.bytes, r.n) for r in rows.join(F.broadcast(some), "n").collect()]


def write_archives(pages: DataFrame, at: str) -> DataFrame:
    """Write archives into folder `at`; returns the manifest (path, records)."""
    rows = numbered(pages)
    dictionary = train(sample_records(rows))
    again = revisits(rows)
    todo = rows.join(again, "n", "left").select("n", "page_id", "url", "html", "digest", F.col("keeper_n").isNotNull().alias("again"), "keeper", "keeper_n")

    def write(it):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(at)
        task, no, done = TaskContext.get(), 0, []
        archive, count = Archive(dictionary), 0

        def close():
            name = f"{base}/part-{task.partitionId():06d}-{no:04d}.warc.zst"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(tmp := f"{base}/.{task.taskAttemptId()}-{no}.tmp") as f:
                f.write(archive.out.getbuffer())
            store.move(tmp, name)  # a task that runs again replaces the file by the same bytes
            done.append((name, count))

        for b in it:
            for n, page_id, url, html, digest, again, keeper, keeper_n in zip(*(c.to_pylist() for c in b.columns)):
                payload = html.encode()
                archive.add(record("revisit" if again else "response", page_id, url, b"" if again else payload, digest, len(payload), n, keeper, keeper_n))
                count += 1
                if archive.out.tell() >= ARCHIVE_BYTES:
                    close()
                    archive, count, no = Archive(dictionary), 0, no + 1
        if count:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    manifest = C.stash(todo.mapInArrow(C.lean(write), "path string, records long"), "warc-manifest")
    C.discard(rows, again)
    return manifest


def read_archives(spark: SparkSession, at: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record, payloads checked against their digests."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(it):
        for b in it:
            for data in b.column(0):
                rows = []
                for h, payload in read_archive(data.as_buffer().to_pybytes()):
                    digest, whole = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "response"
                    if whole and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record: {h}")
                    size = len(payload) if whole else int(h["X-Payload-Length"])
                    rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, h["WARC-Target-URI"], size, digest, h["WARC-Type"], int(h["X-Refers-To-Page-Id"]) if h.get("X-Refers-To-Page-Id") else None))
                cols = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(at).select("content").mapInArrow(C.lean(read, rows=1), schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = C.scratch(spark, "warc")
    manifest = write_archives(C.table(spark, sf_dir, "pages"), at)
    if not manifest.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place > 1 AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN place > 1 AND payload_bytes >= 1000 THEN keeper END AS refers_to
FROM g
"""
