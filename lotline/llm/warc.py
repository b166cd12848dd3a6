"""WARC archives in seekable Zstandard bundles.

Each task appends its records to bundles: records are grouped into frames of
bounded size, every frame is compressed by itself, and a footer in the format
of Zstandard's seekable files (a skippable frame with the sizes of all frames)
closes the bundle, so a reader finds any frame, and any ``zstd`` decoder still
reads the whole.  The index maps each record to its bundle, frame and place in
the frame.  Payloads are not shuffled: which pages are revisits is decided on
their digests.

Bundles are written through ``pyarrow.fs`` (local and shared folders, HDFS, S3,
GCS).  A task attempt uses names of its own, and the index lists the bundles of
attempts that succeeded, so a repeated task leaves no record twice.
"""
from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.frames import scratch_path, written

FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 25
#: Least payload that is stored once only.
REVISIT_BYTES = 1000
#: Revisits are broadcast up to this number, else joined by a shuffle.
BROADCAST_REVISITS = 1_000_000
#: Fixed values of the formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = ("page_id long, record_id string, bundle string, frame int, frame_offset long, frame_length int, "
         "record_offset int, record_length int")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str,
                refers_to: int | None, date: str) -> bytes:
    """A response record with its payload, or a revisit record with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)),
              ("WARC-Date", date), ("WARC-Target-URI", target),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
              ("Page-ID", "" if page_id is None else page_id)]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", refers_to)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a frame."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = head + 4
        stop = start + int(fields["Content-Length"])
        yield fields, data[start:stop]
        at = stop + 4


class BundleWriter:
    """One bundle: frames as they fill up, then the seek table."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        self.uri, self.frame_bytes = uri, frame_bytes
        self.files, path = _open(uri)
        self.out = self.files.open_output_stream(path, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.offset, self.held, self.places = 0, [], []
        self.length = 0

    def add(self, key: tuple, record: bytes) -> Iterator[tuple]:
        """Index rows of the frame that this record closes, if it does."""
        self.places.append((key, self.length, len(record)))
        self.held.append(record)
        self.length += len(record)
        if self.length >= self.frame_bytes:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.held:
            return
        frame = self.compressor.compress(b"".join(self.held))
        self.out.write(frame)
        for key, at, size in self.places:
            yield (*key, self.uri, len(self.sizes), self.offset, len(frame), at, size)
        self.sizes.append((len(frame), self.length))
        self.offset += len(frame)
        self.held, self.places, self.length = [], [], 0

    def close(self) -> Iterator[tuple]:
        yield from self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()


def seek_table(source: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of each frame, from the footer of a bundle."""
    size = source.size()
    source.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    source.seek(size - 9 - 8 * frames)
    table, out, at = source.read(8 * frames), [], 0
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def fetch(bundle: str, frame_offset: int, frame_length: int, record_offset: int, record_length: int) -> bytes:
    """One record by its index entry: reads and decompresses its frame alone."""
    files, path = _open(bundle)
    with files.open_input_file(path) as f:
        f.seek(frame_offset)
        plain = zstandard.ZstdDecompressor().decompress(f.read(frame_length))
    return plain[record_offset:record_offset + record_length]


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  *, level: int = 3, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                  date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` to bundles in ``folder``; returns their index, a written table.

    Of rows with equal payloads (by length and SHA-1) of at least 1000 bytes,
    those with the largest id are responses and the others revisits of them;
    smaller payloads are always responses.  A null payload is empty; a null id
    is smaller than any; repeated rows are records each; other columns are
    ignored.  Ids are integers.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    digests = written(rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "size", "digest"), "digests")
    groups = written(digests.groupBy("size", "digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1").drop("n"), "groups")
    revisits = written(digests.join(groups, ["size", "digest"]).where("keeper > coalesce(page_id, keeper - 1)").select(
        F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("keeper").alias("refers_to")).distinct(), "revisits")
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    marked = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")

    def write(batches):
        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        bundle, count, made = None, 0, []

        def batch_of(found):
            names = [x.split()[0] for x in INDEX.split(", ")]
            types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            kinds = [types[x.split()[1]] for x in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

        for batch in batches:
            for page_id, url, payload, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    bundle = BundleWriter(f"{stem}-{count:04d}.warc.zst", frame_bytes, level)
                    count += 1
                record = make_record(page_id, url, payload or b"", size, digest, refers_to, date)
                made += bundle.add((page_id, record_id(page_id, digest)), record)
                if bundle.offset >= bundle_bytes:
                    made += bundle.close()
                    bundle = None
            if made:
                yield batch_of(made)
                made = []
        if bundle is not None:
            made += bundle.close()
        if made:
            yield batch_of(made)

    return written(marked.mapInArrow(write, INDEX), "index")


def read_bundles(spark: SparkSession, bundles: DataFrame) -> DataFrame:
    """The records of the bundles named in column ``bundle``, in any order.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload (null for a revisit).  A stored payload that differs from its
    digest raises.
    """
    from hashlib import sha1

    def read(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload", pa.binary())])
        number = lambda x: int(x) if x else None
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = _open(uri)
                with files.open_input_file(path) as f:
                    for offset, packed, _ in seek_table(f):
                        f.seek(offset)
                        rows = []
                        for fields, block in parse_records(zstandard.ZstdDecompressor().decompress(f.read(packed))):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                            kind = fields["WARC-Type"]
                            if kind == "response" and (len(payload) != size or sha1(payload).hexdigest() != digest):
                                raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {uri}")
                            rows.append((number(fields["Page-ID"]), fields["WARC-Target-URI"], size, digest, kind,
                                         number(fields.get("Refers-To-Page-ID")), payload if kind == "response" else None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # a bundle a task: names are so short that adaptive execution would put all of them into one
    names = written(bundles.select("bundle").distinct(), "bundles")
    return names.repartition(max(1, names.count())).mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages to bundles (in the scratch folder by default) and read them back."""
    spark = pages.sparkSession
    index = write_bundles(pages, folder or scratch_path(spark, "warc"), **options)
    return read_bundles(spark, index)
