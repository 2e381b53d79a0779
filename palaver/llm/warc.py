"""WARC archives: written as whole-file gzip streams, normalised to one gzip member a record, and read back by index.

``write_archives`` makes WARC records of pages and writes them as monolithic gzip files, the shape many tools produce.
``normalise`` inflates each such file once, as a stream, rewrites every record as a member of its own, and writes a
sidecar index of offsets beside the new file. ``read_archives`` reads records by their index entries, so one large
archive is read by as many tasks as there are index slices.

Of records with equal payloads the one with the largest page id is the response and the others are revisits of it.

Files go below the folder named by ``spark.checkpoint.dir``, through pyarrow's file systems, so any shared store works.
A task writes under a name of its own attempt and renames at its end; a task that is run again replaces its file. What
a reader sees is listed from the paths that the finished tasks returned.

Defined cases: a null payload is empty; a null page id is kept as none and loses against any other; rows equal in id
and payload are all responses when no larger id has that payload; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import shared_folder

LEAST_PAYLOAD = 0
SALTS = 16
READ = 1 << 20
INDEX_SLICE = 2_000
READ_SLICE = 8 << 20
LEVEL = 4
DATE = "2026-01-01T00:00:00Z"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of a plain path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def classify(pages: DataFrame, least: int = LEAST_PAYLOAD, page_id: str = "page_id", url: str = "url",
             html: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to) of every row."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Only digests that occur twice can make revisits; the copies of one payload are dealt over several tasks.
    largest = (
        rows.filter(F.length("payload") >= least).groupBy("digest")
        .agg(F.max("page_id").alias("latest"), F.count("*").alias("copies")).filter(F.col("copies") > 1)
        .select("digest", "latest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(largest, ["digest", "salt"], "left")
    revisit = F.coalesce(F.col("latest") != F.coalesce(F.col("page_id"), F.lit(-(1 << 63))), F.lit(False))
    return joined.select(
        "page_id", "url", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("latest")).alias("refers_to"), F.col("digest").alias("sha1"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).otherwise(F.lit(b"")).alias("payload"))


def record(row: dict) -> bytes:
    """One WARC record with its closing blank lines."""
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + row["payload"]
    page = "none" if row["page_id"] is None else row["page_id"]
    target = json.dumps(row["url"])[1:-1] if row["url"] is not None else ""
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE),
        *([("WARC-Target-URI", target)] if row["url"] is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-Payload-Length", row["payload_bytes"]),
        *([("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"),
           ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
          if row["refers_to"] is not None else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def split_records(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of inflated bytes; no more than one record and one part is held."""
    held = bytearray()
    needed = None
    for part in parts:
        held += part
        while True:
            if needed is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                needed = end + 4 + int(parse_head(bytes(held[:end]))["Content-Length"]) + 4
            if len(held) < needed:
                break
            yield bytes(held[:needed])
            del held[:needed]
            needed = None
    if held:
        raise ValueError("the archive ends within a record")


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in bounded parts."""
    engine = zlib.decompressobj(31)
    while data := stream.read(READ):
        while data:
            yield engine.decompress(data, READ)
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data
                engine = zlib.decompressobj(31)


def member(data: bytes) -> bytes:
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


class Attempt:
    """Files of one task attempt: written beside their final names, moved there when complete."""

    def __init__(self, folder: str):
        self.files, self.folder = file_system(folder)
        self.uri = folder
        self.moves: list[tuple[str, str]] = []
        self.files.create_dir(self.folder, recursive=True)

    def open(self, name: str):
        temporary = posixpath.join(self.folder, f".{name}-{uuid.uuid4().hex}")
        self.moves.append((temporary, posixpath.join(self.folder, name)))
        return self.files.open_output_stream(temporary)

    def commit(self) -> None:
        for temporary, final in self.moves:
            self.files.move(temporary, final)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write each partition as one monolithic archive. Returns (path, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, sink, count = None, None, 0
        engine = zlib.compressobj(1, zlib.DEFLATED, 31)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    attempt = Attempt(folder)
                    sink = attempt.open(name)
                sink.write(engine.compress(record(row)))
                count += 1
        if sink is not None:
            sink.write(engine.flush())
            sink.close()
            attempt.commit()
            yield pa.RecordBatch.from_pydict({"path": [posixpath.join(folder, name)], "records": [count]})

    return records.mapInArrow(write, "path string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives record by record. Returns the index: (path, offset, length), also written beside each file as
    JSON lines."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = file_system(path)
                name = posixpath.basename(place)
                attempt = Attempt(folder)
                offset, entries = 0, []
                target = posixpath.join(folder, name)
                with files.open_input_stream(place, compression=None) as source, attempt.open(name) as sink, \
                        attempt.open(f"{name}.index") as index:
                    for whole in split_records(inflate(source)):
                        packed = member(whole)
                        sink.write(packed)
                        head = parse_head(whole[:whole.find(b"\r\n\r\n")])
                        entry = {"id": head["WARC-Record-ID"], "offset": offset, "length": len(packed)}
                        index.write((json.dumps(entry) + "\n").encode())
                        entries.append((offset, len(packed)))
                        offset += len(packed)
                attempt.commit()
                # The index of one archive: some bytes a record.
                for start in range(0, len(entries), INDEX_SLICE):
                    part = entries[start:start + INDEX_SLICE]
                    yield pa.RecordBatch.from_pydict({"path": [target] * len(part), "offset": [e[0] for e in part],
                                                      "length": [e[1] for e in part]})

    return archives.select("path").mapInArrow(rewrite, "path string, offset long, length long")


def read_archives(index: DataFrame) -> DataFrame:
    """Records by their index entries. A response whose payload does not have its digest is an error."""

    def page(value: str) -> int | None:
        number = value.removeprefix("<urn:page:").removesuffix(">")
        return None if number == "none" else int(number)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*[column.to_pylist() for column in batch.columns]):
                if path != opened:
                    if source is not None:
                        source.close()
                    files, place = file_system(path)
                    source, opened = files.open_input_file(place), path
                whole = zlib.decompress(source.read_at(length, offset), 31)
                end = whole.find(b"\r\n\r\n")
                head = parse_head(whole[:end])
                body = whole[end + 4:end + 4 + int(head["Content-Length"])]
                payload = body[body.find(b"\r\n\r\n") + 4:]
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"damaged payload at {offset} of {path}")
                rows.append((
                    page(head["WARC-Record-ID"]),
                    json.loads(f'"{head["WARC-Target-URI"]}"') if "WARC-Target-URI" in head else None,
                    head["WARC-Type"], page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None,
                    digest, int(head["WARC-Page-Payload-Length"]), payload))
            names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        if source is not None:
            source.close()

    # As many tasks as the archives' bytes ask for: the index rows alone look too small to Spark for more than one.
    size = index.select(F.sum("length")).first()[0] or 0
    slices = index.repartitionByRange(max(1, -(-size // READ_SLICE)), "path", "offset")
    return slices.select("path", "offset", "length").mapInArrow(read, RECORD_SCHEMA + ", payload binary")


def archive(spark: SparkSession, pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Pages written to archives, normalised, and read back as records."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    # The finished files are named by small tables, so no task writes an archive twice because a reader asks again.
    written = f"{folder}/written"
    write_archives(classify(pages, least), f"{folder}/monolithic").write.parquet(written)
    archives = spark.read.parquet(written)
    archives = archives.repartition(max(1, archives.count()))
    normalise(archives, f"{folder}/records").write.parquet(f"{folder}/index")
    return read_archives(spark.read.parquet(f"{folder}/index"))
