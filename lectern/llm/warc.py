"""Dictionary-compressed web archives.

An archive (``.warc.zst``) opens with a skippable frame that holds a Zstandard
dictionary trained on records of this very archive; each record follows as a
frame of its own, compressed with that dictionary, so that one record can be
read by its offset. Payloads that were archived before become ``revisit``
records without the payload.

Rows are decided by a grouped minimum over digests; the payloads themselves are
not shuffled while the table of repeated digests is short (its rows are
counted), else they are dealt by salted digest. Each task writes archives of
bounded size to the shared folder under a name of its own; the list of archives
is a Spark table, so it names the files of successful attempts only.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_ROWS, new_folder, stored

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "urn:lectern:unknown"

SALTS = 16


def decide(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Columns page_id, url, payload, payload_digest, first_id (null: not a copy).

    A null payload is empty. Among payloads of ``min_bytes`` and more that are equal, the
    smallest page_id is ``first_id``; rows that repeat this page_id count as the same page and
    are all responses. Null page_ids never are the first of a group with other ids.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    firsts = stored(
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n"),
        "warc-firsts",
    )
    if firsts.count() <= BROADCAST_ROWS // 4:
        joined = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        spread = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        joined = salted.join(spread, ["digest", "salt"], "left")
    copy = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", F.lower(F.hex("digest")).alias("payload_digest"),
        F.when(copy, F.col("first_id")).alias("first_id"),
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, first_id, date: str) -> bytes:
    """One record; a revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() if first_id is not None else head.encode() + payload
    uri = (url or NO_URL).replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if first_id is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if first_id is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first_id, digest))]
        fields.append(("X-Refers-To-Page", str(first_id)))
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int, training_bytes: int) -> zstd.ZstdCompressionDict:
    """Trained on records spread evenly over the archive; too few for that: their first bytes as they are."""
    step = max(1, -(-sum(map(len, records)) // training_bytes))
    samples = [r[: max(size, 1024) * 4] for r in records[::step]]
    try:
        return zstd.train_dictionary(size, samples, k=256, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[:size], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], size: int, training_bytes: int, level: int) -> bytes:
    made = dictionary(records, size, training_bytes)
    packed = zstd.ZstdCompressor(level=level).compress(made.as_bytes())
    made.precompute_compress(level=level)
    one = zstd.ZstdCompressor(level=level, dict_data=made, write_checksum=True)
    frames = b"".join(map(one.compress, records))
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed + frames


def write_archives(
    decided: DataFrame,
    folder: str | None = None,
    *,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = 16 << 20,
    dictionary_bytes: int = 32 << 10,
    training_bytes: int = 3 << 20,
    level: int = 3,
) -> DataFrame:
    """Write the archives; returns their list (path, records, bytes). An empty table gives none."""
    folder = folder or new_folder(decided.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = archive(waiting, dictionary_bytes, training_bytes, level)
            with files.open_output_stream(f"{top}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "records": [len(waiting)], "bytes": [len(data)]}
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, digest, first_id = row
                made = record(page_id, url, payload.encode(), digest, first_id, date)
                waiting.append(made)
                size += len(made)
                if size >= archive_bytes:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    columns = decided.select("page_id", "url", "payload", "payload_digest", "first_id")
    return stored(columns.mapInArrow(write, "path string, records long, bytes long"), "warc-list")


def frames(data: bytes) -> Iterator[bytes]:
    """The records of one archive."""
    made, at = None, 0
    magic, size = struct.unpack_from("<II", data)
    if magic == DICTIONARY_MAGIC:
        raw = data[8 : 8 + size]
        made = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw)
        at = 8 + size
    reader = zstd.ZstdDecompressor(dict_data=made) if made else zstd.ZstdDecompressor()
    while at < len(data):
        one = reader.decompressobj()
        parts, step = [], 1 << 16
        while not one.eof:
            if at >= len(data):
                raise ValueError("the last record is cut off")
            parts.append(one.decompress(data[at : at + step]))
            at += step
        at = min(at, len(data)) - len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """The fields of a record, with the payload of a response checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION.decode():
        raise ValueError(f"not a record: {lines[0][:20]}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page"), "payload_bytes": length, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"),
        "record_id": fields["WARC-Record-ID"], "target_uri": fields["WARC-Target-URI"],
        "payload": payload.decode() if response else None,
    }


READ_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, target_uri string, payload string"
)


def read_archives(listed: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the listed archives, one task input per archive path."""
    schema = READ_SCHEMA if payloads else READ_SCHEMA.removesuffix(", payload string")
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = pyarrow.fs.FileSystem.from_uri(path)
                with files.open_input_stream(place) as source:
                    data = source.read()
                rows, size = [], 0
                for raw in frames(data):
                    rows.append({k: v for k, v in parse(raw).items() if k in names})
                    size += len(raw)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    tasks = max(1, min(listed.count(), 100_000))
    return listed.select("path").repartition(tasks, "path").mapInArrow(read, schema)


def archived(pages: DataFrame, folder: str | None = None, payloads: bool = True, **options) -> DataFrame:
    """Write all pages and read them back."""
    return read_archives(write_archives(decide(pages), folder, **options), payloads)
