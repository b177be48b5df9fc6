"""Dictionary-compressed WARC archives (operator 10).

Each task writes its pages as one archive: a skippable frame with a Zstandard
dictionary built from that archive's own records, then every record as a frame
of its own, compressed with the dictionary.  Archives are written under a
task's own name and renamed when whole, so a task that runs again replaces its
archive.  Of equal payloads one is archived and the others refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded, new_folder, shuffle_partitions, text_batches, written

#: Magic of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Bytes of a dictionary, and of the records that it is built from, for each archive.
DICTIONARY_BYTES, SAMPLE_BYTES, PIECE_BYTES = 64 << 10, 4 << 20, 64 << 10
#: Bytes of records buffered before an archive is cut, and records at most.
ARCHIVE_BYTES = 256 << 20
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1d3c52-3f0e-5b0a-9f43-1c6f6b0a7e11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _field(value) -> str:
    """A header value: no line breaks or other control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record.  A revisit has no payload, but its length and digest."""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _field(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from whole records spread over the archive, in pieces.

    Where these are too few or too much alike to train one, the pieces themselves
    are the dictionary, as raw content.
    """
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    chosen = records[::step]
    piece = max(64, min(PIECE_BYTES, sum(map(len, chosen)) // 8))
    samples = [r[i : i + piece] for r in chosen for i in range(0, len(r), piece)]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 16))
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, steps=1).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        # no trained dictionary begins like a record, so none is taken for one
        return raw if len(raw) >= 8 else b"WARC/1.1"


def archive(records: list[bytes]) -> bytes:
    import zstandard

    found = build_dictionary(records)
    packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(found) if found else None, write_checksum=True, write_content_size=True)
    stored = zstandard.ZstdCompressor(level=6).compress(found) if found else b""
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(stored)), stored, *map(packer.compress, records)])


def records_of(data: bytes):
    """The records of an archive, one frame at a time."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    stored, at = data[8 : 8 + size], 8 + size
    found = zstandard.ZstdDecompressor().decompress(stored) if stored else b""
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(found) if found else None)
    view = memoryview(data)
    while at < len(data):
        one = opener.decompressobj()
        out = [one.decompress(view[at : at + (1 << 16)])]
        taken = min(len(data), at + (1 << 16))
        while not one.eof:
            if taken >= len(data):
                raise ValueError("the archive ends within a frame")
            out.append(one.decompress(view[taken : taken + (1 << 16)]))
            taken = min(len(data), taken + (1 << 16))
        at = taken - len(one.unused_data)
        yield b"".join(out)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(folder: str):
    """Pages with their digest and what they refer to -> the archives' paths."""

    def run(batches):
        task = TaskContext.get()
        store, root = _filesystem(folder)
        held, size, number = [], 0, 0

        def cut():
            nonlocal held, size, number
            path = f"{root}/part-{task.partitionId():06d}-{number:04d}.warc.zst"
            own = f"{root}/_attempt-{task.taskAttemptId()}-{uuid.uuid4().hex}"
            with store.open_output_stream(own, compression=None) as f:
                f.write(archive(held))
            store.move(own, path)
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(k) for k in range(5)), strict=True):
                payload = (html.as_py() or "").encode()
                one = record(page.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py())
                held.append(one)
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    yield cut()
        if held:
            yield cut()

    return run


def _read(folder: str):
    """Archive paths -> what their records say, digests checked."""

    def run(batches):
        store, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows: list[tuple] = []
                for one in records_of(data):
                    fields, block = parse(one)
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind, length = fields["WARC-Type"], int(fields["X-Payload-Length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                    page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, length, digest, kind, int(refers) if refers else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Writes a record for every row below ``folder`` (a location that pyarrow's file systems reach) and returns the archives' paths.

    Null html: an empty payload.  Among payloads of ``least`` bytes or more that
    are equal, the row with the largest page_id is the response; repeated rows
    with that id are all responses.  A null page_id or url is written as an empty
    field; where all equal payloads have null ids, all are responses.  Whole
    payloads are written, however long; an empty table gives no archive.  Other
    columns are not read, so their names cannot clash.
    """
    spark = pages.sparkSession
    text_batches(spark)
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    base = base.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = base.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    large = bounded(written(large.select(F.col("digest").alias("of"), "first"), "repeated", max(6, shuffle_partitions(spark) // 8)))
    # a small payload refers to nothing; a key of its own keeps the many empty ones apart
    key = F.when(F.octet_length("html") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = base.withColumn("of", key).join(large, "of", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")).alias("refers_to"))
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    return joined.mapInArrow(_write(folder), "path string")


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row for each record."""
    return paths.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` and reads the archives back."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    return read_archives(written(write_archives(pages, folder), "paths"), folder)
