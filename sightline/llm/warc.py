"""WARC archives with one Zstandard dictionary per file.

An archive is a skippable frame that holds the dictionary, then one compressed frame per record, so a record can be
read alone. The dictionary of each archive is built from the records of that archive. Archives lie in a folder that all
executors share; a task that is run again writes files of new names, and readers only follow the table of files that
the finished tasks returned, so a lost executor leaves at most unused files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import saved, shared_folder, utf8

#: Fixed values of the format: the magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
LEAST_REVISIT = 1000
RECORD_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to (null for a response).

    Of payloads that are equal and at least ``least`` bytes long, the row with the largest page_id is the response and
    the others revisit it; rows alike in that page_id are all responses. A null html is an empty payload. A null page_id
    counts as smaller than any other; if no row of a group has one, all are responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8(F.col("html").cast("string")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("length", F.octet_length("payload"))
    groups = rows.where(F.col("length") >= least).groupBy(F.col("payload_digest").alias("group_digest"), F.col("length").alias("group_length")).agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")
    )
    groups = groups.where("n > 1 and keeper is not null").drop("n")
    same = (F.col("payload_digest") == F.col("group_digest")) & (F.col("length") == F.col("group_length"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.join(groups, same, "left").select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def _header(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, length: int) -> bytes:
    name = "" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Payload-Length: {size}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {length}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes, and at most a tenth of the records' (256 at least), from an archive's own
    records: trained where they are enough samples, else the beginnings of the records, whose heads and markup are alike."""
    total = sum(map(len, records))
    size = min(size, max(total // 10, 256))
    if len(records) > 16:
        try:
            return zstandard.train_dictionary(size, records, k=256, d=8, steps=1, threads=0, accel=4).as_bytes()
        except zstandard.ZstdError:  # too little text for these records
            pass
    share = max(64, size // len(records))
    return b"".join(r[:share] for r in records)[-size:]


def _archive(records: list[bytes], dictionary_bytes: int, level: int) -> bytes:
    raw = _dictionary(records, dictionary_bytes)
    dictionary = zstandard.ZstdCompressionDict(raw)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
    out = io.BytesIO()
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    for record in records:
        out.write(compressor.compress(record))
    return out.getvalue()


def write_archives(
    records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = 3
) -> DataFrame:
    """Write ``records`` of :func:`record_types` as archives in ``folder``; returns the saved table (path, records, bytes).

    A task holds the records of one archive at a time: about ``archive_bytes``, or one larger record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            data = _archive(held, dictionary_bytes, level)
            with store.open_output_stream(path, compression=None) as sink:
                sink.write(data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        for rows in batches:
            for row in rows.to_pylist():
                payload, refers_to = row["payload"], row["refers_to"]
                kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
                head = _header(kind, row["page_id"], row["url"], row["payload_digest"], len(payload), refers_to, len(body))
                held.append(head + body + b"\r\n\r\n")
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return saved(records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "archives")


def _frames(data: bytes) -> Iterator[bytes]:
    """The records of one archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
    place = 8 + size
    view = memoryview(data)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while place < len(data):
        one = decompressor.decompressobj()
        record = one.decompress(view[place:])
        place = len(data) - len(one.unused_data)
        yield record


def _parsed(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size, kind = int(fields["WARC-Payload-Length"]), fields["WARC-Type"]
    if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda value: int(value) if value else None
    page = number(fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">"))
    refers_to = number(fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">"))
    return page, fields.get("WARC-Target-URI"), size, digest, kind, refers_to, body


def read_archives(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives named by ``files`` (path): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to (and payload). Every stored payload is checked against its length and digest; damage raises an error."""
    fields = RECORD_FIELDS + ([("payload", pa.binary())] if with_payload else [])
    schema = RECORD_SCHEMA + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for rows in batches:
            for path in rows.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    data = source.read()
                parsed = [_parsed(record) for record in _frames(data)]
                columns = list(zip(*parsed))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    # a stated number of partitions: a row is a whole archive, so tasks are not to be merged by the rows' size
    return files.select("path").repartition(max(1, files.count()), F.col("path")).mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, **options: int) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in ``folder`` and read them back. No pages give no archives."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    folder = folder.replace("file:///", "file:/").replace("file:/", "file:///")
    return read_archives(write_archives(record_types(pages), folder, **options), folder)
