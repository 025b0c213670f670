"""WARC archives of Zstandard records under a dictionary, written and read by Spark.

An archive is one file. Its first frame is skippable and holds a dictionary that was trained on the archive's own
records; each record follows as a frame of its own, so one record can be read without the others. A task begins a new
archive, with a new dictionary, when one has reached its size, so that no file and no row that holds one grows with the
table. Spark's text sink writes the archives, one row and file each, with an empty skippable frame as the line end, so
that they are committed, retried and placed like any other output; the binaryFile source reads them. The sink copies a
string's bytes as they are; the reader holds every payload to its digest, so a change would not go unseen.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, rebatch, shared_folder, stored

#: Fixed values of the formats: skippable frames with and without a dictionary, the magic number of a data frame.
DICTIONARY_FRAME, EMPTY_FRAME, DATA_FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: The empty skippable frame, as text: all of its bytes are ASCII.
SEPARATOR = struct.pack("<II", EMPTY_FRAME, 0).decode("ascii")
LEAST_REVISIT = 1000
#: Duplicated payloads up to this many are known to every task: 40 bytes each, 8 MB.
MOST_BROADCAST = 200_000


def record_id(page_id: int | None) -> str:
    """A UUID of the free-form version 8 that holds the page id; the nil UUID for none."""
    if page_id is None:
        return "<urn:uuid:00000000-0000-0000-0000-000000000000>"
    h = f"{page_id & 0xFFFFFFFFFFFFFFFF:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8{h[15]}00-000000000000>"


def page_of(urn: str | None) -> int | None:
    if not urn:
        return None
    h = urn.removeprefix("<urn:uuid:").rstrip(">").replace("-", "")
    if not int(h, 16):
        return None
    x = int(h[:12] + h[13:16] + h[17], 16)
    return x - (1 << 64) if x >> 63 else x


def warc_record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with an HTTP message. A revisit's message has no body; its headers name the full payload's length and digest."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1.hex()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {uri}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record's fields, its HTTP message's fields and body."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, body = rest[:n].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), body


def build_dictionary(samples: list[bytes], size: int, most_bytes: int) -> bytes:
    """A trained dictionary of at most `size` bytes. It is trained on pieces of the samples, spread evenly if they exceed most_bytes."""
    data = b"".join(samples)
    each = max(64, min(1024, len(data) // 64))
    step = each * max(1, -(-len(data) // most_bytes))
    pieces = [data[i : i + each] for i in range(0, len(data), step)]
    try:
        return zstandard.train_dictionary(max(256, min(size, len(data) // 4)), pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # of samples that repeat too much, the headers are left
        return zstandard.train_dictionary(256, [x[i : i + 64] for x in samples[:64] for i in range(0, 512, 64)], k=64, d=8).as_bytes()


def archives(records: Iterable[bytes], *, archive_bytes: int = 64 << 20, dictionary_bytes: int = 32 << 10, sample_records: int = 400, sample_bytes: int = 4 << 20, level: int = 3) -> Iterator[bytes]:
    """Whole archives; one ends with the record that reaches archive_bytes.

    The dictionary is trained on the archive's first records, of a bounded number and size; none is left out of it.
    """
    source, sample_bytes = iter(records), min(sample_bytes, archive_bytes)
    while True:
        held: list[bytes] = []
        size = 0
        for record in source:
            held.append(record)
            size += len(record)
            if len(held) >= sample_records or size >= sample_bytes:
                break
        if not held:
            return
        dictionary = build_dictionary(held, dictionary_bytes, sample_bytes)
        compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True).compress
        out = [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary, *map(compress, held)]
        size = sum(map(len, out))
        held.clear()
        while size < archive_bytes and (record := next(source, None)) is not None:
            out.append(compress(record))
            size += len(out[-1])
        yield b"".join(out)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after the other."""
    at, decompress = 0, None
    view = memoryview(data)
    while at + 8 <= len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == DICTIONARY_FRAME:
            decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
        elif magic >> 4 == EMPTY_FRAME >> 4:
            at += 8 + size
        elif magic == DATA_FRAME:
            stream = (decompress or zstandard.ZstdDecompressor()).decompressobj()
            chunks = [stream.decompress(view[at : at + 65536])]
            fed = min(len(data), at + 65536)
            while not stream.eof:
                if fed >= len(data):
                    raise ValueError("an archive ends inside a record")
                chunks.append(stream.decompress(view[fed : fed + (1 << 20)]))
                fed = min(len(data), fed + (1 << 20))
            yield b"".join(chunks)
            at = fed - len(stream.unused_data)
        else:
            raise ValueError(f"no frame begins at byte {at}")
    if at != len(data):
        raise ValueError("an archive ends inside a frame")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to). Of equal payloads of at least `least` bytes the largest id is the response.

    A null payload counts as empty. Rows that repeat the response's id are responses, too; rows without an id are never
    revisits. Payloads are equal if their SHA-256 is. One payload may fill a third of the table.

    Ids and digests alone find the groups, aggregated in the map tasks first. Up to most_broadcast groups are sent to
    the pages, which stay where they are. More are joined by the revisits' ids and digests, which spread however large
    a group is; pages that are no revisit for sure are not joined at all.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.when((F.octet_length("payload") >= least) & F.col("page_id").isNotNull(), F.unhex(F.sha2("payload", 256))))
    thin = stored(rows.where(F.col("key").isNotNull()).select("page_id", "key"))
    latest = stored(thin.groupBy("key").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "latest"))
    if latest.count() <= most_broadcast:
        rows = rows.join(F.broadcast(latest), "key", "left")
    else:
        again = stored(thin.join(latest, "key").where("page_id <> latest").distinct())
        rows = rows.where(F.col("key").isNotNull()).join(again, ["page_id", "key"], "left").unionByName(rows.where(F.col("key").isNull()).withColumn("latest", F.lit(None).cast("long")))
    refers = F.when(F.col("latest") != F.col("page_id"), F.col("latest"))
    return rows.select("page_id", "url", "payload", F.unhex(F.sha1("payload")).alias("sha1"), refers.alias("refers_to"))


def write_archives(rows: DataFrame, path: str, **how) -> None:
    """Archives under path, of rows (page_id, url, payload, sha1, refers_to)."""
    schema = pa.schema([("archive", pa.binary())])

    def run(batches):
        def records():
            for batch in batches:
                for page_id, url, payload, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield warc_record(page_id, url, payload, sha1, refers_to)

        for archive in archives(records(), **how):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], schema=schema)

    made = rows.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(run, "archive binary")
    made.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record under path.

    A response's length and digest are worked out from its payload and must agree with its header; a revisit has the
    header's.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        def rows():
            for batch in batches:
                for content in as_bytes(batch.column(0)):
                    for fields, http, body in map(parse_record, read_archive(content)):
                        kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                        if kind == "response" and (len(body) != n or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError("a record's payload isn't what its header says")
                        yield page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), body if kind == "response" else None, n, digest, kind, page_of(fields.get("WARC-Refers-To"))

        return rebatch(rows(), schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **how) -> DataFrame:
    """Writes pages as archives under path (the shared folder if none) and reads them back. An empty table gives no record."""
    spark = pages.sparkSession
    path = path or shared_folder(spark)
    write_archives(with_revisits(pages, id_col, url_col, payload_col), path, **how)
    return read_archives(spark, path)
