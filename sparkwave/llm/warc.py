"""WARC archives: a writer with revisit records and a splittable reader.

Writing: each record is a gzip member of its own. Records with equal payloads of at least ``min_bytes`` share one response,
that with the smallest key; the others are revisits that refer to it. The payload's digest is computed where the row is
read; only the smallest key of each digest is shuffled and joined back, and Spark splits a hot digest's side of the join.

Reading: archives are dealt out as byte ranges. A task looks for the gzip magic in its range, tries to decode a header
that starts with ``WARC/1.`` at each candidate, and owns every record that starts inside its range, the last one to its
end. Each member is decoded in full, so its length and CRC-32 are checked and payloads are compared with their digest.
A payload may itself hold such members, stored as they are: the writer takes their magic apart, and of other writers'
archives the first record that a range finds must be followed by another one or by the end of the file. (A whole chain of
members that ends a payload of theirs isn't told from records, if a range begins between it and its own record's start.)

Defined cases: a null payload is empty; rows with a null key are responses and refer to nothing; rows that repeat the
smallest key of a digest are all responses; an empty table gives no archives and no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir, ship_package
from .common import open_fs, unique_name

MIN_BYTES = 100
SPLIT_BYTES = 16 << 20
CHUNK = 1 << 20
PROBE = 1 << 12
MAGIC = b"\x1f\x8b\x08"
DATE = "2020-01-01T00:00:00Z"  # records carry no date of their own
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(key))}>"


def render(key: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One record. Keys stand in extension fields, as JSON, so that they come back with their type."""
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-X-Key: {json.dumps(key)}", f"WARC-X-Payload-Length: {len(payload)}"]
    if url:
        fields.append("WARC-Target-URI: " + " ".join(url.split()))
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        body += payload
    else:
        fields += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-X-Refers-To-Key: {json.dumps(refers_to)}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload (the body after its HTTP header) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _member(payload: bytes) -> bytes:
    """A gzip member. If bytes that are stored as they are would look like a record's start, such starts are taken apart:
    a flush between the first two bytes puts a block header there."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    plain = packer.compress(payload) + packer.flush()
    at = plain.find(MAGIC, 1)
    while at >= 0 and not _starts_record(plain[at:]):
        at = plain.find(MAGIC, at + 1)
    if at < 0:
        return plain
    packer, parts, done = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0
    while (at := payload.find(MAGIC, done)) >= 0:
        parts += [packer.compress(payload[done : at + 1]), packer.flush(zlib.Z_SYNC_FLUSH)]
        done = at + 1
    return b"".join(parts) + packer.compress(payload[done:]) + packer.flush()


FILES = T.StructType([T.StructField("name", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def first_of_equal(df: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """``df`` as (key, url?, payload, digest, refers_to): refers_to is the smallest key with an equal payload, or null."""
    sized = F.octet_length("payload") >= min_bytes
    rows = df.withColumn("digest", F.sha2(F.col("payload"), 256))
    light = rows.where(sized & F.col("key").isNotNull()).select("digest", "key")
    firsts = light.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(firsts, "digest", "left")
    return joined.withColumn("refers_to", F.when(sized & (F.col("key") != F.col("first")), F.col("first"))).drop("first")


def write(df: DataFrame, key: str, payload: str, *, url: str | None = None, min_bytes: int = MIN_BYTES, folder: str | None = None) -> str:
    """Write one record per row as ``.warc.gz`` archives, one for each task; their folder.

    The folder's ``manifest`` names the archives of the attempts that succeeded; others are ignored.
    """
    spark = df.sparkSession
    ship_package(spark)
    folder = folder or scratch_dir(spark, "warc")
    rows = df.select(F.col(key).alias("key"), (F.col(url) if url else F.lit(None)).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = first_of_equal(rows, "key", "payload", min_bytes).select("key", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size, records = unique_name(".warc.gz"), None, 0, 0
        fs, path = open_fs(f"{folder}/{name}")
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    k, link, data, digest, refers = (batch.column(c)[i].as_py() for c in range(5))
                    if out is None:
                        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(path, compression=None)
                    member = _member(render(k, link, data, digest, refers))
                    out.write(member)
                    size, records = size + len(member), records + 1
        finally:
            if out is not None:
                out.close()
        if records:
            yield pa.RecordBatch.from_pylist([{"name": name, "bytes": size, "records": records}], schema=_arrow(FILES))

    rows.mapInArrow(run, FILES).write.parquet(f"{folder}/manifest")
    return folder


class _Range:
    """Bytes of a file from an offset on, read in chunks; ``base`` is the offset of ``data``."""

    def __init__(self, file, start: int):
        self._file, self.base, self.data = file, start, b""
        file.seek(start)

    def more(self) -> bool:
        chunk = self._file.read(CHUNK)
        self.data += chunk
        return bool(chunk)

    def drop(self, n: int) -> None:
        self.data, self.base = self.data[n:], self.base + n


def _starts_record(data: bytes) -> bool:
    """Whether a gzip member at the start of ``data`` decodes to a record header."""
    try:
        return zlib.decompressobj(31).decompress(data[:PROBE], 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every record that starts in the bytes from ``start`` to before ``stop``."""
    window, follows = _Range(file, start), start == 0  # of a record that is known, or of the file's start
    while window.base < stop:
        at = window.data.find(MAGIC)
        if at < 0:
            window.drop(max(0, len(window.data) - len(MAGIC) + 1))
            if not window.more():
                return
            continue
        window.drop(at)
        if window.base >= stop:
            return
        while len(window.data) < PROBE and window.more():
            pass
        if not _starts_record(window.data):
            window.drop(1)
            continue
        unpack, parts, fed = zlib.decompressobj(31), [], 0
        try:
            while not unpack.eof:
                if fed == len(window.data) and not window.more():
                    raise ValueError(f"the archive ends inside the record at byte {window.base}")
                parts.append(unpack.decompress(window.data[fed:]))
                fed = len(window.data)
        except zlib.error as error:
            raise ValueError(f"the record at byte {window.base} is damaged: {error}") from error
        end = len(window.data) - len(unpack.unused_data)
        while not follows and len(window.data) - end < PROBE and window.more():
            pass
        if not follows and len(window.data) > end and not _starts_record(window.data[end : end + PROBE]):
            window.drop(1)  # a member inside a payload
            continue
        yield window.base, b"".join(parts)
        window.drop(end)
        follows = True


def splits(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(name, start, stop) of byte ranges that cover the archives of a folder."""
    starts = F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))
    ranges = spark.read.parquet(f"{folder}/manifest").select("name", "bytes", F.explode(starts).alias("start"))
    return ranges.select("name", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("stop"))


def read(spark: SparkSession, folder: str, *, key_type: str = "long", split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """One row per record: key, url, record_type, refers_to, payload_bytes, payload_digest, archive, offset and payload.

    Of a revisit, payload_bytes and payload_digest are those of the payload it refers to and payload is null. With
    ``payloads`` false, payloads are checked but not returned.
    """
    ship_package(spark)
    names = [("key", "string"), ("url", "string"), ("record_type", "string"), ("refers_to", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("archive", "string"), ("offset", "long"), *([("payload", "binary")] if payloads else [])]
    schema = T.StructType([T.StructField(n, {"string": T.StringType(), "long": T.LongType(), "binary": T.BinaryType()}[k]) for n, k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            for name, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, path = open_fs(f"{folder}/{name}")
                rows, size = [], 0
                with fs.open_input_file(path) as file:
                    for offset, record in records_in(file, start, stop):
                        fields, payload = parse(record)
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        kind = fields["warc-type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"the payload at byte {offset} of {name} differs from its digest")
                        length = len(payload) if kind == "response" else int(fields["warc-x-payload-length"])
                        key, refers = json.loads(fields["warc-x-key"]), json.loads(fields.get("warc-x-refers-to-key", "null"))
                        row = {"key": None if key is None else str(key), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": None if refers is None else str(refers), "payload_bytes": length, "payload_digest": digest, "archive": name, "offset": offset}
                        if payloads:
                            row["payload"] = payload if kind == "response" else None
                        rows.append(row)
                        size += len(record) if payloads else 300
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    ranges = splits(spark, folder, split_bytes)
    ranges = ranges.repartition(max(1, ranges.count()), "name", "start")
    found = ranges.mapInArrow(run, schema)
    return found.withColumn("key", F.col("key").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))
