"""WARC archives: a writer of gzip members, and a reader that splits at any byte.

Writer: every task writes one archive, one gzip member a record, under a name of its own;
the names of the files that count come back as rows, so a retried or speculative task
leaves nothing that is read.

Reader: tasks get byte ranges and own the records whose member starts inside, however far it
runs on. A range that begins inside a file scans for the gzip magic, decodes the member there
and validates its WARC header. As an archive may lie uncompressed inside a record of another, a
candidate counts only if the members after it follow on without a gap, each with a valid header,
to the end of the file or for ``CHAIN`` bytes: bytes that deflate stores raw are broken by a block
header every 65,535, so no member inside a record reaches that far. From then on members
follow one another. Bytes that no valid member covers are skipped and can be listed: ``lost_bytes``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, pieces

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
CHUNK = 1 << 20
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
READ = RECORDS + ", path string, offset long, length long"
#: Compressed bytes over which the members after a candidate are followed: two stored blocks of deflate.
CHAIN = 2 * 65_540
#: Header fields that a record must have (the format's).
NEEDED = (b"warc-type", b"warc-record-id", b"content-length")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> bytes:
    """A header value on one line."""
    return " ".join((value or "").split()).encode()


def encode_record(record_id: str, record_type: str, target_uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record as one gzip member. A revisit has the HTTP header only; digest and length are of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    head = [VERSION[:-2], b"WARC-Type: " + record_type.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">", b"WARC-Date: 1970-01-01T00:00:00Z"]
    if target_uri is not None:
        head.append(b"WARC-Target-URI: " + _line(target_uri))
    if record_type == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <" + (refers_to or "").encode() + b">"]
    head += [b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def header_fields(head: bytes) -> dict[bytes, bytes]:
    """Fields of a record's header, by lower-case name; ValueError if it is no WARC header."""
    lines = head.split(b"\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    if not lines[0].startswith(b"WARC/") or any(k not in fields for k in NEEDED) or not fields[b"content-length"].isdigit():
        raise ValueError("no WARC header")
    return fields


def decode_record(data: bytes) -> dict:
    """Fields of one decoded record; ValueError if it is none, or shorter than its header says."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = header_fields(head if gap else b"")
    if len(rest) < int(fields[b"content-length"]):
        raise ValueError("the record is cut")
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get(b"content-type", b"").startswith(b"application/http") else (b"", b"", block)
    kind, text = fields[b"warc-type"].decode(), lambda k: fields[k].decode() if k in fields else None
    bare = lambda k: (text(k) or "").strip("<>") or None
    if kind == "revisit":
        declared = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        digest, n, payload = (text(b"warc-payload-digest") or "").rpartition(":")[2], declared[0] if declared else None, None
    else:
        digest, n = base32_sha1(payload), len(payload)
    return {"record_id": bare(b"warc-record-id"), "record_type": kind, "target_uri": text(b"warc-target-uri"), "refers_to": bare(b"warc-refers-to"), "payload_digest": digest, "payload_bytes": n, "payload": payload}


#: Hadoop's names of stores that Arrow knows under other names.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a Hadoop path, and the path in it. ValueError names a scheme that Arrow lacks."""
    scheme, colon, rest = uri.partition(":")
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}" if colon else uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"archives can't be reached by tasks at {uri}: give an opener for it") from e


def _writer(folder: str, opener):
    def write(batches):
        store, where = opener(folder)
        out, name, n, size = None, f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
        try:
            for batch in pieces(batches, 200):
                for r in batch.to_pylist():
                    if out is None:
                        store.create_dir(where, recursive=True)
                        out = store.open_output_stream(f"{where}/{name}", compression=None)  # members are gzip already
                    data = encode_record(r["record_id"], r["record_type"], r["target_uri"], r["payload"] or b"", r["refers_to"])
                    out.write(data)
                    n, size = n + 1, size + len(data)
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.record_batch({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return write


def write_warc(records: DataFrame, folder: str, opener=filesystem) -> DataFrame:
    """Write ``record_id, record_type, target_uri, refers_to, payload``; returns the written files as ``path, records, bytes``.

    A null payload is empty, a long one taken whole. Empty partitions write no file. ``opener`` gives tasks an Arrow file
    system and the path in it, for schemes that ``filesystem`` does not know; the driver tries it first.
    """
    opener(folder)
    records = records.select("record_id", "record_type", "target_uri", "refers_to", "payload")
    return materialize(records.mapInArrow(_writer(folder, opener), "path string, records long, bytes long"), "warc-files")


def members(source, start: int, end: int):
    """(offset, decoded bytes, compressed length) of each WARC member that starts in [start, end); ``source`` is seekable."""
    at, in_step = start, start == 0
    while at < end:
        if not in_step:
            at = _next_magic(source, at, end)
            if at is None:
                return
        got = _member(source, at)
        if got is None or not (in_step or _chained(source, at, at + got[1])):
            at, in_step = at + 1, False
            continue
        yield at, *got
        at, in_step = at + got[1], True


def _next_magic(source, at: int, end: int) -> int | None:
    while at < end:
        source.seek(at)
        window = source.read(CHUNK)
        found = window.find(MAGIC)
        if found >= 0:
            return at + found if at + found < end else None
        if len(window) < CHUNK:
            return None
        at += len(window) - 2
    return None


def _chained(source, first: int, at: int) -> bool:
    """Whether valid members follow one another from ``at`` until ``CHAIN`` bytes behind ``first``, or the end of the file."""
    while at - first < CHAIN:
        source.seek(at)
        if not source.read(1):
            return True
        got = _member(source, at)
        if got is None:
            return False
        at += got[1]
    source.seek(at)
    return source.read(3) in (MAGIC, b"")


def _member(source, at: int) -> tuple[bytes, int] | None:
    """The member at ``at`` decoded, with its compressed length; None if it isn't a whole WARC record."""
    inflate, parts, fed, n, known, step = zlib.decompressobj(31), [], 0, 0, False, 4096
    while not inflate.eof:
        source.seek(at + fed)
        data = source.read(step)
        if not data:
            return None
        try:
            parts.append(inflate.decompress(data))
        except zlib.error:
            return None
        fed, n, step = fed + len(data), n + len(parts[-1]), CHUNK
        if not known and n >= 5:
            if not b"".join(parts).startswith(b"WARC/"):
                return None
            known = True
    data = b"".join(parts)
    try:
        head, _, rest = data.partition(b"\r\n\r\n")
        if len(rest) < int(header_fields(head)[b"content-length"]):
            return None
    except ValueError:
        return None
    return data, fed - len(inflate.unused_data)


def _reader(with_payload: bool, opener):
    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                store, where = opener(r["path"])
                rows, held = [], 0
                with store.open_input_file(where) as source:
                    for offset, data, length in members(source, r["start"], r["end"]):
                        row = decode_record(data) | {"path": r["path"], "offset": offset, "length": length}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(data) if with_payload else 300
                        if held > 16 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return read


SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes`` of the archives that a path or glob names, by Hadoop's listing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return spark.createDataFrame([(x.getPath().toString(), x.getLen()) for x in found if not x.isDirectory()], "path string, bytes long")


def read_warc(files: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True, opener=filesystem) -> DataFrame:
    """Records of ``files(path, bytes)``, read by byte ranges of ``split_bytes``: ``record_id, record_type,
    target_uri, refers_to, payload_digest, payload_bytes, payload, path, offset, length`` (of the member).

    Digest and length of a record with a payload are computed from it, a revisit's are the declared ones. Damaged and cut
    members give no rows; ``lost_bytes`` finds them. A record of any length is one row. No files give no rows.
    """
    spark = files.sparkSession
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    ranges = ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start")
    return ranges.mapInArrow(_reader(with_payload, opener), READ)


def lost_bytes(records: DataFrame, files: DataFrame) -> DataFrame:
    """``path, offset, bytes`` of every stretch of ``files(path, bytes)`` that no record of ``records(path, offset, length)`` covers."""
    ends = records.select("path", F.col("offset").alias("a"), (F.col("offset") + F.col("length")).alias("b"))
    edges = ends.union(files.select("path", F.col("bytes").alias("a"), F.col("bytes").alias("b")))
    before = F.coalesce(F.max("b").over(Window.partitionBy("path").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return edges.withColumn("offset", before).where("a > offset").select("path", "offset", (F.col("a") - F.col("offset")).alias("bytes"))


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0, split_bytes: int = 8 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page, read the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri``.

    A null html is an empty payload, a long one is taken whole, a null url has no target. Of pages with equal payloads of at
    least ``min_revisit_bytes`` the one with the largest id is the response (rows repeated under that id are responses too),
    the others revisit it; a row with a null id revisits when a known id has its payload. Smaller payloads are all responses.
    An empty table gives an empty result. Bytes that can't be read back raise.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("same", F.when(F.octet_length("payload") >= min_revisit_bytes, F.sha2("payload", 256)))
    # Who revisits whom is settled on ids and digests alone; payloads are then joined by id, so equal ones don't meet in one task.
    known = materialize(pages.select("page_id", "same").where("same IS NOT NULL").groupBy("page_id", "same").agg(F.count("*").alias("n")), "known")
    first = known.groupBy("same").agg(F.max("page_id").alias("first"), F.sum("n").alias("n")).where("n > 1 AND first IS NOT NULL").select("same", "first")
    revisits = known.join(first, "same").where("NOT first <=> page_id").select(F.col("page_id").alias("id"), F.col("same").alias("digest"), "first")
    revisits = materialize(revisits, "revisits")
    pages = pages.join(revisits, pages["page_id"].eqNullSafe(revisits["id"]) & (pages["same"] == revisits["digest"]), "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    files = write_warc(pages.select(
        name("page_id").alias("record_id"), F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(F.col("first").isNotNull(), name("first")).alias("refers_to"), "payload",
    ), fresh_path(spark, "warc"))
    records = materialize(read_warc(files, split_bytes, with_payload=False).drop("payload"), "records")
    if lost := lost_bytes(records, files).limit(3).collect():
        raise ValueError(f"archives have damaged or cut records: {lost}")
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri")
