"""WARC archives: a writer and a sequential reader, one gzip member per record.

Writing. Payload digests are computed by Spark functions; which record of equal payloads is the response is one
pre-aggregated ``max`` per digest over narrow rows, so payloads are never shuffled unless the list of revisits outgrows
its broadcast bound. Records go out through Spark's own text sink, so that task retries, speculation and any Hadoop
store work as for other tables: each gzip member ends with the high byte of its length, which is zero for members
under 16 MiB, and that byte is the sink's line separator. A larger member is followed by an empty one that ends so.

Reading. Each archive file is walked member by member with incremental zlib decompression; a record's block is framed
by its Content-Length, and block and payload digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, released, stored

#: Revisits that may be broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Records of one archive file at most.
FILE_RECORDS = 20_000
CHUNK = 1 << 16
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: The base-32 alphabet of RFC 4648 and the digits that conv() writes for it.
_CONV_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits, which are five hex digits, make four base-32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _BASE32)


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'record:{key}')}>"


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member, in a form that ends with a zero byte."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    out = packer.compress(raw) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += packer.flush()
    return out


def revisits_of(pages: DataFrame, id_col: str, least_bytes: int) -> DataFrame:
    """(id, of, refers_to), once each, of the rows that repeat the payload with the digest ``of`` of a row with a larger id."""
    narrow = stored(pages.select(F.col(id_col).alias("id"), "_digest", F.length("_payload").alias("_n")), "warc-digests")
    last = narrow.where(F.col("_n") >= least_bytes).groupBy("_digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("_rows"))
    # A row's own digest is part of the key: rows of one id with other payloads are no revisits of this one.
    found = narrow.where(F.col("_n") >= least_bytes).join(last.where("_rows > 1"), "_digest").where("id < refers_to or (id is null and refers_to is not null)")
    return found.select("id", F.col("_digest").alias("of"), "refers_to").distinct()


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    file_records: int = FILE_RECORDS,
    most_broadcast: int = MOST_BROADCAST,
) -> None:
    """Writes a record per row. A null payload is empty, a null url an empty one; other columns are ignored.

    Rows with one id and one payload are all responses, or all revisits of a larger id. A null id counts as the smallest;
    its record has no X-Row-ID and is read back with a null row_id.

    Of rows with equal payloads of at least ``least_revisit_bytes`` the one with the largest id is the response, the
    others are revisits that carry its HTTP headers and refer to it. No rows give an archive without records.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("_payload"))
    rows = rows.withColumn("_digest", sha1_base32(F.col("_payload")))
    revisits = stored(revisits_of(rows.withColumnRenamed("id", id_col), id_col, least_revisit_bytes), "warc-revisits")
    if revisits.count() <= most_broadcast:
        revisits = F.broadcast(revisits)
    rows = rows.join(revisits.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("of")), "left").drop("_id", "of")

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                out = []
                for r in batch.slice(first, 500).to_pylist():
                    body = r["_payload"]
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    revisit = r["refers_to"] is not None
                    block = http if revisit else http + body
                    headers = [
                        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(r["id"])), ("WARC-Date", date),
                        ("WARC-Target-URI", " ".join((r["url"] or "").split())), ("Content-Type", "application/http; msgtype=response"),
                        ("WARC-Block-Digest", f"sha1:{_base32(block)}"), ("WARC-Payload-Digest", f"sha1:{r['_digest']}"),
                    ]
                    if r["id"] is not None:
                        headers.append(("X-Row-ID", str(r["id"])))
                    if revisit:
                        headers += [("WARC-Profile", _IDENTICAL), ("WARC-Refers-To", record_id(r["refers_to"])), ("X-Refers-To-Row-ID", str(r["refers_to"]))]
                    out.append(member(headers, block)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    packed = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", file_records).text(path)


def members(chunks: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The gzip members of a byte stream, each as an iterator over its decompressed pieces, which has to be read out."""
    rest = b""
    while True:
        while not rest:
            rest = next(chunks, b"")
            if not rest:
                return
        state = {"rest": rest}

        def pieces(state=state):
            unpacker, data = zlib.decompressobj(31), state["rest"]
            while True:
                piece = unpacker.decompress(data)
                if piece:
                    yield piece
                if unpacker.eof:
                    state["rest"] = unpacker.unused_data
                    return
                data = next(chunks, b"")
                if not data:
                    raise ValueError("the archive ends within a gzip member")

        yield pieces()
        rest = state["rest"]


def records(content: bytes, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, in file order."""
    view = memoryview(content)
    for pieces in members(bytes(view[i : i + chunk]) for i in range(0, len(view), chunk)):
        data = bytearray()
        for piece in pieces:
            data += piece
        if not data:
            continue
        end = data.find(b"\r\n\r\n")
        if not data.startswith(b"WARC/") or end < 0:
            raise ValueError("a gzip member doesn't begin with a WARC record")
        headers = {}
        for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        if len(data) < end + 4 + size or bytes(data[end + 4 + size :]) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')}: its block isn't {size} bytes long")
        yield headers, bytes(data[end + 4 : end + 4 + size])


READ_SCHEMA = "row_id string, url string, record_id string, record_type string, refers_to_id string, refers_to_row string, payload_bytes long, payload_digest string, digests_ok boolean, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the folder's ``*.txt`` (written here) and ``*.warc.gz`` files. ``payload`` is null for revisits (and for all if payloads is false); ``payload_bytes`` of a
    revisit is that of the payload it refers to, from its HTTP headers. Files are read sequentially, one task per file
    or several; a broken frame raises ValueError, a wrong digest gives digests_ok = false.
    """

    @released
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for h, block in records(content.as_py()):
                    rows.append(_row(h, block, payloads))
                    held += len(block)
                    if held > CHUNK * 128:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc.gz}").load(path).select("content")
    return files.mapInArrow(unpack, READ_SCHEMA)


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    http, _, body = block.partition(b"\r\n\r\n")
    http_headers = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:] if b": " in x)
    size = int(http_headers.get(b"content-length", len(body)))
    kind = headers.get("warc-type", "")
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    right = headers.get("warc-block-digest", "").removeprefix("sha1:") == _base32(block)
    if kind == "response":
        right = right and stated == _base32(body) and size == len(body)
    return (
        headers.get("x-row-id"), headers.get("warc-target-uri"), headers.get("warc-record-id"), kind, headers.get("warc-refers-to"), headers.get("x-refers-to-row-id"),
        size, stated, right, body if payloads and kind == "response" else None,
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives to the shared folder and reads them back; raises if a digest doesn't verify."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, **options)
    read = read_warc(spark, path, payloads=False)
    return read.withColumn("record_type", F.when(F.col("digests_ok"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("digest mismatch in "), "record_id"))))
