"""WARC archives of pages: writer with revisit records, and a sequential reader.

An archive is a sequence of gzip members, one record each. The reader decompresses a stream chunk by chunk, frames each
record by its Content-Length, and verifies block and payload digests; it holds one record at most. Files are opened
through pyarrow's file systems by URI, so that any store that the shared folder lies in will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared_dir

CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, name: str, uri: str, payload: bytes, digest: str, refers_to: str | None, level: int = 6) -> bytes:
    """One gzip member with one record. A revisit holds the HTTP head only; its Content-Length tells the payload's size."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class Members:
    """The gzip members of a stream, one after the other, decompressed in pieces of chunk bytes at most."""

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK) -> None:
        self.stream, self.chunk, self.raw, self.held, self.unpack = stream, chunk, b"", b"", None

    def begin(self) -> bool:
        """Go to the next member; false at the end of the stream."""
        self.raw = self.raw or self.stream.read(self.chunk)
        self.unpack = zlib.decompressobj(31) if self.raw else None
        return bool(self.raw)

    def more(self) -> bytes:
        """The next piece of the member; empty at its end, where what stands behind it is kept for the next one."""
        while not self.unpack.eof:
            data = self.raw or self.stream.read(self.chunk)
            piece = self.unpack.decompress(data, self.chunk)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if piece:
                return piece
            if not data and not self.unpack.eof:
                raise ValueError("truncated gzip member")
        return b""

    def until(self, mark: bytes) -> bytes:
        """The bytes up to mark, which is passed over."""
        while (at := self.held.find(mark)) < 0:
            if not (piece := self.more()):
                raise ValueError("a header has no end")
            self.held += piece
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next size bytes, piece by piece."""
        while size:
            piece = self.held or self.more()
            if not piece:
                raise ValueError("Content-Length and member disagree")
            self.held = piece[size:]
            piece = piece[:size]
            size -= len(piece)
            yield piece

    def end(self) -> None:
        """Two line breaks and nothing else must be left of the member."""
        rest = self.held
        while piece := self.more():
            rest += piece
            if len(rest) > 4:
                break
        if rest != b"\r\n\r\n":
            raise ValueError("Content-Length and member disagree")
        self.held = b""


def read_records(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each record, names in lower case. Wrong framing or digests raise ValueError.

    A member is framed by its Content-Length as it is decompressed, and both digests run along; the payload alone is held. A
    record may leave the block digest out, which then isn't checked; a response has to have a payload digest.
    """

    def headers(data: bytes) -> dict[str, str]:
        lines = data.decode("utf-8").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    member = Members(stream, chunk)
    while member.begin():
        first = member.until(b"\r\n\r\n")
        if not first.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head = headers(first)
        whole, own, front, payload = hashlib.sha1(), hashlib.sha1(), b"", None
        for piece in member.pieces(int(head["content-length"])):
            whole.update(piece)
            if payload is None:
                front += piece
                if (at := front.find(b"\r\n\r\n")) < 0:
                    continue
                front, piece, payload = front[:at], front[at + 4 :], []
            own.update(piece)
            payload.append(piece)
        member.end()
        if payload is None:
            raise ValueError("a block has no HTTP header")
        digest = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        if head.get("warc-block-digest", digest(whole)) != digest(whole):
            raise ValueError("block digest differs")
        if head["warc-type"] == "response" and head["warc-payload-digest"] != digest(own):
            raise ValueError("payload digest differs")
        yield head, headers(front), b"".join(payload)


def _name(value: object) -> str:
    return "" if value is None else str(value)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write one archive per partition to folder (a URI); returns (path, records) of the archives written.

    Of equal payloads of at least least_bytes bytes the record with the smallest id is the response and the others revisit
    it; rows that repeat this id are all responses, and so are rows without an id. Payloads are equal when SHA-256 and
    length are. Null bodies count as empty, null addresses as empty addresses, line breaks in them are encoded.
    """
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    p = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("body"))
    p = p.withColumn("key", F.unhex(F.sha2("body", 256))).withColumn("size", F.octet_length("body"))
    first = p.where(F.col("size") >= least_bytes).groupBy("key", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = p.join(first.select("key", "size", "first"), ["key", "size"], "left").select("id", "url", "body", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        path, n, out = f"{at}/{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            for page, url, data, kept in zip(*(b.column(i) for i in range(4)), strict=True):
                if out is None:
                    out = store.open_output_stream(path, compression=None)
                page, kept, data = page.as_py(), kept.as_py(), data.as_py()
                again = kept is not None and page is not None and page != kept
                uri = url.as_py().replace("\r", "%0D").replace("\n", "%0A")
                out.write(record_bytes("revisit" if again else "response", _name(page), uri, data, digest_of(data), _name(kept) if again else None))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    return materialize(marked.mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str, id_type: T.DataType = T.LongType()) -> DataFrame:
    """One row per record of the archives (path, records): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits)."""
    kind = id_type if isinstance(id_type, T.IntegralType) else T.StringType()
    whole = isinstance(kind, T.IntegralType)
    schema = T.StructType([T.StructField("page_id", kind), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", kind), T.StructField("payload", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)

    def ident(text: str | None) -> int | str | None:
        name = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return None if not name else int(name) if whole else name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, rows, held = 0, [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for head, http, payload in read_records(stream):
                        again = head["warc-type"] == "revisit"
                        rows.append((ident(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), ident(head.get("warc-refers-to")) if again else None, None if again else payload))
                        n, held = n + 1, held + len(payload)
                        if held > 1 << 23 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                            rows, held = [], 0
                if n != want:
                    raise ValueError(f"{path} has {n} records instead of {want}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(parts).mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read them back; see write_archives and read_archives."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, id_col, url_col, body_col, least_bytes), folder, pages.schema[id_col].dataType)
