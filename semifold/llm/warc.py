"""WARC archives: writing captures, streaming records back, assembling transactions.

Writing: each page becomes a request, a response (or a revisit, if a page with
an equal payload holds the response) and a metadata record.  Every record is a
gzip member of its own.  Tasks write files below the shared folder under names
no other attempt uses and return them; the list of files that successful tasks
returned is the archive, so files of lost or repeated attempts are never read.

Reading: files are streamed record by record along Content-Length, so memory is
bounded by the largest record.  Transactions are joined through the identifiers
in WARC-Concurrent-To by one shuffle on the capture's identifier.

Defined cases: null html is an empty payload; a null url leaves the target URI
out; repeated rows are captures of their own; of repeated rows of the page that
holds a payload's response, all are responses; an empty table gives no files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, materialize

VERSION = b"WARC/1.1"
#: Bytes after which a task starts another file.
ROLL_BYTES = 64 << 20
#: Payloads below this many bytes are stored each time.
MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = "path string, record_type string, record_id string, concurrent_to string, target_uri string, payload_bytes bigint, payload_digest string, fields map<string,string>, payload binary"


def plan_captures(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1), n_bytes, refers_to and refers_uri (null unless a revisit).

    Owners of payloads are found by a map-side-combined aggregate over digests;
    the join back is a plain equi-join that AQE may split at a hot digest.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    owners = (
        rows.filter(F.col("n_bytes") >= min_revisit)
        .groupBy("digest", "n_bytes")
        .agg(F.max(F.struct("page_id", "url")).alias("owner"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("o_digest"), F.col("n_bytes").alias("o_bytes"), "owner")
    )
    joined = rows.join(owners, (F.col("digest") == F.col("o_digest")) & (F.col("n_bytes") == F.col("o_bytes")), "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner.page_id"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "n_bytes", F.when(revisit, F.col("owner.page_id")).alias("refers_to"), F.when(revisit, F.col("owner.url")).alias("refers_uri"))


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in headers if v is not None] + [b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _capture(page_id, url, payload, digest, n_bytes, refers_to, refers_uri) -> list[bytes]:
    rid, qid, mid = (f"<urn:uuid:{uuid.uuid4()}>" for _ in range(3))
    uri = None if url is None else _clean(url)
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    revisit = payload is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    meta = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("payload-bytes", n_bytes), ("refers-to-page", refers_to)) if v is not None)
    return [
        _record([("WARC-Type", "request"), ("WARC-Record-ID", qid), ("WARC-Concurrent-To", rid), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=request")], f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode()),
        _record([("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", sha), ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To-Target-URI", _clean(refers_uri) if revisit and refers_uri is not None else None), ("Content-Type", "application/http; msgtype=response")], http + (payload or b"")),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", mid), ("WARC-Concurrent-To", rid), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/warc-fields")], meta.encode()),
    ]


def _opt(v):
    return None if v is None or v is pd.NA or v != v else v


def write_archives(captures: DataFrame, path: str) -> DataFrame:
    """Writes the captures below the folder and returns the manifest of the files."""

    def write(batches: Iterator) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                for rec in _capture(*row):
                    out.write(rec)
                    n, size = n + 1, size + len(rec)
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    cols = ["page_id", "url", "payload", "digest", "n_bytes", "refers_to", "refers_uri"]
    return materialize(captures.select(*cols).mapInArrow(write, MANIFEST), "warc-manifest")


class _Members:
    """Reads a file of gzip members as one stream, a chunk at a time."""

    def __init__(self, raw, chunk: int = 1 << 20):
        self.raw, self.chunk, self.z, self.buf, self.rest = raw, chunk, zlib.decompressobj(31), bytearray(), b""

    def _fill(self) -> bool:
        data = self.rest or self.raw.read(self.chunk)
        self.rest = b""
        if not data:
            return False
        self.buf += self.z.decompress(data)
        if self.z.eof:
            self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
        return True

    def read(self, n: int) -> bytes:
        while len(self.buf) < n and self._fill():
            pass
        if len(self.buf) < n:
            raise EOFError("truncated WARC record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (i := self.buf.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.buf)
            if not self._fill():
                if self.buf.strip():
                    raise EOFError("truncated WARC header")
                return None
        return self.read(i + len(mark))[: -len(mark)]


def iter_records(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased headers, block) of each record of a plain or gzipped stream."""
    src = _Members(raw)
    while (head := src.until(b"\r\n\r\n")) is not None:
        first, *lines = head.split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
        block = src.read(int(headers["content-length"]))
        if src.read(4) != b"\r\n\r\n":
            raise ValueError("WARC record is not followed by two line ends")
        yield headers, block


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record.  A response's payload must have the digest that its header states."""

    root = manifest.select("path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for paths in batches:
            for path in paths["path"]:
                store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(name, compression=None) as raw:
                    for h, block in iter_records(raw):
                        kind, size, digest, fields, payload = h["warc-type"], None, None, {}, None
                        if kind in ("response", "revisit"):
                            digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"payload digest of {h['warc-record-id']} does not match")
                        if kind == "metadata":
                            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
                        uri = h.get("warc-target-uri")
                        rows.append((path, kind, h["warc-record-id"], h.get("warc-concurrent-to"), None if uri is None else _unclean(uri), size, digest, fields, payload if with_payload else None))
                        held += len(block) if with_payload else 0
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pd.DataFrame(rows, columns=cols).astype({"payload_bytes": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=cols).astype({"payload_bytes": "Int64"})

    cols = [x.split()[0] for x in RECORDS.split(", ")]
    return root.repartition(max(1, root.sparkSession.sparkContext.defaultParallelism), "path").mapInPandas(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata, and what they say together.

    Records meet on the response's identifier: its own, or the one they are
    concurrent to.  A record whose partner is missing leaves that struct null.
    """
    parts = {"request": ["request"], "response": ["response", "revisit"], "metadata": ["metadata"]}
    body = F.struct("record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "fields", "payload")
    keyed = records.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), "record_type", body.alias("rec"))
    one = lambda kinds: F.any_value(F.when(F.col("record_type").isin(kinds), F.col("rec")), True)
    nested = keyed.groupBy("capture_id").agg(*[one(k).alias(n) for n, k in parts.items()])
    field = lambda k: F.col("metadata.fields")[k].cast("long")
    return nested.withColumns({"page_id": field("page-id"), "payload_bytes": field("payload-bytes"), "payload_digest": F.col("response.payload_digest"), "record_type": F.col("response.record_type"), "refers_to": field("refers-to-page")})


def archive_pages(spark: SparkSession, pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads them back and assembles the captures."""
    manifest = write_archives(plan_captures(pages), _uri(fresh_dir(spark, "warc")))
    return assemble(read_archives(manifest, with_payload))


def _uri(path: str) -> str:
    return path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"


def parse_bytes(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    return list(iter_records(io.BytesIO(data)))
