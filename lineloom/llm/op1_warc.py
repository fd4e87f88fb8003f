"""WARC archives: a sequential reader, and the writer that makes archives for it.

A file has one gzip member per record. The reader takes the file in pieces of READ bytes, decompresses each member
incrementally, reads the header up to its blank line, then exactly Content-Length bytes as the block, and verifies the
block's digest as the bytes come in. One task reads one file from front to back; nothing but the record at hand is held.

Records are returned in the order of the file. A wrong digest gives digest_ok false and a missing one null; the record is
returned all the same. A truncated or damaged member gives one row with `error` set and no payload, and the reader goes on
at the next gzip member. A record whose header can't be read, in a member of several records or in an uncompressed file,
gives such a row too, and the reader goes on at the next line that begins with "WARC/". Headers are HEAD bytes long at
most. What a Content-Length spans is one record, whatever it looks like.

The writer archives rows (page_id, url, html): null html is written as an empty block under the header WARC-Truncated:
unspecified and read back as null; a null url or id has no header and comes back null. Line ends in a url, which no header
can hold, are written as spaces. Repeated rows are repeated records; rows of equal ids or urls are told apart by nothing
but their order. A very long page is one record, held whole by its task. An empty table gives archives without records.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import shared

READ, LEVEL, BATCH, HEAD = 1 << 16, 3, 8 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "path string, record_offset long, record_type string, page_id long, url string, content_length long, payload_sha1 string, digest_ok boolean, truncated string, payload binary, error string"

ORACLE = """
SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS content_length, sha1(coalesce(html, '')) AS payload_sha1, true AS digest_ok, html FROM pages
"""


def filesystem(uri: str):
    """(file system, path) of a URI that executors can open: file, hdfs, s3 and whatever else pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One record as a gzip member."""
    block = (html or "").encode()
    digest = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = [
        "WARC/1.1",
        "WARC-Type: resource",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{url}/{digest}')}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {url}"] if url is not None else []),
        *([f"Page-ID: {page_id}"] if page_id is not None else []),
        *(["WARC-Truncated: unspecified"] if html is None else []),
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Block-Digest: {digest}",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def digest_matches(declared: str | None, sha1: bytes) -> bool | None:
    """Whether a labelled digest (sha1, as base 32 or hex) is that of the block; None if there is none of that kind."""
    if not declared or not declared.lower().startswith("sha1:"):
        return None
    value = declared[5:].strip()
    return value.upper() in (base64.b32encode(sha1).decode(), sha1.hex().upper())


class WarcReader:
    """Records of one stream, one after the other, as dicts."""

    def __init__(self, stream, piece: int = READ):
        self.stream, self.piece = stream, piece
        self.raw, self.base, self.over = b"", 0, False  # compressed bytes not used yet, and their offset in the file

    def _more(self) -> bool:
        got = b"" if self.over else self.stream.read(self.piece)
        self.over = not got
        self.raw += got
        return bool(got)

    def _drop(self, n: int) -> None:
        self.raw, self.base = self.raw[n:], self.base + n

    def _member(self) -> Iterator[bytes]:
        """Decompressed pieces of the member at hand; what follows it stays in raw. A damaged one is put back whole."""
        z, start, taken = zlib.decompressobj(31), self.base, []
        while not z.eof:
            if not self.raw and not self._more():
                self.raw, self.base = b"".join(taken), start
                raise EOFError("the file ends inside a member")
            given, self.raw = self.raw, b""
            taken.append(given)
            try:
                out = z.decompress(given)
            except zlib.error:
                self.raw, self.base = b"".join(taken), start
                raise
            self.raw = z.unused_data
            self.base += len(given) - len(self.raw)
            if out:
                yield out

    def _plain(self) -> Iterator[bytes]:
        while self.raw or self._more():
            out, self.raw = self.raw, b""
            self.base += len(out)
            yield out

    def _seek_member(self) -> None:
        """On to what looks like a gzip header, or the end."""
        while True:
            at = self.raw.find(b"\x1f\x8b\x08")
            if at >= 0:
                return self._drop(at)
            self._drop(max(0, len(self.raw) - 2))
            if not self._more():
                return self._drop(len(self.raw))

    def __iter__(self) -> Iterator[dict]:
        while True:
            while len(self.raw) < 3 and self._more():
                pass
            if not self.raw:
                return
            start = self.base
            gz = self.raw[:2] == b"\x1f\x8b"
            try:
                yield from self._records(self._member() if gz else self._plain(), start)
            except (zlib.error, EOFError, ValueError) as e:
                yield {"record_offset": start, "error": f"{type(e).__name__}: {e}"}
                if not gz:
                    return
                self._drop(int(self.base == start))
                self._seek_member()

    def _records(self, pieces: Iterator[bytes], start: int) -> Iterator[dict]:
        held = b""

        def fill() -> bool:
            nonlocal held
            got = next(pieces, b"")
            held += got
            return bool(got)

        def header() -> dict[str, str]:
            nonlocal held
            seen = 0
            while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                seen = len(held)
                if seen > HEAD:
                    raise ValueError("the header is too long")
                if not fill():
                    raise EOFError("the header has no end")
            first, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("no WARC version line")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            if not head.get("content-length", "").isdigit():
                raise ValueError("no Content-Length")
            held = held[end + 4 :]
            return head

        while True:
            held = held.lstrip(b"\r\n")
            if not held:
                if fill():
                    continue
                return
            try:
                head = header()
            except ValueError as e:
                yield {"record_offset": start, "error": f"{type(e).__name__}: {e}"}
                while (at := held.find(b"\nWARC/")) < 0:
                    held = held[-5:]
                    if not fill():
                        return
                held = held[at + 1 :]
                continue
            length = int(head["content-length"])
            sha1, block, have = hashlib.sha1(), [], 0
            while have < length:
                if not held and not fill():
                    raise EOFError(f"the block ends after {have} of {length} bytes")
                piece, held = held[: length - have], held[length - have :]
                sha1.update(piece)
                block.append(piece)
                have += len(piece)
            page = head.get("page-id", "")
            yield {
                "record_offset": start, "record_type": head.get("warc-type"), "page_id": int(page) if page.lstrip("-").isdigit() else None, "url": head.get("warc-target-uri"), "content_length": length,
                "payload_sha1": sha1.hexdigest(), "digest_ok": digest_matches(head.get("warc-block-digest"), sha1.digest()), "truncated": head.get("warc-truncated"), "payload": b"".join(block),
            }


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes) of the archives written, one by each task; a task that runs again writes another file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        path = f"{folder}/part-{at.partitionId():06d}-{at.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        fs, inner = filesystem(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        records = size = 0
        with fs.open_output_stream(inner, compression=None) as out:
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    member = record(page_id, url, html)
                    out.write(member)
                    records, size = records + 1, size + len(member)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), "[\r\n]", " ").alias("url"), F.col("html").cast("string").alias("html"))
    return shared.cut(shared.small_batches(pages).mapInArrow(shared.lean(run), "path string, records long, bytes long").where("records > 0"))


def read_warc(paths: DataFrame) -> DataFrame:
    """The records of the archives in column path, one task for a file."""
    n = max(1, paths.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
            cols = [x.split() for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in cols], [c for c, _ in cols])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(inner, compression=None) as stream:
                    for row in WarcReader(stream):
                        rows.append(row | {"path": path})
                        held += len(row.get("payload") or b"")
                        if held > BATCH or len(rows) >= 5000:
                            yield out(rows)
                            rows, held = [], 0
                yield out(rows)

    return paths.select("path").coalesce(1).repartition(n).mapInArrow(shared.lean(run), SCHEMA)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages in the shared folder and reads them back."""
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared.fresh_path(spark, "warc"))
    html = F.when(F.col("truncated").isNull(), F.decode("payload", "UTF-8"))
    return read_warc(archives).select("page_id", "url", "content_length", "payload_sha1", "digest_ok", html.alias("html"))
