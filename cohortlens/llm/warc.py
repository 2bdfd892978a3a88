"""WARC archives: written with one gzip member per record, read sequentially.

A payload that occurs in several records is stored once, as the ``response``
of the least page id; the others become ``revisit`` records that carry its
digest and refer to that response.  The reader inflates member by member
through a fixed-size buffer, frames each record by its Content-Length and
checks block and payload digests.

Files go to a folder all executors share, through ``pyarrow.fs``.  A task
writes under names of its own attempt, and only the names in the manifest,
which Spark commits once per task, are ever read: files of lost attempts are
never seen.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import attach, ship, store_of, written
from cohortlens.session import scratch_dir

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class WarcError(ValueError):
    """A record that is cut short, badly framed or of another digest than stated."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URI_SAFE, errors='surrogatepass')}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {_PROFILE}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


_URI_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


class _Inflater:
    """Bytes of a file of gzip members, inflated piece by piece."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.out, self.z = stream, b"", bytearray(), None
        self.ended = False   # the present member is over

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(_READ)
            if not self.raw:
                if self.z is not None and not self.z.eof:
                    raise WarcError("gzip member cut short")
                return False
        if self.z is None:
            self.z = zlib.decompressobj(31)
        try:
            self.out += self.z.decompress(self.raw, _READ)
        except zlib.error as e:
            raise WarcError(f"bad gzip data: {e}") from None
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        self.ended = self.z.eof
        return True

    def next_member(self) -> bool:
        """To the next member; false at the end of the file."""
        if self.out:
            raise WarcError("bytes after the record in its gzip member")
        while self.z is not None and not self.ended:
            if not self._more():
                raise WarcError("gzip member cut short")
            if self.out:
                raise WarcError("bytes after the record in its gzip member")
        self.z, self.ended = None, False
        return self._more()

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        """Everything up to ``mark``, which is dropped."""
        start = 0
        while (i := self.out.find(mark, start)) < 0:
            start = max(0, len(self.out) - len(mark) + 1)
            if self.ended or len(self.out) > most or not self._more():
                raise WarcError("header without end")
        head = bytes(self.out[:i])
        del self.out[:i + len(mark)]
        return head

    def exactly(self, n: int) -> bytes:
        buf = io.BytesIO()
        while True:
            take = min(n - buf.tell(), len(self.out))
            buf.write(self.out[:take])
            del self.out[:take]
            if buf.tell() == n:
                return buf.getvalue()
            if self.ended or not self._more():
                raise WarcError("record shorter than its Content-Length")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, in order."""
    inflater = _Inflater(stream)
    while inflater.next_member():
        lines = inflater.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("no WARC version line")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        try:
            n = int(headers["content-length"])
        except (KeyError, ValueError):
            raise WarcError("no Content-Length") from None
        block = inflater.exactly(n)
        if inflater.exactly(4) != b"\r\n\r\n":
            raise WarcError("record not closed after its Content-Length")
        if headers.get("warc-block-digest") != "sha256:" + hashlib.sha256(block).hexdigest():
            raise WarcError(f"block digest differs in {headers.get('warc-record-id')}")
        yield headers, block


def _page(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parsed(headers: dict[str, str], block: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    kind = headers["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise WarcError(f"payload digest differs in {headers.get('warc-record-id')}")
    return {"page_id": _page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"),
            "record_type": kind, "payload_digest": digest, "payload": payload,
            "refers_to": _page(headers.get("warc-refers-to"))}


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(folder)
        store.create_dir(at, recursive=True)
        out, name, size, n = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [size]}, _MANIFEST)

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                member = record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"),
                                r["digest"], r["refers_to"], r["revisit"])
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()
    return run


_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                     ("payload_digest", pa.string()), ("payload", pa.binary()), ("refers_to", pa.int64()),
                     ("archive", pa.string())])


def _reader(folder: str, batch_bytes: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(folder)
        for batch in batches:
            for entry in batch.to_pylist():
                rows, size = [], 0
                n = 0
                with store.open_input_stream(f"{at}/{entry['archive']}", compression=None) as stream:
                    for headers, block in read_records(stream):
                        rows.append(parsed(headers, block) | {"archive": entry["archive"]})
                        n, size = n + 1, size + len(block)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, size = [], 0
                if n != entry["records"]:
                    raise WarcError(f"{entry['archive']}: {n} records, {entry['records']} written")
                yield pa.RecordBatch.from_pylist(rows, _RECORD)
    return run


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, revisit, refers_to): which pages revisit which.

    Of pages with equal payloads of at least ``min_bytes`` those with the
    least page id are responses and the others, null ids included, revisit
    it; if all their ids are null all are responses.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html, 256).alias("digest"),
                        F.octet_length(html).alias("size"))
    repeated = (rows.filter(F.col("size") >= min_bytes).groupBy("digest")
                .agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
                .filter("n > 1 AND least IS NOT NULL"))
    rows = attach(rows, written(repeated, "payloads"), "digest", "n")
    revisit = F.col("least").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("least")))
    return rows.select("page_id", "url", "html", "digest", revisit.alias("revisit"),
                       F.when(revisit, F.col("least")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into archives of
    about ``archive_bytes`` under ``folder``, which all executors must share;
    returns the stored manifest (archive, records, bytes).

    A null html is an empty payload, a null url leaves out the target URI;
    repeated rows are records of their own, extra columns are ignored, an
    empty table gives no archive.
    """
    ship(pages.sparkSession)
    rows = plan_records(pages, min_bytes)
    return written(rows.mapInArrow(_writer(folder, archive_bytes), "archive string, records long, bytes long"),
                   "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload, refers_to, archive)
    of every record in the archives of the manifest, read sequentially.  A
    revisit has a null payload.  Damage raises ``WarcError``."""
    ship(manifest.sparkSession)
    files = manifest.select("archive", "records").repartition(max(1, manifest.count()))
    return files.mapInArrow(_reader(folder), "page_id long, url string, record_type string, payload_digest string, "
                                             "payload binary, refers_to long, archive string")


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the scratch folder and read them back.

    Returns per record page_id, payload_bytes and payload_digest of the full
    payload (a revisit's from the response it refers to), record_type,
    refers_to and url as the archive has it.  A null html is an empty payload;
    a null page_id stays null and refers like any other; repeated rows are
    records each; pages that tie for the least page_id are all responses;
    extra columns are ignored; an empty table gives no row.
    """
    folder = scratch_dir(pages.sparkSession, "llm", "warc")
    found = read_archives(write_archives(pages, folder, min_bytes, archive_bytes), folder)
    found = written(found.select("page_id", "payload_digest", "record_type", "refers_to", "url",
                                 F.octet_length("payload").cast("long").alias("stored_bytes")), "records")
    revisits = found.filter("record_type = 'revisit'").groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"))
    sizes = (found.filter("record_type = 'response'").groupBy("payload_digest")
             .agg(F.max("stored_bytes").alias("full_bytes")).join(revisits, "payload_digest"))
    # the weight counts revisits; responses never need their size looked up
    found = found.withColumn("wanted", F.when(F.col("record_type") == "revisit", F.col("payload_digest"))
                             .otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.monotonically_increasing_id())
                                                 .cast("string"), F.lit("-"), "payload_digest")))
    sizes = written(sizes.withColumnRenamed("payload_digest", "wanted"), "sizes")
    found = attach(found, sizes, "wanted", "n")
    return found.select("page_id", F.coalesce("stored_bytes", "full_bytes").alias("payload_bytes"), "payload_digest",
                        "record_type", "refers_to", "url")
