"""WARC archives: a record for each page, one gzip member per record, and a sequential reader.

Pages with equal payloads of ``revisit_from`` bytes or more are written once: the page with the
largest id is the response and the others are revisits that refer to it.  Payloads are equal if
their SHA-1 and length are, as in WARC's own identical-payload-digest profile.

An archive is a binary value of bounded size, so any Spark sink can hold archives and any
store that Spark writes can keep them; files made elsewhere are read with Spark's binaryFile
source.  The reader takes an archive's members one after another, inflates each ``STEP`` bytes at
a time, frames its record by Content-Length, and recomputes the digests that the record states in
SHA-1; of a record it holds the header, a step and, if asked for, the payload.

Any record type is read.  The payload of an application/http record is what follows its HTTP
header, as it was sent (a chunked body stays chunked); that of another record is its block.
Digests, page ids and urls may be missing: page_id, refers_to and a revisit's digest are null
then.  Stated digests of other algorithms are not checked.  A record that is framed wrongly, has
no Content-Length or type, or differs from its digest is an error, with its reason and offset; the records after it are
read, unless a reader is strict.  A file is read as one binary value, so it must be below 2 GB.

A null payload is an empty one, a null url an empty target; line ends in a url are written as
%0D and %0A.  Rows with a null id are left out.  Rows that repeat an id are written each; they
refer to one another as other pages do, but a row is never a revisit of its own id.  An empty
table makes no archive, and no archive makes no row.  Other columns are left out, whatever their
names.
"""

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ARCHIVE, STEP = 16 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"


def _uri(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int, url: str, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One WARC record, uncompressed.  A revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"X-Page-Id: {page}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Member:
    """The inflated bytes of the gzip member that begins at ``at``, a step at a time."""

    def __init__(self, view: memoryview, at: int, step: int):
        self.view, self.at, self.step, self.z, self.held = view, at, step, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Whether there were more bytes to hold."""
        if self.z.eof:
            return False
        part = self.z.unconsumed_tail or self.view[self.at : self.at + self.step]
        if not len(part):
            raise ValueError("the archive ends within a member")
        self.at += 0 if self.z.unconsumed_tail else len(part)
        try:
            self.held += self.z.decompress(part, 16 * self.step)
        except zlib.error as e:
            raise ValueError(f"no gzip member: {e}") from None
        self.at -= len(self.z.unused_data)
        return True

    def head(self) -> bytes:
        """What stands before the first blank line, which goes too."""
        while b"\r\n\r\n" not in self.held:
            if not self.more():
                raise ValueError("no header")
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        return head

    def take(self, n: int):
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise ValueError("Content-Length does not frame the record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def rest(self) -> bytes:
        while len(self.held) < 5 and self.more():
            pass
        return self.held


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    out, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _sha1(said: str | None) -> str | None:
    """The bare hex of a stated SHA-1, which may be base 32 or base 16; null for other algorithms."""
    kind, _, value = (said or "").partition(":")
    if kind.lower().replace("-", "") != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _record(m: _Member, keep: bool) -> dict:
    first, *lines = m.head().decode("utf-8", "replace").split("\r\n")
    headers = _fields(lines)
    if not first.startswith("WARC/") or "warc-type" not in headers:
        raise ValueError("no WARC record")
    if not headers.get("content-length", "").isdecimal():
        raise ValueError("no Content-Length")
    http = headers.get("content-type", "").lower().startswith("application/http")
    block, payload, head, kept, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
    for piece in m.take(int(headers["content-length"])):
        block.update(piece)
        if http:
            head += piece
            head, found, piece = head.partition(b"\r\n\r\n")
            if not found:
                continue
            http = False
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    if m.rest() != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    revisit, said = headers["warc-type"] == "revisit", _sha1(headers.get("warc-payload-digest"))
    if _sha1(headers.get("warc-block-digest")) not in (None, block.hexdigest()):
        raise ValueError("the block digest differs")
    if not revisit and said not in (None, payload.hexdigest()):
        raise ValueError("the payload digest differs")
    full = _fields(head.decode("latin-1").split("\r\n")).get("content-length", "") if revisit else ""
    return {"headers": headers, "payload": b"".join(kept), "payload_bytes": int(full) if full.isdecimal() else size, "payload_digest": said if revisit else payload.hexdigest()}


PADDING, MAGIC = re.compile(rb"\0*"), re.compile(rb"\x1f\x8b\x08")


def records(archive: bytes, step: int = STEP, keep: bool = True, strict: bool = True):
    """Headers, payload (empty without keep), payload_bytes and payload_digest of an archive's records, one after another.

    Zeros between members are passed over.  A bad record raises; unless strict, it is an error with its offset, and reading
    goes on at the next member that can begin after it.
    """
    view, at = memoryview(archive), 0
    while (at := PADDING.match(view, at).end()) < len(view):
        m = _Member(view, at, step)
        try:
            yield _record(m, keep)
            at = m.at
        except ValueError as error:
            if strict:
                raise
            yield {"error": str(error), "offset": at}
            after = MAGIC.search(view, at + 1)
            at = after.start() if after else len(view)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000, size: int = ARCHIVE) -> DataFrame:
    """archive (binary), n_records: archives of about ``size`` bytes at most, or one record."""
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("payload"))
    long = rows.where(F.octet_length("payload") >= revisit_from).select("page", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    last = long.groupBy("digest", "n").agg(F.max("page").alias("refers"), F.min("page").alias("p")).where("p < refers").select("digest", "n", "refers")
    revisits = long.join(last, ["digest", "n"]).where("page < refers").select("page", "refers", "digest").distinct()
    dealt = rows.withColumn("digest", F.when(F.octet_length("payload") >= revisit_from, F.sha1("payload"))).join(revisits, ["page", "digest"], "left").select("page", "url", "payload", "refers")

    def write(batches):
        held, bytes_ = [], 0
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                m = member(record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py()))
                if held and bytes_ + len(m) > size:
                    yield pa.record_batch([pa.array([b"".join(held)], pa.binary()), pa.array([len(held)], pa.int64())], ["archive", "n_records"])
                    held, bytes_ = [], 0
                held.append(m)
                bytes_ += len(m)
        if held:
            yield pa.record_batch([pa.array([b"".join(held)], pa.binary()), pa.array([len(held)], pa.int64())], ["archive", "n_records"])

    return dealt.mapInArrow(write, "archive binary, n_records long")


def read_archives(archives: DataFrame, archive_col: str = "archive", keep_payload: bool = True, strict: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type (of any type there is), refers_to and, with keep_payload, payload (null for revisits), a row for each record.

    Unless strict, also error and offset (of its member): null but for bad records, which have nothing else.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] * keep_payload
    fields += [] if strict else [("error", pa.string()), ("offset", pa.int64())]

    def batch_of(out):
        return pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)], [n for n, _ in fields])

    def read(batches):
        for batch in batches:
            for archive in batch.column(0):
                out, held = [], 0
                for r in records(archive.as_buffer(), keep=keep_payload, strict=strict):
                    if "error" in r:
                        out.append((None,) * (len(fields) - 2) + (r["error"], r["offset"]))
                        continue
                    h = r["headers"]
                    page, refers = (int(h[k]) if h.get(k, "").lstrip("-").isdecimal() else None for k in ("x-page-id", "x-refers-to-page"))
                    out.append((page, h.get("warc-target-uri"), r["payload_bytes"], r["payload_digest"], h["warc-type"], refers) + ((None if h["warc-type"] == "revisit" else r["payload"]),) * keep_payload + ((None, None) if not strict else ()))
                    held += len(r["payload"])
                    if held >= ARCHIVE or len(out) >= 10_000:
                        yield batch_of(out)
                        out, held = [], 0
                if out:
                    yield batch_of(out)

    return archives.where(F.col(archive_col).isNotNull()).select(archive_col).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload + ", error string, offset long" * (not strict))


def read_warc_files(spark, path: str, **options) -> DataFrame:
    """Records of .warc.gz files, whoever wrote them, by any path that Spark reads."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive")), **options)


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written as archives to the shared folder, and the records read back from there."""
    return read_archives(written(write_archives(pages)), keep_payload=False, strict=True)
