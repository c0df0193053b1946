"""WARC archives as a table of chunks.

Payloads travel as rows (record, chunk number, bytes) of bounded size from the
scan on, before any shuffle: the writer streams the chunks of a record into a gzip
member and updates its digest with each, and the reader streams a member back
into chunk rows that carry the length and SHA-1 so far. No step holds a whole
record's payload besides the page's own row as the table delivers it.

Which record keeps its payload is decided on digests alone: the largest id of
each digest, a minimum-size aggregate, joined back to the pages' ids and digests. A task sends the
chunks of a payload on once, whatever records hold it, so copies cross the shuffle without their bytes; a revisit is a row without bytes from the start. Writers name
files by attempt and the returned list of files is itself written, so a task that runs
twice leaves an unlisted file and no double records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

#: Bytes of a payload in a chunk row; bytes of a file after which a writer begins the next.
CHUNK = 1 << 18
FILE_BYTES = 1 << 30
#: Payloads of at least so many bytes are stored once.
MIN_REVISIT = 0
#: Digests whose chunks a task has sent on that it remembers, so that it needn't send those of copies.
SENT = 1 << 16
#: Fixed values of the format: a date for all records, and the profile of a record that stands for an equal payload.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_uri(page_id: str | None) -> str:
    """The id with everything but letters, digits and ``_.-~`` escaped; a null id has no last part."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def page_of(uri: str) -> str | None:
    found = re.search(r"<urn:page(?::([^>]*))?>", uri)[1]
    return None if found is None else unquote(found)


def safe_uri(url: str | None) -> str:
    """The url with everything outside printable ASCII escaped; a null url is about:blank."""
    return "about:blank" if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def record_head(page_id: str | None, url: str | None, kind: str, refers_to: str | None, n: int, digest: str) -> tuple[bytes, bytes]:
    """The WARC header, and the HTTP header that begins the block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    body = n if kind == "response" else 0
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + body}", "", ""]
    return "\r\n".join(lines).encode(), http


class Writer:
    def __init__(self, folder: str, part: int):
        self.folder, self.part, self.fs, self.path, self.file = folder, part, None, "", None
        self.records = self.bytes = 0

    def _begin(self) -> None:
        self.fs, root = pafs.FileSystem.from_uri(self.folder)
        name = f"part-{self.part:05d}-{uuid.uuid4().hex}.warc.gz"
        self.path, self.records, self.bytes = f"{self.folder}/{name}", 0, 0
        self.file = self.fs.open_output_stream(f"{root}/{name}")

    def _put(self, data: bytes) -> None:
        self.bytes += len(data)
        if data:
            self.file.write(data)

    def head(self, *args) -> None:
        if self.file is None:
            self._begin()
        self.zip = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.sha = hashlib.sha1()
        for data in record_head(*args):
            self._put(self.zip.compress(data))

    def chunk(self, data) -> None:
        self.sha.update(data)
        self._put(self.zip.compress(data))

    def tail(self) -> None:
        self._put(self.zip.compress(b"\r\n\r\n") + self.zip.flush())
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.file.close()
        self.file = None
        return self.path, self.records, self.bytes


def write(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes an archive record per row into the shared folder; returns the list of files (path, records, bytes)."""
    small_batches(pages.sparkSession)
    folder = scratch.folder("archive")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    keyed = keyed.withColumn("n", F.octet_length("payload").cast("long"))
    # a row's number only tells records that repeat an id apart
    heads = scratch.write(keyed.select(F.monotonically_increasing_id().alias("record"), "id", "url", "sha", "n"), "heads")
    end = F.greatest(F.lit(0), F.expr(f"cast((n - 1) div {CHUNK} as int)"))
    first = scratch.write(heads.where(F.col("n") >= min_revisit).groupBy("sha", "n").agg(F.max("id").alias("first")), "first")
    numbered = keyed.select("sha", "n", "payload", F.explode(F.sequence(F.lit(0), end)).alias("chunk"))
    chunks = numbered.select("sha", "n", "chunk", F.substring("payload", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("data"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of payloads that this task hasn't sent; those of a row follow one another."""
        sent: set[str] = set()
        wanted = True
        for b in batches:
            mask = []
            for sha, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if chunk == 0:
                    wanted = sha not in sent
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(sha)
                mask.append(wanted)
            yield b.filter(pa.array(mask, pa.bool_()))

    contents = chunks.mapInArrow(once, chunks.schema).repartition("sha", "n").groupBy("sha", "n", "chunk").agg(F.first("data").alias("data"))
    ids = [F.col("id").cast("string").alias("id"), "url"]
    # responses are found by id too, so the records of a popular payload don't meet in one task
    own = heads.alias("h").join(first.alias("f"), (F.col("h.sha") == F.col("f.sha")) & (F.col("h.n") == F.col("f.n")) & F.col("h.id").eqNullSafe(F.col("f.first"))).select("h.*")
    responses = heads.where(F.col("n") < min_revisit).union(own).select(*ids, F.lit("response").alias("kind"), F.lit(None).cast("string").alias("first"), "n", "sha", "record", end.alias("last"))
    whole = responses.join(contents, ["sha", "n"], "left").sortWithinPartitions("sha", "n", "record", "chunk")
    copies = heads.join(first, ["sha", "n"]).where(~F.col("id").eqNullSafe(F.col("first")))
    copies = copies.select(*ids, F.lit("revisit").alias("kind"), F.col("first").cast("string").alias("first"), "n", "sha", F.lit(0).alias("last"), F.lit(0).alias("chunk"), F.lit(None).cast("binary").alias("data"))
    rows = whole.select(*copies.columns).union(copies)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w, done = Writer(folder, TaskContext.get().partitionId()), []
        for b in batches:
            col = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                kind, chunk, last = col["kind"][i].as_py(), col["chunk"][i].as_py(), col["last"][i].as_py()
                if chunk is None:
                    raise ValueError("a payload changed while the archives were written")
                digest = bytes.fromhex(col["sha"][i].as_py())
                if chunk == 0:
                    w.head(col["id"][i].as_py(), col["url"][i].as_py(), kind, col["first"][i].as_py(), col["n"][i].as_py(), b32(digest))
                if kind == "response":
                    w.chunk(memoryview(col["data"][i].as_buffer()))
                if chunk == last:
                    if kind == "response" and w.sha.digest() != digest:
                        raise ValueError("the chunks of a record don't add up to its digest")
                    w.tail()
                    if w.bytes >= FILE_BYTES:
                        done.append(w.close())
        if w.file:
            done.append(w.close())
        for f in done:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in f], names=["path", "records", "bytes"])

    return scratch.write(rows.mapInArrow(each, "path string, records long, bytes long"), "files")


class Reader:
    """A gzip file of members as a stream of bytes."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_stream(at)
        self.zip, self.buffer = zlib.decompressobj(31), b""

    def fill(self) -> bool:
        data = self.zip.unused_data
        if self.zip.eof:
            self.zip = zlib.decompressobj(31)
        else:
            data = self.zip.unconsumed_tail
        data = data or self.file.read(1 << 16)
        if not data:
            return False
        self.buffer += self.zip.decompress(data, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self.fill():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes, in pieces of CHUNK at most."""
        while n:
            size = min(n, CHUNK)
            while len(self.buffer) < size:
                if not self.fill():
                    raise EOFError("a record is cut off")
            yield self.buffer[:size]
            self.buffer = self.buffer[size:]
            n -= size


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}


def records(path: str) -> Iterator[tuple]:
    """(id text, kind, refers_to text, chunk, data, bytes so far, digest so far, is the last) of an archive file.
    A revisit has one row without data, with the length and digest of the payload it stands for."""
    r = Reader(path)
    while (head := r.until(b"\r\n\r\n")) is not None:
        f = fields(head)
        page = page_of(f["warc-record-id"])
        kind = f["warc-type"]
        http = r.until(b"\r\n\r\n")
        n = int(fields(http)["content-length"])
        if kind == "revisit":
            yield page, kind, page_of(f["warc-refers-to"]), 0, None, n, f["warc-payload-digest"].removeprefix("sha1:"), True
        else:
            body = int(f["content-length"]) - len(http) - 4
            sha, so_far = hashlib.sha1(), 0
            if not body:
                yield page, kind, None, 0, b"", 0, b32(sha.digest()), True
            for k, data in enumerate(r.take(body)):
                sha.update(data)
                so_far += len(data)
                yield page, kind, None, k, data, so_far, b32(sha.digest()), so_far == body
        if b"".join(r.take(4)) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")


CHUNK_ROWS = "id string, kind string, refers_to string, chunk int, data binary, bytes long, digest string, last boolean"


def read(files: DataFrame, with_data: bool = True, last_only: bool = False) -> DataFrame:
    """The chunk table of the archives in ``files`` (path): bytes and digest are
    those of the payload up to and with the chunk. ``last_only`` leaves one row a record."""
    names = [x.strip().split(" ")[0] for x in CHUNK_ROWS.split(",")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for row in records(path):
                    if last_only and not row[-1]:
                        continue
                    size += len(row[4] or b"") if with_data else 0
                    rows.append(row if with_data else (*row[:4], None, *row[5:]))
                    if size >= 16 * CHUNK or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(1, files.count())
    return files.select("path").repartition(n, "path").mapInArrow(each, CHUNK_ROWS)


def archive(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Writes ``pages`` and reads the archives back: (id, payload_bytes, payload_digest, record_type, refers_to).

    A null page is an empty payload, a null url about:blank. A null id is smaller than
    all others. Rows that repeat the largest id of a payload are responses too. Ids of any type that survives
    a cast to text and back are given back as they are, whatever characters they hold.
    """
    files = write(pages, Scratch(pages.sparkSession, "warc"), id_col)
    kind = pages.schema[id_col].dataType
    ident = lambda c: F.col(c).cast(kind)
    return read(files, with_data=False, last_only=True).select(
        ident("id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), ident("refers_to").alias("refers_to")
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


_BITS = "('0x' || substr(sha, 5 * g + 1, 5))::INTEGER"
OP4_SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha,
         max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first FROM pages
), g AS (
  SELECT r, g, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_BITS} // 32768) % 32) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_BITS} // 1024) % 32) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_BITS} // 32) % 32) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({_BITS} % 32) + 1, 1) AS four
  FROM p, unnest(range(0, 8)) t(g)
), d AS (
  SELECT r, string_agg(four, '' ORDER BY g) AS payload_digest FROM g GROUP BY r
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN d USING (r)
"""
