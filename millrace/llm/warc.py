"""WARC archives, compressed record by record with an embedded Zstandard dictionary.

``archive`` writes pages as WARC/1.1 files of bounded size into a folder that all
executors share. Each task trains a dictionary on the first ``SAMPLE`` bytes of its
own records, writes it as a skippable frame (magic 0x184D2A5D) at the front of each
of its files, and then one Zstandard frame for each record, so that any record can be
read alone. Pages with equal payloads are written once: the one with the smallest id
is a ``response``, the others are ``revisit`` records that refer to it and hold no
payload. Payloads that no other page has, nearly all as a rule, are written by the tasks that read them; those
that several have are found by their digests, and of these only the first copies are shuffled. The result is a manifest with a row for each file; a file counts only if it
is in the manifest, so files left behind by a lost or repeated task do no harm.

``read_archives`` reads files back as rows, with their own dictionaries, checking
digests of payloads.

Null payloads count as empty, null URLs as empty; control characters in URLs are
percent-encoded. A page with a null id revisits a page with equal payload that has an id;
if none has, all are responses. Rows that repeat id and payload of a response are responses.
Payloads of any length are one record. Other columns are not read, so they may have any names. An empty table gives an empty manifest. Too few records to train on (or too alike)
give a dictionary that is the plain bytes of the first of them.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sift, written

DICTIONARY_MAGIC = 0x184D2A5D
#: Bytes of records a dictionary is trained on, its size, and compressed bytes of a file after which a new one begins.
SAMPLE, DICTIONARY, FILE = 2_000_000, 32_768, 64_000_000
DATE = "2026-01-01T00:00:00Z"
LEVEL = 3
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Spark path and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record_id(page_id: int | None, sha1_hex: str, url: str = "") -> str:
    own = url if page_id is None else str(page_id)
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{own}/{sha1_hex}')}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, sha1_hex: str, first: int | None, size: int | None = None) -> bytes:
    """A response, or a revisit if another page is the first with the payload (then only its size is needed)."""
    size = len(payload) if size is None else size
    url, http = _url(url), f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", record_id(page_id, sha1_hex, url)), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{base32(sha1_hex)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(size)),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if first is None or page_id == first:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(first, sha1_hex)), ("X-Refers-To-Page-ID", str(first))]
    return record("revisit", fields, http)


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Archive files of one task."""

    def __init__(self, folder: str, stem: str):
        self.fs, self.folder = filesystem(folder)
        self.stem, self.done, self.out = stem, [], None
        self.waiting: list[bytes] = []
        self.held = 0
        self.compressor = None

    def add(self, raw: bytes) -> None:
        if self.compressor is None:
            self.waiting.append(raw)
            self.held += len(raw)
            if self.held >= SAMPLE:
                self._train()
            return
        if self.out is None:
            self._open()
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1
        if self.size >= FILE:
            self._close()

    def _train(self) -> None:
        self.dictionary = dictionary(self.waiting)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=self.dictionary, write_checksum=True)
        waiting, self.waiting = self.waiting, []
        for raw in waiting:
            self.add(raw)

    def _open(self) -> None:
        self.path = f"{self.folder}/{self.stem}-{len(self.done):04d}.warc.zst"
        self.fs.create_dir(self.folder, recursive=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        raw = self.dictionary.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        about = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, self.stem)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        self.out.write(self.compressor.compress(about))
        self.size, self.records = 8 + len(raw), 0

    def _close(self) -> None:
        self.out.close()
        self.out = None
        self.done.append((self.path, self.records, self.size))

    def finish(self) -> list[tuple[str, int, int]]:
        if self.waiting:
            self._train()
        if self.out is not None:
            self._close()
        return self.done


def archive(pages: DataFrame, folder: str, *, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write archives into ``folder`` (a URI); the manifest: archive, records, bytes."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload")).withColumn("sha1", F.sha1("payload"))
    digests = written(rows.select("id", "url", "sha1", F.octet_length("payload").cast("long").alias("size")), "digests")
    several = digests.groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "first")
    several = written(several, "several")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = Writer(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}")
        for batch in batches:
            for page_id, address, raw, sha1, least, size in zip(*(batch.column(n).to_pylist() for n in ("id", "url", "payload", "sha1", "first", "size")), strict=True):
                writer.add(page_record(page_id, address, raw, sha1, least, size))
        paths, records, sizes = zip(*done, strict=True) if (done := writer.finish()) else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    columns = ("id", "url", "payload", "sha1", "first", "size")
    rows = rows.withColumn("size", F.octet_length("payload").cast("long"))
    shared, alone = sift(rows, F.col("sha1"), several, F.col("sha1"))
    # What passes the sieve by chance has a digest of its own, and is a response like the first copies.
    passed, _ = sift(digests, F.col("sha1"), several, F.col("sha1"))
    strays = passed.join(several, "sha1", "left_anti").select("sha1", F.col("id").alias("first"))
    owners = written(several.unionByName(strays), "owners")
    firsts, _ = sift(shared, F.xxhash64("sha1", "id"), owners, F.xxhash64("sha1", "first"))
    is_first = F.col("id").eqNullSafe(F.col("first"))
    responses = firsts.join(owners, "sha1").filter(is_first)
    revisits = digests.join(several, "sha1").filter(F.col("first").isNotNull() & ~is_first).withColumn("payload", F.lit(None).cast("binary"))
    every = alone.withColumn("first", F.col("id")).select(*columns).unionByName(responses.select(*columns)).unionByName(revisits.select(*columns))
    manifest = written(every.mapInArrow(write, "archive string, records long, bytes long"), "manifest")
    scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else ""
    return manifest.withColumn("archive", F.concat(F.lit(scheme), "archive")) if scheme else manifest


def frames(stream) -> io.BufferedReader:
    """The records of an archive, uncompressed one after another."""
    head = stream.read(8)
    known, lead = None, head
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        raw = stream.read(struct.unpack("<II", head)[1])
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known, lead = zstandard.ZstdCompressionDict(raw), b""
    rest = _Chained(lead, stream)
    return io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(rest, read_across_frames=True), 1 << 18)


class _Chained:
    def __init__(self, lead: bytes, stream):
        self.lead, self.stream = lead, stream

    def read(self, n: int = -1) -> bytes:
        if self.lead:
            out, self.lead = self.lead, b""
            return out
        return self.stream.read(n)


def records(reader: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case; the version line left out) and block of each record."""
    while line := reader.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            continue
        fields = {}
        while (line := reader.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, reader.read(int(fields["content-length"]))


ROW = (
    "archive string, record_type string, record_id string, page_id long, url string, payload_bytes long, payload_digest string,"
    "digest_holds boolean, refers_to long, payload binary"
)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each response and revisit in the manifest's files (payloads null if not asked for)."""
    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def rows(path: str) -> Iterator[tuple]:
        fs, own = filesystem(path)
        with fs.open_input_stream(own, compression=None) as stream:
            for f, block in records(frames(stream)):
                kind = f["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                body = block.partition(b"\r\n\r\n")[2]
                digest = f["warc-payload-digest"].removeprefix("sha1:")
                whole = kind == "response"
                found = base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else None
                size = len(body) if whole else number(f["x-payload-length"])
                yield (path, kind, f["warc-record-id"], number(f.get("x-page-id")), f["warc-target-uri"], size, found if whole else digest, found == digest if whole else None, number(f.get("x-refers-to-page-id")), body if payloads and whole else None)

    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in ROW.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 4_000_000:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    files = manifest.select("archive")
    return files.repartition(max(1, files.count())).mapInArrow(read, ROW)
