"""WARC archives: writing, normalising monolithic gzip, reading by an index.

``capture`` writes every row as a response record into archives that are one
gzip stream each (no record can be reached without inflating all before it).
``normalise`` inflates each such stream once, rewrites every record as a gzip
member of its own and writes a sidecar with each member's offset and length.
Records that an earlier decision marks become revisit records on the way: their
payload goes, their digest and HTTP length stay.  ``read`` opens members by the
sidecar alone.

Archives roll at a bounded number of records and bytes, so a task and a group
never hold more than that; payloads are never shuffled, only a few numbers per
record are.  Files lie in the shared folder and are opened through
``pyarrow.fs`` (file, HDFS or object-store URIs).  A file is written under a
name of its attempt and then moved, so a lost or repeated task leaves whole
files only.

Which record of equal payloads is the response: that with the largest id (null
ids rank lowest; equal ids by place in the archives); payloads shorter than
``min_bytes`` are all responses.

Defined results: a null payload counts as empty, a null URL is written as an
``urn:`` of the id; a null id stays null.  An empty table gives no archive and an
empty result.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Out, partitions, rows, written
from tillroll.operators.skew import join_back
from tillroll.session import scratch_dir

ARCHIVE_RECORDS = 4096
ARCHIVE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"  # pages carry no date; a constant keeps archives reproducible
CAPTURED = pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64())])
_CAPTURED = "archive string, ordinal long, page_id long, digest string, bytes long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, digest: str, block: bytes, refers_to: str = "") -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
             f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def urn(page_id: int | None, archive: str, ordinal: int) -> str:
    """Record id: the page's id and the record's place, as ids may repeat."""
    return f"urn:page:{'' if page_id is None else page_id}/{archive}/{ordinal}"


def _page(value: str) -> int | None:
    key = value.strip("<>")[len("urn:page:"):].partition("/")[0]
    return int(key) if key else None


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class Sink:
    """A file in the shared folder that appears whole or not at all."""

    def __init__(self, root: str, name: str):
        self.fs, base = _store(root)
        self.path = f"{base}/{name}"
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def capture(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows into monolithic archives below ``root``; a row per record."""

    def run(batches):
        from pyspark import TaskContext

        task, archive, sink, size, n = TaskContext.get().partitionId(), 0, None, 0, 0
        out = Out(CAPTURED)
        for page_id, url, payload in rows(batches):
            payload = payload or b""
            if sink is None:
                name = f"raw/part-{task:05d}-{archive:04d}.warc.gz"
                sink, gz, size, n = Sink(root, name), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
            digest = sha1_base32(payload)
            own = urn(page_id, name, n)
            uri = re.sub(r"[\x00-\x20\x7f]+", "%20", url) if url else own
            block = http_head(len(payload)) + payload
            sink.write(gz.compress(record("response", own, uri, digest, block)))
            out.add((name, n, page_id, digest, len(payload)))
            size, n = size + len(block), n + 1
            if n >= ARCHIVE_RECORDS or size >= ARCHIVE_BYTES:
                sink.write(gz.flush())
                sink.close()
                sink, archive = None, archive + 1
            if out.full():
                yield out.batch()
        if sink:
            sink.write(gz.flush())
            sink.close()
        yield out.batch()

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("string").cast("binary")).mapInArrow(run, _CAPTURED)


def revisits(captured: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Place of every record, whether it becomes a revisit, and the id and place
    of the response with its payload.  Digests are reduced to one row each before
    they meet the records again; a very common one is joined map-side."""
    place = F.struct("page_id", "archive", "ordinal")
    best = written(captured.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max(place).alias("best"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1"), "responses")
    long_enough = join_back(captured.where(F.col("bytes") >= min_bytes), best, "digest", "n")
    short = captured.where(F.col("bytes") < min_bytes).withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    own = (F.col("best.archive") == F.col("archive")) & (F.col("best.ordinal") == F.col("ordinal"))
    return long_enough.unionByName(short).select(
        "archive", "ordinal", (F.col("best").isNotNull() & ~own).alias("revisit"), F.col("best.page_id").alias("to_page"),
        F.col("best.archive").alias("to_archive"), F.col("best.ordinal").alias("to_ordinal"))


def inflate_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a gzip stream, inflated once;
    holds one record and one chunk.  Works for one member or many."""
    gz, held = zlib.decompressobj(31), bytearray()

    def parsed():
        while (end := held.find(b"\r\n\r\n")) >= 0:
            head = dict(x.split(": ", 1) for x in held[:end].decode().split("\r\n")[1:])
            size = int(head["Content-Length"])
            if len(held) < end + 8 + size:
                return
            block = bytes(held[end + 4:end + 4 + size])
            del held[:end + 8 + size]
            yield head, block

    for chunk in chunks:
        while chunk:
            held += gz.decompress(chunk, 1 << 20)
            chunk = gz.unconsumed_tail
            if gz.eof:
                chunk, gz = gz.unused_data, zlib.decompressobj(31)
            yield from parsed()
    held += gz.flush()
    yield from parsed()
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def _chunks(root: str, name: str, size: int = 1 << 20) -> Iterator[bytes]:
    store, base = _store(root)
    with store.open_input_stream(f"{base}/{name}", compression=None) as f:
        while data := f.read(size):
            yield data


def normalise(decided: DataFrame, root: str) -> DataFrame:
    """Rewrite every monolithic archive with a member per record and a sidecar
    (JSON lines) of offsets.  ``decided``: what ``revisits`` says of each record.
    Returns a row per archive."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name = group["archive"].iloc[0]
        to = zip(group["ordinal"], group["revisit"], group["to_page"], group["to_archive"], group["to_ordinal"], strict=True)
        refers = {int(o): urn(None if pd.isna(p) else int(p), a, int(n)) for o, revisit, p, a, n in to if revisit}
        to = name.replace("raw/", "members/", 1)
        members, index, n = Sink(root, to), Sink(root, to + ".idx"), 0
        for k, (head, block) in enumerate(inflate_records(_chunks(root, name))):
            kind, target = head["WARC-Type"], ""
            if k in refers:
                kind, target = "revisit", refers[k]
                block = block[:block.index(b"\r\n\r\n") + 4]
            member = zlib.compressobj(6, zlib.DEFLATED, 31)
            record_id = head["WARC-Record-ID"].strip("<>")
            data = member.compress(record(kind, record_id, head["WARC-Target-URI"], head["WARC-Payload-Digest"][5:], block, target)) + member.flush()
            index.write((json.dumps({"offset": members.at, "length": len(data), "id": record_id, "type": kind}) + "\n").encode())
            members.write(data)
            n += 1
        members.close()
        index.close()
        return pd.DataFrame({"archive": [to], "records": [n], "bytes": [members.at]})

    # a fixed number of partitions: archives are large and their rows here few, which adaptive coalescing can't see
    return (decided.repartition(partitions(decided), "archive").groupBy("archive")
            .applyInPandas(run, "archive string, records long, bytes long"))


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                  ("refers_to", pa.int64()), ("archive", pa.string()), ("member_offset", pa.int64())])


def read(archives: DataFrame, root: str) -> DataFrame:
    """Every record of the normalised ``archives``, reached by the sidecars.  A
    response's digest and length are those of the payload that was read; a
    revisit's come from its headers."""

    def run(batches):
        out = Out(READ)
        store, base = _store(root)
        for (name,) in rows(batches):
            with store.open_input_file(f"{base}/{name}") as f, store.open_input_stream(f"{base}/{name}.idx", compression=None) as idx:
                for line in idx.read().splitlines():
                    at = json.loads(line)
                    head, block = next(inflate_records(iter([f.read_at(at["length"], at["offset"])])))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, size = sha1_base32(payload), len(payload)
                    if head["WARC-Type"] == "revisit":
                        digest = head["WARC-Payload-Digest"][5:]
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    refers = _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                    out.add((_page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers, name, at["offset"]))
                    if out.full():
                        yield out.batch()
        yield out.batch()

    return archives.select("archive").repartition(partitions(archives), "archive").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, member_offset long")


def archive_pages(pages: DataFrame, root: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back all rows of ``pages``."""
    root = root or scratch_dir(pages.sparkSession, "warc")
    captured = written(capture(pages, root), "captured")
    return read(written(normalise(revisits(captured, min_bytes), root), "archives"), root)
