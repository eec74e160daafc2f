"""WARC: a monolithic gzip normaliser, with a writer and a reader around it.

A monolithic archive is one gzip stream over all its records, which can only be read from its start. The normaliser
inflates the stream once, rewrites every record as a gzip member of its own and writes a sidecar index of offsets, by
which any record can be read alone.

Files go to a folder that all executors share, by its file system's own client; each is written under a name of its
task attempt and then renamed, and a task's input is a fixed set of rows, so a task that runs again or twice leaves
the same files. A monolithic archive is removed only when its normalised form and index are in place, and a
normaliser that finds them in place has nothing to do. An archive that ends within a gzip member or a record, or whose
checksum is wrong, raises an error and stays. Inflation is bounded: a piece of input gives _READ bytes at a time, and only
the record at hand is held. Payloads count as equal if length, SHA-1 and a 64-bit hash agree.

Records: WARC/1.1 response records whose block is an HTTP response, and revisit records (identical payload digest)
that keep the HTTP header, whose Content-Length still tells the payload's length. The page's id is in the record id.

Cases: a null html is an empty payload; payloads below the least length are never revisits; a null page_id is kept
(and never the target of a revisit while another copy has an id); rows repeated with one page_id and one payload are
each a record: all that carry the largest page_id are responses; an empty table writes no file and returns no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from itertools import islice
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import fresh_dir, materialise, small_batches

LEAST_REVISIT = 1000
#: Rows of the table of repeated payloads that are broadcast at most (about 60 bytes each); above, it is joined by shuffle.
BROADCAST_ROWS = 200_000
_READ = 1 << 20


class Gzip:
    """Writes to a stream as gzip, one member or many."""

    def __init__(self, out: BinaryIO):
        self.out, self.size, self.z = out, 0, None

    def write(self, data: bytes) -> None:
        self.z = self.z or zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(self.z.compress(data))

    def end_member(self) -> None:
        if self.z:
            self._put(self.z.flush())
            self.z = None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in url or "" if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def inflate(stream: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in pieces of _READ bytes at most. Raises an error if the last member isn't whole."""
    z, members = None, 0
    data = stream.read(_READ)
    while data or z:
        if z is None:
            data = data.lstrip(b"\0")  # members may be padded
            if not data:
                data = stream.read(_READ)
                continue
            z, members = zlib.decompressobj(47), members + 1
        piece = z.decompress(data, _READ)
        if piece:
            yield piece
        if z.eof:
            data, z = z.unused_data, None
        else:
            data = z.unconsumed_tail
        if not data:
            data = stream.read(_READ)
            if not data and z and not piece:
                raise ValueError("the archive ends within a gzip member")
    if not members:
        raise ValueError("the archive holds no gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, the whole record's bytes) of each record; only the record at hand is held."""
    buffer, at = bytearray(), 0
    need = None  # length of the record at hand
    head: dict[str, str] = {}
    for piece in pieces:
        buffer += piece
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = headers(bytes(buffer[at:end]))
                if not head.get("content-length", "").isdecimal():
                    raise ValueError("a record has no length")
                need = end + 4 - at + int(head["content-length"]) + 4
            if len(buffer) - at < need:
                break
            yield head, bytes(buffer[at : at + need])
            at, need = at + need, None
        del buffer[:at]
        at = 0
    if buffer:
        raise ValueError("the archive ends within a record")


def store_uri(path: str) -> str:
    """Hadoop's names of its S3 clients (s3a, s3n) are one store's."""
    scheme, sep, rest = path.partition("://")
    return f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else path


def _files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    return fs.FileSystem.from_uri(store_uri(path))


def _put(paths: list[str], write: Callable[..., None]) -> None:
    """Calls write with a stream for each path, on files of this attempt's own, then gives them their names, in order."""
    context = TaskContext.get()
    places = [_files(p) for p in paths]
    own = [f"{name}.{context.taskAttemptId() if context else 0}" for _, name in places]
    with ExitStack() as stack:
        write(*[stack.enter_context(files.open_output_stream(x, compression=None)) for (files, _), x in zip(places, own, strict=True)])
    for (files, name), x in zip(places, own, strict=True):
        files.move(x, name)


def _exists(path: str) -> bool:
    files, name = _files(path)
    return files.get_file_info(name).type == fs.FileType.File


def classify(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to (null for a response). No payload is shuffled unless repeated ones are very many."""
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.xxhash64("html").alias("hash"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    repeated = keyed.where(F.col("n") >= least).groupBy("digest", "hash", "n").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "hash", "n", "response_id")
    repeated = materialise(repeated, "warc-repeated")
    table = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    revisits = (F.col("n") >= least) & F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return keyed.join(table, ["digest", "hash", "n"], "left").select("page_id", "url", "html", F.when(revisits, F.col("response_id")).alias("refers_to"))


def write_monolithic(classified: DataFrame, folder: str) -> DataFrame:
    """Writes an archive per partition: one gzip stream over its records. Returns path, records."""
    spark = classified.sparkSession
    small_batches(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.mono.warc.gz"
        count = 0

        def write(f: BinaryIO, first: pd.DataFrame) -> None:
            nonlocal count
            z = Gzip(f)
            batch = first
            while batch is not None:
                for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                    z.write(record(_int(page_id), url, (html or "").encode("utf-8", "surrogatepass"), _int(refers_to)))
                    count += 1
                batch = next(batches, None)
            z.end_member()

        first = next((b for b in batches if len(b)), None)
        if first is not None:
            _put([path], lambda f: write(f, first))
            yield pd.DataFrame({"path": [path], "records": [count]})

    return materialise(classified.mapInPandas(run, "path string, records long"), "warc-written")


def _int(x: object) -> int | None:
    return None if x is None or x != x or x is pd.NA else int(x)


def normalise_file(source: str, target: str, keep_source: bool = False) -> int:
    """Rewrites one archive to target with a member per record, and target + .idx with a JSON line per record. Returns the records."""
    index = f"{target}.idx"
    if not (_exists(target) and _exists(index)):

        def write(f: BinaryIO, lines: BinaryIO) -> None:
            files, name = _files(source)
            z = Gzip(f)
            with files.open_input_stream(name, compression=None) as stream:
                for head, data in records(inflate(stream)):
                    start = z.size
                    z.write(data)
                    z.end_member()
                    entry = {"offset": start, "length": z.size - start, "id": head.get("warc-record-id", ""), "type": head.get("warc-type", ""), "digest": head.get("warc-payload-digest", "")}
                    lines.write(json.dumps(entry).encode() + b"\n")

        _put([target, index], write)
    n = sum(1 for _ in read_index(index))
    if not keep_source and _exists(source):
        files, name = _files(source)
        files.delete_file(name)
    return n


def read_index(path: str) -> Iterator[dict]:
    """The entries of an index, one line after the other."""
    files, name = _files(path)
    rest = b""
    with files.open_input_stream(name, compression=None) as f:
        while data := f.read(_READ):
            *lines, rest = (rest + data).split(b"\n")
            yield from map(json.loads, lines)
    if rest:
        raise ValueError("the index ends within an entry")


def normalise(archives: DataFrame) -> DataFrame:
    """archives: path of monolithic archives. Returns path of the normalised ones, records; a task per archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source in b["path"]:
                target = source.replace(".mono.warc.gz", ".warc.gz")
                yield pd.DataFrame({"path": [target], "records": [normalise_file(source, target)]})

    n = archives.count()
    return materialise(archives.select("path").repartition(max(1, n), "path").mapInPandas(run, "path string, records long"), "warc-normalised")


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, path and offset of every record, each read alone by its index entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                entries = read_index(path + ".idx")
                files, name = _files(path)
                with files.open_input_file(name) as f:
                    while some := list(islice(entries, 1000)):
                        yield pd.DataFrame([_row(f, path, e) for e in some], columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    n = archives.count()
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"
    return archives.select("path").repartition(max(1, n), "path").mapInPandas(run, schema)


def _row(f: BinaryIO, path: str, entry: dict) -> tuple:
    data = zlib.decompress(f.read_at(entry["length"], entry["offset"]), 47)
    end = data.find(b"\r\n\r\n") + 4
    head = headers(data[: end - 4])
    block = data[end : end + int(head["content-length"])]
    body = block.find(b"\r\n\r\n") + 4
    http = headers(block[: body - 4])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
    page = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
    if head["warc-type"] == "revisit":
        return page(head["warc-record-id"]), int(http["content-length"]), digest.hex(), "revisit", page(head["warc-refers-to"]), path, entry["offset"]
    payload = block[body:]
    if hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"{path} at {entry['offset']}: the payload doesn't have the digest that its record names")
    return page(head["warc-record-id"]), len(payload), digest.hex(), "response", None, path, entry["offset"]


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes pages to monolithic archives in the shared folder, normalises them and reads every record back."""
    folder = fresh_dir(pages.sparkSession, "warc")
    return read(normalise(write_monolithic(classify(pages, least), folder)))
