"""WARC archives with a two-level capture index.

`write` turns pages into WARC/1.1 records, one gzip member each, a file per task in a shared folder; a payload of at least
REVISIT_BYTES that several pages have is stored once, as the response of the largest page_id, and the others are revisit
records that refer to it. `index` sorts the captures by their reversed-host URL key (com,example)/path) over all tasks,
writes them as gzip blocks of BLOCK_LINES lines, and keeps a sparse directory: each block's first key and byte range.
`lookup` finds URLs' captures, a batch of them for each index file: binary search in the file's directory, a range read of
the block, binary search in the block. `records` reads what was found by range and checks every payload's digest. `Lookup`
does the same on the driver, for a URL at a time. `archive_and_read`, the query, asks for the URL of every page.

Files go through pyarrow's file systems, so the folder may be local, HDFS or an object store. A task's file has a name of
its own for every attempt; only files named in the returned tables count, and these tables are checkpointed, so a repeated
task leaves at most an unused file. Hot hosts and URLs: the index is range-partitioned by key and place, so a host or URL
with a third of all captures is spread over many blocks and files, each of which is asked for it once; copies of one payload
meet in an aggregation and an equi-join that adaptive execution can split. Records are read by as many tasks as their bytes
need (READ_BYTES each). What goes to the driver is the first and last key of each index file, one row a task.

Payloads are equal if their SHA-1, a 64-bit hash and their size are.

Defined results: a null html is an empty payload; a null or odd url is archived with its control characters, spaces and
non-ASCII percent-encoded (null: empty, key ")"); rows without page_id are responses, whatever their payload; rows that
repeat the largest page_id of a payload are all responses; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, ensure_checkpoint_dir, remove_folder

REVISIT_BYTES = 1000
BLOCK_LINES = 500
#: Compressed bytes of records that a task reads.
READ_BYTES = 4_000_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(folder: str):  # noqa: ANN201
    """pyarrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def archived(url: str | None) -> str:
    """A URL as records have it."""
    return quote(url or "", safe="%/:=&?~#+!$,;'@()*[]|")


def surt(url: str) -> str:
    """A URL's key: host labels reversed, port, path and query, lower-cased host; www. dropped."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return f"){url}"
    labels = ",".join(reversed(host.split(".")))
    return f"{labels}{f':{port}' if port and port not in (80, 443) else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload or, with refers_to, a revisit with headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Capture(NamedTuple):
    page_id: int | None
    record_type: str
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None  # None in a revisit


def parse(member: bytes) -> Capture:
    """Reads a record; a response's payload is held against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of {fields['WARC-Target-URI']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return Capture(number("X-Page-ID"), kind, number("X-Refers-To-Page-ID"), digest, length, payload if kind == "response" else None)


CAPTURES = "key string, page_id long, file string, offset long, length long"


def write(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archives all pages; returns the captures (key, page_id, file, offset, length), checkpointed."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    same = ["digest", "print", "size"]
    pages = pages.withColumns({"digest": F.sha1("payload"), "print": F.xxhash64("payload"), "size": F.octet_length("payload")})
    heads = pages.where(F.col("size") >= revisit_bytes).groupBy(same).agg(F.max("page_id").alias("head"), F.count("*").alias("many")).where("many > 1").select(*same, "head")
    rows = pages.join(heads, same, "left").withColumn("refers_to", F.when((F.col("size") >= revisit_bytes) & (F.col("page_id") < F.col("head")), F.col("head")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        task = TaskContext.get()
        name, out, at = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", None, 0
        for batch in batches:
            keys, offsets, sizes = [], [], []
            columns = [batch.column(x) for x in ("page_id", "url", "payload", "digest", "refers_to")]
            for page_id, url, payload, digest, refers_to in zip(*columns):
                uri = archived(url.as_py())
                member = record(page_id.as_py(), uri, payload.as_py(), digest.as_py(), refers_to.as_py())
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                keys.append(surt(uri)), offsets.append(at), sizes.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), columns[0], pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return cut(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, CAPTURES))


DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines long"


def index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted blocks; returns the directory, one row a block, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        task = TaskContext.get()
        name, out, at, lines = f"index-{task.partitionId():05d}-{task.taskAttemptId()}.gz", None, 0, []

        def block() -> pa.RecordBatch:
            nonlocal out, at, lines
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress("\n".join(lines).encode()) + packer.flush()
            out.write(member)
            row = [[lines[0].partition(" ")[0]], [lines[-1].partition(" ")[0]], [name], [at], [len(member)], [len(lines)]]
            at, lines = at + len(member), []
            return pa.RecordBatch.from_arrays([pa.array(v) for v in row], ["first_key", "last_key", "file", "offset", "length", "lines"])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                lines.append("{} {} {} {} {}".format(row[0], "-" if row[1] is None else row[1], *row[2:]))
                if len(lines) == block_lines:
                    yield block()
        if lines:
            yield block()
        if out is not None:
            out.close()

    order = ["key", "file", "offset"]
    return cut(captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, DIRECTORY))


@lru_cache(maxsize=64)
def source(folder: str, name: str):  # noqa: ANN201
    store, base = opened(folder)
    return store.open_input_file(f"{base}/{name}")


def range_read(folder: str, name: str, offset: int, length: int) -> bytes:
    return source(folder, name).read_at(length, offset)


def block_lines_of(folder: str, name: str, offset: int, length: int) -> list[list[str]]:
    """A block's captures: key, page_id, file, offset, length."""
    return [x.split(" ") for x in zlib.decompress(range_read(folder, name, offset, length), 31).decode().split("\n")]


def lines_with(blocks: list[tuple], folder: str, key: str, lines_of) -> Iterator[list[str]]:  # noqa: ANN001
    """The captures of a key. blocks: (first key, file, offset, length) in order of key; lines_of: block_lines_of or like it."""
    first = lambda x: x[0]
    for _, name, offset, length in blocks[max(bisect_left(blocks, key, key=first) - 1, 0) : bisect_right(blocks, key, key=first)]:
        lines = lines_of(folder, name, offset, length)
        yield from lines[bisect_left(lines, key, key=first) : bisect_right(lines, key, key=first)]


def lookup(urls: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """The captures of the column `key` of urls (see `surt`): key, page_id, file, offset, length."""
    edges = directory.groupBy("file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).orderBy("low", "high").collect()  # one row a task of `index`
    names, lows, highs = ([e[k] for e in edges] for k in range(3))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each key with the index files that may have it; files' ranges ascend, and only a key at their edges has several."""
        for batch in batches:
            keys, files = [], []
            for key in batch.column("key").to_pylist():
                for k in range(bisect_left(highs, key), bisect_right(lows, key)):
                    keys.append(key), files.append(names[k])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(files, pa.string())], ["key", "file"])

    def find(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = sorted(zip(*(blocks.column(x).to_pylist() for x in ("first_key", "file", "offset", "length"))), key=lambda b: (b[0], b[2]))
        lines_of = lru_cache(maxsize=4)(block_lines_of)  # keys ascend, so a block is read once
        found = [x for key in sorted(asked.column("key").to_pylist()) for x in lines_with(rows, folder, key, lines_of)]
        columns = [[x[0] for x in found], [None if x[1] == "-" else int(x[1]) for x in found], [x[2] for x in found], [int(x[3]) for x in found], [int(x[4]) for x in found]]
        return pa.table({f.split()[0]: pa.array(v, pa.string() if f.endswith("string") else pa.int64()) for f, v in zip(CAPTURES.split(", "), columns)})

    asked = urls.select("key").distinct().mapInArrow(ask, "key string, file string")
    return asked.groupBy("file").cogroup(directory.groupBy("file")).applyInArrow(find, CAPTURES)


def records(captures: DataFrame, folder: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """Reads captures' records: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    tasks = max(1, -(-(captures.agg(F.sum("length")).first()[0] or 0) // read_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(range_read(folder, *x)) for x in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.page_id for r in rows], pa.int64()), pa.array([r.payload_bytes for r in rows], pa.int64()), pa.array([r.digest for r in rows], pa.string()), pa.array([r.record_type for r in rows], pa.string()), pa.array([r.refers_to for r in rows], pa.int64())],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    # A task reads forward through a stretch of an archive.
    work = captures.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return work.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


class Lookup:
    """Random access on the driver. The directory has one row for BLOCK_LINES captures."""

    def __init__(self, directory: DataFrame, folder: str) -> None:
        self.folder = folder
        self.blocks = [tuple(r) for r in directory.select("first_key", "file", "offset", "length").orderBy("first_key", "file", "offset").collect()]

    def find(self, url: str) -> list[Capture]:
        """All captures of a URL."""
        return [parse(range_read(self.folder, x[2], int(x[3]), int(x[4]))) for x in lines_with(self.blocks, self.folder, surt(archived(url)), block_lines_of)]


def new_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def keys_of(pages: DataFrame) -> DataFrame:
    """Column `key`: the index's key of each page's url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(archived(x)) for x in batch.column("url").to_pylist()], pa.string())], ["key"])

    return pages.select("url").mapInArrow(run, "key string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes and indexes all pages, looks every page's URL up, reads what is found, and drops the archives again."""
    spark = pages.sparkSession
    folder = new_folder(spark)
    try:
        directory = index(write(pages, folder), folder)
        return cut(records(cut(lookup(keys_of(pages), directory, folder)), folder))
    finally:
        remove_folder(spark, folder)
