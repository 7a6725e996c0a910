"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.llm.common import Scratch, numbered

#: Index lines in one compressed block.
BLOCK_LINES = 3000
#: Lines of one index part, on average, which one task writes and searches.
INDEX_LINES = 300_000
#: Bytes of records that one task reads back, on average.
TASK_BYTES = 32_000_000
#: Revisits that are sent to every task, and the characters of the URLs that they name; beyond either they
#: are joined by a shuffle.
BROADCAST_REVISITS = 500_000
BROADCAST_CHARS = 16_000_000
#: Index parts whose first keys are sent to a task; more parts are searched in several passes over the queries.
BROADCAST_PARTS = 100_000
#: Bytes of payload in one batch of read records.
READ_BYTES = 16_000_000

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def clean(url: str | None) -> str:
    """The URL as records name it: without blanks at its ends, blanks and control characters percent-encoded."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", (url or "").strip())


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels from the last to the first, then port, path and query.

    Scheme, user, a leading ``www.``, default ports and the fragment are left out. What is no URL with
    a host is its own key behind a ``-``.
    """
    text = clean(url)
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        host, port, parts = "", None, None
    if not host:
        return f"-{text}"
    host = host.removeprefix("www.").rstrip(".")
    labels = [host] if ":" in host else host.split(".")[::-1]
    number = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return f"{','.join(labels)}{number}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=row)}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)  # one gzip member for each record
    return deflate.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _http(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def capture_record(row: int, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, str | None] | None) -> bytes:
    """A response, or a revisit that names the record it repeats and leaves the payload out."""
    target = [("WARC-Target-URI", clean(url))] if clean(url) else []
    headers = [("WARC-Record-ID", record_id(row)), ("WARC-Date", DATE), *target]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    block = _http(len(payload))
    if refers_to is None:
        return _record([("WARC-Type", "response"), *headers], block + payload)
    uri = [("WARC-Refers-To-Target-URI", clean(refers_to[1]))] if clean(refers_to[1]) else []
    more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0])), ("WARC-Refers-To-Date", DATE), *uri]
    return _record([("WARC-Type", "revisit"), *headers, *more], block)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one compressed record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _files(uri: str):
    """File system and path of a shared folder, as tasks see them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _decide(rows: DataFrame, row: str, id_col: str, html_col: str, url_col: str, least: int, scratch: Scratch) -> DataFrame:
    """(row, to_row, to_id, to_url) of every revisit: of equal payloads all but that with the largest id.

    Payloads are equal if their SHA-256 is, since texts of one size with the same SHA-1 can be made.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [(t or "").encode() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()),
                 pa.array(map(len, payloads), pa.int64())],
                names=["row", "id", "url", "digest", "size"],
            )

    narrow = rows.select(row, F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    seen = scratch.store(
        narrow.mapInArrow(digest, "row long, id long, url string, digest binary, size long"), "digests"
    ).where(F.col("size") >= least)
    last = F.max(F.struct(F.col("id").isNotNull().alias("has_id"), "id", "row", "url")).alias("last")
    groups = seen.groupBy("digest").agg(last, F.count("*").alias("n")).where("n > 1")
    # One side has each payload once; adaptive execution splits the rows of a frequent one.
    joined = seen.drop("url").join(groups, "digest").where("row <> last.row")
    return joined.select(
        F.col("row").alias(row), F.col("last.row").alias("to_row"), F.col("last.id").alias("to_id"), F.col("last.url").alias("to_url")
    )


CAPTURE = "row long, id long, key string, type string, to_row long, to_id long, file string, offset long, length long"


def _write(rows: DataFrame, folder: str) -> DataFrame:
    """Write one archive per task; a row for each record says where it is.

    A file's name is new for each attempt, so a repeated or speculative task never touches a file that
    a finished one has named.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _files(folder)
        system.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            captures = []
            for row, id_, url, html, to_row, to_id, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)]
                    data = _record([*info, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(data)
                    at += len(data)
                payload = (html or "").encode()
                refers = None if to_row is None else (to_row, to_url)
                data = capture_record(row, url, payload, payload_digest(payload), refers)
                out.write(data)
                kind = "response" if to_row is None else "revisit"
                captures.append((row, id_, surt(url), kind, to_row, to_id, name, at, len(data)))
                at += len(data)
            yield _batch(captures, _CAPTURE_ARROW)
        if out is not None:
            out.close()

    return rows.mapInArrow(write, CAPTURE)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_CAPTURE_ARROW = _arrow(CAPTURE)

DIRECTORY = "part long, block long, key string, row long, file string, offset long, length long"
_DIRECTORY_ARROW = _arrow(DIRECTORY)


def _index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the capture lines in key order as compressed blocks; a directory row for each block.

    The lines are range-partitioned on key and record, so the captures of a frequent host, even of one
    URL, spread over as many parts as they need. The number of parts follows the number of lines.
    """
    parts = 1 + captures.count() // INDEX_LINES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _files(folder)
        system.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"index-{part:06d}-{uuid.uuid4().hex}.cdx.gz"
        out, at, number, lines = None, 0, 0, []

        def flush() -> tuple:
            nonlocal out, at, number, lines
            if out is None:
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            data = gzip.compress("".join(x[2] for x in lines).encode(), 6, mtime=0)
            out.write(data)
            entry = (part, number, lines[0][0], lines[0][1], name, at, len(data))
            at, number, lines = at + len(data), number + 1, []
            return entry

        for batch in batches:
            entries = []
            for c in batch.to_pylist():
                rest = json.dumps([c["type"], c["id"], c["file"], c["offset"], c["length"]])
                lines.append((c["key"], c["row"], f"{c['key']} {c['row']} {rest}\n"))
                if len(lines) == BLOCK_LINES:
                    entries.append(flush())
            yield _batch(entries, _DIRECTORY_ARROW)
        if lines:
            yield _batch([flush()], _DIRECTORY_ARROW)
        if out is not None:
            out.close()

    return captures.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").mapInArrow(write, DIRECTORY)


@dataclass
class Archive:
    """``folder`` has the archives and the index parts; ``directory`` one row for each index block.

    ``manifest`` (file, records, bytes), stored in the folder's ``manifest``, names the files that
    belong to the archive. A failed or repeated task may have left others, which nothing refers to.
    """

    folder: str
    directory: DataFrame
    captures: DataFrame
    manifest: DataFrame
    size: int  #: bytes of all records


def write_archive(
    pages: DataFrame,
    scratch: Scratch,
    folder: str | None = None,
    least: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> Archive:
    """Write one WARC record per row, and the capture index.

    The payload is the html in UTF-8, empty for NULL. Of equal payloads of at least ``least`` bytes the
    row with the largest id is a response and the others are revisits of it; a NULL id is smaller than
    all others, and among repeated ids the later row counts as larger. Smaller payloads are responses.
    Ids are whole numbers. A NULL or unreadable URL gets a key of its own. An empty table gives an archive without files.
    ``folder`` must be one that all executors share.
    """
    folder = folder or f"{scratch.folder}/archive"
    rows, row = numbered(pages, scratch)
    revisits = scratch.store(_decide(rows, row, id_col, html_col, url_col, least, scratch), "revisits")
    number, chars = revisits.agg(F.count("*"), F.sum(F.length("to_url"))).first()
    few = number <= BROADCAST_REVISITS and (chars or 0) <= BROADCAST_CHARS
    plain = rows.select(
        F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    revisits = revisits.withColumnRenamed(row, "row")
    decided = plain.join(F.broadcast(revisits) if few else revisits, "row", "left")
    captures = scratch.store(_write(decided.select("row", "id", "url", "html", "to_row", "to_id", "to_url"), folder), "captures")
    directory = scratch.store(_index(captures, folder), "directory")
    files = captures.groupBy("file").agg(F.count("*").alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes"))
    index = directory.groupBy("file").agg(F.lit(0).cast("long").alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes"))
    files.union(index).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    manifest = pages.sparkSession.read.schema("file string, records long, bytes long").parquet(f"{folder}/manifest")
    return Archive(folder, directory, captures, manifest, captures.agg(F.sum("length")).first()[0] or 0)


FOUND = "key string, row long, type string, id long, file string, offset long, length long"
_FOUND_ARROW = _arrow(FOUND)


def lookup(archive: Archive, queries: DataFrame) -> DataFrame:
    """Where the records (key, row) are; with a NULL row, where all records of the key are.

    A query goes to the index parts that can have its key by a binary search of the parts' first keys,
    within a part to its blocks by one of the directory, and within a block by one of its lines. Only
    blocks with a query are read. Keys that the archive does not have give no row.

    The driver holds the parts' first keys. A task gets at most ``BROADCAST_PARTS`` of them; the queries
    are passed once for each so many parts.
    """
    folder, most = archive.folder, BROADCAST_PARTS
    firsts = archive.directory.where("block = 0").select("key", "row", "part").collect()
    starts = sorted((r.key.encode(), r.row, r.part) for r in firsts)
    # Each run of parts ends with the first key of the next one.
    runs = [starts[at : at + most + 1] for at in range(0, len(starts), most)] or [[]]

    def reach(keys: list, key: bytes, row: int | None) -> range:
        """Places of the parts, blocks or lines, by their first (key, row), that may have the query."""
        low = (key, -1 if row is None else row)
        high = (key, 1 << 63) if row is None else low
        return range(max(0, bisect_right(keys, low) - 1), bisect_right(keys, high))

    def route(own: list[tuple]):
        def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = [s[:2] for s in own]
            for batch in batches:
                out = [
                    (own[p][2], key, row)
                    for key, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    if key is not None
                    for p in reach(keys, key.encode(), row)
                    if p < most
                ]
                yield _batch(out, pa.schema([("part", pa.int64()), ("key", pa.string()), ("row", pa.int64())]))

        return to_parts

    def search(group: pd.DataFrame) -> pd.DataFrame:
        system, path = _files(folder)
        blocks = group[group["file"].notna()].sort_values("block")
        asked = group[group["file"].isna()]
        keys = [(k.encode(), int(r)) for k, r in zip(blocks["key"], blocks["row"], strict=True)]
        wanted: dict[int, list] = {}
        for key, row in zip(asked["key"], asked["row"], strict=True):
            number = None if row < 0 else int(row)
            for b in reach(keys, key.encode(), number):
                wanted.setdefault(b, []).append((key.encode(), number))
        out = []
        if wanted:
            with system.open_input_file(f"{path}/{blocks['file'].iloc[0]}") as file:
                for b in sorted(wanted):
                    line = blocks.iloc[b]
                    file.seek(int(line["offset"]))
                    text = gzip.decompress(file.read(int(line["length"]))).decode()
                    # A key may have line separators other than \n, which clean() leaves as they are.
                    lines = [x.split(" ", 2) for x in text.split("\n")[:-1]]
                    places = [(x[0].encode(), int(x[1])) for x in lines]
                    for key, number in wanted[b]:
                        at = bisect_left(places, (key, -1 if number is None else number))
                        while at < len(places) and places[at][0] == key and number in (None, places[at][1]):
                            out.append((lines[at][0], places[at][1], *json.loads(lines[at][2])))
                            at += 1
        frame = pd.DataFrame(out, columns=[f.name for f in _FOUND_ARROW])
        return frame.astype({"row": "int64", "id": "Int64", "offset": "int64", "length": "int64"})

    asked = queries.select(F.col("key").cast("string"), F.col("row").cast("long")).distinct()
    asked = reduce(DataFrame.union, [asked.mapInArrow(route(own), "part long, key string, row long") for own in runs])
    # A number that is missing is -1, since pandas would turn a column with NULLs into floats.
    nothing = [F.lit(v).cast(t) for v, t in ((-1, "long"), (None, "string"), (-1, "long"), (-1, "long"))]
    blocks = archive.directory.select("part", "key", "row", "block", "file", "offset", "length")
    both = blocks.union(asked.select("part", "key", F.coalesce("row", F.lit(-1)), *nothing))
    return both.groupBy("part").applyInPandas(search, FOUND)


RECORD = "row long, id long, type string, payload_bytes long, payload_digest string, to_row long, to_url string, payload binary"
_RECORD_ARROW = _arrow(RECORD)


def read_records(archive: Archive, places: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the places that ``lookup`` gave, by range reads; digest and length are those of the bytes read.

    ``to_row`` and ``to_url`` name the response that a revisit repeats. ``payload`` is empty for a
    revisit, and NULL throughout without ``with_payload``.
    """
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _files(folder)
        name, file = None, None
        for batch in batches:
            out, size = [], 0
            for p in batch.to_pylist():
                if p["file"] != name:
                    if file is not None:
                        file.close()
                    name, file = p["file"], system.open_input_file(f"{path}/{p['file']}")
                file.seek(p["offset"])
                headers, payload = parse_record(file.read(p["length"]))
                to = headers.get("WARC-Refers-To")
                out.append(
                    (uuid.UUID(headers["WARC-Record-ID"][10:-1]).int, p["id"], headers["WARC-Type"], len(payload), payload_digest(payload),
                     uuid.UUID(to[10:-1]).int if to else None, headers.get("WARC-Refers-To-Target-URI"), payload if with_payload else None)
                )
                size += len(payload) * with_payload
                if size > READ_BYTES:
                    yield _batch(out, _RECORD_ARROW)
                    out, size = [], 0
            yield _batch(out, _RECORD_ARROW)
        if file is not None:
            file.close()

    # Ranges of (file, offset) keep the reads of a task in order and split a large file. A place is a few
    # bytes, the record behind it any number, so the number of tasks follows the archive's bytes.
    tasks = 1 + archive.size // TASK_BYTES
    ordered = places.select("id", "file", "offset", "length").repartitionByRange(tasks, "file", "offset")
    return ordered.sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def read_pages(archive: Archive, scratch: Scratch) -> DataFrame:
    """One row per record of the archive, found by key: ``page_id``, ``record_type``, ``payload_bytes``,
    ``payload_digest`` and ``refers_to``, a revisit's payload being that of the response it names."""
    own = scratch.store(read_records(archive, lookup(archive, archive.captures), with_payload=False).drop("payload"), "records")
    revisits = own.where("type = 'revisit'")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([surt(u) for u in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys, batch.column(0)], names=["key", "row"])

    targets = revisits.select("to_row", "to_url").distinct().mapInArrow(keyed, "key string, row long")
    full = read_records(archive, lookup(archive, targets), with_payload=False).select(
        F.col("row").alias("to_row"), F.col("id").alias("refers_to"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest")
    )
    # Each response is there once; adaptive execution splits the revisits of a frequent one.
    resolved = revisits.join(full, "to_row", "left").select(
        F.col("id").alias("page_id"), F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )
    plain = own.where("type = 'response'").select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    )
    return plain.unionByName(resolved)
