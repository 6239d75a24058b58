"""WARC archives: writing, normalising whole-file gzip streams, and reading by offset.

An archive that is one gzip stream can only be read from its start. The normaliser inflates such
a stream once, writes every record as a gzip member of its own, and puts an index of offsets
beside the archive. Archives live in a folder that all executors share; their names are unique
per task attempt and only successful attempts report them, so a lost executor leaves no wrong
file behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.scratch import shared_folder

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT_TYPE = "application/http; msgtype=response"
#: Bytes of payload after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
PAYLOAD_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, "
                  "record_type string, refers_to long, record_id string, payload binary")
INDEX_SCHEMA = "archive string, offset long, length long, record_id string, record_type string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {payload_digest} {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str,
           refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has the HTTP header alone. Line breaks in an address are escaped."""
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A").strip() or "about:blank"
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, url, payload_digest), "WARC-Date": date,
        "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "Content-Type": CONTENT_TYPE, "Page-ID": "" if page_id is None else str(page_id),
        "URL-Present": "0" if url is None else "1"}
    if refers_to is None:
        block += payload
    else:
        head |= {"WARC-Profile": PROFILE, "Refers-To-Page-ID": str(refers_to)}
    head["Content-Length"] = str(len(block))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


class Fields(dict):
    """Header fields by name without regard to case, as archives spell them differently."""

    def __init__(self, head: bytes):
        """A blank behind the colon is optional, and a line that begins with a blank goes on
        with the field before it. Of fields of the same name the last counts."""
        unfolded = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace")
        for line in unfolded.splitlines()[1:]:
            name, _, value = line.partition(":")
            self[name.strip().lower()] = value.strip()

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


_HEAD_END, _BLANK = re.compile(rb"\r?\n\r?\n"), re.compile(rb"[\r\n\0]*")


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[Fields, bytes, bytes]]:
    """Header, block and all bytes of each record of an inflated stream; what is held at a time
    is one record and a chunk.

    Line ends may be bare line feeds, and the line ends behind a block may be missing or more
    than two; what a record lacks of them is added. Zero bytes between and behind records are
    padding. A record without a length, or one that the stream ends within, raises ValueError.
    """
    held = bytearray()

    def fill(least: int) -> bool:
        while len(held) < least:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while (blank := _BLANK.match(held).end()) == len(held):
            held.clear()
            if not fill(1):
                return
        del held[:blank]
        seen = 0
        while not (end := _HEAD_END.search(held, max(0, seen - 4))):
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("the archive ends within a record")
        head = Fields(bytes(held[:end.start()]))
        if not held.startswith(b"WARC/") or not (head.get("Content-Length") or "").isdecimal():
            raise ValueError("a record without a version or length")
        size = end.end() + int(head["Content-Length"])
        if not fill(size):
            raise ValueError("the archive ends within a record")
        yield head, bytes(held[end.end():size]), bytes(held[:size]) + b"\r\n\r\n"
        del held[:size]


def inflate(source) -> Iterator[bytes]:
    """Inflated chunks of a gzip file of one or more members, in bounded memory. Zero bytes
    behind the last member are padding; a member cut anywhere, its trailer included, raises
    ValueError."""
    engine, begun = zlib.decompressobj(31), False
    while data := source.read(CHUNK):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):
                break
            begun = True
            yield engine.decompress(data, 4 * CHUNK)
            while engine.unconsumed_tail and not engine.eof:
                yield engine.decompress(engine.unconsumed_tail, 4 * CHUNK)
            data = engine.unused_data
            if engine.eof:
                engine, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends within a gzip member")


def _file_system(uri: str):
    return pafs.FileSystem.from_uri(uri)


def mark_revisits(pages: DataFrame, min_bytes: int, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest (hex) and refers_to, the least page_id with an equal payload
    where that is another one and the payload has at least ``min_bytes``.

    The least id per digest is aggregated before the shuffle; the join with it lets Spark split
    a digest that many pages share.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    return rows.join(first, "digest").withColumn("refers_to", F.when(
        (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")),
        F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0,
                   date: str = "1970-01-01T00:00:00Z", level: int = 6,
                   archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> DataFrame:
    """One archive per task, or more for large ones, each a single gzip stream. Returns archive
    and records, and must be written or cached by the caller, as each evaluation writes anew."""
    def work(batches):
        out = engine = path = None
        size = count = 0
        system, root = _file_system(folder)
        for batch in batches:
            columns_ = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page, url, payload, hexed, refers = (c[i].as_py() for c in columns_)
                if out is None:
                    path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = system.open_output_stream(path, compression=None), \
                        zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(page, url, payload, base64.b32encode(bytes.fromhex(hexed)).decode(),
                              refers, date)
                out.write(engine.compress(data))
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.write(engine.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [path], "records": [count]})
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "records": [count]})

    _make(pages.sparkSession, folder)
    return mark_revisits(pages, min_bytes, **columns) \
        .select("page_id", "url", "payload", "digest", "refers_to") \
        .mapInArrow(work, "archive string, records long")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive with a gzip member per record and a sidecar index of JSON lines
    beside it, in one pass. Returns the index rows; write or cache them, as above."""
    def work(batches):
        system, root = _file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name, offset, rows = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, []
                with system.open_input_stream(path, compression=None) as source, \
                        system.open_output_stream(name, compression=None) as out:
                    for head, _, data in split_records(inflate(source)):
                        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = engine.compress(data) + engine.flush()
                        out.write(member)
                        rows.append({"archive": name, "offset": offset, "length": len(member),
                                     "record_id": head.get("WARC-Record-ID"),
                                     "record_type": head.get("WARC-Type")})
                        offset += len(member)
                with system.open_output_stream(f"{name}.idx", compression=None) as side:
                    side.write("".join(json.dumps(r) + "\n" for r in rows).encode())
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    _make(archives.sparkSession, folder)
    return archives.select("archive").mapInArrow(work, INDEX_SCHEMA)


def read_records(index: DataFrame) -> DataFrame:
    """The records that an index names, read at their offsets: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, record_id, payload (null for revisits). The digest of
    a response is computed from the payload read; a mismatch with its header is an error."""
    def work(batches):
        opened, source = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)),
                                            strict=True):
                if path != opened:
                    if source is not None:
                        source.close()
                    system, at = _file_system(path)
                    opened, source = path, system.open_input_file(at)
                source.seek(offset)
                member = zlib.decompress(source.read(length), 31)
                head, block, _ = next(split_records(iter([member])))
                http, payload = block.split(b"\r\n\r\n", 1)
                named = head["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = head["WARC-Type"] == "revisit"
                if not revisit and digest(payload) != named:
                    raise ValueError(f"{path} at {offset}: the payload is not as its digest says")
                rows.append((
                    int(head["Page-ID"]) if head["Page-ID"] else None,
                    head["WARC-Target-URI"] if head["URL-Present"] == "1" else None,
                    int(http.rsplit(b"Content-Length: ", 1)[1]), named, head["WARC-Type"],
                    int(head["Refers-To-Page-ID"]) if revisit else None,
                    head["WARC-Record-ID"], None if revisit else payload))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                     pa.string(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    [c.split()[0] for c in PAYLOAD_SCHEMA.split(", ")])

    return index.select("archive", "offset", "length").mapInArrow(work, PAYLOAD_SCHEMA)


def _make(spark: SparkSession, folder: str) -> None:
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)


def round_trip(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write every page to an archive, normalise the archives and read all records back, in a
    new folder below the shared one.

    Null html is the empty payload; equal payloads of at least ``min_bytes`` refer to the least
    page_id; rows that repeat that id are responses like it. A null id is kept and refers to the
    least id, if there is one. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    base = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex[:12]}"
    write_archives(pages, f"{base}/whole", min_bytes, **columns) \
        .write.parquet(f"{base}/archives")
    archives = spark.read.schema("archive string, records long").parquet(f"{base}/archives")
    spread = archives.repartition(spark.sparkContext.defaultParallelism * 4, "archive")
    normalise(spread, f"{base}/members").write.parquet(f"{base}/index")
    return read_records(spark.read.schema(INDEX_SCHEMA).parquet(f"{base}/index"))
