"""WARC archives with a two-level capture index.

Writing. Tasks write gzip-per-record archives into the shared folder and return
one capture row per record: the URL key with its host reversed, the file, offset
and length. A file's name holds the attempt that wrote it, so a repeated task
cannot mix its records with those of a lost one, and only rows of committed
tasks are indexed. Records with equal payloads are one response, that with the
largest id, and revisits that name it and carry no payload.

Index. Captures are range-partitioned and sorted by key and cut into blocks of
BLOCK_LINES lines, each compressed on its own (first level); the directory holds
a row per block with its first and last key and its place (second level). A
lookup finds the blocks of a key in the sorted directory, reads their byte
ranges, bisects their lines, and reads the records' ranges.

Defined results: a null html is an empty payload and a null URL an empty key;
empty payloads are equal like others; rows repeated with the same largest id are
all responses; a null id never is the response of a group that has another id;
an empty table gives no files and an empty result; other columns are not read.
Files are reached through the file system that the folder's URI names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm.tables import table
from bidloom.session import Scratch

BLOCK_LINES = 1000
LEVEL = 4
DATE = "2026-01-01T00:00:00Z"
_LINE_END = b"\r\n"
CAPTURE = "key string, id string, file string, place bigint, size bigint"
DIRECTORY = "first string, last string, file string, place bigint, size bigint, lines bigint"


def url_key(url: Column) -> Column:
    """The URL as an index key: host labels reversed and in lower case, then the path and query; no scheme, user, port or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    authority = F.regexp_extract(bare, "^[^/?]*", 0)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
    rest = F.substring(bare, F.length(authority) + 1, F.length(bare))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def record(id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record, uncompressed; a revisit has the header of the answer without its payload."""
    answer = _LINE_END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{id}>", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        answer += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(answer)}", "", ""]
    return "\r\n".join(head).encode() + answer + 2 * _LINE_END


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record's fields, the answer's fields and the payload."""
    head, _, block = raw.partition(2 * _LINE_END)
    fields = lambda text: dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:])
    warc = fields(head)
    answer, _, payload = block[: int(warc["Content-Length"])].partition(2 * _LINE_END)
    return warc, fields(answer), payload


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, out, place = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            rows = []
            for id, url, html, refers, key in zip(*[batch.column(c).to_pylist() for c in ("id", "url", "html", "refers", "key")]):
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                packed = gzip.compress(record(str(id), url or "", payload, digest, refers), LEVEL, mtime=0)
                out.write(packed)
                rows.append((key, str(id), name, place, len(packed)))
                place += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["key", "id", "file", "place", "size"])
        if out is not None:
            out.close()

    return write


def _blocks(folder: str, lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, out, place, held = f"captures-{uuid.uuid4().hex}.idx", None, 0, []

        def block(some: list[tuple]) -> tuple:
            nonlocal place
            packed = zlib.compress("\n".join("\t".join(map(str, row)) for row in some).encode())
            out.write(packed)
            place += len(packed)
            return some[0][0], some[-1][0], name, place - len(packed), len(packed), len(some)

        for batch in batches:
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            clean = [re.sub(r"[\t\n]", " ", k) for k in batch.column("key").to_pylist()]
            held += zip(clean, *[batch.column(c).to_pylist() for c in ("id", "file", "place", "size")])
            full = len(held) // lines * lines
            if full:
                rows = [block(held[k:k + lines]) for k in range(0, full, lines)]
                held = held[full:]
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], DIRECTORY_NAMES)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in block(held)], DIRECTORY_NAMES)
        if out is not None:
            out.close()

    return write


DIRECTORY_NAMES = [part.split()[0] for part in DIRECTORY.split(", ")]


def _read_block(fs: pafs.FileSystem, root: str, file: str, place: int, size: int) -> list[list[str]]:
    with fs.open_input_file(f"{root}/{file}") as f:
        return [line.split("\t") for line in zlib.decompress(f.read_at(size, place)).decode().split("\n")]


def _captures(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for batch in batches:
            for file, place, size in zip(*[batch.column(c).to_pylist() for c in ("file", "place", "size")]):
                key, id, name, at, length = map(list, zip(*_read_block(fs, root, file, place, size)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(id), pa.array(name), pa.array(list(map(int, at))), pa.array(list(map(int, length)))], ["key", "id", "file", "place", "size"]
                )

    return read


def _named(urn: str | None) -> int | None:
    value = urn[len("<urn:page:"):-1] if urn else "None"
    return None if value == "None" else int(value)


def _records(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for wanted, place, size in zip(*[batch.column(c).to_pylist() for c in ("file", "place", "size")]):
                if wanted != name:
                    if file is not None:
                        file.close()
                    name, file = wanted, fs.open_input_file(f"{root}/{wanted}")
                warc, answer, payload = parse(gzip.decompress(file.read_at(size, place)))
                digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                if warc["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{wanted} at {place}: the payload does not match its digest")
                rows.append((_named(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], int(answer["Content-Length"]), digest, warc["WARC-Type"], _named(warc.get("WARC-Refers-To")), payload if warc["WARC-Type"] == "response" else None))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if file is not None:
            file.close()

    return read


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


class Archive:
    """Archives and their index in one folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str, directory: DataFrame):
        self.spark, self.folder, self.directory = spark, folder, directory

    @classmethod
    def write(cls, pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", block_lines: int = BLOCK_LINES) -> Archive:
        scratch = Scratch(pages.sparkSession, "warc")
        folder = f"{scratch.root}/archive"
        rows = pages.select(F.col(id).cast("bigint").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
        rows = rows.withColumns({"key": url_key(F.col("url")), "sha": F.sha1(F.coalesce("html", F.lit("")).cast("binary"))})
        equal = rows.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last")
        rows = rows.join(scratch.save(equal, "equal"), "sha", "left")
        refers = F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last").cast("string"))
        captures = scratch.save(rows.select("id", "url", "html", "key", refers.alias("refers")).mapInArrow(_write(folder), CAPTURE), "captures")
        ordered = captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
        directory = scratch.save(ordered.mapInArrow(_blocks(folder, block_lines), DIRECTORY), "directory")
        return cls(pages.sparkSession, folder, directory)

    def captures(self) -> DataFrame:
        """All capture rows, from the index blocks."""
        return self.directory.select("file", "place", "size").repartition("file", "place").mapInArrow(_captures(self.folder), CAPTURE)

    def records(self) -> DataFrame:
        """All records, by range reads in the order of the files."""
        some = self.captures().select("file", "place", "size").sortWithinPartitions("file", "place")
        return some.mapInArrow(_records(self.folder), RECORD)

    def find(self, url: str) -> list[dict]:
        """The records of one URL: directory, block, bisected lines, range reads."""
        key = self.spark.range(1).select(url_key(F.lit(url))).first()[0]
        blocks = self.directory.where((F.col("first") <= key) & (F.col("last") >= key)).collect()
        fs, root = _open(self.folder)
        found = []
        for b in blocks:
            lines = _read_block(fs, root, b["file"], b["place"], b["size"])
            for k in range(bisect_left(lines, key, key=lambda line: line[0]), len(lines)):
                if lines[k][0] != key:
                    break
                with fs.open_input_file(f"{root}/{lines[k][2]}") as f:
                    warc, answer, payload = parse(gzip.decompress(f.read_at(int(lines[k][4]), int(lines[k][3]))))
                found.append({"warc": warc, "answer": answer, "payload": payload})
        return found


def op10_warc(spark, sf_dir):
    archive = Archive.write(table(spark, sf_dir, "pages"))
    return archive.records().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31), 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM r"""

ORACLES = {"op10_warc": ORACLE}
QUERIES = {"op10_warc": op10_warc}
