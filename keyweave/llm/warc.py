"""WARC archives with a two-level capture index.

Every task writes records, each a gzip member, to files of its own. The index sorts captures by
reversed-host URL key; blocks of lines are compressed one by one; a sparse directory beside each
index file has the first key of every block. A lookup searches the first keys of the index files
(one per task that wrote them), then that file's directory, then one block, by bisection; only
that block and the record itself are read.

File names are new for each attempt of a task, and only what successful attempts report is indexed,
so tasks that run twice do no harm. All files lie in one folder that driver and executors share, in
any store that pyarrow.fs reaches.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.llm._common import ascii_lower, broadcast_if_small, checkpointed, shared_path

#: Captures in one compressed block of the index.
LINES = 512
#: A task starts another archive file beyond this size.
FILE_BYTES = 1 << 30
#: Compressed bytes that a task reads back.
READ_BYTES = 64 << 20
#: The most files of one index, whose first keys go to every task that looks something up.
INDEX_FILES = 4096
NO_ID = -(1 << 63)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pa.fs.FileSystem.from_uri(folder)
    return pa.fs.LocalFileSystem(), folder


def url_key(url: Column) -> Column:
    """Reversed-host key: com,example,www)/path?query, host in lower case, without scheme, user name, fragment; what has no :// is kept as it is, null is empty."""
    rest = F.substring_index(F.regexp_extract(url, r"(?s)://(.*)", 1), "#", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)", 1)
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.concat(reversed_host, F.lit(")"), tail)).otherwise(url), F.lit(""))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload: bytes | None  # None for a revisit
    payload_bytes: int
    payload_digest: str


def format_record(record: Record, date: str) -> bytes:
    """One WARC/1.1 record. Line ends inside a URL are percent-encoded, so no header can be forged."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record.payload_bytes}\r\n\r\n".encode()
    block = http + (record.payload or b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {record.record_type}", f"WARC-Record-ID: {name(record.page_id)}", f"WARC-Date: {date}"]
    if record.url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", record.url))
    head.append(f"WARC-Payload-Digest: sha1:{record.payload_digest}")
    if record.record_type == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(record.refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """What format_record wrote. The payload's length and digest are worked out anew and must agree with the headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    number = lambda text: int(text[10:-1]) if text and text != "<urn:page:>" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return Record(number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), None if revisit else payload, size, digest)


def _batch(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def write_archive(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of df; returns the captures: url_key, page_id, file, offset, length.

    Of records with equal payloads of min_bytes or more that with the largest key is the response, the
    others revisit it; smaller payloads are all responses. Payloads stay in the tasks that read them
    while the repeated digests, counted first, are few; only beyond that they are shuffled to meet them.

    A null payload is empty. A null key is smaller than any; such rows revisit if another row with a key
    has the payload, and else are all responses, as are rows that share the largest key. A null URL has no
    header. Repeated rows are records each. An empty table gives no captures.
    """
    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    alike = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    alike = broadcast_if_small(checkpointed(alike.where("n > 1 and original is not null").select(F.col("sha1").alias("alike"), "original")))
    revisits = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    rows = rows.join(alike, rows["sha1"] == alike["alike"], "left").select(
        url_key(F.col("url")).alias("url_key"), "page_id", "url", "payload", F.when(revisits, F.col("original")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in batches:
                lines = []
                for surt, page, target, body, original in zip(*(batch.column(i) for i in range(5))):
                    body, original = body.as_py(), original.as_py()
                    kind = "response" if original is None else "revisit"
                    record = Record(page.as_py(), target.as_py(), kind, original, body if original is None else None, len(body), digest_of(body))
                    member = gzip.compress(format_record(record, date), 6, mtime=0)
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    lines.append((surt.as_py(), page.as_py(), name, at, len(member)))
                    at += len(member)
                yield _batch(lines, ("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))
        finally:
            if out is not None:
                out.close()

    return checkpointed(rows.mapInArrow(write, "url_key string, page_id long, file string, offset long, length long"))


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the index of captures; returns its files in order: file, first_key, first_id. One row per task that wrote, INDEX_FILES at most."""
    order = ("url_key", "id", "file", "offset")
    parts = min(INDEX_FILES, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = captures.select("url_key", F.coalesce("page_id", F.lit(NO_ID)).alias("id"), "file", "offset", "length").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        name, out, at, lines, directory = f"{uuid.uuid4().hex}.idx", None, 0, [], []

        def flush() -> int:
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(data)
            directory.append([lines[0][0], lines[0][1], at, len(data)])
            return at + len(data)

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(line)
                if len(lines) == LINES:
                    at, lines = flush(), []
        if lines:
            at = flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as beside:
                beside.write(zlib.compress("\n".join(json.dumps(x) for x in directory).encode()))
            yield _batch([(name, *directory[0][:2])], ("file", pa.string()), ("first_key", pa.string()), ("first_id", pa.int64()))

    return checkpointed(rows.mapInArrow(write, "file string, first_key string, first_id long"))


def _order(key: str, number: int) -> tuple[bytes, int]:
    return key.encode(), number


class _Reader:
    """Range reads with the last few files, directories and blocks at hand."""

    def __init__(self, archive: str, index: str, files: list[tuple[str, str, int]]):
        (self.archive, self.archive_root), (self.index, self.index_root) = store(archive), store(index)
        self.names, self.firsts = [f[0] for f in files], [_order(*f[1:]) for f in files]
        self.kept: OrderedDict = OrderedDict()

    def _cached(self, what: tuple, make):
        if what not in self.kept:
            self.kept[what] = make()
            if len(self.kept) > 64:
                old = self.kept.popitem(last=False)[1]
                if isinstance(old, pa.NativeFile):
                    old.close()
        self.kept.move_to_end(what)
        return self.kept[what]

    def _bytes(self, fs, path: str, at: int, size: int) -> bytes:
        source = self._cached(("file", path), lambda: fs.open_input_file(path))
        return source.read_at(size, at)

    def _directory(self, name: str) -> tuple[list, list]:
        def load():
            with self.index.open_input_file(f"{self.index_root}/{name}.dir") as source:
                rows = [json.loads(x) for x in zlib.decompress(source.read()).split(b"\n")]
            return [_order(*r[:2]) for r in rows], rows

        return self._cached(("dir", name), load)

    def _block(self, name: str, i: int) -> tuple[list, list]:
        def load():
            at, size = self._directory(name)[1][i][2:]
            rows = [json.loads(x) for x in zlib.decompress(self._bytes(self.index, f"{self.index_root}/{name}", at, size)).split(b"\n")]
            return [_order(*r[:2]) for r in rows], rows

        return self._cached(("block", name, i), load)

    def find(self, low: tuple[bytes, int], high: tuple[bytes, int]) -> Iterator[list]:
        """Index lines from low to high, both included."""
        first = max(0, bisect_left(self.firsts, low) - 1)
        for f in range(first, bisect_right(self.firsts, high)):
            keys = self._directory(self.names[f])[0]
            for b in range(max(0, bisect_left(keys, low) - 1), bisect_right(keys, high)):
                found, rows = self._block(self.names[f], b)
                yield from rows[bisect_left(found, low) : bisect_right(found, high)]

    def record(self, line: list) -> Record:
        return parse_record(gzip.decompress(self._bytes(self.archive, f"{self.archive_root}/{line[2]}", line[3], line[4])))


RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def lookup(requests: DataFrame, archive: str, index: str, files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Records of RECORD for the requested captures: requests has url_key and, if one capture is meant, page_id.

    Without the column page_id all captures of the key come; a null page_id means the capture that
    has none. Equal requests are asked once. Requests are sorted as the index is, so a task reads few
    blocks. The list of index files, INDEX_FILES at most, goes to every task. tasks says
    how many share the reading, whose bytes the planner doesn't see; by default it decides itself.
    """
    known = sorted(((f.file, f.first_key, f.first_id) for f in files.collect()), key=lambda f: _order(*f[1:]))
    one = "page_id" in requests.columns
    number = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)) if one else F.lit(NO_ID)
    asked = requests.select(F.coalesce("url_key", F.lit("")).alias("url_key"), number.alias("id")).distinct()
    asked = asked.repartitionByRange(*([tasks] if tasks else []), "url_key", "id").sortWithinPartitions("url_key", "id")
    shared = requests.sparkSession.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(archive, index, shared.value)
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
        fields = list(zip(Record._fields, types))
        for batch in batches:
            out, held = [], 0
            for key, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line in reader.find(_order(key, number), _order(key, number if one else (1 << 63) - 1)):
                    record = reader.record(line)
                    out.append(record)
                    held += len(record.payload or b"")
                    if held > 16 << 20 or len(out) == 10_000:
                        yield _batch(out, *fields)
                        out, held = [], 0
            if out:
                yield _batch(out, *fields)

    return asked.mapInArrow(read, RECORD)


def archive_and_read(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes df to a new archive in the shared folder, indexes it, and reads every capture back by its key.

    The records are read when they are asked for, so the archive stays; inside scratch(...) it goes at its end.
    """
    folder = shared_path(df.sparkSession, "warc")
    captures = write_archive(df, f"{folder}/archive", key, url, payload, min_bytes)
    files = write_index(captures, f"{folder}/index")
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first().bytes
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    return lookup(captures.select("url_key", "page_id"), f"{folder}/archive", f"{folder}/index", files, tasks)
