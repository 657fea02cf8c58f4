"""Byte-level BPE over distinct words.

Encoding: texts are split into pre-tokens. A block of texts numbers its distinct words and keeps,
per text, the word numbers by position; its words go, packed by hash, to the one task that owns
them, where each distinct word of the corpus is merged once; the ids come back to their block and
the positions put them in order. Shuffled are a block's distinct words and its numbers, not its
occurrences of words with their context: some 0.9 bytes for each byte of compressed input.

Decoding joins ids with the token-byte table, which has one row per vocabulary entry.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from keyweave.llm._common import checkpointed, release_memory, small_batches

#: A block is closed after this many characters of text.
BLOCK_CHARS = 32 << 20
#: Bytes of text for which there is a task that owns words and one that reassembles.
TASK_BYTES = 64 << 20
#: A row of positions is closed after this many of them.
CHUNK = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a rank file: lines of base64 and decimal."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


LEVEL = 6


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 to 2**32 - 1, compressed byte plane by byte plane; the mostly empty upper planes cost next to nothing."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as two bytes each, whose pairs recur, or four if one needs them; the first byte tells which."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + zstandard.ZstdCompressor(level=LEVEL).compress(ids.astype(f"<u{width}").tobytes())


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), f"<u{packed[0]}")


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return pack(sizes), zstandard.ZstdCompressor(level=LEVEL + 3).compress(b"".join(words))


def unpack_words(sizes: bytes, packed: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(unpack(sizes), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def gather(starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the concatenated runs (starts, sizes)[picks], and the size of each."""
    taken = sizes[picks].astype(np.int64)
    ends = np.cumsum(taken)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts[picks] - ends + taken, taken), taken


class TokenBytes:
    """The token-byte table, by id, and the join of arrays of ids with it."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def join(self, ids: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
        """The bytes of each run of ids; ends[i] to ends[i + 1] is run i."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.sizes):
            raise ValueError("an id is not in the token-byte table")
        places, taken = gather(self.starts, self.sizes, ids)
        upto = np.r_[0, np.cumsum(taken)][ends].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(upto), pa.py_buffer(self.data[places])])


#: kind 0: a block's words of one part in rising order of their numbers (sizes, payload, differences of the numbers); kind 1: positions of some texts (keys, sizes: pre-tokens per text, payload).
def _split_schema(key_type) -> StructType:
    fields = [("kind", IntegerType()), ("block", LongType()), ("place", LongType()), ("keys", ArrayType(key_type)), ("sizes", BinaryType()), ("payload", BinaryType()), ("numbers", BinaryType())]
    return StructType([StructField(n, t) for n, t in fields])


class _Block:
    """Collects the texts of one block and gives its rows."""

    def __init__(self, number: int, parts: int, schema: pa.Schema):
        self.number, self.parts, self.schema, self.chars = number, parts, schema, 0
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.keys: list = []
        self.texts: list[np.ndarray] = []

    def add(self, key, text: str | None, find) -> None:
        found = find(text) if text else []
        self.keys.append(key)
        self.texts.append(np.fromiter(map(self.words.__getitem__, found), np.uint32, len(found)))
        self.chars += len(text or "")

    def rows(self) -> Iterator[pa.RecordBatch]:
        n = len(self.words)
        uses = np.bincount(np.concatenate(self.texts), minlength=n)
        renumbered = np.empty(n, np.uint32)  # frequent words get small numbers
        renumbered[np.argsort(-uses, kind="stable")] = np.arange(n, dtype=np.uint32)
        words = [w.encode() for w in self.words]
        self.words.clear()
        part = np.fromiter(map(zlib.crc32, words), np.uint32, n) % np.uint32(self.parts)
        order = np.lexsort((renumbered, part))
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[p] : cuts[p + 1]]
            sizes, payload = pack_words([words[i] for i in own])
            yield self._row(0, int(p), [], sizes, payload, pack(np.diff(renumbered[own], prepend=np.uint32(0))))
        start = held = 0
        for i, text in enumerate(self.texts):
            held += len(text)
            if held >= CHUNK or i + 1 == len(self.texts):
                texts = self.texts[start : i + 1]
                sizes = np.array([len(t) for t in texts], np.uint32)
                yield self._row(1, start, self.keys[start : i + 1], pack(sizes), pack(renumbered[np.concatenate(texts)]), None)
                start, held = i + 1, 0

    def _row(self, kind, place, keys, sizes, payload, numbers) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": kind, "block": self.number, "place": place, "keys": keys, "sizes": sizes, "payload": payload, "numbers": numbers}], schema=self.schema)


def _splitter(pattern: str, parts: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, number = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        block = schema = None
        for batch in batches:
            if block is None:
                fields = [("kind", pa.int32()), ("block", pa.int64()), ("place", pa.int64()), ("keys", pa.list_(batch.column(0).type)), ("sizes", pa.binary()), ("payload", pa.binary()), ("numbers", pa.binary())]
                schema = pa.schema(fields)
                block = _Block(number, parts, schema)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(key, text.as_py(), find)
                if block.chars >= BLOCK_CHARS:
                    yield from block.rows()
                    number += 1
                    block = _Block(number, parts, schema)
                    release_memory()
        if block is not None and block.keys:
            yield from block.rows()
        block = batch = None
        release_memory()

    return split


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", parts: int | None = None, decoded: bool = False, finish: Callable[[pa.Table], pa.Table] | None = None, finished: list[StructField] | None = None) -> DataFrame:
    """One row per row of df: doc_id, ids (array of int), as encoding each text's pre-tokens by ranks gives, without special tokens.

    decoded adds what decode(...) gives for these ids, joined in the same task. finish, if given, takes
    some rows doc_id, ids (and decoded) as an Arrow table and gives doc_id and the columns finished, so that
    what is wanted of the ids, such as digests, leaves the task instead of them.

    parts: tasks that own the distinct words, and tasks that reassemble blocks; by default one for each
    TASK_BYTES of text, which are added up first, but not fewer than the session's shuffle partitions. So a task's share of the corpus's
    distinct words and of the blocks stays the same however large the corpus is; one block at a time is in memory.
    A common word comes once from each block, so no part is hot. Rows in the shared folder between the
    two steps make the numbers of a block survive lost executors.

    Null and empty texts give no ids. A long text is one row and so is in one task. Repeated rows and
    equal or null keys stay apart, being told by position; an empty table gives an empty result; other
    columns are not looked at.
    """
    spark = df.sparkSession
    if parts is None:
        total = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("bytes")).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    key_type = rows.schema["doc_id"].dataType
    with small_batches(spark):
        made = checkpointed(rows.mapInArrow(_splitter(pattern, parts), _split_schema(key_type)))
    shared = spark.sparkContext.broadcast(ranks)  # one entry per vocabulary entry

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pattern that takes any text whole: what comes in is one pre-token each.
        piece = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = unpack_words(row["sizes"], row["payload"])
                for word in words:
                    if word not in known:
                        known[word] = np.array(piece(word.decode()), np.uint32).tobytes()
                found = [known[w] for w in words]
                counts = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                out.append((row["block"], row["numbers"], pack(counts), pack_ids(np.frombuffer(b"".join(found), np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "numbers", "sizes", "ids"])

    words = made.where("kind = 0").select("place", "block", "sizes", "payload", "numbers").repartition(parts, "place")
    merged = words.mapInArrow(merge, "block long, numbers binary, sizes binary, ids binary")
    texts = made.where("kind = 1").select("block", "place", "keys", "sizes", "payload")

    def reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        release_memory()
        sizes = np.zeros(0, np.int64)
        numbers = [np.cumsum(unpack(x), dtype=np.int64) for x in words.column("numbers").to_pylist()]
        counts, ids = [unpack(x) for x in words.column("sizes").to_pylist()], [unpack_ids(x) for x in words.column("ids").to_pylist()]
        if numbers:
            number, count = np.concatenate(numbers), np.concatenate(counts).astype(np.int64)
            sizes, starts = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            sizes[number], starts[number] = count, np.cumsum(count) - count
        flat = np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(np.int32)
        made = []
        key_kind = texts.schema.field("keys").type.value_type
        table = TokenBytes(shared.value) if decoded else None
        for i in np.argsort(texts.column("place").to_numpy(), kind="stable"):
            row = texts.slice(i, 1).to_pylist()[0]
            per_text, at = unpack(row["sizes"]).astype(np.int64), unpack(row["payload"])
            places, taken = gather(starts, sizes, at) if len(at) else (at.astype(np.int64), at)
            upto = np.r_[0, np.cumsum(taken)][np.r_[0, np.cumsum(per_text)]]
            columns = {"doc_id": pa.array(row["keys"], key_kind), "ids": pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat[places]))}
            some = pa.table(columns | ({"decoded": table.join(flat[places], upto)} if table else {}))
            made.append(finish(some) if finish else some)
        return pa.concat_tables(made)

    columns = [StructField("ids", ArrayType(IntegerType())), *([StructField("decoded", BinaryType())] if decoded else [])]
    schema = StructType([StructField("doc_id", key_type), *(finished if finish else columns)])
    texts, merged = (x.repartition(parts, "block") for x in (texts, merged))  # both meet as they lie; the planner would take the session's partitions
    return texts.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(reassemble, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with decoded, the bytes of its ids; a column of that name is replaced.

    Ids are joined with the token-byte table, an array by id of vocabulary size that every task gets.
    A null array gives null, an empty one no bytes; an id outside the table is an error; an id that is
    null is left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenBytes(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            out = []
            for one in batch.column(at):
                run = one.values.drop_null().to_numpy() if one.is_valid else None
                out.append(None if run is None else table.join(run, np.array([0, len(run)]))[0].as_py())
            kept = [c for c in batch.schema.names if c != decoded]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(out, pa.binary())], names=[*kept, decoded])

    fields = [f for f in df.schema.fields if f.name != decoded]
    return df.mapInArrow(join, StructType([*fields, StructField(decoded, BinaryType())]))


#: What digest gives beside doc_id.
DIGESTS = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]


def digest(rows: pa.Table) -> pa.Table:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 from doc_id, ids, decoded."""
    counts, of_ids, of_bytes = [], [], []
    for ids, decoded in zip(rows.column("ids"), rows.column("decoded")):
        numbers = ids.values.to_numpy()
        counts.append(len(numbers))
        of_ids.append(hashlib.sha256(",".join(map(str, numbers.tolist())).encode()).hexdigest())
        of_bytes.append(hashlib.sha256(decoded.as_buffer()).hexdigest())
    return pa.table([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", *[f.name for f in DIGESTS]])
