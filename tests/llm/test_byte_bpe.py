import hashlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken

import public_tokenizers
from keyweave.llm import byte_bpe
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(library, rows):
    out = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    """Digests of ids and bytes as they leave the operators."""
    return sorted(((r.doc_id, len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(bytes(r.decoded)).hexdigest()) for r in df.collect()), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_the_library(documents, document_rows, ranks, library):
    made = byte_bpe.encode(documents, ranks, public_tokenizers.PATTERN, decoded=True)
    assert made.columns == ["doc_id", "ids", "decoded"]
    expected = want(library, [(r.doc_id, r.text) for r in document_rows])
    assert digests(made) == expected
    assert rows(byte_bpe.encode(documents, ranks, public_tokenizers.PATTERN, decoded=True, finish=byte_bpe.digest, finished=byte_bpe.DIGESTS)) == expected


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(odd, no_documents, ranks, library, small, monkeypatch):
    if small:  # many blocks, many rows of positions; the workers fork after this
        monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 50)
        monkeypatch.setattr(byte_bpe, "CHUNK", 3)
    encoded = byte_bpe.encode(odd, ranks, public_tokenizers.PATTERN, parts=3)
    assert encoded.columns == ["doc_id", "ids"]
    decoded = byte_bpe.decode(encoded, ranks)
    assert digests(decoded) == want(library, [r[:2] for r in ODD])
    assert byte_bpe.encode(no_documents, ranks, public_tokenizers.PATTERN).count() == 0


def plain_merge(word: bytes, ranks) -> list[int]:
    """Byte-pair merges by the book: of all neighbours the pair of least rank becomes one, the first of equals, until none has a rank."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            break
        at = min(pairs)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_against_plain_merges(spark, document_rows, ranks):
    """Ids by an own splitter and merge loop, without any tokenizer library."""
    odd = ["\u00c9t\u00e9 \U0001f600\u00a0x", "aaaaaaaaaaaaaaaaaaaaaaa", "\n\n  x\t\t", "it's don't I'LL", "1234567 3.14", "\u4e2d\u6587 \u0e44\u0e17\u0e22", "x" * 300]
    texts = [(r.doc_id, r.text) for r in document_rows[:60] if r.text] + [(-1 - i, t) for i, t in enumerate(odd)]
    known: dict[str, list[int]] = {}

    def ids(text):
        out = []
        for word in regex.findall(public_tokenizers.PATTERN, text):
            if word not in known:
                known[word] = plain_merge(word.encode(), ranks)
            out += known[word]
        return out

    made = byte_bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), ranks, public_tokenizers.PATTERN, parts=3)
    assert {r.doc_id: list(r.ids) for r in made.collect()} == {k: ids(t) for k, t in texts}


def test_block_in_small_pieces(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 3)
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("place", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.binary()), ("payload", pa.binary()), ("numbers", pa.binary())])
    block = byte_bpe._Block(7, 4, schema)
    texts = ["b a b", None, "c b", "", "a a a a a"]
    for i, text in enumerate(texts):
        block.add(i, text, str.split)
    made = [r.to_pylist()[0] for r in block.rows()]
    number = {}
    for r in made:
        if r["kind"] == 0:
            number |= dict(zip(np.cumsum(byte_bpe.unpack(r["numbers"])).tolist(), byte_bpe.unpack_words(r["sizes"], r["payload"])))
    assert number[0] == b"a" and sorted(number.values()) == [b"a", b"b", b"c"]
    back = {}
    for r in (r for r in made if r["kind"] == 1):
        at = iter(byte_bpe.unpack(r["payload"]).tolist())
        for key, size in zip(r["keys"], byte_bpe.unpack(r["sizes"]).tolist()):
            back[key] = [number[next(at)].decode() for _ in range(size)]
    assert back == {i: (t or "").split() for i, t in enumerate(texts)}


def test_packing():
    for numbers in ([], [0], [1, 70_000, (1 << 32) - 1], list(range(300))):
        array = np.array(numbers, np.uint32)
        assert byte_bpe.unpack(byte_bpe.pack(array)).tolist() == numbers
        assert byte_bpe.unpack_ids(byte_bpe.pack_ids(array)).tolist() == numbers
    words = [b"", b"a", b"\xff\x00\n", b" the"]
    assert byte_bpe.unpack_words(*byte_bpe.pack_words(words)) == words


def test_decode_odd_arrays(spark, ranks):
    df = spark.createDataFrame([(1, [0, 1], "x"), (2, None, "x"), (3, [], "x"), (4, [5, None, 6], "x")], "doc_id int, ids array<int>, decoded string")
    back = {v: k for k, v in ranks.items()}
    got = {r.doc_id: r.decoded for r in byte_bpe.decode(df, ranks).collect()}
    assert got == {1: back[0] + back[1], 2: None, 3: b"", 4: back[5] + back[6]}
    with pytest.raises(Exception, match="token-byte table"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id int, ids array<int>"), ranks).collect()
