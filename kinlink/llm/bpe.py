"""Byte-level BPE through a sentencepiece model that is serialised from the ranks.

Method. Each vocabulary entry becomes a piece whose characters stand for its
bytes (byte b is code point U+0100+b), scored by its negative rank; the
normaliser is the identity. A sentencepiece BPE model merges the adjacent pair
with the highest score first, leftmost on ties, which is the lowest rank first.
Texts are split by the pre-token pattern, each distinct pre-token is encoded
once for each worker (bounded memo), and ids are decoded by inverse mapping.
A pre-token that is itself an entry takes that entry's rank at once, as the
usual encoder does.

The model (about 1 MB, fixed by the vocabulary) is built on the driver and
broadcast, so executors need no vocabulary file.

Edge cases: null and empty texts have no ids (n_tokens 0, hashes of nothing);
repeated rows stay repeated; malformed UTF-8 is read with replacement
characters; other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.text import blobs, small_batches

#: Distinct pre-tokens that a worker remembers before it starts afresh.
MEMO_ENTRIES = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: one base64 entry and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def as_piece(data: bytes) -> str:
    return "".join(map(chr, (0x100 + b for b in data)))


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto in wire format whose ids are the ranks; the unknown piece comes last."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0..n-1")
    pieces = [_block(1, as_piece(p).encode()) + b"\x15" + struct.pack("<f", -float(r)) for p, r in by_rank]
    pieces.append(_block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(pieces) - 1)
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_block(1, p) for p in pieces) + _block(2, trainer) + _block(3, normaliser)


class _Memo(dict):
    """Pre-token -> (ids as comma-joined decimals, decoded bytes)."""

    def __init__(self, ranks: dict[bytes, int], model: bytes):
        import sentencepiece

        super().__init__()
        self.ranks = ranks
        self.entries = sorted(ranks, key=ranks.get)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chars = {b: 0x100 + b for b in range(256)}

    def ids(self, tokens: list[str]) -> list[list[int]]:
        data = [t.encode() for t in tokens]
        whole = [self.ranks.get(d) for d in data]
        rest = iter(self.processor.encode([d.decode("latin-1").translate(self.chars) for d, r in zip(data, whole) if r is None], num_threads=1))
        return [next(rest) if r is None else [r] for r in whole]

    def learn(self, tokens: set[str]) -> None:
        """Encode what is not known yet; a full memo starts afresh with this batch's pre-tokens."""
        new = list(tokens.difference(self))
        if len(self) + len(new) > MEMO_ENTRIES:
            self.clear()
            new = list(tokens)
        for token, ids in zip(new, self.ids(new)):
            self[token] = ",".join(map(str, ids)), b"".join(map(self.entries.__getitem__, ids))


#: The usual pattern and an equal one that tries letters first: what the alternatives
#: begin with differs, so their order doesn't matter, and letters are most frequent.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FASTER = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_codecs: dict[int, tuple[_Memo, regex.Pattern]] = {}


def _codec(shared) -> tuple[_Memo, regex.Pattern]:
    ranks, model, pattern = shared.value
    key = hash((model, pattern))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = _Memo(ranks, model), regex.compile(_FASTER if pattern == _USUAL else pattern)
    return _codecs[key]


def _shared(spark, path: str, pattern: str):
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((ranks, serialise_model(ranks), pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>, decoded binary) of every whole text."""
    return _mapped(docs, path, pattern, id_col, text_col, digest=False)


def encode_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what :func:`encode` returns."""
    return _mapped(docs, path, pattern, id_col, text_col, digest=True)


def _mapped(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    shared = _shared(spark, path, pattern)
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rx = _codec(shared)
        for batch in batches:
            n, first, second = [], [], []
            split = [rx.findall(data.decode("utf-8", "replace")) for data in blobs(batch.column(1))]
            memo.learn(set().union(*split))
            for tokens in split:
                got = list(map(memo.__getitem__, tokens))
                ids = ",".join([x[0] for x in got])
                n.append(ids.count(",") + 1 if ids else 0)
                decoded = b"".join([x[1] for x in got])
                if digest:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(decoded).hexdigest())
                else:
                    first.append(list(map(int, ids.split(","))) if ids else [])
                    second.append(decoded)
            kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names=names)

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    kinds = ("string", "string") if digest else ("array<int>", "binary")
    schema = f"`{id_col}` {id_type.simpleString()}, n_tokens long, `{names[2]}` {kinds[0]}, `{names[3]}` {kinds[1]}"
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of lists of ids; null lists decode to nothing."""
    spark = encoded.sparkSession
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast(sorted(ranks, key=ranks.get))
    id_type = encoded.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for batch in batches:
            out = [b"".join(map(entries.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, decoded binary")
