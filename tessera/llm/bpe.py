"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every byte is mapped to one printable character, as byte-level vocabularies do, every token becomes a piece of such
characters whose score is its negative rank, and normalisation is the identity. Sentencepiece then merges the adjacent
pair of the highest score first, leftmost first on ties, which is the merge of lowest rank.

Nulls count as empty texts, an empty text has no tokens. Rows keep their doc_id, null or repeated, one for one; further
columns are left behind. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_pass, slices, texts_of

#: Pre-tokens that a worker remembers; beyond it, it forgets all but the vocabulary.
CACHED = 100_000
#: Longer pre-tokens are encoded anew each time.
CACHED_CHARS = 48


def byte_characters() -> list[str]:
    """The character of each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks have gaps")
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: length-delimited bytes or a varint; a negative int takes ten bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto. Piece 0 is the unknown piece, piece r + 1 the token of rank r."""
    chars = byte_characters()
    parts = [_field(1, _field(1, "\U000f0000".encode()) + struct.pack("<Bf", 2 << 3 | 5, 0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        parts.append(_field(1, _field(1, piece) + struct.pack("<Bf", 2 << 3 | 5, -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary; texts are split by ``pattern`` and each match is encoded alone."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(self.tokens))
        self.map = {b: c for b, c in enumerate(byte_characters())}
        self.whole: dict[str, bytes] = {}
        for rank, token in enumerate(self.tokens):  # a match that is a token needs no merging
            try:
                self.whole[token.decode()] = struct.pack("<I", rank)
            except UnicodeDecodeError:
                pass
        self.known = dict(self.whole)

    def _merge(self, pieces: list[str]) -> list[bytes]:
        encoded = self.model.encode([p.encode().decode("latin-1").translate(self.map) for p in pieces], num_threads=1)
        ends = list(itertools.accumulate([4 * len(ids) for ids in encoded]))
        flat = (np.fromiter(itertools.chain.from_iterable(encoded), np.int64, ends[-1] // 4) - 1).astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers. What is new in all of them is merged at once."""
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHED + len(self.whole):
            self.known = dict(self.whole)
        known = self.known
        new = [p for p in set().union(*split) if p not in known] if split else []
        if new:
            known.update(zip(new, self._merge(new), strict=True))
        out = [b"".join([known[p] for p in pieces]) for pieces in split]
        for p in new:
            if len(p) > CACHED_CHARS:
                del known[p]
        return out


def decode_ids(tokens: list[bytes], ids: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids``, the little-endian ids of the whole text; one narrow pass without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(path, pattern).encode
        for batch in slices(batches, 128):
            ids = encoder(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return python_pass(texts_of(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ``ids`` and ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load_ranks(path)  # a worker of its own, which needs no model
        for batch in slices(batches, 256):
            texts = [decode_ids(tokens, x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return python_pass(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to."""
    return decode(encode(docs, path, pattern), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
