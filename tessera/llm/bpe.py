"""Byte-level BPE encoding and decoding with a sentencepiece model made from ranks.

A file of byte-level BPE ranks is written out as a sentencepiece model: every byte
is mapped to one printable character, a token becomes the piece of its mapped
bytes, its score is its negative rank, and the normaliser changes nothing. The
pieces keep their ranks as ids; the unknown piece follows the last. Matches of the
splitting pattern are encoded one by one and decoded by the inverse mapping.

Defined results: null and empty texts have no tokens; the digest columns are then
those of the empty string. Repeated rows give repeated results; other columns are
not looked at. Texts of any length are split and encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table, slices_of, spread_rows, text_or_empty

CACHE_ENTRIES = 100_000
SLICE_CHARS = 1 << 19


def byte_characters() -> list[str]:
    """One printable character per byte: itself if printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [tokens[r] for r in range(len(tokens))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float | bool) -> bytes:
    """One protocol-buffer field: bytes, float or (signed) integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value) & (1 << 64) - 1)


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model of a rank-ordered byte vocabulary."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    trainer += _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Codec:
    """Encodes and decodes texts; made for each task, so that an idle worker holds no vocabulary."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.table = dict(enumerate(byte_characters()))
        back = {c: b for b, c in self.table.items()}
        size = self.processor.get_piece_size() - 1
        self.pieces = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(size)]
        self.cache: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; parts not met before are encoded in one call."""
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache = self.cache
        new = list(set(chain.from_iterable(split)).difference(cache))
        table = self.table
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(table) for p in new]
        cache.update(zip(new, self.processor.encode(mapped, num_threads=1)))
        return [list(chain.from_iterable(map(cache.__getitem__, parts))) for parts in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encoded(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """Struct of ``ids`` and ``decoded`` bytes of each text."""
    model = spark.sparkContext.broadcast(model_bytes(read_ranks(ranks_path)))

    @F.pandas_udf("struct<ids: array<int>, decoded: binary>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(model.value, pattern)
        for texts in batches:
            ids = [i for a, b in slices_of(texts.str.len(), SLICE_CHARS) for i in codec.encode(texts[a:b])]
            yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(i) for i in ids]})

    return run(text)


def encoded_digests(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text."""
    model = spark.sparkContext.broadcast(model_bytes(read_ranks(ranks_path)))

    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    @F.pandas_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(model.value, pattern)
        numbers = list(map(str, range(len(codec.pieces))))
        for texts in batches:
            rows = []
            for a, b in slices_of(texts.str.len(), SLICE_CHARS):
                for ids in codec.encode(texts[a:b]):
                    listed = " ".join(map(numbers.__getitem__, ids))
                    rows.append((len(ids), digest(listed.encode()), digest(codec.decode(ids))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def with_digests(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns with the digest columns of each row's tokens."""
    spark = docs.sparkSession
    held = spread_rows(docs.select(*keep, text_or_empty(text_col).alias("whole_text")))
    coded = encoded_digests(spark, F.col("whole_text"), ranks_path, pattern)
    return held.select(*keep, coded.alias("coded")).select(*keep, "coded.*")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return with_digests(docs, ranks, public_tokenizers.PATTERN, "text", "doc_id")
