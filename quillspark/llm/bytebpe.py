"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

A rank file gives byte strings and ranks. Each byte is mapped to one printable character, each byte string to the
piece of its mapped characters, scored by its negative rank; normalisation is the identity. sentencepiece merges the
adjacent pair with the best score, leftmost first, which is the rank order. Pre-tokens are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct pre-tokens whose encoding a worker keeps, in each of two generations.
KEPT_PIECES = 250_000
# A pattern of public byte-level vocabularies, the same in the standard library's syntax, and the
# characters that the latter may class differently.
QUICK_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
QUICK = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
UNUSUAL = "[\x00-\x08\x0e-\x1f\x7f-\xa0\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]"


def byte_characters() -> list[str]:
    """One character for each byte: printable Latin-1 bytes stand for themselves, others for U+0100 and up, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: int | float | bytes | str) -> bytes:
    """One protocol buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; gaps become unused pieces, the unknown piece is last."""
    chars = byte_characters()
    by_rank = {r: "".join(chars[b] for b in token) for token, r in ranks.items()}
    top = max(by_rank, default=-1) + 1
    out = bytearray()
    for r in range(top):
        piece = by_rank.get(r)
        # Piece types 1 normal, 2 unknown, 5 unused; model type 2 BPE.
        out += field(1, field(1, piece if piece is not None else f"<unused{r}>") + field(2, float(-r)) + field(3, 1 if piece is not None else 5))
    out += field(1, field(1, "<unk>") + field(2, 0.0) + field(3, 2))
    minus_one = (1 << 64) - 1
    trainer = field(3, 2) + field(4, top + 1) + field(40, top) + b"".join(field(n, minus_one) for n in (41, 42, 43))
    normalizer = field(1, "identity") + field(2, b"") + field(3, 0) + field(4, 0) + field(5, 0)
    return bytes(out + field(2, trainer) + field(3, normalizer))


class ByteBpe:
    """Encoder and decoder; ``encode`` gives ids, ``decode`` bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.whole = regex.compile(pattern).findall
        self.quick = None
        if pattern == QUICK_FOR:
            self.quick, self.unusual = re.compile(QUICK).findall, re.compile(UNUSUAL).search
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.chars = byte_characters()
        table = {c: b for b, c in enumerate(self.chars)}
        # The inverse mapping: the bytes of each of the model's own pieces. Pieces of other characters (unused, unknown) have none.
        pieces = map(self.model.id_to_piece, range(self.model.vocab_size()))
        self.bytes_of = pa.array([bytes(map(table.__getitem__, p)) if all(map(table.__contains__, p)) else b"" for p in pieces], pa.binary())
        self.kept: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens. The standard library's faster matcher serves texts without characters it classes differently."""
        return self.quick(text) if self.quick and not self.unusual(text) else self.whole(text)

    def mapped(self, pretoken: str) -> str:
        return pretoken.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.chars)  # a list works as a table

    def ids(self, pretokens: list[str]) -> list[list[int]]:
        return self.model.encode([self.mapped(x) for x in pretokens], num_threads=1)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.ids(self.split(text)) for i in part]

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """Inverse of the byte mapping, over the pieces of the model itself: each id's bytes, gathered into one buffer."""
        found = self.bytes_of.take(pa.array(ids, pa.int32()))
        at = np.frombuffer(found.buffers()[1], np.int32)
        return memoryview(found.buffers()[2])[at[found.offset] : at[found.offset + len(found)]].tobytes() if len(found) else b""

    def learn(self, pretokens: list[str]) -> None:
        """Encode distinct pre-tokens, once each; of the kept ones the less recent half goes when full."""
        if len(self.kept) > KEPT_PIECES:
            self.older, self.kept = self.kept, {}
        for p, ids in zip(pretokens, self.ids(pretokens), strict=True):
            self.kept[p] = (np.array(ids, np.int32).tobytes(), " ".join(map(str, ids)))

    def coded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """For each text: its ids, and these in decimal, joined by spaces."""
        parts = [self.split(t) for t in texts]
        needed = set().union(*parts)
        held, new = self.kept, []
        for p in needed:
            if p not in held:
                if (found := self.older.get(p)) is not None:
                    held[p] = found
                else:
                    new.append(p)
        if new:
            self.learn(new)
            if self.kept is not held:  # a new generation began: these texts' entries go into it
                self.kept.update({p: held[p] for p in needed if p in held})
        get = self.kept.__getitem__
        for own in parts:
            found = [*map(get, own)]
            yield np.frombuffer(b"".join([f[0] for f in found]), np.int32), " ".join([f[1] for f in found])


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _listed(lists: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` with ``bpe_ids`` (array of int, if asked for), ``bpe_count``, ``bpe_ids_sha256`` and ``bpe_decoded_sha256``.

    Null texts are empty: no ids and digests of the empty string. Any text length works; a text is encoded whole,
    one pre-token at a time, and all its ids are then decoded by the inverse mapping for the second digest. Columns of
    those four names are replaced; others pass through. A map over rows: no shuffle, nothing gathered.
    """
    docs = docs.drop("bpe_ids", "bpe_count", "bpe_ids_sha256", "bpe_decoded_sha256")
    fields = [T.StructField("bpe_count", T.LongType()), T.StructField("bpe_ids_sha256", T.StringType()), T.StructField("bpe_decoded_sha256", T.StringType())]
    fields += [T.StructField("bpe_ids", T.ArrayType(T.IntegerType()))] * ids
    names = [*docs.columns, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                counts, digests, decoded, lists = [], [], [], []
                for found, line in bpe.coded(pc.fill_null(batch.column(text), "").to_pylist()):
                    counts.append(len(found))
                    digests.append(hashlib.sha256(line.encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(found)).hexdigest())
                    if ids:
                        lists.append(found)
                cols = [pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)] + [_listed(lists)] * ids
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``."""
    out = encode_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), path, pattern, ids=False)
    return out.select("doc_id", F.col("bpe_count").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"), F.col("bpe_decoded_sha256").alias("decoded_sha256"))
