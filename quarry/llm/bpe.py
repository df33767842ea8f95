"""Byte-level BPE through a sentencepiece model serialised from a rank table.

Every byte is mapped to one character, so that a vocabulary entry becomes a piece
whose score is its negative rank; the normaliser is the identity. Texts are cut
into pre-tokens by the tokenizer's pattern, each distinct pre-token is encoded
once per worker, and ids are decoded by the inverse mapping.

Defined cases: a null or empty text has no tokens and decodes to nothing; a
pre-token that is itself in the vocabulary is that one token; repeated rows and
extra columns are kept out of each other's way (one output row per input row, only
the id and text columns are read).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import clashless

#: The first of 256 consecutive characters that stand for the bytes 0 to 255.
_FIRST = 0x4E00
#: Distinct pre-tokens a worker remembers; beyond that it forgets those not in use, with the same results.
REMEMBERED = 200_000
#: Documents whose new pre-tokens are encoded in one call.
TOGETHER = 500


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank pairs."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, n: int) -> bytes:
    return _varint(number << 3) + _varint(n)


_MAP = {b: _FIRST + b for b in range(256)}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAP)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: id 0 is the unknown piece, id r + 1 the token of the r-th rank."""
    pieces = [_field(1, "<unk>".encode()) + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)]
    for token in sorted(ranks, key=ranks.get):
        pieces.append(_field(1, mapped(token).encode()) + b"\x15" + struct.pack("<f", -float(ranks[token])) + _number(3, 1))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(35, 0) + _number(24, 0)
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes whole texts; built once per worker from the two broadcast values."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.cut = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks = ranks
        order = sorted(ranks, key=ranks.get)
        self.rank_of_piece = [-1, *(ranks[t] for t in order)]
        self.bytes_of_rank = {ranks[t]: t for t in order}
        self.ids: dict[str, tuple[int, ...]] = {}
        self.written: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        rest = []
        for t in new:
            if (r := self.ranks.get(t.encode())) is None:
                rest.append(t)
            else:
                self._note(t, [r])
        if rest:
            for t, pieces in zip(rest, self.model.encode([mapped(t.encode()) for t in rest], out_type=int, num_threads=1)):
                self._note(t, [self.rank_of_piece[p] for p in pieces])

    def _note(self, token: str, ids: list[int]) -> None:
        self.written[token] = b",".join([b"%d" % i for i in ids])
        self.decoded[token] = self.decode(ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of_rank[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """The decimal ids joined by commas, and the bytes that these ids decode to."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """encode() of each text; what is new in any of them is encoded in one call."""
        cut = [self.cut(t) for t in texts]
        used = set().union(*cut)
        if len(self.written) > REMEMBERED:  # what these texts don't use is forgotten
            self.written = {t: self.written[t] for t in used if t in self.written}
            self.decoded = {t: self.decoded[t] for t in self.written}
        self._learn([t for t in used if t not in self.written])
        written, decoded = self.written.__getitem__, self.decoded.__getitem__
        return [(b",".join(map(written, tokens)), b"".join(map(decoded, tokens))) for tokens in cut]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and token_ids if asked for.

    The vocabulary file is read on the driver; its size is that of the file, whatever the input.
    """
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((serialise(ranks), ranks, pattern))
    kind = dict(docs.dtypes)[id_column]
    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = Codec(*shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(k, TOGETHER)
                found = codec.encode_many([t or "" for t in batch.column(text_column).to_pylist()])
                counts = np.array([w.count(b",") + 1 if w else 0 for w, _ in found], np.int64)
                columns = [batch.column(id_column), pa.array(counts), *(pa.array([hashlib.sha256(x[i]).hexdigest() for x in found], pa.string()) for i in (0, 1))]
                if with_ids:
                    flat = np.fromstring(b",".join([w for w, _ in found if w]).decode(), np.int32, sep=",") if counts.any() else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return clashless(docs, id_column, text_column).mapInArrow(encode, schema)


def decode_ids(rows: DataFrame, path: str, ids_column: str = "token_ids", out: str = "data") -> DataFrame:
    """The bytes that each row's array of ids stands for (null: null)."""
    names = {r: t for t, r in read_ranks(path).items()}
    shared = rows.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("binary")
    def decode(ids):
        return ids.map(lambda x: None if x is None else b"".join([shared.value[int(i)] for i in x]))

    return rows.withColumn(out, decode(F.col(ids_column)))
