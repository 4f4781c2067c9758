"""Byte-level BPE through a sentencepiece model that is serialised here, directly from a rank file.

The rank file (one base64 token and its rank a line) becomes a sentencepiece BPE model: every token is a piece whose bytes are
written as the 256 printable stand-in characters, and whose score is the negative rank, so that sentencepiece merges the pair of
lowest rank first, as the rank file asks for. The normaliser is the identity, and nothing is added or escaped. Texts are split
into pre-tokens by the pattern, each is encoded alone; ids are decoded by the inverse map from pieces to bytes.

Defined results: a null or empty text has no tokens, and decodes to nothing. Texts of any length are encoded whole. Equal rows give
equal results, one for each row. Other columns of the input are not read. Text that holds a special token's string is ordinary.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm import common

#: The memo is emptied before the text that finds more pre-tokens in it than this.
MEMO = 600_000


def byte_letters() -> list[str]:
    """For each byte a character that is printable and no space: Latin-1's own, others from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(key: int, value: bytes | int | float) -> bytes:
    """One protobuf field: an int as varint, a float as fixed32, bytes with their length."""
    if isinstance(value, bytes):
        return _number(key << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(key << 3 | 5) + struct.pack("<f", value)
    return _number(key << 3) + _number(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece 0 is the unknown piece that the format demands; the piece of rank r has id r's place + 1."""
    letters = byte_letters()
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(letters[b] for b in token)
        out.append(_field(1, _field(1, name.encode()) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normaliser)])


class Codec:
    """Encoder and decoder of one rank file; pattern splits a text into pre-tokens that cover it."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.by_piece = [0, *sorted(self.tokens)]
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model_bytes(self.ranks))
        self.letters = dict(enumerate(byte_letters()))
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def learn(self, parts: set[str]) -> None:
        """Puts the ids of new pre-tokens into the memo: those of a whole token, else what the model merges."""
        rest = []
        for part in parts:
            if (whole := self.ranks.get(part.encode())) is None:
                rest.append(part)
            else:
                self.memo[part] = (whole,)
        mapped = [part.encode().decode("latin-1").translate(self.letters) for part in rest]
        for part, found in zip(rest, self.model.encode(mapped, num_threads=1) if mapped else (), strict=True):
            self.memo[part] = tuple(map(self.by_piece.__getitem__, found))

    def encode(self, text: str) -> list[int]:
        parts, memo = self.find(text), self.memo
        if len(memo) > MEMO:
            memo.clear()
        if new := set(parts).difference(memo):
            self.learn(new)
        return list(chain.from_iterable(map(memo.__getitem__, parts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    return Codec(path, pattern)


def codec_settings(tokenizer: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """id_col, n_tokens, ids (array of int, if with_ids), ids_sha256, decoded_sha256 and lossless for each row of docs."""
    path, pattern = codec_settings(tokenizer, pattern)
    df = common.slim(docs, text_col, id_col)
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        own = codec(path, pattern)
        spelled = {i: str(i) for i in own.tokens}

        def step(batch: pa.RecordBatch):
            for part in common.pieces(batch):
                counts, ids_out, ids_sha, out_sha, same = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = own.encode(text)
                    back = own.decode(ids)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(spelled.__getitem__, ids)).encode()).hexdigest())
                    out_sha.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text.encode())
                    if with_ids:
                        ids_out.append(ids)
                columns = [part.column(id_col), pa.array(counts, pa.int64())]
                columns += [pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else []
                columns += [pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names)

        return step

    names = [id_col, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256", "lossless"]
    return common.arrow_map(df, make, f"`{id_col}` {kind}, n_tokens long, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string, lossless boolean")


def decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """id_col and text, from arrays of ids; null ids give an empty text. Ids that the rank file doesn't have raise."""
    path, _ = codec_settings(tokenizer, None)
    kind = tokens.schema[id_col].dataType.simpleString()

    def make():
        by_id = {rank: token for token, rank in read_ranks(path).items()}

        def step(batch: pa.RecordBatch):
            texts = [b"".join(map(by_id.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

        return step

    return common.arrow_map(tokens.select(id_col, ids_col), make, f"`{id_col}` {kind}, text string")
