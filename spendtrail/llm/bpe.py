"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 50_000  # characters; longer texts are encoded in parts of about this length
FLUSH = 8 << 20  # bytes of output in a batch, about

#: A part may end after a non-space before a space or newline: no match of the pattern goes on from a non-space to white
#: space, and none looks ahead from a non-space.
SAFE = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, long: int = LONG):
    """``text`` in pieces that are encoded as they would be within it; a stretch without a safe boundary stays whole."""
    at = 0
    while len(text) - at > long:
        cut = SAFE.search(text, at + long)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(enc: tiktoken.Encoding, text: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join(np.array(enc.encode_ordinary(part), "<u4").tobytes() for part in parts(text))


def decode_ids(enc: tiktoken.Encoding, ids: bytes) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def _mapped(df: DataFrame, key: str, value: str, schema: str, names: list[str], work) -> DataFrame:
    """Rows of (key, outputs of ``work(value)``...), in batches of bounded bytes."""

    def run(batches):
        for batch in batches:
            keys, values = batch.columns
            start, size, made = 0, 0, []
            for i in range(len(values)):
                made.append(work(values[i].as_py()))
                size += sum(map(len, made[-1]))
                if size >= FLUSH or i == len(values) - 1:
                    columns = [pa.array(column, pa.binary()) for column in zip(*made, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(start, i + 1 - start), *columns], names)
                    start, size, made = i + 1, 0, []

    return df.select(F.col(key), F.col(value)).mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids) for every row; with ``decode`` also the bytes that the ids decode to, made in the same pass.

    ids: binary, little-endian unsigned 32-bit integers, as the library encodes the whole text without special tokens.
    Null texts count as empty; empty texts have empty ids. Long texts are encoded in parts cut where no match of ``pattern``
    can cross (for patterns in which white space only begins a match). Repeated rows each keep their row; no rows: no rows;
    other columns are ignored. ``rank_file`` must be at that path on every executor.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def work(text):
        enc = encoding(rank_file, pattern)
        ids = encode_text(enc, text or "")
        return (ids, decode_ids(enc, ids)) if decode else (ids,)

    names = [id_col, "ids", *["decoded"] * decode]
    return _mapped(docs, id_col, text_col, f"`{id_col}` {key}, ids binary" + ", decoded binary" * decode, names, work)


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, decoded) for rows as ``bpe_encode`` returns them: raw bytes, which need not be whole characters. Null ids: empty."""
    key = encoded.schema[id_col].dataType.simpleString()
    return _mapped(encoded, id_col, "ids", f"`{id_col}` {key}, decoded binary", [id_col, "decoded"], lambda ids: (decode_ids(encoding(rank_file, pattern), ids or b""),))
