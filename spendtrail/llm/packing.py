"""Packing of tokenised documents into sequences by vector best-fit."""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendtrail.llm.common import written

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as little-endian 32-bit integers")

WORDS_KEPT = 200_000  # encoded words that a task remembers
LONG_WORD = 64  # characters; longer ones aren't remembered
PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. attention: sum of squared lengths.

    Every sequence keeps all three limits. Documents and attention default to what tokens allow anyway, as packing into as few
    sequences as possible asks; they bind where a caller lowers them, and their weights then count in the choice.
    """

    tokens: int = 4096
    documents: int | None = None
    attention: float | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "residual"  # or "dot"

    def limits(self) -> np.ndarray:
        limits = np.array([self.tokens, self.documents or self.tokens, self.attention or float(self.tokens) ** 2], float)
        if self.rule not in ("residual", "dot") or limits[1] < 1 or limits[2] < self.tokens**2:
            raise ValueError("a whole piece must fit an empty sequence, and the rule be residual or dot")
        return limits


#: Words whose pieces the model gives directly: one run of letters that normalisation keeps, and ASCII marks but the apostrophe.
PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
#: Byte-level models name bytes by characters: printable ones of Latin-1 by themselves, others from U+0100 on, in order.
_UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255) or b == 173]
BYTE_NAMES = {b: 256 + i for i, b in enumerate(_UNSEEN)}


class Words(dict):
    """Ids of the texts between spaces and newlines, as bytes. No token of the tokenizer reaches over white space."""

    def __init__(self, file: str):
        whole = _tokenizer(file)
        self.encode, self.tokenize = whole.encode, whole.model.tokenize
        self.marks, self.old = {"": b""}, {}

    def ids(self, text: str) -> bytes:
        if "<|" not in text:  # special tokens are looked for before letters are lowered, so only other texts are lowered here
            text = text.encode().lower().decode()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONG_WORD:
            return self.whole(word)
        if len(self) >= WORDS_KEPT // 2:  # the other half is what was known before, of which what is met again stays
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            found = self.learnt(word)
        self[word] = found
        return found

    def learnt(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            return array("I", [token.id for token in self.tokenize(word)]).tobytes()
        plain = PLAIN.fullmatch(word)
        if not plain:
            return self.whole(word)
        letters, mark = plain.groups()
        if mark:
            if mark not in self.marks:
                if len(self.marks) > WORDS_KEPT:
                    self.marks = {"": b""}
                self.marks[mark] = self.whole(mark)
            return self[letters] + self.marks[mark]
        return array("I", [token.id for token in self.tokenize(word.encode().decode("latin-1").translate(BYTE_NAMES))]).tobytes()

    def whole(self, word: str) -> bytes:
        return array("I", self.encode(word, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def _tokenizer(file: str) -> Tokenizer:
    return Tokenizer.from_file(file)


def tokenised_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32. Null texts are empty: one piece, the end id."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = Words(tokenizer_file)  # goes with the task, as workers outlive it
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(words.ids(text.as_py() or "") + end)
                step = 4 * capacity
                rows += [(doc, i, i * capacity, len(ids[at : at + step]) // 4, zlib.crc32(ids[at : at + step])) for i, at in enumerate(range(0, len(ids), step))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE_FIELDS)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; longest first, each into the feasible open bin of the best score, else a new one.

    residual: least weighted squared residual capacity after the piece; dot: largest weighted product of the piece's demand
    and the bin's residual capacity; both in shares of a whole bin, ties to the older bin. No bin breaks any limit.
    """
    limits, weights = capacity.limits(), np.array(capacity.weights)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    least = lengths.min() if len(lengths) else 0
    free, names, made = np.empty((3, 1024)), np.empty(1024, np.int64), 0  # columns: open bins
    count = 0
    for i in order.tolist():
        demand = np.array([lengths[i], 1.0, float(lengths[i]) ** 2]) / limits
        left = free[:, :made] - demand[:, None]
        fits = (left > -1e-12).all(axis=0)
        at = -1
        if fits.any():
            score = weights @ left**2 if capacity.rule == "residual" else -(weights * demand) @ free[:, :made]
            at = int(np.argmin(np.where(fits, score, np.inf)))
        if at < 0:
            if made == free.shape[1]:
                keep = free[0, :made] * limits[0] > least - 0.5  # full bins no longer count
                kept = int(keep.sum())
                free[:, :kept], names[:kept] = free[:, :made][:, keep], names[:made][keep]
                made = kept
                if made > free.shape[1] // 2:
                    free, names = np.concatenate((free, np.empty_like(free)), axis=1), np.concatenate((names, np.empty_like(names)))
            at, made = made, made + 1
            free[:, at], names[at], count = 1.0, count, count + 1
        bins[i], offsets[i] = names[at], round((1 - free[0, at]) * limits[0])
        free[:, at] -= demand
    return bins, offsets


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_pieces: int = 8192) -> DataFrame:
    """``pieces`` (doc_id, piece, length and others) with sequence_id and offset.

    Pieces are dealt by hash into groups of about ``group_pieces``, packed side by side; a group leaves one unfilled
    sequence or few. So work a task is bounded whatever one source or document holds, and no piece is lost or cut.
    """
    capacity.limits()
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ignore_index=True)
        bins, offsets = best_fit(group["length"].to_numpy(), capacity)
        group["sequence_id"] = (group.pop("part").to_numpy().astype(np.int64) << 32) + bins
        group["offset"] = offsets
        return group

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.repartitionByRange("part").groupBy("part").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_file: str, capacity: Capacity = Capacity(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents of more tokens than a sequence are cut into full pieces and a rest. Null and empty texts are the end id
    alone. Repeated rows are packed each, equal lengths in the order of id and piece. No rows: no rows; other columns are ignored. Pieces are written once, so the
    texts are tokenised once.
    """
    return pack(written(tokenised_pieces(docs, tokenizer_file, capacity.tokens, end_id, id_col, text_col)), capacity)
