"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 15
DIMS = 1 << BITS
ORDERS = (1, 2, 3)
PART = 1 << 18  # characters handled at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

UNDETERMINED = "und"


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of 1 to 3 characters of the whole lower-cased text, letters only, a space for all else: (index, count).

    A text without letters has none. Runs of non-letters count as one space.
    """
    total = None
    last, carried = " ", 0  # a part's n-grams go on from the last two characters before it
    pieces = [text[at : at + PART] for at in range(0, len(text), PART)]
    for number, piece in enumerate(pieces):
        kept = "".join([c if c.isalpha() else " " for c in piece.lower()]) if not piece.isascii() else piece.lower().translate(_ASCII)
        ends = number == len(pieces) - 1
        joined = _SPACES.sub(" ", last + kept + " " * ends)
        if joined == last or (len(pieces) == 1 and joined == " "):
            continue
        old, last = carried, joined[-2:]
        carried = len(last)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        found = []
        rolled = np.zeros(len(codes), np.uint64)
        for n in ORDERS:
            rolled = rolled[: len(codes) - n + 1] * np.uint64(0x110001) + codes[n - 1 :]
            fresh = rolled[max(0, old - n + 1) :]  # those before ended in an earlier part
            found.append(((fresh * _MIX) ^ _SALTS[n - 1]) * _SALTS[n - 1] >> np.uint64(64 - BITS))
        flat = np.concatenate(found).astype(np.int64)
        if len(pieces) == 1 and len(flat) < 8192:
            return np.unique(flat, return_counts=True)
        counts = np.bincount(flat, minlength=DIMS)
        total = counts if total is None else total + counts
    if total is None or not any(map(str.isalpha, text)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


_SPACES = re.compile(" {2,}")
_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return tfidf(*ngram_counts(text), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        at, x = self.vector(text or "")
        if not len(at) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dampened counts times inverse document frequency, of unit length."""
    x = (1 + np.log(counts)) * idf[at] if len(at) else np.empty(0)
    norm = np.sqrt(x @ x)
    return at, x / norm if norm > 0 else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many of the rows hold each hashed n-gram, and how many rows there are: over all rows, DIMS numbers in all."""

    def run(batches):
        seen, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen[ngram_counts(text.as_py() or "")[0]] += 1
                rows += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], rows), pa.int64())], ["feature", "rows"])

    sums = docs.select(text_col).mapInArrow(run, "feature int, rows long").groupBy("feature").agg(F.sum("rows").alias("rows")).toPandas()
    out = np.zeros(DIMS, np.int64)
    known = sums[sums["feature"] >= 0]
    out[known["feature"].to_numpy()] = known["rows"].to_numpy()
    return out, int(sums.loc[sums["feature"] < 0, "rows"].sum())


def fit_ftrl(vectors: list, labels: np.ndarray, k: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 6, batch: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal) with elastic-net penalties, in small batches: (weights, bias)."""
    z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))

    def leader(at):
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    order = np.arange(len(labels))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        rng.shuffle(order)
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            flat = np.concatenate([vectors[i][0] for i in some] + [np.array([DIMS])])
            used, place = np.unique(flat, return_inverse=True)
            w, grad, at = leader(used), np.zeros((len(used), k)), 0
            for i in some:
                x = vectors[i][1]
                here = place[at : at + len(x)]
                p = softmax(x @ w[here] + w[-1])
                p[labels[i]] -= 1
                grad[here] += np.outer(x, p)
                grad[-1] += p
                at += len(x)
            grew = n[used] + grad**2
            z[used] += grad - (np.sqrt(grew) - np.sqrt(n[used])) / alpha * w
            n[used] = grew
    w = leader(np.arange(DIMS + 1))
    return w[:DIMS], w[DIMS]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows that the weights were not learnt from, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language(docs: DataFrame, learn: Column, sample: int = 4000, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model learnt from rows with a language where ``learn`` holds.

    Document frequencies count all such rows. Weights are learnt from at most ``sample`` of them, those first in the order of
    a hash of their id, of rows that share one the first in the order of a hash of its text; rows without an id count for the
    frequencies alone. A tenth of the sample sets the temperature instead. Languages are those of the rows learnt from.
    Without any, every prediction is ``und``.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull())
    seen, total = document_frequencies(rows, text_col)
    idf = np.log((1 + total) / (1 + seen)) + 1

    def run(batches):
        for batch in batches:
            found = [ngram_counts(x.as_py() or "") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([np.minimum(c, 2**31 - 1).astype("<i4").tobytes() for _, c in found], pa.binary()), batch.column(1), batch.column(2)],
                ["at", "counts", "lang", "held"],
            )

    by = F.xxhash64(F.col("doc_id"), F.lit("language sample"))
    ids = rows.where("doc_id is not null").select("doc_id", by.alias("by")).distinct().orderBy("by", "doc_id").limit(sample)
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(text_col), text_col, lang_col)
    taken = rows.join(F.broadcast(ids), "doc_id").withColumn("nth", F.row_number().over(first)).where("nth = 1").select(text_col, F.col(lang_col).alias("lang"), (F.pmod("by", F.lit(10)) == 0).alias("held"))
    got = taken.mapInArrow(run, "at binary, counts binary, lang string, held boolean").toPandas()
    vectors = [tfidf(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(c, "<i4").astype(float), idf) for a, c in zip(got["at"], got["counts"], strict=True)]
    order = sorted((i for i in range(len(got)) if len(vectors[i][0])), key=lambda i: (got["at"][i], got["counts"][i], got["lang"][i]))
    languages = sorted({got["lang"][i] for i in order})
    if not languages:
        return LanguageModel([], idf, np.zeros((DIMS, 0)), np.zeros(0))
    number = {x: i for i, x in enumerate(languages)}
    own = [i for i in order if not got["held"][i]] or order
    held = [i for i in order if got["held"][i]]
    weights, bias = fit_ftrl([vectors[i] for i in own], np.array([number[got["lang"][i]] for i in own]), len(languages))
    logits = np.array([vectors[i][1] @ weights[vectors[i][0]] + bias for i in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, idf, weights, bias, fit_temperature(logits, np.array([number[got["lang"][i]] for i in held], np.int64)))


def language_scores(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the likeliest language of the whole text and its calibrated probability.

    Null texts and texts without a letter are ``und`` with score 0. Equal probabilities: the first language in order.
    Repeated rows each keep their row. No rows: no rows; other columns are ignored. The text is all that counts.
    """

    def run(batches):
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
