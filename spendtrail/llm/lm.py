"""Language-model scores from a weighted backoff automaton of smoothed word n-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrail.llm.common import written

END = b""  # the end token: no word is empty
PLACE_BITS = 21  # of a token's place in its chunk, and of a word's or an n-gram's number there
CHUNK = 1 << 20  # tokens of a chunk at most; places reach further
RANGE = 1 << 20  # n-grams, repeats across chunks included, that one group of the counting holds, about
PART = 1024  # tokens of a text that are traversed in one go
SPARE_BITS = 20  # of n-gram hashes beyond what numbers all tokens: one foreign n-gram in a million meets another's count
STRENGTHS = (400.0, 5.0)  # tokens that the shorter context counts for, after one word and after two


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; split on 0x20 and 0x09-0x0D."""
    return (text or b"").lower().split()


class _Words(dict):
    """Words numbered in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned integers, byte planes apart and compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unsqueeze(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of a context's hash and a word's."""
    x = (context ^ (context >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def numbered(keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, number of the key at each of ``size`` places, -1 where there is none)."""
    packed = np.sort(keys << np.uint64(PLACE_BITS) | places.astype(np.uint64))
    at = (packed & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    packed >>= np.uint64(PLACE_BITS)
    fresh = np.ones(len(packed), bool)
    fresh[1:] = packed[1:] != packed[:-1]
    out = np.full(size, -1)
    out[at] = np.cumsum(fresh) - 1
    return packed[fresh], out


@dataclass
class Chunk:
    """Some whole texts or parts of long ones. ``token``: word numbers; a text is token[start : stop], of which ``lead`` are the
    words before the part; ``hashes``: of the words, by number."""

    token: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    lead: np.ndarray
    learn: np.ndarray

    def grams(self):
        """For each order 1 to 3: (hashes of the distinct n-grams, first n - 1 words and last word by number, n-gram number at each place)."""
        n = len(self.token)
        token = self.token.astype(np.uint64)
        begin = np.repeat(self.start, self.stop - self.start)
        since = np.arange(n) - begin
        yield self.hashes, None, np.arange(len(self.hashes)), self.token
        head, hashes = self.token, self.hashes
        for order in (2, 3):
            places = np.flatnonzero(since >= order - 1)
            keys = head[places - 1].astype(np.uint64) << np.uint64(PLACE_BITS) | token[places]
            distinct, number = numbered(keys, places, n)
            first, last = (distinct >> np.uint64(PLACE_BITS)).astype(np.int64), (distinct & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            hashes = mix(hashes[first], self.hashes[last])
            yield hashes, first, last, number
            head = number

    def own(self) -> np.ndarray:
        """Whether a place is the text's own, not one of its lead."""
        out = np.ones(len(self.token), bool)
        for s, k in zip(self.start[self.lead > 0].tolist(), self.lead[self.lead > 0].tolist(), strict=True):
            out[s : s + k] = False
        return out


@dataclass
class Automaton:
    """The part of the whole automaton that a chunk's texts can reach. State 0 is the empty context, then come the words,
    then the bigrams by number. An arc has a log10 weight and a next state; arcs[k] are those by n-grams of k + 1 words.

    Where a state has no arc for a word, its failure arc is taken: it costs ``backoff[state]`` and leads to ``fail[state]``,
    the context without its first word. The root has an arc for every word.
    """

    known: list[np.ndarray]
    weight: list[np.ndarray]
    to: list[np.ndarray]
    backoff: np.ndarray
    fail: np.ndarray
    words: int

    def traverse(self, arcs: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 weight of each token; one traversal from left to right of each stretch, all stretches in step.

        ``arcs[k]``: number of the n-gram of k + 1 words that ends at a place, -1 for none. Every stretch begins in the root.
        """
        out = np.zeros(len(arcs[0]))
        by = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[by], lengths[by]
        live = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")
        state = np.zeros(len(starts), np.int64)
        for t, m in enumerate(live.tolist()):
            at = starts[:m] + t
            s, total, goes = state[:m], np.zeros(m), np.full(m, -1)
            for k, floor in ((2, self.words), (1, 0)):
                here = (goes < 0) & (s > floor)
                arc = arcs[k][at]
                hit = here & self.known[k][arc]
                total += np.where(hit, self.weight[k][arc], np.where(here, self.backoff[s], 0.0))
                goes = np.where(hit, self.to[k][arc], goes)
                s = np.where(here & ~hit, self.fail[s], s)
            arc = arcs[0][at]
            root = goes < 0
            out[at] = total + np.where(root, self.weight[0][arc], 0.0)
            state[:m] = np.where(root, self.to[0][arc], goes)
        return out


def automaton(counts: list[np.ndarray], grams: list[tuple], tail: np.ndarray, base: float, strengths: tuple[float, float]) -> Automaton:
    """From training counts of the chunk's words, bigrams and trigrams (0: not in the model, so no arc and no state).

    Dirichlet smoothing: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m) with h' the context without its first word, and m the
    strength of h's length; the root has (c(w) + 1) / base. So what a failure arc costs is m / (c(h) + m), and the weights
    out of every state sum to one over all words. ``tail``: number of the bigram that ends a trigram.
    """
    c1, c2, c3 = counts
    (_, _, _, _), (_, first2, last2, _), (_, first3, last3, _) = grams
    after_one, after_two = strengths
    p1 = (c1 + 1) / base
    p2 = (c2 + after_one * p1[last2]) / (c1[first2] + after_one)
    p3 = (c3 + after_two * p2[tail]) / (c2[first3] + after_two)
    n = len(c1)
    state1 = np.where(c1 > 0, 1 + np.arange(n), 0)
    state2 = np.where(c2 > 0, 1 + n + np.arange(len(c2)), state1[last2])
    pad = [np.append(c > 0, False) for c in counts]  # place -1: no n-gram
    to = [np.append(x, 0) for x in (state1, state2, state2[tail])]
    backoff = np.log10(np.concatenate(([1.0], after_one / (c1 + after_one), after_two / (c2 + after_two))))
    fail = np.concatenate(([0], np.zeros(n, np.int64), state1[last2]))
    return Automaton(pad, [np.append(np.log10(p), 0.0) for p in (p1, p2, p3)], to, backoff, fail, n)


CHUNK_FIELDS = "chunk long, token binary, hashes binary, row array<long>, doc_id array<long>, start array<int>, stop array<int>, lead array<int>, learn array<boolean>, tokens long"


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """``rows`` (doc_id, text, learn) as chunks of up to ``size`` tokens; texts of more are cut, and a part brings the two words before it."""
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches):
        part = TaskContext.get().partitionId() << 33
        made = row = 0
        known, token, texts = _Words(), [], []

        def flush():
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            columns = list(zip(*texts, strict=True))
            own = sum(stop - start - lead for _, _, start, stop, lead, _ in texts)
            arrays = [pa.array([part + made], pa.int64()), pa.array([squeeze(np.array(token, np.uint64))], pa.binary()), pa.array([squeeze(hashes)], pa.binary())]
            arrays += [pa.array([list(c)], t) for c, t in zip(columns, (longs, longs, ints, ints, ints, pa.list_(pa.bool_())), strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([own], pa.int64())], ["chunk", "token", "hashes", "row", "doc_id", "start", "stop", "lead", "learn", "tokens"])

        for batch in batches:
            for doc, text, learn in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                mine = words(text.as_py())
                mine.append(END)
                for at in range(0, len(mine), size - 2):
                    lead = min(at, 2)
                    piece = mine[at - lead : at + size - 2]
                    if token and len(token) + len(piece) > size:
                        yield flush()
                        made += 1
                        known, token, texts = _Words(), [], []
                    texts.append((part + row, doc, len(token), len(token) + len(piece), lead, bool(learn)))
                    token.extend(map(known.__getitem__, piece))
                row += 1
        if texts:
            yield flush()

    return rows.select("doc_id", "text", "learn").mapInArrow(run, CHUNK_FIELDS)


def _chunk(row: dict) -> Chunk:
    return Chunk(unsqueeze(row["token"]).astype(np.int64), unsqueeze(row["hashes"]), *(np.array(row[x], np.int64) for x in ("start", "stop", "lead")), np.array(row["learn"], bool))


def _transported(hashes: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes as they are counted, in order; the n-grams' numbers in that order). Words keep all 64 bits."""
    cut = hashes if order == 1 else hashes >> np.uint64(64 - bits)
    by = np.argsort(cut)
    return cut[by], by


def _edges(order: int, ranges: int, bits: int) -> np.ndarray:
    """First hash of each range but the first."""
    top = 1 << (64 if order == 1 else bits)
    return np.array([-(-top * r // ranges) for r in range(1, ranges)], np.uint64)


def gram_counts(chunked: DataFrame, ranges: int, bits: int) -> DataFrame:
    """(chunk, n, part, totals, types, tokens): training counts of every n-gram that a chunk holds, by ranges of hashes.

    A chunk names each of its n-grams once, with how often training texts there have it; of each range it sends one block,
    and gets one block back, in the same order. So a range's group grows with neither the corpus nor with a frequent n-gram.
    types and tokens: n-grams of the range with a count and their occurrences, on one row of each range.
    """

    def name(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _chunk(row)
                teaches = chunk.own() & np.repeat(chunk.learn, chunk.stop - chunk.start)
                for order, (hashes, _, _, number) in enumerate(chunk.grams(), 1):
                    seen = np.bincount(number[teaches & (number >= 0)], minlength=len(hashes))
                    sent, by = _transported(hashes, order, bits)
                    cuts = np.concatenate(([0], np.searchsorted(sent, _edges(order, ranges, bits)), [len(sent)]))
                    out = []
                    for part in np.flatnonzero(np.diff(cuts)).tolist():
                        own = slice(cuts[part], cuts[part + 1])
                        out.append((order, part, row["chunk"], squeeze(np.diff(sent[own], prepend=np.uint64(0))), squeeze(seen[by[own]])))
                    if out:
                        yield pa.RecordBatch.from_pylist([dict(zip(("n", "part", "chunk", "grams", "seen"), x, strict=True)) for x in out], schema)

    schema = pa.schema([("n", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("seen", pa.binary())])

    def add(key, table):
        grams = [np.cumsum(unsqueeze(x.as_py()), dtype=np.uint64) for x in table["grams"]]
        seen = np.concatenate([unsqueeze(x.as_py()) for x in table["seen"]]).astype(np.int64)
        flat = np.concatenate(grams)
        by = np.argsort(flat)
        fresh = np.ones(len(flat), bool)
        fresh[1:] = flat[by[1:]] != flat[by[:-1]]
        sums = np.add.reduceat(seen[by], np.flatnonzero(fresh))
        totals = np.empty(len(flat), np.int64)
        totals[by] = sums[np.cumsum(fresh) - 1]
        ends = np.cumsum([len(g) for g in grams])
        rest = [0] * (len(grams) - 1)
        return pa.table(
            {
                "chunk": table["chunk"],
                "n": table["n"],
                "part": table["part"],
                "totals": pa.array([squeeze(x) for x in np.split(totals, ends[:-1])], pa.binary()),
                "types": pa.array([int((sums > 0).sum()), *rest], pa.int64()),
                "tokens": pa.array([int(sums.sum()), *rest], pa.int64()),
            }
        )

    named = chunked.select("chunk", "token", "hashes", "start", "stop", "lead", "learn").mapInArrow(name, "n int, part int, chunk long, grams binary, seen binary")
    return named.groupBy("n", "part").applyInArrow(add, "chunk long, n int, part int, totals binary, types long, tokens long")


def lm_scores(
    docs: DataFrame,
    learn: Column,
    strengths: tuple[float, float] = STRENGTHS,
    chunk_tokens: int = CHUNK,
    range_grams: int = RANGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Scores of every row by a model of the rows where ``learn`` holds: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words and one end of text. base_score: sum of log10((c + 1) / (N + V + 1)) with c the token's count among
    the N training tokens, V distinct; n_known: tokens with c > 0. score: log10 probability by the automaton of all training
    n-grams of one to three tokens, none left out (see ``automaton``). Null and blank texts have the end token alone. Rows
    that repeat an id or a text keep a row each, with the values of their own text. Very long texts are cut into chunks, and
    parts are added up; a part starts in the state that the two words before it lead to, so nothing changes. No rows: no
    rows. Nothing learnt from: every probability is that of N = 0 tokens. Other columns are ignored.

    The model is never in one place. The corpus is dealt into chunks of ``chunk_tokens``; n-gram counts are summed by ranges of
    their hashes, each of about ``range_grams``, and each chunk gets back the counts of its own n-grams. From these it builds
    the states and arcs that its texts can reach, equal to those of the whole automaton, and traverses each text once. What
    is shuffled grows with the tokens; what a task holds does not. Words are told apart by 64 bits of XXH64, longer
    n-grams by ``SPARE_BITS`` more bits than number the tokens.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    chunked = written(chunks(rows, min(chunk_tokens, 1 << PLACE_BITS)))
    total = chunked.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bits = min(64, max(total, 1).bit_length() + SPARE_BITS)
    counted = written(gram_counts(chunked, max(1, math.ceil(total / range_grams)), bits))
    tokens, types = counted.where("n = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    base = tokens + types + 1

    def score(key, left, right):
        row = left.to_pylist()[0]
        chunk = _chunk(row)
        blocks = sorted(zip(right["n"].to_pylist(), right["part"].to_pylist(), right["totals"], strict=True), key=lambda x: x[:2])
        grams, counts = list(chunk.grams()), []
        for order, (hashes, *_) in enumerate(grams, 1):
            totals = np.empty(len(hashes), np.int64)
            got = [unsqueeze(x.as_py()).astype(np.int64) for n, _, x in blocks if n == order]
            totals[_transported(hashes, order, bits)[1]] = np.concatenate(got) if got else 0
            counts.append(totals)
        arcs = [g[3] for g in grams]
        tail = np.zeros(len(counts[2]), np.int64)
        ends = arcs[2] >= 0
        tail[arcs[2][ends]] = arcs[1][ends]
        model = automaton(counts, grams, tail, base, strengths)
        weight = model.traverse(arcs, *_stretches(chunk))
        own = chunk.own()
        c = counts[0][arcs[0]]
        log = np.log10(c + 1) - math.log10(base)
        sums = [np.add.reduceat(np.where(own, x, 0), chunk.start) for x in (np.ones(len(own), np.int64), (c > 0).astype(np.int64), log, weight)]
        return pa.table([pa.array(row["row"], pa.int64()), pa.array(row["doc_id"], pa.int64()), *map(pa.array, sums)], names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = chunked.groupBy("chunk").cogroup(counted.select("chunk", "n", "part", "totals").groupBy("chunk"))
    scored = scored.applyInArrow(score, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    sums = scored.groupBy("row", "doc_id").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _stretches(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of stretches of up to PART tokens, each with the two tokens before it, which lead to its state.

    They come in order, and the first token of a stretch's own is written last, so run-in tokens keep their true weight.
    """
    starts, lengths = [], []
    for s, e in zip(chunk.start.tolist(), chunk.stop.tolist(), strict=True):
        for at in range(s, e, PART):
            begin = max(s, at - 2)
            starts.append(begin)
            lengths.append(min(e, at + PART) - begin)
    return np.array(starts, np.int64), np.array(lengths, np.int64)
