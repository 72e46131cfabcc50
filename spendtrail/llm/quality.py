"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges of the bins of each line feature.
SHARE = (0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6)
FEATURES = {
    "lower": (0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9),
    "upper": SHARE,
    "digit": SHARE,
    "space": (0.05, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3),
    "stop": (0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1),
    "symbol": SHARE,
    "markup": SHARE,
    "other": (0.001, 0.03, 0.06, 0.1, 0.15, 0.25, 0.5),
    "characters": (1, 10, 30, 80, 150, 300, 600, 1200),
    "word_length": (2, 3, 4, 4.5, 5, 5.5, 6, 7, 9, 14),
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.99),
    "short_words": (0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "seen": (0.5,),
}
SIZES = np.array([len(edges) + 1 for edges in FEATURES.values()])
OFFSETS = np.concatenate(([0], np.cumsum(SIZES)))[:-1]
CODES = int(SIZES.sum())
NEIGHBOURS = 3  # the line itself, the one before, the one after; a missing neighbour has a code of its own

_CLASS = np.full(256, 7, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:!?'\"", b"#$%&*+=@^~_`\\", b"|<>{}[]()/-")):
    _CLASS[list(_chars)] = _i


def line_codes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features) bin numbers and the lines' lengths in bytes, for every line that isn't blank."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    if not lines:
        return np.empty((0, len(SIZES)), np.uint8), np.empty(0, np.int64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    counts = np.empty((len(lines), 8))
    at = 0
    while at < len(lines):  # some lines at a time: the memory is that of the longest line or of 64 KB
        to = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), 65536, "right")) + at)
        kinds = _CLASS[np.frombuffer(b"".join(lines[at:to]), np.uint8)]
        owner = np.repeat(np.arange(to - at) * 8, lengths[at:to])
        counts[at:to] = np.bincount(owner + kinds, minlength=8 * (to - at)).reshape(-1, 8)
        at = to
    values = np.empty((len(lines), len(SIZES)))
    values[:, :8] = counts / lengths[:, None]
    values[:, 8] = lengths
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        values[i, 9] = sum(map(len, words)) / n
        values[i, 10] = len(set(words)) / n
        values[i, 11] = sum(len(w) < 4 for w in words) / n
        values[i, 12] = line in seen
        seen.add(line)
    codes = np.empty(values.shape, np.uint8)
    for j, edges in enumerate(FEATURES.values()):
        codes[:, j] = np.searchsorted(edges, values[:, j], "right")
    return codes, lengths


@dataclass
class LineField:
    """Binary chain: emission weights of the label good over bad for each code of a line and its neighbours, and transitions."""

    emit: np.ndarray  # NEIGHBOURS x (CODES + 1)
    trans: np.ndarray  # 2 x 2, from label to label
    start: np.ndarray  # 2
    scale: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def potentials(self, codes: np.ndarray) -> np.ndarray:
        """Score of good over bad for each line."""
        flat = codes.astype(np.int64) + OFFSETS
        own = self.emit[0, flat].sum(axis=1)
        own[1:] += self.emit[1, flat[:-1]].sum(axis=1)
        own[0] += self.emit[1, CODES]
        own[:-1] += self.emit[2, flat[1:]].sum(axis=1)
        own[-1] += self.emit[2, CODES]
        return own

    def marginals(self, codes: np.ndarray) -> np.ndarray:
        """P(good) of each line, by forward-backward."""
        return chain(self.potentials(codes), self.trans, self.start)[0]

    def score(self, text: bytes) -> float:
        """Length-weighted mean of the marginals, calibrated; the share of good documents for texts without lines."""
        codes, lengths = line_codes(text)
        if not len(codes):
            return self.prior
        return float(_sigmoid(self.scale * _logit(weighted(self.marginals(codes), lengths)) + self.shift))


def weighted(good: np.ndarray, lengths: np.ndarray) -> float:
    return float(good @ lengths / lengths.sum())


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def chain(own: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transitions (2 x 2). Normalised forward and backward messages."""
    n = len(own)
    local = np.empty((n, 2))
    local[:, 1] = _sigmoid(own)
    local[:, 0] = 1 - local[:, 1]
    local = np.maximum(local, 1e-300)
    step, first = np.exp(trans - trans.max()), np.exp(start - start.max())
    (a, b), (c, d) = step.tolist()
    ahead, rows = [], local.tolist()
    p, q = first[0] * rows[0][0], first[1] * rows[0][1]
    ahead.append((p / (p + q), q / (p + q)))
    for x, y in rows[1:]:
        p, q = ahead[-1]
        p, q = (p * a + q * c) * x, (p * b + q * d) * y
        ahead.append((p / (p + q), q / (p + q)))
    back = [(0.5, 0.5)]
    for x, y in reversed(rows[1:]):
        p, q = back[-1]
        p, q = p * x, q * y
        p, q = a * p + b * q, c * p + d * q
        back.append((p / (p + q), q / (p + q)))
    f, g = np.array(ahead), np.array(back[::-1])
    both = f * g
    good = both[:, 1] / both.sum(axis=1)
    if n == 1:
        return good, np.zeros((2, 2))
    pairs = f[:-1, :, None] * step[None] * (local[1:] * g[1:])[:, None, :]
    return good, (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> LineField:
    """Maximum likelihood with a ridge, every line labelled as its document; then a logistic calibration of the score.

    Documents weigh alike however many lines they have, and both labels weigh alike while the field is fitted; calibration
    undoes that balance.
    """
    examples = [x for x in examples if len(x[0])]
    labels = np.array([y for _, _, y in examples], float)
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    field = LineField(np.zeros((NEIGHBOURS, CODES + 1)), np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2), prior=prior)
    if not examples or labels.min() == labels.max():
        field.shift, field.scale = float(_logit(prior)), 0.0
        return field
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    rows = [_index(codes) for codes, _, _ in examples]
    flat = np.concatenate(rows)
    ends = np.cumsum([len(r) for r in rows])
    share = np.concatenate([np.full(len(r), w / len(r)) for r, w in zip(rows, balance, strict=True)]) / len(rows)
    target = np.concatenate([np.full(len(r), y) for r, y in zip(rows, labels, strict=True)])
    theta = [field.emit.reshape(-1), field.trans, field.start]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    for r in range(rounds):
        own = theta[0][flat].sum(axis=1)
        good = np.empty(len(flat))
        d_trans, d_start = np.zeros((2, 2)), np.zeros(2)
        at = 0
        for end, y, w in zip(ends.tolist(), labels.astype(int).tolist(), (balance / len(rows)).tolist(), strict=True):
            good[at:end], moves = chain(own[at:end], theta[1], theta[2])
            n = end - at
            d_trans -= w * moves / n
            d_trans[y, y] += w * (n - 1) / n
            d_start += w * (np.eye(2)[y] - np.array([1 - good[at], good[at]]))
            at = end
        d_emit = np.bincount(flat.reshape(-1), np.repeat((target - good) * share, flat.shape[1]), minlength=len(theta[0]))
        d_emit[CODES] = 0  # the spare weight
        for t, g, (m, v) in zip(theta, (d_emit, d_trans, d_start), moments, strict=True):
            g = g - ridge * t
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            t += rate * (m / (1 - 0.9 ** (r + 1))) / (np.sqrt(v / (1 - 0.99 ** (r + 1))) + 1e-6)
    field.emit = theta[0].reshape(NEIGHBOURS, CODES + 1)
    raw = _logit(np.array([weighted(field.marginals(codes), lengths) for codes, lengths, _ in examples]))
    field.scale, field.shift = _platt(raw, labels)
    return field


def _index(codes: np.ndarray) -> np.ndarray:
    """Places of a document's codes in the flat emission weights."""
    own = codes.astype(np.int64) + OFFSETS
    edge = np.full((1, own.shape[1]), CODES)
    edge[:, 1:] = -1  # a missing neighbour counts once; place -1 is a spare weight that is never read elsewhere
    before, after = np.concatenate((edge, own[:-1])), np.concatenate((own[1:], edge))
    out = np.concatenate((own, np.where(before < 0, CODES, before + CODES + 1), np.where(after < 0, CODES, after + 2 * (CODES + 1))), axis=1)
    return out


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, slightly drawn to slope 1."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((t - p) * x).sum() - (a - 1), (t - p).sum()])
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return a, b


def _examples(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int, text_col: str) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Line codes of a bounded sample of labelled documents, the same rows whatever the partitions."""

    def run(batches):
        for batch in batches:
            found = [line_codes(x.as_py() or b"") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary()), batch.column(1)], ["codes", "lengths", "quality"])

    chosen = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    ids = docs.select("doc_id").distinct().join(chosen, "doc_id").orderBy(F.xxhash64(F.col("doc_id"), F.lit("quality sample")), "doc_id").limit(sample)
    mark = F.xxhash64(text_col).alias("mark")
    sizes = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "quality", mark, F.octet_length(text_col).alias("size"))
    first = sizes.groupBy("doc_id", "quality").agg(F.min(F.struct("mark", "size")).alias("first")).select("doc_id", "quality", "first.*")
    before = Window.orderBy(F.xxhash64(F.col("doc_id"), F.lit("quality sample")), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))  # a few numbers for each of the sample; no text
    first = first.where((F.col("before") < sample_bytes) | (F.col("before") == 0)).select("doc_id", "mark", "quality")
    taken = docs.withColumn("mark", mark).join(F.broadcast(first), ["doc_id", "mark"])
    taken = taken.groupBy("doc_id").agg(F.min(text_col).cast("binary").alias("text"), F.first("quality").alias("quality")).select("text", "quality")
    rows = taken.mapInArrow(run, "codes binary, lengths binary, quality int").toPandas()
    rows = rows.sort_values(["codes", "lengths", "quality"])
    return [(np.frombuffer(c, np.uint8).reshape(-1, len(SIZES)), np.frombuffer(n, np.int64), int(y)) for c, n, y in zip(rows["codes"], rows["lengths"], rows["quality"], strict=True)]


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = 4000, sample_bytes: int = 64 << 20, text_col: str = "text") -> LineField:
    """A field learnt from labelled rows (doc_id, quality 0 or 1; others are left out) where ``learn`` holds.

    At most ``sample`` documents are learnt from, those first in the order of a hash of their id, until they have
    ``sample_bytes`` of text; of rows that share an id one, the first in the order of a hash of its text. Ids labelled both
    ways are left out. Without labelled rows every score is 0.5.
    """
    labels = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    return train(_examples(docs.where(learn).select("doc_id", text_col), labels, sample, sample_bytes, text_col))


def quality_scores(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: the field's score of the whole text, 0 to 1, higher for good.

    Null texts, and texts of blank lines alone, get the share of good documents among those learnt from. Repeated rows each
    keep their row. No rows: no rows; other columns are ignored. The text is all that a score depends on.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([field.score(x.as_py() or b"") for x in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
