"""The quality and language queries as a whole, fit included, against plain versions without arrays of documents."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendtrail.llm import langid, quality
from spendtrail.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tables(spark):
    documents = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels.setdefault(r.doc_id, set()).add(r.quality)
    return documents, {k: v.pop() for k, v in labels.items() if len(v) == 1 and v <= {0, 1}}


def remainder(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def logit(p):
    p = max(1e-9, min(1 - 1e-9, p))
    return math.log(p / (1 - p))


# quality


def coded(text):
    """A tuple of bins for each line with something in it, and the lines' lengths."""
    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:!?'\"", b"#$%&*+=@^~_`\\", b"|<>{}[]()/-"]
    out, seen = [], set()
    for line in (text or "").encode().split(b"\n"):
        if not line.strip():
            continue
        shares = [sum(c in k for c in line) / len(line) for k in kinds]
        shares.append(sum(not any(c in k for k in kinds) for c in line) / len(line))
        words = line.split()
        values = [*shares, len(line), sum(map(len, words)) / len(words), len(set(words)) / len(words), sum(len(w) < 4 for w in words) / len(words), float(line in seen)]
        seen.add(line)
        bins = tuple(sum(edge <= v for edge in edges) for v, edges in zip(values, quality.FEATURES.values(), strict=True))
        out.append((bins, len(line)))
    return out


def active(lines, i):
    """Names of the weights that speak for the line: its own bins and those of the lines around it."""
    names = [(0, f, b) for f, b in enumerate(lines[i][0])]
    names += [(1, f, b) for f, b in enumerate(lines[i - 1][0])] if i else [(1, "none")]
    return names + ([(2, f, b) for f, b in enumerate(lines[i + 1][0])] if i + 1 < len(lines) else [(2, "none")])


def beliefs(own, trans, start):
    """P(good) of each line and the expected number of each pair of labels, in logarithms."""
    add = lambda *xs: (top := max(xs)) + math.log(sum(math.exp(x - top) for x in xs))
    local = [(math.log(max(1 - sigmoid(x), 1e-300)), math.log(max(sigmoid(x), 1e-300))) for x in own]
    ahead = [[start[y] + local[0][y] for y in (0, 1)]]
    for x in local[1:]:
        ahead.append([add(*(ahead[-1][z] + trans[z][y] for z in (0, 1))) + x[y] for y in (0, 1)])
    back = [[0.0, 0.0]]
    for x in reversed(local[1:]):
        back.insert(0, [add(*(trans[y][z] + x[z] + back[0][z] for z in (0, 1))) for y in (0, 1)])
    whole = add(*ahead[-1])
    good = [math.exp(f[1] + b[1] - whole) for f, b in zip(ahead, back, strict=True)]
    pairs = [[sum(math.exp(ahead[i][y] + trans[y][z] + local[i + 1][z] + back[i + 1][z] - whole) for i in range(len(own) - 1)) for z in (0, 1)] for y in (0, 1)]
    return good, pairs


class PlainField:
    def __init__(self, examples, rounds=60, rate=0.15, ridge=1e-3):
        examples = [(lines, y) for lines, y in examples if lines]
        n, wins = len(examples), sum(y for _, y in examples)
        self.prior = (wins + 1) / (n + 2)
        weigh = {1: 0.5 / (wins / n), 0: 0.5 / (1 - wins / n)}
        self.emit, self.trans, self.start = {}, [[0.5, -0.5], [-0.5, 0.5]], [0.0, 0.0]
        names = sorted({a for lines, _ in examples for i in range(len(lines)) for a in active(lines, i)}, key=repr)
        theta = [dict.fromkeys(names, 0.0), {(y, z): self.trans[y][z] for y in (0, 1) for z in (0, 1)}, {y: 0.0 for y in (0, 1)}]
        moments = [[dict.fromkeys(t, 0.0) for t in theta] for _ in (0, 1)]
        for r in range(rounds):
            grads = [dict.fromkeys(t, 0.0) for t in theta]
            trans, start = [[theta[1][y, z] for z in (0, 1)] for y in (0, 1)], [theta[2][y] for y in (0, 1)]
            for lines, y in examples:
                w = weigh[y] / n
                good, pairs = beliefs([sum(theta[0][a] for a in active(lines, i)) for i in range(len(lines))], trans, start)
                for i in range(len(lines)):
                    for a in active(lines, i):
                        grads[0][a] += w * (y - good[i]) / len(lines)
                for p in (0, 1):
                    for q in (0, 1):
                        grads[1][p, q] -= w * pairs[p][q] / len(lines)
                grads[1][y, y] += w * (len(lines) - 1) / len(lines)
                for p in (0, 1):
                    grads[2][p] += w * ((p == y) - (good[0] if p else 1 - good[0]))
            for k, t in enumerate(theta):
                for name in t:
                    g = grads[k][name] - ridge * t[name]
                    moments[0][k][name] += 0.1 * (g - moments[0][k][name])
                    moments[1][k][name] += 0.01 * (g * g - moments[1][k][name])
                    t[name] += rate * (moments[0][k][name] / (1 - 0.9 ** (r + 1))) / (math.sqrt(moments[1][k][name] / (1 - 0.99 ** (r + 1))) + 1e-6)
        self.emit, self.trans, self.start = theta[0], [[theta[1][y, z] for z in (0, 1)] for y in (0, 1)], [theta[2][y] for y in (0, 1)]
        x, y = [logit(self.raw(lines)) for lines, _ in examples], [y for _, y in examples]
        high, low = (wins + 1) / (wins + 2), 1 / (n - wins + 2)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps, with a prior at slope 1
            p = [sigmoid(a * v + b) for v in x]
            w = [q * (1 - q) + 1e-9 for q in p]
            off = [(high if t else low) - q for t, q in zip(y, p, strict=True)]
            g = [sum(o * v for o, v in zip(off, x, strict=True)) - (a - 1), sum(off)]
            h = [[sum(k * v * v for k, v in zip(w, x, strict=True)) + 1, sum(k * v for k, v in zip(w, x, strict=True))], [sum(k * v for k, v in zip(w, x, strict=True)), sum(w) + 1e-6]]
            det = h[0][0] * h[1][1] - h[0][1] * h[1][0]
            step = [(g[0] * h[1][1] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[1][0] * g[0]) / det]
            a, b = a + max(-1.0, min(1.0, step[0])), b + max(-1.0, min(1.0, step[1]))
        self.scale, self.shift = a, b

    def raw(self, lines):
        own = [sum(self.emit.get(a, 0.0) for a in active(lines, i)) for i in range(len(lines))]
        good, _ = beliefs(own, self.trans, self.start)
        return sum(p * n for p, (_, n) in zip(good, lines, strict=True)) / sum(n for _, n in lines)

    def score(self, text):
        lines = coded(text)
        return sigmoid(self.scale * logit(self.raw(lines)) + self.shift) if lines else self.prior


def test_quality_query_equals_the_plain_version(spark):
    documents, labels = tables(spark)
    field = PlainField([(coded(documents[d].text), y) for d, y in labels.items() if d in documents and remainder(d, 3) != 1])
    got = QUERIES["op3_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        want = field.score(documents[r.doc_id].text)
        assert r.score == pytest.approx(want, abs=1e-5) and r.held_out == (remainder(r.doc_id, 3) == 1)
        assert r.predicted == int(r.score >= 0.5)
    judged = [(r.predicted == labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(judged) / len(judged) > 0.8


def test_the_sample_is_summed_before_texts_are_read(spark):
    rows = [(i, f"text {i} " * 50) for i in range(30)] + [(3, "another"), (3, "another"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    order = [r.doc_id for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "doc_id").collect()]
    sizes = {i: len(f"text {i} " * 50) for i in range(30)}
    taken = quality._examples(docs, labels, 1000, 2000, "text")
    total, want = 0, 0
    for i in order:  # until the bytes before are enough
        if total >= 2000:
            break
        want += 1
        total += sizes[i] if i not in (3, 4) else 0 if i == 4 else sizes[3]
    assert abs(len(taken) - want) <= 1 and len(taken) < 10


# language


def ngrams(text):
    """Counts of hashed n-grams, one at a time."""
    word = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    while "  " in word:
        word = word.replace("  ", " ")
    if word.strip() == "":
        return {}
    out, mask = {}, 2**64 - 1
    for n, salt in zip((1, 2, 3), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True):
        for i in range(len(word) - n + 1):
            code = 0
            for c in word[i : i + n]:
                code = (code * 0x110001 + ord(c)) & mask
            at = ((((code * 0x9E3779B97F4A7C15) & mask) ^ salt) * salt & mask) >> 49
            out[at] = out.get(at, 0) + 1
    return out


def softmax(z):
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def plain_language(documents, by):
    """A function from an id to (probabilities of the languages or none, the languages); ``by`` has the hashes that order a sample."""
    counts = {d: ngrams(r.text) for d, r in documents.items()}
    known = [d for d, r in documents.items() if remainder(d, 4) != 2 and r.lang is not None]
    seen = {}
    for d in known:
        for at in counts[d]:
            seen[at] = seen.get(at, 0) + 1
    idf = lambda at: math.log((1 + len(known)) / (1 + seen.get(at, 0))) + 1

    def vector(d):
        x = {at: (1 + math.log(n)) * idf(at) for at, n in counts[d].items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {at: v / norm for at, v in x.items()} if norm else {}

    packed = lambda values: np.array(values, "<i4").tobytes()
    key = lambda d: (packed(sorted(counts[d])), packed([counts[d][a] for a in sorted(counts[d])]), documents[d].lang)
    order = sorted((d for d in known if counts[d]), key=key)
    languages = sorted({documents[d].lang for d in order})
    own, held = [d for d in order if by[d] % 10 != 0], [d for d in order if by[d] % 10 == 0]
    k = len(languages)
    z, n = {}, {}

    def leader(at):
        return [0.0 if abs(a) <= 1e-3 else -(a - math.copysign(1e-3, a)) / (1.0 + math.sqrt(b) + 1e-3) for a, b in zip(z.get(at, [0.0] * k), n.get(at, [0.0] * k), strict=True)]

    rng, places = np.random.default_rng(0), np.arange(len(own))
    for _ in range(6):
        rng.shuffle(places)
        for s in range(0, len(places), 16):
            some = [own[i] for i in places[s : s + 16]]
            used = {at for d in some for at in counts[d]} | {"bias"}
            w = {at: leader(at) for at in used}
            grad = {at: [0.0] * k for at in used}
            for d in some:
                x = vector(d) | {"bias": 1.0}
                p = softmax([sum(v * w[at][j] for at, v in x.items()) for j in range(k)])
                p[languages.index(documents[d].lang)] -= 1
                for at, v in x.items():
                    for j in range(k):
                        grad[at][j] += v * p[j]
            for at in used:
                zs, ns = z.setdefault(at, [0.0] * k), n.setdefault(at, [0.0] * k)
                for j in range(k):
                    grew = ns[j] + grad[at][j] ** 2
                    zs[j] += grad[at][j] - (math.sqrt(grew) - math.sqrt(ns[j])) * w[at][j]
                    ns[j] = grew
    weights = {at: leader(at) for at in z}

    def logits(d):
        x = vector(d) | {"bias": 1.0}
        return [sum(v * weights.get(at, [0.0] * k)[j] for at, v in x.items()) for j in range(k)]

    hot = [(logits(d), languages.index(documents[d].lang)) for d in held]
    loss = lambda log_t: -sum(math.log(max(softmax([v / math.exp(log_t) for v in row])[y], 1e-12)) for row, y in hot) / len(hot)
    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    heat = math.exp((low + high) / 2)
    return lambda d: (softmax([v / heat for v in logits(d)]) if counts[d] else None, languages)


def language_order(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.xxhash64("doc_id", F.lit("language sample")).alias("by"))
    return {r.doc_id: r.by for r in rows.collect()}


def test_language_query_equals_the_plain_version(spark):
    documents, _ = tables(spark)
    predict = plain_language(documents, language_order(spark))
    for r in QUERIES["op10_language"](spark, SF).collect():
        assert r.held_out == (remainder(r.doc_id, 4) == 2)
        p, languages = predict(r.doc_id)
        if p is None:
            assert (r.lang_pred, r.score) == (langid.UNDETERMINED, 0.0)
            continue
        assert r.score == pytest.approx(max(p), abs=1e-3) and (r.lang_pred == languages[p.index(max(p))] or sorted(p)[-1] - sorted(p)[-2] < 1e-3)
