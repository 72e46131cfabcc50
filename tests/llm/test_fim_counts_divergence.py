"""Fill-in-middle, token counts and source divergence against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendtrail.llm import divergence, token_counts
from spendtrail.llm.divergence import divergence_audit
from spendtrail.llm.fim import FillInMiddle, boundaries, fim_restore, fim_transform
from spendtrail.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [None, "", "\n", "\n\n\nx", "one line", "tail\n", "a\nb\nc\nd\ne", "À la\r\ncarte\n😀 emoji\n", "has <P> in it\nx", "<M>", "almost <P\n>\n<S\n", "x" * 30000, "word \n" * 20000, " \x1c odd space\n\x85"]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")


# fill-in-middle


def filled(key, text, pattern=r"[^\n]*\n|[^\n]+", rate=100, spm=50, seed=7, p="<P>", s="<S>", m="<M>"):
    text = text or ""
    units = re.findall(pattern, text)
    h = [int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in (p, s, m)) or h[2] % 100 >= rate:
        return text, n, "plain", None, None
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm:
        return s + suffix + p + prefix + m + middle, n, "spm", len(prefix), len(middle)
    return p + prefix + s + suffix + m + middle, n, "psm", len(prefix), len(middle)


@pytest.mark.parametrize(
    "how, options",
    [
        (FillInMiddle(), {}),
        (FillInMiddle(unit="word", rate=70, spm=30, seed=11), {"pattern": r"\s*\S+|\s+", "rate": 70, "spm": 30, "seed": 11}),
        (FillInMiddle(unit="char", sentinels=("[pre]", "[suf]", "[mid]")), {"pattern": r"(?s).", "p": "[pre]", "s": "[suf]", "m": "[mid]"}),
    ],
)
def test_fim_equals_brute_force_and_comes_back(spark, how, options):
    rng = random.Random(3)
    texts = AWKWARD + ["".join(rng.choice("ab \n\té😀<PSM>") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    frame = docs(spark, texts).withColumns({"n": F.lit("clash"), "output": F.lit(0)})
    rows = fim_transform(frame, how).withColumn("back", fim_restore(F.col("output"), F.col("form"), how.sentinels)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.output, r.n, r.form, r.prefix_chars, r.middle_chars) == filled(r.doc_id, texts[r.doc_id], **options)
        assert r.back == (texts[r.doc_id] or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_fim_of_repeats_null_ids_and_nothing(spark):
    rows = fim_transform(docs(spark, ["a\nb\n", "a\nb\n", "c\n"], [4, 4, None])).collect()
    assert len({r.output for r in rows if r.doc_id == 4}) == 1
    assert [r.output for r in rows if r.doc_id is None] == [filled(None, "c\n")[0]]
    assert fim_transform(docs(spark, [])).count() == 0


@pytest.mark.parametrize("sentinels", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P", "<P>", "<M>"), ("<P<", "<S>", "<M>")])
def test_fim_refuses_sentinels_that_cannot_be_told_apart(sentinels):
    with pytest.raises(ValueError):
        FillInMiddle(sentinels=sentinels)


def test_fim_boundaries_of_nothing():
    import numpy as np

    assert boundaries(np.zeros(0, np.uint32), "line").tolist() == [0]
    assert boundaries(np.array([10, 10], np.uint32), "line").tolist() == [0, 1, 2]


def test_fim_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for r in QUERIES["op11_fill_in_middle"](spark, "/root/testdata/sf0.001").collect():
        output, *rest = filled(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == tuple(rest)
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(texts[r.doc_id]))


# token counts

ALPHABET = [*"abcXYZ 's't're \n\t\r.,!?0123<|>éÉßİıŉſÀžŽ²½ª­́̇Σσςẞ漢字‍  \x1c\x00\x85😀ǅﬁͅ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "don't", "the", " hello"]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library(spark, file):
    rng = random.Random(5)
    texts = AWKWARD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["the same"] * 2
    library = Tokenizer.from_file(public_tokenizers.path(file))
    frame = docs(spark, texts).withColumns({"n_tokens": F.lit("clash"), "n_bytes": F.lit(0)})
    rows = token_counts.token_counts(frame, public_tokenizers.path(file), limit=20).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 20)
    assert token_counts.token_counts(docs(spark, []), WORDS).count() == 0


def test_whole_tokens_are_proven_and_never_merged():
    whole, library = token_counts.whole_tokens(WORDS), Tokenizer.from_file(WORDS)
    assert len(whole) > 30_000
    for text in sorted(whole)[::97]:
        assert len(library.encode(text, add_special_tokens=False).ids) == 1
    counts = token_counts.Counts(WORDS, whole)
    merged = []
    model = counts.model

    class Spy:
        def tokenize(self, name):
            merged.append(name)
            return model.tokenize(name)

    counts.model = Spy()
    text = "The house is big, isn't it? Floccinaucinihilipilification! <|endoftext|> the house"
    assert counts.of(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert merged == ["floccinaucinihilipilification"]


def test_counts_in_blocks_and_of_many_words(monkeypatch):
    library, whole = Tokenizer.from_file(WORDS), token_counts.whole_tokens(WORDS)
    monkeypatch.setattr(token_counts, "BLOCK", 20)
    monkeypatch.setattr(token_counts, "KEPT", 5)
    rng = random.Random(9)
    for _ in range(100):
        text = "".join(rng.choice(ALPHABET) for _ in range(400))
        assert token_counts.Counts(WORDS, whole).of(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_query_equals_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op12_token_counts"](spark, "/root/testdata/sf0.001").collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


# source divergence


def audited(rows, min_docs, top):
    """By the definition: every kept term of every pair."""
    count, found, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(words)
        total[lang].update(words)
        found[lang].update(set(words))
    out = set()
    for lang, source in count:
        kept = [t for t, n in found[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p, q = shares(count[lang, source]), shares(total[lang])
        pairs = [(-sum(abs(p[t] - x) for t, x in shares(count[lang, s]).items()), s) for other, s in count if other == lang and s != source]
        terms = [(q[t] - p[t], t) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, found_ in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -value, i + 1) for i, (value, item) in enumerate(found_)}
    return out


def corpus(seed, n, sources):
    rng = random.Random(seed)
    words = [*(f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"), "École", "ÉCOLE", "école", "漢字", "naïve", "Zed", "zed", "don't", "x\x00y", "tie", "eit"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(sources)
        bias = words[: rng.choice([5, 20, len(words)])]
        rows.append((rng.choice([None, "", " 1 ", *[" ".join(rng.choice(bias) for _ in range(rng.randint(1, 30))) for _ in range(9)]]), lang, source))
    return rows + [(None, "xx", "only"), ("rare words", "yy", "a"), ("rare", "yy", "b"), ("tie eit " * 40, "zz", "c"), ("tie eit " * 40, "zz", "d")] + rows[:10]


@pytest.mark.parametrize("min_docs, top", [(1, 50), (5, 3), (30, 50)])
def test_divergence_equals_brute_force(spark, min_docs, top):
    rows = corpus(min_docs, 600, ["web", "web", "web", "books", "news", None, "", "é"])
    frame = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("clash"), "n": F.lit(1), "rank": F.lit("x")})
    got = divergence_audit(frame, min_docs, top).collect()
    want = audited(rows, min_docs, top)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {r.part for r in got} == {"pair", "term"}
    assert any(r.lang == "xx" for r in got) is False and all(r.value == 0 for r in got if r.lang == "yy" and min_docs > 2)


def test_divergence_of_nothing(spark):
    assert divergence_audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_partial_counts_do_not_depend_on_what_a_task_holds(spark):
    rows = corpus(2, 200, ["a", "b", "c"])
    frame = spark.createDataFrame(rows, "lang string, source string, text string").select("lang", "source", "text")
    total = lambda most: {tuple(r) for r in divergence.partial_counts(frame, most).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()}
    assert total(3) == total(10**6)


def test_overlaps_do_not_depend_on_the_width_of_arrays(spark):
    rng = random.Random(4)
    names = [f"s{i:02}" for i in range(23)]
    rows = [(lang, [(s, rng.randint(5, 90), 3 + names.index(s) % 4) for s in rng.sample(names, rng.randint(1, 23))]) for lang in ("a", "b", "c") for _ in range(60)]
    frame = spark.createDataFrame(rows, "lang string, held array<struct<source string, p long, p0 long>>").coalesce(1)
    want = Counter()
    for lang, held in rows:
        for a, p, p0 in held:
            for b, q, q0 in held:
                if a < b:
                    want[lang, a, b] += abs(p - q) - abs(p - q0) - abs(p0 - q) + abs(p0 - q0)
    for wide in (2, 5, 12, 1024):
        got = {(r.lang, r.a, r.b): r.fix for r in divergence.overlap_corrections(frame, wide).collect()}
        assert {k: x for k, x in got.items() if x} == {k: x for k, x in want.items() if x}


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 7)
    text = "Some TEXT, with ünïcode-words and averyveryverylongone  x"
    assert [t.decode() for part in divergence.terms_of(text) for t in part] == ["some", "text", "with", "ünïcode", "words", "and", "averyveryverylongone", "x"]
