"""The pipeline's stages on the smallest documents, each against what its operator says of the stage's own input."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(i)))
        docs = spark.read.parquet(str(folder / str(i)))
        out.append(docs.toPandas())
    return out


def test_stages_return_documents(spark, stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert list(after.columns) == list(stages[0].columns)
        assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.is_unique
    assert 0 < len(stages[-1])


def test_classifiers_drop_what_they_reject_and_keep_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = stages[0].doc_id.isin(stages[1].doc_id)
    known = stages[0].doc_id.isin(labels.index)
    truth = stages[0].doc_id[known].map(labels) == 1
    assert (kept[known] == truth).mean() > 0.9 and kept[known][truth].mean() > 0.95
    assert len(stages[2]) >= 0.98 * len(stages[1])


def test_texts_change_only_in_line_dedup(stages):
    texts = [dict(zip(s.doc_id, s.text, strict=True)) for s in stages[:-1]]
    assert all(texts[2][i] == texts[0][i] for i in texts[2]) and all(texts[4][i] == texts[3][i] for i in texts[4])
    assert set(texts[3]) == set(texts[2]) and any(texts[3][i] != texts[2][i] for i in texts[3])
    assert (stages[3].n_chars == stages[3].text.str.len()).all()


def shingles(text):
    w = text.encode().lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_of_near_copies_stays(stages):
    before, kept = stages[3], set(stages[4].doc_id)
    sets = {i: shingles(t) for i, t in zip(before.doc_id, before.text, strict=True)}
    ids = sorted(sets)
    near = defaultdict(set)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            union = len(sets[a] | sets[b])
            likeness = len(sets[a] & sets[b]) / union if union else 1.0
            if likeness >= 0.6:
                near[a].add(b)
                near[b].add(a)
            if likeness >= 0.8:
                assert not (a in kept and b in kept)
    assert all(i in kept for i in ids if not near[i])


def test_packing_holds_every_token(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages[5]
    assert set(pieces.doc_id) == set(stages[4].doc_id)
    for doc, text in zip(stages[4].doc_id, stages[4].text, strict=True):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        own = pieces[pieces.doc_id == doc].sort_values("piece")
        assert own.length.sum() == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096


ODD = [None, "", " \n\t ", "a", "1 2 3", "same text here", "same text here", "word " * 30000, "\n".join(["line of a few words"] * 30), "😀", "tail\n"]


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows_and_none(spark, tmp_path, number):
    frame = spark.createDataFrame(
        [(i, t, "en" if i % 2 else None, None, 1, "mine", "too", 9) for i, t in enumerate([*ODD, *ODD])] + [(3, "again", "en", "x", 1, "mine", "too", 9), (3, "again", "en", "x", 1, "mine", "too", 9), (None, "no id", None, None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_deleted string, score long",
    )
    spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (4, None), (4, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.STAGES[number][1]
    got, none = stage(spark, frame, str(tmp_path)), stage(spark, frame.limit(0), str(tmp_path))
    assert none.count() == 0
    if number == 4:
        assert got.select("doc_id", "piece").count() >= frame.count()
        return
    assert got.columns == frame.columns
    rows = [tuple(r) for r in got.collect()]
    if number == 2:
        assert sorted(str((r[0], r[2], *r[5:])) for r in rows) == sorted(str((r[0], r[2], *r[5:])) for r in frame.collect())
    else:
        given = [tuple(r) for r in frame.collect()]
        assert all(rows.count(r) == given.count(r) for r in rows)
    if number == 3:
        assert rows.count((3, "again", "en", "x", 1, "mine", "too", 9)) == 2 and sum(not (r[1] or "").split() for r in rows) == 1
        assert (None, "no id") in [r[:2] for r in rows]


def test_registered_queries(spark):
    names = __spark_entry__.queries()
    assert len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("op1_line_dedup", "op3_quality", "op4_exact_dedup", "op6_byte_bpe", "op7_lm_scores", "op9_simhash", "op10_language", "op11_fill_in_middle", "op12_token_counts"):
        got = names[name](spark, SF)
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect()), name


def test_held_out_rows_never_teach(spark):
    from spendtrail.llm.quality import fit_quality
    from spendtrail.llm.queries import held_out

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(held_out(3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (fit_quality(docs, x, ~held_out(3, 1)) for x in (labels, flipped))
    assert np.allclose(a.emit, b.emit) and a.shift == pytest.approx(b.shift)
