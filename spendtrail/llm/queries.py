"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from spendtrail.llm.bpe import bpe_encode
from spendtrail.llm.common import table
from spendtrail.llm.divergence import divergence_audit
from spendtrail.llm.exact_dedup import exact_dedup
from spendtrail.llm.fim import fim_restore, fim_transform
from spendtrail.llm.hnsw import nearest
from spendtrail.llm.langid import fit_language, language_scores
from spendtrail.llm.line_dedup import line_dedup
from spendtrail.llm.lm import lm_scores
from spendtrail.llm.packing import best_fit_packing
from spendtrail.llm.quality import fit_quality, quality_scores
from spendtrail.llm.simhash import near_dedup
from spendtrail.llm.token_counts import token_counts
from spendtrail.llm.url_filter import Rule, url_verdicts


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_dedup(docs.select("doc_id", "text"))


URL_RULES = [Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block")]


def op2_url_filter(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def held_out(mod, rest):
    """Rows with this remainder are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    return quality_scores(docs, field).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decode=True)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = lm_scores(docs, ~held_out(7, 2))
    return scores.withColumn("held_out", held_out(7, 2))


def op8_hnsw(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_simhash(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs, ~held_out(4, 2))
    return language_scores(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op11_fill_in_middle(spark, sf_dir):
    rows = fim_transform(table(spark, sf_dir, "documents"))
    restored = fim_restore(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_source_divergence(spark, sf_dir):
    return divergence_audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_url_filter, op3_quality, op4_exact_dedup, op5_best_fit_packing, op6_byte_bpe, op7_lm_scores, op8_hnsw, op9_simhash, op10_language,
        op11_fill_in_middle, op12_token_counts, op13_source_divergence,
    )
}

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_line_dedup": """
        WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS all_lines FROM documents),
             raw AS (SELECT doc_id, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS pos FROM docs),
             units AS (SELECT doc_id, pos, trim(line) AS line, length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 AS words,
                              row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM raw WHERE trim(line) <> ''),
             reach AS (SELECT a.doc_id, a.i, b.i AS j,
                              sum(b.words) OVER (PARTITION BY a.doc_id, a.i ORDER BY b.i) AS words,
                              string_agg(b.line, chr(10)) OVER (PARTITION BY a.doc_id, a.i ORDER BY b.i) AS content
                       FROM units a JOIN units b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 7),
             windows AS (SELECT doc_id, i, min(j) - i + 1 AS n, arg_min(content, j) AS content
                         FROM reach WHERE words >= 50 OR j = i + 7 GROUP BY doc_id, i),
             firsts AS (SELECT content, min((doc_id, i)) AS first FROM windows GROUP BY 1),
             later AS (SELECT w.doc_id, w.i, first[1] AS ref, w.i - first[2] AS shift, w.i + n - 1 AS j
                       FROM windows w JOIN firsts f USING (content) WHERE (w.doc_id, w.i) > first),
             pairs AS (SELECT DISTINCT doc_id, ref, shift FROM later),
             along AS (SELECT p.*, a.i, a.i - row_number() OVER (PARTITION BY p.doc_id, p.ref, p.shift ORDER BY a.i) AS run
                       FROM pairs p JOIN units a ON a.doc_id = p.doc_id JOIN units b ON b.doc_id = p.ref AND b.i = a.i - p.shift AND b.line = a.line),
             runs AS (SELECT doc_id, ref, shift, min(i) AS low, max(i) AS high FROM along GROUP BY doc_id, ref, shift, run),
             lost AS (SELECT DISTINCT r.doc_id, u.i, u.pos FROM runs r JOIN later l USING (doc_id, ref, shift)
                      JOIN units u ON u.doc_id = r.doc_id AND u.i BETWEEN low AND high WHERE l.i >= low AND l.j <= high),
             spans AS (SELECT doc_id, min(pos) AS low, max(pos) AS high
                       FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM lost) GROUP BY doc_id, run),
             gone AS (SELECT r.doc_id, r.pos FROM raw r JOIN spans s ON r.doc_id = s.doc_id AND r.pos BETWEEN low AND high),
             left_over AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) AS text, count(*) AS n
                           FROM raw r ANTI JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos GROUP BY 1)
        SELECT d.doc_id, coalesce(l.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text,
               coalesce(len(all_lines), 0)::INT AS n_lines, (coalesce(len(all_lines), 0) - coalesce(l.n, 0))::INT AS n_deleted
        FROM docs d LEFT JOIN left_over l ON d.doc_id = l.doc_id""",
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({FOLDED}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op11_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
             d AS (SELECT *, len(units) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS draws FROM t),
             c AS (SELECT *, least(draws[1] % (n + 1), draws[2] % (n + 1)) AS low, greatest(draws[1] % (n + 1), draws[2] % (n + 1)) AS high,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 100 THEN 'plain'
                               WHEN draws[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
             p AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
    "op13_source_divergence": rf"""
        WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {FOLDED} AS text FROM documents),
             words AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM docs),
             kept AS (SELECT lang, term, count(*) AS whole FROM words GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
             size AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM kept GROUP BY 1),
             grp AS (SELECT DISTINCT lang, source FROM docs),
             counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
             totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN counts USING (lang, source) GROUP BY 1, 2),
             p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p,
                          1 + (1000000000::HUGEINT * (whole + 5)) // (s.n + 5 * v) AS q
                   FROM totals JOIN size s USING (lang) JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)),
             pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
                      FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
                      LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y USING (lang, term) GROUP BY 1, 2, 3) d
                             ON d.lang = a.lang AND d.source = a.source AND d.other = b.source),
             term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term)) WHERE part = 'pair' OR rank <= 50""",
}
