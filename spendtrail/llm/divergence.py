"""How far the sources of a language are from each other in their use of terms: an audit in exact integers.

The distance of two sources is a sum over all kept terms of the language, most of which either source lacks. It is priced
by inclusion and exclusion over the supports: each source's histogram of counts against the other's share of an absent term,
a constant for the terms that both lack, and corrections for the terms that both have, from the postings of these terms alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrail.llm.common import attach_groups, written

UNIT = 1_000_000_000  # shares are in parts of this
SMOOTH = 5  # is added to each count
HELD = 250_000  # counted (group, term) pairs that a task holds before it passes them on
BLOCK = 1 << 22  # bytes of a text that are split into terms at a time, about
WIDE = 1024  # sources whose pairs are summed in one array
COPIES = 16  # parts of a language's sources that meet all others side by side

#: Bytes of UTF-8 outside terms become spaces, A-Z lower case; all bytes of non-ASCII characters are of terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str):
    """The terms, as UTF-8, in lists of those of a stretch of the text."""
    spaced = text.encode().translate(TERM_BYTES)
    at = 0
    while len(spaced) - at > BLOCK:
        end = spaced.find(b" ", at + BLOCK)
        if end < 0:
            break
        yield spaced[at:end].split()
        at = end
    yield (spaced[at:] if at else spaced).split()


def partial_counts(docs: DataFrame, most: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within a task; a row with an empty term marks a group."""

    def run(batches):
        def passed_on():
            langs, sources, terms, n, found = [], [], [], [], []
            for (lang, source), (total, docs_of) in held.items():
                langs += [lang] * len(total)
                sources += [source] * len(total)
                terms += total.keys()
                n += total.values()
                found += map(docs_of.__getitem__, total)  # the marker is in no document
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(found, pa.int64())], ["lang", "source", "term", "n", "docs"]
            )

        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                total, docs_of = held.setdefault((lang or "", source or ""), (Counter({b"": 0}), Counter()))
                before, seen = len(total), set()
                for terms in terms_of(text.as_py() or ""):
                    seen.update(terms)
                    total.update(terms)
                docs_of.update(seen)
                size += len(total) - before
                if size >= most:
                    yield passed_on()
                    held, size = {}, 0
        if held:
            yield passed_on()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)), by whole numbers of as many digits as it takes."""
    wide = lambda x: x.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", wide(n + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + terms * SMOOTH))).cast("long")


def overlap_corrections(postings: DataFrame, wide: int = WIDE) -> DataFrame:
    """(lang, a, b, fix) for sources a < b with a term in common: the sum of |p - q| - |p - q0| - |p0 - q| + |p0 - q0|.

    ``postings``: lang and ``held``, the (source, p, p0) that have a term. A task sums pairs in arrays of bounded size and
    passes sums on, so pairs of single terms become rows only where a term has more than ``wide`` sources.
    """

    def priced(p, p0, q, q0):
        p, p0, q, q0 = p[:, None], p0[:, None], q[None], q0[None]
        return np.abs(p - q) - np.abs(p - q0) - np.abs(p0 - q) + np.abs(p0 - q0)

    def rows(lang, names, others, fix):
        pairs = [(names[i], others[j], int(fix[i, j])) for i, j in np.argwhere(fix != 0).tolist() if names[i] < others[j]]
        a, b, x = zip(*pairs, strict=True) if pairs else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(x, pa.int64())], ["lang", "a", "b", "fix"])

    def run(batches):
        sums = {}  # lang -> (place of each source, sums of pairs)

        def passed_on(lang):
            places, total = sums.pop(lang)
            return rows(lang, list(places), list(places), total)

        for batch in batches:
            for lang, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, p, p0 = (held.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                names = names.tolist()
                if len(names) > wide:
                    for i in range(0, len(names), wide):
                        for j in range(0, len(names), wide):
                            m, n = slice(i, i + wide), slice(j, j + wide)
                            yield rows(lang, names[m], names[n], priced(p[m], p0[m], p[n], p0[n]))
                    continue
                if lang in sums and len(sums[lang][0]) + sum(x not in sums[lang][0] for x in names) > 2 * wide:
                    yield passed_on(lang)
                places, total = sums.get(lang, ({}, np.zeros((0, 0), np.int64)))
                at = np.array([places.setdefault(x, len(places)) for x in names])
                if len(places) > len(total):
                    total = np.pad(total, (0, min(2 * wide, 2 * len(places)) - len(total)))
                    while sums.keys() - {lang} and sum(t.size for _, t in sums.values()) + total.size > 2 * (2 * wide) ** 2:
                        yield passed_on(next(x for x in sums if x != lang))
                sums[lang] = places, total
                total[np.ix_(at, at)] += priced(p, p0, p, p0)
        for lang in list(sums):
            yield passed_on(lang)

    return postings.select("lang", "held").mapInArrow(run, "lang string, a string, b string, fix long").groupBy("lang", "a", "b").agg(F.sum("fix").alias("fix"))


def divergence_audit(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of a language and source.

    Terms are runs of A-Z, a-z and non-ASCII characters, A-Z lower-cased. A language keeps those in at least ``min_docs`` of its
    rows, V of them; a group's share of a kept term it has n times is p = 1 + floor(UNIT (n + 5) / (N + 5 V)), N all kept terms
    in it. Part pair: item is every other source of the language, value the sum over all kept terms of the difference of
    shares (0 without kept terms). Part term: item is a kept term of the group of a larger share than in its whole language,
    value the difference, the ``top`` largest. Ranks are by value, then by item in UTF-8 order.

    Nulls in any of the three columns are empty strings, which count as a language and a source. Groups without terms have
    pairs too. Very long texts count whole; repeated rows each count; no rows: no rows; other columns are ignored.
    """
    chosen = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    per_term = ["lang", "term"]
    counted = partial_counts(chosen).repartition(*per_term).groupBy(*per_term, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counted.groupBy(*per_term).agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = written(kept.where((F.col("docs") >= min_docs) | (F.col("term") == "")))

    each = kept.select("lang", "term", "whole", F.inline("held"))
    is_term = F.col("term") != ""
    terms = kept.where(is_term).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("lang_total"))
    sizes = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(is_term).alias("size"))
    groups = sizes.join(terms, "lang", "left").na.fill(0, ["terms", "lang_total"])
    groups = written(groups.select("*", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0).alias("absent")))
    rows = each.where(is_term).withColumn("group", F.struct("lang", "source"))
    known = groups.where(F.col("size") > 0).select(F.struct("lang", "source").alias("group"), "size", "total", "terms", "lang_total", "absent")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shares = attach_groups(rows, known, "group", "size", total)
    shares = written(shares.select(*per_term, "source", "absent", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("whole"), F.col("lang_total"), F.col("terms")).alias("q")))

    apart = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = pair_distances(groups, shares)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(apart)


def pair_distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) for every source and every other one of its language.

    A language's sources meet in ``COPIES`` parts, each with all sources, as every pair is asked for.
    """
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("histogram"))
    held = groups.select("lang", "source", "terms", "size", "absent").join(histogram, ["lang", "source"], "left")
    here = held.withColumn("part_", F.pmod(F.xxhash64("source"), F.lit(COPIES)).cast("int"))
    there = groups.select("lang", F.col("source").alias("item"), F.col("size").alias("its_size"), F.col("absent").alias("its_absent"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("part_"))
    met = here.join(there, ["lang", "part_"]).where(F.col("source") != F.col("item"))
    one_sided = F.coalesce(F.aggregate("histogram", F.lit(0).cast("long"), lambda sum_, x: sum_ + x.times * F.abs(x.p - F.col("its_absent"))), F.lit(0))
    constant = (F.col("terms") - F.col("size") - F.col("its_size")) * F.abs(F.col("absent") - F.col("its_absent"))
    met = met.select("lang", "source", "item", one_sided.alias("side"), constant.alias("constant"))
    sides = met.select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), "side", "constant")
    sums = sides.groupBy("lang", "a", "b").agg(F.sum("side").alias("sides"), F.first("constant").alias("constant"))
    fixes = overlap_corrections(shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "absent")).alias("held")).where(F.size("held") > 1))
    both = sums.join(fixes, ["lang", "a", "b"], "left").withColumn("value", F.col("sides") + F.col("constant") + F.coalesce("fix", F.lit(0)))
    named = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("named")
    return both.select("lang", named, "value").select("lang", "named.source", F.lit("pair").alias("part"), "named.item", "value")
