"""Deletion of later repeated runs of lines, by winnowing over line hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrail.llm.common import attach_groups, attach_wide_groups, release, split_by_keys, written

ROW = ["doc_id", "text_hash"]
OWN, RUNS, PLACES = ["__line_dedup_doc_id", "__line_dedup_text_hash"], "__line_dedup_runs", "__line_dedup_places"  # beside the input's own columns


def line_dedup(docs: DataFrame, min_words: int = 50, max_lines: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and the columns n_lines and n_deleted added.

    Lines are compared without the spaces around them; blank lines are no units, and stay unless both sides of them go. A
    window starts at any line and runs to the first line at which it has ``min_words`` words or ``max_lines`` lines (words:
    one more than the spaces); where the text ends before that, there is no window. A window that starts at a smaller (id,
    line) too is a repeat of the first of these; from both places lines are followed backwards and forwards until they
    differ or a text ends, and the whole run found so is deleted. So of each repeated run that holds a window, an earlier
    occurrence stays and later ones go, in other documents or the same one. Null texts stay null, with 0 lines. Texts whose
    lines all go become empty. Very long texts are texts like others. Rows that repeat both id and text are treated alike;
    rows without an id are left as they are. Columns of the input named n_lines or n_deleted are replaced. No rows: no rows.

    Winnowing: the smallest line hash of a window (the last of equals) is its fingerprint, so two equal windows always
    share one. Only these selected minima become rows, one each with the windows that selected it. Minima met once end
    there. The places of the others are joined by the windows' hashes, each to the first one, and matches are extended both
    ways (see ``_extended``). Nothing pairs occurrences with each other: each place meets the first. Only texts that lose lines
    are shuffled, for which a bitmap of their keys is broadcast.
    """
    text = F.col(text_col)
    keyed = docs.withColumns({OWN[0]: F.col(id_col), OWN[1]: F.xxhash64(text)})
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where(text.isNotNull() & F.col(id_col).isNotNull())
    scratch = []
    minima = written(_minima(texts, min_words, max_lines), scratch)
    matches = _matches(_repeated(minima), scratch)
    merged = written(_merged(_extended(matches, texts, max_lines, scratch)))
    release(docs.sparkSession, scratch)

    lines = F.split(text, "\n")
    plain, losing = split_by_keys(keyed, OWN, merged.select(F.col("doc_id").alias(OWN[0]), F.col("text_hash").alias(OWN[1])))
    joined = losing.join(merged.toDF(*OWN, RUNS), OWN, "left").withColumn(PLACES, F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull()))
    placed = joined.withColumn(RUNS, F.transform(RUNS, lambda r: F.struct(F.get(PLACES, r.start).alias("start"), (F.get(PLACES, r.stop - 1) + 1).alias("stop"))))
    deleted = F.coalesce(F.aggregate(RUNS, F.lit(0), lambda n, r: n + r.stop - r.start), F.lit(0))
    kept = F.when(F.col(RUNS).isNull(), text).otherwise(_keep(lines, F.col(RUNS)))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines))
    others = [F.col(c) for c in docs.columns if c not in ("n_lines", "n_deleted")]
    shortened = placed.withColumns({"n_lines": n_lines, "n_deleted": deleted, text_col: kept}).select(*others, "n_lines", "n_deleted")
    return plain.withColumns({"n_lines": n_lines, "n_deleted": F.lit(0)}).select(*others, "n_lines", "n_deleted").unionByName(shortened)


def _units(text: Column) -> Column:
    """Hash and number of words of every line that isn't blank, in order."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("hash"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))


def _minima(texts: DataFrame, min_words: int, max_lines: int) -> DataFrame:
    """A row for each selected minimum: its hash ``print``, its place ``at``, and the windows (hash, start, lines) that selected it."""
    held = texts.select(*ROW, _units(F.col("text")).alias("units"))

    def reach(part: Column) -> Column:
        """Lines until the window is full, 0 if it never is."""
        end = F.aggregate(
            part,
            F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")),
            lambda a, u: F.when(a.words >= min_words, a).otherwise(F.struct((a.words + u.words).alias("words"), (a.lines + 1).alias("lines"))),
        )
        return F.when((end.words >= min_words) | (end.lines == max_lines), end.lines).otherwise(0)

    def span(u: Column, i: Column) -> Column:
        part = F.slice("units", i + 1, F.lit(max_lines))
        return F.slice(part, 1, reach(part))

    def window(part: Column, start: Column) -> Column:
        smallest = F.array_min(F.transform(part, lambda u, k: F.struct(u.hash.alias("hash"), (-k).alias("minus_at"))))
        return F.struct(
            smallest.hash.alias("print"),
            (start - smallest.minus_at).alias("at"),
            F.xxhash64(F.transform(part, lambda u: u.hash)).alias("window"),
            start.alias("start"),
            F.size(part).alias("lines"),
        )

    # a full window is followed by full ones until the text is too short for any, so starts are places in this array
    spans = held.select(*ROW, F.filter(F.transform("units", span), lambda part: F.size(part) > 0).alias("spans"))
    wide = spans.select(*ROW, F.transform("spans", window).alias("wide"))
    heads = F.filter("wide", lambda w, i: (i == 0) | (F.get("wide", i - 1).at != w.at))  # windows that select one line are neighbours
    chosen = F.transform(
        heads,
        lambda h: F.struct(
            h.print.alias("print"),
            h.at.alias("at"),
            F.transform(
                F.filter(F.slice("wide", h.start + 1, F.lit(max_lines)), lambda w: w.at == h.at),
                lambda w: F.struct(w.window.alias("window"), w.start.alias("start"), w.lines.alias("lines")),
            ).alias("windows"),
        ),
    )
    return wide.select(*ROW, F.explode(chosen).alias("m")).select(*ROW, "m.*")


def _repeated(minima: DataFrame) -> DataFrame:
    """The minima whose hash was selected at two places or more."""
    place = F.struct(*ROW, "at")
    met = minima.groupBy("print").agg(F.count("*").alias("met"), F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("print", "met")
    return attach_groups(minima, met, "print", "met", minima.count())


def _matches(minima: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(text, start, lines, first text, shift): a text's windows that occur before, at ``start - shift`` of the first text."""
    windows = written(minima.select(*ROW, F.explode("windows").alias("w")).select(*ROW, "w.*"), scratch)
    place = F.struct("doc_id", "start", "text_hash")
    firsts = windows.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = attach_groups(windows, firsts, "window", "times", windows.count())
    later = later.where(F.struct("doc_id", "start") > F.struct("first.doc_id", "first.start"))
    first = [F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_hash").alias("first_text_hash")]
    return later.select(*ROW, "start", "lines", *first, (F.col("start") - F.col("first.start")).alias("shift")).distinct()


def _extended(matches: DataFrame, texts: DataFrame, max_lines: int, scratch: list[str] | None = None) -> DataFrame:
    """(text, start, stop): the runs of equal lines, as long as they go both ways from a matched window.

    What lies before a matched window and equals what lies before its first place starts with a matched window itself, so
    windows at neighbouring lines, whatever they match, are a chain that is deleted whole. Behind a chain's last window a run
    can go on, but by fewer lines than a window has, or there would be a matched window more. So only these lines are compared,
    for each first text and shift in the chain; and if the nearest window of that shift is not the last one, the lines between.
    A text and a first text meet once, however many shifts there are between them, so a text that repeats one line is linear.
    """
    by = Window.partitionBy(*ROW).orderBy("start")
    opened = matches.withColumn("chain", F.sum(F.when(F.col("start") == F.lag("start").over(by) + 1, 0).otherwise(1)).over(by))
    chains = Window.partitionBy(*ROW, "chain")
    found = opened.withColumns({"last": F.max("start").over(chains), "stop": F.max(F.col("start") + F.col("lines")).over(chains)})
    found = written(found, scratch)
    whole = found.groupBy(*ROW, "chain").agg(F.min("start").alias("start"), F.first("stop").alias("stop")).drop("chain")

    first = ["first_doc_id", "first_text_hash"]
    ends = found.groupBy(*ROW, *first, "stop", "last", "shift").agg(F.max("start").alias("start"))
    ends = written(ends.groupBy(*ROW, *first).agg(F.collect_list(F.struct("stop", "last", "shift", "start")).alias("ends")), scratch)
    firsts = ends.groupBy(*first).agg(F.count("*").alias("followed")).select(F.struct(*first).alias("first_key"), "followed")
    _, wanted = split_by_keys(texts, ROW, ends.select(*ROW).union(ends.select(*first)).distinct(), scratch=scratch)
    wanted = wanted.select(*ROW, F.transform(_units(F.col("text")), lambda u: u.hash).alias("hashes"))
    wanted = written(wanted.groupBy(*ROW).agg(F.first("hashes").alias("hashes")), scratch)
    key = F.struct(F.col("doc_id").alias(first[0]), F.col("text_hash").alias(first[1]))
    first_side = wanted.select(key.alias("first_key"), F.col("hashes").alias("theirs")).join(firsts, "first_key")
    both = attach_wide_groups(ends.withColumn("first_key", F.struct(*first)), first_side, "first_key", "followed", ends.count(), F.xxhash64(*ROW))
    both = both.join(wanted.withColumnRenamed("hashes", "mine"), ROW)

    def further(e: Column) -> Column:
        """The run's stop: lines are compared until two differ or either text ends."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(max_lines)), e.stop, lambda at, _: F.when(F.get("mine", at) == F.get("theirs", at - e.shift), at + 1).otherwise(at))

    def unbroken(e: Column) -> Column:
        n = e.stop - e.start
        return (e.start == e.last) | (F.slice("mine", e.start + 1, n) == F.slice("theirs", e.start - e.shift + 1, n))

    more = F.filter(F.transform("ends", lambda e: F.struct(e.stop.alias("start"), further(e).alias("stop"), e.alias("e"))), lambda r: (r.stop > r.start) & unbroken(r.e))
    return whole.unionByName(both.select(*ROW, F.explode(more).alias("r")).select(*ROW, "r.start", "r.stop"))


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a text merged: the key and its runs (start, stop), in order."""
    by = Window.partitionBy(*ROW).orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.distinct().withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
    merged = opened.withColumn("run", F.sum("opens").over(by)).groupBy(*ROW, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def _keep(lines: Column, runs: Column) -> Column:
    """The lines between the runs: each run's gap to the one before it, and the rest after the last."""
    gaps = F.transform(
        runs,
        lambda r, i: F.slice(
            lines,
            F.when(i == 0, 0).otherwise(F.get(runs, i - 1).stop) + 1,
            r.start - F.when(i == 0, 0).otherwise(F.get(runs, i - 1).stop),
        ),
    )
    rest = F.slice(lines, F.element_at(runs, -1).stop + 1, F.size(lines))
    return F.array_join(F.concat(F.flatten(gaps), rest), "\n")
