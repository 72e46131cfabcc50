"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrail.llm.common import PAGE_BITS, attach_groups, bit_of, cut, fold

PROBES = 2


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """One row for every row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest id stays.
    Rows that repeat an id as well as a text are all in the group's size and are all marked kept. A null id stays only where no row of the group has one. No rows: no rows. Other
    columns are ignored, so none can clash. Very long texts are hashed whole, and only their hash travels.

    Pass one reads every text once, keeps id and SHA-256 (the lineage is cut there), and counts how many rows fall on each
    bit of a Bloom filter; bits met twice or more form the filter. Pass two tests every row: a row with a bit met only once
    is certainly unique and passes straight through. Only the others shuffle, on the SHA-256, to be grouped exactly. The
    filter has ``bits_per_row`` bits a row up to ``max_bits`` (32 MB to broadcast); with more rows than that serves, more
    unique rows are tested exactly, and the result is the same.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.sha2(fold(F.col(text_col)).cast("binary"), 256).alias("text_sha256")))
    total = rows.count()
    bits = PAGE_BITS
    while bits < min(total * bits_per_row, max_bits):
        bits *= 2
    probes = [_probe(seed, bits) for seed in range(PROBES)]
    met = rows.select(F.explode(F.array_distinct(F.array(*probes))).alias("bit")).groupBy("bit").count().where("count > 1")
    page = F.floor(F.col("bit") / PAGE_BITS)
    pages = cut(met.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % PAGE_BITS).alias("bitmap")))

    tested = rows
    for seed, probe in enumerate(probes):
        side = F.broadcast(pages.select(F.col("page").alias(f"page{seed}"), F.col("bitmap").alias(f"bitmap{seed}")))
        tested = tested.withColumn(f"page{seed}", F.floor(probe / PAGE_BITS)).join(side, f"page{seed}", "left")
    repeated = bit_of(F.col("bitmap0"), probes[0]) & bit_of(F.col("bitmap1"), probes[1])
    tested = tested.select("doc_id", "text_sha256", repeated.alias("repeated"))

    alone = tested.where("not repeated").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.where("repeated").drop("repeated")
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = attach_groups(maybe, groups, "text_sha256", "group_size", total)
    return alone.unionByName(found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def _probe(seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64("text_sha256", F.lit(seed)), F.lit(bits))

