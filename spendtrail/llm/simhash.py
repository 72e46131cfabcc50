"""SimHash near-duplicates: pigeonhole blocks of fingerprints, Hamming verification, components."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrail.llm.common import attach_groups, cut, release, split_by_keys, written
from spendtrail.llm.components import connected_components

SEED = 42
SMALL_BUCKET = 16


BATCH = 256  # texts whose shingles a task holds at a time


def _some(batches):
    """Batches of up to BATCH rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of each run of ``words`` words, repeats included; fewer words: the whole sequence."""
    tokens = text.lower().split()  # on bytes: A-Z only, and splits on 0x20 and 0x09-0x0D
    if not tokens:
        return np.empty(0, np.uint64)
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words - 1 :] if len(tokens) > words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes; no hashes: zero."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; null and blank texts have the fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = [_signed(majority(shingle_hashes(x.as_py() or b"", words))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def fingerprint_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): links enough to connect all pairs of the distinct values ``fp`` that differ in ``distance`` bits or fewer.

    The 64 bits fall into ``distance + 3`` blocks; a close pair agrees on at least three of them, so all joins are on three
    blocks (38 bits at distance 2). Buckets of up to SMALL_BUCKET fingerprints are joined with themselves and the pairs'
    Hamming distance is verified. Within a larger bucket every fingerprint instead names all values that it reaches by
    flipping one of the bits outside the shared blocks, and itself: two that are close name a common value, so a link from
    each to the smallest that names it loses nothing and grows with the bucket, not with its square.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    parts = distance + 3
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in keep) for keep in combinations(range(parts), 3)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for i, m in enumerate(masks)])).alias("x"))
    keyed = keyed.select("fp", "x.k", "x.block")
    sizes = keyed.groupBy("k", "block").agg(F.count("*").alias("size"), F.min("fp").alias("least")).where("size > 1")
    met = cut(keyed.join(sizes, ["k", "block"]))

    small = met.where(F.col("size") <= SMALL_BUCKET)
    other = small.select("k", "block", F.col("fp").alias("b"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance
    pairs = small.join(other, ["k", "block"]).where((F.col("fp") < F.col("b")) & close).select(F.col("fp").alias("a"), "b")

    free = F.element_at(F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks]), F.col("k") + 1)
    named = met.where(F.col("size") > SMALL_BUCKET).select("fp", "k", "block", F.explode(F.array_append(F.transform(free, lambda bit: F.col("fp").bitwiseXOR(bit)), F.col("fp"))).alias("name"))
    hubs = named.groupBy("k", "block", "name").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    if distance == 1:  # namers of one value may be two bits apart, so they are linked to that value instead, if it is there
        hubs = met.select("k", "block", F.col("fp").alias("name"), F.col("fp").alias("b"))
    stars = named.join(hubs, ["k", "block", "name"])
    verified = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance
    stars = stars.where((F.col("fp") != F.col("b")) & verified).select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_dedup(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint: 16 lowercase hex digits; component_id: the smallest id reachable over links between fingerprints that
    differ in ``distance`` bits or fewer. Null and blank texts have the fingerprint zero and are linked like any other.
    Repeated rows each keep their row. No rows: no rows. Other columns are ignored.

    Copies collapse to their fingerprint before anything is joined, so groups of copies cost one row; components are found
    between distinct fingerprints and brought back to the rows.
    """
    rows = cut(fingerprints(docs, words, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    parts = connected_components(fingerprint_links(classes.select("fp"), distance))
    parts = classes.join(parts, classes.fp == parts.node, "left").select("fp", "first_id", "copies", F.coalesce("component", "fp").alias("component"))
    least = parts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = cut(parts.join(least, "component").select("fp", "copies", "component_id"))
    total = rows.count()
    out = attach_groups(rows, named, "fp", "copies", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _set_key(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


MAP_WORDS = 16  # 64-bit words of a parity map
WIDE_SHARE = 4  # bits of a wide map for each shingle, or up to twice as many
COMMON_SAMPLE = 10_000  # documents at least, in the sample that tells common shingles
COMMON_SHARE = 1 / 32  # of the documents, if those are more
COMMON_MOST = 500_000  # shingles whose rank tasks carry; it decides the cost alone, never the result
PRINT_BITS = 512  # of a set's wide fingerprint, about; what it misses is found exactly
SPARE_BITS = 3  # of a block beyond those that number the documents, so that few sets share a block by chance
PRINT_SD = 3  # standard deviations over the differing bits to expect, up to which a pair of fingerprints is near
SLACK = 1e-9  # of bounds computed in floating point


def parity_map(shingles: np.ndarray, words: int = MAP_WORDS) -> list[int]:
    """That many signed 64-bit words; each bit is the parity of the shingles that fall on it.

    A shingle in one set alone flips one bit, so two sets differ in at least as many shingles as their maps in bits. The halves
    of a map, one laid on the other by exclusive or, are the map of half as many words.
    """
    bits = np.bincount((shingles >> np.uint64(20)) % np.uint64(64 * words), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8").tolist()


def block_bits(documents: int) -> int:
    """Bits of a block of a wide fingerprint: they grow with the log of the documents, so blocks shared by chance don't pile up."""
    return min(60, max(12, max(1, documents).bit_length() + SPARE_BITS))


def wide_fingerprint(shingles: np.ndarray, width: int) -> list[int]:
    """A SimHash of about PRINT_BITS bits as blocks of ``width`` bits: each bit is set if it is in over half the shingles' hashes."""
    bits = []
    for i in range(1, -(-PRINT_BITS // 64) + 1):  # as many independent hashes of a shingle as 64 bits make up, by splitmix64
        h = shingles + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits.append(majority(h ^ (h >> np.uint64(31))))
    whole = sum(b << 64 * i for i, b in enumerate(bits))
    return [whole >> at & ((1 << width) - 1) for at in range(0, PRINT_BITS - width + 1, width)]


def print_distance(bits: int, similarity: float) -> int:
    """Bits in which fingerprints of sets of that Jaccard similarity differ at most, but for PRINT_SD standard deviations."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi  # the angle between the sets, or less, if sizes differ
    return math.ceil(bits * share + PRINT_SD * math.sqrt(bits * share * (1 - share)))


def wide_words(n: int) -> int:
    """Words of the wide map of a set of ``n``: a power of two, so that of two sets of sizes like 4 to 5 one's are the other's or
    twice as many."""
    return max(MAP_WORDS, 1 << max(0, math.ceil(math.log2(max(1, WIDE_SHARE * n) / 64))))


def rare_first(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in the order that all sets share: shingles not in ``common`` by hash, then those in it by rank."""
    if not len(common):
        return np.sort(shingles)
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    rank = np.where(common[at] == shingles, ranks[at], -1)
    return shingles[np.lexsort((shingles, rank))]


def prefix_length(n: int, similarity: float) -> int:
    """Two sets of that similarity share one of their first so many shingles in any common order."""
    return n - math.ceil(similarity * n - SLACK) + 1 if n else 0


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles met more than twice in a sample of ``docs`` (doc_id, text), and their ranks, the rarest first."""

    def read(batches):
        for batch in _some(batches):
            sets = [np.unique(shingle_hashes(text.as_py() or b"", words)).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], ["s"])

    share = max(COMMON_SHARE, COMMON_SAMPLE / max(docs.count(), 1))
    some = docs if share >= 1 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    met = some.mapInArrow(read, "s long").groupBy("s").agg(F.count("*").alias("c")).where("c > 2")
    got = met.orderBy(F.desc("c"), "s").limit(COMMON_MOST).toArrow()
    hashes, counts = got["s"].to_numpy().astype(np.int64).view(np.uint64), got["c"].to_numpy()
    ranks = np.empty(len(hashes), np.int64)
    ranks[np.lexsort((hashes, counts))] = np.arange(len(hashes))
    by = np.argsort(hashes)
    return hashes[by], ranks[by]


def alike(x: str, y: str, similarity: float) -> Column:
    """Whether two sets, as arrays without repeats, have Jaccard similarity ``similarity`` or more."""
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both) >= similarity


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", scratch: list[str] | None = None) -> DataFrame:
    """(doc_id, component_id) for every row: groups of documents linked by Jaccard similarity of their shingles.

    Documents link where their sets of distinct ``words``-word shingles have Jaccard similarity ``similarity`` or more; the
    components over all such links are exact. Equal sets collapse first. Then SimHash: each set's wide fingerprint is cut into
    blocks; of the sets that share a block each meets the least, so the pairs grow with the sets, not with a block's square.
    Fingerprints that differ in ``print_distance`` bits or fewer make a candidate, and links are those whose sets, counted, are
    similar. Their components leave few links to find, and these are found exactly: two sets that similar share a shingle among the
    first few of each (see ``prefix_length``) in any common order, here the rare first, so sets of different components with a
    common one meet and nothing else can link. A meeting is dropped only where it is proven too few shingles are common: by the
    sets' sizes and the shingle's places in them, or by the maps of ``parity_map``: first small ones, then for larger sets maps
    that grow with them, made from the texts of those that are left; the rest are counted on the sets themselves, read once more.
    Of buckets with the same members only the first in the order counts, as there any two of them meet first. Sizes, places and
    small maps are part of that join, so of its pairs only those near enough become rows. Null and blank texts are one group;
    texts of fewer words than ``words`` are one shingle. Very long texts have long sets, and a prefix of a fifth of them. Rows that
    repeat an id share a component. No rows: no rows. Other columns are ignored. Tables that it writes are named in ``scratch``;
    they may be released when the result was written.
    """
    spark, scratch = docs.sparkSession, [] if scratch is None else scratch
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    order = spark.sparkContext.broadcast(common_shingles(texts, words))
    width = block_bits(texts.count())

    def read(batches):
        for batch in _some(batches):
            sets = [np.unique(shingle_hashes(text.as_py() or b"", words)) for text in batch.column(1)]
            keys = pa.array([_set_key(s) for s in sets], pa.int64())
            first = [rare_first(s, *order.value)[: prefix_length(len(s), similarity)].view(np.int64) for s in sets]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (first, [parity_map(s) for s in sets], [wide_fingerprint(s, width) for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array(map(len, sets), pa.int32()), *lists], ["doc_id", "node", "n", "first", "map", "print"])

    def reading(name, value):
        def run(batches):
            for batch in _some(batches):
                sets = [np.unique(shingle_hashes(text.as_py() or b"", words)) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.int64()), pa.array([value(s) for s in sets], pa.list_(pa.int64()))], ["node", name])

        return run

    rows = written(texts.mapInArrow(read, "doc_id long, node long, n int, first array<long>, map array<long>, print array<long>"), scratch)
    order.unpersist()
    total = rows.count()
    whole = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), *[F.first(x).alias(x) for x in ("n", "first", "map", "print")])
    classes = written(whole, scratch)
    keyed = classes.select("node", "n", F.posexplode("first").alias("place", "key"))
    places = classes.agg(F.coalesce(F.sum(F.size("first")), F.lit(0))).first()[0]
    again = written(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), scratch)
    shared = written(split_by_keys(keyed, ["key"], again, scratch=scratch)[1], scratch)
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"members{i}") for i in range(2)]
    buckets = shared.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "place")).alias("least"), *members).where("size > 1")
    first = F.min(F.struct("least.place", "key")).alias("first")
    buckets = written(buckets.groupBy("size", "least.node", "members0", "members1").agg(first).select("first.key", "size"), scratch)
    met = written(attach_groups(split_by_keys(shared, ["key"], buckets.select("key"), scratch=scratch)[1], buckets, "key", "size", places), scratch)
    least = similarity / (1 + similarity)

    def possible(n: str, place: str, other_n: str, other_place: str) -> Column:
        return F.least(F.col(n) - F.col(place), F.col(other_n) - F.col(other_place)) >= least * (F.col(n) + F.col(other_n)) - SLACK

    sized = classes.select("node", "n", *[F.col("map")[i].alias(f"map{i}") for i in range(MAP_WORDS)])
    apart = sum((F.bit_count(F.col(f"map{i}_a").bitwiseXOR(F.col(f"map{i}_b"))) for i in range(MAP_WORDS)), F.lit(0))
    bound = (1 - 2 * least) * (F.col("n_a") + F.col("n_b")) + SLACK
    close = apart <= bound

    def of_nodes(pairs: DataFrame, name: str, value) -> DataFrame:
        """(node, name) for every set in the pairs, made from the text of one document that has it."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        asked = written(asked.join(classes.select("node", "first_id"), "node"), scratch)
        own = split_by_keys(texts, ["doc_id"], asked.select("first_id"), scratch=scratch)[1].mapInArrow(reading(name, value), f"node long, {name} array<long>")
        own = split_by_keys(own, ["node"], asked.select("node"), scratch=scratch)[1].join(asked, "node")
        return written(own.groupBy("node").agg(F.first(name).alias(name)), scratch)

    def beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
        return pairs.join(values.toDF("a", "x"), "a").join(values.toDF("b", "y"), "b")

    def linked(near: DataFrame) -> DataFrame:
        """Of the pairs (a, b, n_a, n_b) those that are similar, as (a, b)."""
        near = written(near.distinct(), scratch)
        large = (F.col("n_a") + F.col("n_b")) * WIDE_SHARE > 128 * MAP_WORDS  # for smaller sets no map is wider
        maps = of_nodes(near.where(large), "wide", lambda s: parity_map(s, wide_words(len(s))))
        half = lambda m: F.zip_with(F.slice(m, 1, (F.size(m) / 2).cast("int")), F.slice(m, (F.size(m) / 2).cast("int") + 1, (F.size(m) / 2).cast("int")), lambda v, w: v.bitwiseXOR(w))
        laid = beside(near.where(large), maps).withColumn("x", F.when(F.size("x") > F.size("y"), half("x")).otherwise(F.col("x"))).withColumn("y", F.when(F.size("y") > F.size("x"), half("y")).otherwise(F.col("y")))
        bits = F.aggregate(F.zip_with("x", "y", lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, n: total + n)
        laid = laid.where(bits <= bound).select("a", "b")
        left = written(near.where(~large).select("a", "b").unionByName(laid), scratch)
        sets = of_nodes(left, "shingles", lambda s: s.view(np.int64))
        return written(beside(left, sets).where(alike("x", "y", similarity)).select("a", "b"), scratch)

    blocks = classes.select("node", F.posexplode("print").alias("k", "block")).select("node", F.xxhash64("k", "block").alias("key"))
    again = written(blocks.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("b")).where("size > 1"), scratch)
    alike_blocks = split_by_keys(blocks, ["key"], again.select("key"), scratch=scratch)[1]
    near = attach_groups(alike_blocks, again, "key", "size", total * (PRINT_BITS // width)).where("node <> b").select("node", "b").distinct()
    prints = classes.select("node", "n", "print")
    near = near.join(prints.toDF("node", "n_a", "print_a"), "node").join(prints.toDF("b", "n_b", "print_b"), "b")
    bits = F.aggregate(F.zip_with("print_a", "print_b", lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, n: total + n)
    near = near.where(bits <= print_distance(PRINT_BITS // width * width, similarity))
    stars = linked(near.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"), "n_a", "n_b"))
    parts = written(connected_components(stars), scratch)
    placed = met.select("key", "node", "n", "place").distinct().join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    open_ = written(placed.join(mixed, "key").join(sized.drop("n"), "node"), scratch)
    one, two = (open_.select("key", *[F.col(c).alias(f"{c}_{x}") for c in open_.columns if c != "key"]) for x in "ab")
    cross = one.join(two, (one.key == two.key) & (F.col("part_a") < F.col("part_b")) & possible("n_a", "place_a", "n_b", "place_b") & close)
    rest = linked(cross.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b"))

    parts = connected_components(stars.union(rest))
    parts = classes.join(parts, "node", "left").select("node", "first_id", "copies", F.coalesce("component", "node").alias("component"))
    firsts = parts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = written(parts.join(firsts, "component").select("node", "copies", "component_id"), scratch)
    return attach_groups(rows.select("doc_id", "node"), named, "node", "copies", total).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, without the documents of which a group's document of smallest id stays.

    Groups are those of ``similar_groups``. Rows that repeat an id stay or go together; rows without an id stay; of null and
    blank texts one stays. No rows: no rows. Of the texts only those that may go are shuffled.
    """
    scratch = []
    gone = similar_groups(docs, words, similarity, id_col, text_col, scratch).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col))
    gone = written(gone.distinct())
    release(docs.sparkSession, scratch)
    stay, some = split_by_keys(docs.withColumn("__spendtrail_id", F.col(id_col).cast("long")), ["__spendtrail_id"], gone)
    some = some.join(gone.toDF("__spendtrail_id"), "__spendtrail_id", "left_anti")
    return stay.drop("__spendtrail_id").unionByName(some.drop("__spendtrail_id"))
