"""What several corpus operators share: lineage cuts, ASCII folding, joins that survive hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    One of our own is made only where none is named and all runs on one machine, as in tests.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="spendtrail-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Like ``cut``, as a Parquet table in the same folder: smaller than a checkpoint where rows are many.

    Its path is added to ``scratch``, so that ``release`` can delete it once nothing that is still to run reads it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, scratch: list[str]) -> None:
    """Delete the tables of ``scratch``, wherever they lie."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while scratch:
        path = jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null is empty.

    ``lower`` has a fast path for ASCII, where it equals this folding; other texts go through ``translate``.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one row a group, for keys of which one may hold most rows.

    Groups with more than ``total / share`` rows number fewer than ``share``, so that side is broadcast under a proven
    bound and their rows never meet in one task; all other keys take a shuffled join.
    """
    hot = groups.where(F.col(size) > total / share)
    cold = groups.where(F.col(size) <= total / share)
    spread = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return spread.unionByName(rest)


def attach_wide_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column, share: int = 1000, copies: int = 64) -> DataFrame:
    """Like ``attach_groups``, for groups whose columns are too wide to broadcast.

    The rows of a hot group, of which there are fewer than ``share``, are dealt by the hash ``spread`` among ``copies``
    copies of it; only the hot keys are broadcast.
    """
    is_hot = F.col(size) > max(total / share, copies)
    hot = groups.where(is_hot).select(key, F.lit(True).alias("hot_"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("salt_", F.when(F.col("hot_"), F.pmod(spread, F.lit(copies)).cast("int")).otherwise(0)).drop("hot_")
    held = groups.withColumn("salt_", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(held, [key, "salt_"]).drop("salt_")


PAGE_BITS = 32768  # bits in one page of Spark's bitmap functions


def bit_of(bitmap: Column, place: Column) -> Column:
    """Whether the bit at ``place`` within its page is set; False where there is no page."""
    at = place % PAGE_BITS
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False))


def split_by_keys(rows: DataFrame, cols: list[str], keys: DataFrame, most: int = 1 << 28, scratch: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``cols`` are certainly none of ``keys``, the others): nothing is shuffled.

    A bitmap of the keys' hashes is broadcast, 16 bits a key and at most ``most`` bits (32 MB). With more keys than that
    serves, more rows are among the others. ``keys`` has columns in the order of ``cols``.
    """
    bits, total = PAGE_BITS, keys.count()
    while bits < min(total * 16, most):
        bits *= 2

    def place(frame_cols):
        return F.pmod(F.xxhash64(*frame_cols), F.lit(bits))

    page, bitmap = "__spendtrail_page", "__spendtrail_bitmap"
    bit = keys.select(place(keys.columns).alias("bit"))
    pages = written(bit.groupBy(F.floor(F.col("bit") / PAGE_BITS).alias(page)).agg(F.bitmap_construct_agg(F.col("bit") % PAGE_BITS).alias(bitmap)), scratch)
    tested = rows.withColumn(page, F.floor(place(cols) / PAGE_BITS)).join(F.broadcast(pages), page, "left")
    among = bit_of(F.col(bitmap), place(cols))
    return tested.where(~among).drop(page, bitmap), tested.where(among).drop(page, bitmap)


def keep_where(docs: DataFrame, text_col: str, keep: Callable[[str | None], bool]) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text ``keep`` accepts: one pass, nothing is shuffled.

    Only texts go to Python, a hundred at a time as Spark pickles them, and only the answers come back; Arrow would hold
    whole rows on both sides, as many as the session's batch has, when the caller runs the plan.
    """
    return docs.where(F.udf(lambda text: bool(keep(text)), "boolean", useArrow=False)(F.col(text_col)))


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs send that many rows at most to a Python worker at a time; what the session had comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def give_back() -> None:
    """Give what this process has freed back to the system, where libc can: else it keeps what a fit took beside the driver's JVM."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table_key(df: DataFrame, column: str) -> str:
    """The column's name and type, as a schema string has them."""
    return f"`{column}` {df.schema[column].dataType.simpleString()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
