"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch. Spark's 64 MB are held several times over, by the JVM and by each Python worker.
BATCH = "8m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of ``BATCH``, unless the cluster's configuration has a size of its own."""
    if spark.sparkContext.getConf().get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, BATCH)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the cluster's ``spark.checkpoint.dir`` alone; set a folder only where none is set and one machine does everything (tests)."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared checkpoint folder, and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle and checkpoint files of steps that nothing refers to any more.

    Its cleaner waits for the driver to collect garbage, which a long chain of steps may never bring about.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives freed memory back to the system. A Python worker serves one step after the other; what each leaves with its allocators would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(rows: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: what a step's parts are counted by, so that they stay of one size however large the corpus is."""
    return rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_spread(rows: DataFrame, of: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """The inner join of ``rows`` with ``of`` (one row for each ``key``) in which no key is one task's alone.

    ``counts``: ``key`` and ``n``, the number of rows. Keys with more than an eighth of an even share of the rows are fewer than eight
    for each partition, so their part of ``of`` is broadcast and their rows stay where they are; the others are shuffled.
    """
    spark = rows.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") > max(256, total // (8 * partitions(spark)))).select(key))
    rest = rows.join(hot, key, "left_anti").join(of, key)
    return rest.unionByName(rows.join(hot, key, "left_semi").join(F.broadcast(of.join(hot, key, "left_semi")), key))


def partitions(spark: SparkSession) -> int:
    """The shuffle width the cluster is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: Column | str, mod: int) -> Column:
    """crc32 of a value's decimal text, modulo ``mod``; null for null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string").cast("binary")) % mod


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[bytes, int]]:
    """At most ``per_class`` labelled texts of each class, whole, as (UTF-8 bytes, label), in a repeatable order.

    The ids with the smallest hashes are taken, so the sample depends neither on row order nor on
    partitioning. Rows whose id or label is null don't count; an id labelled twice takes the larger label;
    an id with several texts gives its smallest one. The result is bounded by 2 * ``per_class`` rows.
    """
    small_batches(docs.sparkSession)
    ranked = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & keep)
    ranked = ranked.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    chosen = None
    for y in (0, 1):
        part = ranked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * per_class rows of two numbers: a proven bound, so a broadcast is safe at any size of the corpus.
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_y")
        .agg(F.min("_t").cast("binary").alias("_t"))
        .collect()
    )
    rows.sort(key=lambda r: (r["_id"]))
    got = [(bytes(r["_t"]), r["_y"]) for r in rows]
    del rows
    release(docs.sparkSession)  # training needs the driver's memory more than what the collection left behind
    return got
