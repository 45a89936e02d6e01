"""Helpers shared by the operators for training data."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of an Arrow batch are handed on in slices of about so many bytes, or one row.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or that of the context.

    Where neither is set, a session on this machine alone gets a temporary folder of its own; on a cluster that is an
    error, as executors would write to folders that the others can't see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches where the session has Spark's defaults, as rows here hold whole texts.

    They bound what JVM and Python workers hold at a time; a value that somebody else has set stays.
    """
    for name, default, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "2MB")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
    return spark


_OPEN = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are stored within the block are deleted at its end, but those that outlive it.

    What is made from them within must be stored, too, before the end.
    """
    blocks = _OPEN.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for path, system in blocks.pop():
            system.delete(path, True)


def stored(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    The table survives lost executors and is deleted at the end of the scratch() block around, which with `outlive` is
    the second one, and at the latest when the session's JVM ends. Spark deletes the shuffle files of a finished write
    only when the driver collects garbage, which at these sizes it seldom does by itself; so it is asked to, lest each
    step's files stay beside the next one's. Its setting for this leaves out the shuffles of writes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(jpath)
    blocks = getattr(_OPEN, "blocks", [])[: -1 if outlive else None]
    if blocks:
        blocks[-1].append((jpath, system))
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run fn on slices of about SLICE_BYTES of each Arrow batch; nothing is kept from one to the next but caches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, min(4096, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


#: Tables of at most so many bytes may be sent to every executor.
BROADCAST_BYTES = 32 << 20


def fits(size: int) -> bool:
    """Whether a measured size may be broadcast."""
    return size <= BROADCAST_BYTES


def join_measured(large: DataFrame, small: DataFrame, on: str, how: str, row_bytes: int | Column) -> DataFrame:
    """Join with a stored table: broadcast if its measured rows take at most BROADCAST_BYTES, else by shuffles."""
    size = small.count() * row_bytes if isinstance(row_bytes, int) else small.agg(F.sum(row_bytes)).first()[0] or 0
    return large.join(F.broadcast(small) if fits(size) else small.hint("merge"), on, how)


def join_spread(large: DataFrame, small: DataFrame, on: list[str], times: str, hot: int = 1000) -> DataFrame:
    """Inner join of two stored tables, of which small has each key once with how many rows of large it meets.

    Keys that meet more than one in `hot` of all these rows are fewer than `hot`: they are broadcast, so their rows stay
    where they are. All others are joined by a shuffle in which no key has more than that share.
    """
    total = small.agg(F.sum(times)).first()[0] or 0
    heavy = small.where(F.col(times) * hot > total)
    direct = large.join(F.broadcast(heavy), on)
    others = large.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(small.where(F.col(times) * hot <= total).hint("merge"), on)
    return direct.unionByName(others)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def placed(df: DataFrame, name: str) -> DataFrame:
    """stored() with a long column _seq: a number for each row, consecutive within what one task wrote."""
    return stored(df.withColumn("_seq", F.monotonically_increasing_id()), name)


def number_within(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the rows of each key 0, 1, ... in the order of _seq of a placed() table, which is dropped.

    Rows are numbered in runs of at most 2 ** 20 that one task wrote, and moved up by the sizes of the key's earlier
    runs. So no key is gathered in one task, however many rows it has and however equal they are. Keys must not be null.
    """
    df = df.withColumn("_run", F.shiftright("_seq", 20))
    by = [*keys, "_run"]
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("_seq")) - 1)
    return within.join(sizes, by).withColumn(name, F.col("_before") + F.col("_rn")).drop("_before", "_rn", "_run", "_seq")
