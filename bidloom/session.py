"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def spark_session(app: str = "bidloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where none is named, a purely local session (tests, one machine) gets a
    temporary one; a cluster is refused, since its machines would each write to
    a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="bidloom-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of texts that a Python worker is handed at once.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of some BATCH_BYTES at most; a session that names its own bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Intermediate tables of one job, written to the shared folder and read back."""

    #: Folders of all jobs of this process, in order, so that who runs several can clear those that are done.
    roots: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{job}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.roots.append(self.root)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """The table as written: later readers recompute nothing and need no executor of the writer."""
        where = self.path(name)
        df.write.partitionBy(*partition_by).parquet(where)
        # Shuffle files of a finished step go when the driver's garbage does; a long job must not wait for that to happen by itself.
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this job that nothing reads any more."""
        for table in tables:
            for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                if "/" + self.root.rsplit("/", 1)[1] + "/" in folder:
                    delete_folder(self.spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def empty_files(spark: SparkSession, folder: str) -> list[str]:
    """Files without a single byte below a folder: Spark's readers leave them out."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    walk, found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while walk.hasNext():
        status = walk.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            found.append(status.getPath().toString())
    return found


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for a plan, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Rows up to which a lookup side is built whole in the driver's memory.
BROADCAST_ROWS = 400_000


def broadcast_if_small(df: DataFrame, sized_by: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a lookup side only when the stored table it grows with has few rows; else both sides are sorted.

    A column file packs its rows far below what they take in memory, so its bytes say little.
    """
    return broadcast(df) if sized_by.count() <= limit else never_broadcast(df)


def hashed_if_large(df: DataFrame, sized_by: DataFrame) -> DataFrame:
    """A lookup side that the planner may broadcast while its table has few rows; else it is dealt out by key and hashed
    part by part, so that the other side is neither built in the driver nor sorted."""
    return df if sized_by.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def never_broadcast(df: DataFrame) -> DataFrame:
    """Joins with this side sort both, whatever the planner takes its size for: it cannot see through lists, explosions and packed files."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan enough tasks to use the cores there are.

    A table that arrives in many splits is left alone; only one that fits in a
    few splits (a small file) is redistributed, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if planned_bytes(df) > 256 << 20:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
