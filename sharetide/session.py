"""Session defaults for local runs, and the shared work folder used to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# A generated method above the JVM's 8000-byte limit is never compiled to machine code.  Spark
# then does better with one method per expression, which this threshold makes it choose.
# A join too large for a broadcast hashes its smaller side where each of that side's shuffled partitions, whose size is
# measured by then, is under this limit; wide rows are then not sorted.
SQL_DEFAULTS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}


def apply_sql_defaults(spark: SparkSession) -> SparkSession:
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "sharetide", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", extra.pop("driver_memory", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return apply_sql_defaults(builder.getOrCreate())


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A configuration value that holds inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder under the one that every executor can reach.

    The root is ``spark.checkpoint.dir``, else the context's checkpoint directory.  Where both are unset a
    temporary folder serves sessions whose tasks all run on this machine; any other session fails, as
    a folder of one machine would be out of reach for the rest.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("sharetide.local.folder", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sharetide-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("sharetide.local.folder", root)
    return f"{root.rstrip('/')}/sharetide-{spark.sparkContext.applicationId}"


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def clear_stages(spark: SparkSession) -> None:
    """Remove everything this application has staged; its owner calls it when the results are stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# A partitioned write of a few values keeps a file open for each and leaves the rows unsorted; more values are sorted as ever.
FEW_WRITERS = ("spark.sql.maxConcurrentOutputFileWriters", "4")
# What a write has shuffled is removed when it ends, and not when the driver happens to collect its garbage.
FREED_SHUFFLES = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stage(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, keeps column pruning, and gives the
    planner the true size, so its broadcast decisions rest on a measured number.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with setting(spark, *FEW_WRITERS), setting(spark, *FREED_SHUFFLES):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


# The rows of a large input are worked off in slices, so that shuffles and work tables hold one slice at a time: one for so
# many bytes of the files that are read, and at most so many.  Input that is not read from files has no known size and counts as none.
SLICE_BYTES, MOST_SLICES = 32 << 20, 16
SLICE = "_slice"


def slice_count(*parts: DataFrame) -> int:
    """How many slices the files behind ``parts``, which are parts of one table, call for."""
    sizes = []
    for leaves in (p._jdf.queryExecution().optimizedPlan().collectLeaves() for p in parts):
        known = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        sizes.append(sum(n for n in known if n < 1 << 62))
    return max(1, min(MOST_SLICES, -(-max(sizes) // SLICE_BYTES)))


def slice_of(slices: int, *keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")


class SlicedTable:
    """A staged table of which every slice has a folder of its own, so that each can be read and removed alone."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.schema, self.known = spark, fresh_path(spark, label), None, []

    def _write(self, df: DataFrame, path: str, partition_by: Sequence[str], writers: int) -> None:
        self.schema = self.schema or df.drop(SLICE).schema
        writer = df.write.mode("append").option("compression", "zstd")
        with setting(self.spark, FEW_WRITERS[0], str(writers)), setting(self.spark, *FREED_SHUFFLES):
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

    def deal(self, df: DataFrame, slices: int, *keys: Column | str) -> None:
        """Add rows, dealt into slices by ``keys``."""
        self._write(df.withColumn(SLICE, slice_of(slices, *keys)), self.path, [SLICE], slices)
        self.known = [i for i in range(slices) if path_exists(self.spark, self._folder(i))]

    def add(self, df: DataFrame, *partition_by: str) -> None:
        """Add a slice."""
        self._write(df, self._folder(len(self.known)), partition_by, int(FEW_WRITERS[1]))
        self.known.append(len(self.known))

    def _folder(self, i: int) -> str:
        return f"{self.path}/{SLICE}={i}"

    def _table(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path).select(*self.schema.names)

    def slices(self) -> list[DataFrame]:
        """The slices that have rows; of a table without any, one that is empty."""
        return [self._table(self._folder(i)) for i in self.known] or [self.read()]

    def read(self) -> DataFrame:
        return self._table(self.path)


def slices_read(df: DataFrame) -> list[DataFrame]:
    """A table read from a :class:`SlicedTable`, slice by slice; any other table as its only slice."""
    folders = sorted({m[0] for f in df.inputFiles() if (m := re.match(rf".*/{SLICE}=\d+(?=/)", f))})
    return [df.sparkSession.read.schema(df.schema).parquet(f).select(*df.columns) for f in folders] or [df]


def discard(df: DataFrame) -> None:
    """Remove what was staged of ``df``, a table that nothing reads any more; of a sliced table the slices that ``df`` reads."""
    where, files = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path, df.inputFiles()
    mark = re.escape(shared_folder(df.sparkSession).rsplit("/", 1)[1])
    for folder in {m[0] for f in files if (m := re.match(rf".*?{mark}/[^/]+(/{SLICE}=\d+)?(?=/)", f))}:
        path = where(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over all shuffle partitions, ahead of costly per-group work.

    Adaptive execution sizes partitions by bytes and would merge small groups into one task; a
    partition count given by hand is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
