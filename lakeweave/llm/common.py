"""What the corpus operators share: reading tables, stage tables, word patterns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space and \t \n \v \f \r. Everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose files cannot be split among all cores (few files, few row groups) is dealt out once, which a
    table of many files never is."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a temporary one, but only for a
    session within one process: executors on other machines would not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/lakeweave-stages"


def col(name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each lengthened until no column of the frame has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without the columns of these names, in any case: new columns replace them."""
    gone = {n.lower() for n in names}
    return df.select(*(col(c) for c in df.columns if c.lower() not in gone)) if any(c.lower() in gone for c in df.columns) else df


def small_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: Arrow batches of Spark's default length would hold tens of MB on either side. A
    length that the session sets itself stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def release() -> None:
    """Gives free memory back to the system at the end of a Python task: workers live on, and what each keeps adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library of other systems may lack it
        ctypes.CDLL(None).malloc_trim(0)


class Stages:
    """Intermediate tables in the shared folder. They cut lineage: a lost executor costs its running tasks only.

    put() writes a frame and returns the table read back; drop() removes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.top, self.n, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, {}

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            if path := self.paths.pop(id(df), None):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def null_last(column: str):
    """Sort key that puts null ids after all others."""
    return F.struct(F.col(column).isNull().alias("z"), F.col(column).alias("v"))
