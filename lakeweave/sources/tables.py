"""Readers and writers: unquoted TSV, parquet by partition, CSV reports, stage tables, manifests."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a source, and of its ground truth.
RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """All strings by a given schema, no quoting, an empty field is null."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def row_count_check(spark: SparkSession, path: str, df: DataFrame) -> tuple[int, int]:
    """(lines below the headers, rows read); they should be equal. One header for each file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files")).first()
    return lines["n"] - lines["files"], df.count()


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several parquet tables of one schema as one."""
    return spark.read.parquet(*paths)


def write_lists(df: DataFrame, path: str, buckets: int, key: str) -> None:
    """Rows dealt by a hash of the key to as many files, sorted by it; what stood at the path is replaced as a whole when
    the job commits."""
    df.repartition(buckets, F.col(key)).sortWithinPartitions(key).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("country", "src")) -> None:
    """One folder for each value; writing one country again replaces that country only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if a run has completed it, else made and written now. The committer's marker tells."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The table; one whose files cannot be split among all cores (few files, few row groups) is dealt out once, which a
    table of many files never is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one only for a session that
    is one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/lakeweave-stages"


def version(spark: SparkSession, path: str) -> str:
    """A digest of a table's files, their lengths and times: what is derived from it holds as long as that does."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return hashlib.sha256("\n".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)).encode()).hexdigest()[:24]


def derived(spark: SparkSession, table: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made from another one, made once for each application and version of that."""
    return stage(spark, f"{shared_dir(spark)}/derived-{spark.sparkContext.applicationId}/{version(spark, table)}/{name}", make)


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1, rid, src) from comma lists; references without any match have no row."""
    rid = F.explode(F.split("matched_entity_ids", ","))
    return truth.filter("matched_entity_ids is not null").select(F.col("source1_entity_id").alias("s1"), rid.alias("rid")).withColumn("src", F.substring("rid", 1, 2))


def manifest(spark: SparkSession, path: str, entry: dict) -> DataFrame:
    """Appends one JSON line with the next version number and returns all of them."""
    old = spark.read.json(path) if exists(spark, path) else None
    version = (old.agg(F.max("version")).first()[0] or 0) + 1 if old is not None else 1
    spark.createDataFrame([(json.dumps({"version": version, **entry}),)], "value string").coalesce(1).write.mode("append").text(path)
    return spark.read.json(path)


def sample(df: DataFrame, key: Column, percent: int) -> DataFrame:
    """The same rows each time: by a hash of the key."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(100)) < percent)


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, least, quartiles and most of every column."""
    return df.summary()


def check_file(spark: SparkSession, path: str, header: Sequence[str]) -> DataFrame:
    """(rule, severity, n) of a result file before its rows are read: a header with commas or other names is an error, and
    so is each row without a tab; an empty file has no header."""
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    top = first[0]["value"].rstrip("\r") if first else ""
    right = "\t".join(header)
    comma = "\t" not in top and "," in top
    rows = lines.filter((F.trim("value") != "") & ~F.contains("value", F.lit("\t"))).count()
    rows -= int("\t" not in top and top.strip() != "")
    found = [("header_has_commas", int(comma)), ("wrong_header", int(top != right)), ("row_without_tab", rows)]
    return spark.createDataFrame([(rule, "error", n) for rule, n in found], "rule string, severity string, n long")
