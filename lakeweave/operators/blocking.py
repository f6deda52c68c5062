"""Key-based blocking and its quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions import text as T


def document_frequency(records: DataFrame, column: str) -> DataFrame:
    return records.select("country", F.explode(T.tokens(F.col(column))).alias("t")).groupBy("country", "t").agg(F.count(F.lit(1)).alias("df"))


def exact_keys(records: DataFrame, key: Column) -> DataFrame:
    return records.select("entity_id", "country", "src", key.alias("key")).filter("key is not null and key <> ''")


def rare_keys(records: DataFrame, column: str, k: int, alphabetic: bool = False) -> DataFrame:
    """Each record's k rarest tokens that others of its country share, as keys."""
    rows = records.select("entity_id", "country", "src", F.explode(T.tokens(F.col(column))).alias("t"))
    if alphabetic:
        rows = rows.filter(F.col("t").rlike("^[a-z]+$"))
    rows = rows.join(document_frequency(records, column).filter("df >= 2"), ["country", "t"])
    best = Window.partitionBy("entity_id").orderBy("df", "t")
    return rows.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("entity_id", "country", "src", F.col("t").alias("key"))


def compound_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select("entity_id", F.col("key").alias("other"))
    return a.join(b, "entity_id").select("entity_id", "country", "src", F.concat_ws("|", "key", "other").alias("key"))


def pairs(keys: DataFrame) -> DataFrame:
    """Distinct (s1, rid) that share a key; references have src S1."""
    s = keys.filter("src = 'S1'").select("country", "key", F.col("entity_id").alias("s1"))
    r = keys.filter("src <> 'S1'").select("country", "key", F.col("entity_id").alias("rid"))
    return s.join(r, ["country", "key"]).select("s1", "rid").distinct()


def quality(keys: DataFrame, truth: DataFrame) -> DataFrame:
    """Recall over true pairs (s1, rid), candidates, the bound on them by block sizes, and the reduction ratio.

    The bound and the ratio come from block sizes; no pair is formed for them.
    """
    sizes = keys.dropDuplicates(["country", "key", "entity_id"]).groupBy("country", "key").agg(F.count_if(F.col("src") == "S1").alias("s"), F.count_if(F.col("src") != "S1").alias("r"))
    bound = sizes.agg(F.sum(F.col("s") * F.col("r")).alias("bound"))
    all_ = keys.select("country", "entity_id", "src").distinct().groupBy("country").agg((F.count_if(F.col("src") == "S1") * F.count_if(F.col("src") != "S1")).alias("p")).agg(F.sum("p").alias("possible"))
    rid = keys.select(F.col("entity_id").alias("rid"), "country", "key")
    s1 = keys.select(F.col("entity_id").alias("s1"), "country", "key")
    hit = truth.join(s1, "s1").join(rid, ["rid", "country", "key"]).select("s1", "rid").distinct()
    found = truth.join(hit.withColumn("hit", F.lit(1.0)), ["s1", "rid"], "left").agg(F.count(F.lit(1)).alias("n_true"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))
    return found.crossJoin(bound).crossJoin(all_).withColumn("reduction", F.round(1 - F.col("bound") / F.col("possible"), 6))  # three single rows


def candidate_quantiles(keys: DataFrame) -> DataFrame:
    """(n, mean, median, p95, most): candidates of a reference, counted as key mates from block sizes; no pair is formed.
    A record that shares several keys counts for each."""
    sizes = keys.dropDuplicates(["country", "key", "entity_id"]).groupBy("country", "key").agg(F.count_if(F.col("src") != "S1").alias("r"))
    mine = keys.filter("src = 'S1'").select("country", "key", "entity_id").distinct().join(sizes, ["country", "key"]).groupBy("entity_id").agg(F.sum("r").alias("c"))
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by c)").cast("long")
    return mine.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean"), disc(0.5).alias("median"), disc(0.95).alias("p95"), F.max("c").alias("most"))


def recall_by_source(keys: DataFrame, truth: DataFrame) -> DataFrame:
    """(src, n_true, recall): true pairs (s1, rid) that share a key, by the source of the record."""
    rid = keys.select(F.col("entity_id").alias("rid"), "country", "key")
    s1 = keys.select(F.col("entity_id").alias("s1"), "country", "key")
    hit = truth.join(s1, "s1").join(rid, ["rid", "country", "key"]).select("s1", "rid").distinct().withColumn("hit", F.lit(1.0))
    found = truth.join(hit, ["s1", "rid"], "left").withColumn("src", F.substring("rid", 1, 2))
    return found.groupBy("src").agg(F.count(F.lit(1)).alias("n_true"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))
