"""Learns a dictionary from folded foreign words to reference words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions import text as T


def align(pairs: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """(tok, eng, n, share) from pairs (a, b) of names with equally many words, aligned by position; equal words drop
    out, and of each word's counterparts the most frequent stays if frequent enough."""
    words = pairs.select(F.split("a", " ").alias("x"), F.split("b", " ").alias("y")).filter(F.size("x") == F.size("y"))
    rows = words.select(F.explode(F.arrays_zip("x", "y")).alias("z")).select(F.col("z.x").alias("tok"), F.col("z.y").alias("eng")).filter("tok <> eng and tok <> '' and eng <> ''")
    n = rows.groupBy("tok", "eng").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tok")), 6))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("tok").orderBy(F.desc("n"), "eng")))
    return best.filter((F.col("r") == 1) & (F.col("n") >= least) & (F.col("share") >= share)).drop("r")


def fill_by_skeleton(words: DataFrame, references: DataFrame, known: DataFrame, least: int = 5) -> DataFrame:
    """(tok, eng) for words (tok) that `known` (tok) lacks: the most frequent reference word of the same skeleton."""
    skel = lambda c: T.skeleton_word(F.col(c))
    counted = references.groupBy("eng").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & F.col("eng").rlike("^[a-z]{3,}$"))
    best = counted.withColumn("sk", skel("eng")).withColumn("r", F.row_number().over(Window.partitionBy("sk").orderBy(F.desc("n"), "eng"))).filter("r = 1")
    new = words.select("tok").distinct().join(known.select("tok"), "tok", "left_anti").withColumn("sk", skel("tok")).filter(F.char_length("sk") >= 3)
    return new.join(best.select("sk", "eng"), "sk").filter("tok <> eng").select("tok", "eng")


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both layers, the first one's entry where both have one."""
    rows = first.select("tok", "eng", F.lit(1).alias("layer")).unionByName(second.select("tok", "eng", F.lit(2).alias("layer")))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("tok").orderBy("layer", "eng"))).filter("r = 1").drop("r")


def coverage(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    hit = words.join(dictionary.select("tok", F.lit(1.0).alias("hit")), "tok", "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("covered"))


def names(records: DataFrame, raw: str, key: str, dictionary: DataFrame, into: str = "nb") -> DataFrame:
    """Adds the normalised name: all scripts folded, look-alike digits mended, and in names that are not ASCII each word
    replaced by its entry in the learned dictionary (tok, eng). Only words of such names take part in the join; key tells
    records apart."""
    other = F.coalesce(F.col(raw).rlike(r"[^\x00-\x7F]"), F.lit(False))
    plain = T.unleet(T.basic(F.col(raw)))
    foreign = records.filter(other).withColumn(into, T.unleet(T.basic(T.fold(F.col(raw)), folded=True)))
    words = foreign.select(key, F.posexplode(F.split(into, " ")).alias("pos", "tok")).join(dictionary.select("tok", "eng"), "tok", "left")
    words = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("eng", "tok").alias("w")))).alias("ws"))
    learned = words.select(key, F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias(into))
    return records.filter(~other).withColumn(into, plain).unionByName(foreign.drop(into).join(learned, key))


def native_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs (raw, a, b) those whose raw name is not ASCII: what a dictionary may be learned from."""
    return pairs.filter(F.col("raw").rlike(r"[^\x00-\x7F]"))
