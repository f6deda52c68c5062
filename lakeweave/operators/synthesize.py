"""Synthetic decoys: near copies of true records with another number, all choices by md5 of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions import text as T


def draw(key: Column, salt: str, below: int) -> Column:
    """A number in [0, below) that depends on key and salt alone; md5, so that other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("bigint") % below


def new_number(number: Column, key: Column) -> Column:
    """Seven times in ten (always for one digit) the number moved by 1 to 20, up where it would not stay positive;
    else its last digit changed."""
    step = draw(key, "step", 20) + 1
    moved = F.when((draw(key, "sign", 2) == 0) | (number <= step), number + step).otherwise(number - step)
    digit = number - number % 10 + (number % 10 + 1 + draw(key, "digit", 9)) % 10
    return F.when((draw(key, "kind", 10) < 7) | (number < 10), moved).otherwise(digit)


def decoys(records: DataFrame, key: str, number: str, percent: int = 55, base: int = 9_000_000_000, folds: int = 40) -> DataFrame:
    """(key, decoy_id, kind, number, decoy_number) for `percent` of the records; an id keeps its parent's fold."""
    k = F.col(key)
    kind = F.when(draw(k, "variant", 100) < 60, "num").when(draw(k, "variant", 100) < 85, "num+legal").otherwise("num+word")
    rows = records.filter(draw(k, "pick", 100) < percent)
    return rows.select(k.alias(key), (F.lit(base) + k * folds + k % folds).alias("decoy_id"), kind.alias("kind"), F.col(number).alias(number), new_number(F.col(number), k).alias("decoy_number"))


# Legal forms that a decoy may take, by country, and those that it loses.
LEGAL_FORMS = {
    "US": ["llc", "inc", "corp", "pc", "pllc", "ltd", "co", "lp", "llp"],
    "India": ["private limited", "limited", "llp", "pvt ltd", "ltd"],
}
LOST_FORMS = r"\b(llc|l l c|inc|incorporated|corp|corporation|co|company|ltd|limited|pvt|private|llp|lp|plc|pc|pllc)\b"
WORD_BUCKETS = 1000


def decoy_records(references: DataFrame, records: DataFrame, truth: DataFrame, percent: int = 55, folds: int = 40, upto: int = 6, base: int = 9_000_000_000) -> DataFrame:
    """Businesses that look like a reference and are none: of `percent` of the references in the first `upto` folds, one to
    three true records are copied with one number changed alike, some also with another legal form or another word.

    references: entity_id, country, nc, ab; records: the same and nb, src; truth: s1, rid. Returns entity_id, country, src,
    nb, nc, ab, parent_s1, kind, old and new number. The number is the reference's longest one (then the least as text)
    that a chosen record has; records without it are left out. An id is base + the record's own number * folds + the
    parent's fold. All choices are by md5 of ids.
    """
    number_of = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("bigint")
    s1 = F.col("s1")
    refs = references.select(F.col("entity_id").alias("s1"), "country", T.numbers(F.col("ab")).alias("nums"), (number_of(F.col("entity_id")) % folds).alias("fold"))
    refs = refs.filter((F.col("fold") < upto) & (F.size("nums") > 0) & (draw(s1, "pick", 100) < percent))
    size = F.when(draw(s1, "size", 10) < 3, 1).when(draw(s1, "size", 10) < 7, 2).otherwise(3)
    own = records.select(F.col("entity_id").alias("rid"), "src", "nb", "nc", "ab")
    members = refs.select("s1", "country", "fold").join(truth.select("s1", "rid"), "s1").join(own, "rid")
    turn = Window.partitionBy("s1").orderBy(F.md5(F.concat("rid", F.lit("turn"))), "rid")
    members = members.withColumn("r", F.row_number().over(turn)).filter(F.col("r") <= size)
    has = members.select("s1", F.explode(F.array_distinct(T.numbers(F.col("ab")))).alias("t")).distinct()
    longest = refs.select("s1", F.explode(F.array_distinct("nums")).alias("t")).filter(F.char_length("t") <= 15).join(has, ["s1", "t"])
    chosen = longest.groupBy("s1").agg(F.min(F.struct((-F.char_length("t")).alias("l"), "t"))["t"].alias("old"))
    words = references.select(F.explode(F.split("nc", " ")).alias("word")).filter(F.char_length("word") >= 4).distinct()
    words = words.groupBy(draw(F.col("word"), "bucket", WORD_BUCKETS).alias("b")).agg(F.min("word").alias("word"))
    rows = members.join(chosen, "s1").withColumn("b", draw(s1, "word", WORD_BUCKETS)).join(words, "b", "left")
    parts = F.split("ab", " ")
    rows = rows.withColumn("at", F.array_position(parts, F.col("old"))).filter("at > 0")
    rows = rows.withColumns({"new": new_number(F.col("old").cast("bigint"), s1).cast("string"), "kind": F.when(draw(s1, "variant", 100) < 60, "num").when(draw(s1, "variant", 100) < 85, "num+legal").otherwise("num+word")})
    ab = F.array_join(F.transform(parts, lambda w, i: F.when(i + 1 == F.col("at"), F.col("new")).otherwise(w)), " ")
    forms = None
    for country, names in LEGAL_FORMS.items():
        one = F.element_at(F.array(*map(F.lit, names)), (draw(s1, "legal", len(names)) + 1).cast("int"))
        forms = F.when(F.col("country") == country, one) if forms is None else forms.when(F.col("country") == country, one)
    usual = LEGAL_FORMS["US"]
    forms = forms.otherwise(F.element_at(F.array(*map(F.lit, usual)), (draw(s1, "legal", len(usual)) + 1).cast("int")))
    legal = F.concat_ws(" ", T.squeeze(F.regexp_replace("nb", LOST_FORMS, " ")), forms)
    core = F.split("nc", " ")
    other = F.array_join(F.transform(core, lambda w, i: F.when(i == draw(F.col("rid"), "place", 1 << 20) % F.size(core), F.coalesce("word", w)).otherwise(w)), " ")
    nb = F.when(F.col("kind") == "num+legal", legal).when(F.col("kind") == "num+word", other).otherwise(F.col("nb"))
    entity = F.concat(F.substring("rid", 1, 3), (F.lit(base) + number_of(F.col("rid")) * folds + F.col("fold")).cast("string"))
    out = rows.select(entity.alias("entity_id"), "country", F.concat(F.lower("src"), F.lit("syn")).alias("src"), nb.alias("nb"), ab.alias("ab"), F.col("s1").alias("parent_s1"), "kind", "old", "new")
    return out.withColumn("nc", T.name_core(F.col("nb")))


def random_negatives(left: DataFrame, right: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs (s1, rid) laid side by side by their number k, without those that happen to be true."""
    return left.join(right, "k").select("s1", "rid").join(truth.select("s1", "rid"), ["s1", "rid"], "left_anti")
