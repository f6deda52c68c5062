"""The whole feature row of candidate pairs, assembled from the single features."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import strings as S
from lakeweave.functions import text as T
from lakeweave.operators import features

# Patterns of a name that is a domain, and of one that gives another name.
DOMAIN = r"(?i)(\.com|www\.|\.in\b|\.net|\.org|\.fr\b)"
ALIAS = r"(?i)\b(dba|d/b/a|d\.b\.a|formerly|f/k/a|fka|aka|a/k/a|known as|doing business as)\b"
NON_ASCII = r"[^\x00-\x7F]"

#: A spelt-out region's code in a normalised address.
STATE = r"\bzs[a-z]+\b"

#: Columns that are compared within a query.
CONTEXT = ["p_score", "n_tsr", "nw_cos", "aw_cq", "num_cq", "sk_cos", "n3_cos"]


def own(records: DataFrame) -> DataFrame:
    """What a pair's features need of one record. records: entity_id, country, name (as written), nc, sk, ab, ab_digest, num."""
    return records.select("entity_id", "country", *of_record(), *of_name())


def of_record() -> list[Column]:
    return [
        F.col("nc"), F.replace("nc", F.lit(" "), F.lit("")).alias("ncns"), F.col("sk"), F.col("ab_digest"), F.filter(F.split("num", " "), lambda x: x != "").alias("numbers"),
        T.first_match(F.col("ab"), STATE).alias("state"), (F.col("ab") == "").cast("int").alias("noaddr"),
    ]


def of_name() -> list[Column]:
    name, flag = F.col("name"), lambda c: c.cast("int")
    return [
        flag(name.rlike(NON_ASCII)).alias("nonascii"), flag(name.rlike(DOMAIN)).alias("domain"), flag(name.rlike(ALIAS)).alias("alias"),
        F.char_length(name).cast("long").alias("rawlen"),
    ]


def joined(cands: DataFrame, queries: DataFrame, references: DataFrame, similarities: bool = True) -> DataFrame:
    """Candidate pairs with what their own() records say of them, and both name cores as q_nc and s_nc."""
    d = references
    n = lambda c, to: d.groupBy("country", c).agg(F.count(F.lit(1)).alias(to))
    d = d.join(n("nc", "s_nc_dup"), ["country", "nc"]).join(n("ab_digest", "s_ab_dup"), ["country", "ab_digest"])
    shared = ("nc", "ncns", "sk", "numbers", "state", "rawlen")
    q = queries.select(F.col("entity_id").alias("rid"), *(F.col(c).alias(f"q_{c}") for c in (*shared, "nonascii", "domain", "alias", "noaddr")))
    d = d.select(F.col("entity_id").alias("s1"), *(F.col(c).alias(f"s_{c}") for c in shared), "s_nc_dup", "s_ab_dup")
    same = lambda c: (F.col(f"q_{c}") == F.col(f"s_{c}")).cast("int")
    out = cands.join(d, "s1").join(q, "rid").select(
        "rid", "s1", "p_score", "p_rank", "f_score", "f_rank", "q_nonascii", "q_domain", "q_alias", "q_rawlen", "s_rawlen", "q_noaddr", "s_nc_dup", "s_ab_dup",
        same("nc").alias("n_eq"), same("sk").alias("sk_eq"), same("ncns").alias("nns_eq"), same("state").alias("state_eq"),
        F.col("rid").startswith("S3").cast("int").alias("is_s3"), (F.col("f_rank") < 99).cast("int").alias("by_fallback"), (F.col("p_rank") < 99).cast("int").alias("by_primary"),
        *(v.alias(k) for k, v in features.number_relations(F.col("q_numbers"), F.col("s_numbers")).items()), "q_nc", "s_nc",
        *([S.similarities("q_nc", "s_nc").alias("alike")] if similarities else []),
    )
    return out.select("*", *(F.round(F.col("alike")[c], 6).alias(c) for c in S.SIMILARITIES)).drop("alike") if similarities else out


def with_overlaps(pairs: DataFrame, overlaps: DataFrame, odds: DataFrame) -> DataFrame:
    """The whole rows, from joined() and the overlaps and log odds of the same pairs."""
    out = pairs.drop("q_nc", "s_nc").join(overlaps, ["rid", "s1"], "left").join(odds, ["rid", "s1"], "left")
    # a pair of records that are not there has no tokens
    none = {c: 0 for c in overlaps.columns if c.endswith(("_ns", "_extra", "_miss", "_nq"))}
    return features.query_context(out.fillna(none), [c for c in CONTEXT if c in out.columns])


def pair_table(
    cands: DataFrame, queries: DataFrame, references: DataFrame, spaces: Mapping[str, tuple[Callable[[], Column], bool]], odds: DataFrame, similarities: bool = True
) -> DataFrame:
    """One row for each candidate pair (rid, s1, p_score, p_rank, f_score, f_rank) with all its features.

    queries, references: as own() takes them, and the columns that the spaces' tokens are made of. spaces: name -> (tokens,
    whether the query's number of them is a feature). odds: features.log_odds_features() of the pairs. The overlaps are
    taken over the bare pairs and joined by (rid, s1). Without similarities the columns of string similarities are missing.
    Missing values are null, flags 0 or 1.
    """
    pairs = joined(cands, own(queries), own(references), similarities)
    overlaps = features.overlaps_in_blocks(cands.select("rid", "s1"), queries, references, {name: (tokens(), with_nq) for name, (tokens, with_nq) in spaces.items()})
    return with_overlaps(pairs, overlaps, odds)
