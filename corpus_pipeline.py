"""From raw documents to token ids: five stages, each on all that the one before it kept.

run() writes what a stage returns to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import bpe, minhash, mixing, substring, toxicity
from lakeweave.llm.common import Stages, col, table, without
from lakeweave.llm.queries import RANKS, mixing_labels, toxicity_chain

#: Target shares of expected tokens by language; no document is taken less than once.
MIX = {"en": 0.52, "de": 0.17, "fr": 0.17, "es": 0.14}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go.

    Null and empty texts have no words and are judged by that; repeated rows alike; a probability right at the threshold
    goes; an empty table stays empty; other columns stay whatever their names. Texts are read whole.
    """
    return toxicity.reject(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays.

    Documents without an id stay, as do null and empty texts, which link with nothing. Of rows of one id one stays: of
    equal rows any, of different texts the least by its hash. An empty table stays empty; other columns stay.
    """
    kept = minhash.near_duplicates(docs, size=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi")
    several = one.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    first = one.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*(col(c) for c in docs.columns)), F.xxhash64("text")).alias("row"))
    rows = one.join(several, "doc_id", "left_anti").select(*(col(c) for c in docs.columns))
    rows = rows.unionByName(first.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
    return rows.unionByName(docs.filter("doc_id is null"))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentence spans are cut out of all texts but the first; n_chars follows, texts with nothing left go.

    Null and empty texts stay as they are. Repeated rows count as one document and keep the same text; first is by id
    (nulls last), then by place. An empty table stays empty; other columns stay whatever their names.
    """
    out = substring.deduplicate(docs)
    out = out.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*(length.alias(c) if c == "n_chars" else col(c) for c in docs.columns))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated at the fitted rates, so that expected tokens by language come to MIX.

    No document is taken less than once. A null or empty text has no tokens and the rate of the prior; rows of equal id
    and text are taken equally often, which a hash of both decides; without labels, or of an empty table, every row is
    taken once. Other columns stay, also where their names begin as the operator's own do.
    """
    rows, _, _ = mixing.mix(docs, mixing_labels(docs, table(spark, sf_dir, "labels"), low=False), MIX, least=1.0)
    return mixing.take(rows, mixing.prefix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their count and digests; the text itself has served.

    A null or empty text has no tokens; every row stays, repeated rows with equal ids; an empty table stays empty;
    columns of the new names are replaced, others stay.
    """
    return without(bpe.encode(docs, vocab.path(RANKS), vocab.PATTERN, keep_memo=False), "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", drop_repeated_spans),
    ("mixing", mix_languages),
    ("encoding", encode),
]

#: A trained classifier, an iterative fit and byte-pair merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages, docs = Stages(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out = stages.put(stage(spark, docs, sf_dir))
        stages.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
