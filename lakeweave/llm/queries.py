"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import bpe, html, langid, media, minhash, mixing, quality, substring, toxicity, urls
from lakeweave.llm.common import Stages, table

PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


#: Target shares of expected tokens. Documents labelled as of low quality are a domain of their own, else the language.
MIX = {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.12, "low": 0.02}


def mixing_labels(docs: DataFrame, labels: DataFrame, low: bool = True) -> DataFrame:
    """(key, domain) of the labelled documents; repeated labels of a document count once, the worst of them. low: those
    of low quality are a domain of their own."""
    worst = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    named = docs.select("doc_id", "lang").join(worst, "doc_id")
    domain = F.when(F.col("quality") == 0, F.lit("low")).otherwise(F.col("lang")) if low else F.col("lang")
    return named.select(F.col("doc_id").alias("key"), domain.alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", "text")
    rows, domains, _ = mixing.mix(texts, mixing_labels(docs, table(spark, sf_dir, "labels")), MIX, with_text=False)
    own = mixing.prefix(texts)
    posteriors = (F.round(f"{own}p{i}", 6).alias(f"p_{d}") for i, d in enumerate(domains))
    return rows.select("doc_id", F.col(f"{own}n_tokens").alias("n_tokens"), F.round(f"{own}rate", 6).alias("rate"), *posteriors)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", "text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocab.path(RANKS), vocab.PATTERN, keep_ids=False).drop("text")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), vocab.path(PIECES), vocab.path(RANKS))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~langid.held_out())
    scored = langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no audio in the tables; each embedding is rendered as a recording of 64 notes. One row for each vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    prints = Stages(spark, "prints").put(media.fingerprints(vectors, F.col("embedding"), read=media.render).select("vec_id", "fingerprint"))
    return media.group(prints).withColumn("bit_error_rate", F.round("bit_error_rate", 6))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return html.extract(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


#: The chain of op9: texts of low quality, then toxic texts.
CATEGORIES = ("low_quality", "toxic")


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.train(docs, labels, CATEGORIES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity_chain(docs, table(spark, sf_dir, "labels"))
    out = toxicity.predict(docs.select("doc_id", "text"), chain)
    return out.select("doc_id", *(F.round(f"toxicity.{c}", 6).alias(f"p_{c}") for c in CATEGORIES), (F.col("toxicity.toxic") >= toxicity.THRESHOLD).alias("toxic"))


#: Rules of op10, the longest that fits decides.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "template", "block_rate")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_substring": op2_substring,
    "op3_bpe": op3_bpe,
    "op4_minhash": op4_minhash,
    "op5_quality": op5_quality,
    "op6_langid": op6_langid,
    "op7_media": op7_media,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_urls": op10_urls,
}

#: The exact join of all shingles and the closure of its links: fine for small tables.
OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END s
  FROM w),
e AS (SELECT doc_id, len(s) n, unnest(s) x FROM s),
l AS (
  SELECT a.doc_id u, b.doc_id v FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.v FROM r JOIN l ON l.u = r.to_id)
SELECT s.doc_id, len(s.s)::BIGINT n_shingles, c.component_id, s.doc_id = c.component_id kept
FROM s JOIN (SELECT id, min(to_id) component_id FROM r GROUP BY id) c ON c.id = s.doc_id
"""

SQL: dict[str, str] = {"op4_minhash": OP4_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
