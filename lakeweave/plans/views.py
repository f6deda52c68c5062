"""The engine's views of the driver's tables: documents as records of entities, and the same in SQL.

A record's country is the document's language, its source S1, S2 or S3 by id, its name the first six words of the
normalised text and its address all the rest. num are the address's numbers in order, nset the same sorted.

Texts are normalised once for each application and version of the table; the records, and the scored pairs that many
queries start from, are stage tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import text as T
from lakeweave.operators import retrieval
from lakeweave.sources import tables as IO


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return IO.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def derived(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    return IO.derived(spark, f"{sf_dir}/documents.parquet", name, make)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents (doc_id, country, text) the name, the address, and its numbers in order and sorted: its words of digits."""
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, 1024):
            batch, parts = whole_batch.slice(at, 1024), ([], [], [], [])
            for text in batch.column("text"):
                w = T.basic_words(text.as_py())
                numbers = [x for x in w[6:] if x.isdigit()]
                for into, words in zip(parts, (w[:6], w[6:], numbers, sorted(numbers))):
                    into.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("country"), *(pa.array(x, pa.string()) for x in parts)], ["doc_id", "country", "nb", "ab", "num", "nset"])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("country"), "text")
        d = d.mapInArrow(_parts, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, country string, nb string, ab string, num string, nset string")
        src = F.concat(F.lit("S"), F.col("doc_id") % 3 + 1)
        rows = d.select(F.concat(src, F.lit("-"), F.col("doc_id")).alias("entity_id"), "country", src.alias("src"), "nb", "ab", "num", "nset")
        return rows.withColumns({"nc": T.name_core(F.col("nb")), "ab_digest": F.sha2("ab", 256)})

    return derived(spark, sf_dir, "records", make)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References (S1) and queries (S2, S3)."""
    r = records(spark, sf_dir)
    return r.filter("src = 'S1'"), r.filter("src <> 'S1'")


def words(df: DataFrame) -> DataFrame:
    return retrieval.bags(df, T.tokens(F.concat_ws(" ", "nc", "ab")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs: 5 for a query, of tokens in at most 200 references or among its 5 rarest; a stage table."""

    def make() -> DataFrame:
        s, r = sides(spark, sf_dir)
        return retrieval.retrieve(words(r), words(s), 5, 200, 5)

    return derived(spark, sf_dir, "candidates", make)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates() with their score as the probability, and the
    records' own columns; an address goes by its digest."""

    def make() -> DataFrame:
        s, r = sides(spark, sf_dir)
        own = ("nc", "nb", "ab_digest", "num", "nset")
        c = candidates(spark, sf_dir)
        c = c.join(r.select(F.col("entity_id").alias("rid"), *own, (F.col("ab") == "").alias("noaddr")), "rid")
        return c.join(s.select(F.col("entity_id").alias("s1"), *(F.col(x).alias(f"s1_{x}") for x in own)), "s1").withColumn("prob", F.col("score"))

    return derived(spark, sf_dir, "scored", make)


BASIC = r"trim(regexp_replace(regexp_replace(replace(lower(replace(replace(replace(strip_accents(coalesce(text,'')),'ß','ss'),'œ','oe'),'æ','ae')),'&',' and '),'[^a-z0-9 ]',' ','g'),'\s+',' ','g'))"
CORE = rf"trim(regexp_replace(regexp_replace(%s,'\b({T.LEGAL})\b',' ','g'),'\s+',' ','g'))"
RECORDS = f"""
d AS (SELECT doc_id, lang country, string_split({BASIC}, ' ') w FROM documents),
r0 AS (SELECT 'S'||(doc_id%3+1)||'-'||doc_id entity_id, country, 'S'||(doc_id%3+1) src,
  array_to_string(w[1:6],' ') nb, array_to_string(w[7:],' ') ab FROM d),
recs AS (SELECT *, {CORE % "nb"} nc, array_to_string(regexp_extract_all(ab,'\\b\\d+\\b'),' ') num, array_to_string(list_sort(regexp_extract_all(ab,'\\b\\d+\\b')),' ') nset FROM r0),
toks AS (SELECT country, entity_id, src, unnest(list_distinct(list_filter(string_split(nc||' '||ab,' '), lambda x: length(x)>=2))) tok FROM recs)"""


def retrieve_sql(k: int, max_df: int | None, min_keep: int, ctes: str = RECORDS, source: str = "toks") -> str:
    keep = "TRUE" if max_df is None else f"df<={max_df} OR r<={min_keep}"
    return f"""WITH {ctes},
st AS (SELECT * FROM {source} WHERE src='S1'), qt AS (SELECT * FROM {source} WHERE src<>'S1'),
n AS (SELECT country, count(DISTINCT entity_id) n FROM st GROUP BY 1),
df AS (SELECT country, tok, count(*) df FROM st GROUP BY 1,2),
stats AS (SELECT df.country, tok, df, ln((n+1)::DOUBLE/df) idf FROM df JOIN n USING(country)),
norms AS (SELECT st.entity_id s1, CASE WHEN sum(idf*idf)=0 THEN 1 ELSE sqrt(sum(idf*idf)) END norm FROM st JOIN stats USING(country,tok) GROUP BY 1),
q0 AS (SELECT qt.country, qt.tok, qt.entity_id rid, df, idf*idf w, sqrt(sum(idf*idf) OVER (PARTITION BY qt.entity_id)) qnorm, row_number() OVER (PARTITION BY qt.entity_id ORDER BY df, qt.tok) r FROM qt JOIN stats USING(country,tok)),
q AS (SELECT * FROM q0 WHERE {keep}),
h AS (SELECT q.country, q.rid, st.entity_id s1, sum(q.w) w, max(qnorm) qnorm FROM q JOIN st USING(country,tok) GROUP BY 1,2,3),
sc AS (SELECT country, rid, s1, round(w/(qnorm*norm),9) score FROM h JOIN norms USING(s1)),
ranked AS (SELECT country, rid, s1, score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, s1) rank FROM sc),
cands AS (SELECT country, rid, s1, round(score,6) score, rank FROM ranked WHERE rank<={k})"""


SCORED = retrieve_sql(5, 200, 5) + """,
scored AS (SELECT c.*, c.score prob, r.nc, r.nb, r.ab, r.num, r.nset, s.nc s1_nc, s.nb s1_nb, s.ab s1_ab, s.num s1_num, s.nset s1_nset FROM cands c JOIN recs r ON r.entity_id=c.rid JOIN recs s ON s.entity_id=c.s1)"""
