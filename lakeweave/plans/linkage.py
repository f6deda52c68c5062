"""Queries of the linkage operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions import strings as S
from lakeweave.functions import text as T
from lakeweave.operators import blocking, decide, features, retrieval, synthesize
from lakeweave.operators.assemble import ALIAS, DOMAIN
from lakeweave.plans.views import BASIC, CORE, RECORDS, SCORED, candidates, derived, records, retrieve_sql, scored, sides, table, words

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(SCORED + ", best AS (SELECT * FROM scored WHERE rank=1 AND prob>=0.3) SELECT r.entity_id s1, coalesce(string_agg(DISTINCT b.rid, ',' ORDER BY b.rid),'') matched_entity_ids FROM recs r LEFT JOIN best b ON b.s1=r.entity_id WHERE r.src='S1' GROUP BY 1")
def er_flagship_topk_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = sides(spark, sf_dir)
    c = candidates(spark, sf_dir).withColumn("prob", F.col("score"))
    return decide.lists(s.select(F.col("entity_id").alias("s1")), decide.assign(c, 0.3))


@query(f"SELECT doc_id, {BASIC} b FROM documents")
def text_basic_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.basic(F.col("text")).alias("b"))


@query(r"SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name||', '||n_name),'[^a-z0-9 ]',' ','g'),'\s+',' ','g')) a, regexp_replace(trim(regexp_replace(regexp_replace(lower(c_name),'[^a-z0-9 ]',' ','g'),'\s+',' ','g')), '\b0+(\d)', '\1', 'g') z FROM customer JOIN nation ON c_nationkey=n_nationkey")
def leading_zero_strip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", T.basic(F.concat_ws(", ", "c_name", "n_name")).alias("a"), F.regexp_replace(T.basic(F.col("c_name")), r"\b0+(\d)", "$1").alias("z"))


@query("""SELECT c_custkey, c_nationkey||' N Main St, N/A, '||['Ohio','MH','Hauts-de-France'][c_custkey%3+1] raw,
c_nationkey||[' north main street zsoh',' north main street zsmh',' no main saint zshdf'][c_custkey%3+1] ab FROM customer""")
def address_normalize(spark, sf_dir):
    """Region codes, abbreviations and cities; the name of the nation stands for the country."""
    c = table(spark, sf_dir, "customer")
    country = F.element_at(F.array(F.lit("US"), F.lit("India"), F.lit("France")), (F.col("c_custkey") % 3 + 1).cast("int"))
    place = F.element_at(F.array(F.lit("Ohio"), F.lit("MH"), F.lit("Hauts-de-France")), (F.col("c_custkey") % 3 + 1).cast("int"))
    raw = F.concat_ws(", ", F.concat(F.col("c_nationkey"), F.lit(" N Main St")), F.lit("N/A"), place)
    return c.select("c_custkey", raw.alias("raw"), T.address(raw, country).alias("ab"))


def _case(column: str, values: dict[str, str]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {column} END"


@query(f"SELECT doc_id, array_to_string(list_transform(string_split({BASIC},' '), lambda x: {_case('x', T.ABBREVIATIONS)}),' ') e FROM documents")
def abbrev_expand(spark, sf_dir):
    w = F.split(T.basic(F.col("text")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(w, lambda x: T.mapped(x, T.mapping(T.ABBREVIATIONS))), " ").alias("e"))


@query(f"SELECT doc_id, array_to_string(list_transform(string_split({BASIC},' '), lambda x: CASE WHEN regexp_matches(x,'[a-z]') AND regexp_matches(x,'[0-9]') THEN translate(x,'013547','olesat') ELSE x END),' ') u FROM documents")
def leet_fix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.unleet(T.basic(F.col("text"))).alias("u"))


@query(f"WITH d AS (SELECT doc_id, {BASIC} b FROM documents) SELECT doc_id, {CORE % 'b'} nc FROM d")
def legal_suffix_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.name_core(T.basic(F.col("text"))).alias("nc"))


_SOUND = "replace(replace(replace(replace(replace(replace(replace(x,'ph','f'),'ck','k'),'c','k'),'q','k'),'z','s'),'w','v'),'x','ks')"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _squeezed(e: str) -> str:
    """A run of one letter becomes that letter; DuckDB's patterns know no back-references."""
    for c in _LETTERS:
        e = f"regexp_replace({e},'{c}+','{c}','g')"
    return e


_SKELETON_WORD = _squeezed(f"substring({_SOUND},1,1)||regexp_replace(substring({_SOUND},2),'[aeiouyh]','','g')")


@query(f"WITH {RECORDS} SELECT entity_id, array_to_string(list_transform(list_filter(string_split(nb,' '), lambda x: length(x)>=3 AND regexp_full_match(x,'[a-z]+')), lambda x: 'zk'||{_SKELETON_WORD}),' ') sk FROM recs")
def skeleton_tokens(spark, sf_dir):
    return records(spark, sf_dir).select("entity_id", T.skeleton(F.col("nb")).alias("sk"))


@query("SELECT doc_id, replace(replace(replace(strip_accents(coalesce(text,'')),'ß','ss'),'œ','oe'),'æ','ae') f FROM documents")
def fold_latin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold_latin(F.col("text")).alias("f"))


@query(f"WITH {RECORDS} SELECT entity_id, array_to_string(list_sort(list_filter(string_split(nb,' '), lambda x: length(x)>=2)),' ') n_sorted, replace(nb,' ','') n_nospace, nullif(regexp_extract(ab,'\\d+'),'') a_num, nullif(regexp_extract(ab,'\\d+ [a-z]{{3,}}'),'') a_numstreet FROM recs")
def derived_block_keys(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("entity_id", T.sorted_words(F.col("nb")).alias("n_sorted"), F.replace("nb", F.lit(" "), F.lit("")).alias("n_nospace"), T.first_match(F.col("ab"), r"\d+").alias("a_num"), T.first_match(F.col("ab"), r"\d+ [a-z]{3,}").alias("a_numstreet"))


@query(f"WITH {RECORDS}, t AS (SELECT country, unnest(list_distinct(list_filter(string_split(nc,' '), lambda x: length(x)>=2))) t FROM recs) SELECT country, t, count(*) df FROM t GROUP BY 1,2")
def token_df(spark, sf_dir):
    return blocking.document_frequency(records(spark, sf_dir), "nc")


_KEYS = {
    "block_exact": ("nb", lambda: F.col("nb")), "block_core": ("nc", lambda: F.col("nc")),
    "block_sorted": ("array_to_string(list_sort(list_filter(string_split(nb,' '), lambda x: length(x)>=2)),' ')", lambda: T.sorted_words(F.col("nb"))),
    "block_nospace": ("replace(nb,' ','')", lambda: F.replace("nb", F.lit(" "), F.lit(""))),
    "block_address": ("ab", lambda: F.col("ab")),
    "block_num": ("nullif(regexp_extract(ab,'\\d+'),'')", lambda: T.first_match(F.col("ab"), r"\d+")),
    "block_numstreet": ("nullif(regexp_extract(ab,'\\d+ [a-z]{3,}'),'')", lambda: T.first_match(F.col("ab"), r"\d+ [a-z]{3,}")),
}
_PAIRS = "SELECT DISTINCT a.entity_id s1, b.entity_id rid FROM keys a JOIN keys b USING(country,key) WHERE a.src='S1' AND b.src<>'S1'"
for _name, (_sql, _key) in _KEYS.items():
    QUERIES[_name] = lambda spark, sf_dir, key=_key: blocking.pairs(blocking.exact_keys(records(spark, sf_dir), key()))
    SQL[_name] = f"WITH {RECORDS}, keys AS (SELECT entity_id, country, src, {_sql} key FROM recs WHERE coalesce({_sql},'')<>'') {_PAIRS}"


def _rare(column: str, k: int, alphabetic: bool, name: str = "keys") -> str:
    only = "WHERE regexp_full_match(t,'[a-z]+')" if alphabetic else ""
    return f"""{name}_t AS (SELECT entity_id, country, src, unnest(list_distinct(list_filter(string_split({column},' '), lambda x: length(x)>=2))) t FROM recs),
{name}_df AS (SELECT country, t, count(*) df FROM {name}_t GROUP BY 1,2 HAVING count(*)>=2),
{name}_r AS (SELECT entity_id, country, src, t, row_number() OVER (PARTITION BY entity_id ORDER BY df, t) r FROM (SELECT * FROM {name}_t {only}) JOIN {name}_df USING(country,t)),
{name} AS (SELECT entity_id, country, src, t AS key FROM {name}_r WHERE r<={k})"""


for _name, _args in {"block_n_rare1": ("nc", 1, False), "block_n_rare2": ("nc", 2, False), "block_a_rare1": ("ab", 1, True), "block_a_rare2": ("ab", 2, True)}.items():
    QUERIES[_name] = lambda spark, sf_dir, a=_args: blocking.pairs(blocking.rare_keys(records(spark, sf_dir), *a))
    SQL[_name] = f"WITH {RECORDS}, {_rare(*_args)} {_PAIRS}"


_NUM = "nullif(regexp_extract(ab,'\\d+'),'')"
_NUM_KEYS = f"a AS (SELECT entity_id, country, src, {_NUM} AS key FROM recs WHERE {_NUM} IS NOT NULL)"
_JOINED = "keys AS (SELECT a.entity_id, a.country, a.src, a.key||'|'||b.key AS key FROM a JOIN b USING(entity_id))"


@query(f"WITH {RECORDS}, {_rare('nc', 2, False, 'a')}, {_rare('ab', 2, True, 'b')}, {_JOINED} {_PAIRS}")
def block_compound(spark, sf_dir):
    r = records(spark, sf_dir)
    return blocking.pairs(blocking.compound_keys(blocking.rare_keys(r, "nc", 2), blocking.rare_keys(r, "ab", 2, True)))


@query(f"WITH {RECORDS}, {_NUM_KEYS}, {_rare('nc', 2, False, 'b')}, {_JOINED} {_PAIRS}")
def block_num_n_rare2(spark, sf_dir):
    r = records(spark, sf_dir)
    return blocking.pairs(blocking.compound_keys(blocking.exact_keys(r, T.first_match(F.col("ab"), r"\d+")), blocking.rare_keys(r, "nc", 2)))


@query(f"WITH {RECORDS}, {_NUM_KEYS}, {_rare('ab', 1, True, 'b')}, {_JOINED} {_PAIRS}")
def block_num_a_rare1(spark, sf_dir):
    r = records(spark, sf_dir)
    return blocking.pairs(blocking.compound_keys(blocking.exact_keys(r, T.first_match(F.col("ab"), r"\d+")), blocking.rare_keys(r, "ab", 1, True)))


@query(f"""WITH {RECORDS}, {_rare('nc', 2, False)}, z AS (SELECT country, key, count(*) FILTER (src<>'S1') r FROM keys GROUP BY 1,2), c AS (SELECT entity_id, sum(r)::BIGINT c FROM keys JOIN z USING(country,key) WHERE src='S1' GROUP BY 1)
SELECT count(*) n, round(avg(c),6) mean, quantile_disc(c,0.5)::BIGINT median, quantile_disc(c,0.95)::BIGINT p95, max(c) most FROM c""")
def block_candidate_quantiles(spark, sf_dir):
    return blocking.candidate_quantiles(blocking.rare_keys(records(spark, sf_dir), "nc", 2))


_TRUTH = "truth AS (SELECT s.entity_id s1, r.entity_id rid FROM recs s JOIN recs r ON s.nb=r.nb AND s.ab=r.ab AND s.country=r.country WHERE s.src='S1' AND r.src<>'S1')"


def _truth(spark, sf_dir):
    """Records of equal name and address stand for true links."""
    s, r = sides(spark, sf_dir)
    key = ["nb", "ab_digest", "country"]
    return s.select(F.col("entity_id").alias("s1"), *key).join(r.select(F.col("entity_id").alias("rid"), *key), key).select("s1", "rid")


def _keyed(records: DataFrame, name: str) -> DataFrame:
    """(name, true_key) of records: those of one key are true links of each other. Without a country there is none."""
    digest = F.unhex(F.sha2(F.concat("ab_digest", "nb", F.lit("|"), "country"), 256))
    return records.select(F.col("entity_id").alias(name), F.substring(digest, 1, 16).alias("true_key")).filter("true_key is not null")


def _true_counts(spark, sf_dir, of: str) -> DataFrame:
    """(s1 or rid, nt): how many true links each reference or query has, if any, from the sizes of the keys. The pairs of
    a group of copies grow with its square; no pair is formed."""
    s, r = sides(spark, sf_dir)
    own, other = (s, r) if of == "s1" else (r, s)
    sizes = _keyed(other, "id").groupBy("true_key").agg(F.count(F.lit(1)).alias("n"))
    return _keyed(own, of).join(sizes, "true_key").groupBy(of).agg(F.sum("n").alias("nt"))


def _true_among(spark, sf_dir, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (rid, s1) that _truth has, as often as it has them."""
    s, r = sides(spark, sf_dir)
    linked = _keyed(r, "rid").join(_keyed(s, "s1").select("true_key").distinct(), "true_key", "left_semi")
    both = pairs.select("rid", "s1").distinct().join(linked, "rid")
    return both.join(_keyed(s, "s1").withColumnRenamed("true_key", "s1_key"), "s1").filter("true_key = s1_key").select("s1", "rid")


@query(f"""WITH {RECORDS}, {_TRUTH}, {_rare('nc', 2, False)},
b AS (SELECT sum(s*r) bound FROM (SELECT country, key, count(*) FILTER (src='S1') s, count(*) FILTER (src<>'S1') r FROM keys GROUP BY 1,2)),
p AS (SELECT sum(s*r) possible FROM (SELECT country, count(DISTINCT entity_id) FILTER (src='S1') s, count(DISTINCT entity_id) FILTER (src<>'S1') r FROM keys GROUP BY 1)),
h AS (SELECT DISTINCT t.s1, t.rid FROM truth t JOIN keys a ON a.entity_id=t.s1 JOIN keys k ON k.entity_id=t.rid AND k.key=a.key AND k.country=a.country),
f AS (SELECT count(*) n_true, round(avg(CASE WHEN h.s1 IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END),6) recall FROM truth LEFT JOIN h USING(s1,rid))
SELECT n_true, recall, bound::BIGINT bound, possible::BIGINT possible, round(1-bound::DOUBLE/possible,6) reduction FROM f, b, p""")
def block_quality(spark, sf_dir):
    return blocking.quality(blocking.rare_keys(records(spark, sf_dir), "nc", 2), _truth(spark, sf_dir))


@query(f"WITH {RECORDS}, st AS (SELECT * FROM toks WHERE src='S1'), n AS (SELECT country, count(DISTINCT entity_id) n FROM st GROUP BY 1) SELECT country, tok, count(*) df, round(ln((any_value(n)+1)::DOUBLE/count(*)),6) idf FROM st JOIN n USING(country) GROUP BY 1,2")
def inv_index_build(spark, sf_dir):
    rows = words(sides(spark, sf_dir)[0]).select("country", "entity_id", F.explode("toks").alias("tok"))
    stats, _ = retrieval.build_index(rows)
    return stats.select("country", "tok", "df", F.round("idf", 6).alias("idf"))


@query(retrieve_sql(5, None, 0) + " SELECT * FROM cands")
def retrieve_words_topk(spark, sf_dir):
    s, r = sides(spark, sf_dir)
    return retrieval.retrieve(words(r), words(s), 5)


@query(retrieve_sql(5, 200, 5) + " SELECT * FROM cands")
def retrieve_words_capped(spark, sf_dir):
    return candidates(spark, sf_dir)


_GRAMS = RECORDS + ", grams AS (SELECT country, entity_id, src, unnest(list_distinct(list_transform(range(1, length(replace(nc,' ',''))-1), lambda i: substring(replace(nc,' ',''), i::INT, 3)))) tok FROM recs WHERE length(replace(nc,' ',''))>=3)"


@query(retrieve_sql(5, 100, 8, _GRAMS, "grams") + " SELECT * FROM cands")
def retrieve_trigrams_topk(spark, sf_dir):
    s, r = sides(spark, sf_dir)
    g = lambda df: retrieval.bags(df, T.trigrams(F.col("nc")))
    return retrieval.retrieve(g(r), g(s), 5, 100, 8)


_SKELETON = f"array_to_string(list_transform(list_filter(string_split(nb,' '), lambda x: length(x)>=3 AND regexp_full_match(x,'[a-z]+')), lambda x: 'zk'||{_SKELETON_WORD}),' ')"
_STOKS = RECORDS + f", stoks AS (SELECT country, entity_id, src, unnest(list_distinct(list_filter(string_split(nc||' '||{_SKELETON}||' '||ab,' '), lambda x: length(x)>=2))) tok FROM recs)"
_FIRST = retrieve_sql(5, 200, 5, _STOKS, "stoks") + " SELECT * FROM cands"
_WEAK = f", top AS (SELECT rid, score FROM ({_FIRST}) WHERE rank=1), weak AS (SELECT entity_id FROM recs LEFT JOIN top ON rid=entity_id WHERE src='S1' OR ab='' OR coalesce(score,0)<0.6), wgrams AS (SELECT * FROM grams WHERE entity_id IN (SELECT entity_id FROM weak))"
_SECOND = retrieve_sql(5, 100, 8, _GRAMS + _WEAK, "wgrams") + " SELECT * FROM cands"


@query(f"SELECT coalesce(a.rid,b.rid) rid, coalesce(a.s1,b.s1) s1, coalesce(a.score,0) p_score, coalesce(a.rank-1,99)::TINYINT p_rank, coalesce(b.score,0) f_score, coalesce(b.rank-1,99)::TINYINT f_rank FROM ({_FIRST}) a FULL JOIN ({_SECOND}) b ON a.rid=b.rid AND a.s1=b.s1")
def retrieve_adaptive_merge(spark, sf_dir):
    s, r = (df.withColumn("sk", T.skeleton(F.col("nb"))) for df in sides(spark, sf_dir))
    return retrieval.candidates(r, s, 5, 5, 0.6, 200, 100)


@query(f"""WITH {RECORDS}, {_TRUTH}, {_rare('nc', 2, False)}, h AS (SELECT DISTINCT t.s1, t.rid FROM truth t JOIN keys a ON a.entity_id=t.s1 JOIN keys k ON k.entity_id=t.rid AND k.key=a.key AND k.country=a.country)
SELECT substr(rid,1,2) src, count(*) n_true, round(avg(CASE WHEN h.s1 IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END),6) recall FROM truth LEFT JOIN h USING(s1,rid) GROUP BY 1""")
def block_recall_by_source(spark, sf_dir):
    return blocking.recall_by_source(blocking.rare_keys(records(spark, sf_dir), "nc", 2), _truth(spark, sf_dir))


@query(retrieve_sql(50, 200, 5) + f", {_TRUTH} SELECT count(*) n, " + ", ".join(f"round(avg(CASE WHEN rank<={k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) recall_{k}" for k in (1, 5, 10, 20, 50)) + " FROM truth LEFT JOIN cands USING(rid,s1)")
def recall_at_k(spark, sf_dir):
    s, r = sides(spark, sf_dir)
    return retrieval.recall_at(retrieval.retrieve(words(r), words(s), 50, 200, 5), _truth(spark, sf_dir), (1, 5, 10, 20, 50))


@query(retrieve_sql(5, 200, 5) + f", {_TRUTH} SELECT r.country, r.src, count(*) n, round(avg(CASE WHEN c.rid IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) missed FROM truth t JOIN recs r ON r.entity_id=t.rid LEFT JOIN cands c ON c.rid=t.rid AND c.s1=t.s1 GROUP BY 1,2")
def miss_profile(spark, sf_dir):
    """All true links of a country and source less those among the candidates."""
    _, r = sides(spark, sf_dir)
    r = r.select(F.col("entity_id").alias("rid"), "country", "src")
    hits = _true_among(spark, sf_dir, candidates(spark, sf_dir)).groupBy("rid").agg(F.count(F.lit(1)).alias("hits"))
    t = r.join(_true_counts(spark, sf_dir, "rid"), "rid").join(hits, "rid", "left")
    t = t.groupBy("country", "src").agg(F.sum("nt").alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return t.select("country", "src", "n", F.round((F.col("n") - F.col("hits")) / F.col("n"), 6).alias("missed"))


def _overlap_sql(tokens: str, name: str, with_nq: bool) -> str:
    return SCORED + f""",
ft AS (SELECT DISTINCT entity_id, country, src, unnest({tokens}) t FROM recs),
fn AS (SELECT country, count(*) n FROM recs WHERE src='S1' GROUP BY 1),
fdf AS (SELECT country, t, count(*) df FROM ft WHERE src='S1' GROUP BY 1,2),
fw AS (SELECT entity_id, t, ln((n+1)::DOUBLE/(coalesce(df,0)+1))*ln((n+1)::DOUBLE/(coalesce(df,0)+1)) w FROM ft LEFT JOIN fdf USING(country,t) JOIN fn USING(country)),
tot AS (SELECT entity_id, sum(w) w, count(*) n FROM fw GROUP BY 1),
sh AS (SELECT c.rid, c.s1, sum(a.w) w, count(*) n FROM cands c JOIN fw a ON a.entity_id=c.rid JOIN fw b ON b.entity_id=c.s1 AND b.t=a.t GROUP BY 1,2),
j AS (SELECT c.rid, c.s1, coalesce(q.w,0) wq, coalesce(d.w,0) wd, coalesce(sh.w,0) ws, coalesce(sh.n,0) ns, coalesce(q.n,0) nq, coalesce(d.n,0) nd FROM cands c LEFT JOIN tot q ON q.entity_id=c.rid LEFT JOIN tot d ON d.entity_id=c.s1 LEFT JOIN sh ON sh.rid=c.rid AND sh.s1=c.s1)
SELECT rid, s1, CASE WHEN wq>0 THEN round(ws/wq,6) END {name}_cq, CASE WHEN wd>0 THEN round(ws/wd,6) END {name}_cd, CASE WHEN wq>0 AND wd>0 THEN round(ws/sqrt(wq*wd),6) END {name}_cos,
ns {name}_ns, nq-ns {name}_extra, nd-ns {name}_miss{f", nq {name}_nq" if with_nq else ""} FROM j"""


#: Spaces of tokens: name -> (tokens of a record, their SQL, whether the query's number of them is a feature).
SPACES = {
    "nw": (lambda: T.tokens(F.col("nc")), "list_distinct(list_filter(string_split(nc,' '), lambda x: length(x)>=2))", True),
    "sk": (lambda: T.tokens(T.skeleton(F.col("nb"))), f"list_distinct(string_split(nullif({_SKELETON},''),' '))", False),
    "n3": (lambda: T.trigrams(F.col("nc")), "CASE WHEN length(replace(nc,' ',''))>=3 THEN list_distinct(list_transform(range(1, length(replace(nc,' ',''))-1), lambda i: substring(replace(nc,' ',''), i::INT, 3))) ELSE [] END", False),
    "aw": (lambda: T.tokens(F.col("ab")), "list_distinct(list_filter(string_split(ab,' '), lambda x: length(x)>=2))", True),
    "num": (lambda: T.tokens(F.col("num")), "list_distinct(list_filter(string_split(num,' '), lambda x: length(x)>=2))", True),
}


def overlap_in(spark, sf_dir, name: str, pairs: DataFrame) -> DataFrame:
    s, r = sides(spark, sf_dir)
    tokens, _, with_nq = SPACES[name]
    return features.overlap_in_blocks(pairs, r, s, tokens(), name, with_nq)


for _name, _short in {"feat_idf_overlap_words": "nw", "feat_idf_overlap_skeletons": "sk", "feat_idf_overlap_trigrams": "n3", "feat_idf_overlap_address": "aw", "feat_idf_overlap_numbers": "num"}.items():
    QUERIES[_name] = lambda spark, sf_dir, short=_short: overlap_in(spark, sf_dir, short, scored(spark, sf_dir).select("rid", "s1"))
    SQL[_name] = _overlap_sql(SPACES[_short][1], _short, SPACES[_short][2])


_FITS = "({a}.l<{b}.l AND ({b}.v%(10::HUGEINT**{a}.l)::HUGEINT={a}.v OR {b}.v//(10::HUGEINT**greatest({b}.l-{a}.l,0))::HUGEINT={a}.v))"
#: How the numbers qs and ds (lists of digit strings) of each row of v (k) relate, by the definition.
NUMBER_CTES = """qe AS (SELECT k, i, substr(qs[i],1,15)::BIGINT v, least(length(qs[i]),15) l FROM (SELECT k, qs, unnest(range(1,len(qs)+1)) i FROM v)),
de AS (SELECT k, i, substr(ds[i],1,15)::BIGINT v, least(length(ds[i]),15) l FROM (SELECT k, ds, unnest(range(1,len(ds)+1)) i FROM v)),
lq AS (SELECT * FROM qe WHERE NOT EXISTS (FROM de WHERE de.k=qe.k AND de.v=qe.v)), ld AS (SELECT * FROM de WHERE NOT EXISTS (FROM qe WHERE de.k=qe.k AND de.v=qe.v)),
m AS (SELECT lq.k, lq.i, count(ld.v) free, coalesce(bool_or(FITS_AB OR FITS_BA),false) cut, min(abs(lq.v-ld.v)) diff FROM lq LEFT JOIN ld ON ld.k=lq.k GROUP BY 1,2),
s AS (SELECT k, count(*) FILTER (free>0 AND cut) tr, count(*) FILTER (free>0 AND NOT cut AND diff<=20) ne, count(*) FILTER (free>0 AND NOT cut AND diff>20) ch, count(*) FILTER (free=0) ad, min(diff) FILTER (free>0 AND NOT cut) md FROM m GROUP BY 1),
f AS (SELECT v.k, len(qs) nq, len(ds) nd, s.*, (SELECT count(*) FROM ld WHERE ld.k=v.k) mi, (SELECT arg_min(v,i) FROM qe WHERE qe.k=v.k) q1, (SELECT arg_min(v,i) FROM de WHERE de.k=v.k) d1, (SELECT max(v) FROM qe WHERE qe.k=v.k) qm, (SELECT max(v) FROM de WHERE de.k=v.k) dm FROM v LEFT JOIN s ON s.k=v.k)""".replace("FITS_AB", _FITS.format(a="lq", b="ld")).replace("FITS_BA", _FITS.format(a="ld", b="lq"))
NUMBER_COLUMNS = """CASE WHEN nq+nd>0 THEN coalesce(tr,0) END nm_trunc, CASE WHEN nq+nd>0 THEN coalesce(ne,0) END nm_near, CASE WHEN nq+nd>0 THEN coalesce(ch,0) END nm_changed, CASE WHEN nq+nd>0 THEN coalesce(ad,0) END nm_added, CASE WHEN nq+nd>0 THEN mi END nm_miss, md nm_mindiff,
CASE WHEN nq>0 AND nd>0 THEN (q1=d1)::INT END nm_first_eq, CASE WHEN nq>0 AND nd>0 THEN (qm=dm)::INT END nm_max_eq"""
_NUMBERS = f"""WITH t AS (SELECT c_custkey k, [c_custkey::VARCHAR, (c_custkey*7%1000)::VARCHAR, '0'||c_nationkey, CASE WHEN c_custkey%5=0 THEN '123456789012345678901234' WHEN c_custkey%5=1 THEN '12345' END] n FROM customer),
u AS (SELECT k, CASE WHEN k%17=0 THEN [] ELSE list_filter(n, lambda x: x IS NOT NULL) END n FROM t),
v AS (SELECT a.k, b.k k2, a.n qs, b.n ds FROM u a JOIN u b ON b.k=a.k+11),
{NUMBER_CTES} SELECT k c_custkey, {NUMBER_COLUMNS} FROM f"""


@query(_NUMBERS)
def feat_number_relations(spark, sf_dir):
    """Of a customer's numbers and those of the customer 11 keys on; some have none, some one of 24 digits."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    extra = F.when(key % 5 == 0, F.lit("123456789012345678901234")).when(key % 5 == 1, F.lit("12345"))
    own = F.array_compact(F.array(key.cast("string"), (key * 7 % 1000).cast("string"), F.concat(F.lit("0"), F.col("c_nationkey").cast("string")), extra))
    numbers = F.when(key % 17 == 0, F.array().cast("array<string>")).otherwise(own)
    a, b = c.select("c_custkey", numbers.alias("q"), (key + 11).alias("k")), c.select(key.alias("k"), numbers.alias("d"))
    return a.join(b, "k").select("c_custkey", *(v.alias(k) for k, v in features.number_relations(F.col("q"), F.col("d")).items()))


@query(SCORED + " SELECT rid, s1, round(jaro_winkler_similarity(nc, s1_nc),6) n_jw, levenshtein(nc, s1_nc) lev FROM scored")
def feat_jaro_winkler(spark, sf_dir):
    p = scored(spark, sf_dir)
    # two empty strings are not alike here, as in the engine that the SQL is for
    jw = F.when((F.col("nc") == "") & (F.col("s1_nc") == ""), 0.0).otherwise(S.pairwise(S.jaro_winkler, "nc", "s1_nc"))
    d = p.select("nc", "s1_nc").distinct().withColumn("n_jw", F.floor(jw * 1e6 + 0.5) / 1e6)
    return p.join(d, ["nc", "s1_nc"]).select("rid", "s1", "n_jw", F.levenshtein("nc", "s1_nc").cast("long").alias("lev"))


@query()
def feat_ratios(spark, sf_dir):
    p = scored(spark, sf_dir)
    d = p.select("nc", "s1_nc").distinct().select("nc", "s1_nc", F.round(S.pairwise(S.ratio, "nc", "s1_nc"), 6).alias("n_ratio"), F.round(S.pairwise(S.partial_ratio, "nc", "s1_nc"), 6).alias("n_pr"), F.round(S.pairwise(S.token_set_ratio, "nc", "s1_nc"), 6).alias("n_tsr"))
    return p.join(d, ["nc", "s1_nc"]).select("rid", "s1", "n_ratio", "n_pr", "n_tsr")


@query(SCORED + ", a AS (SELECT rid, s1, list_distinct(string_split(nc,' ')) x, list_distinct(string_split(s1_nc,' ')) y FROM scored) SELECT rid, s1, round(len(list_intersect(x,y))::DOUBLE/len(list_distinct(list_concat(x,y))),6) jac FROM a")
def feat_jaccard_tokens(spark, sf_dir):
    x, y = (F.split(c, " ") for c in ("nc", "s1_nc"))
    return scored(spark, sf_dir).select("rid", "s1", F.round(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 6).alias("jac"))


@query("SELECT p.page_id, regexp_matches(url, '(?i)(\\.com|www\\.|\\.in\\b|\\.net|\\.org|\\.fr\\b)') q_domain, regexp_matches(html, '(?i)\\b(dba|d/b/a|d\\.b\\.a|formerly|f/k/a|fka|aka|a/k/a|known as|doing business as)\\b') q_alias, regexp_matches(html, '[^\\x00-\\x7F]') q_nonascii, length(url) q_rawlen FROM pages p")
def feat_flags(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("url").rlike(DOMAIN).alias("q_domain"), F.col("html").rlike(ALIAS).alias("q_alias"), F.col("html").rlike(r"[^\x00-\x7F]").alias("q_nonascii"), F.char_length("url").cast("long").alias("q_rawlen"))


_SK = lambda c: _SKELETON.replace("nb", c)


@query(SCORED + f" SELECT rid, s1, (nc=s1_nc)::INT n_eq, (replace(nc,' ','')=replace(s1_nc,' ',''))::INT nns_eq, ({_SK('nb')}={_SK('s1_nb')})::INT sk_eq, (ab='')::INT q_noaddr, (rid LIKE 'S3%')::INT is_s3 FROM scored")
def feat_equalities(spark, sf_dir):
    i = lambda c: c.cast("int")
    ns = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    p = scored(spark, sf_dir)
    return p.select("rid", "s1", i(F.col("nc") == F.col("s1_nc")).alias("n_eq"), i(ns("nc") == ns("s1_nc")).alias("nns_eq"), i(T.skeleton(F.col("nb")) == T.skeleton(F.col("s1_nb"))).alias("sk_eq"), i(F.col("noaddr")).alias("q_noaddr"), i(F.col("rid").startswith("S3")).alias("is_s3"))


@query(f"WITH {RECORDS} SELECT entity_id, count(*) OVER (PARTITION BY country, nc) s_nc_dup, count(*) OVER (PARTITION BY country, ab) s_ab_dup FROM recs WHERE src='S1'")
def feat_ambiguity_counts(spark, sf_dir):
    """Counts joined back: a frequent name, or no address at all, is no task of its own."""
    s = sides(spark, sf_dir)[0].select("entity_id", "country", "nc", "ab_digest")
    n = lambda c, to: s.groupBy("country", c).agg(F.count(F.lit(1)).alias(to))
    return s.join(n("nc", "s_nc_dup"), ["country", "nc"]).join(n("ab_digest", "s_ab_dup"), ["country", "ab_digest"]).select("entity_id", "s_nc_dup", "s_ab_dup")


@query(SCORED + " SELECT rid, s1, score, count(*) OVER w n_cand, round(score-max(score) OVER w,6) score_gapmax, rank() OVER (PARTITION BY rid ORDER BY score DESC NULLS LAST) score_rk FROM scored WINDOW w AS (PARTITION BY rid)")
def feat_query_context(spark, sf_dir):
    return features.query_context(scored(spark, sf_dir).select("rid", "s1", "score"), ["score"])


_ONLY = "list_distinct(list_filter(string_split({a},' '), lambda x: length(x)>=2 AND NOT list_contains(string_split({b},' '), x)))"
_SIDE = """{s}_t AS (SELECT tok, sum(y) pos, count(*) n FROM (SELECT unnest({s}) tok, y FROM learn) GROUP BY 1),
{s}_lo AS (SELECT tok, round(CASE WHEN p0>0 AND p0<1 THEN ln((pos+20*p0)/(n-pos+20*(1-p0)))-ln(p0/(1-p0)) END,6) lo_{s}, n n_{s} FROM {s}_t, (SELECT avg(y) p0 FROM learn))"""
_DIFF = SCORED + f""", {_TRUTH}, one AS (SELECT rid, min(s1) true_s1 FROM truth GROUP BY 1),
df0 AS (SELECT rid, s1, rank, coalesce(s1=true_s1,false)::INT y, substr(coalesce(true_s1,rid),4)::BIGINT%40 fold, {_ONLY.format(a='nc', b='s1_nc')} extra, {_ONLY.format(a='s1_nc', b='nc')} miss FROM scored LEFT JOIN one USING(rid)),
learn AS (SELECT * FROM df0 WHERE rank=1 AND fold>=6), {_SIDE.format(s='extra')}, {_SIDE.format(s='miss')}, lo AS (SELECT * FROM extra_lo FULL JOIN miss_lo USING(tok))"""
_AGG = "{s}_a AS (SELECT rid, s1, min(lo_{s}) te_{s}_min, round(coalesce(sum(lo_{s}),0),6) te_{s}_sum, count(lo_{s}) te_{s}_known FROM (SELECT rid, s1, unnest({s}) tok FROM df0) LEFT JOIN lo USING(tok) GROUP BY 1,2)"


def labelled_diffs(spark, sf_dir, pairs, nc="nc", s1_nc="s1_nc"):
    """Pairs (rid, s1, nc, s1_nc and more) with the name tokens of one side only, the label and the fold of the true link
    or else the record. A record's first true link is its key's first reference; the pairs of a group of copies are not formed."""
    s, r = sides(spark, sf_dir)
    first = _keyed(s, "s1").groupBy("true_key").agg(F.min("s1").alias("true_s1"))
    one = _keyed(r, "rid").join(first, "true_key").groupBy("rid").agg(F.min("true_s1").alias("true_s1"))
    extra, miss = features.diff_tokens(F.col(nc), F.col(s1_nc))
    fold = F.substring(F.coalesce("true_s1", "rid"), 4, 20).cast("bigint") % 40
    return pairs.join(one, "rid", "left").withColumns({"y": F.coalesce(F.col("s1") == F.col("true_s1"), F.lit(False)), "fold": fold, "extra": extra, "miss": miss})


def _diffs(spark, sf_dir):
    """A stage table, as the log odds read it several times: the true links are joined once, not in each branch of the plan."""
    return derived(spark, sf_dir, "diffs", lambda: labelled_diffs(spark, sf_dir, scored(spark, sf_dir)).select("rid", "s1", "rank", "y", "fold", "extra", "miss"))


def _log_odds(spark, sf_dir):
    return derived(spark, sf_dir, "log-odds", lambda: features.log_odds(_learn(_diffs(spark, sf_dir))))


def _learn(diffs):
    """First candidates of the folds that neither train nor validate."""
    return diffs.filter("rank = 1 and fold >= 6")


@query(_DIFF + " SELECT * FROM lo")
def token_logodds_table(spark, sf_dir):
    return _log_odds(spark, sf_dir)


@query(_DIFF + f", {_AGG.format(s='extra')}, {_AGG.format(s='miss')} SELECT d.rid, d.s1, te_extra_min, te_extra_sum, te_extra_known, te_miss_min, te_miss_sum, te_miss_known FROM df0 d LEFT JOIN extra_a USING(rid,s1) LEFT JOIN miss_a USING(rid,s1)")
def token_logodds_features(spark, sf_dir):
    return features.log_odds_features(_diffs(spark, sf_dir), _log_odds(spark, sf_dir))


@query(_DIFF + " SELECT tok, lo_extra, n_extra FROM lo WHERE n_extra>5 ORDER BY lo_extra, tok LIMIT 25")
def token_logodds_least(spark, sf_dir):
    """The tokens that speak most against a match; here of those met more than five times."""
    return features.least_match_like(_log_odds(spark, sf_dir), "extra", 5)


@query(SCORED + """, b AS (SELECT * FROM scored WHERE rank=1), g AS (SELECT s1, count(*) c FROM b GROUP BY 1), gn AS (SELECT s1, nset, count(*) c FROM b GROUP BY 1,2), gc AS (SELECT s1, nc, count(*) c FROM b GROUP BY 1,2),
x AS (SELECT p.rid, p.s1, p.nset, p.s1_nset, (rank=1)::INT i, (p.nset=p.s1_nset)::INT en, (p.nc=s1_nc)::INT ec, coalesce(g.c,0) g, coalesce(a.c,0) nt, coalesce(a2.c,0) n1, coalesce(c.c,0) ct, coalesce(c2.c,0) c1 FROM scored p LEFT JOIN g ON g.s1=p.s1 LEFT JOIN gn a ON a.s1=p.s1 AND a.nset=p.nset LEFT JOIN gn a2 ON a2.s1=p.s1 AND a2.nset=p.s1_nset LEFT JOIN gc c ON c.s1=p.s1 AND c.nc=p.nc LEFT JOIN gc c2 ON c2.s1=p.s1 AND c2.nc=p.s1_nc),
y AS (SELECT rid, s1, g-i g_n, CASE WHEN nset<>'' THEN nt-i END g_num_twin, CASE WHEN s1_nset<>'' THEN n1-en*i END g_num_s1, ct-i g_nc_twin, c1-ec*i g_nc_s1, CASE WHEN nset<>'' AND s1_nset<>'' THEN en END q_num_eq_s1 FROM x)
SELECT *, CASE WHEN q_num_eq_s1=0 AND g_num_twin>0 THEN 1 ELSE 0 END g_rival, round(g_num_twin::DOUBLE/(g_n+1),6) g_num_twin_frac, round(g_num_s1::DOUBLE/(g_n+1),6) g_num_s1_frac FROM y""")
def group_features(spark, sf_dir):
    return features.group_features(scored(spark, sf_dir))


@query("SELECT doc_id, coalesce(doc_id,0)%40 fold, md5(doc_id::VARCHAR||'x')<'4' sampled FROM documents")
def fold_assignment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.coalesce("doc_id", F.lit(0)) % 40).alias("fold"), (F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("x"))) < "4").alias("sampled"))


@query(SCORED + " SELECT rid, s1, prob FROM scored WHERE rank=1 AND prob>=0.3")
def assign_best(spark, sf_dir):
    return decide.assign(scored(spark, sf_dir), 0.3)


@query(SCORED + " SELECT rid, s1, prob FROM scored WHERE rank=1 AND prob>=CASE country WHEN 'fr' THEN 0.9 WHEN 'de' THEN 0.1 ELSE 0.3 END")
def assign_per_country_threshold(spark, sf_dir):
    return decide.assign(scored(spark, sf_dir), 0.3, {"fr": 0.9, "de": 0.1})


_BEST = SCORED + ", best AS (SELECT rid, max(s1) FILTER (rank=1) s1, max(prob) p, coalesce(max(prob) FILTER (rank=2),0) p2 FROM scored GROUP BY 1)"


@query(_BEST + " SELECT * FROM best")
def best_with_runnerup(spark, sf_dir):
    return decide.best_with_runner_up(scored(spark, sf_dir))


@query(_BEST + """, z AS (SELECT b.*, s.nset num, s.s1_nset s1_num, s.country FROM best b JOIN scored s USING(rid,s1)),
c AS (SELECT *, count(*) OVER w size, min(p) OVER w cmin, max(p) OVER w cmax FROM z WINDOW w AS (PARTITION BY s1, num)),
k AS (SELECT *, p>=0.5 ok, num<>'' AND num<>s1_num AND size>=2 AND cmin<0.05 kill, country IN ('fr') AND p2>=0.3 ambig FROM c),
bo AS (SELECT *, num<>'' AND num=s1_num AND size>=2 AND cmax>=0.95 AND p>=0.3 AND NOT ok AND NOT ambig boost FROM k)
SELECT rid, s1, p, p2, kill, ambig, boost, (ok AND NOT kill AND NOT ambig) OR boost selected FROM bo""")
def cluster_rules(spark, sf_dir):
    p = scored(spark, sf_dir)
    best = decide.best_with_runner_up(p).join(p.select("rid", "s1", F.col("nset").alias("num"), F.col("s1_nset").alias("s1_num"), "country"), ["rid", "s1"])
    return decide.decide(best, 0.5, decide.RULES["cluster_mod"], ("fr",)).select("rid", "s1", "p", "p2", "kill", "ambig", "boost", "selected")


_F = "CASE WHEN nt=0 AND np=0 THEN 1 WHEN tp=0 THEN 0 ELSE 1.25*(tp::DOUBLE/np)*(tp::DOUBLE/nt)/(0.25*(tp::DOUBLE/np)+tp::DOUBLE/nt) END"
_METRIC = SCORED + f", {_TRUTH}, links AS (SELECT rid, s1, prob p FROM scored WHERE rank=1), nt AS (SELECT s1, count(*) nt FROM truth GROUP BY 1)"


@query(_METRIC + f", m AS (SELECT r.entity_id s1, coalesce(any_value(nt.nt),0) nt, count(l.rid) np, count(t.rid) tp FROM recs r LEFT JOIN (SELECT * FROM links WHERE p>=0.5) l ON l.s1=r.entity_id LEFT JOIN truth t ON t.s1=l.s1 AND t.rid=l.rid LEFT JOIN nt ON nt.s1=r.entity_id WHERE src='S1' GROUP BY 1) SELECT count(*) n, round(avg({_F}),6) f FROM m")
def macro_f05(spark, sf_dir):
    refs = sides(spark, sf_dir)[0].select(F.col("entity_id").alias("s1"))
    return decide.f_half(_truth(spark, sf_dir), decide.assign(scored(spark, sf_dir), 0.5), refs).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 6).alias("f"))


@query(_METRIC + f", ts AS (SELECT unnest([0.1,0.3,0.5,0.7,0.9])::DOUBLE t), m AS (SELECT ts.t, r.entity_id s1, coalesce(any_value(nt.nt),0) nt, count(l.rid) np, count(t.rid) tp FROM recs r CROSS JOIN ts LEFT JOIN links l ON l.s1=r.entity_id AND l.p>=ts.t LEFT JOIN truth t ON t.s1=l.s1 AND t.rid=l.rid LEFT JOIN nt ON nt.s1=r.entity_id WHERE src='S1' GROUP BY 1,2) SELECT t, round(avg({_F}),6) f FROM m GROUP BY 1")
def threshold_sweep(spark, sf_dir):
    refs = sides(spark, sf_dir)[0].select(F.col("entity_id").alias("s1"))
    best = decide.best_with_runner_up(scored(spark, sf_dir))
    return decide.sweep(_true_among(spark, sf_dir, best), best, refs, [0.1, 0.3, 0.5, 0.7, 0.9], _true_counts(spark, sf_dir, "s1"))


@query(SCORED + ", o AS (SELECT s1, string_agg(DISTINCT rid, ',' ORDER BY rid) ids FROM scored GROUP BY 1) SELECT r.entity_id s1, coalesce(ids,'') candidate_entity_ids FROM recs r LEFT JOIN o ON o.s1=r.entity_id WHERE src='S1'")
def candidate_lists(spark, sf_dir):
    refs = sides(spark, sf_dir)[0].select(F.col("entity_id").alias("s1"))
    return decide.lists(refs, scored(spark, sf_dir), "candidate_entity_ids")


@query(SCORED + """, b AS (SELECT s1, rid FROM scored WHERE rank=1),
bad0 AS (SELECT s1, string_agg(rid, ',') l FROM (SELECT * FROM b UNION ALL SELECT * FROM b WHERE rid LIKE 'S2%' UNION ALL SELECT s1, s1 FROM b UNION ALL SELECT s1, 'X9'||substr(rid,3) FROM b WHERE rid LIKE 'S3%' UNION ALL SELECT s1, rid||'00000' FROM b WHERE rid LIKE 'S2%') GROUP BY 1),
bad AS (SELECT * FROM bad0 UNION ALL SELECT * FROM bad0 WHERE s1 LIKE '%3' UNION ALL SELECT 'S1-none-'||s1, l FROM bad0 WHERE s1 LIKE '%6'),
i AS (SELECT s1, unnest(string_split(l,',')) rid FROM bad), f AS (SELECT entity_id FROM recs WHERE src='S1')
SELECT 'duplicate_reference_row' rule, (SELECT count(*) FROM (SELECT 1 FROM bad GROUP BY s1 HAVING count(*)>1)) n UNION ALL SELECT 'duplicate_id_in_list', count(*) FROM (SELECT 1 FROM i GROUP BY s1, rid HAVING count(*)>1) UNION ALL SELECT 'self_match', count(*) FROM i WHERE rid LIKE 'S1-%'
UNION ALL SELECT 'wrong_prefix', count(*) FROM i WHERE NOT regexp_matches(rid,'^S[123]-') UNION ALL SELECT 'unknown_id', count(*) FROM i WHERE regexp_matches(rid,'^S[23]-') AND rid NOT IN (SELECT entity_id FROM recs WHERE src<>'S1')
UNION ALL SELECT 'missing_reference', count(*) FROM f WHERE entity_id NOT IN (SELECT s1 FROM bad) UNION ALL SELECT 'extra_reference', count(*) FROM bad WHERE s1 NOT IN (SELECT entity_id FROM f) UNION ALL SELECT 'not_a_candidate', count(*) FROM i WHERE (s1, rid) NOT IN (SELECT s1, rid FROM cands)""")
def validate_rules(spark, sf_dir):
    """A corrupted output in which every rule is broken: doubled ids and rows, ids of the references themselves, of no
    source and of no record, references left out and made up."""
    s, r = sides(spark, sf_dir)
    p = scored(spark, sf_dir)
    best = p.filter("rank = 1").select("s1", "rid")
    src = lambda x: F.col("rid").startswith(x)
    ids = F.concat(F.array("rid", "s1"), F.when(src("S2"), F.array(F.col("rid"), F.concat("rid", F.lit("00000")))).otherwise(F.array(F.concat(F.lit("X9"), F.substring("rid", 3, 99)))))
    out = best.select("s1", F.explode(ids).alias("rid")).groupBy("s1").agg(F.array_join(F.collect_list("rid"), ",").alias("matched_entity_ids"))
    # a list stands once, or twice, or once more under a name that no reference has
    names = F.when(F.col("s1").endswith("3"), F.array("s1", "s1")).when(F.col("s1").endswith("6"), F.array("s1", F.concat(F.lit("S1-none-"), "s1"))).otherwise(F.array("s1"))
    out = out.select(F.explode(names).alias("s1"), "matched_entity_ids")
    return decide.validate(out, s.select(F.col("entity_id").alias("s1")), r.select(F.col("entity_id").alias("rid")), p.select("s1", "rid"))


@query(_METRIC + f", dl AS (SELECT rid, s1 FROM links WHERE p>=0.5 UNION ALL SELECT rid||'#'||k, s1 FROM links, (SELECT unnest([1,2]) k) WHERE p>=0.5 AND rid NOT IN (SELECT rid FROM truth)), m AS (SELECT r.entity_id s1, coalesce(any_value(nt.nt),0) nt, count(l.rid) np, count(t.rid) tp FROM recs r LEFT JOIN dl l ON l.s1=r.entity_id LEFT JOIN truth t ON t.s1=l.s1 AND t.rid=l.rid LEFT JOIN nt ON nt.s1=r.entity_id WHERE src='S1' GROUP BY 1) SELECT count(*) n, round(avg({_F}),6) f FROM m")
def macro_f05_testlike(spark, sf_dir):
    refs = sides(spark, sf_dir)[0].select(F.col("entity_id").alias("s1"))
    best = decide.assign(scored(spark, sf_dir), 0.5)
    links = decide.with_repeated_decoys(best, _true_counts(spark, sf_dir, "rid"), 3)
    return decide.f_half(_true_among(spark, sf_dir, best), links, refs, _true_counts(spark, sf_dir, "s1")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 6).alias("f"))


@query(_METRIC + f", m AS (SELECT r.entity_id s1, r.country, coalesce(any_value(nt.nt),0) nt, count(l.rid) np, count(t.rid) tp FROM recs r LEFT JOIN (SELECT * FROM links WHERE p>=0.5) l ON l.s1=r.entity_id LEFT JOIN truth t ON t.s1=l.s1 AND t.rid=l.rid LEFT JOIN nt ON nt.s1=r.entity_id WHERE src='S1' GROUP BY 1,2) SELECT country, nt=0 singleton, count(*) n, round(avg({_F}),6) f FROM m GROUP BY 1,2")
def macro_f05_breakdown(spark, sf_dir):
    refs = sides(spark, sf_dir)[0].select(F.col("entity_id").alias("s1"), "country")
    f = decide.f_half(_truth(spark, sf_dir), decide.assign(scored(spark, sf_dir), 0.5), refs.select("s1")).join(refs, "s1")
    return f.groupBy("country", (F.col("nt") == 0).alias("singleton")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 6).alias("f"))


@query(_DIFF + " SELECT rid, s1, CASE WHEN fold=0 THEN 'val' ELSE 'train' END part, y=1 y FROM df0 WHERE fold=0 OR (fold BETWEEN 1 AND 5 AND md5(rid||'train')<'4')")
def train_sample(spark, sf_dir):
    picked = F.md5(F.concat("rid", F.lit("train"))) < "4"
    return _diffs(spark, sf_dir).filter((F.col("fold") == 0) | (F.col("fold").between(1, 5) & picked)).select("rid", "s1", F.when(F.col("fold") == 0, "val").otherwise("train").alias("part"), "y")


@query(f"""WITH a AS ({retrieve_sql(20, 200, 5)} SELECT * FROM cands), b AS ({retrieve_sql(10, 100, 8, _GRAMS, "grams")} SELECT * FROM cands),
{RECORDS.strip()}, {_TRUTH}, g AS (SELECT kp, kf, tau FROM (SELECT unnest([5,20]) kp), (SELECT unnest([5,10]) kf), (SELECT unnest([0.3,0.6])::DOUBLE tau)),
u AS (SELECT kp, kf, tau, rid, s1 FROM g JOIN a ON rank<=kp UNION SELECT kp, kf, tau, b.rid, b.s1 FROM g JOIN b ON b.rank<=kf JOIN recs r ON r.entity_id=b.rid LEFT JOIN a t ON t.rid=b.rid AND t.rank=1 WHERE r.ab='' OR coalesce(t.score,0)<tau)
SELECT kp, kf, tau, round(count(t.s1)::DOUBLE/(SELECT greatest(count(*),1) FROM truth),6) recall, round(count(*)::DOUBLE/(SELECT count(*) FROM recs WHERE src<>'S1'),6) candidates FROM u LEFT JOIN truth t ON t.rid=u.rid AND t.s1=u.s1 GROUP BY 1,2,3""")
def union_recall_grid(spark, sf_dir):
    s, r = sides(spark, sf_dir)
    g = lambda df: retrieval.bags(df, T.trigrams(F.col("nc")))
    first, second = retrieval.retrieve(words(r), words(s), 20, 200, 5), retrieval.retrieve(g(r), g(s), 10, 100, 8)
    return retrieval.union_grid(first, second, _truth(spark, sf_dir), r.count(), (5, 20), (5, 10), (0.3, 0.6), r.filter("ab = ''").select(F.col("entity_id").alias("rid")))


@query(f"""WITH {RECORDS}, {_rare('nc', 2, False)}, k AS (SELECT country, string_agg(key, '+' ORDER BY key) key, entity_id FROM keys GROUP BY country, entity_id HAVING count(*)=2)
SELECT country, key, count(*) n, min(entity_id) first_id, max(entity_id) last_id FROM k GROUP BY 1,2 HAVING count(*)>1""")
def rare_token_clusters(spark, sf_dir):
    """Records whose two rarest tokens are the same."""
    k = blocking.rare_keys(records(spark, sf_dir), "nc", 2).groupBy("country", "entity_id").agg(F.array_sort(F.collect_list("key")).alias("ks")).filter(F.size("ks") == 2)
    return k.groupBy("country", F.array_join("ks", "+").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first_id"), F.max("entity_id").alias("last_id")).filter("n > 1")


_J = lambda x, y: f"CASE WHEN len(list_distinct(list_concat({x},{y})))>0 THEN round(len(list_intersect({x},{y}))::DOUBLE/len(list_distinct(list_concat({x},{y}))),6) ELSE 0 END"
_W = lambda c: f"list_filter(string_split({c},' '), lambda x: x<>'')"
_G = lambda c: f"list_distinct(list_transform(range(1, length({c})+1), lambda i: substring(' '||{c}||' ', i::INT, 3)))"


@query(SCORED + f""", e AS (SELECT rid, s1, nb, s1_nb, nc, s1_nc, ab, {_W('nb')} x, {_W('s1_nb')} y, {_W('nc')} cx, {_W('s1_nc')} cy, {_W('ab')} ax, {_W('s1_ab')} ay, {_G('nb')} gx, {_G('s1_nb')} gy, string_split(nullif(num,''),' ') px, string_split(nullif(s1_num,''),' ') py FROM scored)
SELECT rid, s1, (nb=s1_nb)::INT norm_eq, (nc=s1_nc AND nc<>'')::INT core_eq, (list_sort(list_distinct(x))=list_sort(list_distinct(y)))::INT tokset_eq, {_J('x', 'y')} n_jacc, {_J('cx', 'cy')} n_core_jacc, {_J('gx', 'gy')} n_3g,
round(1-levenshtein(nb,s1_nb)::DOUBLE/greatest(length(nb),length(s1_nb),1),6) n_lev, {_J('ax', 'ay')} a_jacc, CASE WHEN px IS NOT NULL OR py IS NOT NULL THEN {_J('coalesce(px,[])', 'coalesce(py,[])')} END a_num_eq, (px[1]=py[1])::INT a_first_num_eq, (ab='')::INT b_addr_missing FROM e""")
def pair_similarities(spark, sf_dir):
    """Similarities of names and addresses of candidate pairs."""
    r = records(spark, sf_dir)
    p = scored(spark, sf_dir).select("rid", "s1", "nb", "s1_nb", "nc", "s1_nc", "num", "s1_num", "noaddr")
    p = p.join(r.select(F.col("entity_id").alias("rid"), "ab"), "rid").join(r.select(F.col("entity_id").alias("s1"), F.col("ab").alias("s1_ab")), "s1")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    union = lambda a, b: F.size(F.array_union(a, b))
    jaccard = lambda a, b: F.when(union(a, b) > 0, F.round(F.size(F.array_intersect(a, b)) / union(a, b), 6)).otherwise(0.0)
    i = lambda c: c.cast("int")
    g = lambda c: F.when(F.char_length(c) > 0, T.trigrams(F.col(c), spaces=True)).otherwise(F.array().cast("array<string>"))
    a, b = words("num"), words("s1_num")
    return p.select(
        "rid", "s1", i(F.col("nb") == F.col("s1_nb")).alias("norm_eq"), i((F.col("nc") == F.col("s1_nc")) & (F.col("nc") != "")).alias("core_eq"),
        i(F.array_sort(F.array_distinct(words("nb"))) == F.array_sort(F.array_distinct(words("s1_nb")))).alias("tokset_eq"), jaccard(words("nb"), words("s1_nb")).alias("n_jacc"), jaccard(words("nc"), words("s1_nc")).alias("n_core_jacc"), jaccard(g("nb"), g("s1_nb")).alias("n_3g"),
        F.round(1 - F.levenshtein("nb", "s1_nb") / F.greatest(F.char_length("nb"), F.char_length("s1_nb"), F.lit(1)), 6).alias("n_lev"), jaccard(words("ab"), words("s1_ab")).alias("a_jacc"),
        F.when((F.size(a) > 0) | (F.size(b) > 0), jaccard(a, b)).alias("a_num_eq"), i(F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1))).alias("a_first_num_eq"), i(F.col("noaddr")).alias("b_addr_missing"),
    )


def _copies(spark, sf_dir):
    """References and records whose address begins with a number of their own, as the tables' texts have few; a record
    shares the number of the reference of the next lower id, and stands for its true record."""
    n = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("bigint")
    s, r = ((df.withColumn("ab", F.concat_ws(" ", (F.floor(n / 3) * 7 % 997 + 1).cast("string"), "ab"))) for df in sides(spark, sf_dir))
    truth = s.select(F.col("entity_id").alias("s1"), F.floor(n / 3).alias("k")).join(r.select(F.col("entity_id").alias("rid"), F.floor(n / 3).alias("k")), "k").select("s1", "rid")
    return s, r, truth


@query()
def synth_decoy_records(spark, sf_dir):
    s, r, truth = _copies(spark, sf_dir)
    return synthesize.decoy_records(s, r, truth)


@query()
def synth_retrieval(spark, sf_dir):
    """Candidates of decoy records from the real index, and whether the first one is the decoy's parent."""
    s, r, truth = _copies(spark, sf_dir)
    d = synthesize.decoy_records(s, r, truth)
    with_sk = lambda df: df.withColumn("sk", T.skeleton(F.col("nb")))
    c = retrieval.candidates(with_sk(d), with_sk(s), 5, 5, 0.6, 200, 100)
    return c.join(d.select(F.col("entity_id").alias("rid"), "parent_s1"), "rid").select("rid", "s1", "p_rank", "f_rank", (F.col("s1") == F.col("parent_s1")).alias("is_parent"))
