"""The assembled feature table of candidate pairs, and the SQL of those of its columns that SQL can express.

A record's name as written is the first six pieces of its document's text, parted by single spaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import text as T
from lakeweave.operators import assemble, features, postings, retrieval
from lakeweave.plans import linkage as L
from lakeweave.plans.views import RECORDS, SCORED, derived, records, scored, sides, table

QUERIES, SQL = {}, {}


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, name): what stands before the sixth space is six pieces; no text is split as a whole."""
    raw = F.substring_index(F.coalesce("text", F.lit("")), " ", 6)
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("S"), F.col("doc_id") % 3 + 1, F.lit("-"), F.col("doc_id")).alias("entity_id"), raw.alias("name"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = _names(spark, sf_dir)
    s, r = (df.withColumn("sk", T.skeleton(F.col("nb"))).join(names, "entity_id") for df in sides(spark, sf_dir))
    return s, r


def _own(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What a pair's features need of one record, references and queries, from a stage table: names as written are not joined
    with addresses, nor in each branch of the plan."""

    def make() -> DataFrame:
        r = records(spark, sf_dir).withColumn("sk", T.skeleton(F.col("nb")))
        names = _names(spark, sf_dir).select("entity_id", *assemble.of_name())
        return r.select("entity_id", "country", "src", *assemble.of_record()).join(names, "entity_id")

    own = derived(spark, sf_dir, "own", make)
    return own.filter("src = 'S1'"), own.filter("src <> 'S1'")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of both indexes, a stage table: every feature starts from it."""

    def make() -> DataFrame:
        s, r = (df.withColumn("sk", T.skeleton(F.col("nb"))) for df in sides(spark, sf_dir))
        return retrieval.candidates(r, s, 5, 5, 0.6, 200, 100)

    return derived(spark, sf_dir, "merged", make)


def _table(spark: SparkSession, sf_dir: str, similarities: bool) -> DataFrame:
    """Written in three steps, so that no plan holds all of it: what the records of a pair say of it, with the name tokens
    that only one has; the overlaps; the log odds."""
    cands, (s, r), (s_own, r_own) = merged(spark, sf_dir), sides(spark, sf_dir), _own(spark, sf_dir)
    pairs = L.labelled_diffs(spark, sf_dir, assemble.joined(cands, r_own, s_own, similarities), "q_nc", "s_nc")
    pairs = postings.put(pairs.drop("q_nc", "s_nc", "true_s1"), "joined")
    odds = features.log_odds_looked_up(pairs, postings.put(features.log_odds(pairs.filter("p_rank = 0 and fold >= 6")), "log-odds"))
    spaces = {name: (tokens(), with_nq) for name, (tokens, _, with_nq) in L.SPACES.items()}
    overlaps = features.overlaps_in_blocks(cands.select("rid", "s1"), r, s, spaces)
    return assemble.with_overlaps(pairs.drop("y", "fold", "extra", "miss"), overlaps, odds)


def feat_pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 87 features of every candidate pair."""
    return _table(spark, sf_dir, True)


def feat_pair_table_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without string similarities (and what compares them within a query), in the JVM alone."""
    return _table(spark, sf_dir, False)


def _space(name: str, tokens: str) -> str:
    idf = "ln((n+1)::DOUBLE/(coalesce(df,0)+1))"
    return f"""{name}_t AS (SELECT DISTINCT entity_id, country, src, unnest({tokens}) t FROM recs),
{name}_df AS (SELECT country, t, count(*) df FROM {name}_t WHERE src='S1' GROUP BY 1,2),
{name}_w AS (SELECT entity_id, t, {idf}*{idf} w FROM {name}_t LEFT JOIN {name}_df USING(country,t) JOIN ref_n USING(country)),
{name}_sum AS (SELECT entity_id, sum(w) w, count(*) n FROM {name}_w GROUP BY 1),
{name}_both AS (SELECT c.rid, c.s1, sum(a.w) w, count(*) n FROM c JOIN {name}_w a ON a.entity_id=c.rid JOIN {name}_w b ON b.entity_id=c.s1 AND b.t=a.t GROUP BY 1,2),
{name}_j AS (SELECT c.rid, c.s1, coalesce(q.w,0) wq, coalesce(d.w,0) wd, coalesce(h.w,0) wb, coalesce(h.n,0) ns, coalesce(q.n,0) nq, coalesce(d.n,0) nd
  FROM c LEFT JOIN {name}_sum q ON q.entity_id=c.rid LEFT JOIN {name}_sum d ON d.entity_id=c.s1 LEFT JOIN {name}_both h ON h.rid=c.rid AND h.s1=c.s1),
{name}_f AS (SELECT rid, s1, CASE WHEN wq>0 THEN round(wb/wq,6) END {name}_cq, CASE WHEN wd>0 THEN round(wb/wd,6) END {name}_cd,
  CASE WHEN wq>0 AND wd>0 THEN round(wb/sqrt(wq*wd),6) END {name}_cos, ns {name}_ns, nq-ns {name}_extra, nd-ns {name}_miss, nq {name}_nq FROM {name}_j)"""


_FLAGS = f"regexp_matches(name,'{assemble.NON_ASCII}')::INT nonascii, regexp_matches(name,'{assemble.DOMAIN}')::INT domain, regexp_matches(name,'{assemble.ALIAS}')::INT alias"
_COMPARED = [c for c in assemble.CONTEXT if c != "n_tsr"]
_UNCOUNTED = [f"{name}_nq" for name, (_, _, with_nq) in L.SPACES.items() if not with_nq]
_NATIVE_SQL = f"""WITH {RECORDS}, {L._TRUTH}, c AS ({L.SQL['retrieve_adaptive_merge']}),
names AS (SELECT 'S'||(doc_id%3+1)||'-'||doc_id entity_id, array_to_string(string_split(coalesce(text,''),' ')[1:6],' ') AS name FROM documents),
own AS (SELECT entity_id, country, src, nc, replace(nc,' ','') ncns, {L._SKELETON} sk, list_filter(string_split(num,' '), lambda x: x<>'') numbers,
  nullif(regexp_extract(ab,'{assemble.STATE}'),'') state, {_FLAGS}, length(name) rawlen, (ab='')::INT noaddr,
  count(*) OVER (PARTITION BY src='S1', country, nc) nc_dup, count(*) OVER (PARTITION BY src='S1', country, ab) ab_dup FROM recs JOIN names USING(entity_id)),
ref_n AS (SELECT country, count(*) n FROM recs WHERE src='S1' GROUP BY 1),
{", ".join(_space(name, tokens) for name, (_, tokens, _) in L.SPACES.items())},
v AS (SELECT rid||'|'||s1 k, a.numbers qs, b.numbers ds FROM c JOIN own a ON a.entity_id=rid JOIN own b ON b.entity_id=s1), {L.NUMBER_CTES}, nm AS (SELECT k, {L.NUMBER_COLUMNS} FROM f),
one AS (SELECT rid, min(s1) true_s1 FROM truth GROUP BY 1),
df0 AS (SELECT c.rid, c.s1, p_rank, coalesce(c.s1=true_s1,false)::INT y, substr(coalesce(true_s1,c.rid),4)::BIGINT%40 fold, {L._ONLY.format(a='a.nc', b='b.nc')} extra, {L._ONLY.format(a='b.nc', b='a.nc')} miss
  FROM c JOIN own a ON a.entity_id=c.rid JOIN own b ON b.entity_id=c.s1 LEFT JOIN one ON one.rid=c.rid),
learn AS (SELECT * FROM df0 WHERE p_rank=0 AND fold>=6), {L._SIDE.format(s='extra')}, {L._SIDE.format(s='miss')}, lo AS (SELECT * FROM extra_lo FULL JOIN miss_lo USING(tok)), {L._AGG.format(s='extra')}, {L._AGG.format(s='miss')},
whole AS (SELECT c.*, a.nonascii q_nonascii, a.domain q_domain, a.alias q_alias, a.rawlen q_rawlen, b.rawlen s_rawlen, a.noaddr q_noaddr, b.nc_dup s_nc_dup, b.ab_dup s_ab_dup,
  (a.nc=b.nc)::INT n_eq, (a.sk=b.sk)::INT sk_eq, (a.ncns=b.ncns)::INT nns_eq, (a.state=b.state)::INT state_eq, (c.rid LIKE 'S3%')::INT is_s3, (f_rank<99)::INT by_fallback, (p_rank<99)::INT by_primary,
  nm.* EXCLUDE (k), {", ".join(f"{name}_f.* EXCLUDE (rid, s1)" for name in L.SPACES)}, extra_a.* EXCLUDE (rid, s1), miss_a.* EXCLUDE (rid, s1)
  FROM c JOIN own a ON a.entity_id=c.rid JOIN own b ON b.entity_id=c.s1 JOIN nm ON nm.k=c.rid||'|'||c.s1 {" ".join(f"JOIN {name}_f ON {name}_f.rid=c.rid AND {name}_f.s1=c.s1" for name in L.SPACES)}
  LEFT JOIN extra_a ON extra_a.rid=c.rid AND extra_a.s1=c.s1 LEFT JOIN miss_a ON miss_a.rid=c.rid AND miss_a.s1=c.s1)
SELECT * EXCLUDE ({", ".join(_UNCOUNTED)}), count(*) OVER w n_cand, {", ".join(f"round({x}-max({x}) OVER w,6) {x}_gapmax, rank() OVER (PARTITION BY rid ORDER BY {x} DESC NULLS LAST) {x}_rk" for x in _COMPARED)}
FROM whole WINDOW w AS (PARTITION BY rid)"""

def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs with names and addresses: a the reference's, b the record's."""
    s, r = _sides(spark, sf_dir)
    of = lambda df, key, p: df.select(F.col("entity_id").alias(key), F.col("name").alias(f"{p}_name"), F.col("nb").alias(f"{p}n"), F.col("nc").alias(f"{p}nc"), F.col("ab").alias(f"{p}a"))
    return scored(spark, sf_dir).select("rid", "s1").join(of(r, "rid", "b"), "rid").join(of(s, "s1", "a"), "s1")


def feat_pair_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the records of candidate pairs look."""
    s, r = sides(spark, sf_dir)
    return features.surface_in_blocks(_looks(spark, sf_dir).drop("aa", "ba"), r, s)


def feat_pair_surface_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy ratios of the same pairs."""
    s, r = sides(spark, sf_dir)
    return features.surface_ratios_in_blocks(_looks(spark, sf_dir).select("rid", "s1", "an", "bn"), r, s)


_W = "list_distinct(list_filter(string_split({0},' '), lambda w: w<>''))"
_G = "CASE WHEN length({0})>0 THEN list_distinct(list_transform(range(1,length({0})+1), lambda i: substring(' '||{0}||' ', i::INT, 3))) ELSE [] END"
_D = "regexp_extract_all({0},'\\d+')"


def _shared(form: str, a: str, b: str) -> str:
    x, y = form.format(a), form.format(b)
    return f"round(len(list_intersect({x},{y}))::DOUBLE/nullif(len(list_distinct(list_concat({x},{y}))),0),6)"


_SURFACE_SQL = f"""{SCORED}, names AS (SELECT 'S'||(doc_id%3+1)||'-'||doc_id entity_id, array_to_string(string_split(coalesce(text,''),' ')[1:6],' ') AS name FROM documents),
p AS (SELECT c.rid, c.s1, x.name a_name, y.name b_name, s1_nb an, nb bn, s1_nc anc, nc bnc, s1_ab aa, ab ba FROM scored c JOIN names x ON x.entity_id=c.s1 JOIN names y ON y.entity_id=c.rid)
SELECT rid, s1, (a_name=b_name)::INT raw_eq, (lower(a_name)=lower(b_name))::INT fold_eq, (an=bn)::INT norm_eq, (anc=bnc AND anc<>'')::INT core_eq, (list_sort({_W.format('an')})=list_sort({_W.format('bn')}))::INT tokset_eq,
coalesce({_shared(_W, 'an', 'bn')},0) n_jacc, coalesce({_shared(_W, 'anc', 'bnc')},0) n_core_jacc, coalesce({_shared(_G, 'an', 'bn')},0) n_3g,
round(1-coalesce(levenshtein(an,bn)::DOUBLE/nullif(greatest(length(an),length(bn)),0),0),6) n_lev, round(CASE WHEN an=bn THEN 1 WHEN an='' OR bn='' THEN 0 ELSE jaro_winkler_similarity(an,bn) END,6) n_jw,
coalesce({_shared(_W, 'aa', 'ba')},0) a_jacc, coalesce({_shared(_G, 'aa', 'ba')},0) a_3g, {_shared(_D, 'aa', 'ba')} a_num_eq,
(nullif(regexp_extract(aa,'\\d+'),'')=nullif(regexp_extract(ba,'\\d+'),''))::INT a_first_num_eq, (ba='')::INT b_addr_missing FROM p"""

QUERIES["feat_pair_table"] = feat_pair_table
QUERIES["feat_pair_table_native"] = feat_pair_table_native
SQL["feat_pair_table_native"] = _NATIVE_SQL
QUERIES["feat_pair_surface"] = feat_pair_surface
QUERIES["feat_pair_surface_ratios"] = feat_pair_surface_ratios
SQL["feat_pair_surface"] = _SURFACE_SQL
