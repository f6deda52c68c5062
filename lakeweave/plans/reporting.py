"""Profiling, learning and relational queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeweave.functions import text as T
from lakeweave.operators import model, synthesize, transliterate
from lakeweave.plans.linkage import _SKELETON_WORD as SKELETON_WORD
from lakeweave.plans.views import RECORDS, SCORED, records, scored, sides, table
from lakeweave.sources import tables as IO

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Patterns of names (N) and addresses (A); RE2 and Java read them alike.
FLAGS = {
    "name_upper": ("N", r"^[^a-z]*[A-Z][^a-z]*$"), "name_lower": ("N", r"^[^A-Z]*[a-z][^A-Z]*$"), "name_nonascii": ("N", r"[^\x00-\x7F]"),
    "name_devanagari": ("N", r"[\x{0900}-\x{097F}]"), "name_other_indic": ("N", r"[\x{0980}-\x{0DFF}]"), "name_latin_diacritic": ("N", r"[\x{00C0}-\x{024F}]"),
    "name_domain": ("N", r"(?i)(\.com|\.in|\.net|\.org|\.fr|\.co\b|www\.)"),
    "name_alias_kw": ("N", r"(?i)(f/k/a|\bn[ée]e\b|\bdba\b|d/b/a|\baka\b|a/k/a|formerly|\bt/a\b|trading as|\bex\b)"), "name_id_tag": ("N", r"(?i)\(id:|#\d|\bid\s*\d"),
    "name_prefix_junk": ("N", r"^[^\w\x{0900}-\x{0DFF}\x{00C0}-\x{024F}]"), "name_paren": ("N", r"[()]"), "name_digit": ("N", r"\d"), "name_amp": ("N", r"&"),
    "name_and": ("N", r"(?i)\band\b|\bet\b"), "name_dblspace": ("N", r"  "),
    "addr_None_lit": ("A", r"(?i)^none$|^nan$|^null$|^n/?a$"), "addr_NULL_tok": ("A", r"<NULL>|\bNone\b|\bnan\b"), "addr_upper": ("A", r"^[^a-z]*[A-Z][^a-z]*$"),
    "addr_nonascii": ("A", r"[^\x00-\x7F]"), "addr_indic": ("A", r"[\x{0900}-\x{0DFF}]"), "addr_zip5": ("A", r"\b\d{5}(-\d{4})?\b"), "addr_pin6": ("A", r"\b\d{3}\s?\d{3}\b"),
    "addr_starts_digit": ("A", r"^\d"), "addr_lead_zero": ("A", r"(^|[ ,])0\d+"), "addr_hno_prefix": ("A", r"(?i)\b(h\.?\s?no|hn|door no|block|plot no|flat no|no\.?)\b"),
    "addr_near": ("A", r"(?i)\b(near|opp\.?|opposite|behind|beside|next to|nr\.?)\b"), "addr_unit": ("A", r"(?i)\b(unit|suite|ste|apt|#|pmb|lot|bldg|floor|flr)\b"),
    "addr_fraction": ("A", r"\d 1/2\b"), "addr_trailing_dash_num": ("A", r"\d-\s"), "addr_us_state2_last": ("A", r", [A-Z]{2}$"), "addr_ends_state2": ("A", r"\b[A-Z]{2}$"),
}
#: A word's edges by Unicode letters, as engines differ on what \\b takes for a word.
LEFT, RIGHT = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
FLAGS = {name: (of, re.sub(r"(^|(?<=[|(])|(?<=\(\?i\)))\\b", lambda m: LEFT, p).replace("\\b", RIGHT)) for name, (of, p) in FLAGS.items()}
#: An end that both engines take for the very end of the text: Java's $ also stands before a last line break.
FLAGS = {name: (of, p.replace("$", r"\z")) for name, (of, p) in FLAGS.items()}
#: Flags that are no single pattern: (SQL, column) over the text t.
_OTHER = {
    "name_mixed_script": (r"regexp_matches(t,'[A-Za-z]') AND regexp_matches(t,'[\x{0900}-\x{0DFF}]')", lambda t: t.rlike("[A-Za-z]") & t.rlike(r"[\x{0900}-\x{0DFF}]")),
    "name_legal": (f"regexp_matches(lower(t),'{LEFT}({T.LEGAL}){RIGHT}')", lambda t: F.lower(t).rlike(f"{LEFT}({T.LEGAL}){RIGHT}")),
    "name_repeat_tok": (
        "coalesce(list_contains(list_transform(range(1,len(string_split(lower(t),' '))), lambda i: string_split(lower(t),' ')[i]=string_split(lower(t),' ')[i+1] AND string_split(lower(t),' ')[i]<>''), true),false)",
        lambda t: F.exists(F.zip_with(F.slice(F.split(F.lower(t), " "), 1, F.greatest(F.size(F.split(t, " ")) - 1, F.lit(0))), F.slice(F.split(F.lower(t), " "), 2, 1 << 20), lambda a, b: a.eqNullSafe(b) & (a != "")), lambda x: F.coalesce(x, F.lit(False))),
    ),
    "addr_null": ("t=''", lambda t: t == ""),
}
#: Means beside the flags.
_MEANS = {"mean_chars": ("length(t)", lambda t: F.char_length(t)), "mean_words": ("len(string_split(t,' '))", lambda t: F.size(F.split(t, " "))), "mean_commas": ("length(t)-length(replace(t,',',''))", lambda t: F.char_length(t) - F.char_length(F.replace(t, F.lit(","), F.lit("")))), "mean_digits": ("length(t)-length(regexp_replace(t,'[0-9]','','g'))", lambda t: F.char_length(t) - F.char_length(F.regexp_replace(t, "[0-9]", "")))}
_ALL = [*FLAGS, *_OTHER, *_MEANS]


@query("WITH d AS (SELECT lang, coalesce(text,'') t FROM documents), f AS (SELECT lang, " + ", ".join([*(f"avg(regexp_matches(t, '{p}')::INT) {n}" for n, (_, p) in FLAGS.items()), *(f"avg(({e})::INT) {n}" for n, (e, _) in (_OTHER | _MEANS).items())]) + " FROM d GROUP BY 1) SELECT lang, flag, round(rate,6) rate FROM f UNPIVOT (rate FOR flag IN (" + ", ".join(_ALL) + "))")
def profile_flags(spark, sf_dir):
    """Share of texts with each pattern and means of sizes, by language, one row for each; patterns see the whole text."""
    d = table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")
    wide = d.groupBy("lang").agg(*(F.avg(t.rlike(p).cast("int")).alias(n) for n, (_, p) in FLAGS.items()), *(F.avg(f(t).cast("int")).alias(n) for n, (_, f) in (_OTHER | _MEANS).items()))
    return wide.unpivot("lang", _ALL, "flag", "rate").withColumn("rate", F.round("rate", 6))


@query("SELECT source, count(*) n, count(DISTINCT doc_id) n_id, round(avg((text IS NULL)::INT),6) null_rate, round(count(DISTINCT text)::DOUBLE/count(*),6) distinct_rate, median(n_chars) med, quantile_disc(n_chars,0.95)::BIGINT q95, min(n_chars) lo, max(n_chars) hi FROM documents GROUP BY 1")
def profile_overview(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_id"), F.round(F.avg(F.isnull("text").cast("int")), 6).alias("null_rate"),
        F.round(F.count_distinct("text") / F.count(F.lit(1)), 6).alias("distinct_rate"), F.median("n_chars").alias("med"), F.expr("percentile_disc(0.95) within group (order by n_chars)").cast("long").alias("q95"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"),
    )


@query("WITH c AS (SELECT conv_id, least(count(*) FILTER (role='user'),5) u, least(count(*) FILTER (role<>'user'),5) a FROM conversations GROUP BY 1) SELECT u, count(*) FILTER (a=0) a0, count(*) FILTER (a=1) a1, count(*) FILTER (a=2) a2, count(*) FILTER (a=3) a3, count(*) FILTER (a=4) a4, count(*) FILTER (a=5) a5 FROM c GROUP BY 1")
def cardinality_crosstab(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.least(F.count_if(F.col("role") == "user"), F.lit(5)).alias("u"), F.least(F.count_if(F.col("role") != "user"), F.lit(5)).alias("a"))
    p = c.groupBy("u").pivot("a", list(range(6))).count().na.fill(0)
    return p.select("u", *(F.col(str(k)).alias(f"a{k}") for k in range(6)))


_REL = SCORED + """, r AS (SELECT CASE WHEN nc='' OR s1_nc='' THEN 'empty' WHEN nb=s1_nb THEN 'equal' WHEN nc=s1_nc THEN 'core' WHEN replace(nc,' ','')=replace(s1_nc,' ','') THEN 'nospace'
 WHEN list_sort(string_split(nc,' '))=list_sort(string_split(s1_nc,' ')) THEN 'reordered' WHEN starts_with(nc,s1_nc) OR starts_with(s1_nc,nc) THEN 'prefix' WHEN levenshtein(nc,s1_nc)<=2 THEN 'typo' ELSE 'other' END rel, prob FROM scored)"""


@query(_REL + " SELECT rel, count(*) n, round(count(*)::DOUBLE/sum(count(*)) OVER (),6) share, round(avg(prob),5) p FROM r GROUP BY 1")
def name_relation_categories(spark, sf_dir):
    ns = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    words = lambda c: F.array_sort(F.split(c, " "))
    a, b = F.col("nc"), F.col("s1_nc")
    rel = F.when((a == "") | (b == ""), "empty").when(F.col("nb") == F.col("s1_nb"), "equal").when(a == b, "core").when(ns(a) == ns(b), "nospace").when(words(a) == words(b), "reordered").when(a.startswith(b) | b.startswith(a), "prefix").when(F.levenshtein(a, b) <= 2, "typo").otherwise("other")
    n = scored(spark, sf_dir).select(rel.alias("rel"), "prob").groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prob"), 5).alias("p"))
    return n.select("rel", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), "p")


@query(SCORED + ", t AS (SELECT unnest(list_filter(string_split(s1_nc,' '), lambda x: NOT list_contains(string_split(nc,' '),x))) tok FROM scored) SELECT tok, count(*) n FROM t WHERE tok<>'' GROUP BY 1 ORDER BY n DESC, tok LIMIT 30")
def dropped_tokens_top(spark, sf_dir):
    t = scored(spark, sf_dir).select(F.explode(F.filter(F.split("s1_nc", " "), lambda x: ~F.array_contains(F.split("nc", " "), x))).alias("tok"))
    return t.filter("tok <> ''").groupBy("tok").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tok").limit(30)


_PICK = "(('0x'||substr(md5(c_custkey::VARCHAR||'|{}'),1,8))::BIGINT % {})"
_D = {k: _PICK.format(k, n) for k, n in {"pick": 100, "variant": 100, "step": 20, "sign": 2, "digit": 9, "kind": 10}.items()}


@query(f"""WITH c AS (SELECT c_custkey, c_custkey*7%1000+1 num FROM customer WHERE {_D['pick']}<55),
m AS (SELECT c_custkey, num, {_D['step']}+1 step, {_D['sign']} sg, {_D['digit']} dg, {_D['kind']} kd, {_D['variant']} v FROM c)
SELECT c_custkey, 9000000000+c_custkey*40+c_custkey%40 decoy_id, CASE WHEN v<60 THEN 'num' WHEN v<85 THEN 'num+legal' ELSE 'num+word' END kind, num,
CASE WHEN kd<7 OR num<10 THEN CASE WHEN sg=0 OR num<=step THEN num+step ELSE num-step END ELSE num-num%10+(num%10+1+dg)%10 END decoy_number FROM m""")
def synth_decoys(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 1000 + 1).alias("num"))
    return synthesize.decoys(c, "c_custkey", "num")


_ALIGN = SCORED + """, w AS (SELECT string_split(nc,' ') x, string_split(s1_nc,' ') y FROM scored WHERE len(string_split(nc,' '))=len(string_split(s1_nc,' '))),
z AS (SELECT unnest(x) tok, unnest(y) eng FROM w), al_n AS (SELECT tok, eng, count(*) n FROM z WHERE tok<>eng AND tok<>'' AND eng<>'' GROUP BY 1,2),
al_s AS (SELECT *, round(n::DOUBLE/sum(n) OVER (PARTITION BY tok),6) share, row_number() OVER (PARTITION BY tok ORDER BY n DESC, eng) r FROM al_n), al AS (SELECT tok, eng, n, share FROM al_s WHERE r=1 AND n>=2 AND share>=0.3)"""


@query(_ALIGN + " SELECT * FROM al")
def translit_align(spark, sf_dir):
    return transliterate.align(scored(spark, sf_dir).select(F.col("nc").alias("a"), F.col("s1_nc").alias("b")), 2, 0.3)


_FILL = _ALIGN + f""", refs AS (SELECT eng, count(*) n FROM (SELECT unnest(string_split(nc,' ')) eng FROM recs WHERE src='S1') GROUP BY 1 HAVING count(*)>=2 AND regexp_full_match(eng,'[a-z]{{3,}}')),
best AS (SELECT sk, eng FROM (SELECT eng, n, {SKELETON_WORD.replace('(x', '(eng')} sk FROM refs) QUALIFY row_number() OVER (PARTITION BY sk ORDER BY n DESC, eng)=1),
new AS (SELECT DISTINCT tok FROM (SELECT unnest(string_split(nc,' ')) tok FROM recs WHERE src<>'S1') WHERE tok<>'' AND tok NOT IN (SELECT tok FROM al)),
fill AS (SELECT tok, eng FROM (SELECT tok, {SKELETON_WORD.replace('(x', '(tok')} sk FROM new) JOIN best USING(sk) WHERE length(sk)>=3 AND tok<>eng)
SELECT tok, eng, 1 layer FROM al UNION ALL SELECT tok, eng, 2 FROM fill"""


@query(_FILL)
def translit_skeleton_fill(spark, sf_dir):
    s, r = sides(spark, sf_dir)
    known = transliterate.align(scored(spark, sf_dir).select(F.col("nc").alias("a"), F.col("s1_nc").alias("b")), 2, 0.3)
    words = lambda df, name: df.select(F.explode(F.split("nc", " ")).alias(name)).filter(f"{name} <> ''")
    return transliterate.merged(known, transliterate.fill_by_skeleton(words(r, "tok"), words(s, "eng"), known, 2))


def _model_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), F.col("n_chars"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("symbols"), F.regexp_count("text", F.lit(r"[A-Z]")).alias("upper"), (F.col("doc_id") % 5 == 0).alias("valid"))


@query()
def gbt_train_score(spark, sf_dir):
    rows, columns = _model_rows(spark, sf_dir), ["n_chars", "symbols", "upper"]
    fitted = model.train(rows, columns, "y", 10, 4, "valid")
    return model.score(fitted, rows, columns).select("doc_id", "y", F.round("prob", 6).alias("prob"))


@query()
def cascade_prefilter(spark, sf_dir):
    rows, columns = _model_rows(spark, sf_dir), ["n_chars", "symbols", "upper"]
    cheap, full = model.train(rows, columns[:1], "y", 3, 2), model.train(rows, columns, "y", 5, 4)
    return model.cascade(cheap, full, rows, columns[:1], columns, 0.5).select("doc_id", F.round("prob", 6).alias("prob"))


@query("SELECT doc_id, replace(replace(coalesce(text,''), chr(10), ' '), chr(13), ' ') t FROM documents WHERE text IS NOT NULL AND text<>''")
def tsv_roundtrip(spark, sf_dir):
    path = f"{IO.shared_dir(spark)}/tsv-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").filter("text is not null and text <> ''").select("doc_id", F.translate("text", "\n\r", "  ").alias("t"))
    IO.write_tsv(d, path)
    return IO.read_tsv(spark, path, "doc_id bigint, t string")


@query("SELECT o_orderpriority, o_orderstatus, count(*) n, count(*) FILTER (o_totalprice>100000) big, round(avg(o_totalprice),4) mean, min(o_totalprice) lo, max(o_totalprice) hi, count(DISTINCT o_custkey) custs FROM orders GROUP BY 1,2")
def aggregates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("big"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count_distinct("o_custkey").alias("custs"))


@query("SELECT n_name, c_mktsegment, count(*) n, round(count(*)::DOUBLE/sum(count(*)) OVER (PARTITION BY n_name),6) share FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2")
def value_counts_share(spark, sf_dir):
    n = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("n_name")), 6))


@query("SELECT c_custkey, o.n IS NOT NULL has, coalesce(o.n,0) n FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) o ON o_custkey=c_custkey")
def left_join_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", F.col("n").isNotNull().alias("has"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT 'semi' kind, count(*) n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'anti', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'full', count(*) FROM (SELECT coalesce(d.doc_id,l.doc_id+5) FROM documents d FULL JOIN labels l ON d.doc_id=l.doc_id+5)")
def semi_anti_joins(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(d.join(l, "doc_id", "left_semi"), "semi").unionByName(n(d.join(l, "doc_id", "left_anti"), "anti")).unionByName(n(d.join(l.select((F.col("doc_id") + 5).alias("doc_id")), "doc_id", "full"), "full"))


@query("SELECT doc_id, lang, NULL::VARCHAR url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def union_diagonal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"), allowMissingColumns=True)


@query("WITH e AS (SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) r, round(value-max(value) OVER (PARTITION BY event_type),6) gap FROM events) SELECT * FROM e WHERE r<=3")
def window_topk(spark, sf_dir):
    w = Window.partitionBy("event_type")
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "value", F.row_number().over(w.orderBy(F.desc("value"), "event_id")).alias("r"), F.round(F.col("value") - F.max("value").over(w), 6).alias("gap"))
    return e.filter("r <= 3")


@query("SELECT item_id, pos::INT pos, w FROM (SELECT item_id, unnest(string_split(text,' ')) w, unnest(range(1,len(string_split(text,' '))+1)) pos FROM benchmark)")
def explode_positions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "w")).withColumn("pos", F.col("pos") + 1)


@query(f"""WITH {RECORDS}, s AS (SELECT entity_id, row_number() OVER (ORDER BY md5(entity_id||'a'), entity_id) k FROM recs WHERE src='S1'), r AS (SELECT entity_id, row_number() OVER (ORDER BY md5(entity_id||'b'), entity_id) k FROM recs WHERE src<>'S1')
SELECT s.entity_id s1, r.entity_id rid FROM s JOIN r USING(k) WHERE k<=50""")
def random_negative_zip(spark, sf_dir):
    """50 random pairs: two seeded samples laid side by side; only top-50 lists are numbered."""
    def top(df, salt, name):
        some = df.select(F.col("entity_id").alias(name), F.md5(F.concat("entity_id", F.lit(salt))).alias("h")).orderBy("h", name).limit(50)
        return some.select(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("h", name)).alias("k"))

    s, r = sides(spark, sf_dir)
    return top(s, "a", "s1").join(top(r, "b", "rid"), "k").select("s1", "rid")


@query(f"WITH {RECORDS} SELECT entity_id, list_contains(list_transform(range(1,len(string_split(nb,' '))), lambda i: string_split(nb,' ')[i]=string_split(nb,' ')[i+1]), true) repeats FROM recs")
def repeated_adjacent_token(spark, sf_dir):
    w = F.split("nb", " ")
    return records(spark, sf_dir).select("entity_id", F.exists(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, 1 << 20), lambda a, b: a.eqNullSafe(b)), lambda x: x).alias("repeats"))


_SOURCES = [f"src{k}" for k in range(20)]


@query("SELECT lang, " + ", ".join(f"(sum(n_chars) FILTER (source='{x}'))::BIGINT {x}" for x in _SOURCES) + " FROM documents GROUP BY 1")
def pivot_sources(spark, sf_dir):
    """A column for each source; naming them spares a pass that would find them."""
    return table(spark, sf_dir, "documents").groupBy("lang").pivot("source", _SOURCES).agg(F.sum("n_chars"))


@query("SELECT arg_max(t, f) best_t, max(f) best_f FROM (SELECT discount t, round(avg(l_extendedprice),4) f FROM (SELECT l_discount discount, l_extendedprice FROM lineitem) GROUP BY 1)")
def best_threshold(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_discount").alias("t")).agg(F.round(F.avg("l_extendedprice"), 4).alias("f"))
    return f.agg(F.max_by("t", "f").alias("best_t"), F.max("f").alias("best_f"))
