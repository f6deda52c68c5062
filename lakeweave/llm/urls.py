"""URL filters by a path-template tree; DataFrame functions only.

Rules judge the URLs that they fit, and label them. For each host a tree of path templates is built from the root down:
segments that look like identifiers, and those of a node with too many rarely visited children, become one wildcard;
labelled sibling branches next to each other in the order of their block rates are merged where the rates do not differ
significantly. A template's block rate is smoothed towards its parent's, from the rate of all labelled URLs above the
root, so a branch with few labels of its own is judged by the nearest one that has more. A URL that no rule fits is
blocked if its template's smoothed rate is REJECT_RATE or more.

The tree is built over counts by (host, generalised path), not over URLs, so a host with a third of all URLs is
aggregated before it is shuffled. A stretch that all paths of a node share is passed in one step, with the smoothing of
its levels in closed form, so there are as many rounds as a path has branchings, however deep it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import Stages, col, fresh, without

#: Children of a node beyond which rare ones are a wildcard, and the mean number of URLs that makes a child rare.
MANY_CHILDREN, RARE = 50, 3.0
#: Least labels of a branch for the test of similarity, critical value of the test, weight of the parent's rate in
#: smoothing, and the smoothed rate of rejection.
LEAST_LABELS, CRITICAL_Z, PRIOR_WEIGHT, REJECT_RATE = 5, 1.96, 4.0, 0.9
#: Siblings are put in order of rate by steps of one in so many: a node has no more steps than that, whatever its children.
RATE_STEPS = 40

_IDENTIFIER = r"^(\d[\d.,_-]*|[0-9a-f]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|[A-Za-z0-9_-]*\d{3,}[A-Za-z0-9_-]*)(\.[A-Za-z]{1,5})?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is between the first :// and the next / ? # or the end, A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null. rules: ("allow" or "block", host/path).

    A rule fits its host and all its subdomains where the path starts with the rule's. Longest is by characters of the
    whole rule, then by the longer host, then by name.
    """
    out = None
    order = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/") if "/" in r[1] else -len(r[1]), r[1]))
    for verdict, rule in order:
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _generalised(path: Column) -> Column:
    """The path's segments, identifiers as *."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(_IDENTIFIER), F.lit("*")).otherwise(s))


def _smoothed(blocked: Column, labelled: Column, rate: Column) -> Column:
    return (blocked + PRIOR_WEIGHT * rate) / (labelled + PRIOR_WEIGHT)


def _past_shared(nodes: DataFrame) -> DataFrame:
    """Passes the segments that all paths of a node begin with: m levels of one child each, whose smoothed rate tends
    from the node's to the labels' own by the factor w / (labels + w) a level."""
    ends = nodes.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    unequal = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    m = F.when(unequal > 0, unequal - 1).otherwise(F.size("lo")).cast("int")
    ends = ends.select("host", "template", F.slice("lo", F.lit(1), m).alias("shared"), m.alias("m"), "l", "b")
    own = F.col("b") / F.col("l")
    rate = F.when(F.col("l") > 0, own + (F.col("rate") - own) * F.pow(PRIOR_WEIGHT / (F.col("l") + PRIOR_WEIGHT), F.col("m"))).otherwise(F.col("rate"))
    template = F.when(F.col("m") > 0, F.concat("template", F.lit("/"), F.array_join("shared", "/"))).otherwise(F.col("template"))
    out = nodes.join(ends, ["host", "template"]).withColumns({"rate": rate, "named": template, "rest": F.slice("rest", F.col("m") + 1, F.size("rest") + 1)})
    return out.withColumn("template", F.col("named")).drop("named", "shared", "m", "l", "b")


def _merged(child: DataFrame) -> DataFrame:
    """child: host, template, seg, l, b. Names of the branches that are merged: host, template, seg, alike."""
    fit = child.filter(F.col("l") >= LEAST_LABELS).withColumn("step", F.round(RATE_STEPS * F.col("b") / F.col("l")))
    steps = fit.groupBy("host", "template", "step").agg(F.sum("l").alias("sl"), F.sum("b").alias("sb"), F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("host", "template").orderBy("step")  # RATE_STEPS + 1 rows at most
    l1, b1, l2, b2 = F.lag("sl").over(order), F.lag("sb").over(order), F.col("sl"), F.col("sb")
    pooled = (b1 + b2) / (l1 + l2)
    z = F.abs(b1 / l1 - b2 / l2) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / l1 + 1 / l2))
    steps = steps.withColumn("new", F.when(z < CRITICAL_Z, 0).otherwise(1)).withColumn("g", F.sum("new").over(order))
    whole = Window.partitionBy("host", "template", "g")
    steps = steps.withColumns({"members": F.sum("k").over(whole), "least": F.min("step").over(whole)}).filter("members > 1")
    name = F.concat(F.lit("~"), F.format_number(100 * F.col("least") / RATE_STEPS, 1))
    return fit.join(steps.select("host", "template", "step", name.alias("alike")), ["host", "template", "step"]).select("host", "template", "seg", "alike")


def templates(stages: Stages, counts: DataFrame) -> DataFrame:
    """counts: host, parts (array), n, labelled, blocked, one row for each host and parts. Adds template and rate.

    A statistic of a node's children is an aggregate joined back by node, so a node with millions of children needs no
    task that holds them all. Merged branches are named ~ and the least block rate among them, in per cent.
    """
    prior = counts.agg((F.sum("blocked") + 1.0) / (F.sum("labelled") + 2.0)).first()[0]
    prior = 0.5 if prior is None else float(prior)
    root = counts.groupBy("host").agg(_smoothed(F.sum("blocked"), F.sum("labelled"), F.lit(prior)).alias("rate"))
    nodes = counts.withColumns({"template": F.lit(""), "rest": F.col("parts")}).join(root, "host")
    done = None
    while True:
        nodes = stages.put(_past_shared(nodes))
        ended = nodes.filter(F.size("rest") == 0).drop("rest")
        done = ended if done is None else done.unionByName(ended)
        nodes = nodes.filter(F.size("rest") > 0).withColumn("seg", F.col("rest")[0])
        if nodes.isEmpty():
            return done
        child = stages.put(nodes.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b")))
        parent = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"))
        wild = (F.col("children") > MANY_CHILDREN) & (F.col("n") < RARE * F.col("all_n") / F.col("children")) & (F.col("all_n") < RARE * F.col("children"))
        both = child.join(parent, ["host", "template"]).withColumn("wild", wild | (F.col("seg") == "*"))
        # the wildcard is one branch, and like any other may be merged
        named = both.select("host", "template", "seg", F.when(F.col("wild"), F.lit("*")).otherwise(F.col("seg")).alias("name"), "l", "b")
        branch = named.groupBy("host", "template", "name").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
        alike = _merged(branch.withColumnRenamed("name", "seg")).withColumnRenamed("seg", "name")
        named = named.join(alike, ["host", "template", "name"], "left").withColumn("name", F.coalesce("alike", "name")).drop("alike")
        rates = named.groupBy("host", "template", "name").agg(F.sum("l").alias("gl"), F.sum("b").alias("gb"))
        named = stages.put(named.select("host", "template", "seg", "name").join(rates, ["host", "template", "name"]))
        nodes = nodes.join(named, ["host", "template", "seg"])
        nodes = nodes.withColumns({
            "rate": _smoothed(F.col("gb"), F.col("gl"), F.col("rate")),
            "template": F.concat("template", F.lit("/"), "name"),
            "rest": F.slice("rest", 2, F.size("rest")),
        }).drop("name", "gl", "gb", "seg")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """Adds host, path, rule (null where none fits), verdict (allow or block), template and block_rate (the template's
    smoothed rate). Columns of these names are replaced, other columns stay whatever their names.

    A null URL or one without :// has an empty host and path, fits no rule and belongs to the empty host's root.
    Repeated URLs count as often as they occur and are judged alike; a rate right at REJECT_RATE blocks; an empty table
    gives an empty one; without any labelled URL nothing but the rules blocks.
    """
    stages = Stages(pages.sparkSession, "urls")
    new = ("host", "path", "rule", "verdict", "template", "block_rate")
    given = without(pages, *(c for c in new if c != url)).columns
    names = fresh(pages, "url_host", "url_path", "url_rule", "url_parts")
    host, path, rule, parts = names
    text = col(url).cast("string")
    rows = pages.withColumns({host: host_of(text), path: path_of(text)})
    rows = rows.withColumns({rule: rule_of(F.col(host), F.col(path), rules), parts: _generalised(F.col(path))})
    label = F.col(f"{rule}.verdict")
    counts = rows.groupBy(F.col(host).alias("host"), F.col(parts).alias("parts")).agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.count_if(label == "block").alias("blocked"))
    tree = templates(stages, stages.put(counts))
    tree = tree.select(F.col("host").alias(host), F.col("parts").alias(parts), F.struct("template", F.round("rate", 6).alias("block_rate")).alias("judged"))
    judged = fresh(rows, "url_judged")[0]
    rows = rows.join(tree.withColumnRenamed("judged", judged), [host, parts], "left")
    rejected = F.col(f"{judged}.block_rate") >= REJECT_RATE
    verdict = F.coalesce(label, F.when(rejected, F.lit("block")).otherwise(F.lit("allow")))
    made = (F.col(host), F.col(path), F.col(f"{rule}.rule"), verdict, F.col(f"{judged}.template"), F.col(f"{judged}.block_rate"))
    return rows.select(*(col(c) for c in given), *(value.alias(name) for name, value in zip(new, made)))
