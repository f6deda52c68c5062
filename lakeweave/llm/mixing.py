"""Mixing to target weights with soft membership; DataFrame functions only.

A classifier trained on a table of labelled documents gives each document a posterior over domains: naive Bayes over
hashed tokens, from the whole text. A document of t tokens thus brings t * p[k] expected tokens to domain k. The
rates r >= least that documents are taken at are fitted by projected gradient descent so that the expected totals
sum(r * t * p[k]) meet the targets in least squares. An iteration is one distributed aggregate of as many sums as there
are domains; only those reach the driver. A document's rate is a function of its posterior and of the iterations'
residuals, so nothing is stored per iteration.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import Stages, col

#: Buckets that tokens are hashed to, and added counts of each bucket in a domain's shares.
BUCKETS, SMOOTHING = 4096, 0.5
#: Labelled rows to train on (about as many), and the tokens that a text counts as in the likelihood, so that posteriors
#: stay soft and long texts are no surer than short ones.
SAMPLE_ROWS, EVIDENCE = 20_000, 12.0
ITERATIONS, TOLERANCE = 60, 1e-4

#: What our own columns' names begin with, beside a table's; see prefix().
OWN = "__mix_"

_SPACES = " \t\n\x0b\x0c\r"


def prefix(docs: DataFrame) -> str:
    """OWN, lengthened until no column of the table begins with it in any case."""
    own = OWN
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    return own


def _buckets(text: Column) -> Column:
    """The bucket of each token in lower case; tokens are parted as words are everywhere here (WORD). An empty text has
    one empty token, which says nothing."""
    words = F.split(F.lower(F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_SPACES))), r"[\x20\x09-\x0D]+")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _n_tokens(text: Column, buckets: Column) -> Column:
    return F.when(F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_SPACES)) == "", 0).otherwise(F.size(buckets)).cast("long")


def _apart(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds columns that later expressions read and do not compute anew at each mention."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def train(docs: DataFrame, labelled: DataFrame, key: str, text: str) -> dict[str, tuple[float, np.ndarray]]:
    """Per domain its log prior and the log share of each bucket among its tokens. labelled: key, domain (nulls ignored).

    The labelled rows are sampled by a hash of the key to about SAMPLE_ROWS. Texts weigh alike, however long they are.
    What comes to the driver is at most BUCKETS numbers for each domain.
    """
    labelled = labelled.filter("key is not null and domain is not null").dropDuplicates(["key", "domain"])
    n = labelled.count()
    sample = labelled.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < min(1.0, SAMPLE_ROWS / max(1, n)) * 1_000_003)
    if sample.count() <= 2 * SAMPLE_ROWS:  # so many keys and names of domains
        sample = F.broadcast(sample)
    rows = docs.select(col(key).alias("key"), col(text).cast("string").alias("text")).join(sample, "key").filter(F.btrim("text", F.lit(_SPACES)) != "").select("domain", _buckets(F.col("text")).alias("b"))
    tokens = rows.select("domain", (F.lit(1.0) / F.size("b")).alias("w"), F.explode("b").alias("b"))
    share = tokens.groupBy("domain", "b").agg(F.sum("w").alias("w")).collect()
    sums: dict[str, np.ndarray] = {}
    for r in share:
        sums.setdefault(r["domain"], np.zeros(BUCKETS))[r["b"]] = r["w"]
    total = sum(float(x.sum()) for x in sums.values())  # each row weighs 1
    smooth = {d: x + SMOOTHING / BUCKETS * max(1.0, float(x.sum())) for d, x in sums.items()}
    return {d: (math.log(float(sums[d].sum()) / total), np.log(smooth[d] / smooth[d].sum())) for d in sorted(sums)}


def featured(docs: DataFrame, model: Mapping[str, tuple[float, np.ndarray]], text: str, own: str) -> DataFrame:
    """Adds n_tokens and the domains' posteriors p0, p1, ... (each named own + name) from whole texts; a null text or
    one without tokens has the prior."""
    k = len(model)
    df = _apart(docs, {own + "b": _buckets(col(text))})
    count = {own + "n_tokens": _n_tokens(col(text), F.col(own + "b"))}
    if not k:
        return _apart(df, count).drop(own + "b")
    # log odds against the first domain; one string literal for each other domain, which folds to an array
    first = next(iter(model.values()))[1]
    tables = [F.split(F.lit(",".join(f"{x:.6f}" for x in shares - first)), ",").cast("array<double>") for _, shares in list(model.values())[1:]]

    def total(table: Column) -> Column:
        return F.aggregate(own + "b", F.lit(0.0), lambda s, b: s + F.get(table, b))

    df = _apart(df, count | {f"{own}log{i}": total(t) for i, t in enumerate(tables, 1)} | {own + "log0": F.lit(0.0)}).drop(own + "b")
    scale = F.when(F.col(own + "n_tokens") > 0, F.lit(EVIDENCE) / F.col(own + "n_tokens")).otherwise(F.lit(0.0))
    df = _apart(df, {f"{own}odds{i}": F.lit(prior) + scale * F.col(f"{own}log{i}") for i, (prior, _) in enumerate(model.values())})
    top = F.greatest(*(F.col(f"{own}odds{i}") for i in range(k))) if k > 1 else F.col(f"{own}odds0")
    df = _apart(df, {own + "top": top})
    df = _apart(df, {f"{own}exp{i}": F.exp(F.col(f"{own}odds{i}") - F.col(own + "top")) for i in range(k)})
    df = _apart(df, {f"{own}p{i}": F.col(f"{own}exp{i}") / sum((F.col(f"{own}exp{j}") for j in range(k)), F.lit(0.0)) for i in range(k)})
    return df.drop(own + "top", *(f"{own}{x}{i}" for x in ("log", "odds", "exp") for i in range(k)))


def fit_rates(rows: DataFrame, domains: list[str], targets: list[float], least: float = 0.0, iterations: int = ITERATIONS, own: str = OWN) -> tuple[Column, list[float]]:
    """rows: n_tokens, p0, p1, ... (each named own + name). Returns the column of rates and the expected totals that it gives.

    Residuals are measured in the norm of the domains' inverse Gram matrix and documents weigh their tokens, so that
    long and short texts of one posterior get one rate. In these norms the gradient's Lipschitz constant is 1, and so is
    the step: without the bound one step reaches the targets, and each further one corrects what the bound cut off.
    Every start is 1. The steps end when the targets are met to TOLERANCE, or the totals stand
    still, which they do where no rates reach the targets; a fit that is still moving after `iterations` warns.
    """
    k = len(domains)
    p, n_tokens = [F.col(f"{own}p{i}") for i in range(k)], F.col(f"{own}n_tokens")
    gram = rows.agg(*(F.sum(n_tokens * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
    g = np.array([[float(gram[f"g{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(k)] for i in range(k)])
    whiten = np.linalg.inv(g + np.eye(k) * max(1e-9, 1e-9 * np.trace(g)))
    slopes: list[Column] = []

    def rates() -> Column:
        """All steps so far, as one fold over their slopes: as many steps make no longer an expression."""
        if not slopes:
            return F.lit(1.0)
        step = lambda r, s: F.greatest(F.lit(float(least)), r - sum((p[i] * s[i] for i in range(1, k)), p[0] * s[0]))
        return F.aggregate(F.array(*slopes), F.lit(1.0), step)

    totals = [0.0] * k
    for step in range(iterations + 1):
        taken = rows.select(*p, (n_tokens * rates()).alias("taken"))
        now = taken.agg(*(F.sum(p[i] * F.col("taken")).alias(f"t{i}") for i in range(k))).first()
        before, totals = totals, [float(now[f"t{i}"] or 0.0) for i in range(k)]
        off = lambda goals: all(abs(t - goal) <= TOLERANCE * max(goal, 1.0) for t, goal in zip(totals, goals))  # noqa: E731, B023
        if off(targets) or off(before):
            break
        if step == iterations:
            warnings.warn(f"rates still move after {iterations} steps: totals {totals}, targets {targets}", stacklevel=2)
            break
        slopes.append(F.array(*(F.lit(x) for x in (whiten @ (np.array(totals) - np.array(targets))).tolist())))
    return rates(), totals


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], tokens: float | None = None, least: float = 0.0, key: str = "doc_id", text: str = "text", with_text: bool = True) -> tuple[DataFrame, list[str], list[float]]:
    """Rates of documents that bring the domains to the target weights.

    labelled: key, domain. weights: of each domain, not negative; they are scaled to sum 1; a labelled domain that has
    none counts as 0. tokens: the total to aim at. By default that is as many tokens as there are, or if least > 0, as
    many as let every domain with a weight keep that share of its tokens.

    Returns (rows, domains, totals): rows are the given ones with all their columns (without the text unless with_text)
    and, each name behind prefix(docs), n_tokens, rate, p0, p1, ... (of each domain, in order); totals are the expected
    tokens of each domain. A null text has no tokens and gets the rate of the prior; rows of equal text get equal rates;
    an empty table, or one without labels, gives rate 1 throughout and no domains.
    """
    stages, own = Stages(docs.sparkSession, "mixing"), prefix(docs)
    model = train(docs, labelled, key, text)
    if not model:
        rows = featured(docs, model, text, own).withColumn(own + "rate", F.lit(1.0))
        return (rows if with_text else rows.drop(text)), [], []
    domains = list(model)
    post = [f"{own}p{i}" for i in range(len(domains))]
    source = docs.select(col(text)) if with_text else docs
    small = featured(source, model, text, own)
    small = stages.put(small.select(*(col(c) for c in small.columns if c != text)))
    share = [weights.get(d, 0.0) / (sum(weights.get(x, 0.0) for x in domains) or 1.0) for d in domains]
    if tokens is None:
        has = [float(x or 0.0) for x in small.agg(*(F.sum(F.col(own + "n_tokens") * F.col(c)) for c in post)).first()]
        tokens = max([least * h / w for h, w in zip(has, share) if w > 0], default=0.0) if least > 0 else sum(has)
    rate, totals = fit_rates(small, domains, [tokens * w for w in share], least, own=own)
    rows = featured(docs, model, text, own) if with_text else small
    return _apart(rows, {own + "rate": rate}), domains, totals


def take(rows: DataFrame, own: str = OWN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of mix() as often as their rates say: the whole part, and once more for as many as the fraction says,
    chosen by a hash of key and text. Only the given columns are left; own is the prefix() of the table given to mix()."""
    rate = F.col(own + "rate")
    chance = F.pmod(F.xxhash64(col(key), col(text), F.lit("mix")), F.lit(1_000_003)) / 1_000_003.0
    copies = (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    out = rows.withColumn(own + "copies", copies).filter(F.col(own + "copies") > 0)
    out = out.withColumn(own + "copy", F.explode(F.sequence(F.lit(1), F.col(own + "copies"))))
    return out.select(*(col(c) for c in out.columns if not c.startswith(own)))
