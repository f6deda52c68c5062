"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over words. Each later model also sees the
log odds of the earlier categories. In training these are out-of-fold predictions, so that a later model meets earlier
probabilities of the quality it will meet on new texts, not those of a model that has seen the very row.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import Stages, col, fresh, release, small_batches

#: Labelled rows in the sample (about as many), words that are features, folds, strength of the ridge penalty.
SAMPLE_ROWS, FEATURES, FOLDS, RIDGE = 12_000, 512, 5, 0.2
#: Labelled texts (copies as one) that a word must be in to be a feature: rarer ones tell texts, not categories.
LEAST_TEXTS = 4
THRESHOLD = 0.35

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


class Rows:
    """Sparse rows of words that occur, beside a few dense columns and the intercept."""

    def __init__(self, lists: list[list[int]], width: int, dense: np.ndarray):
        self.at = np.fromiter((k for own in lists for k in own), np.int64)
        self.row = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
        self.n, self.width, self.dense = len(lists), width, dense

    def take(self, rows: np.ndarray) -> "Rows":
        out, place = object.__new__(Rows), np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        kept = place[self.row] >= 0
        out.at, out.row, out.n, out.width, out.dense = self.at[kept], place[self.row[kept]], len(rows), self.width, self.dense[rows]
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n) + self.dense @ w[self.width : -1] + w[-1]

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.at, v[self.row], self.width), self.dense.T @ v, [v.sum()]])


def logistic(x: Rows, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 200) -> np.ndarray:
    """Weights (the last is the intercept, which is hardly penalised) by limited-memory BFGS."""
    penalty = np.full(x.width + x.dense.shape[1] + 1, ridge)
    penalty[-1] = 1e-6

    def cost(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w)
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum()), x.back(slope) + penalty * w

    w, past = np.zeros(len(penalty)), []
    value, slope = cost(w)
    for _ in range(steps):
        move, kept = slope.copy(), []
        for s, g in reversed(past):
            a = (s @ move) / (s @ g)
            kept.append(a)
            move -= a * g
        move *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(slope).max())
        for (s, g), a in zip(past, reversed(kept)):
            move += s * (a - (g @ move) / (s @ g))
        size = 1.0
        while True:
            new, new_slope = cost(w - size * move)
            if new <= value - 1e-4 * size * (slope @ move) or size < 1e-8:
                break
            size /= 2
        s, g = -size * move, new_slope - slope
        if s @ g > 1e-12:
            past = [*past[-7:], (s, g)]
        done = abs(value - new) <= 1e-7 * max(1.0, abs(value))
        w, value, slope = w + s, new, new_slope
        if done:
            break
    return w


@dataclass
class Chain:
    """words: number of each feature. models: for each category its weights over words, earlier log odds, intercept."""

    categories: list[str]
    words: dict[str, int]
    models: list[np.ndarray]

    def predict(self, texts: Sequence[str | None]) -> np.ndarray:
        """A row of probabilities for each text."""
        lists = [sorted(self.words[w] for w in self.words.keys() & words_of(t)) for t in texts]
        odds = np.zeros((len(lists), 0))
        for model in self.models:
            z = Rows(lists, len(self.words), odds).times(model)
            odds = np.hstack([odds, np.clip(z, -8, 8)[:, None]])
        return 1 / (1 + np.exp(-odds))


def fit(lists: list[list[int]], width: int, labels: np.ndarray, folds: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """One model for each column of labels (nan: not labelled), each fed the earlier columns' out-of-fold log odds."""
    models, odds = [], np.zeros((len(lists), 0))
    for k in range(labels.shape[1]):
        x, y = Rows(lists, width, odds), labels[:, k]
        known = ~np.isnan(y)
        if not known.any() or np.all(y[known] == y[known][0]):  # one class only: its smoothed share
            share = (np.nansum(y) + 0.5) / (known.sum() + 1.0)
            w = np.zeros(width + k + 1)
            w[-1] = np.log(share / (1 - share))
            models.append(w)
            out = np.full(len(lists), w[-1])
        else:
            train_on = lambda rows: logistic(x.take(rows), y[rows], weight[rows])  # noqa: E731, B023
            models.append(train_on(np.flatnonzero(known)))
            out = np.zeros(len(lists))
            for fold in range(FOLDS):
                rest, here = np.flatnonzero(known & (folds != fold)), np.flatnonzero(folds == fold)
                w = train_on(rest) if len(rest) else models[-1]
                out[here] = x.take(here).times(w)
        odds = np.hstack([odds, np.clip(out, -8, 8)[:, None]])
    return models


def copy_key(words: Sequence[str]) -> str:
    """Equal for texts that are mostly copies: the eight least hashes of their words."""
    return "-".join(f"{h:x}" for h in heapq.nsmallest(8, (xxhash.xxh3_64_intdigest(w) for w in words)))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], key: str = "doc_id", text: str = "text") -> Chain:
    """docs: key and text; labels: key and one 0/1 column for each category (null: not labelled), in chain order.

    A sample of about SAMPLE_ROWS labelled keys is taken by hash; what is collected of a row are at most FEATURES words.
    Each row of the sample counts; of likely copies each counts by its share, else a copied text's own words would pass
    for signs of its label. Repeated keys in labels count once, with the largest label; repeated rows of docs as copies.
    Words of equal strength are chosen by name. Null texts have no words, null keys no label. Without labels, or with an
    empty table, every probability is the same and no text is rejected.
    """
    spark = docs.sparkSession
    known = labels.filter(col(key).isNotNull()).groupBy(col(key).alias("key")).agg(*(F.max(col(c).cast("double")).alias(f"y{k}") for k, c in enumerate(categories)))
    ys = [f"y{k}" for k in range(len(categories))]
    n = known.count()
    sample = known.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < min(1.0, SAMPLE_ROWS / max(n, 1)) * 1_000_003)
    if sample.count() <= 2 * SAMPLE_ROWS:  # so many keys with two numbers each
        sample = F.broadcast(sample)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
            copy = [copy_key(words) for words in own]
            rest = [batch.column(c) for c in ("fold", *ys)]
            yield pa.RecordBatch.from_arrays([pa.array(copy, pa.string()), *rest, pa.array(own, pa.list_(pa.string()))], names=["copy", "fold", *ys, "words"])
        release()

    schema = "copy string, fold long, " + ", ".join(f"{c} double" for c in ys) + ", words array<string>"
    texts = docs.select(col(key).alias("key"), col(text).cast("string").alias("text")).join(sample, "key")
    stages = Stages(spark, "toxicity")
    split_ = stages.put(texts.select("text", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(FOLDS)).alias("fold"), *ys).mapInArrow(split, schema))
    shares = split_.groupBy("copy").agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    rows = stages.put(split_.join(shares, "copy").drop("copy"))
    stages.drop(split_)
    totals = rows.agg(F.sum("weight").alias("n"), *(F.sum(F.col(c) * F.col("weight")).alias(c) for c in ys)).first()
    counted = rows.select(F.explode("words").alias("word"), "weight", *ys).groupBy("word").agg(F.sum("weight").alias("n"), *(F.sum(F.col(c) * F.col("weight")).alias(c) for c in ys)).filter(F.round("n", 9) >= LEAST_TEXTS)
    counted = stages.put(counted)
    chosen: list[str] = []
    for c in ys:  # the words whose texts differ most from all texts, in standard deviations
        share = ((totals[c] or 0.0) + 0.5) / ((totals["n"] or 0) + 1.0)
        strength = F.abs(F.coalesce(F.col(c), F.lit(0.0)) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
        chosen += [r["word"] for r in counted.orderBy(F.desc(F.round(strength, 9)), "word").limit(FEATURES // len(categories)).collect()]
    words = {w: k for k, w in enumerate(dict.fromkeys(chosen))}
    kept = rows.select("fold", "weight", *ys, F.array_intersect("words", F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")).alias("words")).toPandas()
    stages.drop(rows, counted)
    # in one order whatever the partitions, so that sums come out alike
    lists = [sorted(words[w] for w in own) for own in kept["words"]]
    order = sorted(range(len(lists)), key=lambda k: (lists[k], int(kept["fold"][k]), float(kept["weight"][k])))
    kept = kept.iloc[order]
    models = fit([lists[k] for k in order], len(words), kept[ys].to_numpy(float), kept["fold"].to_numpy(), kept["weight"].to_numpy(float))
    return Chain(list(categories), words, models)


def predict(docs: DataFrame, chain: Chain, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Adds a struct of the categories' probabilities, from the whole text however long. A null or empty text has no
    words and gets what that says; repeated rows get equal answers; a column named `into` is replaced, all others stay
    whatever their names; an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES words and their weights
    schema = ", ".join(f"`{c}` double" for c in chain.categories)

    @F.pandas_udf(schema)
    def run(column):
        import pandas as pd

        return pd.DataFrame(shipped.value.predict(column.tolist()), columns=shipped.value.categories)

    return docs.withColumn(into, run(col(text).cast("string")))


def reject(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents whose probability of the category is below the threshold, with their columns as they are; one right
    at the threshold goes."""
    name = fresh(docs, "toxicity")[0]
    return predict(docs, chain, text, into=name).filter(F.col(name)[category] < threshold).select(*(col(c) for c in docs.columns))
