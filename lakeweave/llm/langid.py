"""Language identification by words first, character n-grams where a word is unknown.

Training counts all words by language over a bounded sample of labelled rows. A known word adds its log frequency in each language. An unknown one adds the mean over its known character
n-grams of the longest length that has any, from NGRAM letters (with word ends) down to one.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import col, fresh, small_batches, without

#: Rows of each language in the sample (about as many), longest n-gram.
SAMPLE_ROWS, NGRAM = 1000, 5
MEMO_WORDS = 400_000
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}+")
_WORKER: dict = {}


class Model:
    """Log frequencies of words and n-grams; one column for each language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        at = {lang: k for k, lang in enumerate(self.langs)}
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(at)))
        grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(at))) for _ in range(NGRAM + 1)]
        for lang, own in counts.items():
            for word, n in own.items():
                words[word][at[lang]] += n
                ends = f"<{word}>"
                for size in range(1, NGRAM + 1):
                    table = grams[size]
                    for k in range(len(ends) - size + 1):
                        table[ends[k : k + size]][at[lang]] += n
        self.words, self.grams = self._log(words), [self._log(g) for g in grams]

    @staticmethod
    def _log(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if not table:
            return {}
        total = sum(table.values())
        return {k: np.log((v + 0.5) / (total + 0.5 * len(table))).astype(np.float32) for k, v in table.items()}

    def word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        ends = f"<{word}>"
        for size in range(NGRAM, 0, -1):
            table = self.grams[size]
            found = [g for k in range(len(ends) - size + 1) if (g := table.get(ends[k : k + size])) is not None]
            if found:
                return (np.sum(found, axis=0) / len(found)).astype(np.float32)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """Scores texts; a worker remembers the scores of up to MEMO_WORDS words."""

    def __init__(self, model: Model):
        self.model, self.number, self.rows, self.n = model, {}, np.zeros((1024, len(model.langs)), np.float32), 0

    def score(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        if self.n > MEMO_WORDS:
            self.number, self.n = {}, 0
        number = self.number
        ids = []
        for word in words:
            k = number.get(word)
            if k is None:
                if self.n == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                k = number[word] = self.n
                self.rows[k] = self.model.word(word)
                self.n += 1
            ids.append(k)
        total = self.rows[ids].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())  # of equal scores the first language by name
        return self.model.langs[best], 1.0 / sum(math.exp(max(-700.0, x - total[best])) for x in total.tolist())


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learns from a sample of the rows that hold text and language and satisfy learn_from.

    The sample takes rows by a hash of key, so that each language gets about SAMPLE_ROWS; the words of the sample are
    counted on the executors, and what comes to the driver are the distinct words of the sample, as long as it is bounded.
    Ties need no rule: every word of the sample is known, and of languages that score alike the first by name is chosen.
    Null texts and languages teach nothing; repeated rows count as often as they occur; without any row nothing is known.
    """
    rows = docs.filter(learn_from & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model({})
    share = F.create_map(*[F.lit(x) for lang_, n in sizes.items() for x in (lang_, min(1.0, SAMPLE_ROWS / n))])
    sample = rows.filter(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            for text_, lang_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[lang_].update(_LETTERS.findall(text_.lower()))
            flat = [(lang_, w, n) for lang_, own in found.items() for w, n in own.items()]
            langs, words, ns = zip(*flat) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["lang", "word", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {lang_: {} for lang_ in sizes}
    for lang_, word, n in counted.select("lang", "word", "n").toPandas().sort_values(["lang", "word"]).itertuples(index=False):
        counts[lang_][word] = int(n)
    return Model({k: v for k, v in counts.items() if v})


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (the posterior of that language, 0 to 1) from the whole text alone.

    A text that is null or has no letter gets `und` and 0, and so does every text if nothing could be learned.
    Columns of the new names are replaced; repeated rows get equal answers; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # the words of a bounded sample

    @F.pandas_udf("lang_pred string, score double")
    def run(column):
        import pandas as pd

        if _WORKER.get("model") is not shipped.value:
            _WORKER.update(model=shipped.value, scorer=Scorer(shipped.value))
        return pd.DataFrame([_WORKER["scorer"].score(t) for t in column], columns=["lang_pred", "score"])

    name = fresh(docs, "language")[0]
    scored = docs.withColumn(name, run(col(text).cast("string")))
    kept = (col(c) for c in without(docs, "lang_pred", "score").columns)
    return scored.select(*kept, F.col(f"{name}.lang_pred").alias("lang_pred"), F.col(f"{name}.score").alias("score"))
