"""Substring dedup by sliding sentence spans.

A text is cut into sentences. From every sentence on, the shortest run that is long enough to tell (SENTENCES sentences
and RUN_WORDS words, or fewer sentences with LONG_WORDS words) is hashed. Equal hashes are joined over the whole corpus;
the first occurrence, by doc_id and then place, stays, and sentences covered by any other are removed. Runs slide by one
sentence, so a repeated passage is found wherever it starts, up to the sentences that it shares only in part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import WORD, Stages, col, fresh, release, without

SENTENCES, RUN_WORDS, LONG_WORDS = 2, 12, 24
CLAUSE_WORDS = 14
#: Stands for a null id, which comes after all others.
LAST = 2**63 - 1

#: A sentence ends after . ! ? or … (and closing marks) before white space, at a line break, or with the text; white
#: space behind it belongs to it.
_SENTENCE = re.compile(r"[^.!?…\n]*(?:[.!?…]+(?![\s\"')\]»”]|\Z)[^.!?…\n]*)*(?:[.!?…]+[\"')\]»”]*[ \t\r\f\v]*\n*|\n+|\Z)")
_CLAUSE = re.compile(r"[^,;:|]*(?:[,;:|]+\s*|\Z)")
_WORD_AND_SPACE = re.compile(r"(\S+)\s*")
_WORDS = re.compile(WORD)


def _pieces(clause: str) -> list[str]:
    if len(clause.split(None, CLAUSE_WORDS)) <= CLAUSE_WORDS:
        return [clause] if clause else []
    out, at = [], 0
    found = list(_WORD_AND_SPACE.finditer(clause))
    h = [2**64, *(xxhash.xxh3_64_intdigest(m[1]) for m in found), 2**64]
    for k, m in enumerate(found, 1):
        if h[k] <= h[k - 1] and h[k] <= h[k + 1]:
            out.append(clause[at : m.end()])
            at = m.end()
    return [*out, clause[at:]] if at < len(clause) else out


def sentences(text: str) -> list[str]:
    """The sentences of a text; together they are the text. Those of over CLAUSE_WORDS words are cut at their clauses,
    and clauses as long as that after words whose hash is the least of theirs and their neighbours', which cuts equal
    passages alike: a passage that begins or ends within a long sentence would else escape."""
    out = []
    for s in _SENTENCE.findall(text) if text else ():
        if len(s) > 2 * CLAUSE_WORDS and len(s.split(None, CLAUSE_WORDS)) > CLAUSE_WORDS:
            for c in _CLAUSE.findall(s):
                out += _pieces(c)
        elif s:
            out.append(s)
    return out


def runs(parts: list[str]) -> list[tuple[int, int, int]]:
    """(hash, first sentence, number of sentences) of the run from each sentence; none where the text ends too soon."""
    words = [_WORDS.findall(p) for p in parts]
    digests = [xxhash.xxh3_64_digest(" ".join(w)) for w in words]
    counts = [len(w) for w in words]
    out, end, total = [], 0, 0
    for start in range(len(parts)):
        if end < start:
            end, total = start, 0
        if counts[start]:
            while end < len(parts) and not (total >= LONG_WORDS or total >= RUN_WORDS and end - start >= SENTENCES):
                total += counts[end]
                end += 1
            if total < LONG_WORDS and not (total >= RUN_WORDS and end - start >= SENTENCES):
                break  # nor will any later run
            h = xxhash.xxh3_64_intdigest(b"".join(digests[start:end]))
            out.append((h - (1 << 64) if h >> 63 else h, start, end - start))
        if end > start:
            total -= counts[start]
    return out


def _text_key(text: Column) -> Column:
    """With the id it tells rows of one id apart; null where there is no text."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes repeated spans from the texts; every row stays, with all its columns.

    Adds n_sentences and n_removed (long; columns of these names are replaced). A text all of whose sentences are
    repeated becomes empty; a null text stays null with no sentences. "First" goes by key (nulls last), then by place.
    Repeated rows (equal key and text) count as one document, so none of them removes the other's text; rows of equal
    key and different texts are different documents. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "substring")
    docs = without(docs, "n_sentences", "n_removed")
    own = docs.select(col(key).cast("long").alias("k"), col(text).cast("string").alias("t")).withColumn("x", _text_key(F.col("t")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "k", "x", "p"]
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                rows = batch.slice(start, 200)
                out = []
                for k, t, x in zip(*(c.to_pylist() for c in rows.columns)):
                    if t:
                        out += [(h, LAST if k is None else k, x, s << 32 | c) for h, s, c in runs(sentences(t))]
                columns = list(zip(*out)) if out else [()] * 4
                kinds = (pa.int64(),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)
                out = columns = None
        release()

    spans = stages.put(own.mapInArrow(find, "h long, k long, x long, p long"))
    # hashes alone go to be counted; a frequent one is summed before it is moved
    repeated = stages.put(spans.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    # both sides are tables, so that a frequent hash's rows may be split among tasks
    shared = stages.put(spans.join(repeated, "h"))
    stages.drop(spans, repeated)
    first = stages.put(shared.groupBy("h").agg(F.min(F.struct("k", "x", "p")).alias("first")))
    again = shared.join(first, "h").filter(F.struct("k", "x", "p") != F.col("first"))
    # as many rows for a document as it has sentences at most
    covered = stages.put(again.groupBy("k", "x").agg(F.collect_set("p").alias("spans")))
    stages.drop(shared, first)

    x, k, y, found, made = fresh(docs, "text_key", "covered_key", "covered_text", "covered_spans", "cut")
    marked = docs.withColumn(x, _text_key(col(text).cast("string")))
    covered = covered.select(F.col("k").alias(k), F.col("x").alias(y), F.col("spans").alias(found))
    joined = marked.join(covered, (F.col(x) == F.col(y)) & (F.coalesce(col(key).cast("long"), F.lit(LAST)) == F.col(k)), "left")

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans_ in batches:
            out = []
            for t, found_ in zip(texts, spans_):
                parts = sentences(t) if t else []
                gone = set()
                if found_ is not None:
                    for span in map(int, found_):
                        gone.update(range(span >> 32, (span >> 32) + (span & 0xFFFFFFFF)))
                out.append(("".join(p for i, p in enumerate(parts) if i not in gone) if t is not None else None, len(parts), len(gone)))
            yield pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])
        release()

    cut_ = joined.withColumn(made, cut(col(text).cast("string"), F.col(found)))
    columns = [F.col(f"{made}.text").alias(c) if c == text else col(c) for c in docs.columns]
    return cut_.select(*columns, F.col(f"{made}.n_sentences").alias("n_sentences"), F.col(f"{made}.n_removed").alias("n_removed"))
