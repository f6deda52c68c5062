"""Quality rules: plain counts, then tokeniser fertility.

Two public vocabularies measure each text: characters per token under both, the share of byte-fallback tokens and the
entropy of the token distribution under the one with byte fallback. For each language (or script, where the language
is unknown) the quartiles over all texts that pass the plain rules give bands; a text outside a band is rejected.
Bands are wide (REACH interquartile ranges beyond a quartile, and never narrower than FLOOR allows), so they
take out texts that are unlike their language, not the tail of ordinary ones.
"""

from __future__ import annotations

import array
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.bpe import read_ranks
from lakeweave.llm.common import WORD, Stages, release

SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: How far beyond a quartile a band reaches, in interquartile ranges, and the least such range of each measure.
#: A text of n words gets sqrt(1 + SHORT / n) times that reach, as short texts vary more.
REACH, SHORT = 3.0, 200
FLOOR = {"chars_per_piece": 0.04, "chars_per_byte_token": 0.04, "byte_share": 0.02, "entropy_ratio": 0.02}
MEMO_WORDS = 800_000
#: Tokens that the norm of the entropy counts at most: beyond so many draws a text's entropy hardly grows any more, and
#: a norm that grew on would part long texts from short ones of the same language.
ENTROPY_DRAWS = 512

_WORDS = re.compile(WORD)
_WORKER: dict = {}


class Fertility:
    """Counts for each word under both vocabularies; a worker remembers up to MEMO_WORDS words."""

    def __init__(self, pieces: bytes, ranks: bytes):
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.vocab_size())])
        # words come one by one: a pattern that takes each as a whole
        self.encode = tiktoken.Encoding("quality", pat_str=r"(?s).+", mergeable_ranks=read_ranks(ranks), special_tokens={}).encode_ordinary
        self.memo: dict[str, tuple[int, bytes]] = {}
        self.older: dict[str, tuple[int, bytes]] = {}

    def learn(self, words: set[str]) -> None:
        """Per word: tokens of the byte-level vocabulary, ids of the pieces."""
        if len(self.memo) > MEMO_WORDS // 2:  # words not met for a while are forgotten, frequent ones stay
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = []
        for word in words:
            if word not in memo:
                if word in older:
                    memo[word] = older[word]
                else:
                    new.append(word)
        encode, pack = self.encode, array.array
        for word, ids in zip(new, self.piece.encode(new, num_threads=1)):
            memo[word] = len(encode(" " + word)), pack("I", ids).tobytes()

    def measure(self, words: list[str], chars: int) -> tuple[float, float, float, float]:
        if not words:
            return 0.0, 0.0, 0.0, 0.0
        found = [self.memo[w] for w in words]
        ids = np.frombuffer(b"".join([x[1] for x in found]), np.uint32)
        n = len(ids) or 1
        counts = np.bincount(ids.astype(np.int64)) if n > 4000 else np.unique(ids, return_counts=True)[1]
        share = counts[counts > 0] / n
        # the most that n draws could show, so that short texts compare with long ones
        most = math.log2(min(n, ENTROPY_DRAWS)) or 1.0
        entropy = float(-(share * np.log2(share)).sum()) / most
        return chars / n, chars / max(1, sum([x[0] for x in found])), int(self.is_byte[ids].sum()) / n, entropy


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words which the text has twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) ^ ids[k : k + n]
        mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed, kind="stable")
    sorted_ = mixed[order]
    same = sorted_[1:] == sorted_[:-1]
    if not same.any():
        return 0
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    starts = np.flatnonzero(twin).tolist()  # equal windows have equal hashes; now the words decide
    seen = Counter(tuple(words[s : s + window]) for s in starts)
    cover = np.zeros(len(words) + 1, np.int64)
    for s in starts:
        if seen[tuple(words[s : s + window])] > 1:
            cover[s] += 1
            cover[s + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    dup, seen = 0, set()
    if "\n" in text:
        for line in text.split("\n"):
            if _WORDS.search(line):
                dup += line in seen
                seen.add(line)
    return sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


SCHEMA = "doc_id long, grp string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_piece double, chars_per_byte_token double, byte_share double, entropy_ratio double"


def script_of(text: str) -> str:
    """The script of most letters of the text, by Unicode name; only a stand-in for an unknown language."""
    import unicodedata

    names = Counter()
    for c, n in Counter(text).items():  # a text has few distinct characters
        if c.isalpha():
            names[unicodedata.name(c, "?").split(" ")[0]] += n
    return "script:" + (names.most_common(1)[0][0] if names else "none")


def measures(docs: DataFrame, pieces_file: str, ranks_file: str) -> DataFrame:
    """One row for each document with its counts and measures; whole texts, a null text counts as empty."""
    sc = docs.sparkSession.sparkContext
    with open(pieces_file, "rb") as f, open(ranks_file, "rb") as g:
        both = f.read(), g.read()
    data, name = sc.broadcast(both), hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in both)).hexdigest()  # two files of fixed size, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _WORKER:  # one pair of vocabularies at a time
            _WORKER.clear()
            _WORKER[name] = Fertility(*data.value)
        fertility: Fertility = _WORKER[name]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                texts = [t or "" for t in rows.column("text").to_pylist()]
                words = [_WORDS.findall(t) for t in texts]
                fertility.learn(set().union(*words))
                langs = rows.column("lang").to_pylist()
                out = []
                for text, own, lang in zip(texts, words, langs):
                    counts = base_counts(text, own)
                    out.append((lang or script_of(text), len(own), *counts, *fertility.measure(own, counts[0])))
                columns = list(zip(*out))
                arrays = [rows.column("doc_id"), pa.array(columns[0], pa.string())]
                arrays += [pa.array(c, pa.int64()) for c in columns[1:6]] + [pa.array(c, pa.float64()) for c in columns[6:]]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split(" ")[0] for c in SCHEMA.split(", ")])
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def assess(docs: DataFrame, pieces_file: str, ranks_file: str) -> DataFrame:
    """Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the measures.

    docs needs doc_id, text and lang; other columns are left out. Repeated rows are judged alike, a null text has no
    words and fails the plain rules, a null language is replaced by the text's script. Quartiles are exact over values
    rounded to 0.001, of all texts that pass the plain rules, so they do not depend on how rows are partitioned.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "quality")
    measured = stages.put(measures(docs, pieces_file, ranks_file))
    passed = measured.filter(~base_failed())
    quartiles = None
    for name in FLOOR:  # each measure has a few thousand distinct rounded values, whatever the number of texts
        counted = passed.groupBy("grp", F.round(name, 3).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        q = counted.groupBy("grp").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"))
        spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(FLOOR[name]))
        q = q.select("grp", F.col("q")[0].alias(f"{name}_low"), F.col("q")[1].alias(f"{name}_high"), (REACH * spread).alias(f"{name}_reach"))
        quartiles = q if quartiles is None else quartiles.join(q, "grp")
    bands = stages.put(quartiles)
    inside = F.lit(True)
    for name in FLOOR:
        reach = F.col(f"{name}_reach") * F.sqrt(1 + SHORT / F.col("n_words"))
        inside &= F.col(name).between(F.col(f"{name}_low") - reach, F.col(f"{name}_high") + reach)
    out = measured.join(bands, "grp", "left")
    # a group without bands has no text that passes the plain rules
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & F.coalesce(inside, F.lit(False))).alias("kept"),
        *(F.round(name, 6).alias(name) for name in FLOOR),
    )
