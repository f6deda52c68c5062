"""Results that were cut before: class members, clips of long recordings, passages without marks, scripts."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lakeweave.llm import media, quality, queries, substring, toxicity


def test_media_membership(spark, tmp_path):
    rng = np.random.RandomState(2)
    base = rng.randn(4, 64).tolist()
    rows = [(20, base[0]), (21, base[0]), (22, base[0]), (23, base[1]), (24, base[2]), (25, base[2]), (26, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op7_media(spark, str(tmp_path)).collect()
    assert {(r.vec_id, r.component_id, r.aligned_with) for r in out} == {(20, 20, None), (21, 20, 20), (22, 20, 20), (23, 23, None), (24, 24, None), (25, 24, 24), (26, 26, None)}


def test_clips_of_a_long_recording(spark):
    rng = np.random.RandomState(5)
    long = rng.randint(-(2**31), 2**31, 10_000).astype(np.int32)
    rows = [(100, long.tolist())] + [(i, long[900 * i + 7 : 900 * i + 121].tolist()) for i in range(10)] + [(50 + i, rng.randint(-(2**31), 2**31, 114).tolist()) for i in range(10)]
    prints = spark.createDataFrame(rows, "vec_id long, fingerprint array<int>")
    got = {r.vec_id: (r.component_id, r.aligned_with, r.offset) for r in media.group(prints).collect()}
    assert {i: got[i] for i in range(10)} == {i: (0, 100, 900 * i + 7) for i in range(10)}
    assert got[100][0] == 0 and all(got[50 + i] == (50 + i, None, None) for i in range(10))


def test_passages_without_marks():
    rng = random.Random(1)
    word = lambda: f"w{rng.getrandbits(40):x}"
    for distinct, most in ((51, 0.12), (25, 0.13)):
        left = []
        for _ in range(300):
            stock = [word() for _ in range(distinct)]
            passage = stock if distinct == 51 else rng.choices(stock, k=51)
            texts = [" ".join([*(word() for _ in range(rng.randint(20, 60))), *passage, *(word() for _ in range(rng.randint(20, 60)))]) for _ in range(2)]
            first = {h for h, _, _ in substring.runs(substring.sentences(texts[0]))}
            parts = substring.sentences(texts[1])
            gone = {k for h, s, c in substring.runs(parts) if h in first for k in range(s, s + c)}
            left.append(1 - sum(len(parts[k].split()) for k in gone) / 51)
        assert max(left) < 1  # none is missed wholly
        assert sum(left) / len(left) < most


def test_script_of_a_whole_text():
    assert quality.script_of("12 " * 200 + "слова здесь") == "script:CYRILLIC"
    assert quality.script_of("latin words " * 40 + "слова здесь " * 80) == "script:CYRILLIC"
    assert quality.script_of("12 " * 200) == "script:none"


def test_copies_share_more_than_two_words():
    words = sorted((f"word{k}" for k in range(200)), key=xxhash.xxh3_64_intdigest)
    assert toxicity.copy_key(words[:2] + words[2:100]) != toxicity.copy_key(words[:2] + words[100:])
    assert toxicity.copy_key(words[:100]) == toxicity.copy_key(words[:99])


def test_pair_without_a_shared_run(spark):
    """a pair that meets the threshold is linked, whether or not it shares a run or met a pivot."""
    rng = np.random.RandomState(8)
    a, other = (rng.randint(-(2**31), 2**31, 120) for _ in range(2))
    b = a ^ np.where(np.arange(120) % 10, 1, 0)  # 12 equal integers, ten apart
    less = other ^ np.where(np.arange(120) % 11, 1, 0)  # 11 of them
    rows = [(1, a.tolist()), (2, b.tolist()), (3, other.tolist()), (4, less.tolist())]
    out = media.group(spark.createDataFrame(rows, "vec_id long, fingerprint array<int>")).collect()
    assert {r.vec_id: (r.component_id, r.aligned_with, r.hits) for r in out} == {1: (1, 2, 12), 2: (1, 1, 12), 3: (3, None, None), 4: (4, None, None)}


def test_sweep_of_steady_recordings(monkeypatch):
    """Equal integers one recording at a time give the same matches as all at once."""
    import pyarrow as pa

    rng = np.random.RandomState(9)
    prints = [np.where(rng.rand(n) < 0.5, 7, rng.randint(0, 2**32, n)).astype(np.uint32) for n in (60, 90, 120, 200)]
    prints += [np.concatenate([prints[3][50:110], prints[0][:20]]), prints[2] ^ (np.arange(120) % 9 == 0)]
    prints = [p.astype(np.uint32) for p in prints]
    block = media._indexed(pa.table({"rep": pa.array(range(6), pa.int64()), "c": pa.array(range(6), pa.int64()), "fp": pa.array([p.view(np.int32) for p in prints], pa.list_(pa.int32()))}))
    whole = [media._met(block, p, np.ones(6, bool)).tolist() for p in prints]
    assert whole[2] == whole[5] == [2, 5] and whole[4] == [3, 4]
    monkeypatch.setattr(media, "LISTED", 50)
    assert [media._met(block, p, np.ones(6, bool)).tolist() for p in prints] == whole


def test_sweep_sorts_few_equal_integers(monkeypatch):
    """op7_media: chance equal integers of the sweep are counted, not sorted; it finds what brute force finds."""
    import pyarrow as pa

    rng = np.random.RandomState(10)
    prints = [(rng.randint(0, 1500, n).astype(np.uint32) * np.uint32(2654435761)) for n in rng.randint(100, 140, 300)]
    prints[7] = np.where(np.arange(100) % 9, prints[4][:100] ^ np.uint32(1), prints[4][:100])
    prints[9] = np.concatenate([prints[200][50:], prints[3][:40]])
    prints[299] = np.concatenate([prints[5][:30], prints[0][:70]])
    n = len(prints)
    block = media._indexed(pa.table({"rep": pa.array(range(n), pa.int64()), "c": pa.array(range(n), pa.int64()), "fp": pa.array([p.view(np.int32) for p in prints], pa.list_(pa.int32()))}))
    sorted_, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **kw: sorted_.append(len(x)) or unique(x, **kw))
    found = [media._met(block, p, np.ones(n, bool)).tolist() for p in prints]
    monkeypatch.undo()
    _, times = unique(np.concatenate(prints), return_counts=True)
    assert sum(sorted_) < 0.05 * (times**2).sum()

    def held(a, b):
        offset, hits, errors = media.align(a, b)
        return media.matches(hits, errors, min(len(a), len(b) - offset) - max(0, -offset), min(len(a), len(b)))

    alike = {(7, 4), (4, 7), (9, 200), (200, 9), (299, 0), (0, 299)}
    assert {(i, j) for i, js in enumerate(found) for j in js if i != j} == alike
    assert {(i, j) for i in (0, 4, 9, 299) for j in range(n) if i != j and held(prints[i], prints[j])} == {p for p in alike if p[0] in (0, 4, 9, 299)}
