"""Operators over the whole corpus: against brute force, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeweave.llm import media, minhash, mixing, substring
from lakeweave.llm.common import Stages

STOCK = [a + b for a in "ka lo mi ne ru sa to vi".split() for b in "bar den fol gri hem jun kel lam".split()]
SCHEMA = "doc_id long, text string, key string, rep long"


def corpus(seed=1, families=12, copies=14):
    rng = random.Random(seed)
    docs = []
    for _ in range(families):
        base = [rng.choice(STOCK) for _ in range(rng.randint(40, 120))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(words))
                if rng.random() < 0.4:
                    del words[at]
                else:
                    words[at] = rng.choice(STOCK)
            docs.append(" ".join(words))
        docs += [" ".join(base)] * 3
    docs += [" ".join(rng.choice(STOCK) for _ in range(60)) for _ in range(40)] + ["one two", "One  TWO", "one", "", None, " \n"]
    rng.shuffle(docs)
    return docs


def brute_components(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    docs = list(enumerate(corpus(percent)))
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in docs], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size, percent).collect()}
    assert got == brute_components(docs, size, percent)


def test_near_duplicates_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(none).count() == 0
    long = "word " * 5 + " ".join(f"w{k}" for k in range(50_000))
    df = spark.createDataFrame([(None, "a b c", "", 1), (1, "a b c", "", 1), (1, "a b c", "", 1), (2, long, "", 1), (3, long + " x", "", 1)], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 2, False), (None, None, True)]


def test_components_of_long_paths(spark):
    n = 60
    rng = random.Random(0)
    name = list(range(n))
    rng.shuffle(name)
    links = spark.createDataFrame([(name[k], name[k + 1]) for k in range(n - 1) if k != 30], "u long, v long")
    got = {r.id: r.component for r in minhash.components(Stages(spark, "t"), links).collect()}
    parts = name[:31], name[31:]
    assert got == {x: min(p) for p in parts for x in p if x != min(p)}


def test_match_threshold_loses_next_to_nothing():
    for percent in (80, 85):
        m = minhash.least_matches(percent)
        assert minhash.prob_missed(percent, m) <= 1e-5 < minhash.prob_missed(percent, m + 1)


def brute_spans(docs):
    seen = {}
    for i, t in sorted(set(docs)):
        for h, s, c in substring.runs(substring.sentences(t)):
            seen.setdefault(h, []).append((i, s, c))
    gone = {}
    for at in seen.values():
        for i, s, c in sorted(at)[1:]:
            gone.setdefault(i, set()).update(range(s, s + c))
    return {i: "".join(p for k, p in enumerate(substring.sentences(t)) if k not in gone.get(i, ())) for i, t in docs}


def prose(rng, n):
    out = []
    for _ in range(n):
        words = [rng.choice(STOCK) + rng.choice(STOCK) for _ in range(rng.randint(1, 22))]
        out.append(" ".join(words).capitalize() + rng.choice([". ", "! ", "?\n", ".\n\n"]))
    return "".join(out)


def test_repeated_spans(spark):
    rng = random.Random(4)
    passages = [" ".join(rng.choice(STOCK) + rng.choice(STOCK) + ("." if k % rng.randint(6, 18) == 5 else "") for k in range(60)) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [prose(rng, 3), rng.choice(passages), " " + prose(rng, 4)] if i % 2 else [prose(rng, 8)]
        docs.append((i, "".join(parts)))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA).withColumn("n_removed", F.lit("clash"))
    out = {r.doc_id: r for r in substring.deduplicate(df).collect()}
    assert {i: r.text for i, r in out.items()} == brute_spans(docs)
    for p in passages:  # a middle part of each passage is left once
        middle = " ".join(p.split()[15:45])
        assert sum(middle in r.text for r in out.values()) == 1
    assert all(out[i].text == t for i, t in docs if i % 2 == 0)


def test_repeated_spans_edges(spark):
    t = prose(random.Random(9), 12)
    df = spark.createDataFrame([(None, t, "", 1), (1, t, "", 1), (1, t, "", 1), (2, None, "", 1), (3, "", "", 1), (4, "no end " * 30_000, "", 1)], SCHEMA)
    out = sorted(((r.doc_id, r.text, r.n_removed) for r in substring.deduplicate(df).collect()), key=str)
    assert [r[:2] for r in out if r[0] == 1] == [(1, t)] * 2  # repeated rows are one document
    assert [r[1] for r in out if r[0] is None] == [""]  # a null id comes after all others
    assert (2, None, 0) in out and (3, "", 0) in out and len(out) == 6
    assert substring.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "No end", "One. Two! Three?", "a.b c...  \n\n d", "x " * 100, ", ; | : ,"])
def test_sentences_are_the_text(text):
    assert "".join(substring.sentences(text)) == text


def mixed(spark):
    """Domains of one alphabet, told apart by their words alone; a third of the words is common to all."""
    rng = random.Random(6)
    lexicon = {d: ["".join(rng.choice("aeinrst") for _ in range(6)) for _ in range(150)] for d in ("en", "fr", "de", "all")}
    rows = []
    for i in range(300):
        lang = ["en", "en", "en", "fr", "de"][i % 5]
        words = [rng.choice(lexicon["all" if rng.random() < 0.33 else lang]) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def brute_rates(p, n, targets, least):
    """The same steps in numpy."""
    r = np.ones(len(n))
    gram = (p * n[:, None]).T @ p
    white = np.linalg.inv(gram + np.eye(len(targets)) * max(1e-9, 1e-9 * np.trace(gram)))
    last = np.zeros(len(targets))
    for _ in range(mixing.ITERATIONS):
        totals = (p * (n * r)[:, None]).sum(axis=0)
        if all(abs(totals - targets) <= mixing.TOLERANCE * np.maximum(targets, 1)) or all(abs(totals - last) <= mixing.TOLERANCE * np.maximum(last, 1)):
            break
        last = totals
        r = np.maximum(least, r - p @ (white @ (totals - targets)))
    return r


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_mixing(spark, least):
    docs = mixed(spark)
    labelled = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.col("lang").alias("domain"))
    weights = {"en": 0.4, "de": 0.3, "fr": 0.3}
    rows, domains, totals = mixing.mix(docs, labelled, weights, least=least)
    got = rows.toPandas()
    n = got[mixing.OWN + "n_tokens"].to_numpy(float)
    assert n.sum() == sum(len(t.split()) for t in got["text"])
    p = got[[f"{mixing.OWN}p{i}" for i in range(3)]].to_numpy()
    rate = got[mixing.OWN + "rate"].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == [domains.index(x) for x in got["lang"]]).mean() > 0.95
    assert (rate >= least).all()
    have = (p * (n * rate)[:, None]).sum(axis=0)
    total = n.sum() if not least else max((p * n[:, None]).sum(axis=0)[i] / weights[d] for i, d in enumerate(domains))
    want = np.array([weights[d] for d in domains]) * total
    assert np.allclose(have, totals, rtol=1e-6) and np.allclose(have, want, rtol=0.02)
    assert np.allclose(rate, brute_rates(p, n, want, least), atol=1e-6)
    taken = mixing.take(rows)
    assert taken.columns == docs.columns
    assert abs(taken.count() - rate.sum()) < 3 * np.sqrt(len(rate))


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "some text"), (2, ""), (3, "word " * 50_000), (3, "word " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, "en"), (3, "en"), (None, "en"), (9, None)], "key long, domain string")
    rows, domains, _ = mixing.mix(docs, labels, {"en": 1.0})
    assert domains == ["en"] and rows.count() == 5
    assert mixing.mix(docs, labels.limit(0), {"en": 1.0})[0].filter(f"{mixing.OWN}rate = 1").count() == 5
    assert mixing.mix(docs.limit(0), labels, {"en": 1.0})[0].count() == 0


def brute_groups(own):
    """Components of recordings that match at any offset, each offset tried integer by integer."""
    parent = {i: i for i in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def match(x, y):
        short = min(len(x), len(y))
        for shift in range(-len(x) + 1, len(y)):
            pairs = [(x[k], y[k + shift]) for k in range(max(0, -shift), min(len(x), len(y) - shift))]
            if 2 * len(pairs) >= short:
                hits, wrong = sum(a == b for a, b in pairs), sum(bin(a ^ b).count("1") for a, b in pairs)
                if hits >= 4 and 10 * hits >= short and 5 * wrong <= 32 * len(pairs):
                    return True
        return False

    ids = sorted(own)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if root(i) != root(j) and match(own[i], own[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


def test_media(spark):
    rng = np.random.RandomState(1)
    base = rng.randn(24, 64)
    near = base[:10] + rng.randn(10, 64) * 0.06
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, near, base[:2]]))] + [(100, None), (None, base[0].tolist()), (101, []), (3, base[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component_id", F.lit("clash")).withColumn("a.b", F.lit(1))
    prints = media.fingerprints(df, F.col("embedding"), read=media.render)
    own = {r.vec_id: [x & 0xFFFFFFFF for x in r.fingerprint] for r in prints.collect() if r.vec_id is not None and len(r.fingerprint)}
    out = media.group(prints).collect()
    assert len(out) == len(rows)
    want = brute_groups(own)
    assert {r.vec_id: r.component_id for r in out if r.vec_id in own} == want
    assert all(want[i] == want[24 + i] == i for i in range(10)) and all(want[i] == i for i in range(24))
    assert {(r.vec_id, r.component_id, r.aligned_with) for r in out if r.vec_id in (None, 100, 101)} == {(None, None, None), (100, 100, None), (101, 101, None)}
    assert {(r.aligned_with, r.offset) for r in out if r.vec_id in (34, 35)} == {(0, 0), (1, 0)}
    assert media.group(prints.limit(0)).count() == 0


def test_media_large_group(spark):
    """Recordings made from one are one group, and nothing else joins it."""
    rng = np.random.RandomState(4)
    base = rng.randint(-(2**31), 2**31, 120)
    flips = lambda: np.where(rng.rand(120) < 0.4, base ^ (1 << rng.randint(0, 31, 120)), base)
    rows = [(i, flips().tolist()) for i in range(300)] + [(1000 + i, rng.randint(-(2**31), 2**31, 120).tolist()) for i in range(50)]
    out = media.group(spark.createDataFrame(rows, "vec_id long, fingerprint array<int>")).collect()
    assert {r.component_id for r in out if r.vec_id < 1000} == {0}
    assert all(r.component_id == r.vec_id and r.aligned_with is None for r in out if r.vec_id >= 1000)


def test_alignment_finds_the_offset():
    rng = np.random.RandomState(3)
    a = media.fingerprint(media.render(rng.randn(64)))
    assert media.align(a[20:], a) == (20, len(a) - 20, 0.0)
    assert media.fingerprint(None).size == media.fingerprint(b"junk").size == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(corpus(5, 6, 6))]
    docs += [(1000 + i, prose(rng, 8) + " scoundrel villain", "en", "s", 1) for i in range(40)] + [(None, "no id here", "en", "s", 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= 1000)) for i, *_ in docs if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_spans", "mixing", "encoding"]
    clean = [(i, t) for i, t, *_ in docs if i is not None and i < 1000]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in frame.collect()}
        if name != "encoding":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            assert ids == {i for i, _ in clean} | {None}
        if name == "near_duplicates":
            assert ids == {i for i, x in brute_components(clean, 5, 80).items() if x[2]} | {None}
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, again.select("doc_id", "ids_sha256").collect())) == sorted(map(str, frame.select("doc_id", "ids_sha256").collect()))
