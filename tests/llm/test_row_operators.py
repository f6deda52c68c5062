"""Operators that judge each text by itself: against brute force, and their edge cases."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as vocab
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.llm import bpe, html, langid, quality, toxicity, urls
from lakeweave.llm.queries import RULES

RANKS = vocab.path("byte_bpe_50k.tiktoken")
PIECES = vocab.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor " * 20_000
ODD = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "  \n\t ", None, None), (4, LONG, "en", "x"), (None, "a text without an id. " * 8, "en", "x"), (5, "12 34 !! ##", "xx", "x"), (5, "12 34 !! ##", "xx", "x")]
SCHEMA = "doc_id long, text string, lang string, word string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def replay():
    return bpe.Replay(bpe.read_ranks(open(RANKS, "rb").read()))


@settings(max_examples=150, deadline=None)
@given(text=st.text("abst 'é日🎉\n\t09#", max_size=80))
def test_bpe_is_the_library(replay, tik, text):
    ids = replay.block([regex.findall(vocab.PATTERN, text)])[0]
    assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
    assert replay.decode(ids).decode() == text


def test_bpe_table(spark, odd, none, tik):
    for r in bpe.encode(odd.withColumn("n_tokens", F.lit("clash")), RANKS, vocab.PATTERN).collect():
        ids = tik.encode_ordinary(r.text or "")
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(none, RANKS, vocab.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(odd, RANKS, vocab.PATTERN), RANKS).filter("text is not null").collect()
    assert all(bytes(r.decoded).decode() == r.text for r in back)


def brute_repeats(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40))
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute_repeats(words)


def test_quality_table(spark, odd, none):
    rows = {(r.doc_id, r.n_words): r for r in quality.assess(odd, PIECES, RANKS).collect()}
    assert rows[1, 0].base_failed and not rows[1, 0].kept and rows[3, 0].base_failed
    long = rows[4, 60_000]
    assert long.n_repeat_words == 60_000 and long.base_failed and long.word_chars == len(LONG) - 60_000
    assert rows[5, 4].n_symbols == 2
    assert quality.assess(none, PIECES, RANKS).count() == 0
    assert quality.assess(odd, PIECES, RANKS).count() == len(ODD)


def test_quality_keeps_prose_and_rejects_noise(spark):
    rng = random.Random(3)
    stock = ["river", "garden", "window", "letter", "morning", "quiet", "people", "walked", "under", "stone", "bridge", "market", "summer", "evening", "little", "house"]
    prose = [(i, " ".join(rng.choice(stock) for _ in range(120)), "en") for i in range(200)]
    noise = [(1000 + i, " ".join("%#" + "".join(rng.choice("qxzjkv") for _ in range(6)) for _ in range(120)), "en") for i in range(5)]
    got = quality.assess(spark.createDataFrame(prose + noise, "doc_id long, text string, lang string"), PIECES, RANKS).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


def test_base_counts():
    text = "a b\n\n a b\na b\n\n"
    assert quality.base_counts(text, text.split()) == (6, 0, 1, 0)


def test_language(spark, odd, none):
    stock = {"en": "the house of many people in a green garden", "de": "der garten und das haus mit vielen menschen", "fr": "la maison avec des gens dans le jardin vert"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(stock[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(sorted(stock) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.held_out())
    out = langid.predict(docs.withColumn("held", langid.held_out()), model).filter("held").collect()
    assert len(out) > 30 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    # an unknown word goes by its letters
    assert model.langs[int(model.word("gardens").argmax())] == "en" and model.langs[int(model.word("hausen").argmax())] == "de"
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[5] == "und" and got[4] in model.langs
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none, F.lit(True))).collect()} == {"und"}


def test_toxicity(spark, odd, none):
    rng = random.Random(2)
    stock = [a + b for a in "riv gar win let mor qui peo wal und sto bri mar".split() for b in "er den dow ter ning et ple ked".split()]
    rows, labels = [], []
    for i in range(2000):
        words = [rng.choice(stock) for _ in range(rng.randint(15, 60))]
        bad, low = i % 4 == 0, i % 5 == 0
        words += ["scoundrel", "villain"] * bad + ["zzz"] * low
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "x"))
        if i < 1600:
            labels.append((i, int(low), int(bad)))
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + labels[:5], "doc_id long, low int, toxic int")
    chain = toxicity.train(docs, lab, ["low", "toxic"])
    out = [(r.doc_id, r.toxicity) for r in toxicity.predict(docs, chain).collect() if r.doc_id >= 1600]
    assert sum((t.toxic >= toxicity.THRESHOLD) == (i % 4 == 0) for i, t in out) >= 0.95 * len(out)
    assert sum((t.low >= 0.5) == (i % 5 == 0) for i, t in out) >= 0.95 * len(out)
    kept = toxicity.reject(docs, chain)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.predict(docs, chain).collect() if r.toxicity.toxic < toxicity.THRESHOLD}
    assert toxicity.reject(odd, chain).count() == len(ODD) and toxicity.reject(none, chain).count() == 0
    empty = toxicity.train(docs, lab.limit(0), ["low", "toxic"])
    assert toxicity.predict(odd, empty).count() == len(ODD)


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><h1>Hi &amp; bye</h1><p>One<p>Two <b>bold</b><br>line
<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table><div hidden>no</div>
<div style="display: none">no</div><pre>
 a  b
   c</pre><ol start=3><li>x</li><li>y</li></ol><script>if(a<b)"</p>no"</script>end</body></html>"""


def test_html(spark):
    assert html.render(PAGE) == "Hi & bye\n\nOne\n\nTwo bold\nline\n\n- a\n- b\n  - c\n- d\n\nName       Qty\nApple pie  3\n\n a  b\n   c\n\n3. x\n4. y\n\nend"
    assert html.render(None) == html.render("") == html.render("<!-- x -->") == ""
    assert html.render("<div>" * 20_000 + "deep") == "deep"
    assert html.render("a < b <unclosed") == "a < b"
    df = spark.createDataFrame([(1, None, "old"), (2, PAGE, "old"), (2, PAGE, "old")], "page_id long, html string, text string")
    out = html.extract(df).collect()
    assert len(out) == 3 and out[0].text == "" and out[1].text == out[2].text and "no" not in out[1].text.split()
    assert html.extract(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("<>/apbtrdlihu ='\"!-\n&;", max_size=80))
def test_html_never_fails(text):
    assert isinstance(html.render(text), str)


def brute_rule(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end].translate({k: k + 32 for k in range(65, 91)}), rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    for _, rule in sorted(RULES, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            return host, path, rule
    return host, path, None


def test_urls(spark):
    given_ = [None, "", "no scheme", "http://", "https://A.Example.COM/en/71?x#y", "http://a.com/en/5", "http://xcom/en/5", "http://com/en/", "ftp://b.example.net/de/88", "http://b.example.net/de/7", "http://c.org/es/1://x", "http://d.org?q=/es/", "http://É.org/es/", "http://a.com/" + "x/" * 5000]
    given_ += [f"http://spam.com/en/{k}" for k in range(30)] + [f"http://spam.com/fr/{k}" for k in range(30)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(given_)], "page_id long, url string, host string")
    out = {r.page_id: r for r in urls.judge(df, RULES).collect()}
    assert len(out) == len(given_)
    for i, u in enumerate(given_):
        assert (out[i].host, out[i].path, out[i].rule) == brute_rule(u), u
        assert out[i].verdict in ("allow", "block")
    verdicts = dict((r, v) for v, r in RULES)
    assert all(out[i].verdict == verdicts[out[i].rule] for i in out if out[i].rule)
    assert urls.judge(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judge(df, ()).collect()} == {"allow"}


def test_templates_reject_by_purity(spark):
    """Labelled and unlabelled pages of one template: the labels decide for all."""
    rules = [("block", f"h.com/x/{k}") for k in range(100, 140)] + [("allow", f"h.com/y/{k}") for k in range(100, 140)]
    given_ = [f"http://h.com/{s}/{k}" for s in "xy" for k in range(100, 180)]
    out = urls.judge(spark.createDataFrame([(u,) for u in given_], "url string"), rules).filter("rule is null").collect()
    assert len(out) == 80 and all((r.verdict == "block") == ("/x/" in r.url) for r in out)
