"""Independent versions of the corpus operators, and columns whose names clash with the operators' own."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as vocab
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeweave.llm import bpe, html, langid, media, minhash, mixing, quality, queries, substring, toxicity, urls

CLASH = ("__x", "__k", "__mix_rate", "a.b", "cut", "text_key", "url_host", "toxicity", "language", "__MIX_p0")


def clashing(df):
    for name in CLASH:
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def test_clashing_columns(spark):
    rng = random.Random(1)
    text = " ".join(f"{rng.choice('abcde')}{rng.randint(0, 30)}." for _ in range(300))
    docs = clashing(spark.createDataFrame([(1, text, "en"), (2, text + " more", "en"), (3, None, None)], "doc_id long, text string, lang string"))
    pages = clashing(spark.createDataFrame([(1, "http://x.com/en/1", "<p>a"), (2, None, None)], "page_id long, url string, html string"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    chain = queries.toxicity_chain(docs, labels)
    rows, _, _ = mixing.mix(docs, docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("domain")), {"en": 1.0}, least=1.0)
    whole = {
        "substring": substring.deduplicate(docs),
        "bpe": bpe.encode(docs, vocab.path(queries.RANKS), vocab.PATTERN),
        "langid": langid.predict(docs, langid.train(docs, F.lit(True))),
        "toxicity": toxicity.reject(docs, chain, threshold=2.0),
        "mixing": mixing.take(rows, mixing.prefix(docs)),
        "html": html.extract(pages),
        "urls": urls.judge(pages, queries.RULES),
    }
    for name, out in whole.items():
        found = out.collect()
        assert found, name
        assert all(r[c] == f"own {c}" for r in found for c in CLASH), name
    assert minhash.near_duplicates(docs).count() == 3
    assert quality.assess(docs, vocab.path(queries.PIECES), vocab.path(queries.RANKS)).count() == 3
    prints = clashing(spark.createDataFrame([(1, [1, 2, 3])], "vec_id long, fingerprint array<int>"))
    assert media.group(prints).collect()[0].component_id == 1


def brute_tree(counts):
    """{(host, parts): (template, rate)} by plain recursion. counts: {(host, parts): (n, labelled, blocked)}."""
    w = urls.PRIOR_WEIGHT
    smooth = lambda b, l, rate: (b + w * rate) / (l + w)
    prior = (sum(c[2] for c in counts.values()) + 1) / (sum(c[1] for c in counts.values()) + 2)
    out = {}

    def grow(rows, template, rate):  # rows: [(key, rest, n, l, b)]
        for key, rest, *_ in rows:
            if not rest:
                out[key] = template, rate
        rows = [r for r in rows if r[1]]
        if not rows:
            return
        child = {}
        for _, rest, n, l, b in rows:
            c = child.setdefault(rest[0], [0, 0, 0])
            c[0], c[1], c[2] = c[0] + n, c[1] + l, c[2] + b
        all_n, k = sum(c[0] for c in child.values()), len(child)
        name = {s: "*" if s == "*" or k > urls.MANY_CHILDREN and c[0] < urls.RARE * all_n / k and all_n < urls.RARE * k else s for s, c in child.items()}
        branch = {}
        for s, c in child.items():
            x = branch.setdefault(name[s], [0, 0])
            x[0], x[1] = x[0] + c[1], x[1] + c[2]
        steps = {}
        for s, (l, b) in branch.items():
            if l >= urls.LEAST_LABELS:
                steps.setdefault(math.floor(urls.RATE_STEPS * b / l + 0.5), []).append(s)
        groups = []
        for step in sorted(steps):
            l2, b2 = (sum(branch[s][i] for s in steps[step]) for i in (0, 1))
            if groups:
                l1, b1 = groups[-1][2:]
                pooled = (b1 + b2) / (l1 + l2)
                if abs(b1 / l1 - b2 / l2) / math.sqrt(max(pooled * (1 - pooled), 1e-9) * (1 / l1 + 1 / l2)) < urls.CRITICAL_Z:
                    groups[-1] = [groups[-1][0], groups[-1][1] + steps[step], l2, b2]
                    continue
            groups.append([step, steps[step], l2, b2])
        alike = {s: f"~{100 * step / urls.RATE_STEPS:.1f}" for step, members, *_ in groups if len(members) > 1 for s in members}
        final = {s: alike.get(name[s], name[s]) for s in child}
        for g in set(final.values()):
            l, b = (sum(child[s][i] for s in child if final[s] == g) for i in (1, 2))
            grow([(key, rest[1:], n, x, y) for key, rest, n, x, y in rows if final[rest[0]] == g], f"{template}/{g}", smooth(b, l, rate))

    for host in {h for h, _ in counts}:
        rows = [((h, p), list(p), *c) for (h, p), c in counts.items() if h == host]
        grow(rows, "", smooth(sum(r[4] for r in rows), sum(r[3] for r in rows), prior))
    return out


def test_template_tree(spark):
    rng = random.Random(5)
    rules = [("block", "bad.org/x/"), ("block", "mix.org/ads/q"), ("allow", "mix.org/news/a"), ("allow", "bad.org/y/ok")]
    made = [f"http://mix.org/{rng.choice(['ads', 'news', 'blog'])}/{rng.choice('qabc')}{rng.choice(['', '/deep/er/' + rng.choice('uv')])}/{rng.randint(0, 999)}" for _ in range(400)]
    made += [f"http://bad.org/x/{k}" for k in range(60)] + [f"http://bad.org/z/page/{k}" for k in range(20)] + [f"http://bad.org/{rng.choice('vw')}/" + "s/" * 300 for _ in range(4)]
    made += [f"http://many.net/n{chr(97 + k % 26)}{chr(97 + k // 26)}/t" for k in range(80)] + ["no url", None, "http://empty.org"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id long, url string")
    out = urls.judge(df, rules).withColumn("parts", urls._generalised(F.col("path"))).collect()
    counts = {}
    for r in out:
        c = counts.setdefault((r.host, tuple(r.parts)), [0, 0, 0])
        c[0], c[1], c[2] = c[0] + 1, c[1] + (r.rule is not None), c[2] + (r.rule is not None and r.verdict == "block")
    want = brute_tree(counts)
    assert len(out) == len(made)
    for r in out:
        template, rate = want[r.host, tuple(r.parts)]
        assert (r.template, r.block_rate) == (template, pytest.approx(rate, abs=2e-6))
        if r.rule is None:
            assert r.verdict == ("block" if r.block_rate >= urls.REJECT_RATE else "allow")
    assert any(r.verdict == "block" for r in out if r.rule is None) and any(r.verdict == "allow" for r in out if r.rule is None and r.host == "mix.org")


def test_mixing_posteriors(spark):
    """Naive Bayes over buckets, word by word."""
    rng = random.Random(2)
    lexicon = {d: [f"{d}{k}" for k in range(40)] for d in ("news", "code")}
    rows = [(i, " ".join(rng.choice(lexicon[d]) for _ in range(rng.randint(1, 30))), d) for i in range(60) for d in [("news", "code")[i % 2]]] + [(100, " \n", None), (101, None, None), (102, "News1 CODE1\tother", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = docs.filter("doc_id < 40").select(F.col("doc_id").alias("key"), F.col("lang").alias("domain"))
    out, domains, _ = mixing.mix(docs, labelled, {"news": 0.7, "code": 0.3})
    assert domains == ["code", "news"]
    bucket = lambda w: xxhash.xxh64_intdigest(w.lower().encode(), seed=42) % mixing.BUCKETS
    sums = {d: Counter() for d in domains}
    for _, t, d in rows[:40]:
        for w in t.split():
            sums[d][bucket(w)] += 1 / len(t.split())
    def posterior(t):
        words, logs = (t or "").split(), []
        for d in domains:
            total = sum(sums[d].values())
            share = lambda b: math.log((sums[d][b] + mixing.SMOOTHING / mixing.BUCKETS * total) / (total * (1 + mixing.SMOOTHING)))  # noqa: E731, B023
            logs.append(math.log(0.5) + (mixing.EVIDENCE / len(words) * sum(share(bucket(w)) for w in words) if words else 0.0))
        top = max(logs)
        return [math.exp(x - top) / sum(math.exp(y - top) for y in logs) for x in logs]
    for r in out.collect():
        assert [r["__mix_p0"], r["__mix_p1"]] == pytest.approx(posterior(r.text), abs=1e-4)
        assert r["__mix_n_tokens"] == len((r.text or "").split())


def test_language_scores(spark):
    """The backoff, spelt out with plain dictionaries."""
    texts = {"en": "the house and the tree", "de": "das haus und der baum das", "fr": "la maison et un arbre"}
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts.items())] + [(9, None, "en"), (10, "no language", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    langs = sorted(texts)
    words = {lang: Counter(t.split()) for lang, t in texts.items()}
    grams = {n: {lang: Counter() for lang in langs} for n in range(1, 6)}
    for lang in langs:
        for w, c in words[lang].items():
            for n in grams:
                for k in range(len(w) + 3 - n):
                    grams[n][lang][f"<{w}>"[k : k + n]] += c
    def logs(table, item):
        kinds = len(set().union(*table.values()))
        return [math.log((table[lang][item] + 0.5) / (sum(table[lang].values()) + 0.5 * kinds)) for lang in langs]
    def word(w):
        if any(w in words[lang] for lang in langs):
            return logs(words, w)
        for n in range(5, 0, -1):
            known = [g for k in range(len(w) + 3 - n) for g in [f"<{w}>"[k : k + n]] if any(g in grams[n][lang] for lang in langs)]
            if known:
                return [sum(x) / len(known) for x in zip(*(logs(grams[n], g) for g in known))]
        return [0.0] * len(langs)
    tests = ["the maison", "Bäume und häuser", "zzz", "arbres", "qqqq haus", "12 !", None]
    out = {r.text: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([(t,) for t in tests], "text string"), model).collect()}
    for t in tests:
        found = langid._LETTERS.findall(t.lower()) if t else []
        if not found:
            assert out[t] == ("und", 0.0)
            continue
        total = [sum(x) for x in zip(*map(word, found))]
        best = max(range(len(langs)), key=lambda k: total[k])
        if sorted(total)[-1] - sorted(total)[-2] > 1e-4:
            assert out[t][0] == langs[best]
        assert out[t][1] == pytest.approx(1 / sum(math.exp(x - max(total)) for x in total), abs=1e-4)


def test_logistic_is_at_the_optimum():
    rng = np.random.RandomState(0)
    lists = [sorted(rng.choice(30, rng.randint(0, 8), False).tolist()) for _ in range(300)]
    dense = rng.randn(300, 1)
    y, weight = (rng.rand(300) < 0.3).astype(float), rng.rand(300)
    w = toxicity.logistic(toxicity.Rows(lists, 30, dense), y, weight, ridge=0.2)
    x = np.hstack([np.array([[k in own for k in range(30)] for own in lists], float), dense, np.ones((300, 1))])
    penalty = np.full(32, 0.2)
    penalty[-1] = 1e-6
    exact = np.zeros(32)
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-x @ exact))
        exact -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * exact)
    assert np.abs(w - exact).max() < 0.02


def test_chain_feeds_out_of_fold_odds():
    """The second category is the first one's, which words show: its model leans on the earlier log odds."""
    rng = np.random.RandomState(1)
    first = rng.rand(400) < 0.4
    lists = [sorted({0} if f else {1}) + [int(k) for k in sorted(rng.choice(np.arange(2, 40), 5, False))] for f in first]
    labels = np.column_stack([first, first ^ (rng.rand(400) < 0.05)]).astype(float)
    models = toxicity.fit(lists, 40, labels, np.arange(400) % toxicity.FOLDS, np.ones(400))
    assert len(models[0]) == 41 and len(models[1]) == 42 and models[1][40] > 0.1


def lay_out(blocks):
    """Expected lines straight from the blocks that a page was written from."""
    out = []
    for kind, body in blocks:
        if out and kind != "div":
            out.append("")
        elif out and last != "div":  # noqa: F821
            out.append("")
        if kind in ("p", "div"):
            out.append(" ".join(body))
        elif kind == "list":
            out += [f"- {x}" for x in body]
        elif kind == "ol":
            out += [f"{k}. {x}" for k, x in enumerate(body, 1)]
        elif kind == "pre":
            out += body
        elif kind == "table":
            n = max(map(len, body))
            wide = [max(max((len(line) for line in row[c]), default=0) if c < len(row) else 0 for row in body) for c in range(n)]
            for row in body:
                for k in range(max(1, *map(len, row))):
                    out.append("  ".join((row[c][k] if c < len(row) and k < len(row[c]) else "").ljust(wide[c]) for c in range(n)).rstrip())
        last = kind
    return "\n".join(out)


def test_layout_from_blocks():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    for _ in range(200):
        blocks, page = [], ["<html><head><title>unseen</title><style>.gone, #off {display: none}</style>"]
        for _ in range(rng.randint(1, 6)):
            kind = rng.choice(["p", "div", "list", "ol", "pre", "table"])
            end = rng.random() < 0.5
            if kind in ("p", "div"):
                body = [word() for _ in range(rng.randint(1, 5))]
                page.append(f"<{kind}>" + rng.choice([" ", "\n  ", "</b> <b>"]).join(body) + rng.choice(["", "<i class='x gone'>no</i>", "<!-- no -->"]) + (f"</{kind}>" if end or kind == "div" else ""))
            elif kind in ("list", "ol"):
                body = [word() for _ in range(rng.randint(1, 4))]
                tag = "ul" if kind == "list" else "ol"
                page.append(f"<{tag}>" + "".join(f"<li> {x}" + "</li>" * end for x in body) + f"</{tag}>")
            elif kind == "pre":
                body = [word() + "  " + word() for _ in range(rng.randint(1, 3))]
                page.append("<pre>\n" + "\n".join(body) + "</pre>")
            else:
                body = [[[word() for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
                page.append("<table>" + "".join("<tr>" + "".join("<td>" + "<br>".join(cell) + "</td>" * end for cell in row) for row in body) + "</table><p id=off>no</p>")
            blocks.append((kind, body))
        assert html.render("".join(page)) == lay_out(blocks), "".join(page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<table><tr><td><p>one</p><p>two</p><td>x</table>", "one  x\n\ntwo"),
        ("<table><tr><td>y<td><table><tr><td>in<td>ner<tr><td>a<td>b</table></table>", "y  in  ner\n   a   b"),
        ("<table><tr><td colspan=2>long title<td>R<tr><td>a<td>b<td>c</table>", "long title  R\na  b        c"),
        ("<style>.h{display:none} p#z{visibility:hidden} @media print{p{display:none}}</style><p>a<p class='k h'>b<p id=z>c<b style='visibility:visible'>d</b>", "a\n\nd"),
        ("<style>p{display:none} p.on{display:block} i{display:none!important}</style><p>a<p class=on>b<i style='display:inline'>c</i>", "b"),
    ],
)
def test_layout_cases(page, text):
    assert html.render(page) == text
