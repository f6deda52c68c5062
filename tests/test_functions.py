from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.functions import strings as S
from lakeweave.functions import text as T
from lakeweave.functions.unicode_fold import fold_text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_address(spark):
    rows = [("159 Maple Ave, Greenfield, KY", "US"), ("Flat No. C-04, Mumbai, महाराष्ट्र", "India"), ("8 Rue X, Lille, Hauts-de-France", "France"), ("1 N St, N/A, TN", "US"), (None, "US")]
    df = spark.createDataFrame(rows, "a string, c string")
    got = [r[0] for r in df.select(T.address(F.col("a"), F.col("c"))).collect()]
    assert got == ["159 maple avenue greenfield zsky", "flat no c 4 mumbai zsmh", "8 rue x lille zshdf", "1 north street zstn", ""]


def test_names(spark):
    assert one(spark, "channe1", T.unleet) == "channel"
    assert one(spark, "acme tools llc", T.name_core) == "acme tools"
    assert one(spark, "Café & Söhne  Straße", T.basic) == "cafe and sohne strasse"


def test_skeletons(spark):
    for word, want in {"praaivett": "prvt", "private": "prvt", "phoenix": "fnks", "jackson": "jksn", "quick": "k", "wazir": "vsr", "omega": "omg"}.items():
        assert one(spark, word, T.skeleton_word) == want


def test_basic_is_idempotent(spark):
    df = spark.createDataFrame([("Ünïcode & Co. 12",), ("",), (None,)], "x string").select(T.basic(F.col("x")).alias("b"))
    assert [tuple(r) for r in df.select("b", T.basic(F.col("b")).alias("c")).collect() if r[0] != r[1]] == []


def test_basic_in_python_is_basic(spark):
    """records are normalised in Python; every letter that Spark's lower() or the folding turns into ASCII counts."""
    odd = ["", "  ", None, "&", "a&b\tC\nd\x0be\u00a0f", "Â Straße Œuvre œuvre ØL øl ŁÓDŹ łódź", "12a 0x &&", "नमस्ते 123 abc"]
    rows = [(x,) for x in odd] + [(f"A{chr(c)}b Z",) for c in range(1, 0x2200)] + [("K\u0130\U0001d400z ﬁ",)]
    for text, want in spark.createDataFrame(rows, "x string").select("x", T.basic(F.col("x"))).collect():
        assert " ".join(T.basic_words(text)) == want


def test_fold():
    assert fold_text("महाराष्ट्र")[0] == "m" and fold_text("Åß").startswith("A") and fold_text(None) == ""


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j], row[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_similarities(a, b):
    assert S.common_subsequence(a, b) == brute_lcs(a, b)
    for f in (S.ratio, S.partial_ratio, S.token_set_ratio):
        assert 0 <= f(a, b) <= 100
    assert S.ratio(a, b) == S.ratio(b, a)
    assert 0 <= S.jaro_winkler(a, b) <= 1
    assert not a or S.partial_ratio(a, "xx" + a + "yy") == 100


def test_known_similarities():
    assert round(S.jaro_winkler("martha", "marhta"), 6) == 0.961111
    assert S.token_set_ratio("acme tools", "tools acme inc") == 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.one_of(st.text("ab c", max_size=14), st.text("ab", min_size=60, max_size=70), st.text(max_size=5))] * 2), max_size=12))
def test_many_similarities_are_those_of_each(pairs):
    """of many pairs at once; empty strings, strings of more characters than an integer has bits, any characters."""
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert S.ratios(a, b) == [(S.ratio(x, y), S.partial_ratio(x, y)) for x, y in pairs]
    assert S.ratios(a, b, windows=False) == [S.ratio(x, y) for x, y in pairs]
    assert S.jaro_winklers(a, b) == [S.jaro_winkler(x, y) for x, y in pairs]
    assert S.token_set_ratios(a, b) == [S.token_set_ratio(x, y) for x, y in pairs]


def test_similarities_of_many_characters():
    a, b = ("".join(map(chr, range(at, at + 60))) for at in (5000, 5020))
    pairs = [(a[i : i + 40], b[i : i + 50]) for i in range(10)] + [(chr(6000 + 60 * i) * 3 + "x" * i, "".join(map(chr, range(6000 + 60 * i, 6060 + 60 * i)))) for i in range(8)]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert S.ratios(a, b) == [(S.ratio(x, y), S.partial_ratio(x, y)) for x, y in pairs] and S.jaro_winklers(a, b) == [S.jaro_winkler(x, y) for x, y in pairs]


def test_similarities_are_not_taken_pair_by_pair(spark, monkeypatch):
    """names as usual are compared many at once; null counts as empty."""
    for f in ("ratio", "partial_ratio", "jaro_winkler", "token_set_ratio"):
        plain = getattr(S, f)
        monkeypatch.setattr(S, f, lambda x, y, plain=plain: (_ for _ in ()).throw(AssertionError((x, y))) if x and y else plain(x, y))
    names = [("acme tools inc", "tools of acme"), ("alpha road", "alpha road")]
    assert S.ratios(*zip(*names))[1] == (100.0, 100.0) and S.jaro_winklers(*zip(*names))[1] == 1.0 and S.token_set_ratios(*zip(*names))[1] == 100.0
    row = spark.createDataFrame([(None, "a")], "x string, y string").select(S.similarities("x", "y").alias("s")).first()["s"]
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
