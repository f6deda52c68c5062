"""Normalisation of names and addresses as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters and what they fold to.
LATIN_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
LATIN_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
LATIN_WORDS = {"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d"}

# States and regions by code, with the names they go by.
INDIA = {
    "mh": ["maharashtra", "महाराष्ट्र"], "dl": ["delhi", "दिल्ली", "nct of delhi"], "up": ["uttar pradesh", "उत्तर प्रदेश"],
    "ka": ["karnataka", "ಕರ್ನಾಟಕ"], "tn": ["tamil nadu", "tamilnadu", "தமிழ்நாடு"], "gj": ["gujarat", "ગુજરાત"],
    "wb": ["west bengal", "পশ্চিমবঙ্গ"], "tg": ["telangana", "తెలంగాణ"], "hr": ["haryana", "हरियाणा"],
    "rj": ["rajasthan", "राजस्थान"], "kl": ["kerala", "keralam", "കേരളം"], "br": ["bihar", "बिहार"],
    "mp": ["madhya pradesh", "मध्य प्रदेश"], "ap": ["andhra pradesh", "ఆంధ్రప్రదేశ్", "a p"], "pb": ["punjab", "ਪੰਜਾਬ"],
    "od": ["odisha", "orissa", "ଓଡ଼ିଶା"],
}
US = {
    "al": ["alabama"], "ak": ["alaska"], "az": ["arizona"], "ar": ["arkansas"], "ca": ["california"], "co": ["colorado"],
    "ct": ["connecticut"], "de": ["delaware"], "dc": ["district of columbia"], "fl": ["florida"], "ga": ["georgia"],
    "hi": ["hawaii"], "id": ["idaho"], "il": ["illinois"], "in": ["indiana"], "ia": ["iowa"], "ks": ["kansas"],
    "ky": ["kentucky"], "la": ["louisiana"], "me": ["maine"], "md": ["maryland"], "ma": ["massachusetts"],
    "mi": ["michigan"], "mn": ["minnesota"], "ms": ["mississippi"], "mo": ["missouri"], "mt": ["montana"],
    "ne": ["nebraska"], "nv": ["nevada"], "nh": ["new hampshire"], "nj": ["new jersey"], "nm": ["new mexico"],
    "ny": ["new york"], "nc": ["north carolina"], "nd": ["north dakota"], "oh": ["ohio"], "ok": ["oklahoma"],
    "or": ["oregon"], "pa": ["pennsylvania"], "ri": ["rhode island"], "sc": ["south carolina"], "sd": ["south dakota"],
    "tn": ["tennessee"], "tx": ["texas"], "ut": ["utah"], "vt": ["vermont"], "va": ["virginia"], "wa": ["washington"],
    "wv": ["west virginia"], "wi": ["wisconsin"], "wy": ["wyoming"],
}
FRANCE = {"hdf": ["hauts de france", "nord", "pas de calais"], "naq": ["nouvelle aquitaine", "gironde"], "pdl": ["pays de la loire", "loire atlantique"]}
REGIONS = {"India": INDIA, "US": US, "France": FRANCE}

# Abbreviations in addresses, and cities by older names.
ABBREVIATIONS = {
    "rd": "road", "ave": "avenue", "av": "avenue", "dr": "drive", "ln": "lane", "blvd": "boulevard", "hwy": "highway",
    "pkwy": "parkway", "cir": "circle", "trl": "trail", "ter": "terrace", "sq": "square", "fl": "floor", "flr": "floor",
    "apt": "apartment", "ste": "suite", "bldg": "building", "no": "no", "n": "north", "s": "south", "e": "east",
    "w": "west", "ct": "court", "pl": "place", "mkt": "market", "ngr": "nagar", "opp": "opposite", "nr": "near",
    "bhd": "behind", "st": "street",
}
ABBREVIATIONS_FRANCE = {
    "r": "rue", "bd": "boulevard", "bld": "boulevard", "av": "avenue", "ave": "avenue", "all": "allee", "crs": "cours",
    "chem": "chemin", "rte": "route", "imp": "impasse", "pl": "place", "st": "saint", "ste": "sainte",
    "apt": "appartement", "bat": "batiment", "res": "residence", "qu": "quai", "n": "no",
}
CITIES = {"bombay": "mumbai", "calcutta": "kolkata", "bengaluru": "bangalore", "madras": "chennai", "gurugram": "gurgaon", "ahmadabad": "ahmedabad"}

# Words of a name that do not tell businesses apart.
LEGAL = (
    "llc|l l c|inc|incorporated|corp|corporation|co|company|ltd|limited|pvt|private|llp|lp|l p|plc|pc|p c|pllc|sarl|s a r l|"
    "sas|s a s|sasu|eurl|sci|sa|ei|the|and|dba|d b a|aka|fka|f k a|formerly|known|as|doing|business|trading|limittedd|"
    "praaivett|praiveett|lnc|pvtltd|com|www|net|org"
)

PLACEHOLDER = r"^(null|none|n/?a|nan|-*)$"


def mapping(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def mapped(word: Column, values: Column) -> Column:
    """The word's value, or the word where there is none."""
    return F.coalesce(F.try_element_at(values, word), word)


def squeeze(e: Column) -> Column:
    return F.trim(F.regexp_replace(e, r"\s+", " "))


def fold_latin(e: Column) -> Column:
    """Latin letters to ASCII, in the JVM. Null becomes empty; a stray Â (a broken no-break space) becomes a space."""
    e = F.translate(F.replace(F.coalesce(e, F.lit("")), F.lit("Â"), F.lit(" ")), LATIN_FROM, LATIN_TO)
    for letter, to in LATIN_WORDS.items():
        e = F.replace(e, F.lit(letter), F.lit(to))
    return e


def fold(e: Column) -> Column:
    """As fold_latin(), and letters of Indic scripts by their common layout, other marks by decomposition.

    Apply it to rows that are not ASCII; see functions.unicode_fold for the Arrow function that does the second part.
    """
    from lakeweave.functions.unicode_fold import fold_unicode

    return fold_unicode(fold_latin(e))


def basic(e: Column, folded: bool = False) -> Column:
    """Folded, lower case, & as a word, everything but a-z and 0-9 a space, single spaces."""
    e = F.lower(e if folded else fold_latin(e))
    return F.trim(F.regexp_replace(F.replace(e, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


class _Letters(dict):
    """For str.translate() of lower-case text: letters and digits as they are, all else a space."""

    def __missing__(self, c: int) -> str:
        self[c] = chr(c) if 48 <= c <= 57 or 97 <= c <= 122 else " "
        return self[c]


_FOLDED = str.maketrans(dict(zip(LATIN_FROM, LATIN_TO)) | LATIN_WORDS | {"Â": " "})
_LETTERS, _NOT_ASCII = _Letters(), re.compile(r"[^\x00-\x7f]+")


def basic_words(text: str | None) -> list[str]:
    """The words of basic(), in Python: much cheaper on whole documents than three passes of regular expressions."""
    text = text or ""
    return (text if text.isascii() else _NOT_ASCII.sub(lambda m: m[0].translate(_FOLDED), text)).lower().replace("&", " and ").translate(_LETTERS).split()


def unleet(name: Column) -> Column:
    """Digits that stand for letters, in words that have both."""
    fix = lambda w: F.when(w.rlike("[a-z]") & w.rlike("[0-9]"), F.translate(w, "013547", "olesat")).otherwise(w)
    return F.array_join(F.transform(F.split(name, " "), fix), " ")


def name_core(name: Column) -> Column:
    return squeeze(F.regexp_replace(name, rf"\b({LEGAL})\b", " "))


def region_map(country: str) -> dict[str, str]:
    out = {}
    for code, names in REGIONS[country].items():
        if country != "France":
            out[code] = "zs" + code
        out |= {n: "zs" + code for n in names}
    return out


def _region(values: Column, key):
    return lambda p: F.coalesce(F.try_element_at(values, p), F.try_element_at(values, key(p)), p)


def address(raw: Column, country: Column) -> Column:
    """Components that name a region become its code, placeholders go, leading zeros go, words are spelt out."""
    parts = F.transform(F.split(F.replace(F.coalesce(raw, F.lit("")), F.lit("Â"), F.lit(" ")), ","), lambda p: F.lower(F.trim(p)))
    parts = F.filter(parts, lambda p: ~p.rlike(PLACEHOLDER))
    key = lambda p: squeeze(F.regexp_replace(F.lower(fold_latin(p)), "[^a-z0-9]", " "))
    named = None
    for name in REGIONS:
        one = F.transform(parts, _region(mapping(region_map(name)), key))
        named = F.when(country == name, one) if named is None else named.when(country == name, one)
    words = F.split(F.regexp_replace(basic(F.array_join(named.otherwise(parts), " , ")), r"\b0+(\d)", "$1"), " ")
    spell = lambda abbreviations: F.transform(words, lambda w: mapped(mapped(w, mapping(abbreviations)), mapping(CITIES)))
    return squeeze(F.array_join(F.when(country == "France", spell(ABBREVIATIONS_FRANCE)).otherwise(spell(ABBREVIATIONS)), " "))


def skeleton_word(w: Column) -> Column:
    """The consonants of a word as they sound: spelling variants of one name have one skeleton."""
    for a, b in (("ph", "f"), ("ck", "k"), ("c", "k"), ("q", "k"), ("z", "s"), ("w", "v"), ("x", "ks")):
        w = F.replace(w, F.lit(a), F.lit(b))
    rest = F.regexp_replace(F.substring(w, 2, 1 << 20), "[aeiouyh]", "")
    return F.regexp_replace(F.concat(F.substring(w, 1, 1), rest), r"(.)\1+", "$1")


def skeleton(name: Column) -> Column:
    words = F.filter(F.split(name, " "), lambda w: (F.char_length(w) >= 3) & w.rlike("^[a-z]+$"))
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("zk"), skeleton_word(w))), " ")


def tokens(e: Column, least: int = 2) -> Column:
    """Distinct words of at least `least` characters."""
    return F.filter(F.array_distinct(F.split(e, " ")), lambda w: F.char_length(w) >= least)


def trigrams(e: Column, spaces: bool = False) -> Column:
    """Distinct runs of three characters; linear in the length, which cutting each run out of the text would not be."""
    e = F.concat(F.lit(" "), e, F.lit(" ")) if spaces else F.replace(e, F.lit(" "), F.lit(""))
    n, letters = F.char_length(e), F.split(e, "")
    from_ = lambda k: F.slice(letters, k, n)
    grams = F.zip_with(F.zip_with(letters, from_(2), lambda x, y: F.concat(x, y)), from_(3), lambda x, y: F.concat(x, y))
    return F.when(n >= 3, F.array_distinct(F.slice(grams, 1, F.greatest(n - 2, F.lit(1))))).otherwise(F.array().cast("array<string>"))


def numbers(e: Column) -> Column:
    return F.regexp_extract_all(e, F.lit(r"(\b\d+\b)"), F.lit(1))


def sorted_words(e: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(e, " "), lambda w: F.char_length(w) >= 2)), " ")


def first_match(e: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(e, pattern, 0), F.lit(""))
