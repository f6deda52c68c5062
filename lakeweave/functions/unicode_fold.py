"""Arrow function that folds what is not Latin: Indic letters by the layout their scripts share, the rest by decomposition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

# Sounds by offset in an Indic block (0 to 0x7F); blocks start at 0x0900, every 0x80, up to 0x0D00.
VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "r", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "r", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x02: "n", 0x01: "n", 0x03: "h"}
CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh ng c ch j jh ny tt tth dd ddh nn t th d dh n n p ph b bh m y r r l l l v sh ss s h".split()))


def fold_text(text: str | None) -> str:
    out = []
    for c in unicodedata.normalize("NFC", text or ""):
        n = ord(c)
        if n < 128:
            out.append(c)
        elif 0x900 <= n < 0xD80:
            at = n % 0x80
            if 0x66 <= at <= 0x6F:
                out.append(chr(48 + at - 0x66))
            else:
                out.append(VOWELS.get(at) or SIGNS.get(at) or CONSONANTS.get(at, ""))
        else:
            out.append("".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) < 128))
    return "".join(out)


def fold_unicode(column):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if x is not None and x.isascii() else fold_text(x))

    return run(column)
