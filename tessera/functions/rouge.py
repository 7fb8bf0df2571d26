"""ROUGE-L F1 of word sequences, with or without Porter stemming.

The longest common subsequence is quadratic in the lengths and runs in an Arrow
UDF, one row of the table at a time in machine integers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(stem: str) -> int:
    """Runs of vowels that a consonant follows."""
    kinds = re.sub(r"(.)\1+", r"\1", "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem))))
    return kinds.count("vc")


def _vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _short_end(w: str) -> bool:
    """consonant, vowel, consonant other than w, x, y."""
    n = len(w)
    return n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# Porter's published suffix tables (1980), steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """Porter's algorithm; words of up to three letters stay as they are."""
    if len(w) <= 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (e := _longest(w, table)) and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    if (e := _longest(w, STEP4)) and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if _double(w) and w.endswith("l") and _measure(w) > 1:
        w = w[:-1]
    return w


def words(text: str, stemmed: bool) -> list[str]:
    found = re.findall("[a-z0-9]+", text.lower())
    return [stem(w) for w in found] if stemmed else found


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: bit-parallel, one big integer for a row of the table."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & masks.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def f1(prediction: str | None, reference: str | None, stemmed: bool = True) -> float | None:
    if prediction is None or reference is None:
        return None
    p, r = words(prediction, stemmed), words(reference, stemmed)
    common = lcs(p, r) if p and r else 0
    return 2 * common / (len(p) + len(r)) if common else 0.0


def rouge_l(prediction: Column, reference: Column, stemmed: bool = True) -> Column:
    """F1 = 2 PR / (P + R), which is 2 LCS / (words of both)."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for p, r in batches:
            yield pa.array([f1(a, b, stemmed) for a, b in zip(p.to_pylist(), r.to_pylist())], pa.float64())

    return F.arrow_udf(run, "double")(prediction, reference)
