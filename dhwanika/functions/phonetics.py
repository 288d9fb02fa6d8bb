"""Phonetic encoding of Devanagari words and weighted phoneme distance, as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .unicode import WHITE, bare_word, odd_digits, squeeze

# Consonant classes, vowels and vowel signs.
CONSONANTS = {
    "K": "कखगघ", "N": "ङञणन", "C": "चछ", "J": "जझ", "T": "टठतथ", "D": "डढदध", "P": "पफ", "B": "बभव",
    "M": "म", "Y": "य", "R": "र", "L": "लळ", "S": "शषस", "H": "ह",
}
VOWELS = {"a": "अआ", "i": "इई", "u": "उऊ", "e": "एऐऍऎ", "o": "ओऔऑऒ"}
SIGNS = {"a": "ा", "i": "िी", "u": "ुू", "e": "ेैॅॆ", "o": "ोौॉॊ"}
VOCALIC_R, VOCALIC_R_SIGN = "ऋॠ", "ृ"
VIRAMA, ANUSVARA, VISARGA = "्", "ं", "ः"
# Spelling variants folded in the canonical form.
VARIANTS = ("ँॅॉॲ", "ंेोअ")
SPACED = "।॥!?,;:\"'`~*_"
# Sounds that recognisers confuse.
NEAR = ["KH", "TD", "PB", "BM", "NM", "JC", "JY", "RL", "SC", "SH", "ao", "ie", "uo", "ae", "ei", "nN", "nM"]
VOWEL_SOUNDS = "aeiou"
NEAR_COST, VOWEL_COST, MIXED_COST, OTHER_COST = 0.4, 0.6, 1.2, 1.0
LIGHT, LIGHT_COST, FULL_COST = "aeioun", 0.5, 1.0

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MOVED = "".join(chr(0xE041 + i) for i in range(26))  # ASCII letters of the text, out of the classes' way
_RI = chr(0xE000)


def norm_word(c: Column) -> Column:
    """Canonical spelling of a word; empty for null."""
    t = F.translate(bare_word(c.cast("string")), *VARIANTS)
    t = F.translate(t, SPACED, " " * len(SPACED))
    t = F.regexp_replace(t, f"{WHITE}*-{WHITE}*", "-")
    return F.coalesce(squeeze(t), F.lit(""))


def _letters(groups: dict[str, str]) -> str:
    return "".join(groups.values())


def _sounds(groups: dict[str, str]) -> str:
    return "".join(k * len(v) for k, v in groups.items())


def phon_of(canonical: Column, drop_final_nasal: bool = True) -> Column:
    """Phoneme string of a word in its canonical spelling (``norm_word``)."""
    cons = _letters(CONSONANTS)
    sign = _letters(SIGNS) + VOCALIC_R_SIGN
    origin = VIRAMA + cons + _letters(VOWELS) + _letters(SIGNS) + VOCALIC_R + VOCALIC_R_SIGN + ANUSVARA + VISARGA
    target = _sounds(CONSONANTS) + _sounds(VOWELS) + _sounds(SIGNS) + _RI * 3 + "nH"

    def sounds(t: Column, moved: str) -> Column:
        t = F.regexp_replace(t, f"(?<![{cons}])[{sign}]", "")  # a vowel sign counts only right after a consonant
        t = F.regexp_replace(t, f"([{cons}])(?![{VIRAMA}{sign}]|\\z)", "$1a")
        # the virama is deleted, so it has to come last in ``translate``'s list
        t = F.replace(F.translate(t, origin[1:] + VIRAMA, target), F.lit(_RI), F.lit("ri"))
        return F.regexp_replace(t, f"[^A-Za-z{moved}\\p{{Nd}}{odd_digits()}]", "")

    t = F.translate(canonical, " -" + _RI, "")
    # few words have Latin letters, which have to stand aside while the others become Latin ones
    latin = F.translate(sounds(F.translate(t, _UPPER + _UPPER.lower() + _MOVED, _MOVED * 2), _MOVED), _MOVED, _UPPER)
    t = F.when(t.rlike(f"[A-Za-z{_MOVED}]"), latin).otherwise(sounds(t, ""))
    t = F.regexp_replace(t, r"(.)\1+", "$1")
    return F.regexp_replace(t, r"n?H\z|n\z" if drop_final_nasal else r"H\z", "")


def phon(c: Column, drop_final_nasal: bool = True) -> Column:
    """Phoneme string: consonants in upper case, vowels in lower; empty for null and other scripts."""
    return phon_of(norm_word(c), drop_final_nasal)


def skeleton(c: Column) -> Column:
    """Consonants of the phoneme string."""
    return F.regexp_replace(phon(c), "[^A-Z]", "")


def sub_cost(a: Column, b: Column) -> Column:
    """Cost of one phoneme for another."""
    near = F.lit([*NEAR, *[x[::-1] for x in NEAR]])
    va, vb = F.instr(F.lit(VOWEL_SOUNDS), a) > 0, F.instr(F.lit(VOWEL_SOUNDS), b) > 0
    return (
        F.when(a == b, 0.0)
        .when(F.array_contains(near, F.concat(a, b)), NEAR_COST)
        .when(va & vb, VOWEL_COST)
        .when(va != vb, MIXED_COST)
        .otherwise(OTHER_COST)
    )


def indel_cost(c: Column) -> Column:
    """Cost of a phoneme put in or left out."""
    return F.when(F.instr(F.lit(LIGHT), c) > 0, LIGHT_COST).otherwise(FULL_COST)


CELLS = 1 << 22  # signs padded to one length that are measured side by side


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, f"<U{max(width, 1)}").view(np.uint32).reshape(len(texts), max(width, 1))


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Weighted edit distances of many pairs, all pairs of a group moving through the table together."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.zeros(len(a))
    width = la + lb + 2
    order = np.argsort(width, kind="stable")  # alike lengths together, so that little is padded
    # a group ends where padding all of it to its longest pair would pass the bound
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * int(width[order[at + n]]) <= CELLS:
            n += 1
        own = order[at : at + n]
        out[own] = _together([a[i] for i in own], [b[i] for i in own], la[own], lb[own])
        at += n
    return out


def _together(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    wa, wb = int(la.max()), int(lb.max())
    used, inverse = np.unique(np.r_[_codes(a, wa).ravel(), _codes(b, wb).ravel()], return_inverse=True)
    signs = [chr(c) for c in used]
    near = {x for p in NEAR for x in (p, p[::-1])}
    vowel = [c in VOWEL_SOUNDS for c in signs]
    sub = np.array([[0.0 if x == y else NEAR_COST if x + y in near else VOWEL_COST if v and w else MIXED_COST if v != w else OTHER_COST for y, w in zip(signs, vowel)] for x, v in zip(signs, vowel)])
    indel = np.array([LIGHT_COST if c in LIGHT else FULL_COST for c in signs])
    n = len(a)
    ca, cb = inverse[: n * max(wa, 1)].reshape(n, -1), inverse[n * max(wa, 1) :].reshape(n, -1)
    rows = np.arange(n)
    ib = indel[cb]
    row = np.zeros((wb + 1, n))
    for j in range(1, wb + 1):
        row[j] = row[j - 1] + ib[:, j - 1]
    found = row[lb, rows]
    for i in range(1, wa + 1):
        x = ca[:, i - 1]
        cost = indel[x]
        new = np.empty_like(row)
        new[0] = row[0] + cost
        for j in range(1, wb + 1):
            new[j] = np.minimum(np.minimum(row[j] + cost, new[j - 1] + ib[:, j - 1]), row[j - 1] + sub[x, cb[:, j - 1]])
        row = new
        ends = la == i
        found[ends] = row[lb[ends], rows[ends]]
    return found


@pandas_udf(DoubleType())
def pdist(a: pd.Series, b: pd.Series) -> pd.Series:
    """Weighted edit distance of two phoneme strings; null if either is null.

    An Arrow UDF over whole batches: as nested higher-order functions, which Spark interprets, the same
    table took twenty times as long.
    """
    some = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if some.any():
        out[some] = distances(a[some].tolist(), b[some].tolist())
    return pd.Series(out).where(pd.Series(some), None)


def similarity(distance: Column, a: Column, b: Column) -> Column:
    near = F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.greatest(F.length(a), F.length(b), F.lit(1)))
    return F.when(distance.isNotNull(), near)


def psim(a: Column, b: Column) -> Column:
    """Similarity of two phoneme strings in 0..1; 1 for two empty ones."""
    return F.when((a == "") & (b == ""), 1.0).otherwise(similarity(pdist(a, b), a, b))
