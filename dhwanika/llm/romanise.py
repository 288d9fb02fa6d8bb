"""Latin spellings of Devanagari, Telugu and Odia text, in the ways people type them."""

from __future__ import annotations

import unicodedata

# Code-point offsets inside an Indic block are shared by the scripts; fixed values of the standard.
CONSONANTS = dict(
    zip(
        [*range(0x15, 0x3A)],
        "k kh g gh n ch chh j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split(),
        strict=True,
    )
) | {0x5F: "y", 0x71: "v"}
VOWELS = {0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "ri", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x72: "e"}
SIGNS = {0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
BLOCKS = {0x0900: "deva", 0x0B00: "orya", 0x0C00: "telu"}
NUKTA = {"k": "q", "ph": "f", "j": "z"}


def _block(c: str) -> int | None:
    o = ord(c)
    b = o & ~0x7F
    return b if b in BLOCKS else None


def romanise(text: str, long: bool = False, w: bool = False, nukta: bool = False) -> str:
    """Latin letters for Indic ones: ``long`` doubles long vowels, ``w`` writes v as w.

    The vowel of a Devanagari word's last consonant is silent.  Other signs stay.
    """
    s = unicodedata.normalize("NFC", text)
    out: list[str] = []
    i, n = 0, len(s)
    while i < n:
        c = s[i]
        b = _block(c)
        if b is None:
            out.append(c)
            i += 1
            continue
        k = ord(c) - b
        if k in CONSONANTS:
            letter = CONSONANTS[k]
            i += 1
            if i < n and _block(s[i]) == b and ord(s[i]) - b == 0x3C:
                letter = NUKTA.get(letter, letter) if nukta else letter
                i += 1
            out.append(letter)
            nxt = ord(s[i]) - b if i < n and _block(s[i]) == b else None
            if nxt == 0x4D:
                i += 1
            elif nxt in SIGNS:
                out.append(SIGNS[nxt])
                i += 1
            elif nxt is not None and nxt < 0x64 or b != 0x0900:
                out.append("a")
            elif len(out) < 2 or not out[-2][-1:].isalpha():
                out.append("a")  # a word of one consonant
        else:
            i += 1
            if k in VOWELS:
                out.append(VOWELS[k])
            elif k in SIGNS:
                out.append(SIGNS[k])
            elif k in (0x01, 0x02):
                out.append("n")
            elif k == 0x03:
                out.append("h")
            elif 0x66 <= k <= 0x6F:
                out.append(str(k - 0x66))
            elif k in (0x64, 0x65):
                out.append(".")
    t = "".join(out)
    for a, x in (("A", "aa"), ("I", "ee"), ("U", "oo")) if long else (("A", "a"), ("I", "i"), ("U", "u")):
        t = t.replace(a, x)
    return t.replace("v", "w") if w else t
