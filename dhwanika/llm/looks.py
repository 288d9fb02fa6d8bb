"""One form for texts that look the same.

Normalising whole texts is wasted where nearly all of them are stable already.  A table over all code
points holds the quick-check property of the form below: *stable* code points never change, whatever
stands next to them.  Over a batch the table is read at once; the unstable stretches are cut out with
the context they may combine with (back to the sign they belong to, on to the next stable one), each
distinct stretch is normalised once, and the results are spliced into the unchanged text.

The form keeps what can be seen: case, digits' shapes, every printed sign, mark and stop.  It drops what
prints nothing, makes any white space one blank, and fixes width, code block, make-up and mark order.

There are two of it.  The form to compare by also gives letters of other alphabets, the zeros of the Indic
scripts and the bar the sign they look like, wherever they stand.  The form to store (``stored``) does
that only to letters inside a word that holds Latin letters too, and leaves a Russian word, a table's bars
and a text's own zeros alone.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import hot_keys, join_salted, materialize

# Letters of other alphabets with the shape of a Latin one, fixed values by alphabet and code point.
ALIKE = {
    "cyrillic": ("АВЕЅІЈКМНОРСТУХҮӀԌԚԜаеѕіјорсухѵһԁԛԝ", "ABESIJKMHOPCTYXYIGQWaesijopcyxvhdqw"),
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορ", "ABEZHIKMNOPTYXavop"),
    "armenian": ("ՕՍզհոսօ", "OUqhnuo"),
    "cherokee": ("ᎠᎡᎢᎩᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏚᏞᏟᏢᏦᏧ", "DRTyAJEWMHGZbRSLCPKd"),
    "lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "phonetic": ("ɑɡ", "ag"),
}
TWINS = {a: b for signs, latin in ALIKE.values() for a, b in zip(signs, latin, strict=True)}
_LETTERS = re.compile(rf"\w*[{''.join(TWINS)}]\w*")
_LATIN = re.compile("[A-Za-z]")
_letter_twins = str.maketrans(TWINS)
#: Zeros of the Indic scripts are one circle.
ZEROS = {chr(o): "०" for o in range(0x900, 0xE00) if unicodedata.name(chr(o), "").endswith(" DIGIT ZERO")}
#: Signs of one shape: hyphens and apostrophes; the bar typed for a danda.
SIGNS = {"‐": "-", "‑": "-", "ʼ": "’"}
TWINS |= ZEROS | SIGNS | {"|": "।"}
# Vowel signs and letters that print as one when written in parts (longest parts first where nested).
MAKE_UP = {
    "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ", "ाॆ": "ॊ",
    "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "अॊ": "ऒ", "अॅ": "ॲ", "अॆ": "ऄ",
    "आे": "ओ", "आै": "औ", "आॅ": "ऑ", "आॆ": "ऒ", "एे": "ऐ", "एॅ": "ऍ", "एॆ": "ऎ",
    "ଅା": "ଆ", "ଏୗ": "ଐ", "ଓୗ": "ଔ",
    "ఒౕ": "ఓ", "ఒౌ": "ఔ", "ిౕ": "ీ", "ెౕ": "ే", "ొౕ": "ో",
}
#: Compatibility decompositions whose shape is that of their parts.
SAME_SHAPE = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

_fold: tuple[dict[str, str], dict[str, str]] = ({}, {})
_tables: dict[bool, np.ndarray] = {}
STABLE, UNSTABLE, MARK, COMBINES, OPENS, BLANK, BORDER = 0, 1, 2, 4, 8, 16, 32
SEPARATOR = 0xE000  # private use: stands between texts of a batch, never part of one


def _ignorable(c: str) -> bool:
    """Prints nothing: format and control characters, joiners, variation selectors."""
    k, o = unicodedata.category(c), ord(c)
    return (k in ("Cf", "Cc") and not c.isspace()) or o == 0x34F or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x115F, 0x1160, 0x17B4, 0x17B5)


def _one(c: str, stored: bool = False) -> str:
    """A code point without its neighbours: width, block and ligature undone."""
    if (known := _fold[stored].get(c)) is None:
        known = c
        tag, *parts = unicodedata.decomposition(c).split() or [""]
        if _ignorable(c):
            known = ""
        elif c.isspace():
            known = " "
        elif tag in SAME_SHAPE and parts[0] != "0020":
            known = "".join(_one(chr(int(p, 16)), stored) for p in parts)
        else:
            known = (SIGNS if stored else TWINS).get(c, c)
        _fold[stored][c] = known
    return known


def _mark_key(c: str) -> int:
    """Stored order of the marks of one sign: nukta, virama, vowel signs, then what nasalises."""
    name = unicodedata.name(c, "")
    if name.endswith("SIGN NUKTA"):
        return 0
    if name.endswith("SIGN VIRAMA"):
        return 1
    if name.endswith(("SIGN CANDRABINDU", "SIGN ANUSVARA", "SIGN VISARGA")):
        return 3
    return 2


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


def _in_latin_words(text: str) -> str:
    """Letters of other alphabets made Latin in the words that hold Latin letters."""
    return _LETTERS.sub(lambda m: m[0].translate(_letter_twins) if _LATIN.search(m[0]) else m[0], text)


def canonical(text: str, stored: bool = False) -> str:
    """The form of a whole text, without the quick check (the definition of the form)."""
    return _in_latin_words(_canonical(text, True)) if stored else _canonical(text, False)


def _canonical(text: str, stored: bool) -> str:
    one = lambda c: _one(c, stored)
    s = unicodedata.normalize("NFD", "".join(map(one, text)))
    s = "".join(map(one, s))
    out: list[str] = []
    i = 0
    while i < len(s):
        base = i + (i > 0 or not _is_mark(s[0]))  # a text may begin with marks that have no sign
        j = base
        while j < len(s) and _is_mark(s[j]):
            j += 1
        # Indic marks sort among themselves; others keep the canonical order they have
        marks = s[base:j]
        if len(marks) > 1 and all(0x900 <= ord(m) < 0xD80 for m in marks):
            marks = "".join(sorted(marks, key=_mark_key))
        out += [s[i:base], marks]
        i = j
    s = unicodedata.normalize("NFC", "".join(out))
    while True:  # parts may nest: two steps lead from three parts to one sign
        t = s
        for a, b in MAKE_UP.items():
            if a in t:
                t = t.replace(a, b)
        if t == s:
            break
        s = t
    return unicodedata.normalize("NFC", " ".join(s.split()))


def _properties(stored: bool = False) -> np.ndarray:
    """Quick-check property of every code point."""
    if stored not in _tables:
        t = np.zeros(sys.maxunicode + 1, np.uint8)
        for o in range(sys.maxunicode + 1):
            if 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0xE000 <= o < 0xF900 or 0xD800 <= o < 0xE000 or o >= 0xF0000:
                t[o] = UNSTABLE if 0xAC00 <= o < 0xD7A4 or o >= 0xF0000 else STABLE
                continue
            c = chr(o)
            k = unicodedata.category(c)
            if k == "Cn":
                continue
            if k[0] == "M":
                # nukta and non-Indic marks may compose or decompose with the sign before them
                t[o] = MARK if 0x900 <= o < 0xD80 else MARK | COMBINES
            elif _one(c, stored) != c or (o > 0x7F and unicodedata.normalize("NFC", c) != c):
                t[o] = UNSTABLE
        t[0x20] = BLANK
        t[SEPARATOR] = BORDER
        t[_combining()] |= COMBINES
        t[_openers()] |= OPENS
        _tables[stored] = t
    return _tables[stored]


def spans(points: np.ndarray, stored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [a, b) that may change, with the context they may combine with.

    ``points`` are texts divided, begun and ended by SEPARATOR.  A single mark on a sign is stable
    unless the two compose, decompose or print as another sign; two marks in a row, a mark that
    combines, and every unstable code point open a stretch.
    """
    prop = _properties(stored)[points]
    mark, blank, border = (prop & MARK).astype(bool), (prop & BLANK).astype(bool), (prop & BORDER).astype(bool)
    after = lambda x: np.r_[False, x[:-1]]  # noqa: E731 - the same about the code point before
    hot = (prop & UNSTABLE).astype(bool)
    # some letters have parts
    hot |= mark & ((prop & COMBINES).astype(bool) | after((prop & (MARK | OPENS)).astype(bool)))
    # single inner blanks are stable; blanks in a row and at a text's ends are not
    hot |= blank & (after(blank | border) | np.r_[border[1:], False])
    if not hot.any():
        return np.empty(0, np.intp), np.empty(0, np.intp)
    soft = mark | hot | blank
    reach = soft.copy()
    reach[:-1] |= soft[1:] & ~border[:-1]  # the sign before a soft stretch belongs to it
    edge = np.diff(np.r_[0, reach.view(np.int8), 0])
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    count = np.r_[0, np.cumsum(hot)]
    keep = count[b] > count[a]
    return a[keep], b[keep]


_cached: dict[str, np.ndarray] = {}


def _combining() -> np.ndarray:
    """Indic marks that combine with a letter before them: nuktas, length marks, decomposable signs."""
    if "n" not in _cached:
        marks = [chr(o) for o in range(0x900, 0xD80) if _is_mark(chr(o))]
        _cached["n"] = np.array([ord(m) for m in marks if _mark_key(m) == 0 or unicodedata.normalize("NFC", m) != m])
    return _cached["n"]


def _openers() -> np.ndarray:
    """Letters that print as another one together with a sign."""
    if "o" not in _cached:
        _cached["o"] = np.array(sorted({ord(pair[0]) for pair in MAKE_UP if not _is_mark(pair[0])}))
    return _cached["o"]


_known: tuple[dict[str, str], dict[str, str]] = ({}, {})


def looks(texts: list[str], stored: bool = False) -> list[str]:
    """Canonical form of every text: unstable stretches normalised, the rest untouched."""
    done = _looked(texts, stored)
    return [_in_latin_words(t) for t in done] if stored else done


def _looked(texts: list[str], stored: bool) -> list[str]:
    if not texts:
        return []
    sep = chr(SEPARATOR)
    if any(sep in t for t in texts):  # the separator itself is used as a sign: such texts go the plain way
        return [_canonical(t, stored) if sep in t else _looked([t], stored)[0] for t in texts]
    text = sep + sep.join(texts) + sep
    a, b = spans(np.frombuffer(text.encode("utf-32-le"), np.uint32), stored)
    if not len(a):
        return list(texts)
    known = _known[stored]
    if len(known) > 1 << 18:
        known.clear()
    out, at = [], 0
    for i, j in zip(a.tolist(), b.tolist()):
        piece = text[i:j]
        new = known.get(piece)
        if new is None:  # between two stops, so that blanks at the ends of a stretch stay one blank
            new = known[piece] = _canonical(f".{piece}.", stored)[1:-1]
        out += (text[at:i], new)
        at = j
    out.append(text[at:])
    return [t.strip(" ") for t in "".join(out).split(sep)[1:-1]]


def look(text: str) -> str:
    return looks([text])[0]


def _looks(a: pa.Array, stored: bool = False) -> pa.Array:
    """Forms of a string array, once per distinct value; nulls stay null."""
    d = a.dictionary_encode()
    values = d.dictionary.to_pylist()
    out: list[str] = []
    group: list[str] = []
    size = 0
    for v in values:
        group.append(v)
        size += len(v)
        if size > 1 << 20:
            out += looks(group, stored)
            group, size = [], 0
    out += looks(group, stored)
    return pa.array(out, pa.string()).take(d.indices)


def unify(df: DataFrame, columns: list[str], stored: bool = False) -> DataFrame:
    """Replace the named string columns by their canonical forms; other columns pass through.

    By default it is the form to compare by; ``stored`` gives the form to store.

    Defined cases: null stays null; a blank text, or one of characters that print nothing, becomes
    the empty string; texts of any length are handled whole; an empty table gives no rows.  Column
    names must be unique.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [_looks(b[c].cast(pa.string()), stored) if c in columns else b[c] for c in b.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def _two_forms(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [_looks(b[c]) for c in ("a", "b")]
            keep = pa.compute.and_(pa.compute.equal(*forms), pa.compute.not_equal(forms[0], ""))
            yield pa.RecordBatch.from_arrays([b["id"]], names=["id"]).filter(keep)

    return run


def same_looking_columns(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Keys of the rows whose two texts differ in code points and look the same; each key once.

    Defined cases: rows with a null key or text, or whose texts print nothing, make no case; repeated
    rows count once; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("id"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna().filter("a <> b")
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_two_forms(kind), f"id {kind}").distinct().withColumnRenamed("id", key)


def same_looking_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Members of every form that several spellings have: (form, spellings, members, key, text).

    ``spellings`` counts the form's distinct texts, ``members`` its rows; a row says to which form it
    belongs, and no pairs are made.  Defined cases: null keys and null or blank texts belong to none;
    a form of one spelling isn't listed, however many rows have it; repeated rows count once; an empty
    table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).dropna().distinct()
    forms = materialize(unify(rows.withColumn("form", F.col("text")), ["form"]).filter("form <> ''"), "forms").df
    texts = forms.groupBy("form", "text").agg(F.count("*").alias("n"))
    shared = texts.groupBy("form").agg(F.count("*").alias("spellings"), F.sum("n").alias("members")).filter("spellings > 1")
    shared = materialize(shared, "shared").df
    hot = hot_keys(shared, "form", "members", forms.count())
    return join_salted(forms, shared, "form", "id", hot).select("form", "spellings", "members", F.col("id").alias(key), "text")


def pairs_of(members: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: members of one form whose texts differ; as many rows as there are such pairs."""
    a, b = (members.select("form", F.col(key).alias(f"id_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    return a.join(b, "form").filter("id_a < id_b and text_a <> text_b").select("id_a", "id_b").distinct()
