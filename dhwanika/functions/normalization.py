"""Language-aware text normalisation for word error rates.

Order of steps: NFC, fold nukta (Hindi before the number words, Odia after), digits of any script to
number words, bracketed content out, punctuation out, white space collapsed; ``NA`` where nothing is left.

NFC has to leave the JVM, and Spark interprets the nested lambdas that number words need, so a text's
whole chain runs where its NFC does: one Arrow UDF, each distinct text of a batch once.  As Column
expressions around the UDF the chain took four times as long.  The single steps are Column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .unicode import NUKTA, decimal_digits

# Number words of the three languages, in natural order.
HINDI_UNITS = ["", "एक", "दो", "तीन", "चार", "पांच", "छह", "सात", "आठ", "नौ"]
HINDI_TEENS = ["दस", "ग्यारह", "बारह", "तेरह", "चौदह", "पंद्रह", "सोलह", "सत्रह", "अठारह", "उन्नीस"]
HINDI_TENS = ["", "", "बीस", "तीस", "चालीस", "पचास", "साठ", "सत्तर", "अस्सी", "नब्बे"]
HINDI_SCALE = ["करोड़", "लाख", "हज़ार", "सौ"]
HINDI_ZERO = "शून्य"
TELUGU_UNITS = ["", "ఒకటి", "రెండు", "మూడు", "నాలుగు", "ఐదు", "ఆరు", "ఏడు", "ఎనిమిది", "తొమ్మిది"]
TELUGU_TEENS = ["పది", "పదకొండు", "పన్నెండు", "పదమూడు", "పద్నాలుగు", "పదిహేను", "పదహారు", "పదిహేడు", "పద్దెనిమిది", "పంతొమ్మిది"]
TELUGU_TENS = ["", "", "ఇరవై", "ముప్పై", "నలభై", "యాభై", "అరవై", "డెబ్బై", "ఎనభై", "తొంభై"]
TELUGU_SCALE = ["కోటి", "లక్ష", "వెయ్యి", "వంద"]
TELUGU_ZERO = "సున్న"
ODIA_UNITS = ["", "ଏକ", "ଦୁଇ", "ତିନି", "ଚାରି", "ପାଞ୍ଚ", "ଛଅ", "ସାତ", "ଆଠ", "ନଅ"]
ODIA_TEENS = ["ଦଶ", "ଏଗାର", "ବାର", "ତେର", "ଚଉଦ", "ପନ୍ଦର", "ଷୋହଳ", "ସତର", "ଅଠର", "ଊଣେଇଶ"]
ODIA_TENS = ["", "", "କୋଡିଏ", "ତିରିଶ", "ଚାଳିଶ", "ପଚାଶ", "ଷାଠିଏ", "ସତୁରି", "ଅଶୀ", "ନବେ"]
ODIA_SCALE = ["କୋଟି", "ଲକ୍ଷ", "ହଜାର", "ଶହ"]
ODIA_ZERO = "ଶୂନ୍ୟ"
# What the normalisers delete. Danda stays in Hindi.
BRACKETS = r"\(.*?\)|\[.*?\]|\{.*?\}|<.*?>|❴.*?❵"
PUNCTUATION = ",:.-!?;\"'“”‘’%()[]{}<>₹^&*—|\\/~`+=\n\t"
DANDAS = "।॥"
ODIA_NUKTA = "଼"
# Names of the languages.
LANGUAGE_NAMES = {
    "hi": ["hi", "hin", "hindi"],
    "te": ["te", "tel", "telugu"],
    "or": ["or", "od", "ori", "odia", "oriya"],
}
MOST_DIGITS = 4300  # a longer run of digits isn't read as a number; the text becomes NA
NOTHING = "NA"


@dataclass(frozen=True)
class NumberWords:
    units: list[str]
    teens: list[str]
    tens: list[str]
    scale: list[str]
    zero: str

    def below_hundred(self) -> list[str]:
        """Words of 0 to 99; 0 is empty."""
        rest = [f"{t} {u}".strip() for t in self.tens[2:] for u in self.units]
        return self.units + self.teens + rest


HINDI = NumberWords(HINDI_UNITS, HINDI_TEENS, HINDI_TENS, HINDI_SCALE, HINDI_ZERO)
TELUGU = NumberWords(TELUGU_UNITS, TELUGU_TEENS, TELUGU_TENS, TELUGU_SCALE, TELUGU_ZERO)
ODIA = NumberWords(ODIA_UNITS, ODIA_TEENS, ODIA_TENS, ODIA_SCALE, ODIA_ZERO)
LANGUAGES = {"hi": HINDI, "te": TELUGU, "or": ODIA}
_DIGITS = decimal_digits()


def fold_digits(c: Column) -> Column:
    """Decimal digits of every script to ASCII."""
    return F.translate(c, *_DIGITS)


def strip_brackets(c: Column) -> Column:
    """Bracketed content out; a pair never reaches over a line feed."""
    return F.regexp_replace(c, f"(?d){BRACKETS}", "")


def strip_punctuation(c: Column, dandas: bool = False) -> Column:
    return F.translate(c, PUNCTUATION + (DANDAS if dandas else ""), "")


def number_words(digits: Column, words: NumberWords) -> Column:
    """Words of a number given as a string of ASCII digits of any length, in the Indian system.

    The digits fall into groups of seven; between groups stands the word for ten million, however
    many groups there are, so nothing is bound to the range of an integer type.
    """
    table = F.lit(words.below_hundred())
    crore, lakh, thousand, hundred = words.scale

    def group(n: Column) -> Column:
        part = lambda v, label: F.when(v > 0, F.concat(F.get(table, v), F.lit(f" {label}")))
        whole = lambda a, b: F.floor(a / F.lit(b)).cast("int")
        rest = n % 100
        return F.concat_ws(
            " ",
            part(whole(n, 100_000), lakh),
            part(whole(n % 100_000, 1000), thousand),
            part(whole(n % 1000, 100), hundred),
            F.when(rest > 0, F.get(table, rest)),
        )

    count = F.ceil(F.length(digits) / F.lit(7)).cast("int")
    padded = F.lpad(digits, count * 7, "0")
    groups = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(padded, i * 7 + 1, F.lit(7)).cast("int"))
    spoken = F.aggregate(
        groups,
        F.lit(""),
        lambda said, n: F.when(said == "", group(n)).otherwise(
            F.concat(said, F.lit(f" {crore}"), F.when(n > 0, F.concat(F.lit(" "), group(n))).otherwise(""))
        ),
    )
    return F.when(spoken == "", F.lit(words.zero)).otherwise(spoken)


class Chain:
    """The steps of one language, for a text at a time."""

    def __init__(self, code: str):
        w = LANGUAGES[code]
        self.table, self.scale, self.zero = w.below_hundred(), w.scale, w.zero
        self.before, self.after = {"hi": (NUKTA, ""), "te": ("", ""), "or": ("", ODIA_NUKTA)}[code]
        self.signs = dict.fromkeys(map(ord, PUNCTUATION + ("" if code == "hi" else DANDAS)))

    def under_crore(self, n: int) -> list[str]:
        """Words of a number below ten million; none for 0."""
        said: list[str] = []
        for size, label in zip((100_000, 1000, 100), self.scale[1:]):
            if n >= size:
                said += (self.table[n // size], label)
                n %= size
        return said + [self.table[n]] if n else said

    def number(self, digits: str) -> str:
        """Words of a run of digits: groups of seven, the word for ten million between them."""
        said: list[str] = []
        first = len(digits) % 7 or 7
        for end in range(first, len(digits) + 1, 7):
            if said:
                said.append(self.scale[0])
            said += self.under_crore(int(digits[max(end - 7, 0) : end]))
        return " ".join(said) or self.zero

    def __call__(self, text: str) -> str:
        t = text if text.isascii() else unicodedata.normalize("NFC", text)
        if self.before:
            t = t.replace(self.before, "")
        if _ODD_DIGIT.search(t):
            t = t.translate(_DIGIT_VALUES)
        if _OPENING.search(t):
            t = _BRACKETED.sub("", t)
        runs = _RUN.findall(t)
        if runs:
            if max(map(len, runs)) > MOST_DIGITS:
                return NOTHING
            t = _RUN.sub(lambda m: self.number(m[0]), t)
        if self.after:
            t = t.replace(self.after, "")
        return " ".join(t.translate(self.signs).split()) or NOTHING


_ODD_DIGIT, _OPENING, _BRACKETED, _RUN = (re.compile(p) for p in (r"(?![0-9])\d", r"[(\[{<❴]", BRACKETS, "[0-9]+"))
_DIGIT_VALUES = str.maketrans(*_DIGITS)
_CHAINS = {code: Chain(code) for code in LANGUAGES}


@arrow_udf(StringType())
def normalized(text: pa.Array, code: pa.Array) -> pa.Array:
    """Texts in the form of their language (hi, te or or)."""
    known: dict[tuple, str] = {}
    out = []
    for pair in zip(text.to_pylist(), code.to_pylist()):
        if pair[0] is None:
            out.append(None)
            continue
        if (done := known.get(pair)) is None:
            done = known[pair] = _CHAINS[pair[1]](pair[0])
        out.append(done)
    return pa.array(out, pa.string())


def normalize_hindi(c: Column) -> Column:
    return normalized(c.cast("string"), F.lit("hi"))


def normalize_telugu(c: Column) -> Column:
    return normalized(c.cast("string"), F.lit("te"))


def normalize_odia(c: Column) -> Column:
    return normalized(c.cast("string"), F.lit("or"))


def language(lang: Column) -> Column:
    """hi, te or or by the code or name of a language; hi for all else, null included."""
    from ..runtime import strip

    name = F.lower(strip(lang.cast("string")))
    return F.when(name.isin(*LANGUAGE_NAMES["te"]), "te").when(name.isin(*LANGUAGE_NAMES["or"]), "or").otherwise("hi")


def normalize(c: Column, lang: Column) -> Column:
    """Normalise by the row's own language.  A null text stays null; ``NA`` where nothing is left."""
    return normalized(c.cast("string"), language(lang))


Normalizer = Callable[[Column], Column]
