import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dhwanika.functions import normalization as N
from dhwanika.functions import phonetics as P


def apply(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def spoken(n, w):
    if n == 0:
        return w.zero
    out = []
    for d, label in zip((10**7, 10**5, 1000, 100), w.scale):
        if n // d:
            out.append(spoken(n // d, w) + " " + label)
            n %= d
    return " ".join(out + ([w.below_hundred()[n]] if n else []))


@pytest.mark.parametrize("lang", list(N.LANGUAGES))
def test_number_words(spark, lang):
    w = N.LANGUAGES[lang]
    numbers = [*range(0, 130), 999, 1000, 100_000, 10**7, 10**7 + 1, 10**14, 3 * 10**21 + 10**7 + 5, 123_456_789_012_345_678_901_234]
    assert apply(spark, map(str, numbers), lambda c: N.number_words(c, w)) == [spoken(n, w) for n in numbers]
    assert apply(spark, ["007", "0000000000"], lambda c: N.number_words(c, w)) == [spoken(7, w), w.zero]


GOLDEN = [
    ("2 बोरी यूरिया डालें?", "hindi", "दो बोरी यूरिया डालें"), ("3 ఎకరాలు.", "telugu", "మూడు ఎకరాలు"), ("୫ କିଲୋ ବିହନ।", "odia", "ପାଞ୍ଚ କିଲୋ ବିହନ"),
    ("0", "hi", "शून्य"), ("007", "hi", "सात"), ("25", "hi", "बीस पांच"), ("100", "hi", "एक सौ"), ("1,000", "hi", "एकशून्य"), ("1000", "hi", "एक हज़ार"),
    ("हज़ार", "hi", "हजार"), ("S1", "hi", "Sएक"), ("a(b)c", "hi", "ac"), ("a\nb", "hi", "ab"), ("है।", "hi", "है।"), ("है।", "te", "है"), ("", "hi", "NA"),
    ("?!", "te", "NA"), ("NA", "or", "NA"), ("2 x", " HI ", "दो x"), ("2 x", "xx", "दो x"), ("2 x", None, "दो x"), (None, "hi", None), ("<a\nb>", "hi", "ab"),
    ("9" * 4301, "hi", "NA"), ("  a   b ", "or", "a b"),
]


def test_golden_texts(spark):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang, _) in enumerate(GOLDEN)], "i int, t string, l string")
    got = [r["o"] for r in df.withColumn("o", N.normalize(F.col("t"), F.col("l"))).orderBy("i").collect()]
    assert got == [w for _, _, w in GOLDEN]


def test_normaliser_against_a_plain_restatement(spark):
    import random

    signs = list("अक़ज़है।॥1२३౪୫,:.-!?()[]{}<>₹ \n\t᱁xयु") + ["  "]
    rng = random.Random(3)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(20))) for _ in range(600)]

    def plain(t):
        t = unicodedata.normalize("NFC", t).replace("़", "")
        t = re.sub(N.BRACKETS, "", t)
        t = re.sub(r"\d+", lambda m: spoken(int(m[0]), N.HINDI), t)
        t = " ".join(t.translate({ord(c): None for c in N.PUNCTUATION}).split())
        return t or "NA"

    assert apply(spark, texts, N.normalize_hindi) == [plain(t) for t in texts]


PHONEMES = {
    "दवा": "DaBa", "दवाई": "DaBai", "कीड़ा": "KiDa", "खीरा": "KiRa", "खरपतवा": "KaRaPaTaBa", "खरपतवार": "KaRaPaTaBaR", "मक्का": "MaKa", "मका": "MaKa",
    "गेहूं": "KeHu", "गेहू": "KeHu", "कह": "Ka", "क": "K", "కె": "", "11": "1", "abc": "ABC", "अि": "a", "अ": "a", "ऋतु²": "riTu²", "कॄ": "Ka", "क@": "Ka", "": "",
}


def test_phonemes(spark):
    assert dict(zip(PHONEMES, apply(spark, PHONEMES, P.phon))) == PHONEMES
    assert apply(spark, [None], P.phon) == [""]
    assert apply(spark, ["खरपतवार"], P.skeleton) == ["KRPTBR"]
    assert apply(spark, ["अ - ब। ", "ज़ा‍", None], P.norm_word) == ["अ-ब", "जा", ""]


def scan(s):
    """Left-to-right encoder, to check the expression against."""
    cons = {c: k for k, cs in P.CONSONANTS.items() for c in cs}
    vow = {c: k for k, cs in P.VOWELS.items() for c in cs} | dict.fromkeys(P.VOCALIC_R, "ri")
    sign = {c: k for k, cs in P.SIGNS.items() for c in cs} | {P.VOCALIC_R_SIGN: "ri"}
    out, i = [], 0
    while i < len(s):
        c, nxt = s[i], s[i + 1 : i + 2]
        i += 1
        if c in cons:
            out.append(cons[c])
            if nxt and nxt in sign:
                out.append(sign[nxt])
                i += 1
            elif nxt == P.VIRAMA:
                i += 1
            elif nxt:
                out.append("a")
        elif c in vow:
            out.append(vow[c])
        elif c in (P.ANUSVARA, P.VISARGA):
            out.append("n" if c == P.ANUSVARA else "H")
        elif c.isdigit() or c.isascii() and c.isalpha():
            out.append(c.upper())
    t = re.sub(r"(.)\1+", r"\1", "".join(out))
    return t.removesuffix("H").removesuffix("n")


def test_phonemes_against_a_scan(spark):
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("कखमरहअइऋािृ्ंःa7@") for _ in range(rng.randrange(9))) for _ in range(3000)]
    canonical = apply(spark, words, P.norm_word)
    assert apply(spark, canonical, P.phon_of) == [scan(w.replace("-", "").replace(" ", "")) for w in canonical]


def table(a, b):
    near = {x for p in P.NEAR for x in (p, p[::-1])}
    indel = lambda c: 0.5 if c in "aeioun" else 1.0

    def sub(x, y):
        if x == y:
            return 0.0
        if x + y in near:
            return 0.4
        v, w = x in "aeiou", y in "aeiou"
        return 0.6 if v and w else 1.2 if v != w else 1.0

    row = [0.0]
    for y in b:
        row.append(row[-1] + indel(y))
    for x in a:
        new = [row[0] + indel(x)]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + indel(x), new[-1] + indel(y), row[j] + sub(x, y)))
        row = new
    return row[-1]


SOUNDS = st.text("KHTDBMNaeiounr1", max_size=9)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(SOUNDS, SOUNDS), min_size=1, max_size=20))
def test_distances(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    got = P.distances(a, b)
    assert got.tolist() == pytest.approx([table(x, y) for x, y in pairs], abs=1e-12)
    assert got.tolist() == pytest.approx(P.distances(b, a).tolist(), abs=1e-12)


def test_distances_in_groups(monkeypatch):
    monkeypatch.setattr(P, "CELLS", 40)
    a, b = ["KaMa", "", "T" * 30, "n"] * 5, ["KaM", "aT", "D" * 31, "N"] * 5
    assert P.distances(a, b).tolist() == pytest.approx([table(x, y) for x, y in zip(a, b)])


def test_similarity(spark):
    df = spark.createDataFrame([("DaBa", "DaBai"), ("KiDa", "KiRa"), ("", ""), ("Ka", "K"), (None, "K")], "a string, b string")
    got = [r[0] for r in df.select(P.psim(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == pytest.approx([0.9, 0.75, 1.0, 0.75]) and got[4] is None


def test_costs(spark):
    pairs = [(x, y) for x in "KHaonrN" for y in "KHaonrN"]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(P.sub_cost(F.col("a"), F.col("b")), P.indel_cost(F.col("a"))).collect()
    assert [r[0] for r in got] == [table(x, y) if x == y else pytest.approx({True: 0.4}.get(x + y in {z for p in P.NEAR for z in (p, p[::-1])}, r[0])) for (x, y), r in zip(pairs, got)]
    assert {x: r[1] for (x, _), r in zip(pairs, got)} == {"K": 1.0, "H": 1.0, "a": 0.5, "o": 0.5, "n": 0.5, "r": 1.0, "N": 1.0}
