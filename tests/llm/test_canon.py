import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dhwanika.llm import canon

LIST = [("गेहूं", "गेहूं"), ("मिर्च", "मिर्च"), ("खरपतवार", "खरपतवार"), ("झुलसा रोग", "झुलसा रोग"), ("हौभूरिंधे", "फिथीगिधैं"), ("फिथीगिधैं", "फिथीगिधैं"), ("टमाटर", "टमाटर"), (None, "x"), (" ", "y"), ("z", None)]
VALUES = {
    "गेहूं": "गेहूं", " गेहूं ": "गेहूं", "गैहूं": "गेहूं", "gehun": "गेहूं", "Gehoon": "गेहूं", "शायद गेहूं": "गेहूं", "मिर्च जी": "मिर्च", "खरपतवा": "खरपतवार",
    "झुलसारोग": "झुलसा रोग", "झुलसा-रोग": "झुलसा रोग", "हौभूरिधे": "फिथीगिधैं", "jhulasa rog": "झुलसा रोग", "टमा​टर।": "टमाटर",
    "कुछ नहीं": None, "???": None, "12345": None, "": None, "ok thanks": None, None: None,
}


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(LIST, "form string, canon string")


@pytest.mark.parametrize("block", [2, 50_000])
def test_values(spark, listed, block):
    rows = list(VALUES) + ["गेहूं"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, v string")
    wide = df.select("*", *[F.lit("q").alias(c) for c in ("key", "value", "canon", "n", "r", "_part", "ranked", "at", "bucket")])
    got = canon.canonicalise(wide, "id", "v", listed, "form", "canon", block=block).collect()
    assert len(got) == len(rows)
    assert {rows[r["id"]]: r["canon"] for r in got} == VALUES


def test_numbers(spark):
    listed = spark.createDataFrame([("4", "4"), ("w4", "4"), ("critical", "4"), ("2", "2"), ("useful", "2"), ("1", "1")], "form string, canon string")
    want = {"04": "4", "४": "4", "4.00": "4", "-1": None, "12": None, "1.5": None, "CRITICAL": "4", "criti.": "4", "critical (4)": "4", "２": "2", "w4": "4", "nan": None}
    df = spark.createDataFrame([(k,) for k in want], "v string").withColumn("id", F.monotonically_increasing_id())
    assert {r["value"]: r["canon"] for r in canon.canonicalise(df, "id", "v", listed, "form", "canon").collect()} == want


def test_ties_and_empty(spark):
    listed = spark.createDataFrame([("कमल", "कमल"), ("कमर", "कमर")], "form string, canon string")
    df = spark.createDataFrame([(1, "कमन"), (2, "कमल"), (3, "क " * 3000)], "id long, v string")
    got = {r["id"]: r["canon"] for r in canon.canonicalise(df, "id", "v", listed, "form", "canon").collect()}
    assert got == {1: None, 2: "कमल", 3: None}
    assert canon.canonicalise(df.filter("false"), "id", "v", listed, "form", "canon").count() == 0
    assert {r["canon"] for r in canon.canonicalise(df, "id", "v", listed.filter("false"), "form", "canon").collect()} == {None}


def plain_edits(a, b):
    """The definition, by recursion over prefixes."""
    from functools import cache

    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        least = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            least = min(least, d(i - 2, j - 2) + 1)
        return least

    return d(len(a), len(b))


@given(st.lists(st.tuples(st.text("abc", max_size=7), st.text("abc", max_size=7)), max_size=8))
def test_edits(pairs):
    got = canon.edits([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [plain_edits(a, b) for a, b in pairs]


def test_neighbours_swapped():
    assert canon.edits(["abcd"], ["acbd"]).tolist() == [1]


def scanned(words, spelt):
    """Weighted cosine of every pair by a plain scan: n-grams as strings in dictionaries."""
    from collections import Counter

    def own(k):
        out = Counter()
        for tag, s in ((1, k), (2, canon.rough(k))):
            s = f"^{s}$"
            out.update((tag, s[i : i + n]) for n in (2, 3) for i in range(len(s) - n + 1))
        return out

    bags = [own(k) for k in spelt]
    df = Counter(g for b in bags for g in b)
    weight = lambda g: math.log(1 + len(spelt) / max(df[g], 1))
    norm = lambda b: math.sqrt(sum((n * weight(g)) ** 2 for g, n in b.items()))
    return [[sum(n * b[g] * weight(g) ** 2 for g, n in q.items() if g in b) / norm(q) / norm(b) for b in bags] for q in map(own, words)]


def entered(data, spark):
    import random

    listed = sorted({r[0].strip() for r in spark.read.parquet(f"{data}/lexicon.parquet").select("word_norm").dropna().collect() if r[0].strip()})[::4]
    rng = random.Random(6)
    noised = []
    for w in rng.sample(listed, 100):
        i = rng.randrange(len(w))
        noised += [(w, w[:i] + w[i + 1 :]), (w, w[:i] + rng.choice("कतरसनम") + w[i + 1 :])]
    return listed, noised


def test_candidates_against_a_full_ranking(spark, data):
    """The index finds the pairs that a scan of the whole list finds, with the same cosines; and nearly always the entry of fewest edits."""
    listed, noised = entered(data, spark)
    keys = [canon.key(w).replace(" ", "") for w in listed]
    asked = [canon.key(v).replace(" ", "") for _, v in noised]
    cosine = np.array(scanned(asked, keys))
    held = np.zeros(canon.BUCKETS)
    np.add.at(held, canon.grams(keys)[1], 1)
    i, j, c = canon.Index(keys, canon.weights(held, len(keys))).search(asked)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(cosine >= canon.THRESHOLD))))
    got = set(zip(i.tolist(), j.tolist()))
    assert len(got & want) >= 0.999 * len(got | want)  # n-grams of one bucket or a rounded sum may differ
    assert np.abs(cosine[i, j] - c).max() < 0.02
    nearest = [(a, int(np.argmin(canon.edits([q] * len(keys), keys)))) for a, q in enumerate(asked)]
    assert sum(p in got for p in nearest) >= 0.95 * len(nearest)


def test_any_division_of_the_list_gives_the_same(spark, data):
    """Several spellings a term, some of them in other blocks; every cut of list and values gives equal rows."""
    listed, noised = entered(data, spark)
    forms = [(w + x, w) for w in listed for x in ("", "ा", " जी")] + [("गेहूं", "गेहूं"), ("गैहूं", "गेहूं"), ("gehun", "गेहूं")]
    entries = spark.createDataFrame(forms, "form string, canon string")
    df = spark.createDataFrame([(k, v) for k, (_, v) in enumerate([*noised, (0, "गेहू"), (0, "GEHUN"), (0, "गैहूंं")])], "id long, v string")
    results = []
    for block, chunk in ((1_000_000, 1_000_000), (len(forms) // 2, 40), (20, 100)):
        got = canon.canonicalise(df, "id", "v", entries, "form", "canon", block=block, chunk=chunk)
        results.append({(r["id"], r["canon"], round(r["score"] or 0, 9)) for r in got.collect()})
    assert results[0] == results[1] == results[2]
    assert sum(c is not None for _, c, _ in results[0]) > 150
    assert {c for i, c, _ in results[0] if i >= len(noised)} == {"गेहूं"}


def test_one_entry_a_block(spark):
    """Spellings of one term are no rivals of each other, however the list is divided."""
    entries = spark.createDataFrame([("गेहूं", "गेहूं"), ("गैहूं", "गेहूं"), ("गेहुं", "गेहूं")], "form string, canon string")
    df = spark.createDataFrame([(1, "गेहूं"), (2, "गेहू"), (3, "gehoon")], "id long, v string")
    assert [r["canon"] for r in canon.canonicalise(df, "id", "v", entries, "form", "canon", block=1).collect()] == ["गेहूं"] * 3


LONG = ["kirotanulepa" + a + b + c for a in ("dido", "dudi") for b in ("dido", "dudi") for c in ("", "du")] + [x + "kirotanulepa" for x in ("didodudi", "dudididi", "didodido", "dudidodu")]


@pytest.mark.parametrize(("near", "want"), [(["kirotamulepa"], "kirotamulepa"), (["kirotamulepa", "kirotasulepa"], None)])
def test_no_candidate_is_lost_by_its_rank(spark, near, want):
    """Twelve entries of higher cosine but too many edits stand before the meant one, or before two equally near."""
    listed = spark.createDataFrame([(x, x) for x in LONG + near], "form string, canon string")
    df = spark.createDataFrame([(1, "kirotanulepa")], "id long, v string")
    assert [r["canon"] for r in canon.canonicalise(df, "id", "v", listed, "form", "canon").collect()] == [want]


def test_stretches_settled_in_parts(monkeypatch):
    entries = [(canon.key(w), w, [canon.bare(w)]) for w in ("गेहूं", "टमाटर", "खरपतवार")]
    held = np.zeros(canon.BUCKETS)
    np.add.at(held, canon.grams([k for k, _, _ in entries])[1], 1)
    m = canon.Matcher(entries, canon.weights(held, 3))
    values = ["शायद गेहू है", "टमाटर और गेहूं", "", "कुछ भी नहीं " * 300 + "खरपतवा"]
    whole = m.rank(values, 2, canon.Words())
    monkeypatch.setattr(canon, "SPANS", 3)
    assert m.rank(values, 2, canon.Words()) == whole and [bool(x) for x in whole] == [True, True, False, True]


def test_long_values_take_time_in_proportion():
    words = ["कीट", "दाना", "रोग", "गेहूं", "चूर्ण"]
    assert sum(1 for _ in canon.spans(" ".join(words * 200), 3, canon.Words())) == sum(1000 - n + 1 for n in (1, 2, 3, 4))
