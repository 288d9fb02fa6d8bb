import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dhwanika.llm.looks import canonical, look, looks, pairs_of, same_looking_columns, same_looking_rows, unify

SIGNS = list("aеxХ| \t।-‐‍​­ािेैोौअआएओ़्ंकजరఒౕైଅାୌ́éｆﬁ가ﾞカ…²Ạ̊") + ["  ", " ", "\n"]
SAME = [
    ("को", "काे"), ("आम", "अाम"), ("औ", "अौ"), ("ज़ा", "जा़"), ("क़", "क़"), ("oil", "оil"), ("ｏｉｌ", "oil"), ("a b", " a  b "),
    ("क‍ा", "का"), ("ﬁeld", "field"), ("है।", "है|"), ("a‐b", "a-b"), ("ఓ", "ఒౕ"), ("ଆ", "ଅା"), ("é", "é"), ("ab", "a⁠b﻿"), ("१०", "१౦"), ("goал", "gоaл"), ("BAG", "ꓐᎪԌ"), ("no vow", "ոօ ѵօw"), ("౨౦", "౨୦"),
]
OTHER = [("है।", "है"), ("the", "THE"), ("5", "५"), ("ज", "ज़"), ("2", "²"), ("a b", "ab"), ("क", "ख"), (".", "।"), ("पाँच", "पांच"), ("1", "①")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert look(a) == look(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    assert look(a) != look(b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=14).map("".join), max_size=6))
def test_quick_check_agrees_with_the_definition(texts):
    assert looks(texts) == [canonical(t) for t in texts]
    assert looks(looks(texts)) == looks(texts)
    assert looks(texts, stored=True) == [canonical(t, stored=True) for t in texts]
    # what is stored looks as before
    assert looks(looks(texts, stored=True)) == looks(texts)


def test_form_to_store():
    """Tables, Russian and a text's own zeros stay; letters that are out of place in a Latin word don't."""
    for t in ("a | b", "Москва", "౧౦", "Хорошо, ok"):
        assert looks([t], stored=True) == [t]
    assert looks(["оil ｗｅｌｌ", "काे", "field⁠ﬁ"], stored=True) == ["oil well", "को", "fieldfi"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=4))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert looks(texts) == [canonical(t) for t in texts]


def test_separator_in_a_text():
    assert looks(["ab ", "ｃ"]) == ["ab", "c"]


def test_columns_and_rows(spark, rows):
    data = [(1, "को", "काे"), (2, "x", "x"), (3, None, "x"), (4, "​", " "), (1, "को", "काे"), (5, "x" * 40_000, "х" + "x" * 39_999), (None, "a", "а")]
    df = spark.createDataFrame(data, "k long, ref string, hyp string")
    wide = df.select("*", *[F.lit(0).alias(c) for c in ("id", "a", "b", "form", "text", "id_a")])
    assert rows(same_looking_columns(wide, "k", "ref", "hyp")) == [(1,), (5,)]
    words = spark.createDataFrame([(3, "को"), (1, "काे"), (2, "को"), (4, None), (5, " "), (6, "​")], "k long, w string")
    members = same_looking_rows(words.withColumn("id_b", F.lit(1)).withColumn("form", F.lit(1)), "k", "w")
    assert rows(members.select("form", "spellings", "members", "k")) == [("को", 2, 3, 1), ("को", 2, 3, 2), ("को", 2, 3, 3)]
    assert rows(pairs_of(members, "k")) == [(1, 2), (1, 3)]
    assert same_looking_rows(words.filter("false"), "k", "w").count() == 0
    assert same_looking_columns(df.filter("false"), "k", "ref", "hyp").count() == 0
    assert rows(unify(words, ["w"]).filter("k in (4, 5)")) == [(4, None), (5, "")]
