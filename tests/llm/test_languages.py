import numpy as np
import pytest
from pyspark.sql import functions as F

from dhwanika.llm.languages import Model, detect, fit, mislabelled, named_language, stretches

SCHEMA = "utt_id long, ref string, lang string, received_at timestamp"


@pytest.fixture(scope="module")
def samples(spark, data):
    return spark.read.parquet(f"{data}/lang_samples.parquet")


@pytest.fixture(scope="module")
def model(samples):
    return fit(samples)


def test_held_out_accuracy(samples):
    from dhwanika.llm.looks import looks

    rows = samples.orderBy("sample_id").collect()
    right = 0
    for part in range(5):
        held = [r for i, r in enumerate(rows) if i % 5 == part]
        m = Model.fit(looks([r["text"] for i, r in enumerate(rows) if i % 5 != part]), [r["lang"] for i, r in enumerate(rows) if i % 5 != part])
        for r in held:
            score = m.word_scores(looks([r["text"]])[0].lower().split()).sum(0)
            right += m.languages[int(score.argmax())] == r["lang"]
    assert right / len(rows) > 0.97


def test_confidence_is_the_share_that_is_right(samples):
    """On beginnings of sentences of a fifth that neither the counts nor the temperature have seen."""
    from dhwanika.llm.languages import confidence
    from dhwanika.llm.looks import looks

    rows = samples.orderBy("sample_id").collect()
    said, right = [], []
    for part in range(5):
        seen = [r for i, r in enumerate(rows) if i % 5 != part]
        m = Model.fit(looks([r["text"] for r in seen]), [r["lang"] for r in seen])
        assert m.temperature > 1
        for r in (r for i, r in enumerate(rows) if i % 5 == part):
            s = m.word_scores(looks([r["text"]])[0].lower().split())
            for n in (1, 2, 3):
                total = s[:n].sum(0)
                best = int(total.argmax())
                said.append(float(confidence(total, best, m.temperature)))
                right.append(m.languages[best] == r["lang"])
    said, right = np.array(said), np.array(right)
    assert abs(said.mean() - right.mean()) < 0.05
    bands = [(said >= low) & (said < low + 0.1) for low in np.arange(0, 1.1, 0.1)]
    assert sum(abs(said[b].mean() - right[b].mean()) * b.sum() for b in bands if b.any()) / len(said) < 0.05  # expected calibration error


def test_mixed_text(spark, model):
    text = "मुझे मंडी में चना का भाव अच्छा मिला था। Please tell us how many days to wait before we feed the wheat."
    df = spark.createDataFrame([(1, text)], "k long, t string")
    parts = detect(df, "k", "t", model).first()["stretches"]
    assert [p["lang"] for p in parts] == ["hi", "en"]
    assert parts[0]["end_word"] == parts[1]["first_word"] == 9 and all(p["confidence"] > 0.9 for p in parts)


def test_single_loan_words_do_not_divide(spark, model):
    df = spark.createDataFrame([(1, "गोदाम में रखी गेहूं में घुन लग रहा है spray इसलिए धूप दिखाइए")], "k long, t string")
    assert len(detect(df, "k", "t", model).first()["stretches"]) == 1


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(30):
        s = rng.normal(size=(5, 3)) * 4
        got = stretches(s, 3.0)
        path = [g for a, b, g in got for _ in range(a, b)]
        value = lambda p: sum(s[i, g] for i, g in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert abs(value(path) - max(value(p) for p in product(range(3), repeat=5))) < 1e-9


def test_defined_cases(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... ४५"), (4, "yes " * 20_000), (5, "पानी"), (5, "पानी")], "k long, t string")
    wide = df.select("*", *[F.lit(0).alias(c) for c in ("key", "text", "words", "lang", "stretches")])
    out = detect(wide, "k", "t", model).collect()
    got = {r["k"]: r for r in out}
    assert len(out) == 6 and got[1]["lang"] is None and got[1]["stretches"] is None
    assert got[2]["lang"] is None and got[2]["stretches"] == [] and got[3]["lang"] is None and got[3]["words"] == 2
    assert got[4]["words"] == 20_000
    assert detect(df.filter("false"), "k", "t", model).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(" HI ",), ("Oriya",), ("mixed",), (None,), ("EN",), ("mar",), ("TE ",)], "l string")
    assert [r[0] for r in df.select(named_language(F.col("l"))).collect()] == ["hi", "or", None, None, "en", "mr", "te"]


def test_cases(spark, model, rows):
    import datetime as d

    t, u = d.datetime(2026, 1, 1), d.datetime(2026, 1, 2)
    hi = "मुझे मंडी में चना का भाव अच्छा मिला था"
    en = "Please tell us how many days to wait before we feed the wheat"
    data = [
        (1, hi, "hi", t), (2, hi, "te", t), (3, hi, None, t), (4, f"{hi} - {en}", "hi", t), (5, "yes no", "te", t), (6, "NA", "te", t), (7, None, "te", t),
        (2, hi, "te", u), (None, hi, "en", t), (8, hi, "hindi ", t),
    ]
    df = spark.createDataFrame(data, SCHEMA).withColumn("id", F.lit(1)).withColumn("label", F.lit(1)).withColumn("langs", F.lit(1))
    assert rows(mislabelled(df, model)) == sorted([(2, "hi"), (3, "hi"), (4, "en"), (4, "hi"), (None, "hi")], key=repr)
    assert mislabelled(df.filter("false"), model).count() == 0


def test_no_samples(spark):
    with pytest.raises(ValueError):
        fit(spark.createDataFrame([], "text string, lang string"))
