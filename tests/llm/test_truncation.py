import numpy as np
import pytest
from pyspark.sql import functions as F

from dhwanika.llm import truncation as T

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark, data):
    other = data.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{other}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return T.fit(docs)


def test_held_out_examples(model):
    """None of the held-out texts' sentences is learned from."""
    f = model.held_out
    assert f["held_out"] > 1000 and f["precision"] > 0.95 and f["recall"] > 0.95
    assert 0.05 < f["share"] < 0.4 and 0.3 < model.threshold < 0.99


def test_same_sample_whatever_the_partitions(docs):
    a, b = (T.fit(docs.repartition(k), max_docs=50) for k in (1, 5))
    assert np.allclose(a.weights, b.weights) and np.array_equal(a.after, b.after) and a.threshold == b.threshold


def test_copies_come_to_the_driver_once(spark, monkeypatch):
    """A text that fills the table costs the driver no more than one copy, and changes no weight."""
    from pyspark.sql.classic.dataframe import DataFrame

    sizes, plain = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: sizes.append((t := plain(df)).num_rows) or t)
    text = "Stored wheat is being eaten by weevils. Dry it in the hot sun today. Pull out the plants."
    other = "Spray the crop in the evening only. Do not mix the two powders. Wait a week."
    once = spark.createDataFrame([(1, text, "a"), (2, other, "a")], SCHEMA)
    many = spark.createDataFrame([(i, text, "a") for i in range(300)] + [(2, other, "a")], SCHEMA).repartition(4)
    assert np.array_equal(T.fit(once).weights, T.fit(many).weights)
    assert max(sizes) <= 2 * (2 * T.PER_TEXT + 1)


SENTENCES = ["Stored wheat is being eaten by weevils.", "Dry it in the hot sun today.", "Spray the crop in the evening only.", "Do not mix the two powders.", "Pull out the plants and throw them away.", "Wait a week before the harvest."]


def corpus(afters, n=400):
    """Texts of many sentences, every second with something after it."""
    out = []
    for i in range(n):
        body = " ".join(SENTENCES[(i * 7 + j * (1 + i % 5)) % 6] for j in range(5)) + f" Plot {i}."
        out.append((i, body + (afters[(i // 2) % len(afters)] if i % 2 else ""), "a"))
    return out


def test_what_stands_after_is_learned(spark):
    """Words put after texts, told by how often they end texts; nothing of the texts themselves goes."""
    afters = [" (end of note)", "\n#kharif #advice", "\nThanks 🙏", " 🙂", "\n— Field team, Oldtown"]
    closed = T.closings(spark.createDataFrame(corpus(afters), SCHEMA), "doc_id", "text", "source").df
    after = T.put_after(closed)
    for x in afters:
        assert T.core_of("Do not mix them. Dry it in the hot sun today." + x, after) == "Do not mix them. Dry it in the hot sun today.", x
    # marks of a foreign shape at the very end, though hardly any text has them
    for x in (" [[PAD]]", " <|endoftext|>\nThanks 🙏", "\n" + "a" * 30, " 12345678901234567890", " x̂ ŷ"):
        assert T.core_of("Dry it in the hot sun today." + x, after) == "Dry it in the hot sun today.", x
    for x in ("Dry it in the hot sun tod", "Spray the crop in", "Do not mix the two powders"):
        assert T.core_of(SENTENCES[0] + " " + x, after) == SENTENCES[0] + " " + x


def test_a_copied_end_is_no_habit_of_texts(spark):
    data = corpus([""]) + [(1000 + i, " ".join(SENTENCES) + " Uncommon closing wor", "a") for i in range(300)]
    after = T.put_after(T.closings(spark.createDataFrame(data, SCHEMA), "doc_id", "text", "source").df)
    assert T.core_of("Dry it. Uncommon closing wor", after) == "Dry it. Uncommon closing wor"


def test_closing_signs():
    for after, kind in (("…", "dots"), ("...", "dots"), (".", "stop"), ("  \n\t", "none"), (",", ","), ("�", "broken")):
        assert T.close_of("dry it in the sun" + after) == ("dry it in the sun", kind)


def test_limits(spark):
    """Piles anywhere: one longer text hides no limit, a source may have two, copies are no pile."""
    text = lambda n, i: f"{i:06d}" + "x" * (n - 6)
    data = [(i, text(100, i), "cut") for i in range(40)] + [(i, text(10 + i, i), "cut") for i in range(80)] + [(i, text(7 + i, i), "free") for i in range(200)]
    data += [(0, text(5000, 0), "cut")] + [(i, text(400, 100 + i), "cut") for i in range(40)]
    data += [(i, f"{i:06d}" + "क" * 30 + "x" * (i % 3), "bytes") for i in range(40)] + [(1, None, "free"), (2, "x", None)] + [(i, text(50, 0), "copies") for i in range(100)]
    got = {}
    for r in T.limits(T.closings(spark.createDataFrame(data, SCHEMA), "doc_id", "text", "source").df).collect():
        got.setdefault(r["source"], set()).add((r["unit"], r["top"]))
    assert got["cut"] == {(u, n) for u in ("chars", "bytes") for n in (100, 400)}
    assert ("bytes", 98) in got["bytes"] and "free" not in got and "copies" not in got
    assert T.limits(T.closings(spark.createDataFrame([], SCHEMA), "doc_id", "text", "source").df).count() == 0


def test_limit_feature_is_that_of_the_length():
    text = " ".join(SENTENCES * 20)
    x, y = T.examples([text], [("chars", 150)], per_text=50)
    at = [("limit:True" in f, v) for f, v in zip(x, y)]
    if any(a for a, _ in at):
        assert sum(v for a, v in at if a) >= 1
    assert [T.examples([text], [("chars", 150)], seed=s) for s in (1,)] == [T.examples([text], [("chars", 150)], seed=1)]
    cut = [f for s in range(6) for f, v in zip(*T.examples([text], [("chars", 150)], seed=s)) if v and "limit:True" in f]
    assert cut  # a text longer than its field is cut there


def test_share_and_threshold():
    rng = np.random.default_rng(1)
    y = (rng.random(20_000) < 0.1).astype(int)
    z = rng.normal(np.where(y, 2.0, -2.0), 1.0)
    p = 1 / (1 + np.exp(-4 * z))
    assert abs(T.share_of_cut(p) - 0.1) < 0.02
    assert T.best_threshold(p, y, 0.1) > T.best_threshold(p, y, 0.5) - 1e-9
    assert T.best_threshold(np.empty(0), np.empty(0), 0.1) == 0.5


def test_defined_cases(spark, model):
    data = [
        (1, None, "a"), (2, "", "a"), (3, " \n", "a"), (4, "🙂 ()", "a"), (5, "Stored wheat is being eaten by weevils so dry it in the sun.", None),
        (6, "Stored wheat is being eaten by weevils so dry it in the sun. Pull out the pla", "a"), (7, "Stored wheat is being eaten by weevils so dry it in the sun. " * 5000, "b"),
        (6, "Stored wheat is being eaten by weevils so dry it in the sun. Pull out the pla", "a"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    wide = df.select("*", *[F.lit(0).alias(c) for c in ("key", "at", "chars", "bytes", "truncated", "probability", "n", "h", "t", "tail", "words", "limit", "inner")])
    out = T.truncated(wide, model=model).collect()
    got = {r["doc_id"]: r["truncated"] for r in out}
    assert len(out) == 8 and [k for k, v in got.items() if v] == [6]
    rate = {r["source"]: (r["documents"], r["truncated"]) for r in T.rates(T.truncated(df, model=model)).collect()}
    assert rate["a"] == (6, 2) and rate[None] == (1, 0)
    assert T.truncated(df.filter("false")).count() == 0
    assert not any(r["truncated"] for r in T.truncated(df.limit(4)).collect())


def test_share_weights_and_threshold_are_those_of_all_texts(spark, monkeypatch):
    """each distinct text is learned from or held out, and counts for the share, in however many parts."""
    monkeypatch.setattr(T, "PART", 50)
    df = spark.createDataFrame(corpus([""]), SCHEMA)
    sizes = []
    plain = T.share_of_cut
    monkeypatch.setattr(T, "share_of_cut", lambda p, **kw: sizes.append(int(kw["n"].sum())) or plain(p, **kw))
    whole, part = T.fit(df), T.fit(df, max_docs=100)
    assert sizes == [400, 100]
    x, y = T.examples([r[1] for r in corpus([""])])
    assert whole.held_out["examples"] + whole.held_out["held_out"] == len(y)
    assert part.held_out["examples"] + part.held_out["held_out"] < len(y)
    p = T.score(whole.weights, x)
    assert ((p > 0.5) == np.array(y)).mean() > 0.9
    again = T.fit(df.repartition(7))
    assert np.array_equal(whole.weights, again.weights) and whole.threshold == again.threshold


def test_bins_of_probabilities(spark):
    p = np.array([0.0, 1e-9, 0.1, 0.5, 0.7311, 1.0])
    assert np.abs(T.middles(T.bins(p)) - p).max() < 3e-4
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in p], "p double").select(T._bin(F.col("p"))).collect()]
    assert got == T.bins(p).tolist()
