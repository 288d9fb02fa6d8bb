import json

from pyspark.sql import functions as F

from dhwanika.functions.register import register
from dhwanika.operators import correction as C
from dhwanika.runtime import join_salted, materialize, once_per_key
from dhwanika.sources import readers
from dhwanika.streaming import normalize_stream, wer_by_window


def test_dictionary_files(spark, tmp_path):
    (tmp_path / readers.LEXICON).write_text('word,word_norm,relevance_mode,kind\n"a ""x""\nb",खाद,3.7,q\nदवा,,,q\n', "utf-8")
    (tmp_path / readers.PAIRS).write_text("candidate,anchor,label,cue\nदवाई,खाद,SAME_WORD,1\nदवाई,दवा,SAME_WORD,2\n", "utf-8")
    (tmp_path / readers.COUNTS).write_text(json.dumps({"खाद": 5, "है": 9}), "utf-8")
    lexicon = readers.read_lexicon(spark, str(tmp_path / readers.LEXICON))
    assert {r["token"]: r["weight"] for r in C.weights(lexicon).collect()} == {"खाद": 3, "दवा": 1}
    pairs = readers.read_pair_labels(spark, str(tmp_path / readers.PAIRS))
    assert [r["anchor"] for r in C.variant_map(pairs, C.weights(lexicon)).collect()] == ["खाद"]
    assert {r["token"]: r["n"] for r in readers.read_counts(spark, str(tmp_path / readers.COUNTS)).collect()} == {"खाद": 5, "है": 9}
    assert readers.read_counts(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "broken.json").write_text("{")
    assert readers.read_counts(spark, str(tmp_path / "broken.json")).count() == 0


def test_data_dir(spark, tmp_path, monkeypatch):
    monkeypatch.delenv(readers.DATA_DIR_VARIABLE, raising=False)
    monkeypatch.chdir(tmp_path)
    home = tmp_path / "home"
    assert readers.data_dir(home=str(home)) == str(home / "data")
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / readers.LEXICON).write_text("")
    assert readers.data_dir(home=str(home)) == str(tmp_path / "data")
    (home / "data").mkdir(parents=True)
    (home / "data" / readers.LEXICON).write_text("")
    assert readers.data_dir(home=str(home)) == str(home / "data")
    monkeypatch.setenv(readers.DATA_DIR_VARIABLE, "/nowhere")
    assert readers.data_dir(home=str(home)) == "/nowhere"
    spark.conf.set(readers.DATA_DIR_CONF, "/conf")
    assert readers.data_dir(spark) == "/conf"
    spark.conf.unset(readers.DATA_DIR_CONF)


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("select nfc('a'), canonical_text(' ｘ  y '), language_code(' TE '), phoneme_sub_cost('K', 'H'), phoneme_indel_cost('n'), squeeze_text('  a  b')").first()
    assert tuple(got) == ("a", "x y", "te", 0.4, 0.5, "a b")
    from test_text import GOLDEN, PHONEMES

    df = spark.createDataFrame([(i, t, lang) for i, (t, lang, _) in enumerate(GOLDEN)], "i int, t string, l string")
    df.createOrReplaceTempView("golden")
    assert [r[1] for r in spark.sql("select i, normalize_text(t, l) from golden order by i").collect()] == [w for _, _, w in GOLDEN]
    spark.createDataFrame([(w,) for w in PHONEMES], "w string").createOrReplaceTempView("spelt")
    assert {r[0]: r[1] for r in spark.sql("select w, phon(w) from spelt").collect()} == PHONEMES
    got = spark.sql("select round(psim(phon('दवा'), phon('दवाई')), 9), skeleton('खरपतवार'), number_words_te('25'), norm_word('ज़ा ।')").first()
    assert tuple(got) == (0.9, "KRPTBR", "ఇరవై ఐదు", "जा")


def test_streams(spark, tmp_path):
    import datetime as d

    t = d.datetime(2026, 1, 1)
    data = [(1, "2 क", "दो ख", "hi", t), (1, "2 क", "दो ख", "hi", t), (2, "క", "క", "te", t + d.timedelta(hours=1)), (3, "क ख", "क", "hi", t + d.timedelta(days=2)), (4, "NA", "x", "hi", t)]
    schema = "utt_id long, ref string, hyp string, lang string, at timestamp"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = normalize_stream(stream, "ref", "lang", "n").writeStream.format("memory").queryName("normed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("normed").collect()) == sorted(["दो क", "दो क", "క", "क ख", "NA"])
    q = wer_by_window(stream, "at", "1 day", "1 hour").writeStream.format("memory").queryName("rates").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    first = [(r["edits"], r["words"], r["pairs"]) for r in spark.table("rates").collect()]
    assert first in ([], [(1, 3, 2)])
    batch = wer_by_window(spark.createDataFrame(data, schema), "at", "1 day", "1 hour").orderBy("start").collect()
    assert [(r["edits"], r["words"], r["pairs"]) for r in batch] == [(1, 3, 2), (1, 2, 1)]


def test_once_per_key(spark):
    data = [(1, 5, "b"), (1, 3, "a"), (1, None, "0"), (None, 1, "x"), (None, 1, "x"), (2, None, None)]
    got = once_per_key(spark.createDataFrame(data, "k int, o int, v string"), "k", "o", ["v"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a"), (None, "x"), (None, "x"), (2, None)], key=repr)


def test_salted_join(spark):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert join_salted(left, right, "k", "id", [0]).count() == 667
    assert join_salted(left, right, "k", "id", []).count() == 667


def test_written_tables_are_dropped(spark):
    m = materialize(spark.range(3), "x")
    assert m.df.count() == 3
    m.drop()
    import os

    assert not os.path.exists(m.path.removeprefix("file:"))


def test_scratch(spark):
    """Tables made in the block go with it, those made outside stay."""
    import os

    from dhwanika.runtime import materialize, scratch

    at = lambda m: m.path.removeprefix("file:")
    outer = materialize(spark.range(3), "outer")
    with scratch():
        one = materialize(spark.range(3), "one")
        with scratch():
            two = materialize(spark.range(3), "two")
        assert not os.path.exists(at(two)) and one.df.count() == 3
    assert not os.path.exists(at(one)) and outer.df.count() == 3
    outer.drop()
    outer.drop()
