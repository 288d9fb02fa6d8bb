"""Queries of the scalar text operators: number words, normalisation, phonetics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalization as N
from ..functions import phonetics as P
from ..functions.register import register
from ..functions.unicode import strip_nukta as nukta_free
from ..runtime import table
from . import sqltext as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def _numbers(lang: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        n = table(spark, d, "orders").select((F.col("o_orderkey") * 104_729 + F.floor("o_totalprice").cast("long")).alias("n"))
        return n.unionByName(table(spark, d, "part").select(F.col("p_size").cast("long").alias("n"))).distinct().select(
            "n", N.number_words(F.col("n").cast("string"), N.LANGUAGES[lang]).alias("words")
        )

    return run


NUMBERS = """SELECT DISTINCT o_orderkey * 104729 + CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders
  UNION SELECT CAST(p_size AS BIGINT) FROM part"""
for code in ("hi", "te", "or"):
    _add(f"num_words_{code}", _numbers(code), f"SELECT n, {S.number('n', N.LANGUAGES[code])} AS words FROM ({NUMBERS})")

TEXTS = "SELECT DISTINCT hyp AS text FROM aligned UNION SELECT ref FROM aligned"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "aligned")
    return rows.select(F.col("hyp").alias("text")).unionByName(rows.select(F.col("ref").alias("text"))).distinct()


def _over_texts(f):
    return lambda spark, d: _texts(spark, d).select("text", f(F.col("text")).alias("out"))


for code, f in (("hi", N.normalize_hindi), ("te", N.normalize_telugu), ("or", N.normalize_odia)):
    _add(f"normalize_{code}", _over_texts(f), f"SELECT text, {S.normalized('text', code)} AS out FROM ({TEXTS})")
_add("punct_strip", _over_texts(N.strip_punctuation), f"SELECT text, {S.punctuation('text')} AS out FROM ({TEXTS})")
_add("bracket_strip", _over_texts(N.strip_brackets), f"SELECT text, {S.brackets('text')} AS out FROM ({TEXTS})")
_add("digit_fold", _over_texts(N.fold_digits), f"SELECT text, {S.digits('text')} AS out FROM ({TEXTS})")


def normalize_dispatch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "aligned")
    return rows.select("utt_id", N.normalize(F.col("ref"), F.col("lang")).alias("ref_n"), N.normalize(F.col("hyp"), F.col("lang")).alias("hyp_n"))


_add("normalize_dispatch", normalize_dispatch, f"SELECT utt_id, {S.dispatched('ref', 'lang')} AS ref_n, {S.dispatched('hyp', 'lang')} AS hyp_n FROM aligned")

WORDS = """SELECT word FROM lexicon UNION SELECT word_norm FROM lexicon UNION SELECT candidate FROM pair_labels
  UNION SELECT anchor FROM pair_labels UNION SELECT token FROM bg_counts"""


def terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of the lexicon, the judged pairs and the counts."""
    parts = [("lexicon", "word"), ("lexicon", "word_norm"), ("pair_labels", "candidate"), ("pair_labels", "anchor"), ("bg_counts", "token")]
    found = [table(spark, d, t).select(F.col(c).alias("word")) for t, c in parts]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _over_words(f):
    return lambda spark, d: terms(spark, d).select("word", f(F.col("word")).alias("out"))


NORMED = f"SELECT word, {S.norm_word('word')} AS c FROM ({WORDS})"
_add("strip_nukta", _over_words(nukta_free), f"SELECT word, {S.no_nukta('word')} AS out FROM ({WORDS})")
_add("norm_word", _over_words(P.norm_word), f"SELECT word, c AS out FROM ({NORMED})")
_add("phon", _over_words(P.phon), f"SELECT word, {S.phon('c')} AS out FROM ({NORMED})")
_add("skeleton", _over_words(P.skeleton), f"SELECT word, regexp_replace({S.phon('c')}, '[^A-Z]', '', 'g') AS out FROM ({NORMED})")

SOUNDS = "KNCJTDPBMYRLSHaioeun1"


def _sounds(spark: SparkSession) -> DataFrame:
    """The phonemes, each with each: a table of fixed size."""
    all_ = F.lit(list(SOUNDS))
    return spark.range(1).select(F.explode(all_).alias("a")).select("a", F.explode(all_).alias("b"))


_PAIRS = f"SELECT a, b FROM (SELECT unnest(string_split('{SOUNDS}', '')) AS a) x, (SELECT unnest(string_split('{SOUNDS}', '')) AS b) y"
_add("sub_cost", lambda spark, d: _sounds(spark).select("a", "b", P.sub_cost(F.col("a"), F.col("b")).alias("cost")), f"SELECT a, b, {S.sub_cost('a', 'b')} AS cost FROM ({_PAIRS})")
_add("indel_cost", lambda spark, d: _sounds(spark).select("a").distinct().select("a", P.indel_cost(F.col("a")).alias("cost")), f"SELECT DISTINCT a, {S.indel_cost('a')} AS cost FROM ({_PAIRS})")


def pair_distances(spark: SparkSession, d: str) -> DataFrame:
    """Phoneme distance and similarity of the two terms of every judged pair."""
    pairs = table(spark, d, "pair_labels").select("candidate", "anchor").distinct()
    # every term is encoded once, then looked up
    coded = terms(spark, d).filter("word is not null").select("word", P.phon(F.col("word")).alias("p"))
    left = coded.select(F.col("word").alias("candidate"), F.col("p").alias("a"))
    right = coded.select(F.col("word").alias("anchor"), F.col("p").alias("b"))
    both = pairs.join(left, "candidate").join(right, "anchor").filter("a <> '' and b <> ''").select("a", "b").distinct()
    return both.withColumn("d", P.pdist(F.col("a"), F.col("b")))


CODED = f"SELECT word, {S.phon('c')} AS p FROM ({NORMED}) WHERE word IS NOT NULL"
DISTANCES = f"""WITH coded AS ({CODED}), pairs AS (
  SELECT DISTINCT l.p AS a, r.p AS b FROM pair_labels x JOIN coded l ON x.candidate = l.word JOIN coded r ON x.anchor = r.word
  WHERE l.p <> '' AND r.p <> ''), measured AS (SELECT a, b, {S.pdist('a', 'b')} AS d FROM pairs)"""
_add("pdist", lambda spark, d: pair_distances(spark, d).select("a", "b", F.round("d", 6).alias("dist")), f"{DISTANCES} SELECT a, b, round(d, 6) AS dist FROM measured")
_add(
    "psim",
    lambda spark, d: pair_distances(spark, d).select("a", "b", F.round(P.similarity(F.col("d"), F.col("a"), F.col("b")), 6).alias("sim")),
    f"{DISTANCES} SELECT a, b, round(CAST({S.psim('d', 'a', 'b')} AS DOUBLE), 6) AS sim FROM measured",
)


def sql_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The normaliser as a SQL function."""
    register(spark)
    table(spark, d, "aligned").createOrReplaceTempView("sql_normalize_rows")
    return spark.sql("SELECT utt_id, normalize_text(ref, lang) AS ref_n, normalize_text(hyp, lang) AS hyp_n FROM sql_normalize_rows")


def sql_phon(spark: SparkSession, d: str) -> DataFrame:
    """Spelling, phonemes and skeleton as SQL functions."""
    register(spark)
    terms(spark, d).createOrReplaceTempView("sql_phon_rows")
    return spark.sql("SELECT word, norm_word(word) AS spelt, phon(word) AS phon, skeleton(word) AS skeleton FROM sql_phon_rows")


_add("sql_normalize", sql_normalize, SQL["normalize_dispatch"])
_add("sql_phon", sql_phon, f"SELECT word, c AS spelt, {S.phon('c')} AS phon, regexp_replace({S.phon('c')}, '[^A-Z]', '', 'g') AS skeleton FROM ({NORMED})")
