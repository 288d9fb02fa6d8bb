"""Word error rate, plain and weighted by how critical the terms are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StructType

from ..functions.alignment import EQUAL, chunked, flat_operations, weighed
from ..functions.normalization import NOTHING, Normalizer, normalize, normalize_hindi
from ..functions.unicode import words
from ..runtime import materialize, strip

HELD = 200_000  # weights that are broadcast; more of them are joined with the texts instead
SCORED = StructType().add("edits", "long").add("weight", "double").add("total", "double").add("words", "long")
CHUNK = StructType().add("type", "string").add("ref_start", "integer").add("ref_end", "integer").add("hyp_start", "integer").add("hyp_end", "integer")


@arrow_udf(LongType())
def word_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Least number of word edits between two arrays of words."""
    ops, begin, *_ = flat_operations(ref, hyp)
    wrong = np.r_[0, np.cumsum(ops != EQUAL)]
    return pa.array(wrong[begin[1:]] - wrong[begin[:-1]], pa.int64())


@arrow_udf(ArrayType(CHUNK))
def alignment_chunks(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Runs of equal, substituted, deleted and inserted words of two arrays of words, with their places in both.

    Of alignments with equally few edits the one is taken that ``functions.alignment.operations`` names.  A
    null array has no words; of two without words there are no runs.
    """
    return chunked(ref, hyp)


def aligned_chunks(df: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """(key, nth, type, ref_start, ref_end, hyp_start, hyp_end): the runs of every row's two texts, as words, in order.

    Places count words from 0; the end is the place after the last.  Defined cases: a null or blank text has
    no words, and two such texts give no rows; repeated keys give repeated rows; a null key is a key like any
    other; texts of any length are aligned whole; an empty table gives no rows; other columns are ignored.
    """
    runs = df.select(F.col(key).alias("key"), F.posexplode(alignment_chunks(words(F.col(ref)), words(F.col(hyp)))).alias("nth", "x"))
    return runs.select(F.col("key").alias(key), "nth", "x.*")


def _scorer(spark, weighted: DataFrame):
    """Function of two arrays of words to their struct of sums; the weights are held by every worker."""
    shared = spark.sparkContext.broadcast({r["token"]: float(r["weight"]) for r in weighted.select("token", "weight").collect()})

    @arrow_udf(SCORED)
    def score(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        known = shared.value
        return weighed(ref, hyp, lambda ws: [known.get(w, 1.0) for w in ws])

    return score


@arrow_udf(SCORED)
def _score_mapped(ref: pa.Array, hyp: pa.Array, weights: pa.Array) -> pa.Array:
    """The same with a map of weights for every row; a word weighs the same in any of them."""
    known = dict(zip(weights.keys.to_pylist(), weights.items.to_pylist()))
    return weighed(ref, hyp, lambda ws: [known.get(w, 1.0) for w in ws])


def _pairs(df: DataFrame, r: Column, h: Column, *by: str) -> DataFrame:
    """Distinct normalised pairs with how often they occur: equal pairs are aligned once."""
    # inlined, so that the filters below don't evaluate the normalisers once more each
    rows = df.select(*by, F.inline(F.array(F.struct(r.alias("rn"), h.alias("hn"))))).dropna(subset=["rn", "hn"])
    return rows.filter(F.col("rn") != NOTHING).groupBy(*by, "rn", "hn").agg(F.count("*").alias("times"))


def _wer(pairs: DataFrame, *by: str) -> DataFrame:
    counted = pairs.filter(F.col("hn") != NOTHING).select(
        *by, "times", F.size(words(F.col("rn"))).alias("n"), word_edits(words(F.col("rn")), words(F.col("hn"))).alias("e")
    )
    grouped = counted.groupBy(*by) if by else counted.groupBy()
    return grouped.agg(
        F.coalesce(F.sum(F.col("e") * F.col("times")), F.lit(0)).cast("long").alias("edits"),
        F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).cast("long").alias("words"),
        F.coalesce(F.sum("times"), F.lit(0)).cast("long").alias("pairs"),
    ).withColumn("wer", F.when(F.col("words") == 0, F.lit(float("nan"))).otherwise(F.col("edits") / F.col("words")))


def corpus_wer(df: DataFrame, ref: str = "ref", hyp: str = "hyp", normalizer: Normalizer = normalize_hindi) -> DataFrame:
    """One row: edits, words, pairs and their rate over all pairs of which neither side is empty.

    Without a pair the rate is NaN.
    """
    return _wer(_pairs(df, normalizer(F.col(ref)), normalizer(F.col(hyp))))


def corpus_wer_by_lang(df: DataFrame, ref: str = "ref", hyp: str = "hyp", lang: str = "lang", by: tuple[str, ...] = ()) -> DataFrame:
    """As ``corpus_wer``, each row normalised by its own language; a rate per group where ``by`` names columns."""
    return _wer(_pairs(df, normalize(F.col(ref), F.col(lang)), normalize(F.col(hyp), F.col(lang)), *by), *by)


def scored_pairs(df: DataFrame, ref: str = "ref", hyp: str = "hyp", lang: str = "lang") -> DataFrame:
    """Distinct normalised pairs for the weighted rate: a hypothesis that failed or is empty counts as no words."""
    bad = F.col(hyp).isNull() | (strip(F.col(hyp)) == "") | F.col(hyp).startswith("__ERROR__")
    h = normalize(F.col(hyp), F.col(lang))
    return _pairs(df, normalize(F.col(ref), F.col(lang)), F.when(bad | (h == NOTHING), "").otherwise(h))


def weight_of(df: DataFrame, token: str, weighted: DataFrame) -> DataFrame:
    """Add ``weight`` to every row: that of its token, 1 for any other and for null."""
    held = weighted.select(F.col("token").alias("_token"), F.col("weight"))
    return df.join(held, F.col(token) == F.col("_token"), "left").drop("_token").withColumn("weight", F.coalesce("weight", F.lit(1)))


def word_weights(texts: DataFrame, text: str, weighted: DataFrame) -> DataFrame:
    """(text, weights): for every distinct text that holds weighted words, their weights by word."""
    return (
        texts.select(text).distinct()
        .select(text, F.explode(F.array_distinct(words(F.col(text)))).alias("token"))
        .join(weighted, "token")
        .groupBy(text)
        .agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("weight").cast("double")))).alias("weights"))
    )


def weighted_wer(df: DataFrame, weighted: DataFrame, ref: str = "ref", hyp: str = "hyp", lang: str = "lang", held: int = HELD) -> DataFrame:
    """One row: numerators and denominators of the weighted and the plain rate, and both rates to 4 places.

    ``weighted``: (token, weight), a row a token; any other word weighs 1.  Rows whose reference is empty are
    left out.  Up to ``held`` weights are broadcast; more are joined with the words of the texts.
    """
    pairs = scored_pairs(df, ref, hyp, lang)
    if weighted.limit(held + 1).count() <= held:
        score = _scorer(df.sparkSession, weighted)
        scored = pairs.select("times", score(words(F.col("rn")), words(F.col("hn"))).alias("a"))
    else:
        pairs = materialize(pairs, "pairs").df  # read three times below
        of = word_weights(pairs.select(F.explode(F.array("rn", "hn")).alias("text")), "text", weighted)
        maps = pairs.join(of.select(F.col("text").alias("rn"), F.col("weights").alias("rw")), "rn", "left").join(
            of.select(F.col("text").alias("hn"), F.col("weights").alias("hw")), "hn", "left"
        )
        entries = [F.coalesce(F.map_entries(c), F.lit([]).cast("array<struct<key:string,value:double>>")) for c in ("rw", "hw")]
        both = F.map_from_entries(F.array_distinct(F.concat(*entries)))
        scored = maps.select("times", _score_mapped(words(F.col("rn")), words(F.col("hn")), both).alias("a"))
    sums = scored.agg(
        *[F.coalesce(F.sum(F.col(f"a.{c}") * F.col("times")), F.lit(0)).cast(t).alias(k) for k, c, t in (
            ("num", "weight", "double"), ("den", "total", "double"), ("edits", "edits", "long"), ("words", "words", "long"),
        )]
    )
    return sums.withColumn("awwer", F.round(F.col("num") / F.greatest("den", F.lit(1.0)), 4)).withColumn(
        "wer", F.round(F.col("edits") / F.greatest("words", F.lit(1)), 4)
    )
