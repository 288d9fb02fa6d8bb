"""The queries of this subpackage over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, once_per_key, strip, table
from .canon import canonicalise
from .components import group_terms
from .encoding import encode, token_counts
from .frequencies import bg_rows, counts_of, hyp_records, mark_terms
from .languages import detect, fit, mislabelled
from .looks import pairs_of, same_looking_columns, same_looking_rows, unify
from .packing import pack
from .sql import SQL  # noqa: F401
from .texts import usable
from .truncation import rates, truncated


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(table(spark, sf_dir, "aligned"), fit(table(spark, sf_dir, "lang_samples")))


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ref with its language, and every stretch of it."""
    rows = table(spark, sf_dir, "aligned").filter(usable("ref"))
    return detect(rows, "utt_id", "ref", fit(table(spark, sf_dir, "lang_samples")))


def _lexicon_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings and local names of the terms; a term is a spelling of itself."""
    words = table(spark, sf_dir, "lexicon").select("word", "word_norm")
    own = words.select(F.col("word_norm").alias("form"), F.col("word_norm").alias("canon"))
    return words.select(F.col("word").alias("form"), F.col("word_norm").alias("canon")).unionByName(own).distinct()


def _weight_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the weights: the number, either name, both together, and the number after a w."""
    w = table(spark, sf_dir, "weight_scale").withColumn("n", F.col("weight").cast("string"))
    forms = [F.col("n"), F.concat(F.lit("w"), "n"), F.concat(F.lit("weight "), "n")]
    for name in ("name_en", "name_hi"):
        forms += [F.col(name), F.concat_ws(" ", name, "n"), F.concat_ws(" ", "n", name)]
    return w.select(F.explode(F.array(*forms)).alias("form"), F.col("n").alias("canon"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _lexicon_forms(spark, sf_dir)
    norms = words.select(strip(F.col("canon")).alias("hyp")).dropna().distinct()
    typed = once_per_key(table(spark, sf_dir, "aligned").filter("task = 'term'"), "utt_id", "received_at", ["hyp"])
    typed = typed.filter(usable("hyp")).join(norms, "hyp", "left_anti")
    terms = canonicalise(typed, "utt_id", "hyp", words, "form", "canon")
    lexicon = table(spark, sf_dir, "lexicon")
    free = lexicon.filter((strip(F.col("relevance_mode")) != "") & ~F.col("relevance_mode").isin("4", "3", "2", "1"))
    weights = canonicalise(free, "lex_id", "relevance_mode", _weight_forms(spark, sf_dir), "form", "canon")
    named = lambda d, tab, key: d.select(F.lit(tab).alias("tab"), F.col(key).alias("rec_id"), F.coalesce("canon", F.lit("-")).alias("canon"))
    return named(terms, "aligned", "utt_id").unionByName(named(weights, "lexicon", "lex_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_terms(table(spark, sf_dir, "pair_labels"))


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hyp = materialize(hyp_records(spark, sf_dir), "hyp").df  # read for the terms and for their number
    # a batch number may be missing; such rows form a record of their own
    bg = bg_rows(spark, sf_dir).withColumn("batch_no", F.coalesce("batch_no", F.lit(-(2**63))))
    return counts_of({"hyp": (hyp, "hyp"), "bg": (bg, "token", "batch_no", "n")}), hyp


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, _ = _counts(spark, sf_dir)
    return counts.select("src", "term_id", F.col("term").alias("token"), "occurrences", "records")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, utterances = _counts(spark, sf_dir)
    held = materialize(counts, "counts").df  # read for the marks and for the sum over all terms
    h, b = held.filter("src = 'hyp'"), held.filter("src = 'bg'")
    h = mark_terms(h, "records", 1, 0.05, utterances.agg(F.count("*").alias("whole")))
    b = mark_terms(b, "occurrences", 2, 0.005, b.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("whole")))
    return h.unionByName(b).select("src", F.col("term").alias("token"), "mark")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "aligned").filter(usable("ref") & usable("hyp"))
    both = same_looking_columns(rows, "utt_id", "ref", "hyp")
    words = pairs_of(same_looking_rows(table(spark, sf_dir, "lexicon"), "lex_id", "word"), "lex_id")  # the result is pairs
    return both.select(F.lit("aligned").alias("tab"), F.col("utt_id").alias("id_a"), F.col("utt_id").alias("id_b")).unionByName(
        words.select(F.lit("lexicon").alias("tab"), "id_a", "id_b")
    )


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ref, hyp and word in its one form: (tab, rec_id, field, form), rows as delivered."""
    rows = table(spark, sf_dir, "aligned")
    parts = [rows.select(F.lit("aligned").alias("tab"), F.col("utt_id").alias("rec_id"), F.lit(c).alias("field"), F.col(c).alias("form")) for c in ("ref", "hyp")]
    words = table(spark, sf_dir, "lexicon")
    parts.append(words.select(F.lit("lexicon").alias("tab"), F.col("lex_id").alias("rec_id"), F.lit("word").alias("field"), F.col("word").alias("form")))
    return unify(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["form"])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack(sizes, table(spark, sf_dir, "containers"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).filter("truncated").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(truncated(table(spark, sf_dir, "documents")))


QUERIES = {"p1_found": p1_found, "p1_languages": p1_languages, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_counts": p4_counts, "p6_found": p6_found, "p6_forms": p6_forms, "p7_ids": p7_ids, "p8_pack": p8_pack, "p9_found": p9_found, "p9_rates": p9_rates}

