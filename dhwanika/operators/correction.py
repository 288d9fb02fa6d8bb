"""Precision-first correction of out-of-vocabulary terms, and the domain terms of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalization import fold_digits
from ..functions.unicode import WHITE, nfkc, squeeze, words
from ..runtime import materialize, strip
from .matching import build_vocabulary, match

OOV_MAX, REL_MIN, MIN_SIM, TARGET_MIN = 0, 3, 0.90, 1
TIER = "oov_recovery"
FEW_EDITS = 100_000  # corrected tokens that are broadcast, some 15 MB; more are joined by a shuffle
# Diacritics that make no other word, and labels that make two terms one.
FOLDED = ("ँॉॲ", "ंोअ")
SILENT = "़्"
SAME = ("SAME_WORD", "SAME_MEANING")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def canonical_text(c: Column) -> Column:
    """NFKC, white space collapsed; empty for null."""
    return squeeze(nfkc(F.coalesce(c.cast("string"), F.lit(""))))


def tokens(canonical: Column) -> Column:
    """Tokens of a canonical text: whatever is neither a letter, digit nor Devanagari sign divides."""
    return words(F.regexp_replace(canonical, f"[^\\p{{L}}\\p{{N}}_\\x{{900}}-\\x{{97F}}{WHITE[1:-1]}]", " "))


def is_devanagari(c: Column) -> Column:
    return c.rlike(r"[\x{900}-\x{97F}]")


def fold(c: Column) -> Column:
    """A token without the diacritics that make no other word."""
    return F.translate(F.translate(nfkc(c), *FOLDED), SILENT, "")


def weights(lexicon: DataFrame, norm: str = "word_norm", word: str = "word", relevance: str = "relevance_mode") -> DataFrame:
    """(token, weight): greatest weight of every term, 1 at least.

    The term is the normalised word, or the word where that is null or empty; blank terms are left out.
    A weight that isn't a number is 1; decimals are cut off.
    """
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    token = strip(F.coalesce(filled(norm), F.col(word)))
    plain = strip(fold_digits(F.coalesce(filled(relevance), F.lit("1"))))
    value = F.coalesce(F.when(plain.rlike(NUMBER), plain).try_cast("double").try_cast("int"), F.lit(1))
    rows = lexicon.select(token.alias("token"), value.alias("w")).filter("token <> ''")
    return rows.groupBy("token").agg(F.greatest(F.max("w"), F.lit(1)).alias("weight"))


def targets(weighted: DataFrame, rel_min: int = REL_MIN) -> DataFrame:
    """Single words of high weight: what may be corrected towards."""
    return weighted.filter((F.col("weight") >= rel_min) & ~F.col("token").contains(" ")).select("token")


def target_vocabulary(weighted: DataFrame, rel_min: int = REL_MIN) -> DataFrame:
    """The targets as a matcher's vocabulary, in code-point order."""
    return build_vocabulary(targets(weighted, rel_min), "token", "token")


def variant_map(pairs: DataFrame, weighted: DataFrame, order: str = "row_no", rel_min: int = REL_MIN) -> DataFrame:
    """(candidate, anchor): spelling variants of high-weight terms; the first row of a candidate wins."""
    rows = (
        pairs.filter(F.col("label").isin(*SAME))
        .select(canonical_text(F.col("candidate")).alias("candidate"), canonical_text(F.col("anchor")).alias("anchor"), F.col(order).alias("nth"))
        .filter("candidate <> '' and anchor <> '' and candidate <> anchor")
        .filter(~F.col("candidate").contains(" ") & ~F.col("anchor").contains(" "))
    )
    heavy = weighted.filter(F.col("weight") >= rel_min).select(F.col("token").alias("anchor"))
    if rel_min > 1:
        rows = rows.join(heavy, "anchor", "left_semi")
    return rows.groupBy("candidate").agg(F.min(F.struct("nth", "anchor"))["anchor"].alias("anchor"))


def token_counts(batches: DataFrame, token: str = "token", n: str = "n") -> DataFrame:
    """(token, n): one count per token from counts by batch; null and blank tokens are left out."""
    rows = batches.select(F.col(token).alias("token"), F.col(n).cast("long").alias("n")).filter(strip(F.col("token")) != "")
    return rows.groupBy("token").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def known_gate(candidates: DataFrame, weighted: DataFrame, rel_min: int = REL_MIN) -> DataFrame:
    """Tokens that aren't targets already."""
    return candidates.join(targets(weighted, rel_min), "token", "left_anti")


def oov_gate(candidates: DataFrame, counts: DataFrame, oov_max: int = OOV_MAX) -> DataFrame:
    """Tokens that the corpus holds at most ``oov_max`` times."""
    return candidates.join(counts.filter(F.col("n") > oov_max).select("token"), "token", "left_anti")


def attested_gate(edits: DataFrame, counts: DataFrame, target_min: int = TARGET_MIN) -> DataFrame:
    """Matches whose target the corpus holds at least ``target_min`` times."""
    held = counts.select(F.col("token").alias("surface"), F.col("n").alias("held"))
    return edits.join(held, "surface", "left").filter(F.coalesce("held", F.lit(0)) >= target_min).drop("held")


def edit_table(
    candidates: DataFrame, weighted: DataFrame, counts: DataFrame,
    oov_max: int = OOV_MAX, rel_min: int = REL_MIN, min_sim: float = MIN_SIM, target_min: int = TARGET_MIN,
) -> DataFrame:
    """(token, surface, sim): corrections of the candidate tokens that pass every gate."""
    open_ = oov_gate(known_gate(candidates, weighted, rel_min), counts, oov_max)
    found = match(open_, "token", target_vocabulary(weighted, rel_min), min_sim)
    unique = found.filter(~F.col("collision") & (F.col("surface") != F.col("token")) & (F.col("sim") >= min_sim))
    other = unique.filter(fold(F.col("token")) != fold(F.col("surface")))
    return attested_gate(other, counts, target_min).select("token", "surface", "sim")


def correct(
    df: DataFrame, text: str, lexicon_weights: DataFrame, counts: DataFrame,
    oov_max: int = OOV_MAX, rel_min: int = REL_MIN, min_sim: float = MIN_SIM, target_min: int = TARGET_MIN,
) -> DataFrame:
    """Add ``corrected``, ``changed``, ``edits`` and ``n_recovered`` to every row.

    A text in which nothing is left to read (null, blank, ``NA``) comes back as it is; any other comes
    back in NFKC with white space collapsed.  The tokens are taken in order; each that can be corrected
    replaces the first whole word that equals it by then, one edit each.  Where ``oov_max`` is below
    ``target_min`` no replacement is a candidate itself, so all words are replaced at once; otherwise the
    tokens of a text are folded over its words.
    """
    canon = F.col("_canon")
    rows = df.withColumn("_canon", canonical_text(F.col(text)))
    # each task combines its own tokens, so no text is shuffled for them
    candidates = rows.select(F.explode(F.array_distinct(tokens(canon))).alias("token")).filter(is_devanagari(F.col("token"))).distinct()
    # a table of its own, so that neither its plan nor the words without a correction go into the join with the texts
    table = materialize(edit_table(candidates, lexicon_weights, counts, oov_max, rel_min, min_sim, target_min), "edits").df
    small = table.limit(FEW_EDITS + 1).count() <= FEW_EDITS
    in_turn = oov_max >= target_min
    said, heard, read = F.split("_canon", " "), tokens(canon), ~canon.isin("", "NA")
    # texts go by their hash: of two with the same hash each looks up words of its own only
    keyed = rows.withColumn("_key", F.when(read, F.xxhash64("_canon")))
    found = (
        keyed.filter("_key is not null").select("_key", F.explode(F.array_distinct(heard if in_turn else said)).alias("token"))
        .join(F.broadcast(table) if small else table, "token")
        .groupBy("_key")
        .agg(F.map_from_entries(F.collect_set(F.struct("token", F.struct("surface", "sim")))).alias("_map"))
    )
    out = keyed.join(found, "_key", "left")
    if in_turn:
        out = out.withColumn("_fold", F.when(F.col("_map").isNotNull(), _folded(said, heard)))
        edits, new = F.col("_fold.edits"), F.array_join("_fold.words", " ")
    else:
        edits = F.transform(
            F.filter(said, lambda w: F.map_contains_key("_map", w)),
            lambda w: F.struct(
                w.alias("from"), F.col("_map")[w]["surface"].alias("to"), F.round(F.col("_map")[w]["sim"], 3).alias("sim"), F.lit(TIER).alias("tier")
            ),
        )
        new = F.array_join(F.transform(said, lambda w: F.coalesce(F.col("_map")[w]["surface"], w)), " ")
    none = F.lit([]).cast("array<struct<from:string,to:string,sim:double,tier:string>>")
    changed = F.size("_edits") > 0  # a token may not be a whole word, or no more be one
    return (
        out.withColumn("_edits", F.coalesce(F.when(F.col("_map").isNotNull(), edits), none))
        .withColumn("corrected", F.when(~read, F.col(text)).when(changed, new).otherwise(canon))
        .withColumn("changed", changed)
        .withColumn("edits", F.col("_edits"))
        .withColumn("n_recovered", F.size("edits"))
        .drop("_key", "_canon", "_map", "_fold", "_edits")
    )


def _folded(said: Column, own: Column) -> Column:
    """struct<words, edits>: the words of a text after each token in turn has replaced the first word that equals it.

    A replacement may itself be a token that is still to come, or one that was taken before.
    """
    entry = lambda t: F.col("_map")[t]
    edit = lambda t: F.struct(t.alias("from"), entry(t)["surface"].alias("to"), F.round(entry(t)["sim"], 3).alias("sim"), F.lit(TIER).alias("tier"))
    none = F.lit([]).cast("array<struct<from:string,to:string,sim:double,tier:string>>")

    def step(state: Column, t: Column) -> Column:
        at = F.array_position(state["words"], t).cast("int")
        words_ = F.transform(state["words"], lambda w, i: F.when(i == at - 1, entry(t)["surface"]).otherwise(w))
        done = F.struct(words_.alias("words"), F.concat(state["edits"], F.array(edit(t))).alias("edits"))
        return F.when(F.map_contains_key("_map", t) & (at > 0), done).otherwise(state)

    return F.aggregate(own, F.struct(said.alias("words"), none.alias("edits")), step)


def domain_terms(df: DataFrame, key: str, normed: str, weighted: DataFrame, variants: DataFrame, rel_min: int = REL_MIN) -> DataFrame:
    """(key, nth, term): high-weight terms among the words of a normalised text, variants folded, in order."""
    said = df.select(F.col(key).alias("key"), F.posexplode(words(F.col(normed))).alias("nth", "token"))
    known = targets(weighted, rel_min).withColumn("is_target", F.lit(True))
    folded = variants.select(F.col("candidate").alias("token"), "anchor")
    return (
        said.join(known, "token", "left").join(folded, "token", "left")
        .filter("is_target or anchor is not null")
        .select(F.col("key").alias(key), "nth", F.coalesce("anchor", "token").alias("term"))
    )
