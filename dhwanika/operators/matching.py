"""Fuzzy term matching: a similarity join of tokens with a vocabulary in phoneme space.

Tokens are made distinct first.  A token whose phoneme string is in the vocabulary is settled by an
equi-join.  The others meet the entries of their first phoneme (entries of any first phoneme where
theirs has none) whose length differs by at most ``len_gate``; both are equi-join keys, and an exact
lower bound by built-in edit distance thins the pairs before the weighted distance is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonetics import norm_word, pdist, phon_of, similarity
from ..runtime import materialize, shuffle_partitions

MIN_SIM, LEN_GATE = 0.84, 3
FEW_FOUND = 100_000  # distinct windows that are broadcast, some 20 MB; more are joined by a shuffle
CHEAPEST = 0.4  # cost of the cheapest edit: bounds the number of edits from the distance


def _inlined(spelt: Column) -> Column:
    """The phoneme string as a generated column ``phon``, so that filters on it don't compute it again."""
    return F.inline(F.array(F.struct(phon_of(spelt).alias("phon"))))


def build_vocabulary(df: DataFrame, word: str, position: str) -> DataFrame:
    """(surface, phon, first, len, position, n_homophones): one entry per canonical spelling.

    Of words with one spelling the one of least ``position`` counts; words without phonemes are left
    out.
    """
    spelt = df.select(norm_word(F.col(word)).alias("surface"), F.col(position).alias("position"))
    entries = (
        spelt.groupBy("surface").agg(F.min("position").alias("position"))
        .select("surface", "position", _inlined(F.col("surface"))).filter("phon <> ''")
    )
    same = entries.groupBy("phon").agg(F.count("*").alias("n_homophones"))
    return entries.join(same, "phon").select(
        "surface", "phon", F.left("phon", F.lit(1)).alias("first"), F.length("phon").alias("len"), "position", "n_homophones"
    )


def homophones(vocabulary: DataFrame) -> DataFrame:
    """(phon, least_surface, n): the spellings that share a phoneme string."""
    return vocabulary.groupBy("phon").agg(F.min("surface").alias("least_surface"), F.count("*").alias("n"))


def encode_tokens(df: DataFrame, token: str) -> DataFrame:
    """Distinct (token, spelt, phon); tokens without phonemes match nothing and are left out."""
    rows = df.select(F.col(token).cast("string").alias("token")).dropna().distinct()
    return rows.withColumn("spelt", norm_word(F.col("token"))).select("token", "spelt", _inlined(F.col("spelt"))).filter("phon <> ''")


def match_exact(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens (encoded) whose phoneme string is in the vocabulary: the member itself, else the least spelling."""
    member = vocabulary.select(F.col("surface").alias("spelt"), F.lit(True).alias("member"))
    return (
        tokens.join(homophones(vocabulary), "phon").join(member, "spelt", "left")
        .select(
            "token", F.when(F.col("member"), F.col("spelt")).otherwise(F.col("least_surface")).alias("surface"),
            F.lit(1.0).alias("sim"), (F.col("n") > 1).alias("collision"),
        )
    )


def match_fuzzy(tokens: DataFrame, vocabulary: DataFrame, min_sim: float = MIN_SIM, len_gate: int = LEN_GATE) -> DataFrame:
    """Best entry of each token (encoded) that no phoneme string of the vocabulary equals."""
    rest = tokens.join(vocabulary.select("phon").distinct(), "phon", "left_anti")
    firsts = vocabulary.select("first").distinct().withColumn("known", F.lit(True))
    size = F.length("phon")
    band = F.sequence(F.greatest(size - len_gate, F.lit(1)), size + len_gate)
    wide = (
        rest.withColumn("first", F.left("phon", F.lit(1))).join(firsts, "first", "left")
        .select("token", "phon", "first", "known", F.explode(band).alias("len"))
    )
    entry = vocabulary.select("surface", F.col("phon").alias("entry"), "first", "len", "position")
    near = wide.filter("known").join(entry, ["first", "len"])
    far = wide.filter("known is null").drop("first").join(entry.drop("first"), "len")
    cols = ["token", "phon", "surface", "entry", "position"]
    longest = F.greatest(F.length("phon"), F.length("entry"))
    budget = (1 - min_sim) * longest
    pairs = (
        near.select(cols).unionByName(far.select(cols))
        .filter(0.5 * F.abs(F.length("phon") - F.length("entry")) <= budget + 1e-9)
        .filter(F.levenshtein("phon", "entry") <= budget / CHEAPEST + 1e-9)
        .withColumn("d", pdist(F.col("phon"), F.col("entry")))
        .withColumn("sim", similarity(F.col("d"), F.col("phon"), F.col("entry")))
        .filter(F.col("sim") >= min_sim)
        .withColumn("level", F.round("sim", 9))
    )
    levels = pairs.groupBy("token", "level").agg(
        F.min(F.struct("position", "surface", "sim")).alias("first"), F.count("*").alias("ties")
    )
    return levels.groupBy("token").agg(F.max_by(F.struct("first", "ties"), "level").alias("b")).select(
        "token", F.col("b.first.surface").alias("surface"), F.col("b.first.sim").alias("sim"), (F.col("b.ties") > 1).alias("collision")
    )


def match(df: DataFrame, token: str, vocabulary: DataFrame, min_sim: float = MIN_SIM, len_gate: int = LEN_GATE) -> DataFrame:
    """(token, surface, sim, collision) of every distinct token that matches.

    Defined cases: null tokens and tokens without phonemes match nothing; equally near entries give
    the one of least position and ``collision``; an empty vocabulary or table gives no rows.
    """
    # both are read by several branches: encoded once, written, read back
    tokens = materialize(encode_tokens(df, token), "tokens").df
    vocabulary = materialize(vocabulary, "vocabulary").df
    return match_exact(tokens, vocabulary).unionByName(match_fuzzy(tokens, vocabulary, min_sim, len_gate))


def correct_windows(df: DataFrame, key: str, tokens: str, vocabulary: DataFrame, min_sim: float = MIN_SIM, len_gate: int = LEN_GATE) -> DataFrame:
    """Proposals over windows of three, two and one tokens, longest first, left to right.

    ``df[tokens]`` is an array of strings and ``df[key]`` unique.  Returns (key, nth, i, span, text,
    surface, sim, collision); a window whose match is its own spelling leaves its tokens free.
    """
    rows = df.select(F.col(key).alias("key"), F.col(tokens).alias("tokens")).filter(F.size("tokens") > 0)
    # few bytes make many windows, so the rows go to all cores, however small they are
    lines = materialize(rows.repartition(shuffle_partitions(df.sparkSession)).withColumn("id", F.monotonically_increasing_id()), "lines").df
    spans = F.filter(F.array(F.lit(3), F.lit(2), F.lit(1)), lambda s: s <= F.size("tokens"))
    windows = (
        lines.select("id", "tokens", F.explode(spans).alias("span"))
        .select("id", "tokens", "span", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("span"))).alias("i"))
        .select("id", "span", "i", F.array_join(F.slice("tokens", F.col("i") + 1, F.col("span")), "").alias("joined"))
    )
    found = match(windows, "joined", vocabulary, min_sim, len_gate).withColumnRenamed("token", "joined")
    found = materialize(found.filter(F.col("surface") != norm_word(F.col("joined"))), "found").df
    # few windows match: their number decides whether the others have to be shuffled to meet them
    small = found.limit(FEW_FOUND + 1).count() <= FEW_FOUND
    hits = windows.join(F.broadcast(found) if small else found, "joined")
    every = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("span")).alias("o"), "i", "span", "surface", "sim", "collision"))).alias("all"))
    clear = lambda kept, w: ~F.exists(kept, lambda k: (k["i"] < w["i"] + w["span"]) & (w["i"] < k["i"] + k["span"]))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, w: F.when(clear(kept, w), F.concat(kept, F.array(w))).otherwise(kept))
    text = F.array_join(F.slice("tokens", F.col("w.i") + 1, F.col("w.span")), " ").alias("text")
    return every.select("id", F.posexplode(kept).alias("nth", "w")).join(lines, "id").select(
        F.col("key").alias(key), "nth", "w.i", "w.span", text, "w.surface", "w.sim", "w.collision"
    )
