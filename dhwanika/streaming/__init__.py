"""The stateless operators on streams, and a windowed error rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalization import NOTHING, normalize
from ..functions.unicode import words
from ..operators.scoring import word_edits


def normalize_stream(df: DataFrame, text: str, lang: str, to: str) -> DataFrame:
    """Add the normalised text; the same plan on a stream and on a table."""
    return df.withColumn(to, normalize(F.col(text), F.col(lang)))


def wer_by_window(df: DataFrame, at: str, window: str, late: str, ref: str = "ref", hyp: str = "hyp", lang: str = "lang", key: str = "utt_id") -> DataFrame:
    """Word error rate per event-time window: (start, end, edits, words, pairs, wer).

    An utterance delivered again within the watermark counts once.  Rows later than ``late`` behind the
    newest are dropped by the watermark, as on any stream; on a table nothing is.
    """
    rows = df.withWatermark(at, late)
    rows = rows.dropDuplicatesWithinWatermark([key]) if df.isStreaming else rows.dropDuplicates([key])
    pairs = rows.select(at, F.inline(F.array(F.struct(normalize(F.col(ref), F.col(lang)).alias("rn"), normalize(F.col(hyp), F.col(lang)).alias("hn")))))
    scored = pairs.filter((F.col("rn") != NOTHING) & (F.col("hn") != NOTHING)).select(
        at, F.size(words(F.col("rn"))).alias("n"), word_edits(words(F.col("rn")), words(F.col("hn"))).alias("e")
    )
    sums = scored.groupBy(F.window(at, window)).agg(F.sum("e").alias("edits"), F.sum("n").alias("words"), F.count("*").alias("pairs"))
    return sums.select("window.start", "window.end", "edits", "words", "pairs", (F.col("edits") / F.col("words")).alias("wer"))
