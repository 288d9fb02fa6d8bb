"""Queries of the speaker operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from ..operators import speakers as V
from ..runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Complete turns, those delivered twice once."""
    rows = table(spark, d, "segments").select("clip_id", "seg_idx", "start", "end", "speaker")
    return rows.dropna().filter(F.col("end") > F.col("start")).distinct()


def _clips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clips").select("clip_id", "sr", "audio")


TURNS = """turns AS (
  SELECT DISTINCT clip_id, seg_idx, "start" AS s, "end" AS e, speaker FROM segments
  WHERE clip_id IS NOT NULL AND seg_idx IS NOT NULL AND "start" IS NOT NULL AND "end" > "start" AND speaker IS NOT NULL
)"""
SPOKEN = """placed AS (
  SELECT t.*, sr, audio, greatest(CAST(trunc(s * sr) AS BIGINT), 0) AS a, least(greatest(CAST(trunc(e * sr) AS BIGINT), 0), coalesce(len(audio), 0)) AS b
  FROM turns t JOIN clips USING (clip_id)
), energies AS (
  SELECT clip_id, seg_idx, s, e, speaker, sr,
    CASE WHEN b > a THEN coalesce(list_sum(list_transform(audio[a + 1:b], lambda x: CAST(x AS DOUBLE) * x)), 0) ELSE 0 END AS energy FROM placed
)"""
PICKS = """spoken AS (
  SELECT clip_id, speaker, sr, round(sum(e - s), 6) AS duration, sum(energy) AS energy, min(seg_idx) AS first_idx FROM energies GROUP BY ALL
), loud AS (
  SELECT *, sqrt(energy / greatest(duration * sr, 1)) AS rms, max(duration) OVER (PARTITION BY clip_id) AS longest FROM spoken
), picks AS (
  SELECT clip_id, speaker, duration, rms FROM loud WHERE longest < 1 OR duration >= greatest(1, 0.25 * longest)
  QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY CASE WHEN longest < 1 THEN duration ELSE round(rms, 9) END DESC, first_idx, speaker DESC) = 1
)"""
SLICES = """own AS (
  SELECT t.clip_id, t.seg_idx, audio, greatest(CAST(trunc((s - 0.3) * sr) AS BIGINT), 0) AS a,
    least(greatest(CAST(trunc((e + 0.3) * sr) AS BIGINT), 0), coalesce(len(audio), 0)) AS b
  FROM turns t JOIN picks p ON t.clip_id = p.clip_id AND t.speaker = p.speaker JOIN clips c ON c.clip_id = t.clip_id
), joined AS (
  SELECT clip_id, flatten(list(audio[a + 1:b] ORDER BY seg_idx, a, b)) AS cut FROM own WHERE b > a GROUP BY clip_id
), sliced AS (
  SELECT c.clip_id, p.speaker, CASE WHEN j.cut IS NOT NULL AND len(j.cut) >= CAST(trunc(0.2 * sr) AS INTEGER) THEN j.cut ELSE c.audio END AS audio
  FROM clips c LEFT JOIN picks p USING (clip_id) LEFT JOIN joined j USING (clip_id)
)"""

QUERIES["qualifying_speakers"] = lambda spark, d: V.qualifying_speakers(turns(spark, d))
SQL["qualifying_speakers"] = f"WITH {TURNS} SELECT clip_id, speaker, round(sum(e - s), 6) AS duration, min(seg_idx) AS first_idx FROM turns GROUP BY clip_id, speaker HAVING round(sum(e - s), 6) >= 1"

QUERIES["segment_energy"] = lambda spark, d: V.segment_energy(turns(spark, d), _clips(spark, d)).select(
    "clip_id", "seg_idx", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"), "speaker", F.round("energy", 6).alias("energy")
)
SQL["segment_energy"] = f"WITH {TURNS}, {SPOKEN} SELECT clip_id, seg_idx, round(s, 6) + 0.0 AS start_s, round(e, 6) + 0.0 AS end_s, speaker, round(energy, 6) AS energy FROM energies"

QUERIES["robust_pick"] = lambda spark, d: V.robust_pick(turns(spark, d), _clips(spark, d)).withColumn("rms", F.round("rms", 6))
SQL["robust_pick"] = f"WITH {TURNS}, {SPOKEN}, {PICKS} SELECT clip_id, speaker, duration, round(rms, 6) AS rms FROM picks"


@arrow_udf(StructType().add("samples", "integer").add("total", "double").add("first", "double").add("last", "double"))
def _summary(audio: pa.Array) -> pa.Array:
    out = []
    for x in audio:
        a = np.zeros(0) if x.values is None else x.values.to_numpy(zero_copy_only=False).astype(float)
        out.append({"samples": len(a), "total": float(a.sum()), "first": float(a[0]) if len(a) else 0.0, "last": float(a[-1]) if len(a) else 0.0})
    return pa.array(out, pa.struct([("samples", pa.int32()), ("total", pa.float64()), ("first", pa.float64()), ("last", pa.float64())]))


def _described(df: DataFrame) -> DataFrame:
    """Audio as its length, sum and first and last sample: arrays don't compare across engines."""
    rows = df.select("clip_id", "speaker", _summary(F.col("audio")).alias("x"))
    plain = lambda c, n: F.round(F.col(f"x.{c}"), n) + 0.0  # noqa: E731 - no negative zero
    return rows.select(
        "clip_id", "speaker", "x.samples", plain("total", 4).alias("total"), plain("first", 6).alias("first_sample"), plain("last", 6).alias("last_sample")
    )


DESCRIBED = """SELECT clip_id, speaker, CAST(coalesce(len(audio), 0) AS INTEGER) AS samples,
  round(coalesce(list_sum(list_transform(audio, lambda x: CAST(x AS DOUBLE))), 0), 4) + 0.0 AS total,
  round(coalesce(CAST(audio[1] AS DOUBLE), 0) + 0.0, 6) AS first_sample, round(coalesce(CAST(audio[-1] AS DOUBLE), 0) + 0.0, 6) AS last_sample FROM sliced"""


def slice_longest(spark: SparkSession, d: str) -> DataFrame:
    """Audio of the speaker with the most time in each clip."""
    best = F.max(F.struct("duration", (-F.col("first_idx")).alias("early"), "speaker"))["speaker"]
    longest = V.durations(turns(spark, d)).groupBy("clip_id").agg(best.alias("speaker"))
    return _described(V.slice_speaker(turns(spark, d), longest, _clips(spark, d)))


QUERIES["slice_speaker"] = slice_longest
SQL["slice_speaker"] = f"""WITH {TURNS}, held AS (SELECT clip_id, speaker, round(sum(e - s), 6) AS duration, min(seg_idx) AS first_idx FROM turns GROUP BY clip_id, speaker),
picks AS (SELECT clip_id, speaker FROM held QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY duration DESC, first_idx, speaker DESC) = 1), {SLICES} {DESCRIBED}"""
QUERIES["select_best_speaker"] = lambda spark, d: _described(V.select_best_speaker(turns(spark, d), _clips(spark, d)))
SQL["select_best_speaker"] = f"WITH {TURNS}, {SPOKEN}, {PICKS}, {SLICES} {DESCRIBED}"
