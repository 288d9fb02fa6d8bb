"""Dominant-speaker selection by energy.

Audio is cut into chunks with the energy up to every sample, one pass over each clip in numpy, and the
ends of the turns look their sample up by an equi-join.  So a turn never carries its clip's audio, and a
clip with a third of all turns is spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD, MIN_SECONDS, RELATIVE, SHORTEST = 0.3, 1.0, 0.25, 0.2
CHUNK = 4096
HELD = 1 << 20  # samples whose sums leave a worker at once


def durations(segments: DataFrame) -> DataFrame:
    """(clip_id, speaker, duration, first_idx); sums are rounded to a microsecond, the data's precision."""
    return segments.groupBy("clip_id", "speaker").agg(
        F.round(F.sum(F.col("end") - F.col("start")), 6).alias("duration"), F.min("seg_idx").alias("first_idx")
    )


def qualifying_speakers(segments: DataFrame, min_seconds: float = MIN_SECONDS) -> DataFrame:
    """Speakers who talk ``min_seconds`` or more in a clip."""
    return durations(segments).filter(F.col("duration") >= min_seconds)


def _samples(seconds: Column, sr: Column) -> Column:
    """Sample number of a time, cut off towards zero, never negative."""
    return F.greatest((seconds * sr).try_cast("long"), F.lit(0).cast("long"))


def sound(clips: DataFrame) -> DataFrame:
    """(clip_id, sr, n): rate and number of samples; no audio is 0 samples."""
    return clips.select("clip_id", "sr", F.greatest(F.coalesce(F.size("audio"), F.lit(0)), F.lit(0)).cast("long").alias("n"))


def _running(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(clip_id, audio) to (clip_id, chunk_no, upto): energy up to each sample of a chunk, from the clip's first one on."""
        for b in batches:
            clips: list[pa.Scalar] = []
            numbers: list[np.ndarray] = []
            sums: list[np.ndarray] = []
            sizes: list[np.ndarray] = []

            def flush() -> pa.RecordBatch:
                at = np.r_[0, np.cumsum(np.concatenate(sizes))]  # noqa: B023
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sums)))  # noqa: B023
                own = np.repeat(np.arange(len(clips)), [len(x) for x in numbers])  # noqa: B023
                ids = pa.array([c.as_py() for c in clips], b["clip_id"].type).take(pa.array(own))  # noqa: B023
                return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(numbers)), lists], names=["clip_id", "chunk_no", "upto"])  # noqa: B023

            held = 0
            for clip, audio in zip(b["clip_id"], b["audio"]):
                x = pc.fill_null(audio.values, 0).to_numpy(zero_copy_only=False).astype(float)
                total = np.cumsum(x * x)
                for lo in range(0, len(total), HELD // chunk * chunk or chunk):  # a long clip leaves in parts
                    part = total[lo : lo + (HELD // chunk * chunk or chunk)]
                    n = -(-len(part) // chunk)
                    clips.append(clip)
                    numbers.append(np.arange(n, dtype=np.int64) + lo // chunk)
                    sums.append(part)
                    sizes.append(np.diff(np.minimum(np.arange(n + 1) * chunk, len(part))))
                    held += len(part)
                    if held >= HELD:
                        yield flush()
                        clips, numbers, sums, sizes, held = [], [], [], [], 0
            if held:
                yield flush()

    return run


def _chunks(clips: DataFrame, chunk: int) -> DataFrame:
    """(clip_id, chunk_no, upto) of every clip with audio; a null sample is silence."""
    rows = clips.select("clip_id", "audio").filter(F.size("audio") > 0)
    return rows.mapInArrow(_running(chunk), f"clip_id {dict(rows.dtypes)['clip_id']}, chunk_no long, upto array<double>")


def segment_energy(segments: DataFrame, clips: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``sr`` and ``energy``, the sum of squares of a turn's samples, to every turn of a known clip.

    Times before the clip count from its start; what lies beyond its audio has no energy.
    """
    placed = (
        segments.join(sound(clips), "clip_id")
        .withColumn("a", F.least(_samples(F.col("start"), F.col("sr")), F.col("n")))
        .withColumn("b", F.greatest(F.least(_samples(F.col("end"), F.col("sr")), F.col("n")), F.col("a")))
        .drop("n")
    )
    points = placed.filter("b > a").select("clip_id", F.explode(F.array("a", "b")).alias("at")).filter("at > 0").distinct()
    size = F.lit(chunk)
    looked = (
        points.withColumn("chunk_no", F.floor((F.col("at") - 1) / size))
        .join(_chunks(clips, chunk), ["clip_id", "chunk_no"])
        .select("clip_id", "at", F.element_at("upto", (F.col("at") - F.col("chunk_no") * size).cast("int")).alias("upto"))
    )
    low = looked.select("clip_id", F.col("at").alias("a"), F.col("upto").alias("upto_a"))
    high = looked.select("clip_id", F.col("at").alias("b"), F.col("upto").alias("upto_b"))
    energy = F.when(F.col("b") > F.col("a"), F.col("upto_b") - F.coalesce("upto_a", F.lit(0.0))).otherwise(0.0)
    return placed.join(low, ["clip_id", "a"], "left").join(high, ["clip_id", "b"], "left").withColumn("energy", energy).drop("a", "b", "upto_a", "upto_b")


def robust_pick(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip_id, speaker, duration, rms): the loudest speaker of each clip among those who hold the floor.

    The floor is a second, or a quarter of the longest speaker's time if that is more.  Where nobody
    talks for a second, the longest speaker is taken.  Ties go to the speaker heard first.
    """
    spoken = (
        segment_energy(segments, clips).groupBy("clip_id", "speaker", "sr")
        .agg(
            F.round(F.sum(F.col("end") - F.col("start")), 6).alias("duration"),
            F.sum("energy").alias("energy"), F.min("seg_idx").alias("first_idx"),
        )
        .withColumn("rms", F.sqrt(F.greatest("energy", F.lit(0.0)) / F.greatest(F.col("duration") * F.col("sr"), F.lit(1.0))))
    )
    longest = spoken.groupBy("clip_id").agg(F.max("duration").alias("longest"))
    short = F.col("longest") < MIN_SECONDS
    floor = F.greatest(F.lit(MIN_SECONDS), RELATIVE * F.col("longest"))
    rank = F.struct(
        F.when(short, F.col("duration")).otherwise(F.round("rms", 9)).alias("by"), (-F.col("first_idx")).alias("early"), "speaker", "duration", "rms"
    )
    best = spoken.join(longest, "clip_id").filter(short | (F.col("duration") >= floor)).groupBy("clip_id").agg(F.max(rank).alias("x"))
    return best.select("clip_id", "x.speaker", "x.duration", "x.rms")


def slice_speaker(segments: DataFrame, picks: DataFrame, clips: DataFrame, pad: float = PAD) -> DataFrame:
    """(clip_id, speaker, audio): the picked speaker's turns, padded, one after the other.

    Turns are taken in the order of ``seg_idx``; padding may repeat audio.  A result shorter than a fifth of
    a second, or none, gives the whole clip; a clip without a pick keeps its audio and a null speaker.
    """
    own = segments.join(picks.select("clip_id", "speaker"), ["clip_id", "speaker"]).join(sound(clips), "clip_id")
    pieces = (
        own.withColumn("a", F.least(_samples(F.col("start") - pad, F.col("sr")), F.col("n")))
        .withColumn("b", F.least(_samples(F.col("end") + pad, F.col("sr")), F.col("n")))
        .filter("b > a")
        .groupBy("clip_id")
        .agg(F.array_sort(F.collect_list(F.struct("seg_idx", "a", "b"))).alias("pieces"))
    )
    part = lambda p: F.slice("audio", p["a"].cast("int") + 1, (p["b"] - p["a"]).cast("int"))
    cut = F.flatten(F.transform("pieces", part))
    enough = F.col("pieces").isNotNull() & (F.size(cut) >= (F.lit(SHORTEST) * F.col("sr")).cast("int"))
    return (
        clips.select("clip_id", "sr", "audio").join(picks.select("clip_id", "speaker"), "clip_id", "left").join(pieces, "clip_id", "left")
        .select("clip_id", "speaker", F.when(enough, cut).otherwise(F.col("audio")).alias("audio"))
    )


def select_best_speaker(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Picked speaker and audio of every clip."""
    return slice_speaker(segments, robust_pick(segments, clips), clips)
