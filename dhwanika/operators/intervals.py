"""Overlapping and gapped time intervals: periods and gaps per entity, by run bitmaps.

Time is discretised to whole milliseconds.  An entity's time line is cut into shards of 2**20 ms; a
shard holds the *run bitmap* of the intervals that start in it, compressed to run containers (sorted
starts and ends of its set runs; the last run may reach beyond the shard, so a week-long interval
costs one run, not a thousand pieces).  The steps:

1. map side: every Arrow batch is united to run containers per (entity, shard) before the shuffle;
2. reduce side: the containers of each (entity, shard) are united;
3. one small summary row per shard (first and last run, greatest end) carries open runs over shard
   borders by a window; the containers themselves never pass that window;
4. set runs (periods) and clear runs (gaps) are read off each container with its carried state.

No task ever holds an entity: a shard has at most 2**19 disjoint runs, and the window sees one row
per occupied shard (about 30,000 for a year of one entity's time).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_BITS = 20
LOW = np.iinfo(np.int64).min
RUNS_HELD = 1 << 16  # runs of an open group that wait before they are united


def unite(group: np.ndarray, start: np.ndarray, end: np.ndarray, multi: np.ndarray):
    """Union of runs that are sorted by (group, start); groups are numbered from 0 upwards.

    Returns group, start, end, multi of the united runs.  ``multi`` tells that a run was built from
    two or more different intervals: equal single runs stay single, so repeats never count.
    """
    n = len(group)
    if n == 0:
        return group, start, end, multi
    # running greatest end inside each group: lift each group above all ends of the one before it
    low = min(int(start.min()), 0)
    span = int(end.max()) - low + 1
    if (int(group[-1]) + 1) * span < 2**62:
        lifted = np.maximum.accumulate(end - low + group * span)
        reach = np.empty(n, np.int64)
        reach[0] = -1
        reach[1:] = lifted[:-1]
        head = (start - low + group * span) > reach
        head[0] = True
        head[1:] |= group[1:] != group[:-1]
    else:  # times so long that the lift would overflow: group by group
        head = np.ones(n, bool)
        borders = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(borders, [*borders[1:], n]):
            top = np.maximum.accumulate(end[a:b])
            head[a + 1 : b] = start[a + 1 : b] > top[:-1]
    at = np.flatnonzero(head)
    low_e, high_e = np.minimum.reduceat(end, at), np.maximum.reduceat(end, at)
    high_s = np.maximum.reduceat(start, at)
    many = np.maximum.reduceat(multi.astype(np.int8), at).astype(bool)
    return group[at], start[at], high_e, many | (low_e != high_e) | (high_s != start[at])


def _codes(clip, speaker, shard) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of consecutive equal (clip, speaker, shard) rows and the first row of each."""
    new = np.ones(len(clip), bool)
    new[1:] = (clip[1:] != clip[:-1]) | (speaker[1:] != speaker[:-1]) | (shard[1:] != shard[:-1])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entity, speaker, shard, s, e) to run containers, batch by batch."""
    for b in batches:
        if not b.num_rows:
            continue
        words = b["speaker"].dictionary_encode()
        code = words.indices.to_numpy()
        clip, shard = b["entity"].to_numpy(), b["shard"].to_numpy()
        s, e = b["s"].to_numpy(), b["e"].to_numpy()
        o = np.lexsort((e, s, shard, code, clip))
        clip, code, shard = clip[o], code[o], shard[o]
        yield _containers(clip, words.dictionary, code, shard, s[o], e[o], np.zeros(len(o), bool))


def _containers(clip, words, code, shard, s, e, multi) -> pa.RecordBatch:
    group, first = _codes(clip, code, shard)
    g, s, e, multi = unite(group, s, e, multi)
    offsets = np.searchsorted(g, np.arange(len(first) + 1)).astype(np.int32)
    lists = lambda x, t: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, t))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(clip[first], pa.int64()),
            words.take(pa.array(code[first])),
            pa.array(shard[first], pa.int64()),
            lists(s, pa.int64()),
            lists(e, pa.int64()),
            lists(multi, pa.bool_()),
        ],
        names=["entity", "speaker", "shard", "starts", "ends", "multi"],
    )


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite containers that arrive sorted by (entity, speaker, shard); a group may cross batches.

    Of the group that is still open its containers are kept, united again whenever they have doubled, so
    many containers of one group take time in proportion.
    """
    held: list[pa.RecordBatch] = []
    key, waiting, united = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        of = lambda k: tuple(b[c][k].as_py() for c in ("entity", "speaker", "shard"))  # noqa: B023, E731
        if held and of(0) != key:
            yield _merge(pa.Table.from_batches(held))
            held, waiting, united = [], 0, 0
        key = of(b.num_rows - 1)
        same = None
        for c, v in zip(("entity", "speaker", "shard"), key):
            x = pc.equal(b[c], pa.scalar(v, b[c].type))
            same = x if same is None else pc.and_(same, x)
        done = b.num_rows - int(pc.sum(same).as_py() or 0)
        if done:  # the rows before the last group, and what is held of their first one
            yield _merge(pa.Table.from_batches([*held, b.slice(0, done)]))
            held, waiting, united = [], 0, 0
        held.append(b.slice(done))
        waiting += len(held[-1]["starts"].flatten())
        if waiting > max(2 * united, RUNS_HELD):
            held = [_merge(pa.Table.from_batches(held))]
            waiting = united = len(held[0]["starts"].flatten())
    if held:
        yield _merge(pa.Table.from_batches(held))


def _merge(t: pa.Table) -> pa.RecordBatch:
    t = t.combine_chunks()
    col = lambda c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
    words = col("speaker").dictionary_encode()
    code = words.indices.to_numpy()
    sizes = pc.list_value_length(col("starts")).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(t.num_rows), sizes)
    clip, code, shard = (x[rows] for x in (col("entity").to_numpy(), code, col("shard").to_numpy()))
    flat = lambda c: pc.list_flatten(col(c)).to_numpy(zero_copy_only=False)
    s, e, multi = flat("starts"), flat("ends"), flat("multi")
    group, _ = _codes(clip, code, shard)
    o = np.lexsort((e, s, group))
    return _containers(clip, words.dictionary, code, shard, s[o], e[o], multi[o])


def _emit(batches: Iterator[pa.RecordBatch], singles: bool) -> Iterator[pa.RecordBatch]:
    """Periods that end and gaps that close in each shard, given the state carried into it."""
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]).combine_chunks()
        col = lambda c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]  # noqa: E731, B023
        num = lambda c, d: pc.fill_null(col(c), d).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(col("starts")).to_numpy(zero_copy_only=False).astype(np.int64)
        n = t.num_rows
        row = np.repeat(np.arange(n), sizes)
        flat = lambda c: pc.list_flatten(col(c)).to_numpy(zero_copy_only=False)
        s, e, multi = flat("starts"), flat("ends"), flat("multi").astype(bool)
        carry, p_start = num("carry", LOW), num("p_start", LOW)
        p_multi, last = num("p_multi", False).astype(bool), num("is_last", False).astype(bool)
        head = s > carry[row]
        first_run = np.r_[0, np.cumsum(sizes)[:-1]]
        absorbed = np.bincount(row[~head], minlength=n)
        reach = carry.copy()
        np.maximum.at(reach, row[~head], e[~head])
        h = np.flatnonzero(head)
        hr = row[h]
        opens = h == first_run[hr] + absorbed[hr]  # the first head of its shard
        before = np.where(opens, reach[hr], e[h - 1])
        b_start = np.where(opens, p_start[hr], s[h - 1])
        b_multi = np.where(opens, p_multi[hr] | (absorbed[hr] > 0), multi[h - 1])
        has = ~opens | (p_start[hr] != LOW)
        # the entity's last period stays open until its last shard ends
        heads = np.bincount(hr, minlength=n)
        z = np.flatnonzero(last)
        end_run = first_run + sizes - 1
        z_start = np.where(heads[z] > 0, s[end_run[z]], p_start[z])
        z_end = np.where(heads[z] > 0, e[end_run[z]], reach[z])
        z_multi = np.where(heads[z] > 0, multi[end_run[z]], True)
        i_gap = np.flatnonzero(has)
        i_per = np.flatnonzero(has & (b_multi | singles))
        z_keep = np.flatnonzero(z_multi | singles)
        rows = np.r_[hr[i_gap], hr[i_per], z[z_keep]]
        of_many = np.r_[b_multi[i_per], z_multi[z_keep]]
        kinds = ["gap"] * len(i_gap) + np.where(of_many, "merged", "single").tolist()
        yield pa.RecordBatch.from_arrays(
            [
                col("entity").take(pa.array(rows)),
                col("speaker").take(pa.array(rows)),
                pa.array(kinds, pa.string()),
                pa.array(np.r_[before[i_gap], b_start[i_per], z_start[z_keep]], pa.int64()),
                pa.array(np.r_[s[h][i_gap], before[i_per], z_end[z_keep]], pa.int64()),
            ],
            names=["entity", "speaker", "kind", "start_ms", "end_ms"],
        )


RUNS = "entity bigint, speaker string, shard bigint, starts array<bigint>, ends array<bigint>, multi array<boolean>"


def periods_and_gaps(
    df: DataFrame,
    entity: str = "clip_id",
    speaker: str = "speaker",
    start: str = "start",
    end: str = "end",
    shard_bits: int = SHARD_BITS,
    singles: bool = False,
) -> DataFrame:
    """Merged periods and gaps of every (entity, speaker).

    Returns (entity, speaker, kind, start_ms, end_ms), entity and speaker under their own names:
    ``merged`` is a period of two or more different intervals that overlap or touch, ``gap`` the
    stretch between two neighbouring periods of one speaker, and ``single``, only with ``singles``, a
    period of one interval.

    Defined cases: rows with a null key, start, end or speaker, with a time that isn't finite or
    doesn't fit a bigint, or whose end isn't after its start once rounded, are left out; repeated
    rows count once; an empty speaker name is a name like any other; an empty table gives no rows;
    other columns, whatever their names, are ignored.
    """
    ms = lambda c: F.round(F.col(c).cast("double") * 1000).try_cast("bigint")
    turns = (
        df.select(
            F.col(entity).cast("bigint").alias("entity"),
            F.col(speaker).cast("string").alias("speaker"),
            ms(start).alias("s"),
            ms(end).alias("e"),
        )
        .filter("entity is not null and speaker is not null and s is not null and e > s")
        .filter(F.col("s").between(-(2**61), 2**61) & F.col("e").between(-(2**61), 2**61))
        .withColumn("shard", F.shiftright("s", shard_bits))
    )
    runs = (
        turns.mapInArrow(_partial, RUNS)
        .repartition("entity", "speaker", "shard")
        .sortWithinPartitions("entity", "speaker", "shard")
        .mapInArrow(_united, RUNS)
    )
    w = Window.partitionBy("entity", "speaker").orderBy("shard")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        runs.select(
            "entity", "speaker", "shard",
            F.element_at("starts", 1).alias("first_s"), F.element_at("starts", -1).alias("last_s"),
            F.array_max("ends").alias("top"), F.element_at("multi", -1).alias("last_multi"),
        )
        .withColumn("carry", F.max("top").over(past))
        .withColumn("is_last", F.lead("shard").over(w).isNull())
        .withColumn("absorbs", F.coalesce(F.col("first_s") <= F.col("carry"), F.lit(False)))
        .withColumn("opens", F.coalesce(F.col("last_s") > F.col("carry"), F.lit(True)))
        .withColumn("n_abs", F.sum(F.col("absorbs").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("mark", F.when(F.col("opens"), F.struct(F.col("last_s").alias("s"), F.col("last_multi").alias("m"), F.col("n_abs").alias("n"))))
        .withColumn("open", F.last("mark", ignorenulls=True).over(past))
        .withColumn("n_before", F.lag("n_abs").over(w))
        .select(
            "entity", "speaker", "shard", "carry", "is_last",
            F.col("open.s").alias("p_start"),
            (F.col("open.m") | (F.col("n_before") > F.col("open.n"))).alias("p_multi"),
        )
    )
    out = runs.join(summary, ["entity", "speaker", "shard"]).mapInArrow(
        lambda it: _emit(it, singles), "entity bigint, speaker string, kind string, start_ms bigint, end_ms bigint"
    )
    return out.select(F.col("entity").alias(entity), F.col("speaker").alias(speaker), "kind", "start_ms", "end_ms")
