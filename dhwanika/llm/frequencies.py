"""Frequency of every distinct term: global dictionary, block encoding, count arrays by id range.

1. Every block (a task's texts, up to ``BLOCK`` distinct terms) is encoded with a dictionary of its own
   and counted into arrays: occurrences and record presence per local code.  A term held by every
   record costs one row a block.  Where a record's rows may lie in many blocks, a block counts pairs
   of record and term instead.
2. The distinct terms of all sources, sorted, are the global dictionary: a term's integer id is its rank,
   whatever the partitions, so the ids depend on the terms alone.
3. The blocks' terms are encoded with the global ids; pairs of record and id become presence there, as
   integers.  Counts are accumulated into arrays per range of ids, and the arrays of a range are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, once_per_key, shuffle_partitions, strip, table
from .texts import nfkc, usable

#: Characters stripped from both ends of a term; fixed values of the problem statement.
EDGE = ",.?!;:\"'()।|"
BLOCK = 1 << 18  # distinct terms at which a block ends
RANGE = 4096  # ids of an array
PAIRS = "src string, record string, term string, occ long, rec long"
ARRAYS = "src string, place long, at array<int>, occ array<long>, rec array<long>"


def terms_of(text: str) -> list[str]:
    """NFKC, lower case, split at white space, punctuation stripped from both ends."""
    return [t for t in (w.strip(EDGE) for w in nfkc(text).lower().split()) if t]


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(src, record, text, n) rows to the block's counts: n a hit, presence one a row without a record."""
        code: dict[tuple, int] = {}
        occ = rec = np.zeros(0, np.int64)

        def flush():
            columns = list(zip(*code))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(occ), pa.array(rec)], names=["src", "record", "term", "occ", "rec"])

        for b in batches:
            hits: list[int] = []
            held: list[int] = []
            weight: list[int] = []
            for s, r, text, n in zip(*(b[c].to_pylist() for c in ("src", "record", "text", "n"))):
                own = [code.setdefault((s, r, t), len(code)) for t in terms_of(text)]
                hits += own
                weight += [n] * len(own)
                if r is None:
                    held += set(own)
            occ, rec = (np.r_[x, np.zeros(len(code) - len(x), np.int64)] for x in (occ, rec))
            np.add.at(occ, np.array(hits, np.int64), np.array(weight, np.int64))
            np.add.at(rec, np.array(held, np.int64), 1)
            if len(code) >= limit:
                yield flush()
                code.clear()
                occ = rec = np.zeros(0, np.int64)
        if code:
            yield flush()

    return run


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, term_id): every distinct ``term`` with its rank by code points, from 0 without gaps.

    Sorted over all partitions and numbered within each; the numbers before a partition are summed over
    one row a partition.
    """
    placed = terms.select("term").distinct().orderBy("term").withColumn("m", F.monotonically_increasing_id())
    held = materialize(placed, "dictionary").df.select("term", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("nth"))
    sizes = held.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most as many rows as the session's number of shuffle partitions
    offset = sizes.select("part", before.alias("before"))
    return held.join(F.broadcast(offset), "part").select("term", (F.col("before") + F.col("nth")).alias("term_id"))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded counts (src, term_id, occ, rec) to count arrays by range of ids."""
    for b in batches:
        if not b.num_rows:
            continue
        src = b["src"].dictionary_encode()
        names, own = src.dictionary.to_pylist(), src.indices.to_numpy()
        ids, occ, rec = (b[c].to_numpy() for c in ("term_id", "occ", "rec"))
        order = np.lexsort((ids, own))
        own, ids, occ, rec = own[order], ids[order], occ[order], rec[order]
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (ids[1:] != ids[:-1])])
        own, ids, occ, rec = own[first], ids[first], np.add.reduceat(occ, first), np.add.reduceat(rec, first)
        place = ids // RANGE
        cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (place[1:] != place[:-1])])
        lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.r_[cut, len(ids)], pa.int32()), pa.array(x, t))
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in own[cut]], pa.string()), pa.array(place[cut]), lists(ids % RANGE, pa.int32()), lists(occ, pa.int64()), lists(rec, pa.int64())],
            names=["src", "place", "at", "occ", "rec"],
        )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays sorted by range, each range's terms first, to the range's sums: (src, term_id, term, occ, rec)."""
    place, terms, sums = None, np.empty(RANGE, object), {}

    def flush():
        for s, (occ, rec) in sums.items():
            at = np.flatnonzero(occ | rec)
            cols = [pa.array([s] * len(at), pa.string()), pa.array(place * RANGE + at), pa.array(terms[at].tolist(), pa.string()), pa.array(occ[at]), pa.array(rec[at])]
            yield pa.RecordBatch.from_arrays(cols, names=["src", "term_id", "term", "occurrences", "records"])

    for b in batches:
        if not b.num_rows:
            continue
        places, named = b["place"].to_numpy(), b["src"].is_null().to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (named[1:] != named[:-1])])
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows]):
            if places[lo] != place:
                yield from flush()
                place, terms, sums = int(places[lo]), np.empty(RANGE, object), {}
            part = b.slice(lo, hi - lo)
            if named[lo]:  # a row a term
                terms[part["at"].flatten().to_numpy()] = np.array(part["term"].to_pylist(), object)
                continue
            for k, s in enumerate(part["src"].to_pylist()):
                if s not in sums:
                    sums[s] = (np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64))
                at = part["at"][k].values.to_numpy()
                for total, c in zip(sums[s], ("occ", "rec")):
                    total[at] += part[c][k].values.to_numpy()
    yield from flush()


def counts_of(sources: dict[str, tuple], block: int = BLOCK) -> DataFrame:
    """Totals and presence of every distinct term of several sources, with one dictionary for all.

    ``sources``: name to (df, text) or (df, text, record, n), as in ``term_counts``.  Returns (src,
    term_id, term, occurrences, records).
    """
    parts = []
    for name, (df, text, *rest) in sources.items():
        record, n = [*rest, None, None][:2]
        rows = df.select(
            F.lit(name).alias("src"),
            (F.col(record) if record else F.lit("")).cast("string").alias("record"),
            F.col(text).cast("string").alias("text"),
            (F.col(n) if n else F.lit(1)).cast("long").alias("n"),
        ).dropna()
        if record:  # rows of one text are added before they are read
            rows = rows.groupBy("src", "record", "text").agg(F.sum("n").alias("n"))
        else:
            rows = rows.withColumn("record", F.lit(None).cast("string"))
        parts.append((record is not None, materialize(rows.mapInArrow(_blocks(block), PAIRS), "term-blocks").df))
    every = parts[0][1]
    for _, p in parts[1:]:
        every = every.unionByName(p)
    known = materialize(dictionary(every), "terms").df
    encoded = []
    for recorded, p in parts:
        e = p.join(known, "term").select("src", "record", "term_id", "occ", "rec")
        if recorded:  # a pair counts once, in however many blocks it lies
            e = e.groupBy("src", "record", "term_id").agg(F.sum("occ").alias("occ")).withColumn("rec", F.lit(1).cast("long"))
        encoded.append(e.select("src", "term_id", "occ", "rec"))
    counted = encoded[0]
    for e in encoded[1:]:
        counted = counted.unionByName(e)
    arrays = counted.mapInArrow(_arrays, ARRAYS).withColumn("term", F.lit(None).cast("string"))
    none = F.lit(None).cast("array<long>")
    named = known.select(
        F.lit(None).cast("string").alias("src"), F.floor(F.col("term_id") / RANGE).alias("place"),
        F.array((F.col("term_id") % RANGE).cast("int")).alias("at"), none.alias("occ"), none.alias("rec"), "term",
    )
    met = arrays.unionByName(named).repartition(max(1, shuffle_partitions(every.sparkSession)), "place")
    return met.sortWithinPartitions("place", F.col("src").asc_nulls_first()).mapInArrow(_sums, "src string, term_id long, term string, occurrences long, records long")


def term_counts(df: DataFrame, text: str, record: str | None = None, n: str | None = None, block: int = BLOCK) -> DataFrame:
    """Totals and presence of every distinct term of ``df[text]``.

    Returns (term_id, term, occurrences, records).  Each row is a record of its own, or belongs to
    the record ``df[record]``; a hit counts ``df[n]`` times, once by default.  term_id are the
    integers from 0 without gaps, in the order of the terms' code points.

    Defined cases: rows with null text, null ``n`` or null ``record`` (where one is named) are left
    out; a text without terms counts nothing; an empty table gives no rows; repeated rows are
    repeated evidence (make rows distinct first where they aren't); other columns are ignored.
    """
    return counts_of({"": (df, text, record, n)}, block).drop("src")


def mark_terms(counts: DataFrame, measure: str, rare: int, common_share: float, whole: DataFrame) -> DataFrame:
    """Add ``mark``: ``rare`` at most ``rare``, ``common`` at least ``common_share`` of ``whole``.

    ``whole`` is a DataFrame of one row and one column (a scalar subquery).  A term that is both (only in tiny
    inputs) is rare and common at once and gets a row for either.
    """
    least = F.lit(common_share) * whole.scalar()
    marks = F.array_compact(
        F.array(F.when(F.col(measure) <= rare, F.lit("rare")), F.when(F.col(measure) >= least, F.lit("common")))
    )
    return counts.withColumn("mark", F.explode(marks))


def hyp_records(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "aligned")
    return once_per_key(rows, "utt_id", "received_at", ["hyp"]).filter(usable("hyp"))


def bg_rows(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "bg_counts").select("batch_no", "token", "n").distinct()
    return rows.filter((strip(F.col("token")) != "") & (F.col("n") >= 1))
