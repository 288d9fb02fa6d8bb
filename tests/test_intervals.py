import random

import pytest
from pyspark.sql import functions as F

from dhwanika.operators import intervals
from dhwanika.operators.intervals import periods_and_gaps

SCHEMA = "clip_id long, speaker string, start double, end double"


def brute(data):
    """Periods and gaps by a walk over sorted intervals."""
    by = {}
    for c, p, s, e in data:
        if None in (c, p, s, e) or s != s or e != e or abs(s) > 1e15 or abs(e) > 1e15:
            continue
        s, e = round(s * 1000), round(e * 1000)
        if e > s:
            by.setdefault((c, p), set()).add((s, e))
    out = set()
    for k, own in by.items():
        periods = []
        for s, e in sorted(own):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
                periods[-1][2] += 1
            else:
                periods.append([s, e, 1])
        out |= {(*k, "merged", s, e) for s, e, n in periods if n > 1}
        out |= {(*k, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])}
    return out


@pytest.mark.parametrize("bits", [3, 8, 20])
def test_random_against_brute_force(spark, bits):
    rng = random.Random(bits)
    data = []
    for _ in range(1500):
        s = rng.randrange(-2000, 20_000) / 1000
        data.append((rng.randrange(4), rng.choice("ab"), s, s + rng.choice([0.001, 0.01, 0.05, 0.3, 2.0])))
    data += rng.sample(data, 200)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = periods_and_gaps(df, shard_bits=bits).collect()
    assert {tuple(r) for r in got} == brute(data) and len(got) == len(brute(data))


CASES = [
    (1, "a", 0.0, 1.0), (1, "a", 1.0, 2.0), (1, "a", 2.001, 3.0), (1, "a", 0.0, 1.0),  # touch, a gap of 1 ms, a repeat
    (2, "a", 0.0, 5.0), (2, "a", 1.0, 2.0), (2, "a", 10.0, 11.0), (2, "a", 10.0, 11.0),  # nested; a repeat alone merges nothing
    (3, None, 0.0, 1.0), (None, "a", 0.0, 1.0), (3, "a", None, 1.0), (3, "a", 1.0, None), (3, "a", 2.0, 2.0), (3, "a", 3.0, 1.0), (3, "a", 1.0, 1.0002),
    (4, "", 0.0, 1.0), (4, "", 0.0000000004, 1.0), (4, "", 5.0, 6.0),  # an empty name; noise below a microsecond
    (5, "a", 0.0, 1e9), (5, "a", 5.0, 6.0), (5, "a", 2e9, 3e9), (5, "a", float("nan"), 1.0), (5, "a", 0.0, float("inf")), (5, "a", -1e30, 1e30),
]


def test_defined_cases(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    wide = df.select("*", *[F.lit("x").alias(c) for c in ("entity", "shard", "s", "e", "starts", "ends", "multi", "kind", "carry")])
    got = {tuple(r) for r in periods_and_gaps(wide).collect()}
    assert got == brute(CASES)
    assert (5, "a", "merged", 0, 10**12) in got and (1, "a", "gap", 2000, 2001) in got


def test_hot_entity(spark):
    data = [(7, "a", i * 0.5, i * 0.5 + 0.6) for i in range(20_000)]
    got = periods_and_gaps(spark.createDataFrame(data, SCHEMA).repartition(8), shard_bits=10).collect()
    assert [tuple(r) for r in got] == [(7, "a", "merged", 0, 10_000_100)]


def test_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA)).count() == 0


def test_own_column_names(spark):
    df = spark.createDataFrame([("x", 1, 0.0, 1.0), ("x", 1, 0.5, 2.0)], "who string, room long, t0 double, t1 double")
    out = periods_and_gaps(df, entity="room", speaker="who", start="t0", end="t1")
    assert out.columns == ["room", "who", "kind", "start_ms", "end_ms"] and out.first()["end_ms"] == 2000


@pytest.mark.parametrize("waiting", [0, 3, 1 << 16])
def test_groups_that_cross_batches(monkeypatch, waiting):
    """Containers of two groups in batches of two: the same union however often the open group is united."""
    import pyarrow as pa

    monkeypatch.setattr(intervals, "RUNS_HELD", waiting)
    rows = [(1, "a", 0, [i * 10], [i * 10 + 12]) for i in range(5)] + [(1, "b", 0, [i * 10], [i * 10 + 5]) for i in range(6)] + [(2, "a", 3, [7], [9])]
    columns = [list(x) for x in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.list_(pa.int64())), pa.array([[False]] * len(rows), pa.list_(pa.bool_()))],
        names=["entity", "speaker", "shard", "starts", "ends", "multi"],
    )
    out = [r for size in (2, 5) for b in intervals._united(batch.slice(k, size) for k in range(0, len(rows), size)) for r in b.to_pylist()]
    want = [((1, "a", 0), [0], [52]), ((1, "b", 0), [i * 10 for i in range(6)], [i * 10 + 5 for i in range(6)]), ((2, "a", 3), [7], [9])]
    assert [((r["entity"], r["speaker"], r["shard"]), r["starts"], r["ends"]) for r in out] == want * 2
