from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dhwanika.llm import packing


@given(st.lists(st.integers(0, 50), max_size=80))
def test_assignment_fits(sizes):
    x = np.array(sizes, np.int64)
    place = packing.assign(x, 50)
    load = np.bincount(place, x) if len(x) else np.zeros(1)
    assert len(place) == len(x) and load.max(initial=0) <= 50


def best_fit(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= s
        else:
            room.append(capacity - s)
    return len(room)


def test_few_containers_and_even_cost():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 400, 3000)
    place = packing.assign(sizes, 512)
    assert place.max() + 1 <= 1.01 * best_fit(sizes.tolist(), 512)
    cost = np.bincount(place, sizes + sizes.astype(float) ** 2 / packing.EVEN_AT)
    assert cost.std() < 0.2 * cost.mean()


KINDS = [("s", 10), ("m", 25), ("none", None), ("zero", 0)]


@pytest.mark.parametrize("sequences", [2, 2048])
def test_every_token_once(spark, monkeypatch, sequences):
    monkeypatch.setattr(packing, "SEQUENCES", sequences)
    sizes = [(1, 0), (2, 7), (3, 10), (4, 11), (5, 96), (6, None), (None, 3), (7, 7), (7, 7)] + [(100 + i, i % 9) for i in range(60)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long").withColumn("part", F.lit("x")).withColumn("capacity", F.lit(1)).withColumn("n", F.lit(1))
    out = packing.pack(df, spark.createDataFrame(KINDS, "container_kind string, capacity int")).collect()
    assert {r["container_kind"] for r in out} == {"s", "m"}
    for kind, capacity in KINDS[:2]:
        own = [r for r in out if r["container_kind"] == kind]
        load, tokens = Counter(), Counter()
        for r in own:
            load[r["container_id"]] += r["tokens"]
            tokens[r["doc_id"]] += r["tokens"]
            assert r["first_token"] == r["part"] * capacity
        assert max(load.values()) <= capacity
        want = Counter()
        for k, n in sizes:
            want[k] += n or 0
        assert tokens == want and set(tokens) == {k for k, _ in sizes}
        split = {r["doc_id"] for r in own if r["part"] > 0}
        assert split == {k for k, n in sizes if (n or 0) > capacity}


def test_same_containers_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "SEQUENCES", 8)
    monkeypatch.setattr(packing, "RUN", 7)
    kinds = spark.createDataFrame(KINDS, "container_kind string, capacity int")
    df = spark.createDataFrame([(i % 90, 1 + (i % 90) * 5 % 11) for i in range(120)] + [(1000, 4)] * 60, "doc_id long, tokens long")
    a, b = (Counter(map(tuple, packing.pack(df.repartition(k), kinds).collect())) for k in (1, 5))
    assert a == b and sum(a.values()) >= 2 * 180


def test_empty(spark):
    kinds = spark.createDataFrame(KINDS, "container_kind string, capacity int")
    sizes = spark.createDataFrame([(1, 5)], "doc_id long, tokens long")
    assert packing.pack(sizes.filter("false"), kinds).count() == 0
    assert packing.pack(sizes, kinds.filter("false")).count() == 0
