import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from dhwanika.llm.components import connected_components, group_terms, local_roots

SCHEMA = "row_no long, candidate string, anchor string, label string"


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_local_union_find_agrees_with_brute_force(edges):
    n = 31
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    rank = np.random.default_rng(1).permutation(n)
    root = local_roots(u, v, rank)
    want = brute([*edges, *((i, i) for i in range(n))])
    for i in range(n):
        for j in range(n):
            assert (root[i] == root[j]) == (want[i] == want[j])
        assert rank[root[i]] == min(rank[j] for j in range(n) if want[j] == want[i])


@pytest.mark.parametrize("cell", [7, 40, 10_000])
def test_chains_stars_and_cycles_over_many_cells(spark, cell):
    rng = random.Random(cell)
    edges = [(i, i + 1) for i in range(150)] + [(1000, 1001 + i) for i in range(120)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["id"]: r["root"] for r in connected_components(df, cell_edges=cell).collect()}
    want = brute(edges)
    assert set(got) == set(want)
    assert all(want[got[x]] == want[x] for x in got)
    assert len(set(got.values())) == len(set(want.values()))


def test_plan_does_not_grow_with_the_rounds(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(400)], "u long, v long")
    out = connected_components(df, cell_edges=8)  # 50 cells, several rounds
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") + plan.count("LogicalRDD") + plan.count("LocalRelation") < 6
    got = out.collect()
    assert len(got) == 401 and len({r["root"] for r in got}) == 1


def test_judged_pairs_on_a_grid_of_many_cells(spark, data):
    """The test tables' pairs over at least eight blocks a side, against union-find."""
    df = spark.read.parquet(f"{data}/pair_labels.parquet")
    one = {r["term"]: r["group_term"] for r in group_terms(df).collect()}
    linking = df.filter("upper(trim(label)) in ('SAME_WORD', 'SAME_MEANING')").count()
    many = {r["term"]: r["group_term"] for r in group_terms(df, cell_edges=max(1, linking // 80)).collect()}
    assert one == many and len(one) > 50


def test_labels_and_forms(spark, rows):
    data = [
        (1, "ख", "क", "SAME_WORD"), (2, "ख", "ग", " same-meaning "), (3, "ख", "घ", "DIFF_MEANING"), (4, "ख", "ख", "SAME WORD"),
        (5, "च", "च", "same_word"), (6, None, "क", "SAME_WORD"), (7, " ", "क", "SAME_WORD"), (8, "ट", "ठ", None), (9, "ｘ  y", "z", "SAME_WORD"),
        (10, "क", "ख", "SAME_WORD"), (11, "ख", "क", "UNRELATED"), (12, "ड", "ढ", "SAMEWORD"),
    ]
    got = rows(group_terms(spark.createDataFrame(data, SCHEMA)))
    want = {("क", "क"), ("ख", "क"), ("ग", "क"), ("च", "च"), ("x y", "x y"), ("z", "x y")}
    assert set(got) == want and len(got) == len(want)
    assert all(unicodedata.is_normalized("NFKC", t) for t, _ in got)


def test_empty_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], SCHEMA)
    assert group_terms(none).count() == 0
    one = spark.createDataFrame([(1, "a", "b", "SAME_WORD")], SCHEMA)
    wide = one.select("*", *[F.lit("x").alias(c) for c in ("u", "v", "root", "term", "id", "cell", "part", "n", "group_term")])
    assert group_terms(wide).count() == 2
