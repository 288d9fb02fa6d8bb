"""Consolidating pairwise matches into groups: connected components on a two-dimensional grid.

Vertices are hashed into G blocks and every edge goes to the cell of its block pair, so a cell holds
the edges between two blocks.  A round

1. runs a local union-find on every cell and keeps its spanning stars (vertex, local representative),
2. exchanges representatives: a vertex gathers those it has in the cells of its row and of its
   column, and takes the best as its parent,
3. replaces every edge by the edge between the parents of its ends and drops loops.

Rounds repeat until no edge is left, that is until every parent is stable.  Representatives are
chosen by a priority drawn anew each round, so a long chain shrinks by a constant factor a round
whatever its identifiers are.  G follows the number of edges left, so a cell stays near
``cell_edges``; cells that are larger because of a hot vertex are cut into further cells by a hash of
the edge (any division of the edges is right, since vertices meet again in the exchange).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Materialized, hot_keys, join_salted, materialize, strip

CELL_EDGES = 50_000


def local_roots(u: np.ndarray, v: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Union-find over edges (u, v) of vertices 0..n-1, vectorised: hooking and path halving.

    Returns for each vertex the member of its component with the least ``rank`` (ranks are unique).
    """
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    parent = np.arange(n)  # in terms of places: the best of a component is its least place
    a, b = place[u], place[v]
    while len(a):
        ra, rb = parent[a], parent[b]
        hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
        live = hi != lo
        a, b, hi, lo = a[live], b[live], hi[live], lo[live]
        if not len(a):
            break
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return order[parent[place]]


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit bijection (finaliser of splitmix64), so priorities of different ids differ."""
    mask = (1 << 64) - 1
    x = x.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & mask)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stars(seed: int):
    def solve(t: pa.Table) -> pa.Table:
        ids, inverse = np.unique(np.r_[t["u"].to_numpy(), t["v"].to_numpy()], return_inverse=True)
        n = t.num_rows
        priority = _mix(ids, seed)
        root = local_roots(inverse[:n], inverse[n:], priority)
        off = np.flatnonzero(root != np.arange(len(ids)))
        signed = lambda x: (x ^ np.uint64(1 << 63)).view(np.int64)  # noqa: E731 - keeps the order
        return pa.table(
            {
                "v": pa.array(ids[off]),
                "root": pa.array(ids[root[off]]),
                "priority": pa.array(signed(priority[root[off]])),
            }
        )

    return solve


def _cells(edges: DataFrame, count: int, cell_edges: int) -> DataFrame:
    """Edges with their cell: block pair, and a part of it where the cell is overfull."""
    g = max(1, math.ceil(math.sqrt(count / cell_edges)))
    block = lambda c: F.pmod(F.xxhash64(F.lit(17), c), F.lit(g))
    placed = edges.withColumn("cell", (block("u") * g + block("v")).cast("long"))
    # g*g rows, about count / cell_edges: the number of tasks, not of vertices or edges
    full = {r["cell"]: math.ceil(r["n"] / cell_edges) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * cell_edges).collect()} if g > 1 else {}
    if full:
        parts = F.create_map(*[F.lit(x) for k, n in full.items() for x in (int(k), int(n))])
        placed = placed.withColumn("part", F.pmod(F.xxhash64("u", "v"), F.coalesce(parts[F.col("cell")], F.lit(1)).cast("long")))
    else:
        placed = placed.withColumn("part", F.lit(0).cast("long"))
    return placed


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", cell_edges: int = CELL_EDGES, vertices: DataFrame | None = None) -> DataFrame:
    """Root of every vertex that occurs in ``edges`` (bigint columns ``u`` and ``v``).

    A caller that has the vertices apart, distinct, passes them (with the column ``id``) together with
    edges that hold no pair twice in either direction; then neither is made distinct again.

    Returns (id, root): vertices have equal roots exactly if a chain of edges joins them; the root is
    one of the group's vertices.  Defined cases: edges with a null end are left out; a loop makes its
    vertex a group of its own; repeated and reversed edges count once; no edges give no rows; other
    columns are ignored.
    """
    pairs = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).dropna()
    ordered = pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if vertices is None:
        vertices = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        ordered = ordered.distinct()
    live = materialize(ordered, "edges")
    levels: list[Materialized] = []
    seed = 0
    while True:
        count = live.df.count()
        if not count:
            live.drop()
            break
        seed += 1
        cells = _cells(live.df, count, cell_edges)
        n_cells = max(1, math.ceil(count / cell_edges))
        stars = (
            cells.repartition(n_cells, "cell", "part")
            .groupBy("cell", "part")
            .applyInArrow(_stars(seed), "v long, root long, priority long")
        )
        # a vertex has at most one representative per cell of its row and column
        w = Window.partitionBy("v").orderBy("priority", "root")
        best = stars.withColumn("parent", F.first("root").over(w)).withColumn("nth", F.row_number().over(w))
        gathered = materialize(best.select("v", "root", "parent", "nth"), "stars")
        parents = materialize(gathered.df.filter("nth = 1").select("v", "parent"), "parents")
        # the edge (v, root) becomes (parent of v, parent of root); most pairs are equal and fall away here
        rest = gathered.df.select("parent", "root").distinct()
        up = parents.df.select(F.col("v").alias("root"), F.col("parent").alias("above"))
        new = (
            rest.join(up, "root", "left")
            .select(F.col("parent").alias("a"), F.coalesce("above", "root").alias("x"))
            .filter("a <> x")
            .select(F.least("a", "x").alias("u"), F.greatest("a", "x").alias("v"))
            .distinct()
        )
        nxt = materialize(new, "edges")
        gathered.drop()
        live.drop()
        live = nxt
        levels.append(parents)
    # From the last round back: a vertex takes the label that the later rounds give its parent; parents
    # that no later round saw had no edge left and stand for their group.  Every round's labels are
    # written, so a plan reads two tables whatever the number of rounds; both shrink geometrically.
    label: Materialized | None = None
    while levels:
        level = levels.pop()
        here = level.df.select(F.col("v").alias("id"), F.col("parent").alias("root"))
        if label is not None:
            above = label.df.select(F.col("id").alias("root"), F.col("root").alias("top"))
            lower = here.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
            here = lower.unionByName(label.df.join(here.select("id"), "id", "left_anti"))
        if label is None and not levels:
            label = level  # a single round's parents are the labels
            break
        made = materialize(here, "labels")
        level.drop()
        if label is not None:
            label.drop()
        label = made
    if label is None:
        return vertices.withColumn("root", F.col("id"))
    found = label.df.toDF("id", "_r")
    return vertices.join(found, "id", "left").withColumn("root", F.coalesce("_r", "id")).drop("_r")


#: Judgements that make two terms the same form; fixed values of the data model.
SAME = ("SAME_WORD", "SAME_MEANING")


def _vertex_ids(terms: DataFrame) -> int:
    """A hash seed under which no two of the terms get the same 64-bit id (checked on all terms)."""
    for seed in range(20):
        clash = terms.groupBy(F.xxhash64(F.lit(seed), "term").alias("id")).count().filter("count > 1")
        if clash.isEmpty():
            return seed
    raise ValueError("too many distinct terms for 64-bit identifiers")


def group_terms(
    df: DataFrame,
    candidate: str = "candidate",
    anchor: str = "anchor",
    label: str = "label",
    same: tuple[str, ...] = SAME,
    cell_edges: int = CELL_EDGES,
) -> DataFrame:
    """Group of every term that a linking row holds.

    Returns (term, group_term): terms in NFKC with white space collapsed and trimmed; ``group_term``
    is the least term of the group by code points (UTF-8 order is code-point order).

    A row links its two terms if both are non-blank and its label reads one of ``same``, regardless of
    case, outer blanks, and a blank or hyphen for the underscore.  Defined cases: rows with a null
    label or side link nothing; contradicting rows break nothing; a term linked only to itself is a
    group of one; repeats and reversals count once; an empty table gives no rows; other columns are
    ignored.
    """
    from .texts import map_strings, squeeze

    reads = F.translate(F.upper(strip(F.col(label))), " -", "__")
    pairs = (
        df.filter(reads.isin(*same))
        .select(F.col(candidate).cast("string").alias("a"), F.col(anchor).cast("string").alias("b"))
        .dropna()
        .mapInArrow(lambda it: map_strings(it, ["a", "b"], squeeze), "a string, b string")
        .filter("a <> '' and b <> ''")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    held = materialize(pairs, "pairs")
    terms = materialize(held.df.select(F.explode(F.array("a", "b")).alias("term")).distinct(), "terms")
    seed = _vertex_ids(terms.df)
    vertex = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    roots = connected_components(
        held.df.select(vertex("a").alias("u"), vertex("b").alias("v")), cell_edges=cell_edges, vertices=terms.df.withColumn("id", vertex("term"))
    )
    placed = materialize(roots.select("term", "root"), "placed")
    least = placed.df.groupBy("root").agg(F.min("term").alias("group_term"), F.count("*").alias("n"))
    hot = hot_keys(least, "root", "n", placed.df.count())
    return join_salted(placed.df, least.drop("n"), "root", "term", hot).select("term", "group_term")
