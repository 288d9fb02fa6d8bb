"""Filling fixed-capacity containers: cost-balanced packing.

A document of n tokens costs ``linear * n + quadratic * n**2`` (attention).  Documents are spread by a
hash over shards of about ``SEQUENCES`` containers; in a shard they are taken in descending size, and
each goes to the sequence of lowest cost that still has room for it.  A shard opens with three quarters
of the sequences that its tokens need at least, and with another one whenever nothing has room; with all
of them opened at once, middling documents would find every sequence half full.  What the
last sequences of a shard leave unused is spread over thousands of full ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

SEQUENCES = 2048
ITEMS = 65_536
RUN = 10_000  # copies of a document that are numbered at once
OPENED = 0.75
#: Relative cost of attention: at this many tokens its quadratic part equals the linear part.
EVEN_AT = 2048


def assign(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / EVEN_AT) -> np.ndarray:
    """Sequence number of every item; no size exceeds ``capacity``.  Ties go by position."""
    n = len(sizes)
    place = np.zeros(n, np.int64)
    if not n:
        return place
    order = np.argsort(-sizes, kind="stable")
    total = int(sizes.sum())
    k = max(1, int(OPENED * total / capacity))
    room = np.full(max(n, k), capacity, np.int64)
    cost = np.zeros(max(n, k))
    step = linear * sizes + quadratic * sizes.astype(float) ** 2
    # the sequences that have room for an item are kept apart from those that are full for all the rest
    live = np.arange(k)
    smallest = np.minimum.accumulate(sizes[order][::-1])[::-1]
    for pos, i in enumerate(order):
        size = sizes[i]
        fits = room[live] >= size
        if fits.any():
            at = live[np.argmin(np.where(fits, cost[live], np.inf))]
        else:
            at = k
            k += 1
            live = np.append(live, at)
        place[i] = at
        room[at] -= size
        cost[at] += step[i]
        if pos % 256 == 255 and pos + 1 < n:
            live = live[room[live] >= smallest[pos + 1]]
    return place


def pack(sizes: DataFrame, containers: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Assign every document to containers of each kind.

    ``sizes``: (key, tokens); ``containers``: (container_kind, capacity), a list of a few kinds (over
    1,000 raise an error, as they are held in the plan).  Returns (container_kind, capacity,
    container_id, key, part, first_token, tokens): the document's tokens from ``first_token`` on that
    lie in the container.  Only documents larger than the capacity are split, into full containers
    and a rest.

    Defined cases: documents of size 0 (empty or null texts) take part 0 of a container and no room;
    a null or negative size counts as 0; a null key is a key like any other; repeated documents are
    packed as often as they occur; the same rows give the same containers, however they are divided
    over files and tasks; kinds with a null capacity or one below 1 are left out; empty tables
    give no rows; other columns are ignored.
    """
    kinds = [
        (r["container_kind"], r["capacity"])
        for r in containers.select("container_kind", F.col("capacity").cast("long").alias("capacity"))
        .filter("capacity >= 1").distinct().orderBy("container_kind", "capacity").limit(1001).collect()
    ]
    if len(kinds) > 1000:
        raise ValueError("containers is a list of kinds; it has over 1,000")
    kind_type = containers.schema["container_kind"].dataType.simpleString()
    struct = f"array<struct<container_kind:{kind_type},capacity:bigint>>"
    listed = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds]).cast(struct)
    whole = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("whole")
    # number of parts: full containers and a rest; an empty document is one empty part
    parts = F.greatest(F.ceil(F.col("whole") / F.col("capacity")), F.lit(1)).cast("long")
    # copies of a document are numbered, so that nothing hangs on the order of the rows
    copies = materialize(sizes.select(F.col(key).alias("key"), whole).groupBy("key", "whole").agg(F.count("*").alias("copies")), "sizes").df
    most = copies.agg(F.max("copies")).first()[0] or 0
    runs = copies.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    if most > RUN:  # of a document that fills the table, many tasks number the copies
        runs = runs.repartition("key", "run")
    numbered = runs.select("key", "whole", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("copies")) - 1)).alias("copy"))
    held = (
        numbered.select("key", "whole", "copy", F.explode(listed).alias("k"))
        .select("key", "whole", "copy", "k.container_kind", "k.capacity")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        .withColumn("first_token", F.col("part") * F.col("capacity"))
        .withColumn("tokens", F.least(F.col("capacity"), F.col("whole") - F.col("first_token")))
        .drop("whole")
    )
    load = held.groupBy("container_kind", "capacity").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    shards = [
        F.struct(
            F.lit(r["container_kind"]).cast(kind_type).alias("container_kind"),
            F.lit(r["capacity"]).alias("capacity"),
            F.lit(max(1, math.ceil(r["t"] / r["capacity"] / SEQUENCES), math.ceil(r["n"] / ITEMS))).alias("n"),
        )
        for r in load
    ]
    n = F.lit(1)
    for s in shards:
        n = F.when(F.col("container_kind").eqNullSafe(s["container_kind"]) & (F.col("capacity") == s["capacity"]), s["n"]).otherwise(n)
    placed = held.withColumn("shard", F.pmod(F.xxhash64("key", "copy", "part"), n).cast("long"))
    types = dict(placed.dtypes)
    schema = f"container_kind {types['container_kind']}, capacity long, container_id long, key {types['key']}, part long, first_token long, tokens long"

    def fill(t: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(t, sort_keys=[("tokens", "descending"), ("key", "ascending"), ("copy", "ascending"), ("part", "ascending")])
        t = t.take(order)
        at = assign(t["tokens"].to_numpy(), t["capacity"][0].as_py())
        ids = pa.array((t["shard"].to_numpy() << 32) + at, pa.int64())
        cols = [t["container_kind"], t["capacity"], ids, t["key"], t["part"], t["first_token"], t["tokens"]]
        return pa.table(cols, names=["container_kind", "capacity", "container_id", "key", "part", "first_token", "tokens"])

    return placed.groupBy("container_kind", "capacity", "shard").applyInArrow(fill, schema).withColumnRenamed("key", key)
