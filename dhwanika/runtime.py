"""Session-level helpers: shared-folder materialisation and table access.

``materialize`` cuts lineage by writing a Parquet table below the folder named by
``spark.checkpoint.dir``.  Every executor can read that folder, so a lost executor costs only the
tasks that ran on it, and unlike ``checkpoint()`` the plan is evaluated once and stays columnar.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors.

    Reads ``spark.checkpoint.dir`` from the session.  Only where it is unset (tests, local mode) a
    folder of our own is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dhwanika-"))
        current = sc.getCheckpointDir()
    return current


class Materialized:
    """A written intermediate table; ``drop()`` removes it once it is superseded."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> Materialized:
    """Write ``df`` once to the shared folder and return a handle whose ``df`` reads it back.

    What is still there when the JVM ends is deleted then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/dhwanika/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    made = Materialized(spark, path, df.schema)
    for held in _scratch[-1:]:
        held.append(made)
    return made


_scratch: list[list[Materialized]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables that were materialised in the block when it ends.

    Results read them, so they have to be written or collected inside.  Blocks may be nested; each
    deletes its own.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for made in _scratch.pop():
            made.drop()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


WHITE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def strip(col):
    """Trim every white-space character at both ends, not only U+0020."""
    return F.regexp_replace(col, f"^{WHITE}+|{WHITE}+$", "")


def once_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per non-null ``key``: the one with the least ``order`` (nulls last), then least values.

    Rows without a key can't be told to be repeats of each other and are all kept.  A map-side
    combined aggregate, so a key delivered millions of times costs one row per map task.
    """
    value = F.struct(F.col(order).isNull().alias("_n"), F.col(order).alias("_o"), *[F.col(c) for c in columns])
    keyed = (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_k"))
        .agg(F.min(value).alias("_v"))
        .select(F.col("_k").alias(key), *[F.col("_v")[c].alias(c) for c in columns])
    )
    loose = df.filter(F.col(key).isNull()).select(key, *columns)
    return keyed.unionByName(loose)


HOT_SHARE, HOT_ROWS, SALTS = 200, 10_000, 64


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """Keys that hold over 1/200 of all rows (so at most 200 of them) and over 10,000 rows."""
    limit = max(total // HOT_SHARE, HOT_ROWS)
    return [r[key] for r in counts.filter(F.col(n) > limit).select(key).collect()]


def join_salted(rows: DataFrame, unique: DataFrame, key: str, spread: str, hot: list) -> DataFrame:
    """Inner equi-join of ``rows`` with a side that has one row per ``key``.

    Rows of the hot keys are divided over 64 parts by a hash of ``spread``, and the other side's row
    is repeated for each part, so no task gets all rows of a hot key.
    """
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    part = F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = unique.select("*", F.explode(parts).alias("_part"))
    return rows.withColumn("_part", part).join(right, [key, "_part"]).drop("_part")
