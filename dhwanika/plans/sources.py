"""Queries over the file sources: a table goes out as CSV or JSON to the shared folder and comes back by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correction as C
from ..runtime import shared_dir, table
from ..sources import readers as R
from .terms import COUNTS, WEIGHTS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _place(spark: SparkSession, name: str) -> str:
    """A folder below the shared one, deleted when the session ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/dhwanika/source-{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def _csv(df: DataFrame, name: str) -> str:
    path = _place(df.sparkSession, name)
    df.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8")
    return path


def read_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return R.read_lexicon(spark, _csv(table(spark, d, "lexicon").select("category", "word", "word_norm", "relevance_mode"), "lexicon"))


QUERIES["read_lexicon"] = read_lexicon
# a CSV file doesn't tell an empty field from a missing one; the reader gives null for both
SQL["read_lexicon"] = "SELECT nullif(word, '') AS word, nullif(word_norm, '') AS word_norm, nullif(relevance_mode, '') AS relevance_mode FROM lexicon"
QUERIES["read_weights"] = lambda spark, d: C.weights(read_lexicon(spark, d))
SQL["read_weights"] = f"WITH {WEIGHTS} SELECT token, weight FROM weights"


def read_pair_labels(spark: SparkSession, d: str) -> DataFrame:
    """One file in the order of ``row_no``, as labellers deliver it."""
    rows = table(spark, d, "pair_labels").orderBy("row_no").coalesce(1).select("candidate", "anchor", "label")
    return R.read_pair_labels(spark, _csv(rows, "pairs"))


QUERIES["read_pair_labels"] = read_pair_labels
SQL["read_pair_labels"] = "SELECT row_number() OVER (ORDER BY row_no) - 1 AS row_no, nullif(candidate, '') AS candidate, nullif(anchor, '') AS anchor, nullif(label, '') AS label FROM pair_labels"


def read_counts(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object, token to count."""
    counts = C.token_counts(table(spark, d, "bg_counts").select("batch_no", "token", "n").distinct())
    pairs = counts.select(F.concat(F.to_json(F.create_map("token", "n"))).alias("x"))
    whole = pairs.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.collect_list("x"), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), ","), F.lit("}")).alias("value"))
    path = _place(spark, "counts")
    whole.write.text(path)
    return R.read_counts(spark, path)


QUERIES["read_counts"] = read_counts
SQL["read_counts"] = f"WITH {COUNTS} SELECT token, n FROM counts"
