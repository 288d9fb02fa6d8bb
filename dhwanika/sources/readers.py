"""Sources: the lexicon and pair labels as CSV, the counts as one JSON object, tables as Parquet."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA_DIR_VARIABLE = "DHWANIKA_DATA_DIR"
DATA_DIR_CONF = "spark.dhwanika.dataDir"
LEXICON, PAIRS, COUNTS = "lexicon.csv", "pair_labels.csv", "bg_counts.json"


def data_dir(spark: SparkSession | None = None, home: str | None = None, lexicon: str = LEXICON) -> str:
    """Folder of the dictionary files.

    The session's ``spark.dhwanika.dataDir``, else the environment's DHWANIKA_DATA_DIR (neither is
    checked), else ``data`` beside ``home`` if the lexicon (by its file name) is there, else ``./data`` if it is there, else
    the former.
    """
    named = (spark.conf.get(DATA_DIR_CONF, None) if spark else None) or os.environ.get(DATA_DIR_VARIABLE)
    if named:
        return named
    beside = Path(home or Path(__file__).resolve().parents[2]) / "data"
    here = Path.cwd() / "data"
    return str(here if not (beside / lexicon).exists() and (here / lexicon).exists() else beside)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns by the header, all strings; quoted fields may hold line breaks.  No inference."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def _with(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as strings; those the file lacks are null."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in names])


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, word_norm, relevance_mode) of a lexicon file."""
    return _with(read_csv(spark, path), ["word", "word_norm", "relevance_mode"])


def read_pair_labels(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, candidate, anchor, label); rows keep the order of the file in ``row_no``.

    A multi-line file is read by one task, so the running identifiers follow its order.
    """
    rows = read_csv(spark, path).withColumn("row_no", F.monotonically_increasing_id())
    return rows.select("row_no", "candidate", "anchor", "label")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(token, n) of a file that holds one JSON object of counts; no rows where it is missing or unreadable."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "token string, n bigint")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("token", "n"))
