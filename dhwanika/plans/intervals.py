"""Queries over time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.intervals import periods_and_gaps
from ..runtime import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "segments"))


def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unbroken period, those of one interval too, and every gap."""
    return periods_and_gaps(table(spark, sf_dir, "segments"), singles=True)


P5_SQL = """
WITH t AS (
  SELECT DISTINCT clip_id, speaker, CAST(round("start" * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e
  FROM segments WHERE clip_id IS NOT NULL AND speaker IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL
), u AS (
  SELECT *, max(e) OVER (PARTITION BY clip_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM t WHERE e > s
), v AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
    OVER (PARTITION BY clip_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM u
), p AS (
  SELECT clip_id, speaker, k, min(s) AS s, max(e) AS e, count(*) AS n FROM v GROUP BY clip_id, speaker, k
), q AS (
  SELECT *, lag(e) OVER (PARTITION BY clip_id, speaker ORDER BY k) AS before FROM p
)
SELECT clip_id, speaker, 'merged' AS kind, s AS start_ms, e AS end_ms FROM q WHERE n > 1
UNION ALL
SELECT clip_id, speaker, 'gap' AS kind, before AS start_ms, s AS end_ms FROM q WHERE before IS NOT NULL
"""

QUERIES = {"p5_found": p5_found, "p5_periods": p5_periods}
SQL = {"p5_found": P5_SQL, "p5_periods": P5_SQL.replace("'merged' AS kind", "CASE WHEN n > 1 THEN 'merged' ELSE 'single' END AS kind").replace(" FROM q WHERE n > 1", " FROM q")}
