"""Queries of the scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalization import language
from ..operators import correction as C
from ..operators import scoring
from ..runtime import table
from . import sqltext as S
from .terms import WEIGHTS

QUERIES: dict = {}
SQL: dict[str, str] = {}

QUERIES["weight_of"] = lambda spark, d: scoring.weight_of(table(spark, d, "bg_counts").select("token").distinct(), "token", C.weights(table(spark, d, "lexicon")))
SQL["weight_of"] = f"WITH {WEIGHTS} SELECT b.token, coalesce(w.weight, 1) AS weight FROM (SELECT DISTINCT token FROM bg_counts) b LEFT JOIN weights w ON w.token = b.token"

WORDS = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _count_dp(r: str, h: str) -> str:
    """Least number of word edits between two lists by nested folds over places."""
    places = lambda x: f"list_transform(range(1, len({x}) + 1), lambda i: [CAST(i AS BIGINT)])"
    cell = f"least(a[k[1] + 1] + 1, cur[len(cur)] + 1, a[k[1]] + CASE WHEN {r}[p[1]] = {h}[k[1]] THEN 0 ELSE 1 END)"
    row = f"list_reduce({places(h)}, lambda cur, k: list_append(cur, {cell}), [a[1] + 1])"
    return f"list_last(list_reduce({places(r)}, lambda a, p: {row}, list_transform(range(0, len({h}) + 1), lambda i: CAST(i AS BIGINT))))"


def _pairs(r: str, h: str, group: str = "") -> str:
    by = f"{group}, " if group else ""
    return f"SELECT {by}rn, hn, count(*) AS times FROM (SELECT {by}{r} AS rn, {h} AS hn FROM aligned) WHERE rn IS NOT NULL AND hn IS NOT NULL AND rn <> 'NA' GROUP BY {by}rn, hn"


def _wer_sql(r: str, h: str, column: str = "", group: str = "") -> str:
    by = f"{group}, " if group else ""
    source = _pairs(r, h, group).replace("FROM aligned", f"FROM (SELECT *, {column} AS {group} FROM aligned)") if group else _pairs(r, h)
    return f"""WITH pairs AS ({source}), counted AS (
      SELECT {by}times, len(r) AS n, CASE WHEN rn = hn THEN 0 ELSE {_count_dp('r', 'h')} END AS e
      FROM (SELECT *, {WORDS('rn')} AS r, {WORDS('hn')} AS h FROM pairs WHERE hn <> 'NA'))
    SELECT {by}CAST(coalesce(sum(e * times), 0) AS BIGINT) AS edits, CAST(coalesce(sum(n * times), 0) AS BIGINT) AS words,
      CAST(coalesce(sum(times), 0) AS BIGINT) AS pairs,
      round(coalesce(sum(e * times) / nullif(sum(n * times), 0), CAST('nan' AS DOUBLE)), 6) AS wer
    FROM counted""" + (f" GROUP BY {group}" if group else "")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("wer", F.round("wer", 6))


QUERIES["corpus_wer"] = lambda spark, d: _rounded(scoring.corpus_wer(table(spark, d, "aligned")))
SQL["corpus_wer"] = _wer_sql(S.normalized("ref", "hi"), S.normalized("hyp", "hi"))
QUERIES["corpus_wer_by_lang"] = lambda spark, d: _rounded(scoring.corpus_wer_by_lang(table(spark, d, "aligned")))
SQL["corpus_wer_by_lang"] = _wer_sql(S.dispatched("ref", "lang"), S.dispatched("hyp", "lang"))


def wer_per_language(spark: SparkSession, d: str) -> DataFrame:
    """A rate for each normaliser."""
    rows = table(spark, d, "aligned").withColumn("code", language(F.col("lang")))
    return _rounded(scoring.corpus_wer_by_lang(rows, by=("code",)))


QUERIES["wer_per_language"] = wer_per_language
SQL["wer_per_language"] = _wer_sql(S.dispatched("ref", "lang"), S.dispatched("hyp", "lang"), S.language("lang"), "code")


def awwer(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.weighted_wer(table(spark, d, "aligned"), C.weights(table(spark, d, "lexicon")))
    return out.withColumn("awwer", F.round("awwer", 4)).withColumn("wer", F.round("wer", 4))


def _weighted_dp(r: str, h: str, wr: str, wh: str) -> str:
    """[edits, weight] of the preferred alignment; rows are lists of such pairs."""
    places = lambda x: f"list_transform(range(1, len({x}) + 1), lambda i: [[CAST(i AS DOUBLE)]])"
    i, j = "CAST(p[1][1] AS BIGINT)", "CAST(k[1][1] AS BIGINT)"
    up, left, diagonal = f"a[{j} + 1]", "cur[len(cur)]", f"a[{j}]"
    differs = f"CASE WHEN {r}[{i}] = {h}[{j}] THEN 0 ELSE 1 END"
    e = f"least({up}[1] + 1, {left}[1] + 1, {diagonal}[1] + {differs})"
    cell = f"[{e}, CASE WHEN {up}[1] + 1 = {e} THEN {up}[2] + {wr}[{i}] WHEN {left}[1] + 1 = {diagonal}[1] THEN {left}[2] + {wh}[{j}] ELSE {diagonal}[2] + {differs} * {wr}[{i}] END]"
    row = f"list_reduce({places(h)}, lambda cur, k: list_append(cur, {cell}), [[a[1][1] + 1, a[1][2] + {wr}[{i}]]])"
    start = f"list_transform(range(0, len({h}) + 1), lambda n: [CAST(n AS DOUBLE), CAST(coalesce(list_sum({wh}[1:n]), 0) AS DOUBLE)])"
    return f"list_last(list_reduce({places(r)}, lambda a, p: {row}, {start}))"


HYP = S.dispatched("hyp", "lang")
TRIMMED = f"""split_up AS (SELECT *, {WORDS('rn')} AS r0, {WORDS('hn')} AS h0 FROM pairs),
headed AS (
  SELECT *, coalesce(list_position(list_transform(range(1, least(len(r0), len(h0)) + 1), lambda i: r0[i] = h0[i]), false) - 1, least(len(r0), len(h0))) AS head FROM split_up
), tailed AS (
  SELECT *, least(coalesce(list_position(list_transform(range(1, least(len(r0), len(h0)) - head + 1), lambda i: r0[len(r0) - i + 1] = h0[len(h0) - i + 1]), false) - 1, least(len(r0), len(h0)) - head), least(len(r0), len(h0)) - head) AS tail FROM headed
)"""
BAD = f"hyp IS NULL OR regexp_replace(hyp, '^{S.BLANKS}+|{S.BLANKS}+$', '', 'g') = '' OR starts_with(hyp, '__ERROR__')"
QUERIES["awwer"] = awwer
SQL["awwer"] = f"""WITH {WEIGHTS}, pairs AS ({_pairs(S.dispatched('ref', 'lang'), f"CASE WHEN {BAD} OR {HYP} = 'NA' THEN '' ELSE {HYP} END")}),
listed AS (SELECT map(list(token), list(CAST(weight AS DOUBLE))) AS m FROM weights),
{TRIMMED}, weighed AS (
  SELECT times, rn = hn AS same, r0, r0[head + 1:len(r0) - tail] AS r, h0[head + 1:len(h0) - tail] AS h, m FROM tailed, listed
), valued AS (
  SELECT *, list_transform(r0, lambda t: coalesce(m[t], 1.0)) AS w0, list_transform(r, lambda t: coalesce(m[t], 1.0)) AS wr, list_transform(h, lambda t: coalesce(m[t], 1.0)) AS wh FROM weighed
), scored AS (
  SELECT times, list_sum(w0) AS den, len(r0) AS n, CASE WHEN same THEN [0.0, 0.0] ELSE {_weighted_dp('r', 'h', 'wr', 'wh')} END AS x FROM valued
), sums AS (
  SELECT CAST(coalesce(sum(x[2] * times), 0) AS DOUBLE) AS num, CAST(coalesce(sum(den * times), 0) AS DOUBLE) AS den,
    CAST(coalesce(sum(x[1] * times), 0) AS BIGINT) AS edits, CAST(coalesce(sum(n * times), 0) AS BIGINT) AS words FROM scored
) SELECT *, round(num / greatest(den, 1), 4) AS awwer, round(edits / greatest(words, 1), 4) AS wer FROM sums"""


def alignment_ops(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the alignment of every distinct normalised pair."""
    pairs = scoring.scored_pairs(table(spark, d, "aligned")).select("rn", "hn", F.struct("rn", "hn").alias("pair"))
    return scoring.aligned_chunks(pairs, "pair", "rn", "hn").select(F.col("pair.rn").alias("rn"), F.col("pair.hn").alias("hn"), "nth", "type", "ref_start", "ref_end", "hyp_start", "hyp_end")


def _ops_dp(r: str, h: str) -> str:
    """Operations of the preferred alignment as letters; rows are lists of [edits, letters]."""
    places = lambda x: f"list_transform(range(1, len({x}) + 1), lambda i: [[CAST(i AS VARCHAR)]])"
    i, j = "CAST(p[1][1] AS BIGINT)", "CAST(k[1][1] AS BIGINT)"
    up, left, diagonal = f"a[{j} + 1]", "cur[len(cur)]", f"a[{j}]"
    n = lambda c: f"CAST({c}[1] AS BIGINT)"
    same = f"{r}[{i}] = {h}[{j}]"
    e = f"least({n(up)} + 1, {n(left)} + 1, {n(diagonal)} + CASE WHEN {same} THEN 0 ELSE 1 END)"
    cell = f"[CAST({e} AS VARCHAR), CASE WHEN {n(up)} + 1 = {e} THEN {up}[2] || 'D' WHEN {n(left)} + 1 = {n(diagonal)} THEN {left}[2] || 'I' ELSE {diagonal}[2] || CASE WHEN {same} THEN 'E' ELSE 'S' END END]"
    row = f"list_reduce({places(h)}, lambda cur, k: list_append(cur, {cell}), [[CAST(CAST(a[1][1] AS BIGINT) + 1 AS VARCHAR), a[1][2] || 'D']])"
    start = f"list_transform(range(0, len({h}) + 1), lambda n: [CAST(n AS VARCHAR), repeat('I', n)])"
    return f"list_last(list_reduce({places(r)}, lambda a, p: {row}, {start}))[2]"


QUERIES["alignment_ops"] = alignment_ops
SQL["alignment_ops"] = f"""WITH pairs AS ({_pairs(S.dispatched('ref', 'lang'), f"CASE WHEN {BAD} OR {HYP} = 'NA' THEN '' ELSE {HYP} END")}),
{TRIMMED}, traced AS (
  SELECT rn, hn, repeat('E', head) || {_ops_dp('r', 'h')} || repeat('E', tail) AS ops
  FROM (SELECT *, r0[head + 1:len(r0) - tail] AS r, h0[head + 1:len(h0) - tail] AS h FROM tailed)
), runs AS (SELECT *, regexp_extract_all(ops, 'E+|S+|D+|I+') AS x FROM traced),
placed AS (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM runs), spans AS (
  SELECT *, CAST(coalesce(list_sum(list_transform(x[1:i - 1], lambda c: CASE WHEN c[1] = 'I' THEN 0 ELSE len(c) END)), 0) AS INTEGER) AS ra,
    CAST(coalesce(list_sum(list_transform(x[1:i - 1], lambda c: CASE WHEN c[1] = 'D' THEN 0 ELSE len(c) END)), 0) AS INTEGER) AS ha, CAST(len(x[i]) AS INTEGER) AS size, x[i][1] AS op FROM placed
) SELECT rn, hn, CAST(i - 1 AS INTEGER) AS nth, CASE op WHEN 'E' THEN 'equal' WHEN 'S' THEN 'substitute' WHEN 'D' THEN 'delete' ELSE 'insert' END AS type,
  ra AS ref_start, ra + CASE op WHEN 'I' THEN 0 ELSE size END AS ref_end, ha AS hyp_start, ha + CASE op WHEN 'D' THEN 0 ELSE size END AS hyp_end FROM spans"""
