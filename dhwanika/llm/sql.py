"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from ..plans import sqltext as S

EDGE = ",.?!;:\"'()।|"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{S.BLANKS}+|{S.BLANKS}+$', '', 'g')"


def _terms(x: str) -> str:
    pieces = f"string_split({S.squeeze(f'lower({S.nfkc(x)})')}, ' ')"
    return f"list_filter(list_transform({pieces}, lambda w: trim(w, {S.q(EDGE)})), lambda w: w <> '')"


_A, _B = (S.squeeze(S.nfkc(c)) for c in ("candidate", "anchor"))
P3 = f"""WITH RECURSIVE pairs AS (
  SELECT DISTINCT {_A} AS a, {_B} AS b FROM pair_labels
  WHERE translate(upper({_trim('label')}), ' -', '__') IN ('SAME_WORD', 'SAME_MEANING')
), edges AS (SELECT a, b FROM pairs WHERE a <> '' AND b <> '' UNION SELECT b, a FROM pairs WHERE a <> '' AND b <> ''),
reach AS (
  SELECT a AS term, a AS other FROM edges
  UNION
  SELECT r.term, e.b FROM reach r JOIN edges e ON r.other = e.a
)
SELECT term, min(other) AS group_term FROM reach GROUP BY term"""

P4_ROWS = f"""once AS (
  SELECT utt_id, arg_min(hyp, received_at) AS hyp FROM (SELECT utt_id, coalesce(hyp, '') AS hyp, received_at FROM aligned WHERE utt_id IS NOT NULL) GROUP BY utt_id
  UNION ALL SELECT utt_id, hyp FROM aligned WHERE utt_id IS NULL
), used AS (
  SELECT row_number() OVER () AS r, hyp FROM once WHERE {_trim('hyp')} NOT IN ('', 'NA') AND NOT starts_with({_trim('hyp')}, '__ERROR__')
), said AS (SELECT r, unnest({_terms('hyp')}) AS token FROM used),
batches AS (
  SELECT batch_no, unnest({_terms('token')}) AS token, n FROM (SELECT DISTINCT batch_no, token, n FROM bg_counts) WHERE {_trim('token')} <> '' AND n >= 1
)"""
P4 = f"""WITH {P4_ROWS}, held AS (SELECT token, count(DISTINCT r) AS n FROM said GROUP BY token),
totals AS (SELECT token, sum(n) AS n FROM batches GROUP BY token)
SELECT 'hyp' AS src, token, 'rare' AS mark FROM held WHERE n = 1
UNION ALL SELECT 'hyp', token, 'common' FROM held WHERE n >= 0.05 * (SELECT count(*) FROM used)
UNION ALL SELECT 'bg', token, 'rare' FROM totals WHERE n <= 2
UNION ALL SELECT 'bg', token, 'common' FROM totals WHERE n >= 0.005 * (SELECT sum(n) FROM totals)"""
P4_COUNTS = f"""WITH {P4_ROWS}, counted AS (
  SELECT 'hyp' AS src, token, count(*) AS occurrences, count(DISTINCT r) AS records FROM said GROUP BY token
  UNION ALL SELECT 'bg', token, CAST(sum(n) AS BIGINT), count(DISTINCT coalesce(batch_no, -9223372036854775807)) FROM batches GROUP BY token
), listed AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS term_id FROM (SELECT DISTINCT token FROM counted))
SELECT src, term_id, token, occurrences, records FROM counted JOIN listed USING (token)"""

SQL = {"p3_found": P3, "p4_found": P4, "p4_counts": P4_COUNTS}
