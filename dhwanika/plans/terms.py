"""Queries of vocabulary, matching and correction operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalization import normalize
from ..functions.phonetics import phon
from ..functions.unicode import words
from ..operators import correction as C
from ..operators import matching as M
from ..runtime import materialize, table
from . import sqltext as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return C.weights(table(spark, d, "lexicon"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per token over the batches; rows delivered twice count once."""
    return C.token_counts(table(spark, d, "bg_counts").select("batch_no", "token", "n").distinct())


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return C.target_vocabulary(_weights(spark, d))


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{S.BLANKS}+|{S.BLANKS}+$', '', 'g')"


PLAIN_REL = trim(S.digits("coalesce(nullif(relevance_mode, ''), '1')"))
WEIGHTS = f"""weights AS (
  SELECT token, greatest(max(w), 1) AS weight FROM (
    SELECT {trim("coalesce(nullif(word_norm, ''), word)")} AS token,
      coalesce(TRY_CAST(trunc(TRY_CAST(CASE WHEN regexp_matches(rel, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN rel END AS DOUBLE)) AS INTEGER), 1) AS w
    FROM (SELECT *, {PLAIN_REL} AS rel FROM lexicon)) WHERE token <> '' GROUP BY token
)"""
COUNTS = f"""counts AS (
  SELECT token, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT batch_no, token, n FROM bg_counts)
  WHERE {trim('token')} <> '' GROUP BY token
)"""
TARGETS = "targets AS (SELECT token FROM weights WHERE weight >= 3 AND NOT contains(token, ' '))"
VOCAB = f"""spelt AS (
  SELECT surface, min(token) AS position FROM (SELECT token, {S.norm_word('token')} AS surface FROM targets) GROUP BY surface
), coded AS (SELECT surface, position, {S.phon('surface')} AS phon FROM spelt),
vocab AS (
  SELECT *, left(phon, 1) AS first, CAST(len(phon) AS INTEGER) AS len, count(*) OVER (PARTITION BY phon) AS n_homophones FROM coded WHERE phon <> ''
)"""

_add("weights_dedup", _weights, f"WITH {WEIGHTS} SELECT token, weight FROM weights")
_add("corpus_counts", _counts, f"WITH {COUNTS} SELECT token, n FROM counts")
_add("vocab_build", _vocabulary, f"WITH {WEIGHTS}, {TARGETS}, {VOCAB} SELECT surface, phon, first, len, position, n_homophones FROM vocab")
_add(
    "homophones",
    lambda spark, d: M.homophones(_vocabulary(spark, d)),
    f"WITH {WEIGHTS}, {TARGETS}, {VOCAB} SELECT phon, min(surface) AS least_surface, count(*) AS n FROM vocab GROUP BY phon",
)
CANON = {c: S.squeeze(S.nfkc(c)) for c in ("candidate", "anchor")}
VARIANTS = f"""variants AS (
  SELECT c AS candidate, arg_min(a, (row_no, a)) AS anchor FROM (
    SELECT row_no, {CANON['candidate']} AS c, {CANON['anchor']} AS a FROM pair_labels WHERE label IN ('SAME_WORD', 'SAME_MEANING'))
  WHERE c <> '' AND a <> '' AND c <> a AND NOT contains(c, ' ') AND NOT contains(a, ' ') AND a IN (SELECT token FROM weights WHERE weight >= 3)
  GROUP BY c
)"""


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return C.variant_map(table(spark, d, "pair_labels"), _weights(spark, d))


_add("variant_map_first_wins", _variants, f"WITH {WEIGHTS}, {VARIANTS} SELECT candidate, anchor FROM variants")

TOKEN_SIGNS = "[^\\p{L}\\p{N}_\\x{900}-\\x{97F}\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"
HYP = f"SELECT utt_id, {S.squeeze(S.nfkc("coalesce(hyp, '')"))} AS canon FROM aligned"
TOKENS = f"list_filter(string_split({S.squeeze(f"regexp_replace(canon, '{TOKEN_SIGNS}', ' ', 'g')")}, ' '), lambda w: w <> '')"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every hypothesis, joined by a bar."""
    canon = C.canonical_text(F.col("hyp"))
    return table(spark, d, "aligned").select("utt_id", F.array_join(C.tokens(canon), "|").alias("tokens"))


_add("tokens", tokens, f"SELECT utt_id, array_to_string({TOKENS}, '|') AS tokens FROM ({HYP})")
SAID = f"""said AS (
  SELECT DISTINCT token FROM (SELECT unnest({TOKENS}) AS token FROM (SELECT DISTINCT canon FROM ({HYP}))) WHERE regexp_matches(token, '[\\x{{900}}-\\x{{97F}}]')
)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Distinct Devanagari tokens of the hypotheses."""
    said = table(spark, d, "aligned").select(F.explode(C.tokens(C.canonical_text(F.col("hyp")))).alias("token")).distinct()
    return said.filter(C.is_devanagari(F.col("token")))


KNOWN = "known AS (SELECT token FROM said WHERE token NOT IN (SELECT token FROM targets))"
OPEN = "open AS (SELECT token FROM known WHERE token NOT IN (SELECT token FROM counts WHERE n > 0))"


def open_tokens(spark: SparkSession, d: str) -> DataFrame:
    return C.oov_gate(C.known_gate(candidates(spark, d), _weights(spark, d)), _counts(spark, d))


_add("known_gate", lambda spark, d: C.known_gate(candidates(spark, d), _weights(spark, d)), f"WITH {WEIGHTS}, {TARGETS}, {SAID}, {KNOWN} SELECT token FROM known")
_add("oov_gate", open_tokens, f"WITH {WEIGHTS}, {TARGETS}, {COUNTS}, {SAID}, {KNOWN}, {OPEN} SELECT token FROM open")

def encoded(source: str) -> str:
    return f"""encoded AS (
      SELECT token, spelt, {S.phon('spelt')} AS phon FROM (SELECT token, {S.norm_word('token')} AS spelt FROM {source}) WHERE spelt <> ''
    ), tok AS (SELECT * FROM encoded WHERE phon <> '')"""


EXACT = """exact AS (
  SELECT token, coalesce(m.surface, h.least_surface) AS surface, CAST(1 AS DOUBLE) AS sim, h.n > 1 AS collision
  FROM tok JOIN (SELECT phon, min(surface) AS least_surface, count(*) AS n FROM vocab GROUP BY phon) h USING (phon)
  LEFT JOIN vocab m ON m.surface = tok.spelt
)"""


def fuzzy_sql(min_sim: float) -> str:
    """The blocked match by a plain join on first phoneme and length band."""
    return f"""rest AS (SELECT * FROM tok WHERE phon NOT IN (SELECT phon FROM vocab)),
    near AS (
      SELECT r.token, r.phon AS a, v.surface, v.phon AS b, v.position FROM rest r JOIN vocab v
        ON left(r.phon, 1) = v.first AND abs(len(r.phon) - v.len) <= 3
      UNION ALL
      SELECT r.token, r.phon, v.surface, v.phon, v.position FROM rest r JOIN vocab v ON abs(len(r.phon) - v.len) <= 3
        WHERE left(r.phon, 1) NOT IN (SELECT first FROM vocab)
    ), thin AS (SELECT DISTINCT a, b FROM near WHERE levenshtein(a, b) <= {1 - min_sim:.6f} * greatest(len(a), len(b)) / 0.4 + 1e-9),
    measured AS (SELECT a, b, {S.pdist('a', 'b')} AS d FROM thin),
    scored AS (SELECT token, surface, position, CAST({S.psim('d', 'a', 'b')} AS DOUBLE) AS sim FROM near JOIN measured USING (a, b)),
    best AS (SELECT token, max(round(sim, 9)) AS top FROM scored WHERE sim >= {min_sim} GROUP BY token),
    fuzzy AS (
      SELECT s.token, arg_min(surface, position) AS surface, arg_min(sim, position) AS sim, count(*) > 1 AS collision
      FROM scored s JOIN best ON s.token = best.token AND round(s.sim, 9) = best.top GROUP BY s.token
    )"""


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return materialize(M.encode_tokens(candidates(spark, d), "token"), "tokens").df


def _rounded(f: DataFrame) -> DataFrame:
    return f.withColumn("sim", F.round("sim", 6))


BASE = f"WITH {WEIGHTS}, {TARGETS}, {VOCAB}, {SAID}, {encoded('said')}"
_add(
    "match_exact",
    lambda spark, d: M.match_exact(_encoded(spark, d), _vocabulary(spark, d)),
    f"{BASE}, {EXACT} SELECT token, surface, sim, collision FROM exact",
)
_add(
    "match_fuzzy",
    lambda spark, d: _rounded(M.match_fuzzy(_encoded(spark, d), _vocabulary(spark, d))),
    f"{BASE}, {fuzzy_sql(M.MIN_SIM)} SELECT token, surface, round(sim, 6) AS sim, collision FROM fuzzy",
)


_add(
    "match_fallback",
    lambda spark, d: _rounded(M.match(candidates(spark, d), "token", _vocabulary(spark, d), 0.7)),
    f"{BASE}, {EXACT}, {fuzzy_sql(0.7)} SELECT token, surface, round(sim, 6) AS sim, collision FROM fuzzy "
    "UNION ALL SELECT token, surface, round(sim, 6), collision FROM exact",
)


def trivial_variant(spark: SparkSession, d: str) -> DataFrame:
    """Judged pairs whose terms differ only in diacritics that make no other word."""
    pairs = table(spark, d, "pair_labels").select("candidate", "anchor").dropna().distinct()
    return pairs.select("candidate", "anchor", (C.fold(F.col("candidate")) == C.fold(F.col("anchor"))).alias("trivial"))


FOLD = lambda x: f"translate(translate({S.nfkc(x)}, {S.q(C.FOLDED[0])}, {S.q(C.FOLDED[1])}), {S.q(C.SILENT)}, '')"
_add(
    "trivial_variant",
    trivial_variant,
    f"SELECT DISTINCT candidate, anchor, {FOLD('candidate')} = {FOLD('anchor')} AS trivial FROM pair_labels WHERE candidate IS NOT NULL AND anchor IS NOT NULL",
)


def edit_table(spark: SparkSession, d: str) -> DataFrame:
    return C.edit_table(candidates(spark, d), _weights(spark, d), _counts(spark, d))


EDITS = f"""WITH {WEIGHTS}, {TARGETS}, {VOCAB}, {COUNTS}, {SAID}, {KNOWN}, {OPEN}, {encoded('open')}, {EXACT}, {fuzzy_sql(C.MIN_SIM)},
matched AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy),
edits AS (
  SELECT m.token, m.surface, m.sim FROM matched m JOIN counts c ON c.token = m.surface
  WHERE NOT collision AND m.surface <> m.token AND sim >= {C.MIN_SIM} AND {FOLD('m.token')} <> {FOLD('m.surface')} AND c.n >= 1
)"""
_add("attested_gate", lambda spark, d: _rounded(edit_table(spark, d)), f"{EDITS} SELECT token, surface, round(sim, 6) AS sim FROM edits")


def correct(spark: SparkSession, d: str) -> DataFrame:
    """Every hypothesis with its corrections; the edits as text."""
    rows = table(spark, d, "aligned").select("utt_id", "hyp")
    out = C.correct(rows, "hyp", _weights(spark, d), _counts(spark, d))
    return out.select("utt_id", "corrected", "changed", F.array_join(F.transform("edits", lambda e: F.concat(e["from"], F.lit(">"), e["to"])), "|").alias("edits"), "n_recovered")


_add(
    "correct",
    correct,
    f"""{EDITS}, heard AS (SELECT utt_id, hyp, {S.squeeze(S.nfkc("coalesce(hyp, '')"))} AS canon FROM aligned),
    split_up AS (SELECT canon, string_split(canon, ' ') AS ws FROM (SELECT DISTINCT canon FROM heard WHERE canon NOT IN ('', 'NA'))),
    placed AS (SELECT canon, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM split_up),
    changed AS (
      SELECT canon, string_agg(coalesce(e.surface, w), ' ' ORDER BY i) AS new, string_agg(w || '>' || e.surface, '|' ORDER BY i) AS edits, count(e.token) AS n
      FROM placed LEFT JOIN edits e ON e.token = w GROUP BY canon HAVING count(e.token) > 0
    )
    SELECT utt_id, CASE WHEN h.canon IN ('', 'NA') THEN hyp ELSE coalesce(c.new, h.canon) END AS corrected,
      c.canon IS NOT NULL AS changed, coalesce(c.edits, '') AS edits, CAST(coalesce(c.n, 0) AS INTEGER) AS n_recovered
    FROM heard h LEFT JOIN changed c ON c.canon = h.canon""",
)


def domain_terms(spark: SparkSession, d: str) -> DataFrame:
    """Domain terms of the normalised references, in order."""
    normed = table(spark, d, "aligned").select("utt_id", normalize(F.col("ref"), F.col("lang")).alias("normed"))
    return C.domain_terms(normed, "utt_id", "normed", _weights(spark, d), _variants(spark, d))


_add(
    "domain_terms",
    domain_terms,
    f"""WITH {WEIGHTS}, {TARGETS}, {VARIANTS}, normed AS (SELECT utt_id, received_at, {S.dispatched('ref', 'lang')} AS t FROM aligned),
    placed AS (SELECT utt_id, received_at, unnest(range(0, len(ws))) AS nth, unnest(ws) AS token FROM (SELECT *, string_split(t, ' ') AS ws FROM normed WHERE t IS NOT NULL))
    SELECT utt_id, CAST(nth AS INTEGER) AS nth, coalesce(v.anchor, p.token) AS term
    FROM placed p LEFT JOIN variants v ON v.candidate = p.token LEFT JOIN targets g ON g.token = p.token WHERE g.token IS NOT NULL OR v.anchor IS NOT NULL""",
)


def windows_1_3(spark: SparkSession, d: str) -> DataFrame:
    """Window proposals over the distinct hypotheses."""
    said = table(spark, d, "aligned").select(C.canonical_text(F.col("hyp")).alias("said")).distinct()
    rows = said.select("said", words(F.col("said")).alias("tokens"))
    return _rounded(M.correct_windows(rows, "said", "tokens", _vocabulary(spark, d))).withColumnRenamed("i", "at")


CLEAR = "len(list_filter(kept, lambda k: k.p < w[1].p + w[1].span AND w[1].p < k.p + k.span)) = 0"
_add(
    "windows_1_3",
    windows_1_3,
    f"""WITH {WEIGHTS}, {TARGETS}, {VOCAB}, lines AS (
      SELECT DISTINCT canon AS said, list_filter(string_split(canon, ' '), lambda w: w <> '') AS ws FROM ({HYP})
    ), starts AS (SELECT said, ws, unnest([3, 2, 1]) AS span FROM lines),
    windows AS (
      SELECT said, span, p, array_to_string(ws[p + 1:p + span], '') AS joined, array_to_string(ws[p + 1:p + span], ' ') AS text
      FROM (SELECT *, unnest(range(0, len(ws) - span + 1)) AS p FROM starts WHERE len(ws) >= span)
    ), every AS (SELECT DISTINCT joined AS token FROM windows), {encoded('every')}, {EXACT}, {fuzzy_sql(M.MIN_SIM)},
    matched AS (SELECT token, surface, sim, collision FROM exact UNION ALL SELECT token, surface, sim, collision FROM fuzzy),
    hits AS (
      SELECT said, list(w ORDER BY w.span DESC, w.p) AS ws FROM (
        SELECT said, {{'p': w.p, 'span': w.span, 'text': w.text, 'surface': m.surface, 'sim': m.sim, 'collision': m.collision}} AS w
        FROM windows w JOIN matched m ON m.token = w.joined JOIN encoded e ON e.token = w.joined WHERE m.surface <> e.spelt) GROUP BY said
    ), taken AS (
      SELECT said, list_reduce(list_transform(ws, lambda w: [w]), lambda kept, w: CASE WHEN {CLEAR} THEN list_append(kept, w[1]) ELSE kept END) AS kept FROM hits
    ), numbered AS (SELECT said, unnest(range(0, len(kept))) AS nth, unnest(kept) AS w FROM taken)
    SELECT said, CAST(nth AS INTEGER) AS nth, CAST(w.p AS INTEGER) AS "at", CAST(w.span AS INTEGER) AS span, w.text AS text, w.surface AS surface, round(w.sim, 6) AS sim, w.collision AS collision FROM numbered""",
)
_add("part_phonemes", lambda spark, d: table(spark, d, "part").select("p_name").distinct().select("p_name", phon(F.col("p_name")).alias("phon")),
     f"SELECT p_name, {S.phon('c')} AS phon FROM (SELECT DISTINCT p_name, {S.norm_word('p_name')} AS c FROM part)")
