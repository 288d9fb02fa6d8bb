from collections import Counter

import pytest
from pyspark.sql import functions as F

from dhwanika.functions.phonetics import norm_word
from dhwanika.operators import correction as C
from dhwanika.operators import matching as M

VOCABULARY = ["खरपतवार", "कीटनाशक", "यूरिया", "सिंचाई"]


def vocabulary(spark, words):
    return M.build_vocabulary(spark.createDataFrame(list(enumerate(words)), "p int, w string"), "w", "p")


def match(spark, token, words, **kw):
    r = M.match(spark.createDataFrame([(token,)], "t string"), "t", vocabulary(spark, words), **kw).collect()
    return (r[0]["surface"], round(r[0]["sim"], 3), r[0]["collision"]) if r else None


CASES = [
    ("खरपतवा", VOCABULARY, ("खरपतवार", 0.909, False)), ("यूरिया", VOCABULARY, ("यूरिया", 1.0, False)),
    ("मका", ["मक्का", "मका"], ("मका", 1.0, True)),
    ("आम", ["काम"], None), ("आमकाला", ["कामकाला", "कामकाल"], ("कामकाला", 0.875, False)), ("తెలుగు", VOCABULARY, None), (None, VOCABULARY, None), ("क", ["कखगघच"], None),
]


def test_cases(spark):
    for token, words, want in CASES:
        assert match(spark, token, words) == want, token


def test_ties_take_the_first_and_are_flagged(spark):
    got = match(spark, "कमल", ["कमर", "कमय"], min_sim=0.5)
    assert got[0] == "कमर" and got[2] is False  # L~R is a near pair
    got = match(spark, "कमल", ["कमय", "कमट"], min_sim=0.5)
    assert got[0] == "कमय" and got[2] is True


def test_against_a_scan_of_the_vocabulary(spark, data):
    from test_text import table

    words = [r[0] for r in spark.read.parquet(f"{data}/lexicon.parquet").select("word_norm").dropna().distinct().orderBy("word_norm").limit(150).collect()]
    v = vocabulary(spark, words)
    entries = sorted(v.collect(), key=lambda r: r["position"])
    tokens = [w[:i] + w[i + 1 :] for w in words[:60] for i in (1, 3)]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    coded = {r["token"]: (r["spelt"], r["phon"]) for r in M.encode_tokens(df, "t").collect()}
    got = {r["token"]: (r["surface"], round(r["sim"], 6), r["collision"]) for r in M.match(df, "t", v).collect()}
    want = {}
    for t, (spelt, p) in coded.items():
        same = [e["surface"] for e in entries if e["phon"] == p]
        if same:
            want[t] = (spelt if spelt in same else min(same), 1.0, len(same) > 1)
            continue
        pool = [e for e in entries if e["first"] == p[0]] or entries
        sims = [(max(0.0, 1 - table(p, e["phon"]) / max(len(p), len(e["phon"]))), e["surface"]) for e in pool if abs(len(e["phon"]) - len(p)) <= 3]
        top = max((s for s, _ in sims), default=0)
        if top >= 0.84:
            best = [w for s, w in sims if abs(s - top) < 1e-9]
            want[t] = (best[0], round(top, 6), len(best) > 1)
    assert got == want


def test_windows(spark):
    df = spark.createDataFrame([(1, ["खर", "पत", "वार", "में"]), (2, []), (3, ["यूरिया"]), (4, None), (5, ["कीटनाशक", "खरपतवा"])], "id int, toks array<string>")
    out = M.correct_windows(df, "id", "toks", vocabulary(spark, VOCABULARY)).orderBy("id", "nth").collect()
    assert [(r["id"], r["nth"], r["i"], r["span"], r["text"], r["surface"]) for r in out] == [(5, 0, 1, 1, "खरपतवा", "खरपतवार")]
    df = spark.createDataFrame([(1, ["खर", "पत", "वा", "में"])], "id int, toks array<string>")
    out = M.correct_windows(df, "id", "toks", vocabulary(spark, VOCABULARY)).collect()
    assert [(r["i"], r["span"], r["text"], r["surface"]) for r in out] == [(0, 3, "खर पत वा", "खरपतवार")]


LEXICON = [("x", "खरपतवार", "3"), ("x", "कीटनाशक", "3"), ("x", "यूरिया", "3.0"), ("x", "खेत", "2")]
COUNTS = {"खरपतवार": 5, "कीटनाशक": 2, "खेत": 9, "में": 50, "बहुत": 20, "हो": 30, "गया": 25, "है": 99}


def corrected(spark, texts, counts=COUNTS, **kw):
    weights = C.weights(spark.createDataFrame(LEXICON, "word string, word_norm string, relevance_mode string"))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    n = spark.createDataFrame(list(counts.items()), "token string, n long")
    return [(r["corrected"], r["changed"], [(e["from"], e["to"], e["sim"]) for e in r["edits"]], r["n_recovered"]) for r in C.correct(df, "t", weights, n, **kw).orderBy("i").collect()]


def test_correction(spark):
    edit = ("खरपतवा", "खरपतवार", 0.909)
    text = "खेत में खरपतवा बहुत हो गया है"
    got = corrected(spark, [text, "खरपतवा, है", "खरपतवा खरपतवा", "తెలుగు  మాట", "", None, "NA", "खरपतवार। है", "ｘ खरपतवा"])
    assert got[0] == ("खेत में खरपतवार बहुत हो गया है", True, [edit], 1)
    assert got[1] == ("खरपतवा, है", False, [], 0)
    assert got[2] == ("खरपतवार खरपतवार", True, [edit, edit], 2)
    assert got[3] == ("తెలుగు మాట", False, [], 0)
    assert got[4:7] == [("", False, [], 0), (None, False, [], 0), ("NA", False, [], 0)]
    assert got[7] == ("खरपतवार है", True, [("खरपतवार।", "खरपतवार", 1.0)], 1)
    assert got[8][0] == "x खरपतवार"


def test_gates(spark):
    text = "खेत में खरपतवा"
    without = {k: v for k, v in COUNTS.items() if k != "खरपतवार"}
    assert not corrected(spark, [text], without)[0][1]
    assert not corrected(spark, [text], COUNTS | {"खरपतवा": 1})[0][1]
    assert corrected(spark, [text], COUNTS | {"खरपतवा": 1}, oov_max=1, target_min=2)[0][1]


def in_turn(text, table):
    """The definition: tokens in order, each replaces the first whole word that equals it by then."""
    import re

    words, edits = text.split(), []
    for t in re.sub(r"[^\w\sऀ-ॿ]", " ", text).split():
        if t in table and t in words:
            words[words.index(t)] = table[t]
            edits.append((t, table[t]))
    return " ".join(words), edits


def test_correction_in_turn(spark):
    """Where a target may be a candidate itself, a replacement can be replaced again."""
    lexicon = [("x", "खरपतवार", "3"), ("x", "खरपतवारर", "2"), ("x", "कीटनाशक", "3")]
    weights = C.weights(spark.createDataFrame(lexicon, "word string, word_norm string, relevance_mode string"))
    counts = spark.createDataFrame([("खरपतवार", 1), ("कीटनाशक", 1)], "token string, n long")
    texts = ["खेत में खरपतवा बहुत", "खरपतवा खरपतवा, कीटनाशख", "कीटनाशख कीटनाशख", "खरपतवा।", "NA", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    fast = C.correct(df, "t", weights, counts, oov_max=0, target_min=1).orderBy("i").collect()
    slow = C.correct(df, "t", weights, counts, oov_max=1, target_min=1).orderBy("i").collect()
    table = {e["from"]: e["to"] for r in slow for e in r["edits"]}
    assert table.get("खरपतवा") == "खरपतवार"
    for a, b, t in zip(fast, slow, texts):
        if t in ("NA", ""):
            assert b["corrected"] == t and not b["changed"]
        else:
            want, edits = in_turn(t, table)
            assert b["corrected"] == want and [(e["from"], e["to"]) for e in b["edits"]] == edits and b["changed"] == bool(edits) and b["n_recovered"] == len(edits)
        assert a["corrected"] == b["corrected"] and a["edits"] == b["edits"]


def test_replacements_that_are_replaced(spark):
    """A fixed table: ख -> ग, then ग -> घ, over the words of a text."""
    df = spark.createDataFrame([("ख ग ख", {"ख": ("ग", 0.9), "ग": ("घ", 0.9)})], "_canon string, _map map<string,struct<surface:string,sim:double>>")
    got = df.select(C._folded(F.split("_canon", " "), C.tokens(F.col("_canon"))).alias("x")).first()["x"]
    want, edits = in_turn("ख ग ख", {"ख": "ग", "ग": "घ"})
    assert " ".join(got["words"]) == want and [(e["from"], e["to"]) for e in got["edits"]] == edits


def test_correction_of_its_own_output_changes_nothing(spark, data):
    rows = spark.read.parquet(f"{data}/aligned.parquet").select("hyp").limit(200)
    weights = C.weights(spark.read.parquet(f"{data}/lexicon.parquet"))
    counts = C.token_counts(spark.read.parquet(f"{data}/bg_counts.parquet"))
    once = C.correct(rows, "hyp", weights, counts).select("corrected")
    assert C.correct(once.withColumnRenamed("corrected", "t"), "t", weights, counts).filter("changed").count() == 0


def test_texts_stay_where_they_are_until_their_words_are_corrected(spark):
    """pairs of text and word aren't shuffled, and a text takes part in no distinct."""
    weights = C.weights(spark.createDataFrame(LEXICON, "word string, word_norm string, relevance_mode string"))
    n = spark.createDataFrame(list(COUNTS.items()), "token string, n long")
    out = C.correct(spark.createDataFrame([("खेत में खरपतवा",)], "t string"), "t", weights, n)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_canon" not in plan and plan.count("Exchange hashpartitioning(") <= 3
    assert not {"_canon", "_key", "_map", "_fold", "_edits"} & {*out.columns}


@pytest.mark.parametrize("kw", [{}, {"oov_max": 1}])
def test_texts_of_one_hash(spark, monkeypatch, kw):
    texts = ["खेत में खरपतवा है", "कीटनाशख है", "खेत है", "NA", None, "खेत है"]
    want = corrected(spark, texts, **kw)
    assert [r[1] for r in want] == [True, True, False, False, False, False]
    monkeypatch.setattr(C, "FEW_EDITS", 0)  # as if there were many corrections
    assert corrected(spark, texts, **kw) == want
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    assert corrected(spark, texts, **kw) == want


def test_weights(spark):
    data = [("a", "", "3.7"), ("b", "b", ""), ("b", "c", "x"), ("d", "d", "nan"), ("e", "e", "-1"), ("f", "f", "४"), ("f", "f", "2"), (" ", None, "3"), (None, " ", "3"), ("g", "g", " 4 "), ("h", "h", None)]
    got = {r["token"]: r["weight"] for r in C.weights(spark.createDataFrame(data, "word string, word_norm string, relevance_mode string")).collect()}
    assert got == {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1, "f": 4, "g": 4, "h": 1}


def test_variants_and_domain_terms(spark):
    weights = spark.createDataFrame([("दवा", 3), ("खाद", 4), ("खेत", 2)], "token string, weight int")
    pairs = [(1, "दवाई", "दवा", "SAME_WORD"), (2, "दवाई", "खाद", "SAME_MEANING"), (3, "दवा", "खाद", "SAME_WORD"), (4, "x", "खेत", "SAME_WORD"), (5, "y", "दवा", "UNRELATED"), (6, "a b", "दवा", "SAME_WORD"), (7, None, "दवा", "SAME_WORD")]
    v = C.variant_map(spark.createDataFrame(pairs, "row_no long, candidate string, anchor string, label string"), weights)
    assert {r["candidate"]: r["anchor"] for r in v.collect()} == {"दवाई": "दवा", "दवा": "खाद"}
    df = spark.createDataFrame([(1, "दवाई और खाद खेत दवाई"), (2, None)], "k int, t string")
    got = C.domain_terms(df, "k", "t", weights, v).orderBy("nth").collect()
    assert [(r["nth"], r["term"]) for r in got] == [(0, "दवा"), (2, "खाद"), (4, "दवा")]


def test_vocabulary_keeps_the_first_spelling(spark):
    v = vocabulary(spark, ["मक्का", "मका", "ज़ा", "जा", "తె", None])
    got = {r["surface"]: (r["position"], r["n_homophones"]) for r in v.collect()}
    assert got == {"मक्का": (0, 2), "मका": (1, 2), "जा": (2, 1)}


def test_no_cartesian_product(spark):
    df = spark.createDataFrame([("खरपतवा",)], "t string")
    v = vocabulary(spark, VOCABULARY)
    plan = M.match_fuzzy(M.encode_tokens(df, "t"), v)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_empty(spark):
    v = vocabulary(spark, VOCABULARY)
    none = spark.createDataFrame([], "t string")
    assert M.match(none, "t", v).count() == 0
    assert M.match(spark.createDataFrame([("क",)], "t string"), "t", v.filter("false")).count() == 0
    assert C.tokens(F.lit("x")) is not None


def test_windows_over_every_hypothesis(spark, data):
    """The query against a greedy scan of all hypotheses, sentences as well as single terms."""
    from dhwanika.plans import terms as Q

    said = [r[0] for r in spark.read.parquet(f"{data}/aligned.parquet").select(C.canonical_text(F.col("hyp"))).distinct().collect()]
    windows = {s: [(n, i, s.split()[i : i + n]) for n in (3, 2, 1) for i in range(len(s.split()) - n + 1)] for s in said}
    joined = spark.createDataFrame([(x,) for x in sorted({"".join(w) for ws in windows.values() for _, _, w in ws})], "t string")
    found = {r["token"]: r for r in M.match(joined, "t", Q._vocabulary(spark, data)).collect()}
    spelt = {r["t"]: r["s"] for r in joined.select("t", norm_word(F.col("t")).alias("s")).collect()}
    want = []
    for s, ws in windows.items():
        used: set = set()
        for n, i, w in ws:
            hit = found.get("".join(w))
            if hit and hit["surface"] != spelt["".join(w)] and not used & set(range(i, i + n)):
                want.append((s, i, n, " ".join(w), hit["surface"], round(hit["sim"], 6), hit["collision"]))
                used |= set(range(i, i + n))
    got = [tuple(r) for r in Q.windows_1_3(spark, data).select("said", "at", "span", "text", "surface", "sim", "collision").collect()]
    assert sorted(got) == sorted(want)
    assert any(len(s.split()) > 3 for s, *_ in got)


def test_domain_terms_of_rows_without_a_key(spark, data, tmp_path):
    """A row counts whether or not its utterance or its time of delivery is known."""
    from dhwanika.plans import terms as Q

    for name in ("lexicon", "pair_labels"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{data}/{name}.parquet")
    one = Q.domain_terms(spark, data).agg(F.min("utt_id")).first()[0]
    row = spark.read.parquet(f"{data}/aligned.parquet").filter(F.col("utt_id") == one).limit(1)
    no = {c: F.lit(None).cast(t) for c, t in row.dtypes}
    whole = row.unionByName(row.withColumn("received_at", no["received_at"])).unionByName(row.withColumn("utt_id", no["utt_id"]))
    whole.write.parquet(f"{tmp_path}/aligned.parquet")
    got = Counter(r["utt_id"] for r in Q.domain_terms(spark, str(tmp_path)).collect())
    assert got[None] > 0 and got == {one: 2 * got[None], None: got[None]}
