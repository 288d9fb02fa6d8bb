import unicodedata
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dhwanika.llm.frequencies import counts_of, mark_terms, term_counts, terms_of
from dhwanika.llm.queries import p4_found

EDGE = ",.?!;:\"'()।|"


@given(st.text(max_size=30))
def test_terms(text):
    want = [w.strip(EDGE) for w in unicodedata.normalize("NFKC", text).lower().split()]
    assert terms_of(text) == [w for w in want if w]


def test_counts_against_brute_force(spark):
    texts = ["a b a", "B, c.", None, "", "।", "a" * 50_000, "a b a", "ｃ c"] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(5)
    got = term_counts(df, "text").collect()
    occ, rec = Counter(), Counter()
    for t in texts:
        occ.update(terms_of(t or ""))
        rec.update(set(terms_of(t or "")))
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got} == {t: (occ[t], rec[t]) for t in occ}
    assert sorted(r["term_id"] for r in got) == list(range(len(occ)))


def test_records_and_weights(spark):
    data = [(1, "x", 2), (1, "x,", 3), (2, "x y", 1), (None, "x", 5), (3, "y", None), (3, None, 1)]
    df = spark.createDataFrame(data, "batch long, token string, n long")
    wide = df.select("*", F.lit("q").alias("term"), F.lit("q").alias("occ"), F.lit(1).alias("bucket"), F.lit(1).alias("record"))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts(wide, "token", record="batch", n="n").collect()}
    assert got == {"x": (6, 2), "y": (1, 1)}


def test_results_do_not_depend_on_partitions_or_blocks(spark):
    """Records that lie in many blocks, and another number of shuffle partitions."""
    df = spark.createDataFrame([(i % 7, f"w{i % 97} w{i % 11} ｗ{i % 5}", i % 4) for i in range(500)], "batch long, text string, n long")
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, shuffle, block in ((1, "4", 1 << 18), (7, "16", 5), (3, "1", 40)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            results.append([set(map(tuple, term_counts(df.repartition(parts), *a, block=block).collect())) for a in (("text",), ("text", "batch", "n"))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
    terms = sorted(t for _, t, _, _ in results[0][0])
    assert {t: i for i, t, _, _ in results[0][0]} == {t: i for i, t in enumerate(terms)}


def test_one_dictionary_for_all_sources(spark):
    a = spark.createDataFrame([("x y",), ("y z",)], "t string")
    b = spark.createDataFrame([(1, "z", 3), (2, "a z", 1)], "r long, t string, n long")
    got = {tuple(r) for r in counts_of({"a": (a, "t"), "b": (b, "t", "r", "n")}).collect()}
    assert got == {("a", 1, "x", 1, 1), ("a", 2, "y", 2, 2), ("a", 3, "z", 1, 1), ("b", 0, "a", 1, 1), ("b", 3, "z", 4, 2)}


def test_marks_and_empty(spark):
    df = spark.createDataFrame([("a a a b",)], "text string")
    marked = mark_terms(term_counts(df, "text"), "occurrences", 1, 0.5, spark.sql("select 4 as whole"))
    assert {(r["term"], r["mark"]) for r in marked.collect()} == {("a", "common"), ("b", "rare")}
    assert term_counts(df.filter("false"), "text").count() == 0


def test_query_against_brute_force(spark, data, duck):
    got = {tuple(r) for r in p4_found(spark, data).collect()}
    first = {}
    for u, h in duck.execute("select utt_id, hyp from aligned order by received_at").fetchall():
        first.setdefault(u, h)
    used = [h for h in first.values() if h is not None and h.strip() not in ("", "NA") and not h.strip().startswith("__ERROR__")]
    rec = Counter(t for h in used for t in set(terms_of(h)))
    want = {("hyp", t, "rare") for t, n in rec.items() if n == 1} | {("hyp", t, "common") for t, n in rec.items() if n >= 0.05 * len(used)}
    total = defaultdict(int)
    for _, t, n in set(duck.execute("select batch_no, token, n from bg_counts").fetchall()):
        if t is not None and t.strip() and n is not None and n >= 1:
            for w in terms_of(t):
                total[w] += n
    whole = sum(total.values())
    want |= {("bg", t, "rare") for t, n in total.items() if n <= 2} | {("bg", t, "common") for t, n in total.items() if n >= 0.005 * whole}
    assert got == want
