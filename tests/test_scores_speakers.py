import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dhwanika.functions import alignment as A
from dhwanika.operators import scoring as S
from dhwanika.operators import speakers as V

WEIGHTS = [("खरपतवार", 3), ("कीटनाशक", 3), ("यूरिया", 3), ("खेत", 2)]
REF, HYP = "किसान खेत में यूरिया डाल रहा है", "किसान खेत में यूरिया कीटनाशक डाल है"


def weighted(spark, pairs, weights=WEIGHTS):
    df = spark.createDataFrame([(*p, "hindi") for p in pairs], "ref string, hyp string, lang string")
    return S.weighted_wer(df, spark.createDataFrame(weights, "token string, weight int")).first()


def test_weighted_rate(spark):
    got = weighted(spark, [(REF, HYP)])
    assert (got["awwer"], got["wer"]) == (0.4, 0.2857)
    got = weighted(spark, [(REF, REF)])
    assert (got["awwer"], got["wer"]) == (0.0, 0.0)
    for bad in ("", None, "__ERROR__ x", "?!"):
        got = weighted(spark, [("क ख ग", bad)])
        assert (got["awwer"], got["wer"]) == (1.0, 1.0)
    got = weighted(spark, [("NA", "x"), ("", "x"), (None, "x")])
    assert (got["awwer"], got["wer"], got["words"]) == (0.0, 0.0, 0)
    assert weighted(spark, [(REF, HYP), (REF, HYP)], [("q", 1)])["awwer"] == weighted(spark, [(REF, HYP)], [("q", 1)])["wer"]


def test_plain_rate(spark):
    df = spark.createDataFrame([(REF, HYP, "hi"), ("क ख", "", "hi"), ("NA", "x", "hi"), (None, "x", "hi"), ("3 ఎకరాలు", "మూడు ఎకరాలు", "te")], "ref string, hyp string, lang string")
    one = S.corpus_wer(df.limit(4)).first()
    assert (one["edits"], one["words"], one["pairs"]) == (2, 7, 1)
    both = S.corpus_wer_by_lang(df).first()
    assert (both["edits"], both["words"], both["pairs"]) == (2, 9, 2)
    none = S.corpus_wer(df.filter("false")).first()
    assert math.isnan(none["wer"]) and none["pairs"] == 0


WORDS = st.lists(st.sampled_from("abc"), max_size=7)


def back_from_the_end(r, h):
    """Operations by walking a full table back, head and tail set aside."""
    head = tail = 0
    while head < min(len(r), len(h)) and r[head] == h[head]:
        head += 1
    r, h = r[head:], h[head:]
    while r and h and r[-1] == h[-1]:
        r, h, tail = r[:-1], h[:-1], tail + 1
    d = [[i + j if not i or not j else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (r[i - 1] != h[j - 1]))
    i, j, out = len(r), len(h), []
    while i or j:
        if i and d[i - 1][j] + 1 == d[i][j]:
            i -= 1
            out.append(A.DELETE)
        elif j and (not i or d[i][j - 1] + 1 == d[i - 1][j - 1]):
            j -= 1
            out.append(A.INSERT)
        else:
            i, j = i - 1, j - 1
            out.append(A.SUBSTITUTE if r[i] != h[j] else A.EQUAL)
    return [A.EQUAL] * head + out[::-1] + [A.EQUAL] * tail, d[-1][-1]


@pytest.mark.parametrize("cells", [1 << 22, 60, 12])
@given(st.lists(st.tuples(WORDS, WORDS), max_size=6))
def test_operations_of_many_pairs(cells, pairs):
    """Side by side in one table, in several, and in tables of which only some rows are kept."""
    before, A.CELLS = A.CELLS, cells
    try:
        code = lambda x: np.array(["abc".index(w) for w in x], np.int64)
        got = A.operations([code(r) for r, _ in pairs], [code(h) for _, h in pairs])
    finally:
        A.CELLS = before
    for (r, h), ops in zip(pairs, got):
        want, least = back_from_the_end(r, h)
        assert ops.tolist() == want and (ops != A.EQUAL).sum() == least
        assert (ops != A.INSERT).sum() == len(r) and (ops != A.DELETE).sum() == len(h)


@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=6))
def test_weights_follow_the_operations(pairs):
    value = {"a": 1.0, "b": 2.0, "c": 4.0}
    lists = [pa.array([p[k] for p in pairs], pa.list_(pa.string())) for k in (0, 1)]
    got = A.weighed(*lists, lambda ws: [value[w] for w in ws]).to_pylist()
    for (r, h), x in zip(pairs, got):
        ops, least = back_from_the_end(list(r), list(h))
        ri, hi, weight = iter(r), iter(h), 0.0
        for o in ops:
            w, v = (next(ri) if o != A.INSERT else None), (next(hi) if o != A.DELETE else None)
            weight += value[v] if o == A.INSERT else value[w] if o != A.EQUAL else 0
        assert x == {"edits": least, "weight": weight, "total": sum(value[w] for w in r), "words": len(r)}


def test_chunks(spark):
    data = [(1, REF, HYP), (2, "क ख", None), (3, "", ""), (4, "", "क"), (5, "क ख", "क ख")]
    out = S.aligned_chunks(spark.createDataFrame(data, "id int, r string, h string"), "id", "r", "h").orderBy("id", "nth").collect()
    got = [tuple(r) for r in out]
    assert got[:5] == [(1, 0, "equal", 0, 4, 0, 4), (1, 1, "insert", 4, 4, 4, 5), (1, 2, "equal", 4, 5, 5, 6), (1, 3, "delete", 5, 6, 6, 6), (1, 4, "equal", 6, 7, 6, 7)]
    assert got[5:] == [(2, 0, "delete", 0, 2, 0, 0), (4, 0, "insert", 0, 0, 0, 1), (5, 0, "equal", 0, 2, 0, 2)]
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "c", "e"]), (["a"], ["b"]), ([], ["x", "y"]), (None, ["x"])], "r array<string>, h array<string>")
    assert [r[0] for r in df.repartition(1).select(S.word_edits(F.col("r"), F.col("h"))).collect()] == [2, 1, 2, 1]


def test_a_long_pair():
    rng = np.random.default_rng(4)
    r, h = rng.integers(0, 50, 4000), rng.integers(0, 50, 3000)
    ops = A.operations([r], [h])[0]
    assert (ops != A.INSERT).sum() == 4000 and (ops != A.DELETE).sum() == 3000


def test_weights_held_or_joined(spark, data):
    """The same sums whichever way the weights come to the words."""
    from dhwanika.operators import correction as C

    rows, weights = spark.read.parquet(f"{data}/aligned.parquet"), C.weights(spark.read.parquet(f"{data}/lexicon.parquet"))
    a, b = (S.weighted_wer(rows, weights, held=n).first().asDict() for n in (10_000, 0))
    assert {k: round(v, 6) for k, v in a.items()} == {k: round(v, 6) for k, v in b.items()} and a["num"] > a["edits"] > 0


def clip(spark, parts, sr=10, audio=None, n=None):
    """parts: (speaker, start, end, amplitude)."""
    length = n or int(max((e for _, _, e, _ in parts), default=3) * sr)
    wave = audio if audio is not None else [0.0] * length
    if audio is None:
        for _, s, e, x in parts:
            for i in range(int(s * sr), min(int(e * sr), length)):
                wave[i] = x
    segments = spark.createDataFrame([(1, i, float(s), float(e), p) for i, (p, s, e, _) in enumerate(parts)], "clip_id long, seg_idx int, start double, end double, speaker string")
    return segments, spark.createDataFrame([(1, sr, wave)], "clip_id long, sr int, audio array<float>")


PICKS = [
    ([("A", 0, 3, 0.05), ("B", 3, 6, 0.3)], "B"), ([("A", 0, 8, 0.05), ("B", 8, 9.5, 0.9)], "A"), ([("A", 0, 0.5, 0.1), ("B", 0.5, 1.2, 0.1)], "B"),
    ([("B", 0, 2, 0.5), ("A", 2, 4, 0.5)], "B"), ([("A", 0, 3, 0.05), ("B", 3, 6, 0.3), ("C", 6, 6.5, 0.9)], "B"),
]


@pytest.mark.parametrize("parts,want", PICKS)
@pytest.mark.parametrize("gain", [1.0, 3.0])
def test_pick(spark, parts, want, gain):
    segments, clips = clip(spark, [(p, s, e, x * gain) for p, s, e, x in parts])
    assert V.robust_pick(segments, clips).first()["speaker"] == want


def test_a_clip_with_a_third_of_all_turns(spark, monkeypatch):
    """Against numpy; long audio leaves the worker in parts, null samples are silence."""
    monkeypatch.setattr(V, "HELD", 100)
    rng = np.random.default_rng(3)
    clips, turns, want = [], [], {}
    for c in range(21):
        wave = rng.uniform(-1, 1, 3000 if c == 7 else int(rng.integers(0, 60))).astype("float32")
        audio = [None if i % 50 == 9 else float(x) for i, x in enumerate(wave)]
        clips.append((c, 10, audio))
        heard = np.array([0.0 if x is None else x for x in audio]) ** 2
        for k in range(200 if c == 7 else 20):
            a = float(rng.integers(0, 310))
            b = a + float(rng.integers(1, 30))
            turns.append((c, k, a, b, "ab"[k % 2]))
            want[c, k] = heard[int(a * 10) : int(b * 10)].sum()
    segments = spark.createDataFrame(turns, "clip_id long, seg_idx int, start double, end double, speaker string")
    known = spark.createDataFrame(clips, "clip_id long, sr int, audio array<float>")
    got = {(r["clip_id"], r["seg_idx"]): r["energy"] for r in V.segment_energy(segments, known, 32).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_energy_over_chunks(spark):
    import random

    rng = random.Random(1)
    wave = [rng.uniform(-1, 1) for _ in range(100)]
    parts = [("A", 0, 3, 0), ("B", 2.55, 9.95, 0), ("A", -1, 0.5, 0), ("A", 9, 50, 0), ("B", 20, 30, 0)]
    segments, clips = clip(spark, parts, audio=wave)
    import numpy as np

    audio = np.array(wave, "float32").astype(float)
    for chunk in (7, 10, 4096):
        got = {r["seg_idx"]: r["energy"] for r in V.segment_energy(segments, clips, chunk).collect()}
        want = {i: float((audio[max(int(s * 10), 0) : max(min(int(e * 10), 100), 0)] ** 2).sum()) for i, (_, s, e, _) in enumerate(parts)}
        assert got == pytest.approx(want, abs=1e-9)


def test_slices(spark):
    segments, clips = clip(spark, [("A", 1, 2, 0.5), ("B", 2, 2.2, 0.1), ("A", 2.2, 3, 0.5)], n=40)
    got = V.select_best_speaker(segments, clips).first()
    assert got["speaker"] == "A" and len(got["audio"]) == 16 + 14  # padded, the overlap twice
    whole = V.slice_speaker(segments.filter("false"), V.robust_pick(segments, clips), clips).first()
    assert len(whole["audio"]) == 40
    silent = V.select_best_speaker(segments.filter("false"), clips).first()
    assert silent["speaker"] is None and len(silent["audio"]) == 40


def test_no_audio(spark):
    segments, _ = clip(spark, [("A", 0, 2, 0.5)])
    clips = spark.createDataFrame([(1, 10, None), (2, 10, [])], "clip_id long, sr int, audio array<float>")
    assert V.robust_pick(segments, clips).first()["speaker"] == "A"
    assert {r["clip_id"]: r["audio"] for r in V.select_best_speaker(segments, clips).collect()} == {1: None, 2: []}
    assert [r["speaker"] for r in V.qualifying_speakers(segments).collect()] == ["A"]
    assert V.qualifying_speakers(segments, 2.5).count() == 0
