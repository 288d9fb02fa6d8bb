"""Language of texts and of the stretches of mixed texts, with a confidence.

Multinomial naive Bayes over hashed character n-grams.  The log-probability matrix (buckets x
languages, well under 2 MB) is broadcast; a batch is scored sparsely in numpy: each distinct word
once, all its n-gram buckets gathered and summed.  A text is then a sequence of word scores; the most
probable sequence of languages with a cost per switch divides it into stretches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import strip
from .looks import looks
from .romanise import romanise

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4, 5)
#: Labels that name a language, fixed values.
ALIASES = {
    "hi": ("hi", "hin", "hindi"),
    "te": ("te", "tel", "telugu"),
    "or": ("or", "od", "ori", "odia", "oriya"),
    "mr": ("mr", "mar", "marathi"),
    "en": ("en", "eng", "english"),
}
SMOOTHING = 0.05
SWITCH = 20.0  # nats a change of language costs, against word scores averaged over the n-gram orders
STRETCH = 4  # words that make a stretch
FOLDS = 3


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _clean(word: str) -> str:
    """Letters and marks of a word; what is left of a number or of punctuation tells no language."""
    return "".join(c for c in word if unicodedata.category(c)[0] in "LM")


def buckets(words: list[str], n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of every word with its borders: bucket and word number of each n-gram."""
    padded = [f"\x02{w}\x03" for w in words]
    joined = "".join(padded)
    if not joined:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in padded])
    of = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)[of]
    at = np.arange(len(p))
    out, own = [], []
    h = np.zeros(len(p), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        # h[i] is the hash of the n code points from i on
        shifted = np.zeros(len(p), np.uint64)
        shifted[: len(p) - n + 1] = p[n - 1 :]
        h = (h ^ shifted) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            fit = at + n <= end
            if n == 1:
                fit &= (p != 2) & (p != 3)
            out.append((h[fit] % np.uint64(n_buckets)).astype(np.int64))
            own.append(of[fit])
    return np.concatenate(out), np.concatenate(own)


class Model:
    """Log-probabilities by (bucket, language), and what a difference of scores is divided by for a confidence."""

    def __init__(self, languages: list[str], table: np.ndarray, temperature: float = 1.0):
        self.languages, self.table, self.temperature = languages, table, temperature

    @staticmethod
    def fit(texts: list[str], langs: list[str]) -> Model:
        """Model of all sentences; its temperature is measured on sentences that a model of the others hasn't seen.

        The n-grams of a text are no independent witnesses, so their sum overstates the evidence.
        """
        parts = [[i for i in range(len(texts)) if i % FOLDS == k] for k in range(FOLDS)]
        scores, right = [], []
        for held in parts if len(texts) >= FOLDS else []:
            out = set(held)
            rest = [i for i in range(len(texts)) if i not in out]
            m = Model._fit([texts[i] for i in rest], [langs[i] for i in rest])
            for i in held:
                if langs[i] not in m.languages or len(m.languages) < 2:
                    continue
                s = m.word_scores(words_of(texts[i]))
                # whole sentences and their beginnings: short stretches are the doubtful ones
                for n in sorted({1, 2, 3, 4, 6, len(s)}):
                    if 0 < n <= len(s) and np.any(s[:n]):
                        total = dict(zip(m.languages, s[:n].sum(0)))
                        scores.append([total.get(g, -1e9) for g in sorted(set(langs))])
                        right.append(sorted(set(langs)).index(langs[i]))
        m = Model._fit(texts, langs)
        m.temperature = best_temperature(np.array(scores), np.array(right, np.int64)) if scores else 1.0
        return m

    @staticmethod
    def _fit(texts: list[str], langs: list[str]) -> Model:
        names = sorted(set(langs))
        counts = np.zeros((BUCKETS, len(names)))
        for k, name in enumerate(names):
            own = [t for t, g in zip(texts, langs) if g == name]
            # a sentence in an Indic script is also a sample of its romanised spellings
            latin = [romanise(t, long, w) for t in own for long in (False, True) for w in (False, True)]
            known = set(own)
            own += [x for x in latin if x not in known]
            words = [c for t in own for w in words_of(t) if (c := _clean(w))]
            b, _ = buckets(words)
            np.add.at(counts[:, k], b, 1.0)
        logs = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * BUCKETS)
        # only differences between languages matter: unseen buckets of equal priors then add nothing
        return Model(names, (logs - logs.mean(1, keepdims=True)).astype(np.float32))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): naive Bayes score, averaged over the n-gram orders."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        clean = [_clean(w) for w in words]
        some = [i for i, c in enumerate(clean) if c]
        if some:
            b, of = buckets([clean[i] for i in some])
            gathered = self.table[b]
            order = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[order], np.arange(len(some)))
            out[some] = np.add.reduceat(gathered[order], starts) / len(ORDERS)
        return out


CELLS = 1 << 21  # word scores of texts, padded to one length, that go side by side


def paths(score: np.ndarray, size: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of every word on the most probable path of each text; the texts' words stand one after the other.

    Texts of like length go side by side through the recursion.
    """
    k = score.shape[1]
    begin = np.cumsum(size) - size
    out = np.zeros(len(score), np.int64)
    order = np.argsort(size, kind="stable")
    at = int((size == 0).sum())
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * size[order[at + n]] * k <= CELLS:
            n += 1
        own = order[at : at + n]
        at += n
        length, first = size[own], begin[own]
        widest, rows = int(length.max()), np.arange(n)
        best = score[first].astype(float)
        back = np.zeros((widest, n, k), np.int8 if k < 128 else np.int32)
        for i in range(1, widest):
            live = np.flatnonzero(length > i)
            b = best[live]
            top = b.argmax(1)
            change = b[np.arange(len(live)), top] - switch
            back[i, live] = np.where(b >= change[:, None], np.arange(k), top[:, None])
            best[live] = np.maximum(b, change[:, None]) + score[first[live] + i]
        here = best.argmax(1)
        for i in range(widest - 1, -1, -1):
            live = length > i
            out[first[live] + i] = here[live]
            here = np.where(live, back[i, rows, here], here)
    return out


def stretches(score: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int, int]]:
    """Most probable (first word, end, language) stretches of a text, from its words' scores."""
    path = paths(score, np.array([len(score)]), switch)
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [(a, b, int(path[a])) for a, b in zip(cuts, cuts[1:]) if b > a]


def best_temperature(scores: np.ndarray, right: np.ndarray) -> float:
    """Divisor of the scores under which the right languages are most probable."""
    tried = np.geomspace(0.25, 64, 65)
    rows = np.arange(len(right))

    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[rows, right]).mean())

    return float(tried[np.argmin([loss(t) for t in tried])])


def confidence(total: np.ndarray, language: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """Posterior of a language under equal priors, its evidence tempered, for every row of scores."""
    e = np.exp((total - total.max(-1, keepdims=True)) / temperature)
    return np.take_along_axis(e, np.asarray(language)[..., None], -1)[..., 0] / e.sum(-1)


def fit(samples: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = 20_000) -> Model:
    """Model from labelled sentences, at most ``max_rows`` of them, drawn by a hash of the sentence.

    Rows with a null text or language are left out.  Raises an error without any sample.
    """
    rows = (
        samples.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna().distinct()
        .orderBy(F.xxhash64("text", "lang"), "text", "lang").limit(max_rows).collect()
    )
    if not rows:
        raise ValueError("no labelled sentences to fit on")
    return Model.fit(looks([r["text"] for r in rows]), [r["lang"] for r in rows])


STRETCHES = "array<struct<first_word:int,end_word:int,words:int,lang:string,confidence:double>>"


def detect(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """Language of every text and of each of its stretches.

    Returns (key, words, lang, confidence, stretches): ``words`` counts the words with a letter or
    digit; ``lang`` is the language of most evidence over the whole text; a stretch runs from its
    first word to before its end word in white-space words of the text's canonical form.

    Defined cases: a null text gives null words, lang and stretches; a text without letters gives
    null lang, confidence 0 and no stretches; ties go to the language first by name; texts of any
    length are scored whole; repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.languages, pa.string())
        for b in batches:
            raw = b["text"].to_pylist()
            split = [words_of(t) for t in looks([t or "" for t in raw])]
            number: dict[str, int] = {}
            said = np.array([number.setdefault(w, len(number)) for ws in split for w in ws], np.int64)
            score = m.word_scores(list(number)).astype(float)[said]
            solid = np.array([any(c.isalnum() for c in w) for w in number], bool)[said]
            size = np.array([len(ws) for ws in split], np.int64)
            n, text = len(split), np.repeat(np.arange(len(split)), size)
            total = np.stack([np.bincount(text, score[:, g], n) for g in range(score.shape[1])], 1) if n else np.zeros((0, len(m.languages)))
            told = np.bincount(text, score.any(1), n) > 0
            main = total.argmax(1)
            sure = np.where(told, confidence(total, main, m.temperature), 0.0)
            # stretches of all texts, one after the other
            path = paths(score, size)
            cut = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (text[1:] != text[:-1])] & told[text]) if len(path) else np.empty(0, np.int64)
            begin = np.cumsum(size) - size
            own = text[cut]
            end = np.minimum(np.r_[cut[1:], len(path)][: len(cut)], begin[own] + size[own])
            runs = np.cumsum(np.bincount(cut, minlength=len(path) + 1)[:-1]) - 1 if len(cut) else np.empty(0, np.int64)
            within = told[text] if len(cut) else np.zeros(len(text), bool)
            sums = np.stack([np.bincount(runs[within], score[within, g], len(cut)) for g in range(score.shape[1])], 1) if len(cut) else np.zeros((0, len(m.languages)))
            held = np.bincount(runs[within], solid[within], len(cut)) if len(cut) else np.zeros(0)
            parts = pa.StructArray.from_arrays(
                [
                    pa.array(cut - begin[own], pa.int32()), pa.array(end - begin[own], pa.int32()), pa.array(held.astype(np.int32)),
                    names.take(pa.array(path[cut])), pa.array(confidence(sums, path[cut], m.temperature), pa.float64()),
                ],
                names=["first_word", "end_word", "words", "lang", "confidence"],
            )
            null = np.array([t is None for t in raw], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), parts, mask=pa.array(null))
            words = pa.array(np.bincount(text, solid, n).astype(np.int32), mask=null)
            langs = names.take(pa.array(main, mask=null | ~told))
            yield pa.RecordBatch.from_arrays([b["key"], words, langs, pa.array(sure, mask=null), lists], names=["key", "words", "lang", "confidence", "stretches"])

    schema = f"key {kind}, words int, lang string, confidence double, stretches {STRETCHES}"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def named_language(label: Column) -> Column:
    """Code of the language that a label names, or null."""
    plain = F.lower(strip(label))
    out = F.lit(None).cast("string")
    for code, names in ALIASES.items():
        out = F.when(plain.isin(*names), F.lit(code)).otherwise(out)
    return out


def mislabelled(df: DataFrame, model: Model, key: str = "utt_id", text: str = "ref", label: str = "lang", order: str = "received_at") -> DataFrame:
    """Utterances whose label doesn't fit their text, or whose text is mixed: (key, lang).

    One row per case and language of the text.  Texts of fewer than STRETCH words make no case.  Each
    key counts once (its earliest row), rows without a key each for themselves.
    """
    from ..runtime import once_per_key
    from .texts import usable

    rows = once_per_key(df, key, order, [text, label]).filter(usable(text))
    wide = rows.select(F.struct(F.col(key).alias("k"), named_language(F.col(label)).alias("label")).alias("id"), F.col(text).alias("text"))
    seen = detect(wide, "id", "text", model).filter((F.col("words") >= STRETCH) & F.col("lang").isNotNull())
    long = F.filter("stretches", lambda s: s["words"] >= STRETCH)
    held = F.array_sort(F.array_distinct(F.transform(long, lambda s: s["lang"])))
    langs = F.when(F.size(held) > 0, held).otherwise(F.array("lang"))
    wrong = F.col("id.label").isNull() | (F.col("id.label") != F.element_at("langs", 1))
    return (
        seen.withColumn("langs", langs)
        .filter((F.size("langs") > 1) | wrong)
        .select(F.col("id.k").alias(key), F.explode("langs").alias("lang"))
    )
