"""Texts that were cut off: hashed logistic regression on how they close.

1. One pass over the texts keeps of each its closing sentence, lengths and style, and counts how often
   words and shapes of words stand inside texts.
2. What stands far more often at the end of texts than inside (thanks, tags, signatures, emoji) was put
   after them, and so was a last word of a shape that words of the corpus hardly ever have (marks of
   converters, runs of one letter); no list of such words is given.  It is set aside before a text is judged.
3. Lengths at which the texts of a source pile up are the limits of its field.
4. Intact sentences inside texts are closed properly; cutting texts artificially, at a limit or anywhere,
   gives positives.  The features are closing characters and words, punctuation, the shape of a list row,
   and the length against the limits.  Every distinct text gives examples: parts of PART texts are learned
   side by side, and a weight is its mean over the parts that saw its feature.  The share of cut texts is
   estimated from the endings of all texts, and the threshold is the one of best expected F1 on held-out
   examples, those of a fifth of all texts, at that share.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Materialized, materialize, strip
from .looks import looks

DIM = 1 << 18
PART = 10_000  # texts that one task learns from, about
BLOCKS = 16  # of the weights, to add them up over the parts
FINE = 1024  # bins of a unit of log odds, in which probabilities are counted
PER_TEXT = 6  # intact sentences, and cuts, of each of them
MAX_LIMITS = 1_000  # limits, the most frequent first, that examples are cut at
NEAR = 4  # code points or bytes below a limit that count as at it
PILE = 8  # least texts at a limit, and times they must be more frequent there than around it
AROUND = 64  # lengths below and above that a pile is compared with
LAST = 8  # words at a text's end in which what was put after it is looked for
KEPT = 16  # words at a text's end that are kept, with the whole sentence they begin in
WORDS, SHAPES = 1 << 20, 1 << 16  # buckets of word counts; the first SHAPES of them are those of shapes
RARE = 1e-4  # share of the words inside texts below which a shape is foreign to the corpus
LEAST_ENDS, ODDS = 5, 2.3  # texts that end with a word put after them, least; log odds of end against inside, least

STOPS = ".?!।॥"
SPLIT = re.compile(r"(?<=[.?!।॥])\s+|\n+")
TOKEN = re.compile(r"\n?[^\s]+")
LABEL = re.compile(r"^\w[\w ‍‌ऀ-ॿ଀-୿ఀ-౿]{0,20}:(?:\s|$)")
ROW = re.compile(r"^[^:\n]{1,40} :(?:\s|$)")
BROKEN = "�"
KEY = re.compile(r"\d")


def _class(c: str) -> str:
    k, o = unicodedata.category(c), ord(c)
    if k[0] == "L":
        return "a" if c.isascii() else "i" if 0x900 <= o < 0xD80 else "x"
    if k[0] == "M":
        return "" if 0x900 <= o < 0xD80 else "m"
    return "0" if k[0] == "N" else "s" if k in ("So", "Sk", "Cs", "Co", "Cn") else c


def shape(word: str) -> str:
    """Kinds of a word's signs, runs as one; long runs of one sign and long numbers have a shape of their own."""
    plain = re.sub(r"(.)\1+", r"\1", "".join(map(_class, unicodedata.normalize("NFC", word))))
    return plain + ("~" if re.search(r"(\D)\1{5,}", word) else "+" if plain == "0" and len(word) >= 8 else "")


_features: dict[str, tuple[int, ...]] = {}


def _bucket(feature: str) -> int:
    h = zlib.crc32(feature.encode("utf-8", "surrogatepass"))
    return h % SHAPES if feature[0] == "s" else SHAPES + h % (WORDS - SHAPES)


def _plain(token: str) -> tuple[str, str]:
    """Line break before a token, and the token without the stops at its end, digits as one."""
    line = "\n" if token[0] == "\n" else ""
    return line, KEY.sub("0", token[len(line) :].rstrip(STOPS + "…," + BROKEN))


def _names(line: str, word: str) -> list[str]:
    """What a word is known by besides itself: its shape, and that at the beginning of a line."""
    own = shape(word)
    return ["s" + own] + (["b" + own] if line else [])


def ends_of(token: str) -> tuple[int, ...]:
    """Buckets that a word at the end of a text is known by, that of its shape first."""
    if (known := _features.get(token)) is None:
        line, word = _plain(token)
        if len(_features) > 1 << 17:
            _features.clear()
        known = _features[token] = tuple(map(_bucket, [*_names(line, word), "w" + word])) if word else ()
    return known


def inner_counts(tokens: Counter, into: np.ndarray) -> None:
    """Add words inside texts: their beginnings too, so that the first half of a word is no word of its own."""
    at: list[int] = []
    n: list[int] = []
    begin: Counter = Counter()
    for token, k in tokens.items():
        line, word = _plain(token)
        if word:
            for name in _names(line, word):
                at.append(_bucket(name))
                n.append(k)
            begin[word] += k
    whole: Counter = Counter()
    for word, k in begin.items():
        for j in range(1, len(word) + 1):
            whole[word[:j]] += k
    at += [_bucket("w" + w) for w in whole]
    n += whole.values()
    np.add.at(into, np.array(at, np.int64), np.array(n, np.int64))


AFTER, FOREIGN = 1, 2


def core_of(text: str, after: np.ndarray) -> str:
    """The text without what was put after it; ``after`` marks the buckets of such words.

    The longest end of which at least half the words are put after texts goes, and a last word of a
    foreign shape, until neither is left.
    """
    t = text.rstrip()
    while True:
        tokens = [(m.start(), ends_of(m[0])) for m in list(TOKEN.finditer(t))[-LAST:]]
        put = [any(after[b] & AFTER for b in own) for _, own in tokens]
        n = len(put)
        cut = next((i for i in range(n) if put[i] and 2 * sum(put[i:]) >= n - i), None)
        if cut is None and n and tokens[-1][1] and after[tokens[-1][1][0]] & FOREIGN:
            cut = n - 1
        if cut is None:
            return t
        t = t[: tokens[cut][0]].rstrip()


def close_of(core: str) -> tuple[str, str]:
    """A text without its last punctuation, and the kind of that."""
    t = core.rstrip()
    if t.endswith(BROKEN):
        return t.rstrip(BROKEN).rstrip(), "broken"
    if t.endswith("…") or t.endswith("..."):
        return t.rstrip("…. "), "dots"
    if t and t[-1] in STOPS:
        return t.rstrip(STOPS + " "), "stop"
    if t and t[-1] in ",;:-(":
        return t.rstrip(" ,;:-("), t[-1]
    return t, "none"


def style_of(text: str) -> bool:
    """Whether a text sets stops at all: at least one per 400 characters, or lines."""
    inner = len(re.findall(r"[.?!।]\s|\n", text[: max(len(text) - 3, 0)]))
    return inner * 400 >= len(text) or inner > 3


def features(core: str, kind: str, punctuated: bool, at: bool) -> list[str]:
    core = KEY.sub("0", core)
    parts = SPLIT.split(core)
    last = parts[-1]
    label = LABEL.match(last)
    body = last[label.end() :] if label else last
    words = core.split()[-4:]
    own = body.split()
    out = [f"c{n}:{core[-n:]}" for n in (1, 2, 3, 4, 5, 6, 8, 10)]
    out += [f"w{n}:{' '.join(words[-n:])}" for n in (1, 2, 3, 4)]
    out += [f"wk:{kind}:{words[-1] if words else ''}", f"k:{kind}", f"ks:{kind}:{punctuated}", f"limit:{at}", f"limitk:{at}:{kind}"]
    if punctuated:
        out.append(f"n:{min(len(own), 8)}")
        out.append(f"nk:{min(len(own), 8)}:{kind}")
        if len(own) <= 4:
            out.append(f"own:{' '.join(own)}")
    if label and not own:
        out.append("label only")
    if ROW.match(last):
        out.append("row")
        out.append(f"row:{' '.join(last.split(' :', 1)[1].split())}")
        if len(parts) > 1:  # rows of a list end alike
            out.append(f"like the row before:{parts[-2].rstrip(STOPS + ' ').split()[-2:] == last.split()[-2:]}")
    if core.count("(") > core.count(")"):
        out.append("open bracket")
    return out


def hashed(rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows one after the other, and where each row begins."""
    at = np.cumsum([0, *map(len, rows)])[:-1]
    return np.array([zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIM for r in rows for f in r], np.int64), at


def score(weights: np.ndarray, rows: list[list[str]]) -> np.ndarray:
    """Probability of truncation of every row of features."""
    if not rows:
        return np.empty(0)
    return _probability(weights, *hashed(rows))


def _probability(weights: np.ndarray, f: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = np.add.reduceat(weights[f], at) + weights[DIM]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _size(text: str, unit: str) -> int:
    return len(text) if unit == "chars" else len(text.encode("utf-8", "surrogatepass"))


def _parts(text: str) -> list[tuple[int, int]]:
    """Begin and end of every sentence or line."""
    out, a = [], 0
    for m in SPLIT.finditer(text):
        out.append((a, m.start()))
        a = m.end()
    return [(a, b) for a, b in [*out, (a, len(text))] if text[a:b].strip()]


def examples(texts: list[str], limits: list[tuple[str, int]] = [], per_text: int = PER_TEXT, seed: int = 7) -> tuple[list[list[str]], list[int]]:  # noqa: B006
    """Artificially cut and intact endings of texts, ``per_text`` of either at most.

    Half the texts are taken as if their field had one of the ``limits`` (unit, length): an ending is at
    it if its own length is, and a longer text is cut there once.
    """
    x: list[list[str]] = []
    y: list[int] = []
    for text in texts:
        rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) + seed)  # the same in any batch
        parts = _parts(text)
        # the last part may be cut itself; the first may be a heading
        sure = [i for i in range(len(parts) - 1) if len(text[slice(*parts[i])].split()) >= 3]
        unit, limit = rng.choice(limits) if limits and rng.random() < 0.5 else ("chars", None)
        ends = lambda n: limit is not None and limit - NEAR <= _size(text[:n], unit) <= limit  # noqa: B023, E731

        def add(i: int, n: int, cut: bool) -> None:
            plain = rng.random() < 0.35  # as if the text set no stops  # noqa: B023
            a = parts[i][0]  # noqa: B023
            before = text[slice(*parts[i - 1])].strip() if i else ""  # noqa: B023
            head = (before.rstrip(STOPS) + " " if plain else before + "\n") if before else ""
            piece = text[a:n].strip()  # noqa: B023
            if cut:
                kind = rng.choice(["none"] * 7 + ["broken", "dots", "stop" if rng.random() < 0.15 else "none"])  # noqa: B023
            else:
                piece = piece.rstrip(STOPS + " ")
                kind = rng.choice(["none", "none", "none", "dots"] if plain else ["stop", "none", "none", "dots"])  # noqa: B023
            x.append(features(head + piece, kind, not plain, ends(n)))  # noqa: B023
            y.append(int(cut))

        made = 0
        if limit is not None and _size(text, unit) > limit:  # cut by the field
            n = limit if unit == "chars" else len(text.encode("utf-8", "surrogatepass")[:limit].decode("utf-8", "ignore"))
            i = next((i for i, (a, b) in enumerate(parts) if a < n < b and text[n:b].strip(STOPS + " ")), None)
            if i is not None:
                add(i, n, True)
                made = 1
        for i in rng.sample(sure, min(len(sure), per_text)):
            a, b = parts[i]
            add(i, b, False)
            if made >= per_text:
                continue
            # cut in transfer: anywhere before its last word ends, mostly inside a word
            bare = len(text[a:b].rstrip(STOPS + " "))
            n = rng.randrange(1, max(bare, 2))
            if rng.random() < 0.2 and " " in text[a : a + bare]:
                n = max(text[a : a + bare].rindex(" "), 1)
            add(i, a + n, True)
            made += 1
    return x, y


def learn(f: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.3, decay: float = 1e-6, seed: int = 3) -> np.ndarray:
    """Logistic regression by adaptive gradient steps over small batches of feature lists."""
    w = np.zeros(DIM + 1)
    g2 = np.full(DIM + 1, 1e-6)
    y_ = y.astype(float)
    size = np.diff(np.r_[at, len(f)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y_))
        for lo in range(0, len(order), 64):
            rows = order[lo : lo + 64]
            n = size[rows]
            take = np.repeat(at[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            cols = f[take]
            z = np.add.reduceat(w[cols], np.r_[0, np.cumsum(n)[:-1]]) + w[DIM]
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y_[rows]
            cols = np.r_[cols, np.full(len(rows), DIM)]
            grad = np.r_[np.repeat(err, n), err]
            hit, own = np.unique(cols, return_inverse=True)
            step = np.bincount(own, grad)
            g2[hit] += step**2
            w[hit] -= rate * (step + decay * w[hit]) / np.sqrt(g2[hit])
    return w.astype(np.float32)


def share_of_cut(p: np.ndarray, given: float = 0.5, rounds: int = 50, n: np.ndarray | None = None) -> float:
    """Share of positives among texts with these probabilities, ``n`` of each, which were learned at the share ``given`` (EM)."""
    share = 0.5
    p = np.clip(p, 1e-6, 1 - 1e-6)
    for _ in range(rounds if len(p) else 0):
        a, b = p * share / given, (1 - p) * (1 - share) / (1 - given)
        share = float(np.clip(np.average(a / (a + b), weights=n), 1e-3, 1 - 1e-3))
    return share


def best_threshold(p: np.ndarray, y: np.ndarray, share: float) -> float:
    """The threshold of best F1 on held-out examples, weighted so that ``share`` of them are positive."""
    return _best(p, y, 1 - y, share)


def _best(p: np.ndarray, cut: np.ndarray, intact: np.ndarray, share: float) -> float:
    if not cut.sum() or not intact.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(cut[order]) / cut.sum() * share
    wrong = np.cumsum(intact[order]) / intact.sum() * (1 - share)
    k = int(np.argmax(2 * hit / (hit + wrong + share)))
    least = p[order[k]]
    return float((least + p[order[k + 1]]) / 2 if k + 1 < len(p) else least)


def bins(p: np.ndarray) -> np.ndarray:
    """Numbers of the bins that probabilities are counted in, at most 60 * FINE + 1 whatever the corpus."""
    p = np.clip(p, 1e-13, 1 - 1e-13)
    return np.rint(np.log(p / (1 - p)) * FINE).astype(np.int32)


def middles(bin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-bin / FINE))


@dataclass
class Model:
    weights: np.ndarray
    after: np.ndarray  # marks the buckets of words that are put after texts
    threshold: float
    held_out: dict[str, float]  # examples, precision and recall at 0.5, share, and expected F1's threshold


def _form(texts: list[str]) -> list[str]:
    """Texts with look-alike and invisible characters unified, line by line."""
    lines = [t.split("\n") for t in texts]
    flat = iter(looks([x for ls in lines for x in ls]))
    return ["\n".join(next(flat) for _ in ls).strip() for ls in lines]


def _tail(form: str) -> str:
    """The last words of a text, from the beginning of the sentence or line the first of them stands in."""
    before = form.rsplit(None, KEPT)
    if len(before) <= KEPT:
        return form
    to = len(before[0]) + 1
    back = 1000
    while True:
        begin = 0
        for m in SPLIT.finditer(form, max(0, to - back), to + 1):
            begin = m.end()
        if begin or back >= to:
            return form[begin:].lstrip("\n")
        back *= 8


CLOSINGS = "key {key}, source string, h long, chars long, bytes long, tail string, punctuated boolean, words int, at array<int>, n array<long>, inner long"


def closings(df: DataFrame, key: str, text: str, source: str) -> Materialized:
    """The one pass over all texts: of each its closing and lengths; of each task the counts of the words inside texts."""
    t = F.col(text).cast("string")
    rows = df.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.xxhash64(t).alias("h"),
        F.char_length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), t.alias("t"),
    )
    schema = CLOSINGS.format(key=dict(rows.dtypes)["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, kind = np.zeros(WORDS, np.int64), 0, None
        for b in batches:
            kind = b["key"].type
            held: Counter = Counter()
            tails, styles, words = [], [], []
            for f in _form([t or "" for t in b["t"].to_pylist()]):
                tokens = TOKEN.findall(f)
                inside = tokens[:-LAST]
                held.update(inside)
                total += len(inside)
                tails.append(_tail(f))
                styles.append(style_of(f))
                words.append(len(tokens))
            inner_counts(held, counts)
            n = b.num_rows
            own = [b[c] for c in ("key", "source", "h", "chars", "bytes")]
            made = [pa.array(tails, pa.string()), pa.array(styles, pa.bool_()), pa.array(words, pa.int32())]
            none = [pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *made, *none], names=NAMES)
        if kind is not None:
            at = np.flatnonzero(counts)
            own = [pa.nulls(1, t) for t in (kind, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32())]
            made = [pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[at]], pa.list_(pa.int64())), pa.array([total], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *made], names=NAMES)

    return materialize(rows.mapInArrow(run, schema), "closings")


NAMES = [x.split()[0] for x in CLOSINGS.replace("{key}", "k").split(", ")]


def put_after(closed: DataFrame) -> np.ndarray:
    """Marks of the word buckets that stand at the end of texts far more often than inside, and of foreign shapes.

    Each distinct text counts once at its end, however many copies there are.  Texts of fewer than 16
    words show no inside and aren't counted.
    """
    inside = closed.filter("at is not null").select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy(F.col("x.at").alias("bucket")).agg(F.sum("x.n").alias("inner"))
    tails = closed.filter((F.col("at").isNull()) & (F.col("words") >= 2 * LAST)).groupBy("h").agg(F.min("tail").alias("tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [x for t in b["tail"].to_pylist() for x in {k for m in TOKEN.findall(t)[-LAST:] for k in ends_of(m)}]
            bucket, n = np.unique(np.array(at, np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], names=["bucket", "ends"])

    ends = tails.mapInArrow(run, "bucket int, ends long").groupBy("bucket").agg(F.sum("ends").alias("ends")).filter(F.col("ends") >= LEAST_ENDS)
    seen = closed.agg(F.sum("inner").alias("inner"), F.countDistinct(F.when(F.col("words") >= 2 * LAST, F.col("h"))).alias("texts")).first()
    base = np.log(max(LAST * seen["texts"], 1) / max(seen["inner"] or 0, 1))
    odds = F.log((F.col("ends") + 0.5) / (F.coalesce("inner", F.lit(0)) + 0.5)) - F.lit(float(base))
    found = ends.join(inside, "bucket", "left").filter(odds > ODDS).select("bucket").toArrow()  # at most WORDS rows
    after = np.zeros(WORDS, np.uint8)
    after[found["bucket"].to_numpy()] = AFTER
    usual = inside.filter((F.col("bucket") < SHAPES) & (F.col("inner") >= RARE * (seen["inner"] or 0))).select("bucket").toArrow()  # at most SHAPES rows
    foreign = np.full(SHAPES, FOREIGN, np.uint8)
    foreign[usual["bucket"].to_numpy()] = 0
    after[:SHAPES] |= foreign
    return after


def limits(closed: DataFrame) -> DataFrame:
    """(source, unit, top, docs): lengths in chars and bytes at which a source's texts pile up.

    Counted over all distinct texts; a source may have several.  At least PILE texts lie within NEAR
    below such a length, and they are PILE times as dense there as at the AROUND lengths below and above.
    """
    once = closed.filter("source is not null and chars > 0").groupBy("source", "h").agg(F.min("chars").alias("chars"), F.min("bytes").alias("bytes"))
    sizes = once.select("source", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("n")) for u in ("chars", "bytes")])).alias("x"))
    histogram = sizes.groupBy("source", "x.unit", "x.n").agg(F.count("*").alias("docs"))
    # a window holds the distinct lengths of a source, however many texts it has
    own = Window.partitionBy("source", "unit").orderBy("n")
    docs = lambda low, high: F.coalesce(F.sum("docs").over(own.rangeBetween(low, high)), F.lit(0))
    piles = histogram.select("source", "unit", F.col("n").alias("top"), "docs", docs(-NEAR, 0).alias("pile"), docs(-AROUND, AROUND).alias("around"), docs(1, 1).alias("above"))
    dense = F.col("pile") > PILE * (F.col("around") - F.col("pile")) * (NEAR + 1) / (2 * AROUND - NEAR)
    # the limit is the pile's last length
    return piles.filter((F.col("pile") >= PILE) & dense & (F.col("docs") > F.col("above") * 4)).select("source", "unit", "top", F.col("pile").alias("docs"))


FEW_SOURCES = 100_000


def _with_limits(closed: DataFrame, bounds: DataFrame, small: bool) -> DataFrame:
    """Closings with ``limit``: whether the text is at a limit of its source."""
    lists = bounds.groupBy("source").agg(*[F.collect_set(F.when(F.col("unit") == u, F.col("top"))).alias(f"_{u}") for u in ("chars", "bytes")])
    rows = closed.filter("at is null").drop("at", "n", "inner").join(F.broadcast(lists) if small else lists, "source", "left")
    at = lambda u: F.coalesce(F.exists(f"_{u}", lambda x: F.col(u).between(x - NEAR, x)), F.lit(False))
    return rows.withColumn("limit", at("chars") | at("bytes")).drop("_chars", "_bytes")


def _ending(tail: str, punctuated: bool, limit: bool, after: np.ndarray) -> tuple[list[str], bool]:
    """Features of a text's own ending, and whether anything is there to judge."""
    core, kind = close_of(core_of(tail, after))
    return features(core, kind, punctuated, limit), any(c.isalnum() for c in core)


def _parted(t: pa.Table, tops: list[tuple[str, int]], per_text: int, hold: bool) -> pa.Table:
    """Weights learned from the texts of one part, in blocks, and how many examples were learned from and held out."""
    t = t.sort_by([("h", "ascending"), ("t", "ascending")])  # an order that doesn't depend on the tasks
    hs = t["h"].to_numpy()
    t = t.filter(pa.array(np.r_[True, hs[1:] != hs[:-1]]))  # copies from several tasks
    lists, ys, left = [], [], 0
    for h, form in zip(t["h"].to_pylist(), _form(t["t"].to_pylist())):
        x, y = examples([form], tops, per_text)
        if hold and h % 5 == 0:
            left += len(y)
        elif x:
            f, at = hashed(x)
            lists += np.split(f.astype(np.int32), at[1:])
            ys += y
    w = np.zeros(DIM + 1)
    if lists:
        w = learn(np.concatenate(lists).astype(np.int64), np.cumsum([0, *map(len, lists)])[:-1], np.array(ys)).astype(float)
    parts = [(k, x.tobytes(), (x != 0).astype(np.int64).tobytes()) for k, x in enumerate(np.array_split(w, BLOCKS))]
    block, sums, seen = zip(*parts)
    number = t["part"][0].as_py()
    return pa.table([pa.array(block, pa.int32()), pa.array([number] * BLOCKS, pa.int64()), pa.array(sums, pa.binary()), pa.array(seen, pa.binary()),
                     pa.array([len(ys)] * BLOCKS, pa.int64()), pa.array([left] * BLOCKS, pa.int64())], names=PARTED_NAMES)


PARTED = "block int, part long, sums binary, seen binary, own long, out long"
PARTED_NAMES = [x.split()[0] for x in PARTED.split(", ")]


def _added(t: pa.Table) -> pa.Table:
    """A block's weights added up over parts, in their order."""
    t = t.sort_by("part")
    add = lambda c, kind: sum(np.frombuffer(x.as_py(), kind) for x in t[c]).tobytes()
    row = [t["block"][0].as_py(), t["part"][0].as_py(), add("sums", float), add("seen", np.int64), sum(t["own"].to_pylist()), sum(t["out"].to_pylist())]
    return pa.table([pa.array([v], f.type) for v, f in zip(row, t.schema)], names=PARTED_NAMES)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts without copies, so that texts are shuffled once, and a copied one once a task."""
    seen: set[int] = set()
    for b in batches:
        new = [h not in seen and not seen.add(h) for h in b["h"].to_pylist()]
        yield b.filter(pa.array(new, pa.bool_()))


def _learned(texts: DataFrame, n: int, tops: list[tuple[str, int]], per_text: int, hold: bool) -> tuple[np.ndarray, int, int]:
    """Weights from the examples of all ``n`` texts (h, t), and the numbers of examples learned from and held out."""
    part = F.pmod(F.shiftright("h", 20), F.lit(-(-n // PART)))  # h itself tells which texts are held out
    made = texts.mapInArrow(_once, "h long, t string").select(part.alias("part"), "h", "t").groupBy("part").applyInArrow(lambda t: _parted(t, tops, per_text, hold), PARTED)
    # 64 parts at a time, so that no task holds all of many
    some = made.withColumn("_some", F.shiftright("part", 6)).groupBy("block", "_some").applyInArrow(lambda t: _added(t.select(PARTED_NAMES)), PARTED)
    rows = some.groupBy("block").applyInArrow(_added, PARTED).toArrow().sort_by("block")
    sums, seen = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows[c]]) for c, kind in (("sums", float), ("seen", np.int64)))
    return (sums / np.maximum(seen, 1)).astype(np.float32), rows["own"][0].as_py(), rows["out"][0].as_py()


def _counted(found: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability, and numbers with y = 1 and with y = 0, of the bins; some 60,000 at most."""
    got = found.groupBy("bin").agg(F.sum(F.col("n") * F.col("y")).alias("cut"), F.sum(F.col("n") * (1 - F.col("y"))).alias("intact")).toArrow().sort_by("bin")
    return middles(got["bin"].to_numpy()), got["cut"].to_numpy(), got["intact"].to_numpy()


def _held_out(texts: DataFrame, w: np.ndarray, tops: list[tuple[str, int]], per_text: int) -> DataFrame:
    """(bin, y, n) of the examples of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = examples(_form(b["t"].to_pylist()), tops, per_text)
            each, n = np.unique(np.c_[bins(score(shared.value, x)), np.array(y, np.int32)], axis=0, return_counts=True) if x else (np.empty((0, 2)), np.empty(0))
            yield pa.RecordBatch.from_arrays([pa.array(each[:, 0], pa.int32()), pa.array(each[:, 1], pa.int32()), pa.array(n, pa.int64())], names=["bin", "y", "n"])

    return texts.select("t").mapInArrow(run, "bin int, y int, n long")


def _scored(rows: DataFrame, w: np.ndarray, after: np.ndarray) -> DataFrame:
    """(key, source, h, words, limit, p): every text's probability of truncation."""
    shared = rows.sparkSession.sparkContext.broadcast((w, after))  # DIM + 1 weights and WORDS flags, 2 MB
    kind = dict(rows.dtypes)["key"]
    kept = ["key", "source", "h", "words", "limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, after = shared.value
        for b in batches:
            found = [_ending(t or "", bool(s), bool(a), after) for t, s, a in zip(*(b[c].to_pylist() for c in ("tail", "punctuated", "limit")))]
            p = np.where([solid for _, solid in found], score(w, [x for x, _ in found]), 0.0) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.array(p, pa.float64())], names=[*kept, "p"])

    return rows.select(*kept, "tail", "punctuated").mapInArrow(run, f"key {kind}, source string, h long, words int, limit boolean, p double")


def _fit(df: DataFrame, text: str, closed: DataFrame, rows: DataFrame, bounds: DataFrame, max_docs: int | None, per_text: int) -> tuple[Model, DataFrame]:
    """The model, and every text scored with its weights."""
    after = put_after(closed)
    none = Model(np.zeros(DIM + 1, np.float32), after, 0.5, {"examples": 0})
    chosen = rows.filter("words > 0").select("h").distinct()
    chosen = chosen.orderBy("h").limit(max_docs) if max_docs else chosen
    least, n = chosen.agg(F.max("h"), F.count("*")).first()
    if least is None:
        return none, _scored(rows, none.weights, after)
    tops = [(r["unit"], r["top"]) for r in bounds.groupBy("unit", "top").agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "unit", "top").limit(MAX_LIMITS).collect()]
    t = F.col(text).cast("string")
    texts = df.select(t.alias("t")).filter(strip(F.col("t")) != "").select(F.xxhash64("t").alias("h"), "t").filter(F.col("h") <= least)
    once = lambda x: x.groupBy("h").agg(F.min("t").alias("t"))  # copies of a text are one example, combined on the map side
    # a fifth of the texts is held out, none of whose sentences is learned from
    w, own, out = _learned(texts, n, tops, per_text, True)
    held = once(texts.filter(F.col("h") % 5 == 0))
    if not own or not out:
        if own + out == 0:
            return none, _scored(rows, none.weights, after)
        w, own, _ = _learned(texts, n, tops, per_text, False)
        held, out = once(texts), own
    p, cut, intact = _counted(_held_out(held, w, tops, per_text))
    scored = materialize(_scored(rows, w, after), "scored").df
    # each distinct text once, by the ending of one of its copies
    ends = scored.filter("words > 0").filter(F.col("h") <= least).groupBy("h").agg(F.min(F.struct("limit", "p"))["p"].alias("p"))
    real, _, real_n = _counted(ends.select(_bin(F.col("p")).alias("bin"), F.lit(0).alias("y"), F.lit(1).alias("n")))
    share = share_of_cut(real, n=real_n)
    t = _best(p, cut, intact, share)
    said = p > 0.5
    right = float(cut[said].sum())
    figures = {"examples": own, "held_out": out, "precision": right / max(right + intact[said].sum(), 1), "recall": right / max(cut.sum(), 1), "share": share, "threshold": t}
    return Model(w, after, t, figures), scored


def _bin(p):
    """``bins`` as an expression."""
    kept = F.greatest(F.least(p, F.lit(1 - 1e-13)), F.lit(1e-13))
    return F.rint(F.log(kept / (1 - kept)) * FINE).cast("int")


def _prepared(df: DataFrame, key: str, text: str, source: str):
    closed = closings(df, key, text, source).df
    bounds = materialize(limits(closed), "limits").df
    # few sources have a limit; where they are many, the join is left to the planner
    return closed, bounds, _with_limits(closed, bounds, bounds.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES)


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_docs: int | None = None, per_text: int = PER_TEXT) -> Model:
    """Model from artificially cut sentences of all texts, or of ``max_docs`` of them, those of least hash.

    Examples are made and learned from where the texts are; the driver gets the weights and counts of
    probabilities.  With no sentence to learn from the weights are zero and no text counts as truncated.
    """
    closed, bounds, rows = _prepared(df, key, text, source)
    return _fit(df, text, closed, rows, bounds, max_docs, per_text)[0]


def truncated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", model: Model | None = None) -> DataFrame:
    """Probability of truncation of every text: (key, source, truncated, probability).

    Defined cases: null, empty and blank texts, and those without a letter or digit, are not
    truncated (probability 0); a null source is a source like any other but has no limit; texts of
    any length are read whole; repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored.
    """
    closed, bounds, rows = _prepared(df, key, text, source)
    m, scored = (model, _scored(rows, model.weights, model.after)) if model else _fit(df, text, closed, rows, bounds, None, PER_TEXT)
    return scored.select(F.col("key").alias(key), "source", (F.col("p") > m.threshold).alias("truncated"), F.col("p").alias("probability"))


def rates(scored: DataFrame) -> DataFrame:
    """Per source: texts, those truncated, and their share."""
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
        F.avg(F.col("truncated").cast("double")).alias("share"),
    )
