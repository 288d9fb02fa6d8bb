"""Mapping freely entered values to a canonical list.

Values are made distinct, normalised to phonetic keys that Devanagari and Latin spellings share, and
their stretches of words are looked up in an inverted index of character n-grams over the list.  Every
entry whose weighted cosine reaches ``THRESHOLD`` is a candidate, whatever its rank; an exact check
counts the edits between it and the stretch.  The score is half cosine, half likeness by edits, less
what the stretch leaves aside of the value; the best canonical value is taken if its score reaches
``ACCEPT`` and leads all others by ``MARGIN``, else the value is reported as matching nothing.

N-grams are hashed into ``BUCKETS`` buckets, and their weights are counted once over the whole list, so
what is broadcast (one number a bucket) never grows.  The list is a distributed table: it is divided into
blocks, the values into chunks, and a task meets one block and one chunk, the block's entries first.
The score of a pair depends on nothing else, so any number of blocks gives the same result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import HOT_ROWS, hot_keys, join_salted, materialize, shuffle_partitions, strip
from .looks import look, looks
from .romanise import romanise

BLOCK = 50_000  # entries of the list that a task indexes
CHUNK = 2_048  # values that a task looks up in a block, at least; where there are many, as many as a block has entries
BUCKETS = 1 << 18
SIZES = (2, 3)  # signs of an n-gram
#: Least cosine of a candidate, most edits per sign of the entry, least score and least lead over another value.
THRESHOLD, MOST_EDITS, ACCEPT, MARGIN = 0.3, 0.37, 0.35, 0.01
COSINE = 0.5  # share of the cosine in the score; the rest is the likeness by edits
UNCOVERED = 0.3  # weight of the part of a value that a match leaves aside
ABBREVIATION = 0.2  # edits per sign that an abbreviation counts as
SPANS = 1 << 17  # stretches of words that are looked up at once
CELLS = 1 << 22  # cells of a table that is worked on at once

# Latin spellings of one sound, longest first; fixed rules of the key.
FOLD = [("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("w", "v"), ("f", "ph"), ("z", "j"), ("q", "k"), ("x", "ks")]
# Sounds that recognisers and typists confuse: aspiration, length of diphthongs, retroflex, v/b.
ROUGH = [("chh", "c"), ("ch", "c"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("th", "t"), ("dh", "d"), ("ph", "p"), ("bh", "b"), ("sh", "s"), ("v", "b"), ("au", "o"), ("ai", "e"), ("y", "i")]


def _key(looked: str) -> str:
    t = romanise(looked.lower())
    t = "".join(c if c.isalnum() else " " if c.isspace() or c in "-_/.,|" else "" for c in unicodedata.normalize("NFKD", t))
    for a, b in FOLD:
        t = t.replace(a, b)
    return " ".join(t.split())


def key(text: str) -> str:
    """Sounds of a text in Latin letters, words divided by single blanks."""
    return _key(look(text))


def rough(k: str) -> str:
    for a, b in ROUGH:
        k = k.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", k)


def _bare(looked: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", looked.lower()) if c.isalnum() or unicodedata.category(c)[0] == "M" and not unicodedata.name(c, "").endswith("NUKTA"))


def bare(text: str) -> str:
    """A text's own signs for counting edits: case, blanks, hyphens and nuktas aside."""
    return _bare(look(text))


def _number(looked: str) -> str | None:
    t = "".join(str(unicodedata.digit(c)) if c.isdecimal() else c for c in looked.strip())
    m = re.fullmatch(r"([-+]?)0*(\d+)(?:[.,](\d*))?", t)
    if not m:
        return None
    rest = (m[3] or "").rstrip("0")
    return m[1].replace("+", "") + m[2] + ("." + rest if rest else "")


def number(text: str) -> str | None:
    """A text that is a number, digits of any script, in its plain form; else null."""
    return _number(look(text))


def _hashed(strings: list[str], tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the string and bucket of every n-gram of all strings with their borders."""
    padded = [f"\x02{s}\x03" for s in strings]
    p = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(s) for s in padded], np.int64)
    of = np.repeat(np.arange(len(strings)), size)
    left = np.cumsum(size)[of] - np.arange(len(p))  # code points from here to the string's end
    h = np.full(len(p), tag << 40, np.uint64)  # far from any code point, so that tags never meet
    own, out = [], []
    for n in range(1, max(SIZES) + 1):
        shifted = np.zeros(len(p), np.uint64)
        shifted[: max(len(p) - n + 1, 0)] = p[n - 1 :]
        h = (h ^ shifted) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        h ^= h >> np.uint64(29)
        if n in SIZES:
            own.append(of[left >= n])
            out.append((h[left >= n] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(own), np.concatenate(out)


def grams(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key's number, bucket, count) of the n-grams of every key and of its rough form, sorted."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    fine, coarse = _hashed(keys, 1), _hashed([rough(k) for k in keys], 2)
    cell, n = np.unique(np.r_[fine[0], coarse[0]] * BUCKETS + np.r_[fine[1], coarse[1]], return_counts=True)
    return cell // BUCKETS, cell % BUCKETS, n.astype(float)


def weights(held: np.ndarray, entries: int) -> np.ndarray:
    """Weight of every bucket by the number of entries that hold it."""
    return np.log(1 + entries / np.maximum(held, 1)).astype(np.float32)


class Index:
    """Inverted index of a block: the postings of every bucket, entries scaled to unit length."""

    def __init__(self, keys: list[str], weight: np.ndarray):
        self.size, self.weight = len(keys), weight
        own, bucket, n = grams(keys)
        w = n * weight[bucket]
        norm = np.sqrt(np.bincount(own, w * w, self.size))
        order = np.argsort(bucket, kind="stable")
        self.entry, self.value = own[order], (w / norm[own])[order]
        self.buckets, self.first = np.unique(bucket[order], return_index=True)
        self.last = np.r_[self.first[1:], len(order)]

    def search(self, keys: list[str], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key's number, entry, cosine) of every pair that reaches the threshold."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        step = max(1, min(1024, CELLS // max(self.size, 1)))
        for lo in range(0, len(keys) if self.size else 0, step):
            part = keys[lo : lo + step]
            own, bucket, n = grams(part)
            q = n * self.weight[bucket]
            norm = np.sqrt(np.bincount(own, q * q, len(part)))
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            known = self.buckets[at] == bucket
            own, q, at = own[known], q[known], at[known]
            n = self.last[at] - self.first[at]
            place = np.repeat(self.first[at] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n) + np.arange(n.sum())
            score = np.bincount(np.repeat(own, n) * self.size + self.entry[place], np.repeat(q, n) * self.value[place], len(part) * self.size)
            score = score.reshape(len(part), self.size) / np.maximum(norm, 1e-9)[:, None]
            i, j = np.nonzero(score >= threshold)
            found.append((i + lo, j, score[i, j]))
        return tuple(np.concatenate(x) for x in zip(*found))


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Insertions, deletions, substitutions and swaps of neighbours between the strings of each pair.

    All pairs of a group move through the table together; alike lengths stand together.
    """
    la, lb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    out = np.zeros(len(a), np.int64)
    order = np.argsort(la + lb, kind="stable")
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * (la[order[at + n]] + lb[order[at + n]] + 2) <= CELLS // 32:
            n += 1
        own = order[at : at + n]
        out[own] = _together([a[i] for i in own], [b[i] for i in own], la[own], lb[own])
        at += n
    return out


def _together(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, wa, wb = len(a), max(int(la.max()), 1), max(int(lb.max()), 1)
    x, y = (np.ascontiguousarray(np.array(s, f"<U{w}").view(np.uint32).reshape(n, w).T) for s, w in ((a, wa), (b, wb)))
    rows = np.arange(n)
    before, row = None, np.repeat(np.arange(wb + 1, dtype=np.int32)[:, None], n, 1)
    found = row[lb, rows].copy()
    for i in range(1, wa + 1):
        new = np.empty_like(row)
        new[0] = i
        for j in range(1, wb + 1):
            d = np.minimum(np.minimum(row[j], new[j - 1]) + 1, row[j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1:
                swapped = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                d = np.where(swapped, np.minimum(d, before[j - 2] + 1), d)
            new[j] = d
        before, row = row, new
        ends = la == i
        found[ends] = row[lb[ends], rows[ends]]
    return found


class Words:
    """Key and own signs of single words, kept: the words of a list recur in many values."""

    def __init__(self):
        self.known: dict[str, tuple[str, str]] = {}

    def __getitem__(self, word: str) -> tuple[str, str]:
        if (found := self.known.get(word)) is None:
            if len(self.known) > 1 << 17:
                self.known.clear()
            found = self.known[word] = (_key(word).replace(" ", ""), _bare(word))
        return found


Span = tuple[str, str, bool]  # key without blanks, own signs, whether it ends with a full stop


def spans(looked: str, width: int, words: Words) -> Iterator[tuple[Span, float]]:
    """Stretches of the value's words up to a word longer than any entry, with what they leave aside."""
    own = looked.split()
    parts = [words[w] for w in own]
    size = [len(w) for w in own]
    total = sum(size)
    for n in range(min(len(own), width + 1), 0, -1):
        for i in range(len(own) - n + 1):
            if k := "".join(p[0] for p in parts[i : i + n]):
                yield (k, "".join(p[1] for p in parts[i : i + n]), own[i + n - 1].endswith(".")), 1 - sum(size[i : i + n]) / total


class Matcher:
    """Score of values against one block of the list: (key without blanks, canonical value, own signs of its spellings)."""

    def __init__(self, entries: list[tuple[str, str, list[str]]], weight: np.ndarray):
        self.keys, self.canon = [k for k, _, _ in entries], [c for _, c, _ in entries]
        self.bares = [sorted({b for b in bs if b}) for _, _, bs in entries]
        self.length = np.array([len(k) for k in self.keys], np.int64)
        self.index = Index(self.keys, weight)

    def hits(self, own: list[Span]) -> dict[Span, list[tuple[str, float, float, float]]]:
        """(canonical value, score, cosine, edits per sign) of every entry that passes, for each stretch of words."""
        i, j, cosine = self.index.search([k for k, _, _ in own])
        ratio = np.full(len(i), np.inf)
        # a difference of lengths takes as many edits
        size = np.array([len(k) for k, _, _ in own], np.int64)
        near = np.flatnonzero(np.abs(size[i] - self.length[j]) <= MOST_EDITS * self.length[j] + 1e-9)
        ratio[near] = edits([own[k][0] for k in i[near]], [self.keys[k] for k in j[near]]) / self.length[j[near]]
        pair, a, b = [], [], []
        for p, (s, e) in enumerate(zip(i.tolist(), j.tolist())):
            text = own[s][1]
            for spelt in self.bares[e]:
                if abs(len(text) - len(spelt)) <= MOST_EDITS * len(spelt) + 1e-9:
                    pair.append(p)
                    a.append(text)
                    b.append(spelt)
            if own[s][2] and len(own[s][0]) >= 4 and self.keys[e].startswith(own[s][0]):
                ratio[p] = min(ratio[p], ABBREVIATION)
        if pair:
            np.minimum.at(ratio, pair, edits(a, b) / np.array([len(x) for x in b]))
        out: dict[Span, list] = defaultdict(list)
        for p in np.flatnonzero(ratio <= MOST_EDITS).tolist():
            c, r = float(cosine[p]), float(ratio[p])
            out[own[i[p]]].append((self.canon[j[p]], COSINE * c + (1 - COSINE) * (1 - r), c, r))
        return out

    def rank(self, looked: list[str], width: int, words: Words) -> list[list[tuple[float, str, float, float]]]:
        """The two canonical values of best score for every value: (score, canonical value, cosine, edits per sign)."""
        best: list[dict[str, tuple[float, float, float]]] = [{} for _ in looked]
        held: list[tuple[int, Span, float]] = []  # of a long value its stretches are settled in parts

        def settle() -> None:
            hits = self.hits(list(dict.fromkeys(s for _, s, _ in held)))
            for i, s, aside in held:
                for c, score, cosine, ratio in hits.get(s, ()):
                    v = (score - UNCOVERED * aside, cosine, -ratio)
                    if c not in best[i] or v > best[i][c]:
                        best[i][c] = v
            held.clear()

        for i, t in enumerate(looked):
            for s, aside in spans(t, width, words):
                held.append((i, s, aside))
                if len(held) >= SPANS:
                    settle()
        settle()
        # a second one is needed for the lead; a third can't be second in any block's company
        order = (sorted(b.items(), key=lambda x: (-x[1][0], x[0]))[:2] for b in best)
        return [[(v[0], c, v[1], -v[2]) for c, v in o] for o in order]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, canon) to (canon, number, bare, key, words)."""
    for b in batches:
        seen = looks(b["form"].to_pylist())
        keys = [_key(t) for t in seen]
        cols = [[_number(t) for t in seen], [_bare(t) for t in seen], [k.replace(" ", "") for k in keys], [k.count(" ") + 1 for k in keys]]
        arrays = [pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([b["canon"], *arrays], names=["canon", "number", "bare", "key", "words"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, n) to (value, n, number, bare, looked)."""
    for b in batches:
        seen = looks(b["value"].to_pylist())
        cols = [pa.array(x, pa.string()) for x in ([_number(t) for t in seen], [_bare(t) for t in seen], seen)]
        yield pa.RecordBatch.from_arrays([b["value"], b["n"], *cols], names=["value", "n", "number", "bare", "looked"])


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bucket, n = np.unique(grams(b["key"].to_pylist())[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n.astype(np.int64))], names=["bucket", "n"])


def _by_block(weight, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block's entries, then of a chunk's values, to the values' best two of the block."""
        kind = pa.list_(pa.struct([("score", pa.float64()), ("canon", pa.string()), ("cosine", pa.float64()), ("edits", pa.float64())]))
        entries: list[tuple[str, str, list[str]]] = []
        m, words = None, Words()
        for b in batches:
            first = int(b["is_value"].to_numpy(zero_copy_only=False).sum())
            e = b.slice(0, b.num_rows - first)
            entries += zip(e["key"].to_pylist(), e["canon"].to_pylist(), e["bares"].to_pylist())
            v = b.slice(b.num_rows - first)
            for lo in range(0, v.num_rows, 512):
                m = m or Matcher(entries, weight.value)
                part = v.slice(lo, 512)
                found = m.rank(part["text"].to_pylist(), width, words)
                out = [[{"score": s, "canon": c, "cosine": x, "edits": r} for s, c, x, r in f] for f in found]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(out, kind)], names=["id", "ranked"])

    return run


RANKED = "id long, ranked array<struct<score:double,canon:string,cosine:double,edits:double>>"


def canonicalise(df: DataFrame, key_col: str, value: str, entries: DataFrame, form: str, canon: str, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Canonical value of every row's entered value.

    ``entries``: (form, canon), spellings and the canonical value they stand for.  Returns (key, value,
    canon, score, cosine); ``canon`` is null where nothing of the list is meant, or two values are
    equally near.

    Defined cases: null values give a null canon; blank values, and values without letters or digits,
    match nothing; a number matches only the same number; a value that equals a spelling of just one
    canonical value (case, blanks and look-alikes aside) means that; ties between canonical values match
    nothing; entries with a null or blank form or canon are left out; an empty list matches nothing;
    values of any length are read whole; repeated rows are kept; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key_col).alias("key"), F.col(value).cast("string").alias("value"))
    distinct = rows.filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    spread = distinct.repartition(shuffle_partitions(spark))  # few bytes, but each takes its time
    values = materialize(spread.mapInArrow(_held, "value string, n long, number string, bare string, looked string").withColumn("id", F.monotonically_increasing_id()), "values")
    listed = (
        entries.select(F.col(form).cast("string").alias("form"), strip(F.col(canon).cast("string")).alias("canon"))
        .dropna().filter((strip(F.col("form")) != "") & (F.col("canon") != "")).distinct()
    )
    forms = materialize(listed.mapInArrow(_listed, "canon string, number string, bare string, key string, words int"), "list")
    # spellings of two canonical values decide nothing by themselves
    one = lambda c: forms.df.filter(f"{c} <> ''").groupBy(c).agg(F.min("canon").alias(f"by_{c}"), F.max("canon").alias("_m")).filter(f"by_{c} = _m").drop("_m")
    settled = values.df.join(one("number"), "number", "left").join(one("bare"), "bare", "left")
    settled = settled.select("id", F.when(F.col("number").isNotNull(), F.col("by_number")).otherwise(F.col("by_bare")).alias("sure"), "number", "looked")
    state = materialize(settled, "settled")
    sure = state.df.filter("sure is not null").select("id", F.struct(F.lit(1.0).alias("score"), F.col("sure").alias("canon"), F.lit(1.0).alias("cosine")).alias("best"))
    open_ = state.df.filter("sure is null and number is null").select("id", F.col("looked").alias("text"))

    spelt = forms.df.filter("key <> ''").groupBy("key", "canon").agg(F.collect_set("bare").alias("bares"), F.max("words").alias("words"))
    counted = spelt.mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    held = np.zeros(BUCKETS)
    held[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    number_of, width = spelt.agg(F.count("*"), F.coalesce(F.max("words"), F.lit(1))).first()
    asked_for, total, most = values.df.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(weights(held, number_of))  # BUCKETS numbers, 1 MB
    chunk = max(chunk, min(block, math.ceil(asked_for / shuffle_partitions(spark))))
    blocks, chunks = max(1, math.ceil(number_of / block)), max(1, math.ceil(asked_for / chunk))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    index = spelt.withColumn("at", part(blocks, "key", "canon") * chunks).withColumn("c", each(chunks)).select(
        (F.col("at") + F.col("c")).alias("at"), F.lit(False).alias("is_value"), "key", "canon", "bares", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text")
    )
    asked = open_.withColumn("at", part(chunks, "id")).withColumn("b", each(blocks)).select(
        (F.col("b") * chunks + F.col("at")).alias("at"), F.lit(True).alias("is_value"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("canon"),
        F.lit(None).cast("array<string>").alias("bares"), "id", "text",
    )
    met = index.unionByName(asked).repartitionById(blocks * chunks, "at").sortWithinPartitions("is_value")
    ranked = met.drop("at").mapInArrow(_by_block(shared, width), RANKED)
    # the best of every canonical value over all blocks, then the best value and the one behind it
    by_canon = ranked.select("id", F.explode("ranked").alias("x")).groupBy("id", F.col("x.canon").alias("canon")).agg(F.max("x").alias("x"))
    order = by_canon.groupBy("id").agg(
        F.max_by(F.struct("x.score", "x.canon", "x.cosine"), F.col("x.score")).alias("best"), F.sort_array(F.collect_list("x.score"), False).alias("scores")
    )
    lead = F.coalesce(F.get("scores", F.lit(0)) - F.get("scores", F.lit(1)), F.lit(1.0))
    found = order.filter((F.col("best.score") >= ACCEPT) & (lead >= MARGIN)).select("id", "best").unionByName(sure)
    answer = values.df.select("id", "value").join(found, "id", "left").select("value", "best.canon", "best.score", "best.cosine")
    hot = hot_keys(values.df, "value", "n", total) if most > HOT_ROWS else []
    out = join_salted(rows.filter("value is not null"), answer, "value", "key", hot).select("key", "value", "canon", "score", "cosine")
    nulls = rows.filter("value is null").select("key", "value", *[F.lit(None).cast(t).alias(c) for c, t in (("canon", "string"), ("score", "double"), ("cosine", "double"))])
    return out.unionByName(nulls).withColumnRenamed("key", key_col)
