"""Encoding with a public byte-level BPE tokenizer, pre-tokenised without regular expressions.

The split pattern of the vocabulary is a finite automaton.  Every code point gets a class from a
table; white-space look-ahead and contractions are folded into the class from its neighbours; then
each class is a *function from state to state*, and functions compose associatively.  A batch is cut
into lanes, all lanes compose their functions side by side, a doubling scan over the lanes gives each
its entry state, and a second sweep marks the boundaries.  No step looks at one text at a time.

The slices between boundaries are merged by rank with a cache that lives as long as the worker.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Folder of the public vocabulary files; pass ``vocab`` to use another.
TOKENIZERS = os.environ.get("DHWANIKA_TOKENIZERS", "/opt/tokenizers")
VOCAB = "byte_bpe_50k.tiktoken"
CHUNK = 1 << 21  # code points handled at once, but for a longer single text
CACHE = 1 << 19  # slices kept by a worker

# symbols: what a code point does, neighbours taken into account
LETTER, NUMBER, OTHER, JOINT, WHITE, LONE, APO1, APO2 = range(8)
# states: what the slice that holds the last code point is
S_NONE, S_LETTER, S_NUMBER, S_OTHER, S_JOINT, S_WHITE, S_WANT1, S_WANT2 = range(8)
_RESET, _PAD = 8, 16  # symbols 8..15 open a text; 16 leaves the state alone


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a slice begins, by (symbol, state)."""
    step = np.zeros((17, 8), np.uint8)
    cut = np.ones((17, 8), bool)
    joins = {LETTER: (S_LETTER, (S_LETTER, S_JOINT)), NUMBER: (S_NUMBER, (S_NUMBER, S_JOINT)), OTHER: (S_OTHER, (S_OTHER, S_JOINT))}
    for sym, (to, holds) in joins.items():
        step[sym] = to
        cut[sym, list(holds)] = False
    step[LETTER, S_WANT2], step[LETTER, S_WANT1] = S_WANT1, S_NONE
    cut[LETTER, [S_WANT2, S_WANT1]] = False
    step[JOINT] = S_JOINT
    step[WHITE] = step[LONE] = S_WHITE
    cut[WHITE, S_WHITE] = False
    # an apostrophe opens a contraction only where a slice begins; else it is any other sign
    for sym, to in ((APO1, S_WANT1), (APO2, S_WANT2)):
        step[sym] = to
        step[sym, [S_OTHER, S_JOINT]] = S_OTHER
        cut[sym, [S_OTHER, S_JOINT]] = False
    step[_RESET : _RESET + 8] = step[:8, S_NONE][:, None]
    step[_PAD] = np.arange(8)
    cut[_PAD] = False
    return step, cut


STEP, CUT = _automaton()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    global _classes
    if _classes is None:
        major = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
        t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        major = np.array(major)
        t[major == "L"], t[major == "N"] = LETTER, NUMBER
        # the White_Space property: separators and these controls
        t[(major == "Z")] = WHITE
        t[[9, 10, 11, 12, 13, 0x85]] = WHITE
        _classes = t
    return _classes


def symbols(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``begins`` are the places where texts begin."""
    sym = classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    last = first[1:]
    nxt = np.empty(n, np.uint8)
    nxt[:-1], nxt[-1] = sym[1:], WHITE
    white = sym == WHITE
    before_solid = white & ~last & (nxt != WHITE)
    space = points == 0x20
    apo = np.flatnonzero(points == 0x27)
    sym[before_solid & space] = JOINT
    sym[before_solid & ~space] = LONE
    if len(apo):
        at = lambda k: np.where(apo + k < n, points[np.minimum(apo + k, n - 1)], 0)
        one, two = at(1), at(2)
        room1 = ~last[apo]
        room2 = room1 & ~last[np.minimum(apo + 1, n - 1)]
        pair = one * 256 + two
        short = room1 & np.isin(one, [ord(c) for c in "stmd"])
        long = room2 & (one < 128) & np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        sym[apo[short]] = APO1
        sym[apo[long]] = APO2
    sym[begins] += _RESET
    return sym


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Places where slices begin, by composing transition functions over lanes."""
    n = len(sym)
    width = max(1, int(np.sqrt(n / 2)))
    lanes = -(-n // width)
    grid = np.full(lanes * width, _PAD, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T)
    flat = STEP.ravel().astype(np.intp)
    # each lane's function, all states at once
    f = np.tile(np.arange(8, dtype=np.intp), (lanes, 1))
    for row in grid:
        f = flat[(row.astype(np.intp) * 8)[:, None] + f]
    # inclusive doubling scan: f[i] becomes the composition of lanes 0..i
    d = 1
    while d < lanes:
        f[d:] = np.take_along_axis(f[d:], f[:-d], axis=1)
        d *= 2
    state = np.full(lanes, S_NONE, np.intp)
    state[1:] = f[:-1, S_NONE]
    marks = np.empty(grid.shape, bool)
    cut = CUT.ravel()
    for j, row in enumerate(grid):
        at = row.astype(np.intp) * 8 + state
        marks[j] = cut[at]
        state = flat[at]
    return np.flatnonzero(marks.T.ravel()[:n])


class Encoder:
    """Byte-level BPE by the ranks of a ``.tiktoken`` file."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of least rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged away
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two parts has changed since
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        group: list[str] = []
        size = 0
        for t in texts:
            if group and size + len(t) > CHUNK:
                out += self._encode(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + (self._encode(group) if group else [])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        lengths = np.array([len(t) for t in texts])
        joined = "".join(texts)
        if not joined:
            return [[] for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = np.cumsum(lengths) - lengths
        at = boundaries(symbols(points, begin[lengths > 0]))
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int8)
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        data = joined.encode()
        edge = [*place[at].tolist(), len(data)]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        first = np.searchsorted(at, [*begin, len(points)]).tolist()
        out = []
        for k in range(len(texts)):
            ids: list[int] = []
            a = edge[first[k]] if first[k] < len(edge) else 0
            for b in edge[first[k] + 1 : first[k + 1] + 1]:
                piece = data[a:b]
                known = cache.get(piece)
                if known is None:
                    known = cache[piece] = self.merge(piece)
                ids += known
                a = b
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset of every token in the UTF-8 text."""
        at, out = 0, []
        for i in ids:
            out.append(at)
            at += len(self.bytes_of[i])
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; its cache outlives the task."""
    key = hash(shared.value)
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def vocabulary(spark: SparkSession, vocab: str | None = None):
    """Broadcast the vocabulary file (under 1 MB, whatever the corpus)."""
    with open(vocab or os.path.join(TOKENIZERS, VOCAB), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _column(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    from pyspark.sql import functions as F

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows, dict(rows.dtypes)["key"]


def encode(df: DataFrame, key: str, text: str, vocab: str | None = None, offsets: bool = False) -> DataFrame:
    """Token ids of every text, without special tokens.

    Returns (key under its own name, ids array<int>) and, if asked for, offsets array<int>: the byte
    at which each token begins in the UTF-8 text.  The vocabulary's special strings are plain text.

    Defined cases: empty and null texts get an empty list; a blank text is encoded as it stands;
    texts of any length are encoded whole; repeated keys give repeated rows; an empty table gives no
    rows; other columns are ignored.
    """
    shared = vocabulary(df.sparkSession, vocab)
    rows, kind = _column(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            ids = enc.encode_batch([t or "" for t in b["text"].to_pylist()])
            cols = [b["key"], pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                cols.append(pa.array([enc.offsets(x) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "ids", "offsets"][: len(cols)])

    schema = f"key {kind}, ids array<int>" + ", offsets array<int>" * offsets
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, vocab: str | None = None) -> DataFrame:
    """(key, tokens): size of every text in tokens; 0 for empty and null texts."""
    shared = vocabulary(df.sparkSession, vocab)
    rows, kind = _column(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            ids = enc.encode_batch([t or "" for t in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([len(x) for x in ids], pa.int64())], names=["key", "tokens"])

    return rows.mapInArrow(run, f"key {kind}, tokens long").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, vocab: str | None = None) -> DataFrame:
    """(key, text) from token ids; null ids give a null text."""
    from pyspark.sql import functions as F

    shared = vocabulary(df.sparkSession, vocab)
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(texts, pa.string())], names=["key", "text"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, text string").withColumnRenamed("key", key)
