"""Word alignment of many pairs at once, in numpy over Arrow arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

EQUAL, SUBSTITUTE, DELETE, INSERT = range(4)
NAMES = ("equal", "substitute", "delete", "insert")
CELLS = 1 << 22  # cells of tables that are held at once


def codes_of(*lists: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
    """Words of arrays of word lists as numbers: the flat numbers and where each row begins, for every array, and the words.

    A null list is an empty one.
    """
    begins, flats = [], []
    for x in lists:
        size = np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        begins.append(np.r_[0, np.cumsum(size)])
        flats.append(x.flatten())
    coded = pa.chunked_array([pa.concat_arrays(flats)]).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    cut = np.cumsum([0, *map(len, flats)])
    return [codes[a:b] for a, b in zip(cut, cut[1:])], begins, coded.dictionary.to_pylist()


def operations(ref: list[np.ndarray], hyp: list[np.ndarray]) -> list[np.ndarray]:
    """Operations that make every hypothesis of its reference with least edits, both as arrays of word numbers.

    Of alignments with equally few edits this is the one found from the end, after common head and tail
    are set aside, by taking a deletion where it leads to a least path, else an insertion where the cell
    before it is one better than the diagonal, else the diagonal.
    """
    inner, ends = [], []
    for r, h in zip(ref, hyp):
        least = min(len(r), len(h))
        same = r[:least] == h[:least]
        head = least if same.all() else int(same.argmin())
        rest = least - head
        same = r[len(r) - rest :][::-1] == h[len(h) - rest :][::-1]
        tail = rest if same.all() else int(same.argmin())
        ends.append((head, tail))
        inner.append((r[head : len(r) - tail], h[head : len(h) - tail]))
    la, lb = (np.array([len(x[k]) for x in inner], np.int64) for k in (0, 1))
    order = np.lexsort((lb, la))  # alike lengths together, so that little is padded
    out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(ref)
    at = 0
    while at < len(order):
        n, wide = 1, int(lb[order[at]])
        while at + n < len(order):
            w = max(wide, int(lb[order[at + n]]))
            if (n + 1) * (la[order[at + n]] + 1) * (w + 1) > CELLS:
                break
            n, wide = n + 1, w
        own = order[at : at + n]
        for k, ops in zip(own, _traced([inner[k][0] for k in own], [inner[k][1] for k in own])):
            head, tail = ends[k]
            out[k] = np.r_[np.full(head, EQUAL, np.uint8), ops, np.full(tail, EQUAL, np.uint8)]
        at += n
    return out


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _traced(ref: list[np.ndarray], hyp: list[np.ndarray]) -> list[np.ndarray]:
    """All pairs side by side through one table; of a table too large to hold, some rows are kept and the others made again."""
    n = len(ref)
    a, b = _padded(ref, -1), _padded(hyp, -2)
    wa, wb = a.shape[1], b.shape[1]
    places = np.arange(wb + 1, dtype=np.int32)

    def row_after(row: np.ndarray, i: int) -> np.ndarray:
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i - 1 : i] != b), out=new[:, 1:])
        # insertions run along the row
        return np.minimum.accumulate(new - places, axis=1) + places

    step = max(wa, 1) if n * (wa + 1) * (wb + 1) <= CELLS else max(1, math.isqrt(wa))
    row = np.repeat(places[None], n, 0)
    kept = {0: row}
    if step < wa:
        for i in range(1, wa + 1):
            row = row_after(row, i)
            if i % step == 0:
                kept[i] = row
    i, j = (np.array([len(x) for x in xs], np.int64) for xs in (ref, hyp))
    back = np.empty((n, wa + wb), np.uint8)
    size = np.zeros(n, np.int64)
    for base in range((wa - 1) // step * step if wa else 0, -1, -step):
        table = [kept[base]]
        for k in range(base + 1, min(base + step, wa) + 1):
            table.append(row_after(table[-1], k))
        table = np.stack(table)
        while len(own := np.flatnonzero(i > base)):
            x, y = i[own] - base, j[own]
            before = np.maximum(y - 1, 0)
            here, up, left, diagonal = table[x, own, y], table[x - 1, own, y], table[x, own, before], table[x - 1, own, before]
            gone = (y == 0) | (up + 1 == here)
            put = ~gone & (left + 1 == diagonal)
            differs = a[own, i[own] - 1] != b[own, before] if wb else np.ones(len(own), bool)
            back[own, size[own]] = np.where(gone, DELETE, np.where(put, INSERT, np.where(differs, SUBSTITUTE, EQUAL)))
            size[own] += 1
            i[own] -= ~put
            j[own] -= ~gone
    return [np.r_[np.full(j[k], INSERT, np.uint8), back[k, : size[k]][::-1]] for k in range(n)]


def flat_operations(ref: pa.Array, hyp: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], list[str]]:
    """Operations of all rows one after the other, where each row begins, and the rows' words as ``codes_of``."""
    codes, begins, words = codes_of(ref, hyp)
    rows = [[c[x:y] for x, y in zip(b, b[1:])] for c, b in zip(codes, begins)]
    ops = operations(*rows)
    begin = np.cumsum([0, *map(len, ops)])
    return np.concatenate([np.empty(0, np.uint8), *ops]), begin, codes, begins, words


def weighed(ref: pa.Array, hyp: pa.Array, weight) -> pa.StructArray:
    """struct<edits, weight, total, words> of every row; ``weight`` gives the weights of a list of words.

    Substitutions and deletions weigh as the reference word, insertions as the hypothesis word.
    """
    ops, begin, codes, begins, words = flat_operations(ref, hyp)
    w = np.array(weight(words), float)
    # every operation but an insertion takes the next reference word, all but a deletion the next of the hypothesis
    r, h = np.cumsum(ops != INSERT) - 1, np.cumsum(ops != DELETE) - 1
    cost = np.zeros(len(ops))
    own, other = (ops == SUBSTITUTE) | (ops == DELETE), ops == INSERT
    cost[own], cost[other] = w[codes[0][r[own]]], w[codes[1][h[other]]]
    row = np.repeat(np.arange(len(ref)), np.diff(begin))
    total = np.bincount(np.repeat(np.arange(len(ref)), np.diff(begins[0])), w[codes[0]], len(ref))
    return pa.StructArray.from_arrays(
        [
            pa.array(np.bincount(row[ops != EQUAL], minlength=len(ref)), pa.int64()), pa.array(np.bincount(row, cost, len(ref)), pa.float64()),
            pa.array(total, pa.float64()), pa.array(np.diff(begins[0]), pa.int64()),
        ],
        names=["edits", "weight", "total", "words"],
    )


def chunked(ref: pa.Array, hyp: pa.Array) -> pa.ListArray:
    """Runs of one operation of every row: list<struct<type, ref_start, ref_end, hyp_start, hyp_end>>."""
    ops, begin, _, begins, _ = flat_operations(ref, hyp)
    row = np.repeat(np.arange(len(ref)), np.diff(begin))
    first = np.flatnonzero(np.r_[True, (ops[1:] != ops[:-1]) | (row[1:] != row[:-1])]) if len(ops) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(ops)][: len(first)]
    r, h = np.r_[0, np.cumsum(ops != INSERT)], np.r_[0, np.cumsum(ops != DELETE)]
    own = row[first]
    columns = [x[at] - b[own] for x, b in ((r, begins[0]), (h, begins[1])) for at in (first, last)]
    types = pa.array([NAMES[o] for o in ops[first]], pa.string())
    runs = pa.StructArray.from_arrays([types, *[pa.array(c, pa.int32()) for c in columns]], names=["type", "ref_start", "ref_end", "hyp_start", "hyp_end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(ref) + 1)), pa.int32()), runs)
