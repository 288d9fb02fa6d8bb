"""Small text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import strip


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def squeeze(text: str) -> str:
    """NFKC, white space collapsed to one blank and trimmed."""
    return " ".join(nfkc(text).split())


def usable(col: str) -> Column:
    """Not null, blank, ``NA`` or a recogniser error."""
    t = strip(F.col(col))
    return F.col(col).isNotNull() & (t != "") & (t != "NA") & ~t.startswith("__ERROR__")


def map_strings(batches: Iterator[pa.RecordBatch], columns: list[str], f) -> Iterator[pa.RecordBatch]:
    """Replace the named string columns by ``f`` of each value, computed once per distinct value."""
    for b in batches:
        arrays = []
        for name in b.schema.names:
            a = b[name]
            if name in columns:
                d = a.dictionary_encode()
                done = pa.array([None if x is None else f(x) for x in d.dictionary.to_pylist()], pa.string())
                a = done.take(d.indices)
            arrays.append(a)
        yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)
