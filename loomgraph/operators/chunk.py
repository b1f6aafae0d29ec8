"""Packing sentences into chunks of bounded length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=\S)")
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "St.", "vs.", "etc.", "e.g.", "i.e.", "No.", "Inc.")


def sentences(text: str) -> list[str]:
    out, start = [], 0
    for m in _END.finditer(text):
        if not text[start : m.start()].endswith(ABBREVIATIONS):
            out.append(text[start : m.end()].strip())
            start = m.end()
    return [s for s in [*out, text[start:].strip()] if s]


def pack(parts: list[str], most: int) -> Iterator[str]:
    """Greedy runs of parts; each counts one character more, for the space after it. A part alone may exceed the limit."""
    run, size = [], 0
    for p in parts:
        if run and size + len(p) + 1 > most:
            yield " ".join(run)
            run, size = [], 0
        run.append(p)
        size += len(p) + 1
    if run:
        yield " ".join(run)


def chunks(text: str, most: int = 500) -> list[str]:
    """Whole sentences as long as they fit; a sentence over the limit is packed by words, apart from its neighbours.

    Where a single word exceeds the limit it makes a chunk of its own; no chunk is empty.
    """
    out, run = [], []
    for s in sentences(text):
        if len(s) <= most:
            run.append(s)
            continue
        out += [*pack(run, most), *pack(s.split(), most)]
        run = []
    return [*out, *pack(run, most)]


def chunk(docs: DataFrame, most: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, chunk) of every document; null and empty texts have none."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunks(t, most) if t else [])

    return docs.select(F.col(id_col), F.posexplode(run(text_col)).alias("chunk_no", "chunk"))
