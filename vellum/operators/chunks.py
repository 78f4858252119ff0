"""Chunks of pages: native windows, and the recursive splitter behind an Arrow boundary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_chunks(df: DataFrame, text: str, size: int = 350, step: int = 300) -> DataFrame:
    """df without text, with chunk_no (from 0) and chunk: windows of size characters every step."""
    last = F.greatest(F.lit(0), F.floor((F.length(text) - (size - step) - 1) / step)).cast("int")
    rows = df.filter(F.length(text) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    chunk = F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size))
    return rows.select(*[c for c in df.columns if c != text], "chunk_no", chunk.alias("chunk"))


def split_text(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Recursive splitting: the first separator that occurs parts the text and stays at the start of the next piece; pieces are
    merged greedily up to size; on overflow a chunk is emitted and pieces drop from the left until at most overlap is kept;
    pieces over size are split by the remaining separators, or stay whole when none is left."""
    sep = next((s for s in separators if s == "" or s in text), None)
    if sep is None:
        return [text.strip()] if text.strip() else []
    rest = separators[separators.index(sep) + 1 :]
    if sep:
        head, *tail = text.split(sep)
        pieces = [p for p in [head, *(sep + t for t in tail)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    window: list[str] = []

    def emit() -> None:
        chunk = "".join(window).strip()
        if chunk:
            out.append(chunk)

    for piece in pieces:
        if len(piece) > size:
            if window:
                emit()
                window = []
            out += split_text(piece, size, overlap, rest) if rest else ([piece.strip()] if piece.strip() else [])
            continue
        if window and sum(map(len, window)) + len(piece) > size:
            emit()
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(piece) > size):
                window.pop(0)
        window.append(piece)
    if window:
        emit()
    return out


def recursive_chunks(pages: DataFrame, keys: list[str], text: str, parent_size: int = 2000, child_size: int = 350, child_overlap: int = 50) -> DataFrame:
    """keys, parent_no, parent, chunk_no, chunk of each page: parents at blank lines, lines or spaces, never inside a word; children
    anywhere. Parents do not span pages."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (*key, i, parent, j, child)
                for *key, t in b.itertuples(index=False)
                if t
                for i, parent in enumerate(split_text(t, parent_size, 0, ["\n\n", "\n", " "]))
                for j, child in enumerate(split_text(parent, child_size, child_overlap, ["\n\n", "\n", " ", ""]))
            ]
            yield pd.DataFrame(rows, columns=[*keys, "parent_no", "parent", "chunk_no", "chunk"])

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", parent_no int, parent string, chunk_no int, chunk string"
    return pages.select(*keys, text).mapInPandas(split, schema)
