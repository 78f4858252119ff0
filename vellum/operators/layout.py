"""Reading order and text of pages out of layout blocks.

A block: page_width, block_no, block_type (0: text), x0, y0, x1, y1, text. Blocks of one page are few; they are sorted inside
one array per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block wider than this part of the page spans it; a page has two columns if each half holds this part of the narrow blocks. Fixed values.
SPAN, HALF, BUCKET = 0.55, 0.15, 5


def _two_columns() -> Column:
    narrow = (F.col("block_type") == 0) & ((F.col("x1") - F.col("x0")) < F.col("page_width") * SPAN)
    left = F.count_if(narrow & (F.col("x0") < F.col("page_width") / 2)) / F.nullif(F.count_if(narrow), F.lit(0))
    return F.coalesce(left.between(HALF, 1 - HALF), F.lit(False))


def detect_columns(blocks: DataFrame, page: list[str]) -> DataFrame:
    """page and two_columns."""
    return blocks.groupBy(*page).agg(_two_columns().alias("two_columns"))


def _sorted(blocks: DataFrame, page: list[str]) -> DataFrame:
    rows = F.collect_list(F.struct("x0", "y0", "x1", "page_width", "block_no", "block_type", "text"))
    g = blocks.groupBy(*page).agg(_two_columns().alias("two"), rows.alias("rows"))

    def key(b: Column) -> Column:
        wide = (b["x1"] - b["x0"]) > b["page_width"] * SPAN
        column = F.when(~F.col("two"), 0).when(wide, -1).when(b["x0"] >= b["page_width"] / 2, 1).otherwise(0)
        bucket = F.bround(b["y0"] / BUCKET) * BUCKET
        return F.struct(column.alias("column"), bucket.alias("bucket"), b["x0"].alias("x0"), b["block_no"].alias("block_no"), b["block_type"].alias("block_type"), b["text"].alias("text"))

    return g.select(*page, F.array_sort(F.transform("rows", key)).alias("rows"))


def reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """page, block_no and pos (from 1): left column before right, blocks across the page first, lines in buckets of five points."""
    return _sorted(blocks, page).select(*page, F.posexplode("rows").alias("pos", "b")).select(*page, "b.block_no", (F.col("pos") + 1).alias("pos"))


def page_text(blocks: DataFrame, page: list[str]) -> DataFrame:
    """page and text: its text blocks in reading order, stripped, blank ones left out, parted by blank lines; no row for a blank page."""
    texts = F.transform(F.filter("rows", lambda b: b["block_type"] == 0), lambda b: F.regexp_replace(b["text"], r"^\s+|\s+$", ""))
    out = _sorted(blocks, page).select(*page, F.filter(texts, lambda t: t != "").alias("texts"))
    return out.filter(F.size("texts") > 0).select(*page, F.array_join("texts", "\n\n").alias("text"))
