"""Lines that come back all over one source (problem 4).

Lines are compared by 128 bits of hash of (source, normal form). A distinct over (line, page) is followed by a count per
line: both combine on the map side, so a line on every page of a huge source costs one row a task. What is counted often
enough goes back to the lines by a join whose small side is broadcast only if its measured size allows.

Defined results: a null source has no repeated lines; a null page counts as a page of its own; null or empty text has no
lines; pages loaded again count once, their lines come out; a line of no letters or digits never counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PAGES = 5
#: A line counts from this part of the pages of its source: 1 / 5.
SHARE = 5


def normal_line(line: Column) -> Column:
    """Lower case without spacing and punctuation, each number (with its own punctuation) as one sign."""
    bare = F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{N}]", "")
    return F.regexp_replace(bare, r"\p{N}+", "0")


def _lines(pages: DataFrame) -> DataFrame:
    cols = ["page_id", "source_file", "page"]
    split = pages.filter(F.col("source_file").isNotNull()).select(*cols, F.posexplode(F.split("page_content", "\n")).alias("at", "line"))
    page = F.coalesce(F.concat(F.lit("p"), F.col("page").cast("string")), F.concat(F.lit("r"), F.col("page_id").cast("string")))
    split = split.select("page_id", "source_file", page.alias("page"), (F.col("at") + 1).cast("bigint").alias("line_no"), normal_line(F.col("line")).alias("form")).filter("form <> ''")
    return split.select("page_id", "source_file", "page", "line_no", F.xxhash64("source_file", "form").alias("h1"), F.xxhash64(F.lit(1), "form", "source_file").alias("h2"))


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, share: int = SHARE) -> DataFrame:
    """page_id, line_no (from 1), source_file and n_pages of each place where a repeated line stands.

    pages: page_id, source_file, page, page_content. Repeated: on min_pages different pages or more of its source and on
    one in share of them or more.
    """
    lines = _lines(pages)
    often = lines.select("h1", "h2", "page").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    page = F.coalesce(F.concat(F.lit("p"), F.col("page").cast("string")), F.concat(F.lit("r"), F.col("page_id").cast("string")))
    sizes = pages.filter(F.col("source_file").isNotNull()).select("source_file", page.alias("page")).distinct().groupBy("source_file").agg(F.count(F.lit(1)).alias("size"))
    found = lines.join(often, ["h1", "h2"]).join(sizes, "source_file").filter(F.col("n_pages") * share >= F.col("size"))
    return found.select("page_id", "line_no", "source_file", "n_pages")


def without_repeated_lines(pages: DataFrame, **how: int) -> DataFrame:
    """pages with the column clean: page_content without its repeated lines (null stays null), and n_removed."""
    gone = repeated_lines(pages, **how).groupBy("page_id").agg(F.collect_set("line_no").alias("__gone"))
    kept = F.filter(F.split("page_content", "\n"), lambda x, i: ~F.array_contains("__gone", (i + 1).cast("bigint")))
    out = pages.join(gone, "page_id", "left")
    clean = F.when(F.col("__gone").isNull(), F.col("page_content")).otherwise(F.array_join(kept, "\n"))
    return out.select(*[c for c in pages.columns if c not in ("clean", "n_removed")], clean.alias("clean"), F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"))
