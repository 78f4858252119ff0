"""The seam for models: what retrieval and audit ask of them, and deterministic stand-ins.

A Scorer holds four functions of columns. A model takes the place of one of them as a Pandas UDF of the same shape; the stand-ins
are plain expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import normal_space
from vellum.operators.retrieval import terms

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text: Column) -> Column:
    """Stand-in for an embedding: how often each of 26 letters comes."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


def term_coverage(question: Column, text: Column) -> Column:
    """Stand-in for a reranker: the share of the question's different terms that text holds, 6 decimals."""
    asked = F.array_distinct(terms(question))
    return F.coalesce(F.round(F.size(F.array_intersect(asked, terms(text))) / F.nullif(F.size(asked), F.lit(0)), 6), F.lit(0.0))


def sentences(answer: Column) -> Column:
    """Stand-in for the extraction of claims: sentences of at least one letter or digit."""
    parts = F.split(F.trim(answer), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def verbatim_quote(claim: Column, context: Column) -> Column:
    """Stand-in for verification: the claim itself where the context holds it, but for space and case; else an empty string."""
    return F.when(F.contains(normal_space(context), normal_space(claim)) & (normal_space(claim) != ""), claim).otherwise(F.lit(""))


@dataclass(frozen=True)
class Scorer:
    embed: Callable[[Column], Column] = letter_counts
    rerank: Callable[[Column, Column], Column] = term_coverage
    extract: Callable[[Column], Column] = sentences
    verify: Callable[[Column, Column], Column] = verbatim_quote
