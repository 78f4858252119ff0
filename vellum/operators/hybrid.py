"""The whole retrieval chain: dense and lexical search, fusion, swap to parents, rerank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import retrieval as rt
from vellum.operators.scoring import Scorer

#: (fetched, kept) for questions of fact and of analysis. Fixed values.
DEPTHS = {"fact": (10, 3), "analytical": (20, 5)}


def swap_to_parents(hits: DataFrame, query: str, child: str) -> DataFrame:
    """query, parent_id, child (null for parents), pages, first_rank, legacy and rank.

    hits: query, child, rank, page, parent_id (null: a child without a parent, which passes through unchanged). Parents come
    in the order of their first child, with the different pages of their children in the order met; children without
    parents go last. A query's hits are as many as were fetched, so the lists are short.
    """
    legacy = F.col("parent_id").isNull()
    h = hits.withColumn("legacy", legacy).withColumn("_child", F.when(legacy, F.col(child)))
    by_page = h.groupBy(query, "legacy", "parent_id", "_child", "page").agg(F.min("rank").alias("rank"))
    pages = F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("rank", "page"))))
    g = by_page.groupBy(query, "legacy", "parent_id", "_child").agg(F.min("rank").alias("first_rank"), pages.alias("p"))
    w = Window.partitionBy(query).orderBy("legacy", "first_rank", "parent_id", "_child")
    return g.select(query, "parent_id", F.col("_child").alias(child), F.col("p.page").alias("pages"), "first_rank", "legacy", F.row_number().over(w).alias("rank"))


def fused_hits(questions: DataFrame, query: str, question: str, children: DataFrame, child: str, text: str, k: int, scorer: Scorer | None = None) -> DataFrame:
    """query, child, score and rank: the k nearest and the k best by BM25 (as they stand, idf with a floor, always k), fused half and half."""
    scorer = scorer or Scorer()
    q = questions.filter(F.col(question).isNotNull()).select(F.col(query), scorer.embed(F.col(question)).alias("v"))
    c = children.filter(F.col(text).isNotNull()).select(F.col(child), scorer.embed(F.col(text)).alias("v"))
    dense = rt.nearest(q, c, child, "v", k, query=query)
    lexical = rt.bm25(questions, query, question, children, child, text, k, mode="okapi_floor", lower=False, pad=True)
    return rt.fuse([(dense, 0.5), (lexical, 0.5)], query, child)


def hybrid_search(questions: DataFrame, query: str, question: str, children: DataFrame, child: str, text: str, parents: DataFrame, fetched: int, kept: int, scorer: Scorer | None = None) -> DataFrame:
    """query, parent_id, child, pages and rank: fetched fused hits swapped to parents, reranked on the parents' text, kept kept.

    children: child, text, page and parent_id; parents: parent_id and parent_text. Ties of the reranker go by the swap's order.
    """
    scorer = scorer or Scorer()
    hits = fused_hits(questions, query, question, children, child, text, fetched, scorer).filter(F.col("rank") <= fetched)
    swapped = swap_to_parents(hits.join(children.select(child, "page", "parent_id"), child), query, child)
    texts = swapped.join(parents.select("parent_id", "parent_text"), "parent_id", "left").join(children.select(child, F.col(text).alias("_own")), child, "left")
    scored = texts.join(questions.select(query, F.col(question).alias("_question")), query)
    scored = scored.withColumn("score", scorer.rerank(F.col("_question"), F.coalesce("parent_text", "_own")))
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.col("rank"))
    return scored.withColumn("final", F.row_number().over(w)).filter(F.col("final") <= kept).select(query, "parent_id", child, "pages", "score", F.col("final").alias("rank"))
