"""Lexical and dense retrieval for a table of queries, rank fusion, diversification and context assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut

#: Robertson / Zaragoza constants, and the constant of reciprocal rank fusion. Fixed values.
K1, B, RRF_C = 1.5, 0.75, 60
#: Rows of a block in the exact nearest-neighbour search; a task holds two blocks and their products.
BLOCK = 4096


#: Questions of a block of the lexical search, and cells of the table of scores that a task holds at once.
QUERIES, CELLS = 4096, 1 << 22


def terms(text: Column, lower: bool = True) -> Column:
    """White-space tokens."""
    return F.filter(F.split(F.lower(text) if lower else text, r"\s+"), lambda t: t != "")


def collection_stats(corpus: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n_docs and avg_dl."""
    return corpus.filter(F.col(text).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(terms(F.col(text)))).alias("avg_dl"))


def term_idf(corpus: DataFrame, text: str, mode: str = "nonneg", lower: bool = True) -> DataFrame:
    """term, df, idf and avg_dl of every term of the corpus: the statistics of one snapshot, to be written once and read by every search.

    mode nonneg: ln(1 + (N - df + 0.5) / (df + 0.5)); okapi_floor: ln((N - df + 0.5) / (df + 0.5)), where that is negative a quarter
    of the mean over all terms. A row a term; counts are combined on the map side.
    """
    t = corpus.filter(F.col(text).isNotNull()).select(terms(F.col(text), lower).alias("t"))
    whole = t.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avg_dl")).alias("s")).scalar()
    df = t.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("_s", whole)
    n, d = F.col("_s.n"), F.col("df")
    if mode == "nonneg":
        return df.select("term", "df", F.log(1 + (n - d + 0.5) / (d + 0.5)).alias("idf"), F.col("_s.avg_dl").alias("avg_dl"))
    plain = cut(df.select("term", "df", (F.log(n - d + 0.5) - F.log(d + 0.5)).alias("idf"), F.col("_s.avg_dl").alias("avg_dl")))
    floor = plain.agg((F.avg("idf") * 0.25).alias("f")).scalar()
    held = plain.withColumn("_f", floor)
    return held.select("term", "df", F.when(F.col("idf") < 0, F.col("_f")).otherwise(F.col("idf")).alias("idf"), "avg_dl")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (k a column) and scores of the k best rows of each column; equal scores by the lower id. scores: 6 decimals."""
    n = len(ids)
    place = np.empty(n, np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(n)
    key = np.rint(scores * 1e6).astype(np.int64) * n - place[:, None]
    if n > k:
        at = np.argpartition(-key, k - 1, axis=0)[:k]
    else:
        at = np.broadcast_to(np.arange(n)[:, None], (n, scores.shape[1]))
    return at, np.take_along_axis(scores, at, 0)


def _scorer(hashes: np.ndarray, idf: np.ndarray, askers: list, n_queries: int, avg_dl: float | None, k: int, pad: bool):
    """A function over Arrow batches (doc, h) that gives the k best documents of its partition for each query; without avg_dl a term
    counts by its presence alone."""

    def shrink(parts: list) -> tuple:
        q, d, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        first = np.r_[True, q[1:] != q[:-1]]
        keep = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) < k
        return q[keep], d[keep], s[keep]

    def run(batches):
        parts, rows = [], max(1, CELLS // max(n_queries, 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                piece = batch.slice(lo, rows)
                ids, lists = piece.column(0).to_numpy(zero_copy_only=False), piece.column(1)
                flat, dl = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
                at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
                hit = hashes[at] == flat
                code, tf = np.unique(at[hit] * len(ids) + np.repeat(np.arange(len(ids)), dl)[hit], return_counts=True)
                term, row = code // len(ids), code % len(ids)
                weight = idf[term] if avg_dl is None else idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avg_dl))
                scores = np.zeros((len(ids), n_queries))
                ends = np.r_[np.flatnonzero(np.diff(term)) + 1, len(term)] if len(term) else []
                start = 0
                for end in ends:
                    q, times = askers[term[start]]
                    scores[np.ix_(row[start:end], q)] += weight[start:end, None] * times[None, :]
                    start = end
                pos, best = _best(np.round(scores, 6), ids, k)
                cols = np.broadcast_to(np.arange(n_queries), pos.shape)
                keep = np.ones(pos.shape, bool) if pad else best > 0
                parts.append((cols[keep], ids[pos][keep], best[keep]))
                if len(parts) >= 16:
                    parts = [shrink(parts)]
        if parts:
            q, d, s = shrink(parts)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(d.astype(np.int64)), pa.array(s.astype(np.float64))], names=["q", "doc", "score"])

    return run


def bm25(queries: DataFrame, query: str, question: str, corpus: DataFrame, doc: str, text: str, k: int, mode: str = "nonneg", lower: bool = True, pad: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """query, doc, score and rank: the k best documents of each query. A tenant or file filter belongs on corpus, before the search.

    Queries go in blocks of QUERIES; a block's terms (a proven bound) are sent to the tasks, each of which scores its documents against the whole
    block by rows of a term and hands on its k best a query. So neither postings nor pairs of query and document are ever shuffled,
    and a stop word costs no more than its own postings. Terms count as often as the query has them; ties go to the lower doc.

    pad: give k rows even where the score is zero. doc: a bigint. Null texts are not searched, null questions ask nothing. stats: term_idf
    of the corpus, if it is held already.
    """
    known = (stats if stats is not None else term_idf(corpus, text, mode, lower)).select("term", "idf", "avg_dl")
    return _search(queries, query, question, corpus, doc, text, k, known, lower, pad)


def coverage(queries: DataFrame, query: str, question: str, corpus: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """As bm25, but score is the share of the question's different terms that the document holds."""
    return _search(queries, query, question, corpus, doc, text, k, None, True, False)


def _search(queries: DataFrame, query: str, question: str, corpus: DataFrame, doc: str, text: str, k: int, known: DataFrame | None, lower: bool, pad: bool) -> DataFrame:
    spark = queries.sparkSession
    words = terms(F.col(question), lower)
    asked = queries.filter(F.col(question).isNotNull()).select(F.col(query).cast("bigint").alias("q"), (words if known is not None else F.array_distinct(words)).alias("t"))
    one = asked.select("q", F.size("t").alias("size"), F.explode("t").alias("term")).groupBy("q", "term", "size").agg(F.count(F.lit(1)).alias("times"))
    if known is None:
        joined = one.select("q", F.xxhash64("term").alias("h"), (1 / F.col("size")).alias("times"), F.lit(1.0).alias("idf"), F.lit(None).cast("double").alias("avg_dl"))
    else:
        joined = one.join(known, "term").select("q", F.xxhash64("term").alias("h"), "times", "idf", "avg_dl")
    blocks, joined = max(1, -(-asked.count() // QUERIES)), cut(joined)
    docs = corpus.filter(F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.transform(terms(F.col(text), lower), lambda t: F.xxhash64(t)).alias("h"))
    out = spark.createDataFrame([], "q bigint, doc bigint, score double")
    in_block = lambda df, b: df.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
    for b in range(blocks):
        ids = np.sort(in_block(asked, b).select("q").distinct().toPandas().q.to_numpy(np.int64))  # QUERIES, about
        pdf = in_block(joined, b).toPandas()
        if len(ids) == 0 or (len(pdf) == 0 and not pad):
            continue
        hashes, term = np.unique(pdf.h.to_numpy(np.int64), return_inverse=True) if len(pdf) else (np.array([0]), np.array([], int))
        idf, askers = np.zeros(len(hashes)), [(np.array([], int), np.array([])) for _ in hashes]
        order = np.argsort(term, kind="stable")
        places, times = np.searchsorted(ids, pdf.q.to_numpy(np.int64)), pdf.times.to_numpy(float)
        for part in np.split(order, np.flatnonzero(np.diff(term[order])) + 1) if len(order) else []:
            idf[term[part[0]]], askers[term[part[0]]] = pdf.idf.iloc[part[0]], (places[part], times[part])
        avg_dl = None if known is None else float(pdf.avg_dl.iloc[0]) if len(pdf) else 1.0
        found = docs.mapInArrow(_scorer(hashes, idf, askers, len(ids), avg_dl, k, pad), "q bigint, doc bigint, score double")
        out = out.unionByName(found.select(F.get(F.lit(ids.tolist()), F.col("q").cast("int")).alias("q"), "doc", "score"))
    return top_k(out.select(F.col("q").alias(query), F.col("doc").alias(doc), "score"), query, doc, k)


def top_k(scored: DataFrame, query: str, doc: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query with their rank; Spark cuts to k before the shuffle as well as after."""
    w = Window.partitionBy(query).orderBy(F.desc(score), doc)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(df: DataFrame, key: str, column: str, block: int) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // block))
    return df.withColumn(column, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def nearest(queries: DataFrame, corpus: DataFrame, id: str, vector: str, k: int, query: str = "query_id", group: str | None = None, block: int = BLOCK) -> DataFrame:
    """query, id, score (cosine, 6 decimals) and rank: exact search of a query set against all rows, block by block.

    Each pair of blocks is one product of matrices in one task, which hands on its k best a query; the same vector may be query
    and row. Memory per task is bounded by block, whatever the sizes. group: the k best of each group (a bigint), as its own column.
    """
    label = F.col(group).cast("bigint") if group else F.lit(0).cast("bigint")
    q, nq = _blocks(queries.filter(F.col(vector).isNotNull()).select(F.col(query).alias("qid"), F.col(vector).alias("v")), "qid", "qb", block)
    c, nc = _blocks(corpus.filter(F.col(vector).isNotNull()).select(F.col(id).alias("cid"), label.alias("label"), F.col(vector).alias("v")), "cid", "cb", block)
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "label": [], "cid": [], "score": []})
        a, b = (np.stack(x.v.to_numpy()).astype(np.float64) for x in (left, right))
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, b))
        s, out = np.round(b @ a.T, 6), []
        for name, rows in right.groupby("label", dropna=False).indices.items():
            at, best = _best(s[rows], right.cid.to_numpy()[rows], k)
            out.append(pd.DataFrame({"qid": np.broadcast_to(left.qid.to_numpy(), at.shape).ravel(), "label": name, "cid": right.cid.to_numpy()[rows][at].ravel(), "score": best.ravel()}))
        return pd.concat(out)

    parts = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(product, "qid bigint, label bigint, cid bigint, score double")
    w = Window.partitionBy("qid", "label").orderBy(F.desc("score"), "cid")
    best = parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select(F.col("qid").alias(query), F.col("cid").alias(id), "score", "rank", *([F.col("label").alias(group)] if group else []))


def fuse(rankings: list[tuple[DataFrame, float]], query: str, doc: str, c: int = RRF_C) -> DataFrame:
    """query, doc, score and rank by weighted reciprocal rank fusion: the sum of weight / (c + rank)."""
    rows = None
    for df, weight in rankings:
        one = df.select(query, doc, (F.lit(float(weight)) / (c + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.groupBy(query, doc).agg(F.round(F.sum("part"), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc)))


def _unit(v: Column) -> Column:
    """v over its length, which is bound once and not worked out per element."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))
    return F.get(F.transform(F.array(F.greatest(length, F.lit(1e-12))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)


def mmr(candidates: DataFrame, query: str, group: str, id: str, k: int = 5, weight: float = 0.5) -> DataFrame:
    """query, group, id and pick (from 1): maximal marginal relevance among the candidates of each (query, group), as a fold over an array.

    candidates: also qv and v, the vectors; cut them to the best few (fetch_k) before, as a group becomes one row. Scores are
    rounded to 9 decimals, ties go to the candidate more like the query, then to the lower id.
    """
    unit = candidates.select(query, group, id, _unit(F.col("qv")).alias("qv"), _unit(F.col("v")).alias("v"))
    c = unit.select(query, group, F.struct(F.round(-_dot(F.col("qv"), F.col("v")), 9).alias("far"), F.col(id).alias("id"), "v").alias("c"))
    rows = c.groupBy(query, group).agg(F.array_sort(F.collect_list("c")).alias("cs"))  # fetch_k candidates
    cs = F.col("cs")

    def step(state: Column, _: Column) -> Column:
        # near: how like each candidate is to the picked one it is most like
        last = F.get(cs, F.element_at(state["picked"], -1))["v"]
        near = F.transform(cs, lambda x, i: F.greatest(F.get(state["near"], i), _dot(last, x["v"])))
        return F.get(F.transform(F.array(near), lambda n: F.struct(F.concat(state["picked"], following(state["picked"], n)).alias("picked"), n.alias("near"))), F.lit(0))

    def following(picked: Column, near: Column) -> Column:
        left = F.transform(cs, lambda x, i: F.when(~F.array_contains(picked, i), F.struct(F.round(-weight * x["far"] - (1 - weight) * F.get(near, i), 9).alias("s"), (-i).alias("at"))))
        return F.transform(F.filter(F.array(F.array_max(left)), lambda b: b.isNotNull()), lambda b: -b["at"])

    start = F.struct(F.array(F.lit(0)).alias("picked"), F.transform(cs, lambda _: F.lit(-2.0)).alias("near"))
    picks = F.aggregate(F.sequence(F.lit(2), F.lit(max(k, 2))), start, step)["picked"]
    chosen = rows.select(query, group, "cs", F.posexplode(F.slice(picks, 1, k)).alias("pick", "at"))
    return chosen.select(query, group, F.get("cs", F.col("at"))["id"].alias(id), (F.col("pick") + 1).cast("int").alias("pick"))
