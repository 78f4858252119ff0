"""Queries of retrieval and context assembly. Tenant of a document is its source; questions are every 20th of the golden set.

The lexical searches come in two forms: within one tenant, and under the name with _all over every document, whatever its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import page_ranges as format_ranges
from vellum.operators import retrieval as rt
from vellum.operators.chunks import window_chunks
from vellum.operators.hybrid import DEPTHS, fused_hits
from vellum.operators.hybrid import hybrid_search as whole_search
from vellum.operators.scoring import LETTERS, term_coverage
from vellum.plans import REGISTRY
from vellum.plans.texts import _LATEST, latest_pages
from vellum.session import cut
from vellum.sources.tables import table

_TENANT = "court_digest"


def _questions(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "golden_dataset", "source_row", "question").filter("source_row % 20 = 0")


def _tenant(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents", "doc_id", "source", "text").filter(F.col("source") == _TENANT)


def _everything(spark: SparkSession, directory: str) -> DataFrame:
    """All documents as one corpus, those without a source too."""
    return table(spark, directory, "documents", "doc_id", "text").filter("text IS NOT NULL")


_D = f"(SELECT doc_id, text FROM documents WHERE source = '{_TENANT}' AND text IS NOT NULL)"
_D_ALL = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_Q = "(SELECT source_row, question FROM golden_dataset WHERE source_row % 20 = 0)"


def _bm25_sql(k: int, docs: str = _D) -> str:
    split = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> '')"
    return f"""
ds AS (SELECT doc_id, {split('text')} AS ts FROM {docs}), n AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_dl FROM ds),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM ds) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qs AS (SELECT source_row, term, count(*) AS qtf FROM (SELECT source_row, unnest({split('question')}) AS term FROM {_Q}) GROUP BY 1, 2),
sc AS (SELECT source_row, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
  FROM qs JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2),
lex AS (SELECT *, row_number() OVER (PARTITION BY source_row ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {k})"""


@REGISTRY.query("bm25_topk", f"WITH {_bm25_sql(10)} SELECT source_row, doc_id, score, CAST(rank AS INT) AS rank FROM lex")
def bm25_topk(spark: SparkSession, directory: str) -> DataFrame:
    return rt.bm25(_questions(spark, directory), "source_row", "question", _tenant(spark, directory), "doc_id", "text", 10)


@REGISTRY.query("bm25_topk_all", f"WITH {_bm25_sql(10, _D_ALL)} SELECT source_row, doc_id, score, CAST(rank AS INT) AS rank FROM lex")
def bm25_topk_all(spark: SparkSession, directory: str) -> DataFrame:
    return rt.bm25(_questions(spark, directory), "source_row", "question", _everything(spark, directory), "doc_id", "text", 10)


@REGISTRY.query("bm25_stats", r"SELECT source, count(*) AS n_docs, round(avg(len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> ''))), 6) AS avg_dl FROM documents WHERE text IS NOT NULL GROUP BY 1")
def bm25_stats(spark: SparkSession, directory: str) -> DataFrame:
    s = rt.collection_stats(table(spark, directory, "documents", "source", "text"), ["source"], "text")
    return s.select("source", "n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@REGISTRY.query("lexical_corpus", "SELECT doc_id, text FROM documents WHERE source = 'loan_books' AND lang IN ('en', 'de') AND text IS NOT NULL")
def lexical_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """A tenant's texts under a filter, both pushed to the scan; no cap."""
    d = table(spark, directory, "documents", "doc_id", "text", "source", "lang")
    return d.filter((F.col("source") == "loan_books") & F.col("lang").isin("en", "de") & F.col("text").isNotNull()).select("doc_id", "text")


_COVER = rf"""cov AS (SELECT source_row, doc_id, round(count(DISTINCT term) * 1.0 / max(n), 6) AS score FROM (SELECT source_row, term, count(*) OVER (PARTITION BY source_row) AS n FROM qs) JOIN tf USING (term) GROUP BY 1, 2),
covr AS (SELECT *, row_number() OVER (PARTITION BY source_row ORDER BY score DESC, doc_id) AS rank FROM cov QUALIFY rank <= 20),
fused AS (SELECT source_row, doc_id, round(sum(0.5 / (60 + rank)), 9) AS score FROM (SELECT source_row, doc_id, rank FROM lex UNION ALL SELECT source_row, doc_id, rank FROM covr) GROUP BY 1, 2)"""


def _fused(spark: SparkSession, directory: str, corpus: DataFrame) -> DataFrame:
    """BM25 and, in place of a second retriever, the share of the question's terms that a document holds."""
    q = _questions(spark, directory)
    lexical = rt.bm25(q, "source_row", "question", corpus, "doc_id", "text", 20)
    return rt.fuse([(lexical, 0.5), (rt.coverage(q, "source_row", "question", corpus, "doc_id", "text", 20), 0.5)], "source_row", "doc_id")


def _fusion_sql(docs: str) -> str:
    return f"WITH {_bm25_sql(20, docs)}, {_COVER} SELECT source_row, doc_id, score, CAST(row_number() OVER (PARTITION BY source_row ORDER BY score DESC, doc_id) AS INT) AS rank FROM fused"


@REGISTRY.query("rrf_fusion", _fusion_sql(_D))
def rrf_fusion(spark: SparkSession, directory: str) -> DataFrame:
    return _fused(spark, directory, _tenant(spark, directory))


@REGISTRY.query("rrf_fusion_all", _fusion_sql(_D_ALL))
def rrf_fusion_all(spark: SparkSession, directory: str) -> DataFrame:
    return _fused(spark, directory, _everything(spark, directory))


def _hybrid_sql(docs: str) -> str:
    return (
        f"WITH {_bm25_sql(20, docs)}, {_COVER}, f20 AS (SELECT *, row_number() OVER (PARTITION BY source_row ORDER BY score DESC, doc_id) AS fr FROM fused QUALIFY fr <= 20) "
        "SELECT source_row, doc_id, CAST(row_number() OVER (PARTITION BY source_row ORDER BY coalesce(c.score, 0) DESC, fr) AS INT) AS rank FROM f20 LEFT JOIN cov c USING (source_row, doc_id) QUALIFY rank <= 5"
    )


def _hybrid(spark: SparkSession, directory: str, corpus: DataFrame) -> DataFrame:
    """Twenty fused hits, reranked by the stand-in scorer (term coverage, then fusion), five kept."""
    hits = _fused(spark, directory, corpus).filter("rank <= 20").select("source_row", "doc_id", F.col("rank").alias("fr"))
    w = Window.partitionBy("source_row").orderBy(F.desc("cover"), "fr")
    cover = term_coverage(F.col("question"), F.col("text"))
    ranked = hits.join(corpus, "doc_id").join(_questions(spark, directory), "source_row").withColumn("cover", cover).withColumn("rank", F.row_number().over(w))
    return ranked.filter("rank <= 5").select("source_row", "doc_id", "rank")


@REGISTRY.query("hybrid_search", _hybrid_sql(_D))
def hybrid_search(spark: SparkSession, directory: str) -> DataFrame:
    return _hybrid(spark, directory, _tenant(spark, directory))


@REGISTRY.query("hybrid_search_all", _hybrid_sql(_D_ALL))
def hybrid_search_all(spark: SparkSession, directory: str) -> DataFrame:
    return _hybrid(spark, directory, _everything(spark, directory))


def _dense_sql(where: str, partition: str, k: int) -> str:
    return f"""SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY {partition} ORDER BY score DESC, vec_id) AS INT) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 6) AS score
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e WHERE {where}) QUALIFY rank <= {k}"""


def _vectors(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, directory, "embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e


@REGISTRY.query("dense_topk_all", _dense_sql("true", "query_id", 10))
def dense_topk_all(spark: SparkSession, directory: str) -> DataFrame:
    q, e = _vectors(spark, directory)
    return rt.nearest(q, e, "vec_id", "embedding", 10)


@REGISTRY.query("dense_topk", _dense_sql("label = 3", "query_id", 10))
def dense_topk(spark: SparkSession, directory: str) -> DataFrame:
    """Within one tenant: the filter reaches the scan."""
    q, e = _vectors(spark, directory)
    return rt.nearest(q, e.filter("label = 3"), "vec_id", "embedding", 10)


@REGISTRY.query("scoped_topk", _dense_sql("label IN (1, 4, 7)", "query_id", 5))
def scoped_topk(spark: SparkSession, directory: str) -> DataFrame:
    q, e = _vectors(spark, directory)
    return rt.nearest(q, e.filter(F.col("label").isin(1, 4, 7)), "vec_id", "embedding", 5)


_COSINE = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"


def _mmr_sql(picks: int) -> str:
    v = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
    parts = [
        f"e AS ({v})", f"c AS (SELECT a.vec_id AS query_id, b.label, b.vec_id, b.v, round({_COSINE}, 6) AS near6, round({_COSINE}, 9) AS near FROM e a, e b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY near6 DESC, b.vec_id) <= 20)",
        "p1 AS (SELECT query_id, label, vec_id, v, 1 AS pick FROM c QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY near DESC, vec_id) = 1)",
    ]
    for i in range(2, picks + 1):
        parts.append(
            f"p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT query_id, label, vec_id, v, {i} FROM (SELECT b.query_id, b.label, b.vec_id, any_value(b.v) AS v, any_value(b.near) AS near, round(0.5 * any_value(b.near) - 0.5 * max({_COSINE}), 9) AS s FROM c b JOIN p{i - 1} a USING (query_id, label) "
            f"WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} x WHERE x.query_id = b.query_id AND x.label = b.label AND x.vec_id = b.vec_id) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, near DESC, vec_id) = 1)"
        )
    return f"WITH {', '.join(parts)} SELECT query_id, label, vec_id, CAST(pick AS INT) AS pick FROM p{picks}"


@REGISTRY.query("mmr_per_doc", _mmr_sql(5))
def mmr_per_doc(spark: SparkSession, directory: str) -> DataFrame:
    """Five of the twenty rows of each label nearest to each query: one search with the labels as groups, then a fold."""
    q, e = _vectors(spark, directory)
    near = rt.nearest(q, e, "vec_id", "embedding", 20, group="label").select("query_id", "label", "vec_id")
    c = near.join(q.withColumnRenamed("embedding", "qv"), "query_id").join(e.select("vec_id", F.col("embedding").alias("v")), "vec_id")
    return rt.mmr(c.select("query_id", "label", "vec_id", "qv", "v"), "query_id", "label", "vec_id", 5)


@REGISTRY.query(
    "attribution",
    "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 6) AS score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 5) e), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10) SELECT query_id, vec_id, score FROM t WHERE score >= 0.3 OR (rank = 1 AND query_id NOT IN (SELECT query_id FROM t WHERE score >= 0.3))",
)
def attribution(spark: SparkSession, directory: str) -> DataFrame:
    """All of the ten parents at 0.3 or more, else the single best."""
    q, e = _vectors(spark, directory)
    t = rt.nearest(q, e.filter("label = 5"), "vec_id", "embedding", 10)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return t.withColumn("best", best).filter("score >= 0.3 OR (rank = 1 AND best < 0.3)").select("query_id", "vec_id", "score")


@REGISTRY.query(
    "coverage",
    "WITH w AS (SELECT id, unnest(uploaded_files) AS file FROM chat_sessions), h AS (SELECT source_file, count(*) AS n FROM document_pages GROUP BY 1) SELECT DISTINCT w.id, w.file, coalesce(h.n, 0) AS n_pages, coalesce(h.n, 0) > 0 AS covered FROM w LEFT JOIN h ON h.source_file = w.file",
)
def coverage(spark: SparkSession, directory: str) -> DataFrame:
    """Of each requested file, whether anything of it is held: the requested side is kept."""
    wanted = table(spark, directory, "chat_sessions", "id", "uploaded_files").select("id", F.explode("uploaded_files").alias("file")).distinct()
    held = table(spark, directory, "document_pages", "source_file").groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return wanted.join(held, "file", "left").select("id", "file", n.alias("n_pages"), (n > 0).alias("covered"))


_CITES = "SELECT m.id, j->>'file' AS file, CAST(j->>'page' AS INT) AS page, pos FROM (SELECT id, unnest(CAST(citations AS JSON[])) AS j, generate_subscripts(CAST(citations AS JSON[]), 1) AS pos FROM (SELECT id, any_value(citations) AS citations FROM chat_messages WHERE citations IS NOT NULL GROUP BY 1)) m"


def _citations(spark: SparkSession, directory: str) -> DataFrame:
    m = table(spark, directory, "chat_messages", "id", "citations").filter("citations IS NOT NULL").groupBy("id").agg(F.max("citations").alias("citations"))
    rows = m.select("id", F.posexplode(F.from_json("citations", "array<struct<file string, page int>>")).alias("pos", "c"))
    return rows.select("id", "pos", "c.file", "c.page")


@REGISTRY.query("page_ranges", f"""WITH c AS (SELECT DISTINCT id, file, page FROM ({_CITES}) WHERE page IS NOT NULL), g AS (SELECT *, page - row_number() OVER (PARTITION BY id, file ORDER BY page) AS grp FROM c),
r AS (SELECT id, file, min(page) AS lo, max(page) AS hi, count(*) AS n FROM g GROUP BY id, file, grp)
SELECT id, file, CASE WHEN sum(n) > 1 THEN 'pp. ' ELSE 'p. ' END || string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS pages FROM r GROUP BY 1, 2""")
def page_ranges(spark: SparkSession, directory: str) -> DataFrame:
    c = _citations(spark, directory).filter("page IS NOT NULL").groupBy("id", "file").agg(F.collect_set("page").alias("pages"))
    return c.select("id", "file", format_ranges(F.col("pages")).alias("pages"))


@REGISTRY.query("source_list", f"SELECT id, file, min(page) AS first_page, count(DISTINCT page) AS n_pages, row_number() OVER (PARTITION BY id ORDER BY file, min(coalesce(page, 0))) AS pos FROM ({_CITES}) GROUP BY id, file")
def source_list(spark: SparkSession, directory: str) -> DataFrame:
    c = _citations(spark, directory).groupBy("id", "file").agg(F.min("page").alias("first_page"), F.count_distinct("page").alias("n_pages"), F.min(F.coalesce("page", F.lit(0))).alias("at"))
    return c.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("file", "at")).cast("bigint")).drop("at")


@REGISTRY.query("compare_sources", f"SELECT id, file, page, min(pos) AS first_pos FROM ({_CITES}) GROUP BY 1, 2, 3")
def compare_sources(spark: SparkSession, directory: str) -> DataFrame:
    """The first mention of each (file, page) of an answer."""
    return _citations(spark, directory).groupBy("id", "file", "page").agg((F.min("pos") + 1).cast("bigint").alias("first_pos"))


_HITS = f"SELECT c.id, c.pos, c.file, c.page, p.section, p.page_content FROM ({_CITES}) c JOIN ({_LATEST}) p ON p.source_file = c.file AND p.page = c.page"


def _cited_pages(spark: SparkSession, directory: str) -> DataFrame:
    pages = latest_pages(spark, directory).select(F.col("source_file").alias("file"), "page", "section", "page_content")
    return _citations(spark, directory).join(pages, ["file", "page"])


@REGISTRY.query("context_assemble", f"""SELECT id, sha256(string_agg('Source: ' || file || ', Page: ' || page || CASE WHEN section <> '' THEN ', Section: ' || section ELSE '' END || chr(10) || 'Content: ' || page_content, chr(10) || '---' || chr(10) ORDER BY pos)) AS context_sha, count(*) AS parts FROM ({_HITS}) GROUP BY 1""")
def context_assemble(spark: SparkSession, directory: str) -> DataFrame:
    section = F.when(F.col("section") != "", F.concat(F.lit(", Section: "), "section")).otherwise("")
    head = F.concat(F.lit("Source: "), "file", F.lit(", Page: "), F.col("page").cast("string"), section, F.lit("\nContent: "), "page_content")
    g = _cited_pages(spark, directory).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", head.alias("part")))).alias("s"))
    return g.select("id", F.sha2(F.array_join(F.col("s.part"), "\n---\n"), 256).alias("context_sha"), F.size("s").cast("bigint").alias("parts"))


@REGISTRY.query("compare_context", f"""SELECT id, file, sha256(string_agg('[' || file || ' | Page ' || page || CASE WHEN section <> '' THEN ' | ' || section ELSE '' END || ']' || chr(10) || page_content, chr(10) || chr(10) ORDER BY pos)) AS block_sha,
  CAST(dense_rank() OVER (PARTITION BY id ORDER BY min(pos)) AS INT) AS ordinal FROM ({_HITS}) GROUP BY id, file""")
def compare_context(spark: SparkSession, directory: str) -> DataFrame:
    section = F.when(F.col("section") != "", F.concat(F.lit(" | "), "section")).otherwise("")
    part = F.concat(F.lit("["), "file", F.lit(" | Page "), F.col("page").cast("string"), section, F.lit("]\n"), "page_content")
    g = _cited_pages(spark, directory).groupBy("id", "file").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("s"), F.min("pos").alias("first"))
    g = g.withColumn("ordinal", F.row_number().over(Window.partitionBy("id").orderBy("first")))
    return g.select("id", "file", F.sha2(F.array_join(F.col("s.part"), "\n\n"), 256).alias("block_sha"), "ordinal")


def _swap_sql(docs: str) -> str:
    return (
        f"""WITH {_bm25_sql(20, docs)}, ch AS (SELECT l.source_row, l.rank, l.doc_id, l.doc_id // 10 AS parent_id FROM lex l), p AS (SELECT source_row, parent_id, min(rank) AS first_rank, list(doc_id ORDER BY rank) AS children FROM ch GROUP BY 1, 2)"""
        " SELECT source_row, parent_id, CAST(first_rank AS INT) AS first_rank, children, CAST(row_number() OVER (PARTITION BY source_row ORDER BY first_rank) AS INT) AS rank FROM p"
    )


def _swapped(spark: SparkSession, directory: str, corpus: DataFrame) -> DataFrame:
    """Hits replaced by their parents (ten documents each here), in the order first seen, children in rank order."""
    hits = rt.bm25(_questions(spark, directory), "source_row", "question", corpus, "doc_id", "text", 20)
    g = hits.withColumn("parent_id", F.floor(F.col("doc_id") / 10)).groupBy("source_row", "parent_id").agg(F.min("rank").alias("first_rank"), F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("s"))
    w = Window.partitionBy("source_row").orderBy("first_rank")
    return g.select("source_row", "parent_id", "first_rank", F.col("s.doc_id").alias("children"), F.row_number().over(w).alias("rank"))


@REGISTRY.query("parent_swap", _swap_sql(_D))
def parent_swap(spark: SparkSession, directory: str) -> DataFrame:
    return _swapped(spark, directory, _tenant(spark, directory))


@REGISTRY.query("parent_swap_all", _swap_sql(_D_ALL))
def parent_swap_all(spark: SparkSession, directory: str) -> DataFrame:
    return _swapped(spark, directory, _everything(spark, directory))


_CHUNK_DOCS = f"(SELECT page_id * 10000 + i AS doc_id, substr(page_content, CAST(i * 300 + 1 AS INT), 350) AS text FROM (SELECT *, unnest(generate_series(0, greatest(0, (length(page_content) - 51) // 300))) AS i FROM ({_LATEST}) WHERE length(page_content) > 0))"


@REGISTRY.query(
    "chunk_search",
    f"WITH {_bm25_sql(20, _CHUNK_DOCS)}, p AS (SELECT source_row, doc_id // 10000 AS page_id, CAST(min(rank) AS INT) AS first_rank FROM lex GROUP BY 1, 2) "
    "SELECT source_row, page_id, first_rank, CAST(row_number() OVER (PARTITION BY source_row ORDER BY first_rank) AS INT) AS rank FROM p QUALIFY rank <= 5",
)
def chunk_search(spark: SparkSession, directory: str) -> DataFrame:
    """BM25 over window chunks of all pages, hits swapped for their pages."""
    pages = latest_pages(spark, directory)
    chunks = window_chunks(pages.select("page_id", "page_content"), "page_content").withColumn("chunk_id", F.col("page_id") * 10000 + F.col("chunk_no"))
    hits = rt.bm25(_questions(spark, directory), "source_row", "question", chunks, "chunk_id", "chunk", 20)
    parents = hits.withColumn("page_id", F.floor(F.col("chunk_id") / 10000)).groupBy("source_row", "page_id").agg(F.min("rank").alias("first_rank"))
    return parents.withColumn("rank", F.row_number().over(Window.partitionBy("source_row").orderBy("first_rank"))).filter("rank <= 5")


def _children(spark: SparkSession, directory: str) -> DataFrame:
    """Pages as children; three pages of a file make a parent; a page without a section has none. Written once, as the chain reads them often."""
    parent = F.when(F.col("section") != "", F.concat_ws("#", "source_file", F.floor((F.col("page") - 1) / 3).cast("string")))
    return cut(latest_pages(spark, directory).select("page_id", "page", "page_content", parent.alias("parent_id")))


def _parents(children: DataFrame) -> DataFrame:
    pages = F.array_sort(F.collect_list(F.struct("page", "page_content")))  # three pages
    return children.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(pages.alias("p")).select("parent_id", F.array_join(F.col("p.page_content"), "\n").alias("parent_text"))


def _whole_sql(k: int) -> str:
    """Dense and lexical lists over pages, and their fusion f, all of k."""
    split = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> '')"
    letters = lambda c: "[" + ", ".join(f"CAST(length(lower({c})) - length(replace(lower({c}), '{x}', '')) AS DOUBLE)" for x in LETTERS) + "]"
    return rf"""ch AS (SELECT page_id, page, page_content, CASE WHEN section <> '' THEN source_file || '#' || ((page - 1) // 3) END AS parent_id FROM ({_LATEST})),
par AS (SELECT parent_id, string_agg(page_content, chr(10) ORDER BY page) AS parent_text FROM ch WHERE parent_id IS NOT NULL GROUP BY 1),
a AS (SELECT source_row, question, {letters("question")} AS v FROM {_Q}), b AS (SELECT page_id, {letters("page_content")} AS v FROM ch),
dense AS (SELECT source_row, page_id, row_number() OVER (PARTITION BY source_row ORDER BY score DESC, page_id) AS rank FROM (SELECT source_row, page_id, round({_COSINE}, 6) AS score FROM a, b) QUALIFY rank <= {k}),
ds AS (SELECT page_id, {split("page_content")} AS ts FROM ch), n AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_dl FROM ds),
tf AS (SELECT page_id, dl, term, count(*) AS tf FROM (SELECT page_id, len(ts) AS dl, unnest(ts) AS term FROM ds) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), i0 AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS i FROM df, n),
idf AS (SELECT term, CASE WHEN i < 0 THEN (SELECT avg(i) * 0.25 FROM i0) ELSE i END AS idf FROM i0),
qs AS (SELECT source_row, term, count(*) AS qtf FROM (SELECT source_row, unnest({split("question")}) AS term FROM {_Q}) GROUP BY 1, 2),
sc AS (SELECT source_row, page_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM qs JOIN tf USING (term) JOIN idf USING (term), n GROUP BY 1, 2),
lex AS (SELECT a.source_row, ds.page_id, coalesce(sc.score, 0) AS score, row_number() OVER (PARTITION BY a.source_row ORDER BY coalesce(sc.score, 0) DESC, ds.page_id) AS rank FROM a CROSS JOIN ds LEFT JOIN sc ON sc.source_row = a.source_row AND sc.page_id = ds.page_id QUALIFY rank <= {k}),
f0 AS (SELECT source_row, page_id, round(sum(0.5 / (60 + rank)), 9) AS score FROM (SELECT source_row, page_id, rank FROM dense UNION ALL SELECT source_row, page_id, rank FROM lex) GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY source_row ORDER BY score DESC, page_id) AS rank FROM f0)"""


def _hybrid_pages_sql(fetched: int, kept: int) -> str:
    return rf"""WITH {_whole_sql(fetched)}, h AS (SELECT f.source_row, f.rank, ch.page, ch.parent_id, CASE WHEN ch.parent_id IS NULL THEN f.page_id END AS page_id FROM f JOIN ch USING (page_id) WHERE f.rank <= {fetched}),
hp AS (SELECT source_row, parent_id, page_id, page, min(rank) AS rank FROM h GROUP BY ALL), s AS (SELECT source_row, parent_id, page_id, list(page ORDER BY rank) AS pages, min(rank) AS first_rank FROM hp GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_row ORDER BY parent_id IS NULL, first_rank) AS place FROM s),
x AS (SELECT r.*, list_distinct(list_filter(regexp_split_to_array(lower(a.question), '\s+'), lambda t: t <> '')) AS qt, list_filter(regexp_split_to_array(lower(coalesce(par.parent_text, own.page_content)), '\s+'), lambda t: t <> '') AS ct
  FROM r JOIN a USING (source_row) LEFT JOIN par ON par.parent_id = r.parent_id LEFT JOIN ch own ON own.page_id = r.page_id),
y AS (SELECT *, round(len(list_intersect(qt, ct)) / len(qt), 6) AS score FROM x)
SELECT source_row, parent_id, page_id, pages, score, CAST(row_number() OVER (PARTITION BY source_row ORDER BY score DESC, place) AS INT) AS rank FROM y QUALIFY rank <= {kept}"""


def _hybrid_pages(spark: SparkSession, directory: str, intent: str) -> DataFrame:
    children = _children(spark, directory)
    return whole_search(_questions(spark, directory), "source_row", "question", children, "page_id", "page_content", _parents(children), *DEPTHS[intent])


@REGISTRY.query("hybrid_fact", _hybrid_pages_sql(10, 3))
def hybrid_fact(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors and BM25 over all pages, fused, swapped to parents with their pages, reranked: 10 fetched, 3 kept."""
    return _hybrid_pages(spark, directory, "fact")


@REGISTRY.query("hybrid_analytical", _hybrid_pages_sql(20, 5))
def hybrid_analytical(spark: SparkSession, directory: str) -> DataFrame:
    """As hybrid_fact, 20 fetched, 5 kept."""
    return _hybrid_pages(spark, directory, "analytical")


@REGISTRY.query("bm25_okapi", f"WITH {_whole_sql(10)} SELECT source_row, page_id, score, CAST(rank AS INT) AS rank FROM lex")
def bm25_okapi(spark: SparkSession, directory: str) -> DataFrame:
    """Terms as they stand, idf with a floor, always ten rows."""
    return rt.bm25(_questions(spark, directory), "source_row", "question", _children(spark, directory), "page_id", "page_content", 10, mode="okapi_floor", lower=False, pad=True)


@REGISTRY.query("hybrid_fused", f"WITH {_whole_sql(10)} SELECT source_row, page_id, score, CAST(rank AS INT) AS rank FROM f")
def hybrid_fused(spark: SparkSession, directory: str) -> DataFrame:
    return fused_hits(_questions(spark, directory), "source_row", "question", _children(spark, directory), "page_id", "page_content", 10)


@REGISTRY.query(
    "term_statistics",
    r"""WITH t AS (SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS ts FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM t),
    d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM t) GROUP BY 1), i AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM d, n)
    SELECT term, df, round(CASE WHEN i < 0 THEN (SELECT avg(i) * 0.25 FROM i) ELSE i END, 6) AS idf FROM i""".replace("\\\\", "\\"),
)
def term_statistics(spark: SparkSession, directory: str) -> DataFrame:
    """The lexical index of a snapshot: what every search of it reads instead of counting again."""
    return rt.term_idf(_everything(spark, directory), "text", "okapi_floor", lower=False).select("term", "df", F.round("idf", 6).alias("idf"))
