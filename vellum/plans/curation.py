"""Queries of provenance, curation and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.provenance import paragraph_votes, provenance
from vellum.plans import REGISTRY
from vellum.sources.tables import table

_PROV = r"""WITH p AS (SELECT source_row, trim(regexp_replace(lower(reference_contexts[1]), '\s+', ' ', 'g')) AS p FROM golden_dataset WHERE source_row % 20 = 0),
d AS (SELECT page_id, trim(regexp_replace(lower(page_content), '\s+', ' ', 'g')) AS t FROM document_pages),
h AS (SELECT p.source_row, d.page_id, CASE WHEN contains(t, substr(p, 1, 400)) THEN 400 WHEN contains(t, substr(p, 1, 250)) THEN 250 WHEN contains(t, substr(p, 1, 150)) THEN 150 ELSE 80 END AS prefix FROM p JOIN d ON contains(t, substr(p, 1, 80)) WHERE length(substr(p, 1, 80)) >= 40),
b AS (SELECT source_row, prefix, min(page_id) AS page_id, count(*) AS n_docs FROM h GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source_row ORDER BY prefix DESC) = 1),
r AS (SELECT p.source_row, b.page_id, CAST(b.prefix AS INT) AS prefix, coalesce(n_docs, 0) AS n_docs, CASE WHEN coalesce(p.p, '') = '' THEN 'no_reference_contexts' WHEN b.page_id IS NULL THEN 'no_match' WHEN n_docs > 1 THEN 'ambiguous' ELSE 'matched' END AS reason FROM p LEFT JOIN b USING (source_row))
"""


def _provenance(spark: SparkSession, directory: str, which: str = "true") -> DataFrame:
    g = table(spark, directory, "golden_dataset", "source_row", "reference_contexts").filter(which).select("source_row", F.get("reference_contexts", F.lit(0)).alias("passage"))
    return provenance(g, "source_row", "passage", table(spark, directory, "document_pages", "page_id", "page_content"), "page_id", "page_content")


_TWENTIETH = "source_row % 20 = 0"


@REGISTRY.query("provenance_match", _PROV + "SELECT * FROM r")
def provenance_match(spark: SparkSession, directory: str) -> DataFrame:
    """Every 20th row, as the SQL compares each with all pages; provenance_match_all has all rows."""
    return _provenance(spark, directory, _TWENTIETH)


@REGISTRY.query("provenance_match_all")
def provenance_match_all(spark: SparkSession, directory: str) -> DataFrame:
    return _provenance(spark, directory)


def _reasons(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("match_summary", _PROV + "SELECT reason, count(*) AS n FROM r GROUP BY 1")
def match_summary(spark: SparkSession, directory: str) -> DataFrame:
    return _reasons(_provenance(spark, directory, _TWENTIETH))


@REGISTRY.query("match_summary_all")
def match_summary_all(spark: SparkSession, directory: str) -> DataFrame:
    return _reasons(_provenance(spark, directory))


@REGISTRY.query("provenance_vote", r"""WITH g AS (SELECT source_row, unnest(list_distinct(regexp_extract_all(lower(array_to_string(reference_contexts, ' ')), 'section \d+\.\d+'))) AS s FROM golden_dataset),
d AS (SELECT DISTINCT source_file, s FROM (SELECT source_file, unnest(regexp_extract_all(lower(page_content), 'section \d+\.\d+')) AS s FROM document_pages)),
v AS (SELECT source_row, source_file, count(*) AS votes FROM g JOIN d USING (s) GROUP BY 1, 2) SELECT source_row, source_file, votes FROM v QUALIFY rank() OVER (PARTITION BY source_row ORDER BY votes DESC) = 1""")
def provenance_vote(spark: SparkSession, directory: str) -> DataFrame:
    """Files by how many of a row's cited sections they hold; all with the most votes."""
    found = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"section \d+\.\d+"), F.lit(0))
    g = table(spark, directory, "golden_dataset", "source_row", "reference_contexts").select("source_row", F.explode(F.array_distinct(found(F.array_join("reference_contexts", " ")))).alias("s"))
    d = table(spark, directory, "document_pages", "source_file", "page_content").select("source_file", F.explode(F.array_distinct(found(F.col("page_content")))).alias("s")).distinct()
    votes = g.join(d, "s").groupBy("source_row", "source_file").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("source_row").orderBy(F.desc("votes"))
    return votes.withColumn("r", F.rank().over(w)).filter("r = 1").drop("r")


def _files(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "document_pages", "source_file", "page_content")


@REGISTRY.query("provenance_files")
def provenance_files(spark: SparkSession, directory: str) -> DataFrame:
    """Which file each first context of the golden set came from."""
    g = table(spark, directory, "golden_dataset", "source_row", "reference_contexts").select("source_row", F.get("reference_contexts", F.lit(0)).alias("passage"))
    return provenance(g, "source_row", "passage", _files(spark, directory), "source_file", "page_content")


@REGISTRY.query(
    "paragraph_votes",
    r"""WITH g AS (SELECT source_row, substr(trim(regexp_replace(lower(p), '\s+', ' ', 'g')), 1, 200) AS probe FROM (SELECT source_row, unnest(string_split(reference_contexts[1], chr(10) || chr(10))) AS p FROM golden_dataset)),
    d AS (SELECT source_file, trim(regexp_replace(lower(page_content), '\s+', ' ', 'g')) AS t FROM document_pages),
    n AS (SELECT source_row, probe, count(*) AS times FROM g WHERE length(probe) >= 30 GROUP BY 1, 2), h AS (SELECT DISTINCT source_row, probe, times, source_file FROM n JOIN d ON contains(t, probe))
    SELECT source_row, source_file, CAST(sum(times) AS BIGINT) AS votes FROM h GROUP BY 1, 2 QUALIFY rank() OVER (PARTITION BY source_row ORDER BY sum(times) DESC) = 1""".replace("\\\\", "\\"),
)
def paragraph_vote(spark: SparkSession, directory: str) -> DataFrame:
    """The files that hold most paragraphs of each first context; all with the most votes."""
    g = table(spark, directory, "golden_dataset", "source_row", "reference_contexts").select("source_row", F.get("reference_contexts", F.lit(0)).alias("passage"))
    return paragraph_votes(g, "source_row", "passage", _files(spark, directory), "source_file", "page_content")


@REGISTRY.query("round_robin", "SELECT page_id, source_file, rn FROM (SELECT page_id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY CAST(page AS VARCHAR), length(page_content), page_id) AS rn FROM document_pages) ORDER BY rn, source_file, page_id LIMIT 120")
def round_robin(spark: SparkSession, directory: str) -> DataFrame:
    """One page of each file in turn, 120 in all."""
    w = Window.partitionBy("source_file").orderBy(F.col("page").cast("string"), F.length("page_content"), "page_id")
    p = table(spark, directory, "document_pages", "page_id", "source_file", "page", "page_content").withColumn("rn", F.row_number().over(w))
    return p.select("page_id", "source_file", F.col("rn").cast("bigint").alias("rn")).orderBy("rn", "source_file", "page_id").limit(120)


@REGISTRY.query("stratified_sample", "SELECT source_row, doc_category FROM golden_dataset QUALIFY row_number() OVER (PARTITION BY doc_category ORDER BY sha256('7:' || source_row), source_row) <= 7")
def stratified_sample(spark: SparkSession, directory: str) -> DataFrame:
    """Seven rows a category in the order of a seeded hash."""
    w = Window.partitionBy("doc_category").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("source_row").cast("string")), 256), "source_row")
    return table(spark, directory, "golden_dataset", "source_row", "doc_category").withColumn("rn", F.row_number().over(w)).filter("rn <= 7").drop("rn")


@REGISTRY.query("overlap_contracts", "SELECT source_file, count(DISTINCT lower(section)) AS n, min(page_id) AS first_id FROM document_pages WHERE section IS NOT NULL GROUP BY 1 ORDER BY n DESC, first_id LIMIT 12")
def overlap_contracts(spark: SparkSession, directory: str) -> DataFrame:
    """The twelve files with the most different sections."""
    p = table(spark, directory, "document_pages", "source_file", "section", "page_id").filter("section IS NOT NULL")
    g = p.groupBy("source_file").agg(F.count_distinct(F.lower("section")).alias("n"), F.min("page_id").alias("first_id"))
    return g.orderBy(F.desc("n"), "first_id").limit(12)


@REGISTRY.query("category_counts", "SELECT doc_category, count(*) AS raw, count(*) FILTER (length(ground_truth) >= 5) AS usable, list(source_row ORDER BY source_row)[1:2] AS samples FROM golden_dataset GROUP BY 1")
def category_counts(spark: SparkSession, directory: str) -> DataFrame:
    g = table(spark, directory, "golden_dataset", "doc_category", "ground_truth", "source_row")
    first = F.min("source_row")
    a = g.groupBy("doc_category").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.length("ground_truth") >= 5).alias("usable"), first.alias("s1"))
    # the second sample without collecting the group: the least above the first
    b = g.join(a.select("doc_category", "s1"), g.doc_category.eqNullSafe(a.doc_category)).filter("source_row > s1").groupBy("s1").agg(F.min("source_row").alias("s2"))
    return a.join(b, "s1", "left").select("doc_category", "raw", "usable", F.array_compact(F.array("s1", "s2")).alias("samples"))


_DIST = "WITH cited AS (SELECT DISTINCT doc_source_file AS f FROM ragas_eval_results WHERE doc_source_file <> '' AND faithfulness >= 0.97) SELECT source_file, count(*) AS n_pages FROM document_pages WHERE source_file NOT IN (SELECT f FROM cited) GROUP BY 1"


@REGISTRY.query("distractors", _DIST)
def distractors(spark: SparkSession, directory: str) -> DataFrame:
    """Files that no well-answered question asks for."""
    cited = table(spark, directory, "ragas_eval_results", "doc_source_file", "faithfulness").filter("faithfulness >= 0.97").select(F.col("doc_source_file").alias("source_file")).filter("source_file <> ''").distinct()
    return table(spark, directory, "document_pages", "source_file").join(cited, "source_file", "left_anti").groupBy("source_file").agg(F.count(F.lit(1)).alias("n_pages"))


@REGISTRY.query("missing_titles", "SELECT DISTINCT source_file AS title FROM document_pages EXCEPT SELECT source_file FROM document_jobs WHERE status = 'failed'")
def missing_titles(spark: SparkSession, directory: str) -> DataFrame:
    """Wanted names without those found: a set difference."""
    wanted = table(spark, directory, "document_pages", "source_file").select(F.col("source_file").alias("title"))
    return wanted.subtract(table(spark, directory, "document_jobs", "source_file", "status").filter("status = 'failed'").select("source_file"))


@REGISTRY.query("name_match", "SELECT DISTINCT j.source_file AS wanted, p.source_file AS found FROM document_jobs j JOIN (SELECT DISTINCT source_file FROM document_pages) p ON regexp_replace(regexp_replace(lower(j.source_file), '\\.pdf$', '', 'g'), '[^a-z0-9]', '', 'g') = regexp_replace(regexp_replace(lower(p.source_file), '\\.pdf$', '', 'g'), '[^a-z0-9]', '', 'g')")
def name_match(spark: SparkSession, directory: str) -> DataFrame:
    """Names that are equal once extension, case and punctuation are gone."""
    a = table(spark, directory, "document_jobs", "source_file").distinct().select(F.col("source_file").alias("wanted"), tx.normal_name(F.col("source_file")).alias("k"))
    b = table(spark, directory, "document_pages", "source_file").distinct().select(F.col("source_file").alias("found"), tx.normal_name(F.col("source_file")).alias("k"))
    return a.join(b, "k").select("wanted", "found")


@REGISTRY.query("golden_join", "SELECT g.source_row, min(nullif(r.doc_source_file, '')) AS source_file, count(r.result_id) AS results FROM golden_dataset g LEFT JOIN ragas_eval_results r USING (source_row) GROUP BY 1")
def golden_join(spark: SparkSession, directory: str) -> DataFrame:
    r = table(spark, directory, "ragas_eval_results", "source_row", "doc_source_file", "result_id")
    r = r.groupBy("source_row").agg(F.min(F.nullif("doc_source_file", F.lit(""))).alias("source_file"), F.count("result_id").alias("results"))
    return table(spark, directory, "golden_dataset", "source_row").join(r, "source_row", "left").select("source_row", "source_file", F.coalesce("results", F.lit(0)).alias("results"))


@REGISTRY.query("resume_anti", "SELECT source_row FROM golden_dataset g WHERE NOT EXISTS (SELECT 1 FROM ragas_eval_results r WHERE r.source_row = g.source_row AND r.faithfulness >= 0.7)")
def resume_anti(spark: SparkSession, directory: str) -> DataFrame:
    """Rows still to do: without a result that scored well enough."""
    done = table(spark, directory, "ragas_eval_results", "source_row", "faithfulness").filter("faithfulness >= 0.7")
    return table(spark, directory, "golden_dataset", "source_row").join(done, "source_row", "left_anti")


@REGISTRY.query("repair_semi", "SELECT source_row, question FROM golden_dataset WHERE source_row IN (SELECT source_row FROM ragas_eval_results WHERE faithfulness IS NULL)")
def repair_semi(spark: SparkSession, directory: str) -> DataFrame:
    bad = table(spark, directory, "ragas_eval_results", "source_row", "faithfulness").filter("faithfulness IS NULL")
    return table(spark, directory, "golden_dataset", "source_row", "question").join(bad, "source_row", "left_semi")


_M = ["faithfulness", "answer_relevancy", "context_precision"]


@REGISTRY.query("missing_metric", "SELECT doc_category, count(*) AS n, " + ", ".join(f"count(*) FILTER ({m} IS NULL) AS no_{m}" for m in _M) + " FROM ragas_eval_results GROUP BY 1")
def missing_metric(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "ragas_eval_results", "doc_category", *_M).groupBy("doc_category").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(m).isNull()).alias(f"no_{m}") for m in _M])


@REGISTRY.query("metric_means", "SELECT " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _M) + ", count(*) AS n FROM ragas_eval_results")
def metric_means(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "ragas_eval_results", *_M).agg(*[F.round(F.avg(m), 6).alias(m) for m in _M], F.count(F.lit(1)).alias("n"))


@REGISTRY.query("metric_quartiles", " UNION ALL ".join(f"SELECT '{m}' AS metric, min({m}) AS min, round(quantile_cont({m}, 0.25), 6) AS q1, round(quantile_cont({m}, 0.5), 6) AS q2, round(quantile_cont({m}, 0.75), 6) AS q3, max({m}) AS max FROM ragas_eval_results" for m in _M))
def metric_quartiles(spark: SparkSession, directory: str) -> DataFrame:
    r = table(spark, directory, "ragas_eval_results", *_M)
    long = r.select(F.explode(F.create_map(*[x for m in _M for x in (F.lit(m), F.col(m))])).alias("metric", "v"))
    q = lambda p, n: F.round(F.percentile("v", F.lit(p)), 6).alias(n)
    return long.groupBy("metric").agg(F.min("v").alias("min"), q(0.25, "q1"), q(0.5, "q2"), q(0.75, "q3"), F.max("v").alias("max"))


_I = "CASE lower(golden_intent) WHEN 'factual' THEN 'fact' ELSE lower(golden_intent) END"


def _intent(column: str) -> F.Column:
    low = F.lower(column)
    return F.when(low == "factual", "fact").otherwise(low)


@REGISTRY.query("metric_by_intent", f"SELECT intent, count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _M) + f" FROM (SELECT *, {_I} AS intent FROM ragas_eval_results) GROUP BY GROUPING SETS ((intent), ())")
def metric_by_intent(spark: SparkSession, directory: str) -> DataFrame:
    """By intent, and overall in the row of null."""
    r = table(spark, directory, "ragas_eval_results", "golden_intent", *_M).withColumn("intent", _intent("golden_intent"))
    return r.groupingSets([["intent"], []], "intent").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in _M])


@REGISTRY.query("intent_summary", "SELECT intent, synthesizer, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE lower(intent) WHEN 'factual' THEN 'fact' ELSE lower(intent) END AS intent, synthesizer FROM golden_dataset) GROUP BY 1, 2")
def intent_summary(spark: SparkSession, directory: str) -> DataFrame:
    g = table(spark, directory, "golden_dataset", "intent", "synthesizer")
    n = g.groupBy(_intent("intent").alias("intent"), "synthesizer").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / g.agg(F.count(F.lit(1)).alias("t")).scalar(), 6))


@REGISTRY.query("genuine_perfect", "SELECT result_id FROM ragas_eval_results WHERE faithfulness >= 0.99 AND answer_relevancy IS NOT NULL AND evaluation_error IS NULL")
def genuine_perfect(spark: SparkSession, directory: str) -> DataFrame:
    r = table(spark, directory, "ragas_eval_results", "result_id", "faithfulness", "answer_relevancy", "evaluation_error")
    return r.filter("faithfulness >= 0.99 AND answer_relevancy IS NOT NULL AND evaluation_error IS NULL").select("result_id")


@REGISTRY.query("refusal_scoring", f"SELECT result_id, CASE WHEN {_I} = 'guardrail' THEN 1.0::DOUBLE ELSE faithfulness END AS faithfulness, CASE WHEN {_I} <> 'guardrail' THEN answer_relevancy END AS answer_relevancy FROM ragas_eval_results WHERE pipeline_error = ''")
def refusal_scoring(spark: SparkSession, directory: str) -> DataFrame:
    """A refusal that is due counts as faithful and has no other metric."""
    r = table(spark, directory, "ragas_eval_results", "result_id", "golden_intent", "faithfulness", "answer_relevancy", "pipeline_error").filter("pipeline_error = ''")
    due = _intent("golden_intent") == "guardrail"
    return r.select("result_id", F.when(due, 1.0).otherwise(F.col("faithfulness")).alias("faithfulness"), F.when(~due, F.col("answer_relevancy")).alias("answer_relevancy"))


@REGISTRY.query("context_precision", "WITH c AS (SELECT result_id, i, CASE WHEN contains(lower(c), lower(substr(reference, 1, 12))) THEN 1 ELSE 0 END AS rel FROM (SELECT result_id, reference, unnest(retrieved_contexts) AS c, generate_subscripts(retrieved_contexts, 1) AS i FROM ragas_eval_results WHERE reference IS NOT NULL)), p AS (SELECT *, avg(rel) OVER (PARTITION BY result_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p_at FROM c) SELECT result_id, round(coalesce(sum(p_at * rel) / nullif(sum(rel), 0), 0), 6) AS precision FROM p GROUP BY 1")
def context_precision(spark: SparkSession, directory: str) -> DataFrame:
    """Rank-weighted mean of relevance bits, inside one array: no shuffle. The bit stands in for a judge's and asks for the first
    twelve characters of the reference only; context_precision_all asks for the whole."""
    r = _retrieved(spark, directory)
    return _precision(r, F.transform("retrieved_contexts", lambda c: F.coalesce(F.contains(F.lower(c), F.lower(F.substring("reference", 1, 12))).cast("int"), F.lit(0))))


def _retrieved(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "ragas_eval_results", "result_id", "reference", "retrieved_contexts").filter("reference IS NOT NULL AND size(retrieved_contexts) > 0")


def _precision(r: DataFrame, bits: F.Column) -> DataFrame:
    r = r.withColumn("bits", bits)
    upto = F.transform("bits", lambda b, i: F.aggregate(F.slice("bits", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) / (i + 1) * b)
    total = F.aggregate("bits", F.lit(0), lambda a, x: a + x)
    score = F.when(total == 0, 0.0).otherwise(F.aggregate(upto, F.lit(0.0), lambda a, x: a + x) / total)
    return r.select("result_id", F.round(score, 6).alias("precision"))


#: A context is relevant if it holds so large a part of the reference's word runs.
HELD = 0.5


@REGISTRY.query("context_precision_all")
def context_precision_all(spark: SparkSession, directory: str) -> DataFrame:
    """As context_precision, with a bit by the whole reference: whether the context holds HELD of its runs of RUN words (of all
    its words, where they are fewer). The bit stands in for a judge's; a reference without words makes none relevant."""
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))
    r = _retrieved(spark, directory).withColumn("asked", F.when(words(F.col("reference")) != "", words(F.col("reference"))))
    few = F.size(F.split("asked", " ")) < tx.RUN
    r = r.withColumn("runs", F.when(~few, tx.word_runs(F.col("asked"))))

    def bit(c: F.Column) -> F.Column:
        held = F.size(F.array_intersect("runs", tx.word_runs(words(c)))) / F.size("runs")
        whole = F.contains(F.concat(F.lit(" "), words(c), F.lit(" ")), F.concat(F.lit(" "), "asked", F.lit(" ")))
        return F.coalesce(F.when(few, whole).otherwise(held >= HELD).cast("int"), F.lit(0))

    return _precision(r, F.transform("retrieved_contexts", bit))


_CLAIMS = r"""WITH c AS (SELECT result_id, retrieved_contexts, unnest(regexp_extract_all(response, '[^.!?\n]+[.!?]?')) AS claim FROM ragas_eval_results WHERE response IS NOT NULL),
k AS (SELECT result_id, trim(lower(claim)) AS claim, bool_or(coalesce(contains(lower(array_to_string(retrieved_contexts, ' ')), trim(lower(claim))), false)) AS ok FROM c WHERE trim(claim) <> '' GROUP BY 1, 2)"""


def _claims(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct claims of each answer as an array with whether its contexts hold them; a row stays a row."""
    r = table(spark, directory, "ragas_eval_results", "result_id", "response", "retrieved_contexts").filter("response IS NOT NULL")
    found = F.filter(F.transform(F.regexp_extract_all("response", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), lambda c: F.trim(F.lower(c))), lambda c: c != "")
    context = F.lower(F.coalesce(F.array_join("retrieved_contexts", " "), F.lit("")))
    return r.select("result_id", F.transform(F.array_distinct(found), lambda c: F.struct(c.alias("claim"), F.contains(context, c).alias("ok"))).alias("claims"))


@REGISTRY.query("claim_verify", _CLAIMS + " SELECT result_id, claim, ok FROM k")
def claim_verify(spark: SparkSession, directory: str) -> DataFrame:
    return _claims(spark, directory).select("result_id", F.inline("claims"))


@REGISTRY.query("claim_report", _CLAIMS + ", r AS (SELECT result_id, count(k.claim) AS total, count(*) FILTER (ok) AS supported FROM (SELECT result_id FROM ragas_eval_results WHERE response IS NOT NULL) LEFT JOIN k USING (result_id) GROUP BY 1) SELECT result_id, total, supported, round(CASE WHEN total = 0 THEN 1 ELSE supported * 1.0 / total END, 6) AS score, CASE WHEN supported = total THEN 'PASS' WHEN supported = 0 THEN 'FAIL' ELSE 'PARTIAL' END AS verdict FROM r")
def claim_report(spark: SparkSession, directory: str) -> DataFrame:
    c = _claims(spark, directory).select("result_id", F.size("claims").cast("bigint").alias("total"), F.size(F.filter("claims", lambda x: x["ok"])).cast("bigint").alias("supported"))
    score = F.round(F.when(F.col("total") == 0, 1.0).otherwise(F.col("supported") / F.col("total")), 6)
    verdict = F.when(F.col("supported") == F.col("total"), "PASS").when(F.col("supported") == 0, "FAIL").otherwise("PARTIAL")
    return c.select("result_id", "total", "supported", score.alias("score"), verdict.alias("verdict"))
