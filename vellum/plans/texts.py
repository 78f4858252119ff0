"""Queries of text normalisation, gates, pages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.chunks import window_chunks
from vellum.plans import REGISTRY
from vellum.sources.tables import table


def _any(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{p}')" for p in phrases) + ")"


_NORM = r"regexp_replace(regexp_replace(regexp_replace(text, '\x00', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@REGISTRY.query("norm_text", f"SELECT doc_id, lower({_NORM}) AS norm_a, {_NORM} AS norm_b FROM documents")
def norm_text(spark: SparkSession, directory: str) -> DataFrame:
    t = F.col("text")
    return table(spark, directory, "documents").select("doc_id", tx.normal_space(t).alias("norm_a"), tx.normal_space(t, lower=False).alias("norm_b"))


@REGISTRY.query("fingerprint", f"SELECT doc_id, sha256(lower({_NORM})) AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"))


@REGISTRY.query("dedup_chunks", f"SELECT min(doc_id) AS doc_id, sha256(lower({_NORM})) AS fingerprint, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 2")
def dedup_chunks(spark: SparkSession, directory: str) -> DataFrame:
    """The first of each group of equal texts; a min combines on the map side where a window would not."""
    d = table(spark, directory, "documents").filter("text IS NOT NULL")
    return d.groupBy(tx.fingerprint(F.col("text")).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@REGISTRY.query("usable_chunks", f"SELECT source, count(*) AS n, count(*) FILTER (length({_NORM}) >= 350) AS usable FROM documents GROUP BY 1")
def usable_chunks(spark: SparkSession, directory: str) -> DataFrame:
    long = F.length(tx.normal_space(F.col("text"), lower=False)) >= 350
    return table(spark, directory, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(long).alias("usable"))


@REGISTRY.query("clean_text", r"SELECT page_id, regexp_replace(regexp_replace(page_content, '-\s*\n\s*', '', 'g'), '[ \t]{2,}', ' ', 'g') AS clean FROM document_pages")
def clean_text(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "document_pages").select("page_id", tx.clean_page(F.col("page_content")).alias("clean"))


@REGISTRY.query("preview", "SELECT page_id, substr(page_content, 1, 300) || '...' AS preview FROM document_pages")
def preview(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "document_pages").select("page_id", tx.preview(F.col("page_content")).alias("preview"))


@REGISTRY.query("intent_classify", f"SELECT source_row, CASE WHEN {_any('question', tx.ANALYTICAL_PHRASES)} THEN 'analytical' ELSE 'fact' END AS class FROM golden_dataset")
def intent_classify(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "golden_dataset").select("source_row", tx.intent(F.col("question")).alias("class"))


@REGISTRY.query("offtopic_gate", f"SELECT id, {_any('content', tx.OFF_TOPIC_PHRASES)} AS off_topic FROM chat_messages WHERE content IS NOT NULL")
def offtopic_gate(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "chat_messages").filter("content IS NOT NULL").select("id", tx.contains_any(F.col("content"), tx.OFF_TOPIC_PHRASES).alias("off_topic"))


@REGISTRY.query("needs_rephrase", rf"SELECT source_row, regexp_matches(question, '(?i)\b({tx.REFERENCE_WORDS})\b') AS refers FROM golden_dataset WHERE regexp_matches(question, '^[\x00-\x7f]*$')")
def needs_rephrase(spark: SparkSession, directory: str) -> DataFrame:
    """Questions in ASCII, for which any engine's word ends serve; needs_rephrase_all has all."""
    return table(spark, directory, "golden_dataset").filter(F.col("question").rlike(r"^[\x00-\x7f]*$")).select("source_row", tx.refers_back(F.col("question")).alias("refers"))


_BESIDE = rf"(?:^|{tx.BESIDE})(?:{tx.REFERENCE_WORDS})(?:$|{tx.BESIDE})"


@REGISTRY.query("needs_rephrase_all", f"SELECT source_row, regexp_matches(question, '(?i){_BESIDE}') AS refers FROM golden_dataset")
def needs_rephrase_all(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "golden_dataset", "source_row", "question").select("source_row", tx.refers_back(F.col("question")).alias("refers"))


@REGISTRY.query("refusal_flag", f"SELECT result_id, {_any('response', tx.REFUSAL_MARKERS['service'])} AS service, {_any('response', tx.REFUSAL_MARKERS['evaluation'])} AS evaluation FROM ragas_eval_results WHERE response IS NOT NULL")
def refusal_flag(spark: SparkSession, directory: str) -> DataFrame:
    r = table(spark, directory, "ragas_eval_results").filter("response IS NOT NULL")
    return r.select("result_id", *[tx.contains_any(F.col("response"), m).alias(n) for n, m in tx.REFUSAL_MARKERS.items() if n != "first"])


@REGISTRY.query("section_hint", rf"""SELECT page_id, nullif(substr(regexp_replace(regexp_extract(substr(page_content, 1, 500),
  '{tx.SECTION_PATTERN}', 0), '^\s+|\s+$', '', 'g'), 1, 100), '') AS hint FROM document_pages WHERE NOT contains(page_content, chr(13))""")
def section_hint(spark: SparkSession, directory: str) -> DataFrame:
    p = table(spark, directory, "document_pages").filter(~F.contains("page_content", F.lit("\r")))
    return p.select("page_id", tx.section_hint(F.col("page_content")).alias("hint"))


@REGISTRY.query("section_hint_all", rf"""SELECT page_id, nullif(substr(regexp_replace(regexp_extract(regexp_replace(substr(page_content, 1, 500), '\r\n?', chr(10), 'g'),
  '{tx.SECTION_PATTERN}', 0), '^\s+|\s+$', '', 'g'), 1, 100), '') AS hint FROM document_pages""")
def section_hint_all(spark: SparkSession, directory: str) -> DataFrame:
    """Pages with carriage returns too."""
    return table(spark, directory, "document_pages", "page_id", "page_content").select("page_id", tx.section_hint(F.col("page_content")).alias("hint"))


@REGISTRY.query("strip_footer", r"SELECT result_id, regexp_replace(regexp_replace(response || ' [1] [2]' || chr(10) || 'Sources Used:' || chr(10) || '[1] ' || doc_source_file, '(?s)(?:\s*\[\d+\])*\s*Sources Used:.*$', ''), '\s+$', '') AS answer FROM ragas_eval_results WHERE response IS NOT NULL")
def strip_footer(spark: SparkSession, directory: str) -> DataFrame:
    r = table(spark, directory, "ragas_eval_results").filter("response IS NOT NULL")
    return r.select("result_id", tx.without_footer(F.concat("response", F.lit(" [1] [2]\nSources Used:\n[1] "), "doc_source_file")).alias("answer"))


@REGISTRY.query("norm_name", "SELECT DISTINCT source_file, regexp_replace(regexp_replace(lower(source_file), '\\.pdf$', '', 'g'), '[^a-z0-9]', '', 'g') AS name FROM document_pages")
def norm_name(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "document_pages", "source_file").distinct().select("source_file", tx.normal_name(F.col("source_file")).alias("name"))


@REGISTRY.query("safe_name", "SELECT id, CASE WHEN n IN ('', '.', '..') THEN NULL ELSE n END AS name FROM (SELECT DISTINCT id, regexp_extract(replace('..\\up/' || trim(source_file), '\\', '/'), '([^/]*)$', 1) AS n FROM document_jobs)")
def safe_name(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "document_jobs", "id", "source_file").distinct().select("id", tx.base_name(F.concat(F.lit("..\\up/"), "source_file")).alias("name"))


@REGISTRY.query("client_ip", "SELECT id, coalesce(nullif(trim(split_part(ip_address || ', 100.64.0.1', ',', 1)), ''), 'unknown') AS ip FROM audit_logs")
def client_ip(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "audit_logs").select("id", tx.client_ip(F.concat("ip_address", F.lit(", 100.64.0.1")), F.lit(None).cast("string")).alias("ip"))


@REGISTRY.query("json_rescue", """SELECT id, verification AS found FROM chat_messages WHERE verification IS NOT NULL AND json_valid(verification)""")
def json_rescue(spark: SparkSession, directory: str) -> DataFrame:
    """Objects wrapped in fences and words, rescued."""
    m = table(spark, directory, "chat_messages", "id", "verification").filter("verification IS NOT NULL")
    raw = F.concat(F.lit("Here it is:\n```json\n"), "verification", F.lit("\n```"))
    return m.select("id", tx.rescued_json(raw).alias("found")).filter("found IS NOT NULL")


@REGISTRY.query("doc_category", "SELECT DISTINCT source_file, CASE " + " ".join(f"WHEN contains(upper(source_file), '{p}') THEN '{c}'" for p, c in tx.CATEGORY_PATTERNS) + f" ELSE '{tx.DEFAULT_CATEGORY}' END AS category FROM document_pages")
def doc_category(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "document_pages", "source_file").distinct().select("source_file", tx.category_of(F.col("source_file")).alias("category"))


@REGISTRY.query("claim_extract", r"SELECT result_id, pos, claim FROM (SELECT result_id, unnest(regexp_extract_all(response, '[^.!?\n]+[.!?]?')) AS claim, generate_subscripts(regexp_extract_all(response, '[^.!?\n]+[.!?]?'), 1) - 1 AS pos FROM ragas_eval_results)")
def claim_extract(spark: SparkSession, directory: str) -> DataFrame:
    """Sentences as claims, the stand-in for a model's extraction."""
    r = table(spark, directory, "ragas_eval_results", "result_id", "response")
    return r.select("result_id", F.posexplode(F.regexp_extract_all("response", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))).alias("pos", "claim")).withColumn("pos", F.col("pos").cast("bigint"))


_LATEST = "SELECT * FROM document_pages QUALIFY row_number() OVER (PARTITION BY source_file, page ORDER BY loaded_at DESC, page_id DESC) = 1"


def latest_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Of pages loaded again the last; max_by combines on the map side."""
    p = table(spark, directory, "document_pages", "page_id", "user_id", "source_file", "page", "section", "page_content", "loaded_at")
    newest = F.max_by(F.struct("page_id", "user_id", "section", "page_content"), F.struct("loaded_at", "page_id"))
    return p.groupBy("source_file", "page").agg(newest.alias("p")).select("source_file", "page", "p.*")


@REGISTRY.query("doc_text_marked", f"SELECT source_file, sha256(string_agg('--- Page ' || page || ' ---' || chr(10) || page_content, chr(10) ORDER BY page)) AS text_sha, count(*) AS n_pages FROM ({_LATEST}) GROUP BY 1")
def doc_text_marked(spark: SparkSession, directory: str) -> DataFrame:
    p = latest_pages(spark, directory).withColumn("part", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), "page_content"))
    parts = F.array_sort(F.collect_list(F.struct("page", "part")))
    g = p.groupBy("source_file").agg(parts.alias("parts"))
    return g.select("source_file", F.sha2(F.array_join(F.col("parts.part"), "\n"), 256).alias("text_sha"), F.size("parts").cast("bigint").alias("n_pages"))


@REGISTRY.query("token_budget", f"SELECT source_file, CAST(sum(length(page_content)) // 4 AS BIGINT) AS tokens, sum(length(page_content)) // 4 > 4000 AS summarise FROM ({_LATEST}) GROUP BY 1")
def token_budget(spark: SparkSession, directory: str) -> DataFrame:
    tokens = F.floor(F.sum(F.length("page_content").cast("bigint")) / 4).cast("bigint")
    return latest_pages(spark, directory).groupBy("source_file").agg(tokens.alias("tokens")).withColumn("summarise", F.col("tokens") > 4000)


@REGISTRY.query("page_cap", f"SELECT source_file, page, page_id FROM ({_LATEST}) WHERE trim(page_content) <> '' QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY page) <= 10")
def page_cap(spark: SparkSession, directory: str) -> DataFrame:
    w = Window.partitionBy("source_file").orderBy("page")
    p = latest_pages(spark, directory).filter(F.trim("page_content") != "")
    return p.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").select("source_file", "page", "page_id")


_CHUNKS = "SELECT page_id, source_file, i AS chunk_no, substr(page_content, CAST(i * 300 + 1 AS INT), 350) AS chunk FROM (SELECT *, unnest(generate_series(0, greatest(0, (length(page_content) - 51) // 300))) AS i FROM document_pages WHERE length(page_content) > 0)"


@REGISTRY.query("window_chunks", f"SELECT page_id, CAST(chunk_no AS BIGINT) AS chunk_no, sha256(chunk) AS chunk_sha, CAST(length(chunk) AS INT) AS size FROM ({_CHUNKS})")
def windows(spark: SparkSession, directory: str) -> DataFrame:
    c = window_chunks(table(spark, directory, "document_pages", "page_id", "page_content"), "page_content")
    return c.select("page_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.sha2("chunk", 256).alias("chunk_sha"), F.length("chunk").alias("size"))


@REGISTRY.query("chunk_counts", f"SELECT source_file, count(*) AS chunks FROM ({_CHUNKS}) GROUP BY 1")
def chunk_counts(spark: SparkSession, directory: str) -> DataFrame:
    c = window_chunks(table(spark, directory, "document_pages", "source_file", "page_content"), "page_content")
    return c.groupBy("source_file").agg(F.count(F.lit(1)).alias("chunks"))


@REGISTRY.query("tenant_inventory", "SELECT user_id, source_file, min(page_id) AS first_page_id FROM document_pages WHERE user_id <> '' AND source_file <> '' GROUP BY 1, 2")
def tenant_inventory(spark: SparkSession, directory: str) -> DataFrame:
    p = table(spark, directory, "document_pages", "user_id", "source_file", "page_id").filter("user_id <> '' AND source_file <> ''")
    return p.groupBy("user_id", "source_file").agg(F.min("page_id").alias("first_page_id"))


@REGISTRY.query("delete_count", "SELECT user_id, source_file, count(*) AS n FROM document_pages GROUP BY 1, 2")
def delete_count(spark: SparkSession, directory: str) -> DataFrame:
    """How many rows a delete by (user, file) would take out."""
    return table(spark, directory, "document_pages", "user_id", "source_file").groupBy("user_id", "source_file").agg(F.count(F.lit(1)).alias("n"))
