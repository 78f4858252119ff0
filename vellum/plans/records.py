"""Queries over stored records: shapes shown to users, audit payloads, evaluation rows, turns, frames and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.chunks import recursive_chunks
from vellum.operators.names import match_names
from vellum.operators.scoring import Scorer
from vellum.plans import REGISTRY
from vellum.sources.files import payload_origin, persist_turns
from vellum.sources.tables import table
from vellum.streaming.stateful import fold_frames

#: What agreements are called; fixed values.
AGREEMENTS = ["Supply Agreement", "License Agreement", "Lease", "Loan Agreement", "Services Agreement", "Distribution Agreement", "Franchise Agreement", "Joint Venture Agreement"]
REFUSAL_TEXT = "I cannot answer this based on the provided documents."


def _first_of(column: str, tags: list[str], marks: str = "") -> str:
    form = (lambda t: f"contains({column}, '{marks[0]}{t}{marks[1]}')") if marks else (lambda t: f"contains(lower({column}), '{t.lower()}')")
    return "CASE " + " ".join(f"WHEN {form(t)} THEN '{t}'" for t in tags) + " END"


@REGISTRY.query("refusal_first", "SELECT result_id, " + " OR ".join(f"contains(lower(response), '{p}')" for p in tx.REFUSAL_MARKERS["first"]) + " AS refused FROM ragas_eval_results WHERE response IS NOT NULL")
def refusal_first(spark: SparkSession, directory: str) -> DataFrame:
    """By the markers of the first harness."""
    r = table(spark, directory, "ragas_eval_results", "result_id", "response").filter("response IS NOT NULL")
    return r.select("result_id", tx.contains_any(F.col("response"), tx.REFUSAL_MARKERS["first"]).alias("refused"))


@REGISTRY.query("category_tags", f"SELECT source_row, {_first_of('question', AGREEMENTS, '“”')} AS quoted, {_first_of('question', AGREEMENTS)} AS within FROM golden_dataset")
def category_tags(spark: SparkSession, directory: str) -> DataFrame:
    """The agreement that a question quotes, and the one it names in any case."""
    q = F.col("question")
    return table(spark, directory, "golden_dataset", "source_row", "question").select("source_row", tx.quoted_tag(q, AGREEMENTS, "“”").alias("quoted"), tx.tag_within(q, AGREEMENTS).alias("within"))


@REGISTRY.query("audit_details", "SELECT source_row, substr(question, 1, 200) AS ask, coalesce(len(reference_contexts), 0) || ' docs · ' || substr(question, 1, 120) AS compare FROM golden_dataset")
def audit_details(spark: SparkSession, directory: str) -> DataFrame:
    q, n = F.col("question"), F.coalesce(F.size("reference_contexts"), F.lit(0))
    n = F.when(F.col("reference_contexts").isNull(), 0).otherwise(n)
    return table(spark, directory, "golden_dataset", "source_row", "question", "reference_contexts").select("source_row", tx.audit_detail(q).alias("ask"), tx.audit_detail(q, n).alias("compare"))


@REGISTRY.query("stamped_documents", "SELECT doc_id, coalesce(nullif(source, ''), 'shared') AS tenant, coalesce(nullif(source_file, ''), nullif(title, ''), 'unknown_source') AS stamped_file FROM documents")
def stamped_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Tenant and file put on every row before it is stored."""
    d = table(spark, directory, "documents", "doc_id", "source", "source_file", "title")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return d.select("doc_id", F.coalesce(blank("source"), F.lit("shared")).alias("tenant"), F.coalesce(blank("source_file"), blank("title"), F.lit("unknown_source")).alias("stamped_file"))


_PAYLOAD = """CASE page_id % 4 WHEN 0 THEN '{"metadata": {"source": "' || source_file || '", "page": ' || page || '}}' WHEN 1 THEN '{"source": "' || source_file || '", "page": "' || page || '", "metadata": "none"}'
  WHEN 2 THEN '{"metadata": {"file_name": "' || source_file || '", "source": ""}}' ELSE '{"text": "x"}' END"""


@REGISTRY.query("payload_origins", "SELECT page_id, CASE WHEN page_id % 4 < 3 THEN source_file ELSE 'unknown_source' END AS source, CASE WHEN page_id % 4 < 2 THEN CAST(page AS VARCHAR) ELSE 'unknown_page' END AS page FROM document_pages")
def payload_origins(spark: SparkSession, directory: str) -> DataFrame:
    """Source and page out of payloads of four shapes, made from the pages."""
    p = table(spark, directory, "document_pages", "page_id", "source_file", "page").select("page_id", F.expr(_PAYLOAD).alias("payload"))
    return p.select("page_id", payload_origin(F.col("payload")).alias("o")).select("page_id", "o.*")


@REGISTRY.query("public_users", "SELECT id, lower(email) AS email, role, coalesce(is_active, false) AS is_active, created_at FROM users ORDER BY created_at DESC, id")
def public_users(spark: SparkSession, directory: str) -> DataFrame:
    """Accounts as they may be shown, the newest first."""
    u = table(spark, directory, "users", "id", "email", "role", "is_active", "created_at")
    return u.select("id", F.lower("email").alias("email"), "role", F.coalesce("is_active", F.lit(False)).alias("is_active"), "created_at").orderBy(F.desc("created_at"), "id")


_VIEW = "SELECT id, any_value(role) AS role, max(citations) AS citations, max(verification) AS verification, max(extra) AS extra FROM chat_messages WHERE id IS NOT NULL GROUP BY 1"


@REGISTRY.query(
    "message_view",
    f"""SELECT id, coalesce(json_array_length(citations), 0)::INT AS n_citations, json_extract_string(citations, '$[0].file') AS first_file, coalesce('p. ' || json_extract_string(citations, '$[0].page'), '') AS first_range, verification->>'verdict' AS verdict,
    round(CAST(verification->>'score' AS DOUBLE), 6) AS score, CAST(coalesce(verification->>'total_claims', '0') AS INT) AS total_claims, coalesce(CAST(extra->>'isComparison' AS BOOLEAN), false) AS is_comparison, coalesce(json_array_length(extra->'comparedDocs'), 0)::INT AS n_compared,
    coalesce(json_array_length(extra->'weakEvidence'), 0)::INT AS n_weak FROM ({_VIEW})""",
)
def message_view(spark: SparkSession, directory: str) -> DataFrame:
    """Stored messages as they are shown: citations, report, compared files and those without evidence."""
    m = table(spark, directory, "chat_messages", "id", "citations", "verification", "extra").filter("id IS NOT NULL").groupBy("id").agg(*[F.max(c).alias(c) for c in ("citations", "verification", "extra")])
    c = F.from_json("citations", "array<struct<file string, page int>>")
    v = F.from_json("verification", "struct<verdict string, score double, total_claims int>")
    x = F.from_json("extra", "struct<isComparison boolean, comparedDocs array<string>, weakEvidence array<string>>")
    m = m.select("id", c.alias("c"), v.alias("v"), x.alias("x"))
    size = lambda a: F.coalesce(F.when(F.col(a).isNotNull(), F.size(a)), F.lit(0))
    page = F.get("c", F.lit(0))["page"]
    return m.select(
        "id", size("c").alias("n_citations"), F.get("c", F.lit(0))["file"].alias("first_file"), F.coalesce(F.concat(F.lit("p. "), page.cast("string")), F.lit("")).alias("first_range"), F.col("v.verdict").alias("verdict"), F.round("v.score", 6).alias("score"),
        F.coalesce("v.total_claims", F.lit(0)).alias("total_claims"), F.coalesce("x.isComparison", F.lit(False)).alias("is_comparison"), size("x.comparedDocs").alias("n_compared"), size("x.weakEvidence").alias("n_weak"),
    )


_GENERATOR = "CASE synthesizer WHEN 'multi_hop' THEN CASE WHEN source_row % 2 = 0 THEN 'multi_hop_abstract_query_synthesizer' ELSE 'Multi_Hop_Specific_Query_Synthesizer' END WHEN 'single_hop' THEN 'single_hop_specific_query_synthesizer' ELSE synthesizer END"


@REGISTRY.query("intent_of_generator", "SELECT source_row, CASE WHEN synthesizer = 'multi_hop' THEN 'ANALYTICAL' ELSE 'FACT' END AS intent FROM golden_dataset")
def intent_of_generator(spark: SparkSession, directory: str) -> DataFrame:
    """The intent by the name of the generator, in any case; any other name asks for facts."""
    g = table(spark, directory, "golden_dataset", "source_row", "synthesizer").withColumn("generator", F.coalesce(F.expr(_GENERATOR), F.lit("")))
    return g.select("source_row", tx.intent_of(F.col("generator")).alias("intent"))


@REGISTRY.query("retry_delays", r"SELECT result_id, CASE WHEN result_id % 3 = 0 THEN (result_id % 50) + 0.5 WHEN result_id % 3 = 1 THEN CAST(result_id % 7 AS DOUBLE) ELSE 2.0 END AS seconds FROM ragas_eval_results")
def retry_delays(spark: SparkSession, directory: str) -> DataFrame:
    """How long messages of a limited service ask to wait."""
    r = table(spark, directory, "ragas_eval_results", "result_id", "pipeline_error")
    said = F.expr("CASE result_id % 3 WHEN 0 THEN 'Limit reached, try again in ' || (result_id % 50) || '.5s.' WHEN 1 THEN 'try again in ' || (result_id % 7) || 's' ELSE coalesce(pipeline_error, '') END")
    return r.select("result_id", tx.retry_after(said).alias("seconds"))


@REGISTRY.query("human_sizes", "SELECT doc_id, CASE WHEN s < 1024 THEN s || 'B' WHEN s < 1048576 THEN CAST(floor(s / 1024.0 + 0.5) AS BIGINT) || 'KB' ELSE printf('%.1fMB', floor(s / 104857.6 + 0.5) / 10) END AS size FROM (SELECT doc_id, n_chars * (1 + doc_id % 977) + 7 AS s FROM documents)")
def human_sizes(spark: SparkSession, directory: str) -> DataFrame:
    d = table(spark, directory, "documents", "doc_id", "n_chars").withColumn("s", F.col("n_chars") * (1 + F.col("doc_id") % 977) + 7)
    return d.select("doc_id", tx.human_size(F.col("s")).alias("size"))


_SPOKEN = r"SELECT * FROM (SELECT result_id, regexp_replace(c, '^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$', '', 'g') AS claim, pos FROM (SELECT result_id, unnest(regexp_extract_all(response, '[^.!?\n]+[.!?]?')) AS c, generate_subscripts(regexp_extract_all(response, '[^.!?\n]+[.!?]?'), 1) AS pos FROM ragas_eval_results WHERE response IS NOT NULL)) WHERE claim <> ''"
_FIRST = f"SELECT result_id, claim, pos FROM ({_SPOKEN}) QUALIFY row_number() OVER (PARTITION BY result_id, lower(claim) ORDER BY pos) = 1"


def _spoken(spark: SparkSession, directory: str, *more: str) -> DataFrame:
    r = table(spark, directory, "ragas_eval_results", "result_id", "response", *more).filter("response IS NOT NULL")
    return r.withColumn("claims", tx.first_spelling(F.regexp_extract_all("response", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))))


@REGISTRY.query("claims_as_spelled", f"SELECT result_id, claim, CAST(row_number() OVER (PARTITION BY result_id ORDER BY pos) - 1 AS INT) AS place FROM ({_FIRST})")
def claims_as_spelled(spark: SparkSession, directory: str) -> DataFrame:
    """Claims once each, in their first spelling."""
    return _spoken(spark, directory).select("result_id", F.posexplode("claims").alias("place", "claim"))


_AUDIT = f"""WITH ctx AS (SELECT result_id, response, evaluation_error, faithfulness, trim(regexp_replace(lower(substr(coalesce(array_to_string(retrieved_contexts, ' '), ''), 1, 6000)), '\\s+', ' ', 'g')) AS c FROM ragas_eval_results WHERE response IS NOT NULL),
f AS ({_FIRST}), v AS (SELECT f.*, contains(c, trim(regexp_replace(lower(claim), '\\s+', ' ', 'g'))) AS ok FROM f JOIN ctx USING (result_id)),
a AS (SELECT ctx.result_id, evaluation_error IS NOT NULL AND evaluation_error <> '' AS broken, faithfulness, count(v.claim) AS total, count(v.claim) FILTER (ok) AS good, coalesce(list(v.claim ORDER BY pos) FILTER (NOT ok), []) AS bad FROM ctx LEFT JOIN v USING (result_id) GROUP BY 1, 2, 3)
SELECT result_id, CASE WHEN broken THEN CASE WHEN coalesce(faithfulness >= 1, false) THEN 'PASS' ELSE 'FAIL' END WHEN good = total THEN 'PASS' WHEN good = 0 THEN 'FAIL' ELSE 'PARTIAL' END AS verdict,
  round(CASE WHEN broken THEN CASE WHEN coalesce(faithfulness >= 1, false) THEN 1 ELSE 0 END WHEN total = 0 THEN 1 ELSE good * 1.0 / total END, 6) AS score, CAST(CASE WHEN broken THEN 0 ELSE total END AS INT) AS total_claims, CASE WHEN broken THEN [] ELSE bad END AS unverified_claims FROM a"""


@REGISTRY.query("audit_payload", f"SELECT *, verdict = 'PASS' AS is_faithful FROM ({_AUDIT})")
def audit_payload(spark: SparkSession, directory: str) -> DataFrame:
    """The report of each answer. Claims are held against the first 6,000 characters of the contexts and count by a quote out of these;
    where that audit failed (an error is on record) a yes or no stands in for it, and where that fails too the answer counts as wrong."""
    scorer = Scorer()
    r = _spoken(spark, directory, "retrieved_contexts", "evaluation_error", "faithfulness").withColumn("context", F.substring(F.coalesce(F.array_join("retrieved_contexts", " "), F.lit("")), 1, 6000))
    judged = r.withColumn("judged", F.transform("claims", lambda c: F.struct(c.alias("claim"), scorer.verify(c, F.col("context")).alias("quote"))))
    broken = F.coalesce(F.col("evaluation_error") != "", F.lit(False))
    binary = F.coalesce(F.col("faithfulness") >= 1, F.lit(False))
    total, bad = F.size("judged"), F.filter("judged", lambda x: x["quote"] == "")
    j = judged.select("result_id", broken.alias("broken"), binary.alias("binary"), total.alias("total"), F.transform(bad, lambda x: x["claim"]).alias("bad"))
    good = F.col("total") - F.size("bad")
    verdict = F.when(F.col("broken"), F.when(F.col("binary"), "PASS").otherwise("FAIL")).when(good == F.col("total"), "PASS").when(good == 0, "FAIL").otherwise("PARTIAL")
    score = F.when(F.col("broken"), F.col("binary").cast("double")).when(F.col("total") == 0, 1.0).otherwise(good / F.col("total"))
    out = j.select("result_id", verdict.alias("verdict"), F.round(score, 6).alias("score"), F.when(F.col("broken"), 0).otherwise(F.col("total")).alias("total_claims"), F.when(F.col("broken"), F.array().cast("array<string>")).otherwise(F.col("bad")).alias("unverified_claims"))
    return out.withColumn("is_faithful", F.col("verdict") == "PASS")


@REGISTRY.query(
    "failure_rows",
    "SELECT result_id, CASE WHEN p THEN NULL ELSE faithfulness END AS faithfulness, CASE WHEN p OR e THEN NULL ELSE answer_relevancy END AS answer_relevancy, CASE WHEN p OR e THEN NULL ELSE context_precision END AS context_precision, concat_ws(' | ', CASE WHEN p THEN 'pipeline: ' || pipeline_error END, CASE WHEN e THEN 'answer_context: ' || evaluation_error END) AS error "
    "FROM (SELECT *, coalesce(pipeline_error, '') <> '' AS p, coalesce(evaluation_error, '') <> '' AS e FROM ragas_eval_results)",
)
def failure_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Results whose steps failed lose the metrics of these steps only; what went wrong is joined into one text."""
    r = table(spark, directory, "ragas_eval_results", "result_id", "faithfulness", "answer_relevancy", "context_precision", "pipeline_error", "evaluation_error")
    p, e = (F.coalesce(F.col(c), F.lit("")) != "" for c in ("pipeline_error", "evaluation_error"))
    text = F.concat_ws(" | ", F.when(p, F.concat(F.lit("pipeline: "), "pipeline_error")), F.when(e, F.concat(F.lit("answer_context: "), "evaluation_error")))
    return r.select("result_id", F.when(~p, F.col("faithfulness")).alias("faithfulness"), *[F.when(~p & ~e, F.col(c)).alias(c) for c in ("answer_relevancy", "context_precision")], text.alias("error"))


_METRICS = ("faithfulness", "answer_relevancy", "context_precision")


@REGISTRY.query("missing_positions", " UNION ALL ".join(f"SELECT '{m}' AS metric, result_id, source_row FROM ragas_eval_results WHERE {m} IS NULL" for m in _METRICS))
def missing_positions(spark: SparkSession, directory: str) -> DataFrame:
    """Where each metric is missing: a row a place, as there may be any number."""
    r = table(spark, directory, "ragas_eval_results", "result_id", "source_row", *_METRICS)
    metrics = F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in _METRICS])
    return r.select(F.explode(F.array_compact(metrics)).alias("metric"), "result_id", "source_row")


@REGISTRY.query("three_to_check", "SELECT result_id, faithfulness FROM ragas_eval_results WHERE faithfulness = 1.0 ORDER BY sha256('7:' || result_id), result_id LIMIT 3")
def three_to_check(spark: SparkSession, directory: str) -> DataFrame:
    """Three perfect results in the order of a seeded hash."""
    r = table(spark, directory, "ragas_eval_results", "result_id", "faithfulness").filter("faithfulness = 1.0")
    return r.orderBy(F.sha2(F.concat(F.lit("7:"), F.col("result_id").cast("string")), 256), "result_id").limit(3)


@REGISTRY.query("sorted_titles", "SELECT DISTINCT title FROM documents WHERE trim(title) <> '' ORDER BY 1")
def sorted_titles(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents", "title").filter(F.trim("title") != "").distinct().orderBy("title")


_LABEL = r"regexp_replace(lower(intent), '[^a-z]', '', 'g')"


@REGISTRY.query(
    "golden_tiers",
    f"""WITH g AS (SELECT *, {_LABEL} AS label FROM golden_dataset WHERE question IS NOT NULL)
    SELECT source_row, question, ground_truth, coalesce(len(reference_contexts), 0)::INT AS n_contexts, 'FACTUAL' AS intent, 'corpus' AS synthesizer, 'in_scope' AS doc_category FROM g WHERE label IN ('fact', 'factual')
    UNION ALL SELECT source_row, question, ground_truth, coalesce(len(reference_contexts), 0)::INT, 'ANALYTICAL', 'by_hand', coalesce(doc_category, 'in_scope') FROM g WHERE label = 'analytical'
    UNION ALL SELECT source_row, question, ground_truth, coalesce(len(reference_contexts), 0)::INT, 'COMPARATIVE', 'by_hand', coalesce(doc_category, 'cross_doc') FROM g WHERE label = 'comparative'
    UNION ALL SELECT source_row, question, '{REFUSAL_TEXT}', 0, 'GUARDRAIL', 'by_hand', 'out_of_scope' FROM g WHERE label = 'guardrail'""",
)
def golden_tiers(spark: SparkSession, directory: str) -> DataFrame:
    """One set out of four tiers: facts of the corpus, analyses and comparisons by hand, and what is to be refused. One pass, as the tiers are told
    by a label."""
    g = table(spark, directory, "golden_dataset", "source_row", "question", "ground_truth", "reference_contexts", "intent", "doc_category").filter("question IS NOT NULL")
    label = F.regexp_replace(F.lower("intent"), "[^a-z]", "")
    tier = F.when(label.isin("fact", "factual"), "FACTUAL").when(label == "analytical", "ANALYTICAL").when(label == "comparative", "COMPARATIVE").when(label == "guardrail", "GUARDRAIL")
    refused, n = F.col("tier") == "GUARDRAIL", F.coalesce(F.when(F.col("reference_contexts").isNotNull(), F.size("reference_contexts")), F.lit(0))
    category = F.when(F.col("tier") == "FACTUAL", "in_scope").when(refused, "out_of_scope").otherwise(F.coalesce("doc_category", F.when(F.col("tier") == "ANALYTICAL", "in_scope").otherwise("cross_doc")))
    g = g.withColumn("tier", tier).filter("tier IS NOT NULL")
    return g.select("source_row", "question", F.when(refused, REFUSAL_TEXT).otherwise(F.col("ground_truth")).alias("ground_truth"), F.when(refused, 0).otherwise(n).alias("n_contexts"), F.col("tier").alias("intent"), F.when(F.col("tier") == "FACTUAL", "corpus").otherwise("by_hand").alias("synthesizer"), category.alias("doc_category"))


_HINT = rf"nullif(substr(regexp_replace(regexp_extract(regexp_replace(substr(@@, 1, 500), '\r\n?', chr(10), 'g'), '{tx.SECTION_PATTERN}', 0), '^\s+|\s+$', '', 'g'), 1, 100), '')"
_PIECES = "(SELECT page_id, section, i AS chunk_no, substr(page_content, CAST(i * 300 + 1 AS INT), 350) AS chunk FROM (SELECT *, unnest(generate_series(0, greatest(0, (length(page_content) - 51) // 300))) AS i FROM document_pages WHERE length(page_content) > 0))"


@REGISTRY.query("child_sections", f"SELECT page_id, CAST(chunk_no AS INT) AS chunk_no, coalesce({_HINT.replace('@@', 'chunk')}, nullif(section, '')) AS section FROM {_PIECES}")
def child_sections(spark: SparkSession, directory: str) -> DataFrame:
    """A chunk's own heading, else its page's."""
    from vellum.operators.chunks import window_chunks

    p = table(spark, directory, "document_pages", "page_id", "section", "page_content")
    c = window_chunks(p, "page_content")
    return c.select("page_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.coalesce(tx.section_hint(F.col("chunk")), F.nullif(F.col("section"), F.lit(""))).alias("section"))


@REGISTRY.query("split_pages")
def split_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Parents and children of every page by the recursive splitter."""
    c = recursive_chunks(table(spark, directory, "document_pages", "page_id", "page_content"), ["page_id"], "page_content")
    return c.select("page_id", "parent_no", "chunk_no", F.length("chunk").alias("size"), F.sha2("chunk", 256).alias("chunk_sha"))


_TURNS = "SELECT id AS turn_id, id AS session_id, CASE WHEN sha256(id) < '2' THEN 'another' ELSE user_id END AS user_id, coalesce(name, 'untitled') AS question, 'noted' AS answer, coalesce(updated_at, created_at) AS at FROM chat_sessions"


def _turns(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, directory, "chat_sessions", "id", "user_id", "name", "created_at", "updated_at")
    user = F.when(F.sha2("id", 256) < "2", "another").otherwise(F.col("user_id"))
    t = s.select(F.col("id").alias("turn_id"), F.col("id").alias("session_id"), user.alias("user_id"), F.coalesce("name", F.lit("untitled")).alias("question"), F.lit("noted").alias("answer"), F.coalesce("updated_at", "created_at").alias("at"))
    return persist_turns(t, s)


@REGISTRY.query("persisted_turns", f"SELECT t.turn_id, t.session_id, r.seq, r.role, CASE WHEN r.seq = 0 THEN question ELSE answer END AS content, t.at AS created_at FROM ({_TURNS}) t JOIN chat_sessions s ON s.id = t.session_id AND s.user_id = t.user_id, (VALUES (0, 'user'), (1, 'assistant')) r(seq, role)")
def persisted_turns(spark: SparkSession, directory: str) -> DataFrame:
    """The messages that a turn of every session leaves, where the session is the user's."""
    return _turns(spark, directory)[0]


@REGISTRY.query("touched_sessions", f"SELECT t.session_id, max(t.at) AS updated_at FROM ({_TURNS}) t JOIN chat_sessions s ON s.id = t.session_id AND s.user_id = t.user_id GROUP BY 1")
def touched_sessions(spark: SparkSession, directory: str) -> DataFrame:
    return _turns(spark, directory)[1]


def _frames(spark: SparkSession, directory: str) -> DataFrame:
    """Frames of every stored answer as a stream would send them: its words, then sources and report; an error for those without content."""
    m = table(spark, directory, "chat_messages", "id", "content", "citations", "verification").filter("id IS NOT NULL").groupBy("id").agg(*[F.max(c).alias(c) for c in ("content", "citations", "verification")])
    word = lambda w, i: F.struct((i * 2).alias("seq"), F.lit("token").alias("kind"), w.alias("payload"))
    end = lambda c, at, kind: F.when(F.col(c).isNotNull(), F.struct(F.lit(at).alias("seq"), F.lit(kind).alias("kind"), F.col(c).alias("payload")))
    words = F.transform(F.split(F.coalesce("content", F.lit("")), "(?<= )"), word)
    failed = F.when(F.col("content").isNull(), F.struct(F.lit(2000000003).alias("seq"), F.lit("error").alias("kind"), F.lit("Something went wrong.").alias("payload")))
    all_ = F.array_compact(F.concat(words, F.array(end("citations", 2000000001, "done"), end("verification", 2000000002, "verification"), failed)))
    return m.select("id", F.inline(all_))


@REGISTRY.query("answer_frames", "SELECT id, coalesce(max(content), 'Something went wrong.') AS content, max(citations) AS sources, max(verification) AS verification, max(content) IS NULL AS failed FROM chat_messages WHERE id IS NOT NULL GROUP BY 1")
def answer_frames(spark: SparkSession, directory: str) -> DataFrame:
    """Answers folded from their frames: tokens joined in order, sources and report from the last frames, an error instead of the text."""
    return fold_frames(_frames(spark, directory)).drop("n_frames")


@REGISTRY.query("similar_names")
def similar_names(spark: SparkSession, directory: str) -> DataFrame:
    """The document file meant by each uploaded name: containment, else similarity. Every twentieth name by hash has lost its last letters first."""
    j = table(spark, directory, "chat_sessions", "uploaded_files").select(F.explode("uploaded_files").alias("wanted")).distinct()
    j = j.select(F.when(F.pmod(F.xxhash64("wanted"), F.lit(20)) == 0, F.concat(F.substring("wanted", 3, 24), F.lit("_v2.pdf"))).otherwise(F.col("wanted")).alias("wanted"))
    return match_names(j, "wanted", table(spark, directory, "document_pages", "source_file"), "source_file")


@REGISTRY.query("perfect_scores", "SELECT result_id FROM ragas_eval_results WHERE faithfulness = 1.0 AND answer_relevancy IS NOT NULL")
def perfect_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Results with exactly the full score that were judged at all, refusals scored by hand left out by their missing relevancy."""
    r = table(spark, directory, "ragas_eval_results", "result_id", "faithfulness", "answer_relevancy")
    return r.filter("faithfulness = 1.0 AND answer_relevancy IS NOT NULL").select("result_id")


@REGISTRY.query("unasked_questions", "SELECT source_row, question FROM golden_dataset g WHERE NOT EXISTS (SELECT 1 FROM ragas_eval_results r WHERE trim(lower(r.user_input)) = trim(lower(g.question)) AND r.faithfulness IS NOT NULL)")
def unasked_questions(spark: SparkSession, directory: str) -> DataFrame:
    """Questions without a scored result under the same words; questions repeated within the set stay."""
    key = lambda c: F.trim(F.lower(c)).alias("key")
    done = table(spark, directory, "ragas_eval_results", "user_input", "faithfulness").filter("faithfulness IS NOT NULL").select(key("user_input")).distinct()
    g = table(spark, directory, "golden_dataset", "source_row", "question")
    return g.withColumn("key", key("question")).join(done, "key", "left_anti").select("source_row", "question")


@REGISTRY.query("files_to_load", "SELECT source_file, count(*) AS n_pages, bool_or(source_file IN (SELECT doc_source_file FROM ragas_eval_results WHERE doc_source_file <> '')) AS golden FROM document_pages GROUP BY 1")
def files_to_load(spark: SparkSession, directory: str) -> DataFrame:
    """Files that results refer to, and the others that stand beside them to distract, as one list."""
    cited = table(spark, directory, "ragas_eval_results", "doc_source_file").filter("doc_source_file <> ''").select(F.col("doc_source_file").alias("source_file")).distinct().withColumn("golden", F.lit(True))
    files = table(spark, directory, "document_pages", "source_file").groupBy("source_file").agg(F.count(F.lit(1)).alias("n_pages"))
    return files.join(cited, "source_file", "left").select("source_file", "n_pages", F.coalesce("golden", F.lit(False)).alias("golden"))
