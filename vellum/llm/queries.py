"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import conversations as conv
from vellum.llm import lines, mixing, pairs, residue, tokenize, truncation
from vellum.registry import Registry
from vellum.session import cut
from vellum.sources.tables import table

REGISTRY = Registry()

_SAID = "', '".join(conv.STAND_INS)
_P2 = r"""
WITH m AS (
  SELECT lower(regexp_replace(session_id, '[\s\p{Z}{}\-]', '', 'g')) AS k, id, created_at,
    CASE WHEN regexp_replace(lower(role), '[^\p{L}]', '', 'g') IN ('user', 'human') THEN 'user'
         WHEN regexp_replace(lower(role), '[^\p{L}]', '', 'g') IN ('assistant', 'ai', 'bot') THEN 'assistant'
         WHEN regexp_replace(lower(role), '[^\p{L}]', '', 'g') = 'system' THEN 'system' ELSE '?' END AS who,
    regexp_replace(lower(regexp_replace(coalesce(content, ''), '[\s\p{Z}\p{Cc}\p{Cf}]', '', 'g')), '^[<(\[{"''#]+|[>)\]}"'']+$', '', 'g') IN ('$SAID') AS nothing, content
  FROM chat_messages WHERE regexp_replace(session_id, '[\s\p{Z}\x{200B}\x{FEFF}]', '', 'g') <> ''),
once AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, created_at) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY created_at, CASE WHEN who = 'user' THEN 0 ELSE 1 END, id) - 1 AS place FROM once WHERE who <> 'system'),
sessions AS (
  SELECT o.k, count(p.id) AS n, bool_or(p.nothing OR p.who <> CASE WHEN p.place % 2 = 0 THEN 'user' ELSE 'assistant' END) AS wrong
  FROM (SELECT DISTINCT k FROM once) o LEFT JOIN placed p ON p.k = o.k GROUP BY o.k),
named AS (SELECT *, substr(k, 1, 8) || '-' || substr(k, 9, 4) || '-' || substr(k, 13, 4) || '-' || substr(k, 17, 4) || '-' || substr(k, 21, 12) AS session_id, coalesce(wrong, false) OR n = 0 OR n % 2 = 1 AS broken FROM sessions)
""".replace("$SAID", _SAID)


@REGISTRY.query("p2_found", _P2 + "SELECT session_id FROM named WHERE broken")
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return conv.broken_sessions(table(spark, directory, "chat_messages"))


@REGISTRY.query("p2_conversations", _P2 + "SELECT n.session_id, CAST(p.place AS BIGINT) AS place, p.who AS speaker, p.id, p.content FROM named n JOIN placed p ON p.k = n.k WHERE NOT n.broken")
def p2_conversations(spark: SparkSession, directory: str) -> DataFrame:
    return conv.ordered_conversations(table(spark, directory, "chat_messages"))


@REGISTRY.query(
    "p2_paths",
    _P2 + """, unfit AS (SELECT *, nothing OR who = '?' AS bad, min(CASE WHEN nothing OR who = '?' THEN place END) OVER (PARTITION BY k) AS first_bad FROM placed),
    stated AS (SELECT k, CASE WHEN bad THEN 'unusable' WHEN place > first_bad THEN 'orphan' ELSE 'ok' END AS state, place,
      CASE WHEN NOT bad THEN place - coalesce(max(CASE WHEN bad THEN place END) OVER (PARTITION BY k ORDER BY place), 0) END AS deep FROM unfit)
    SELECT state, CAST(sum(n) AS BIGINT) AS messages, count(*) AS sessions, CAST(max(deepest) AS BIGINT) AS deepest FROM (SELECT state, k, count(*) AS n, max(deep) AS deepest FROM stated GROUP BY 1, 2) GROUP BY 1""",
)
def p2_paths(spark: SparkSession, directory: str) -> DataFrame:
    """How the paths of messages end."""
    return conv.path_report(table(spark, directory, "chat_messages"))


_P4 = r"""
WITH raw AS (SELECT page_id, source_file, page, unnest(string_split(page_content, chr(10))) AS line, generate_subscripts(string_split(page_content, chr(10)), 1) AS line_no FROM document_pages),
l AS (SELECT page_id, source_file, page, CAST(line_no AS BIGINT) AS line_no, regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{M}\p{N}]', '', 'g'), '\p{N}+', '0', 'g') AS form FROM raw),
sizes AS (SELECT source_file, count(DISTINCT page) AS size FROM document_pages GROUP BY 1),
often AS (SELECT source_file, form, count(DISTINCT page) AS n_pages FROM l WHERE form <> '' GROUP BY 1, 2 HAVING count(DISTINCT page) >= 5),
found AS (SELECT l.page_id, l.line_no, o.source_file, o.n_pages FROM l JOIN often o ON o.source_file = l.source_file AND o.form = l.form JOIN sizes s ON s.source_file = l.source_file WHERE o.n_pages * 5 >= s.size)
"""


@REGISTRY.query("p4_found", _P4 + "SELECT page_id, line_no FROM found")
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return lines.repeated_lines(table(spark, directory, "document_pages")).select("page_id", "line_no")


@REGISTRY.query(
    "p4_clean",
    _P4 + """SELECT p.page_id, sha256(string_agg(r.line, chr(10) ORDER BY r.line_no)) AS clean_sha, count(*) AS n_lines FROM document_pages p
    JOIN raw r ON r.page_id = p.page_id LEFT JOIN found f ON f.page_id = r.page_id AND f.line_no = r.line_no WHERE f.page_id IS NULL GROUP BY 1""",
)
def p4_clean(spark: SparkSession, directory: str) -> DataFrame:
    clean = lines.without_repeated_lines(table(spark, directory, "document_pages", "page_id", "source_file", "page", "page_content"))
    left = F.size(F.split("page_content", "\n")) - F.col("n_removed")
    return clean.filter(left > 0).select("page_id", F.sha2("clean", 256).alias("clean_sha"), left.cast("bigint").alias("n_lines"))


@REGISTRY.query("p6_ids")
def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokenize.encode(table(spark, directory, "documents", "doc_id", "text")).select("doc_id", "ids")


@REGISTRY.query("p6_round_trip", "SELECT doc_id, coalesce(text, '') AS text, true AS same FROM documents")
def p6_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Each text decoded from its own ids."""
    docs = table(spark, directory, "documents", "doc_id", "text")
    back = tokenize.decode(tokenize.encode(docs), out="back")
    return back.select("doc_id", F.col("back").alias("text"), (F.col("back") == F.coalesce("text", F.lit(""))).alias("same"))


def _sized(spark: SparkSession, directory: str) -> DataFrame:
    ids = tokenize.encode(table(spark, directory, "documents", "doc_id", "source", "text"))
    return cut(ids.select("doc_id", "source", F.size("ids").alias("n_tokens")))


@REGISTRY.query("p7_mix")
def p7_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mix(_sized(spark, directory), table(spark, directory, "mix_targets"))[0]


@REGISTRY.query("p7_shares")
def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mix(_sized(spark, directory), table(spark, directory, "mix_targets"))[1]


@REGISTRY.query("p7_epoch_shares")
def p7_epoch_shares(spark: SparkSession, directory: str) -> DataFrame:
    """A mix of 0.7 of the size of its sources: the exponent is bisected to the limits on repetition."""
    return mixing.mix(_sized(spark, directory), table(spark, directory, "mix_targets"), epochs=0.7)[1]


@REGISTRY.query("p7_entropy_shares")
def p7_entropy_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Natural shares flattened to an entropy of 2.65 nats (sixteen equal sources have 2.77): the exponent is bisected to it."""
    return mixing.mix(_sized(spark, directory), table(spark, directory, "mix_targets"), target_entropy=2.65)[1]


@REGISTRY.query(
    "p7_quotas_by_length",
    """
    WITH s AS (SELECT source, sum(n_chars) AS tokens FROM documents WHERE n_chars > 0 AND source IS NOT NULL GROUP BY 1),
    u AS (SELECT t.source, t.target_share / sum(t.target_share) OVER () AS p, s.tokens, t.max_repeats FROM mix_targets t JOIN s ON s.source = t.source WHERE t.target_share > 0 AND t.max_repeats > 0),
    b AS (SELECT least(min(tokens * max_repeats / p), sum(tokens * max_repeats)) AS budget FROM u),
    d AS (SELECT t.source, t.target_share, coalesce(u.p, 0) AS weight, CAST(coalesce(round_even(u.p * b.budget, 0), 0) AS BIGINT) AS due, u.tokens, t.max_repeats FROM mix_targets t LEFT JOIN u ON u.source = t.source CROSS JOIN b),
    n AS (SELECT *, CAST(CASE WHEN due > 0 THEN least(due // tokens, max_repeats) ELSE 0 END AS BIGINT) AS passes FROM d)
    SELECT source, target_share, weight, CAST(1 AS DOUBLE) AS exponent, due, passes, CAST(CASE WHEN due > 0 AND passes < max_repeats THEN due - passes * tokens ELSE 0 END AS BIGINT) AS part FROM n""",
)
def p7_quotas_by_length(spark: SparkSession, directory: str) -> DataFrame:
    """What each source is to give if documents are sized by code points."""
    docs = table(spark, directory, "documents", "source", "n_chars").filter("n_chars > 0 AND source IS NOT NULL")
    return mixing.quotas(docs.groupBy("source").agg(F.sum("n_chars").alias("tokens")), table(spark, directory, "mix_targets"))


def _audit(spark: SparkSession, directory: str) -> DataFrame:
    return truncation.truncated_rows(table(spark, directory, "audit_logs", "id", "action", "detail"), "detail", "action", "id")


@REGISTRY.query("p1_found")
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return _audit(spark, directory).filter("truncated AND id IS NOT NULL").select("id").distinct()


@REGISTRY.query("p1_by_action")
def p1_by_action(spark: SparkSession, directory: str) -> DataFrame:
    return truncation.truncation_by_group(_audit(spark, directory), "id", "action")


def _pairs(spark: SparkSession, directory: str) -> DataFrame:
    golden = table(spark, directory, "golden_dataset").select(
        F.lit("golden_dataset").alias("table_name"), F.col("source_row").alias("row_id"), F.col("question").alias("prompt"), F.col("ground_truth").alias("response"), "intent"
    )
    results = table(spark, directory, "ragas_eval_results").select(
        F.lit("ragas_eval_results").alias("table_name"), F.col("result_id").alias("row_id"), F.col("user_input").alias("prompt"), "response", F.col("golden_intent").alias("intent")
    )
    both = golden.unionByName(results)
    return pairs.defects(both, "prompt", "response", pairs.labelled_intent(F.col("intent")) == "guardrail", "table_name")


@REGISTRY.query("p5_found")
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return _pairs(spark, directory).filter("defect IS NOT NULL").select("table_name", "row_id", "defect")


@REGISTRY.query("p5_by_intent")
def p5_by_intent(spark: SparkSession, directory: str) -> DataFrame:
    rows = _pairs(spark, directory).select("table_name", pairs.labelled_intent(F.col("intent")).alias("intent"), F.coalesce("defect", F.lit("none")).alias("defect"))
    return rows.groupBy("table_name", "intent", "defect").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("p8_found")
def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return residue.residue(table(spark, directory, "documents", "doc_id", "text")).filter("residue").select("doc_id")


@REGISTRY.query("p8_kept")
def p8_kept(spark: SparkSession, directory: str) -> DataFrame:
    """Per source: documents kept and left out."""
    rows = residue.residue(table(spark, directory, "documents", "doc_id", "source", "text"))
    return rows.groupBy("source").agg(F.count_if(~F.col("residue")).alias("kept"), F.count_if("residue").alias("left_out"))
