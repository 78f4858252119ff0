"""Queries of problem 3: references without a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.operators.references import Reference, orphan_references, orphans_by_period
from vellum.plans import REGISTRY
from vellum.sources.tables import table

_SQL = r"""
WITH parents AS (
  SELECT 'users' AS p, lower(regexp_replace(id, '[\s\p{Z}{}\-]', '', 'g')) AS k, min(created_at) AS born FROM users GROUP BY ALL
  UNION ALL
  SELECT 'chat_sessions', lower(regexp_replace(id, '[\s\p{Z}{}\-]', '', 'g')), min(created_at) FROM chat_sessions GROUP BY ALL),
refs AS (
  SELECT 'chat_messages' AS table_name, id AS record_id, 'chat_sessions' AS p, session_id AS v, created_at FROM chat_messages
  UNION ALL SELECT 'document_jobs', id, 'users', user_id, created_at FROM document_jobs
  UNION ALL SELECT 'audit_logs', CAST(id AS VARCHAR), 'users', user_id, created_at FROM audit_logs),
keyed AS (
  SELECT table_name, record_id, p, created_at, lower(regexp_replace(v, '[\s\p{Z}{}\-]', '', 'g')) AS k FROM refs
  WHERE regexp_replace(v, '[\s\p{Z}\x{200B}\x{FEFF}]', '', 'g') <> '' AND record_id IS NOT NULL),
dead AS (SELECT DISTINCT table_name AS p, lower(regexp_replace(record_id, '[\s\p{Z}{}\-]', '', 'g')) AS k FROM tombstones),
found AS (
  SELECT table_name, record_id, min(CASE WHEN a.k IS NOT NULL THEN 'late' WHEN d.k IS NOT NULL THEN 'deleted' ELSE 'missing' END) AS kind, min(created_at) AS created_at
  FROM keyed r LEFT JOIN parents a ON a.p = r.p AND a.k = r.k LEFT JOIN dead d ON d.p = r.p AND d.k = r.k
  WHERE a.k IS NULL OR a.born > r.created_at GROUP BY 1, 2)
"""


def _orphans(spark: SparkSession, directory: str) -> DataFrame:
    references = [
        Reference("chat_messages", table(spark, directory, "chat_messages"), "session_id", "chat_sessions"),
        Reference("document_jobs", table(spark, directory, "document_jobs"), "user_id", "users"),
        Reference("audit_logs", table(spark, directory, "audit_logs"), "user_id", "users"),
    ]
    parents = {name: table(spark, directory, name, "id", "created_at") for name in ("users", "chat_sessions")}
    return orphan_references(references, parents, table(spark, directory, "tombstones"))


@REGISTRY.query("p3_found", _SQL + "SELECT table_name, record_id, kind FROM found")
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return _orphans(spark, directory).select("table_name", "record_id", "kind")


@REGISTRY.query("p3_by_month", _SQL + "SELECT table_name, strftime(created_at, '%Y-%m') AS month, kind, count(*) AS n FROM found GROUP BY ALL")
def p3_by_month(spark: SparkSession, directory: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, directory))
