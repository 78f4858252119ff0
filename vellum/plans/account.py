"""Queries of sessions, messages, audit and jobs, and of layouts on literal blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import layout
from vellum.operators.references import is_blank, normal_key
from vellum.plans import REGISTRY
from vellum.sources.tables import table
from vellum.streaming.stateful import lockouts_batch


@REGISTRY.query("recent_sessions", "SELECT user_id, id, updated_at FROM chat_sessions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) <= 5")
def recent_sessions(spark: SparkSession, directory: str) -> DataFrame:
    """The five sessions each user touched last; cut to five before the shuffle too."""
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "id")
    s = table(spark, directory, "chat_sessions", "user_id", "id", "updated_at")
    return s.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").drop("rn")


_MSG = r"""(SELECT DISTINCT lower(regexp_replace(session_id, '[\s\p{Z}{}\-]', '', 'g')) AS k, id, role, content, created_at FROM chat_messages WHERE regexp_replace(session_id, '[\s\p{Z}]', '', 'g') <> '')"""


def _messages(spark: SparkSession, directory: str) -> DataFrame:
    m = table(spark, directory, "chat_messages", "session_id", "id", "role", "content", "created_at").filter(~is_blank(F.col("session_id")))
    return m.select(normal_key(F.col("session_id")).alias("k"), "id", "role", "content", "created_at").distinct()


@REGISTRY.query("session_detail", f"SELECT s.id AS session_id, s.user_id, m.id, row_number() OVER (PARTITION BY s.id ORDER BY m.created_at, m.id) AS seq FROM chat_sessions s JOIN {_MSG} m ON m.k = lower(replace(s.id, '-', '')) WHERE s.user_id IS NOT NULL")
def session_detail(spark: SparkSession, directory: str) -> DataFrame:
    s = table(spark, directory, "chat_sessions", "id", "user_id").filter("user_id IS NOT NULL").select(F.col("id").alias("session_id"), "user_id", normal_key(F.col("id")).alias("k"))
    m = _messages(spark, directory).select("k", "id", "created_at")
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return s.join(m, "k").select("session_id", "user_id", "id", F.row_number().over(w).cast("bigint").alias("seq"))


@REGISTRY.query("session_name", f"SELECT s.id, coalesce(nullif(trim(substr(m.content, 1, 48)), ''), 'New chat') AS name FROM chat_sessions s LEFT JOIN (SELECT k, arg_min(content, ROW(created_at, id)) AS content FROM {_MSG} WHERE lower(trim(role)) = 'user' AND content IS NOT NULL GROUP BY 1) m ON m.k = lower(replace(s.id, '-', ''))")
def session_name(spark: SparkSession, directory: str) -> DataFrame:
    """The first user message's first 48 characters; min_by combines on the map side."""
    m = _messages(spark, directory).filter("lower(trim(role)) = 'user' AND content IS NOT NULL")
    first = m.groupBy("k").agg(F.min_by("content", F.struct("created_at", "id")).alias("content"))
    s = table(spark, directory, "chat_sessions", "id").select("id", normal_key(F.col("id")).alias("k")).join(first, "k", "left")
    return s.select("id", F.coalesce(F.nullif(F.trim(F.substring("content", 1, 48)), F.lit("")), F.lit("New chat")).alias("name"))


@REGISTRY.query("session_search", "SELECT id FROM chat_sessions WHERE contains(lower(coalesce(name, '')), 'notice') OR contains(lower(coalesce(uploaded_files[1], '')), 'lease')")
def session_search(spark: SparkSession, directory: str) -> DataFrame:
    first = F.lower(F.coalesce(F.get("uploaded_files", F.lit(0)), F.lit("")))
    hit = F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit("notice")) | F.contains(first, F.lit("lease"))
    return table(spark, directory, "chat_sessions", "id", "name", "uploaded_files").filter(hit).select("id")


_LAST = f"SELECT k, id, role, content, created_at FROM {_MSG} WHERE regexp_replace(content, '[\\s\\p{{Z}}]', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY created_at DESC, id DESC) <= 6"


def _last_turns(spark: SparkSession, directory: str) -> DataFrame:
    w = Window.partitionBy("k").orderBy(F.desc("created_at"), F.desc("id"))
    return _messages(spark, directory).filter(F.regexp_replace("content", r"[\s\p{Z}]", "") != "").withColumn("rn", F.row_number().over(w)).filter("rn <= 6")


@REGISTRY.query("last_turns", f"SELECT k, id FROM ({_LAST})")
def last_turns(spark: SparkSession, directory: str) -> DataFrame:
    return _last_turns(spark, directory).select("k", "id")


@REGISTRY.query("history_text", f"SELECT k, string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || content, chr(10) ORDER BY created_at, id) AS history FROM ({_LAST}) WHERE role IS NOT NULL GROUP BY 1")
def history_text(spark: SparkSession, directory: str) -> DataFrame:
    line = F.concat(F.upper(F.substring("role", 1, 1)), F.lower(F.substring("role", 2, 1 << 30)), F.lit(": "), "content")
    rows = _last_turns(spark, directory).filter("role IS NOT NULL")  # six a session at most
    g = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", line.alias("line")))).alias("s"))
    return g.select("k", F.array_join(F.col("s.line"), "\n").alias("history"))


@REGISTRY.query("audit_recent", "SELECT id, action, created_at FROM (SELECT DISTINCT id, action, created_at FROM audit_logs) ORDER BY created_at DESC, id DESC LIMIT 200")
def audit_recent(spark: SparkSession, directory: str) -> DataFrame:
    """The newest 200 rows, a top-k by feature."""
    return table(spark, directory, "audit_logs", "id", "action", "created_at").distinct().orderBy(F.desc("created_at"), F.desc("id")).limit(200)


@REGISTRY.query("rate_limit", "SELECT ip_address AS ip, action, date_trunc('minute', created_at) AS minute, count(*) AS n FROM audit_logs WHERE ip_address IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def rate_limit(spark: SparkSession, directory: str) -> DataFrame:
    """Requests per address, route and fixed minute above a limit."""
    a = table(spark, directory, "audit_logs", "ip_address", "action", "created_at").filter("ip_address IS NOT NULL")
    g = a.groupBy(F.col("ip_address").alias("ip"), "action", F.date_trunc("minute", F.col("created_at").cast("timestamp")).cast("timestamp_ntz").alias("minute"))
    return g.agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@REGISTRY.query("job_status", "SELECT id, arg_max(status, ROW(updated_at, status)) AS status, max(updated_at) AS updated_at, max(total_chunks) AS total_chunks FROM document_jobs GROUP BY 1")
def job_status(spark: SparkSession, directory: str) -> DataFrame:
    """Latest state of each job."""
    j = table(spark, directory, "document_jobs", "id", "status", "updated_at", "total_chunks")
    return j.groupBy("id").agg(F.max_by("status", F.struct("updated_at", "status")).alias("status"), F.max("updated_at").alias("updated_at"), F.max("total_chunks").alias("total_chunks"))


@REGISTRY.query("sse_fold", f"SELECT k, count(*) AS frames, sha256(string_agg(id, '' ORDER BY created_at, id)) AS folded FROM {_MSG} GROUP BY 1")
def sse_fold(spark: SparkSession, directory: str) -> DataFrame:
    """An ordered fold of a stream's frames, the batch twin of the stateful one."""
    g = _messages(spark, directory).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("s"))
    return g.select("k", F.size("s").cast("bigint").alias("frames"), F.sha2(F.array_join(F.col("s.id"), ""), 256).alias("folded"))


@REGISTRY.query("relative_time", "SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM (SELECT id, CAST(epoch(TIMESTAMP '2026-01-01' - updated_at) AS BIGINT) AS s FROM chat_sessions)")
def relative_time(spark: SparkSession, directory: str) -> DataFrame:
    """How long ago, against a fixed now."""
    s = F.round(F.lit(1767225600) - F.unix_micros(F.col("updated_at").cast("timestamp")) / 1_000_000).cast("bigint")
    d = lambda n, unit: F.concat(F.floor(F.col("s") / n).cast("string"), F.lit(unit))
    age = F.when(F.col("s") < 60, "just now").when(F.col("s") < 3600, d(60, "m ago")).when(F.col("s") < 86400, d(3600, "h ago")).otherwise(d(86400, "d ago"))
    return table(spark, directory, "chat_sessions", "id", "updated_at").withColumn("s", s).select("id", age.alias("age"))


def _blocks(spark: SparkSession, directory: str) -> DataFrame:
    """Blocks of a page laid out from its lines: odd pages in two columns under a title, even ones in one."""
    p = table(spark, directory, "document_pages", "page_id", "source_file", "page", "page_content")
    b = p.select("page_id", "source_file", "page", F.posexplode(F.split("page_content", "\n")).alias("i", "text"))
    two = (F.col("page") % 2 == 1) & (F.col("i") > 0)
    x0 = F.when(two & (F.col("i") % 2 == 0), 320.0).otherwise(40.0)
    width = F.when(two, 240.0).otherwise(520.0)
    y0 = F.when(two, F.floor((F.col("i") + 1) / 2) * 12.5).otherwise(F.col("i") * 12.5)
    return b.select("page_id", F.lit(600.0).alias("page_width"), F.col("i").alias("block_no"), F.lit(0).alias("block_type"), x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + 10).alias("y1"), "text")


_BLOCKS = """(SELECT page_id, 600.0 AS page_width, i AS block_no, CASE WHEN two AND i % 2 = 0 THEN 320.0 ELSE 40.0 END AS x0, CASE WHEN two THEN 240.0 ELSE 520.0 END AS width, CASE WHEN two THEN floor((i + 1) / 2) * 12.5 ELSE i * 12.5 END AS y0, text FROM
  (SELECT *, page % 2 = 1 AND i > 0 AS two FROM (SELECT page_id, page, unnest(string_split(page_content, chr(10))) AS text, generate_subscripts(string_split(page_content, chr(10)), 1) - 1 AS i FROM document_pages)))"""
_TWO = f"(SELECT page_id, coalesce(sum(CASE WHEN width < 330 AND x0 < 300 THEN 1 ELSE 0 END) * 1.0 / nullif(sum(CASE WHEN width < 330 THEN 1 ELSE 0 END), 0) BETWEEN 0.15 AND 0.85, false) AS two_columns FROM {_BLOCKS} GROUP BY 1)"


@REGISTRY.query("layout_detect", f"SELECT page_id, two_columns FROM {_TWO}")
def layout_detect(spark: SparkSession, directory: str) -> DataFrame:
    return layout.detect_columns(_blocks(spark, directory), ["page_id"])


_ORDERED = f"(SELECT b.page_id, b.block_no, b.text, CASE WHEN NOT two_columns THEN 0 WHEN width > 330 THEN -1 WHEN x0 >= 300 THEN 1 ELSE 0 END AS col, round_even(y0 / 5, 0) * 5 AS bucket, x0 FROM {_BLOCKS} b JOIN {_TWO} t USING (page_id))"


@REGISTRY.query("reading_order", f"SELECT page_id, block_no::BIGINT AS block_no, row_number() OVER (PARTITION BY page_id ORDER BY col, bucket, x0, block_no) AS pos FROM {_ORDERED}")
def reading_order(spark: SparkSession, directory: str) -> DataFrame:
    o = layout.reading_order(_blocks(spark, directory), ["page_id"])
    return o.select("page_id", F.col("block_no").cast("bigint").alias("block_no"), F.col("pos").cast("bigint").alias("pos"))


@REGISTRY.query("page_text", rf"SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY col, bucket, x0, block_no) AS text FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM {_ORDERED}) WHERE t <> '' GROUP BY 1")
def page_text(spark: SparkSession, directory: str) -> DataFrame:
    return layout.page_text(_blocks(spark, directory), ["page_id"])


@REGISTRY.query("login_lockout")
def login_lockout(spark: SparkSession, directory: str) -> DataFrame:
    """Locks by a fold over each user's attempts: failures are errors, successes purchases."""
    e = table(spark, directory, "events", "user_id", "ts", "event_type").filter("event_type IN ('error', 'purchase')")
    return lockouts_batch(e.select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("ok")))


@REGISTRY.query("hourly_events", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, directory: str) -> DataFrame:
    """The batch twin of the windowed stream count."""
    e = table(spark, directory, "events", "ts", "event_type", "value")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
