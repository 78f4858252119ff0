"""Structured Streaming forms of the stateful operators; each has a batch twin among the queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Attempts until an account is locked, and for how long. Fixed values.
MAX_FAILURES, LOCK_MINUTES = 5, 15
LOCKOUT_SCHEMA = "user_id string, locked_at timestamp, locked_until timestamp"


def stream_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A directory of Parquet files as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).parquet(path)


def rate_limits(requests: DataFrame, limit: int, minutes: int = 1, lateness: str = "10 minutes") -> DataFrame:
    """ip, action, minute and n above limit, in fixed windows of event time; rows later than lateness are dropped, which bounds
    the state. created_at must be a timestamp with zone (TIMESTAMP_NTZ takes no watermark)."""
    w = F.window("created_at", f"{minutes} minutes")
    g = requests.withWatermark("created_at", lateness).groupBy(w, F.col("ip_address").alias("ip"), "action").agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") > limit).select("ip", "action", F.col("window.start").alias("minute"), "n")


def latest_status(jobs: DataFrame) -> DataFrame:
    """id and status of each job by its latest change; for output mode update or complete."""
    return jobs.groupBy("id").agg(F.max_by("status", F.struct("updated_at", "status")).alias("status"), F.max("updated_at").alias("updated_at"))


def lockouts_of(rows: list[tuple[pd.Timestamp, bool]], failures: int = 0, until: pd.Timestamp | None = None) -> tuple[list[tuple[pd.Timestamp, pd.Timestamp]], int, pd.Timestamp | None]:
    """(locks, failures, until) after attempts (time, success) in order: attempts while locked do not count, the last failure allowed
    locks and resets the count, a success clears both."""
    locks = []
    for ts, ok in rows:
        if until is not None and ts < until:
            continue
        if ok:
            failures, until = 0, None
            continue
        failures += 1
        if failures >= MAX_FAILURES:
            until, failures = ts + pd.Timedelta(minutes=LOCK_MINUTES), 0
            locks.append((ts, until))
    return locks, failures, until


class Lockout(StatefulProcessor):
    """State a user: failures so far and the end of a lock. Rows of a batch are put in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lock", "failures int, until timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        kept = self.state.get() if self.state.exists() else (0, None)
        pdf = pd.concat(list(rows)).sort_values(["ts", "ok"])
        locks, failures, until = lockouts_of(list(zip(pdf.ts, pdf.ok, strict=True)), kept[0], pd.Timestamp(kept[1]) if kept[1] is not None else None)
        self.state.update((failures, until.to_pydatetime() if until is not None else None))
        if locks:
            yield pd.DataFrame({"user_id": key[0], "locked_at": [a for a, _ in locks], "locked_until": [b for _, b in locks]})

    def close(self) -> None:
        pass


def lockouts_stream(attempts: DataFrame) -> DataFrame:
    """attempts: user_id, ts, ok. Needs the RocksDB state store."""
    return attempts.groupBy("user_id").transformWithStateInPandas(Lockout(), LOCKOUT_SCHEMA, outputMode="Append", timeMode="None")


def lockouts_batch(attempts: DataFrame) -> DataFrame:
    """The same over a table, by a fold over each user's attempts in order, inside the JVM. A user's failed and successful logins are
    gathered in one array; other rows must be filtered out before."""
    ordered = attempts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "ok"))).alias("rows"))
    lock = F.expr(f"INTERVAL {LOCK_MINUTES} MINUTES")
    start = F.struct(F.lit(0).alias("failures"), F.lit(None).cast("timestamp").alias("until"), F.array().cast("array<timestamp>").alias("locks"))

    def step(s: F.Column, r: F.Column) -> F.Column:
        locked = F.coalesce(r["ts"] < s["until"], F.lit(False))
        trips = ~r["ok"] & (s["failures"] + 1 >= MAX_FAILURES)
        return F.struct(
            F.when(locked, s["failures"]).when(r["ok"] | trips, 0).otherwise(s["failures"] + 1).alias("failures"),
            F.when(locked, s["until"]).when(r["ok"], F.lit(None).cast("timestamp")).when(trips, r["ts"] + lock).otherwise(s["until"]).alias("until"),
            F.when(~locked & trips, F.concat(s["locks"], F.array(r["ts"]))).otherwise(s["locks"]).alias("locks"),
        )

    out = ordered.select("user_id", F.explode(F.aggregate("rows", start, step)["locks"]).alias("locked_at"))
    return out.select("user_id", "locked_at", (F.col("locked_at") + lock).alias("locked_until"))


def fold_frames(frames: DataFrame, key: str = "id") -> DataFrame:
    """key, content, sources, verification, failed and n_frames of each answer from its frames (key, seq, kind, payload), in order of seq.

    token adds to content, done gives the sources, verification the report; an error replaces content and marks the answer as failed. Of
    several done or verification frames the last counts, of errors too. An answer's frames are as many as its tokens; other
    kinds and repeats of a seq are left out.
    """
    kinds = ("token", "done", "verification", "error")
    once = frames.filter(F.col("kind").isin(*kinds)).groupBy(key, "seq").agg(F.min(F.struct("kind", "payload")).alias("f")).select(key, "seq", "f.*")
    g = once.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct("seq", "payload")))).alias("tokens"),
        *[F.max_by("payload", F.when(F.col("kind") == k, F.col("seq"))).alias(k) for k in kinds[1:]], F.count(F.lit(1)).alias("n_frames"),
    )
    failed = F.col("error").isNotNull()
    return g.select(key, F.when(failed, F.col("error")).otherwise(F.array_join(F.col("tokens.payload"), "")).alias("content"), F.col("done").alias("sources"), "verification", failed.alias("failed"), "n_frames")


class FrameFold(StatefulProcessor):
    """State an answer: the frames so far. The answer comes out, and its state goes, with the report or an error, which end a stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getListState("frames", "seq long, kind string, payload string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in pdf[["seq", "kind", "payload"]].itertuples(index=False, name=None)]
        held = {int(s): (k, p) for s, k, p in [*(self.frames.get() if self.frames.exists() else []), *new]}
        last = {k: p for _, (k, p) in sorted(held.items()) if k != "token"}
        if not {"verification", "error"} & set(last):
            self.frames.put([(s, *f) for s, f in held.items()])
            return
        self.frames.clear()
        text = "".join(p for _, (k, p) in sorted(held.items()) if k == "token")
        yield pd.DataFrame({"id": [key[0]], "content": [last.get("error", text)], "sources": [last.get("done")], "verification": [last.get("verification")], "failed": ["error" in last]})

    def close(self) -> None:
        pass


def frames_stream(frames: DataFrame) -> DataFrame:
    """frames: id, seq (long), kind, payload, as for fold_frames. Needs the RocksDB state store."""
    return frames.groupBy("id").transformWithStateInPandas(FrameFold(), "id string, content string, sources string, verification string, failed boolean", outputMode="Append", timeMode="None")


def refresh_index(pages: DataFrame, path: str, keys: list[str], checkpoint: str) -> object:
    """Keep the table at path up to date with a stream of loaded pages: each batch replaces exactly the partitions it holds."""
    from vellum.sources.files import replace_partitions

    def replace(batch: DataFrame, _: int) -> None:
        replace_partitions(batch, path, keys)

    return pages.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_audit(audit: DataFrame, path: str, checkpoint: str) -> object:
    """Append a stream of audit rows to Parquet, exactly once, and stop when what is there now is written."""
    return audit.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
