"""Conversations out of message rows (problem 2).

Messages carry no parent pointer, so each one is given the message before it in its session. Finding that one must not
put a session into one task: the messages are range-partitioned by (session, time, speaker, id), numbered by partition
and position, and the pointer is the number before; only where a session goes on in the next partition is the pointer
looked up in a table with one row per partition and session. resolve_paths then follows the pointers by pointer jumping,
which also serves data with pointers of its own, and finds orphans and cycles.

Defined results: a role is read without regard to case, spaces and punctuation around it; a message of null id stands for
itself, exact repeats of such a row count once; a null time sorts first; of rows that share an id and differ, the one that
sorts first in (session, time, role, text) counts; rows without a session belong to no conversation; a session with
nothing but system notices is no conversation of one or more turns and so is dropped; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.references import is_blank, normal_key
from vellum.session import cut

USERS = ("user", "human", "customer", "client", "person", "enduser", "prompter", "you")
ASSISTANTS = ("assistant", "ai", "bot", "model", "chatbot", "gpt", "llm", "agent", "aiassistant", "machine")
SYSTEM = ("system", "sys", "developer", "notice", "tool")

#: Contents that stand in for a missing value, in lower case without spaces and without brackets, quotes and # around them. Fixed values.
STAND_INS = ("", "-", "--", "---", "–", "—", "?", ".", "...", "…", "n/a", "na", "n.a.", "n.a", "none", "null", "nil", "nan", "nat", "undefined", "empty", "missing", "blank", "nocontent", "nodata", "novalue", "notavailable", "notapplicable", "tbd", "keininhalt", "sanscontenu", "sincontenido", "nessuncontenuto")
_WRAPPED = r"^[<(\[{\"'#]+|[>)\]}\"']+$"

#: More rounds than any path needs: 2**62 messages.
MAX_ROUNDS = 62


def speaker(role: Column) -> Column:
    """user, assistant, system, or null for a role that cannot be read."""
    r = F.lower(F.regexp_replace(role, r"[^\p{L}]", ""))
    return F.when(r.isin(*USERS), "user").when(r.isin(*ASSISTANTS), "assistant").when(r.isin(*SYSTEM), "system")


def says_nothing(content: Column) -> Column:
    """Null, blank, invisible, or only a stand-in for a missing value."""
    bare = F.lower(F.regexp_replace(content, r"[\s\p{Z}\p{Cc}\p{Cf}]", ""))
    return content.isNull() | F.regexp_replace(bare, _WRAPPED, "").isin(*STAND_INS)


def session_key(session: Column) -> Column:
    """Lower case with hyphens where it is a UUID in any spelling, else as it is in lower case without blanks around."""
    k = normal_key(session)
    return F.when(k.rlike("^[0-9a-f]{32}$"), F.regexp_replace(k, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(F.lower(F.trim(session)))


def resolve_paths(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, root, depth and state of each node by pointer jumping: after round k each pointer spans 2**k steps.

    state: ok (a root is reached), orphan (the path ends at a parent that is no node; root is that parent) or cycle.
    node is unique and not null; a null parent makes a root. Rounds: log2 of the longest path; only nodes that still
    climb are joined again, so that many short paths and one long one cost little more than the short ones.
    """
    n = nodes.select(F.col(node).alias("node"), F.col(parent).alias("ptr"))
    known = n.select(F.col("node").alias("ptr"), F.lit(True).alias("known"))
    first = (
        n.join(known, "ptr", "left")
        .select("node", "ptr", F.col("ptr").isNull().alias("root"), (F.col("ptr").isNotNull() & F.col("known").isNull()).alias("orphan"))
        .select(
            "node",
            F.when(F.col("root"), F.col("node")).otherwise(F.col("ptr")).alias("ptr"),
            F.when(F.col("root"), 0).otherwise(1).cast("bigint").alias("depth"),
            F.when(F.col("root"), "ok").when(F.col("orphan"), "orphan").alias("state"),
        )
    )
    state = cut(first)
    total = None
    for r in range(MAX_ROUNDS):
        open_ = state.filter("state IS NULL")
        if open_.isEmpty():
            break
        total = total if total is not None else state.count()
        if 1 << r > total:  # a path without a cycle would have ended by now
            state = state.withColumn("state", F.coalesce("state", F.lit("cycle")))
            break
        above = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("up"), F.col("depth").alias("far"), F.col("state").alias("end"))
        climbed = open_.join(above, "ptr").select("node", F.col("up").alias("ptr"), (F.col("depth") + F.col("far")).alias("depth"), F.col("end").alias("state"))
        state = cut(state.filter("state IS NOT NULL").unionByName(climbed))
    return state.select("node", F.col("ptr").alias("root"), "depth", F.coalesce("state", F.lit("ok")).alias("state"))


def linked_messages(messages: DataFrame, content: bool = False) -> DataFrame:
    """One row a message of a session: session_id, id, speaker, empty, created_at, node and parent (null: the first), and content if asked for.

    System notices are left out of the links; their rows have a null node.
    """
    m = messages.filter(~is_blank(F.col("session_id"))).select(
        session_key(F.col("session_id")).alias("session_id"), "id", speaker(F.col("role")).alias("speaker"), says_nothing(F.col("content")).alias("empty"), "created_at", F.xxhash64("content").alias("text"), *(["content"] if content else [])
    )
    key = F.coalesce(F.col("id"), F.concat_ws("|", F.lit("null"), "session_id", F.col("created_at").cast("string"), "speaker", F.col("text").cast("string")))
    m = m.groupBy(key.alias("key")).agg(F.min(F.struct("session_id", "created_at", "speaker", "text", "empty", "id", *(["content"] if content else []))).alias("m")).select("key", "m.*")
    rank = F.when(F.col("speaker") == "user", 0).otherwise(1)
    m = m.withColumn("rank", rank).repartitionByRange("session_id", "created_at", "rank", "key").sortWithinPartitions("session_id", "created_at", "rank", "key")
    shown = ["session_id", "id", "speaker", "empty", "created_at", *(["content"] if content else [])]
    m = cut(m.select(*shown, F.monotonically_increasing_id().alias("node")))
    spoken = m.filter(F.coalesce(F.col("speaker"), F.lit("")) != "system").withColumn("part", F.shiftright("node", 33))
    w = Window.partitionBy("session_id", "part").orderBy("node")
    ends = spoken.groupBy("session_id", "part").agg(F.max("node").alias("last"))
    before = ends.select("session_id", "part", F.lag("last").over(Window.partitionBy("session_id").orderBy("part")).alias("before"))
    links = spoken.withColumn("prior", F.lag("node").over(w)).join(before, ["session_id", "part"])
    links = links.select(*shown, "node", F.coalesce("prior", "before").alias("parent"))
    notices = m.filter("speaker = 'system'").select(*shown, F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("parent"))
    return links.unionByName(notices)


def conversations(messages: DataFrame, content: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ordered, sessions): each message with its place (from 0) and state, and each session with its turns and whether it is broken.

    Only messages that say something and whose role can be read are nodes; those after another message are orphans, as is all that follows.
    sound: no orphan, the speakers alternate from user to assistant and the last message is a reply.
    """
    links = cut(linked_messages(messages, content))
    usable = F.col("node").isNotNull() & ~F.col("empty") & F.col("speaker").isNotNull()
    paths = resolve_paths(links.filter(usable))
    placed = links.join(paths, "node", "left").withColumn("place", F.col("depth"))
    due = F.when(F.col("place") % 2 == 0, "user").otherwise("assistant")
    wrong = F.col("node").isNotNull() & (F.col("state").isNull() | (F.col("state") != "ok") | (F.col("speaker") != due))
    sessions = placed.groupBy("session_id").agg(F.count("node").alias("n_messages"), F.bool_or(wrong).alias("wrong"))
    sessions = sessions.select("session_id", "n_messages", (F.col("wrong") | (F.col("n_messages") == 0) | (F.col("n_messages") % 2 == 1)).alias("broken"))
    return placed, sessions


def broken_sessions(messages: DataFrame) -> DataFrame:
    """The sessions to drop."""
    return conversations(messages)[1].filter("broken").select("session_id")


def ordered_conversations(messages: DataFrame) -> DataFrame:
    """session_id, place (from 0), speaker, id and content of the sound conversations, as rows."""
    placed, sessions = conversations(messages, content=True)
    kept = placed.filter("node IS NOT NULL").join(sessions.filter("NOT broken").select("session_id"), "session_id")
    return kept.select("session_id", "place", "speaker", "id", "content")


def path_report(messages: DataFrame) -> DataFrame:
    """Per state of the messages' paths (ok, orphan, cycle, unusable): messages, sessions, and the deepest place."""
    placed, _ = conversations(messages)
    state = F.coalesce("state", F.lit("unusable"))
    once = placed.filter("node IS NOT NULL").groupBy(state.alias("state"), "session_id").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("deepest"))
    return once.groupBy("state").agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("sessions"), F.max("deepest").alias("deepest"))
