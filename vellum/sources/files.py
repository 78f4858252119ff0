"""Readers and writers of the file formats in use; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GOLDEN = "question string, ground_truth string, reference_contexts array<string>, intent string, synthesizer string, doc_category string"
QA_CORPUS = "data array<struct<title string, paragraphs array<struct<context string, qas array<struct<question string, is_impossible boolean, answers array<struct<text string>>>>>>>>"
DOC_MAP = "map<string, struct<source_file string, reason string>>"


def json_array(spark: SparkSession, path: str, schema: str = GOLDEN, row: str = "source_row") -> DataFrame:
    """The objects of one JSON array, numbered by place."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{_fields(schema)}>>").alias("rows"))
    return whole.select(F.posexplode("rows").alias(row, "r")).select(row, "r.*")


def json_map(spark: SparkSession, path: str, row: str = "source_row") -> DataFrame:
    """row, source_file and reason of a JSON object keyed by row number; entries without a file are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", DOC_MAP).alias("m"))
    out = whole.select(F.explode("m").alias("k", "v")).select(F.try_to_number("k", F.lit("9999999999")).cast("int").alias(row), "v.*")
    return out.filter("source_file IS NOT NULL AND source_file <> ''")


def qa_corpus(spark: SparkSession, path: str) -> DataFrame:
    """title, context, question, answer of a nested question corpus; impossible and unanswered questions and answers under five
    characters are left out."""
    d = spark.read.schema(QA_CORPUS).json(path, multiLine=True).select(F.explode("data").alias("d"))
    p = d.select("d.title", F.explode("d.paragraphs").alias("p")).select("title", "p.context", F.explode("p.qas").alias("q"))
    answer = F.get("q.answers", F.lit(0))["text"]
    out = p.filter("NOT coalesce(q.is_impossible, false)").select("title", "context", "q.question", answer.alias("answer"))
    return out.filter(F.length("answer") >= 5)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with quoted line breaks and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")


def names(spark: SparkSession, path: str) -> DataFrame:
    """name: the lines of a text file, stripped, blank ones left out."""
    t = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("name"))
    return t.filter("name <> ''")


def listing(spark: SparkSession, path: str, glob: str = "*.[pP][dD][fF]", max_bytes: int | None = None) -> DataFrame:
    """path and length of the files below path; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")
    return f.filter(F.col("length") <= max_bytes) if max_bytes else f


def list_column(text: Column) -> Column:
    """A list stored as JSON; anything else becomes a list of one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.when(text.isNotNull(), F.array(text)))


def prompt(spark: SparkSession, path: str) -> str:
    """The text of one prompt file, without white space around it."""
    return (spark.read.text(path, wholetext=True).first() or [""])[0].strip()


def tolerant_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines: what does not parse goes to rejects as text, and a path that is not there gives no rows."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        lines = spark.createDataFrame([], "value string")
    else:
        lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull()
    return parsed.filter(~bad).select("r.*").drop("_corrupt_record"), parsed.filter(bad).select("value")


def payload_origin(payload: Column) -> Column:
    """struct of source and page of a payload {metadata: {source, file_name, page}, source, page} held as JSON, by a chain of
    fall-backs; metadata that is no object counts as empty."""
    at = lambda path: F.nullif(F.get_json_object(payload, path), F.lit(""))
    source = F.coalesce(at("$.metadata.source"), at("$.source"), at("$.metadata.file_name"), F.lit("unknown_source"))
    return F.struct(source.alias("source"), F.coalesce(at("$.metadata.page"), at("$.page"), F.lit("unknown_page")).alias("page"))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks, before anything runs."""
    lacks = [c for c in columns if c not in df.columns]
    if lacks:
        raise ValueError(f"columns missing: {', '.join(lacks)}")
    return df


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write df over exactly the partitions of path that it holds; others stay. One commit, no time between delete and insert."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def rewrite_without(df: DataFrame, keys: DataFrame, on: list[str], to: str) -> None:
    """Delete by key: df without the rows of keys, written to a new path."""
    df.join(keys, on, "left_anti").write.mode("overwrite").parquet(to)


def update_columns(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with columns taken from changes where these hold a value for the key."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    out = df.join(c, key, "left")
    return out.select(*[F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in df.columns])


def export(df: DataFrame, path: str, list_columns: list[str] = ()) -> None:
    """JSON lines, and CSV with lists as JSON."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.withColumns({c: F.to_json(c) for c in list_columns}).write.mode("overwrite").csv(f"{path}/csv", header=True, escape='"')


def append_rows(df: DataFrame, path: str) -> None:
    """Append a batch of results."""
    df.write.mode("append").parquet(path)


def append_log(reports: DataFrame, path: str, answer: str = "answer", size: int = 120) -> None:
    """Append reports as JSON lines, the answer cut to size characters: a log, not a record."""
    reports.withColumn(answer, F.substring(answer, 1, size)).write.mode("append").json(path)


def persist_turns(turns: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, touched) of turns (turn_id, session_id, user_id, question, answer, at): two messages a turn and the new time of its
    session. Turns whose session is not there or is another user's give nothing."""
    owned = turns.join(sessions.select(F.col("id").alias("session_id"), "user_id"), ["session_id", "user_id"], "left_semi")
    two = F.array(F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    messages = owned.select("turn_id", "session_id", "at", F.inline(two)).select("turn_id", "session_id", "seq", "role", "content", F.col("at").alias("created_at"))
    return messages, owned.groupBy("session_id").agg(F.max("at").alias("updated_at"))


def _fields(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))
