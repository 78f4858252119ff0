"""References to records that do not exist (problem 3).

A Bloom filter of each parent's keys proves most orphans on the scan, without a shuffle. The references it lets through
are reduced to one row a key (the earliest reference), map-side combined, so that a key that a third of all rows share
costs no more than any other; those rows meet the parents in an exact join. Only keys found wanting there go back to the
rows, by a join whose other side Spark broadcasts when its measured size is small and splits by skew otherwise.

Defined results: a null or blank reference is none; a key's letter case, hyphens, braces and white space do not matter;
a parent without a time is never late, nor is a row without one; several parents of one key count as the earliest;
repeated rows of an id give one row, with the first kind in alphabetical order should they differ; rows with a null id
are left out, as they cannot be named; empty tables give no rows. Columns other than those named are never touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import bloom
from vellum.session import cut

#: White space and characters without width. Taken out by translate, which is many times cheaper than a pattern.
_INVISIBLE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200E))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def is_blank(value: Column) -> Column:
    """Null, or nothing but white space and characters without width."""
    return value.isNull() | (F.translate(value, _INVISIBLE, "") == "")


def normal_key(value: Column) -> Column:
    """The key meant by value: lower case without hyphens, braces and white space."""
    return F.lower(F.translate(value.cast("string"), _INVISIBLE + "{}-", ""))


@dataclass(frozen=True)
class Reference:
    """Rows of a table that refer by column to the key of parent."""

    table: str
    rows: DataFrame
    column: str
    parent: str
    id: str = "id"
    created_at: str = "created_at"


def _parents(parents: dict[str, DataFrame], key: str, created_at: str) -> DataFrame:
    out = None
    for name, df in parents.items():
        one = df.select(F.lit(name).alias("_parent"), normal_key(F.col(key)).alias("_key"), F.col(created_at).alias("_born"))
        one = one.filter(F.col("_key").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out.groupBy("_parent", "_key").agg(F.min("_born").alias("_born"), F.lit(True).alias("_exists"))


def orphan_references(references: list[Reference], parents: dict[str, DataFrame], tombstones: DataFrame, parent_key: str = "id", parent_created_at: str = "created_at") -> DataFrame:
    """table_name, record_id, kind (late, deleted, missing) and created_at of each reference that fails.

    tombstones: table_name (a name in parents) and record_id.
    """
    absent, positive = None, None
    filters = {}
    for name, df in parents.items():
        keys = df.select(normal_key(F.col(parent_key)).alias("_key"))
        bits = bloom.log2_bits_for(df.count())
        filters[name] = (cut(bloom.build(keys, "_key", bits)), bits)  # built once, not once per place in the plan
    for r in references:
        words, bits = filters[r.parent]
        value = F.col(r.column).cast("string")
        rows = r.rows.filter(~is_blank(value) & F.col(r.id).isNotNull()).select(
            F.lit(r.table).alias("table_name"), F.col(r.id).cast("string").alias("record_id"), F.lit(r.parent).alias("_parent"), normal_key(value).alias("_key"), F.col(r.created_at).alias("created_at")
        )
        rows = bloom.probe(rows, words, "_key", bits, "_hit")
        no, yes = rows.filter("NOT _hit").drop("_hit"), rows.filter("_hit").drop("_hit")
        absent = no if absent is None else absent.unionByName(no)
        positive = yes if positive is None else positive.unionByName(yes)

    earliest = positive.groupBy("_parent", "_key").agg(F.min("created_at").alias("_first"))
    wanting = (
        earliest.join(_parents(parents, parent_key, parent_created_at), ["_parent", "_key"], "left")
        .filter(F.col("_exists").isNull() | (F.col("_born") > F.col("_first")))
        .select("_parent", "_key", "_born", F.coalesce("_exists", F.lit(False)).alias("_exists"))
    )
    found = positive.join(wanting, ["_parent", "_key"]).filter(~F.col("_exists") | (F.col("_born") > F.col("created_at")))
    late = found.filter("_exists").select("table_name", "record_id", "created_at", F.lit("late").alias("kind"))

    dead = tombstones.select(F.col("table_name").alias("_parent"), normal_key(F.col("record_id")).alias("_key")).distinct().withColumn("_dead", F.lit(True))
    gone = absent.unionByName(found.filter(~F.col("_exists")).select(absent.columns))
    gone = gone.join(dead, ["_parent", "_key"], "left").select(
        "table_name", "record_id", "created_at", F.when(F.col("_dead"), "deleted").otherwise("missing").alias("kind")
    )
    return late.unionByName(gone).groupBy("table_name", "record_id").agg(F.min("kind").alias("kind"), F.min("created_at").alias("created_at"))


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Counts of failing references per table, month (null without a time) and kind."""
    return orphans.groupBy("table_name", F.date_format("created_at", "yyyy-MM").alias("month"), "kind").agg(F.count(F.lit(1)).alias("n"))
