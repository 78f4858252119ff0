from datetime import datetime

from vellum.functions import bloom
from vellum.operators.references import Reference, orphan_references, orphans_by_period

T = [datetime(2024, m, 1) for m in range(1, 13)]
U = "0f8fad5b-d9cb-469f-a165-70867728950e"
ROWS = "id string, user_id string, created_at timestamp, _key string, kind string"


def found(spark, rows, users=((U, T[2]),), dead=()):
    refs = spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS)
    parents = spark.createDataFrame(list(users), "id string, created_at timestamp")
    tomb = spark.createDataFrame([("users", d) for d in dead], "table_name string, record_id string")
    out = orphan_references([Reference("t", refs, "user_id", "users")], {"users": parents}, tomb)
    return sorted((r.record_id, r.kind) for r in out.collect()), out


def test_kinds_and_spellings(spark):
    rows = [
        ("a", U.upper(), T[5]), ("b", "{" + U + "}", T[5]), ("c", U.replace("-", "") + "\n", T[5]), ("d", f" {U} ", T[1]), ("e", "gone-1", T[5]), ("f", "other", T[5]), ("g", None, T[5]),
        ("h", "  ", T[5]), ("i", "​", T[5]), (None, "other", T[5]), ("f", "other", T[5]), ("j", U, None), ("k", "other" * 5000, T[5]),
    ]
    got, out = found(spark, rows, dead=["GONE-1", "{gone1}", U])
    assert got == [("d", "late"), ("e", "deleted"), ("f", "missing"), ("k", "missing")]
    assert {(r.month, r.kind, r.n) for r in orphans_by_period(out).collect()} == {("2024-02", "late", 1), ("2024-06", "deleted", 1), ("2024-06", "missing", 2)}


def test_empty_tables_and_no_parents(spark):
    assert found(spark, [])[0] == []
    assert found(spark, [("a", U, T[1])], users=())[0] == [("a", "missing")]


def test_hot_key(spark):
    rows = [(str(i), U if i % 3 else "hot", T[5]) for i in range(3000)]
    assert len(found(spark, rows)[0]) == 1000


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("cast(id * 7 AS string) AS k")
    words = bloom.build(keys, "k", 17)
    yes = bloom.probe(keys, words, "k", 17, "hit")
    no = bloom.probe(spark.range(5000).selectExpr("concat('x', id) AS k"), words, "k", 17, "hit")
    assert yes.filter("NOT hit").count() == 0
    assert no.filter("hit").count() < 150
