"""What the plans of operators must and must not hold."""

from tests.conftest import DATA
from vellum import plans


def plan(spark, name):
    return plans.load().queries[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    p = plan(spark, "lexical_corpus")
    assert "EqualTo(source,loan_books)" in p and "In(lang, [" in p


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "recent_sessions")
    assert "TakeOrderedAndProject" in plan(spark, "audit_recent")


def test_no_python_and_no_cross_join(spark):
    for name in ("p3_found", "bm25_topk", "claim_report", "context_assemble", "provenance_match", "reading_order"):
        p = plan(spark, name)
        assert "Python" not in p and "Pandas" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_scan_reads_only_what_is_needed(spark):
    p = plan(spark, "chunk_counts")
    assert "ReadSchema: struct<source_file:string,page_content:string>" in p
