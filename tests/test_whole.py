"""Queries that take in every row: what the forms under a filter leave out."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import DATA
from vellum import plans
from vellum.sources.tables import table

QUERIES = plans.load().queries


def test_searches_reach_every_source(spark, tmp_path):
    """One text is asked for; copies of it lie in two sources and in none, the other documents hold no word of it."""
    rows = [(1, "court_digest", "other words"), (2, "loan_books", "quiet enjoyment"), (3, None, "quiet enjoyment"), (4, "eu_annexes", "quiet enjoyment"), (5, "loan_books", None)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, "Quiet enjoyment")], "source_row bigint, question string").write.parquet(f"{tmp_path}/golden_dataset.parquet")
    for name in ("bm25_topk_all", "rrf_fusion_all", "hybrid_search_all"):
        assert {r.doc_id for r in QUERIES[name](spark, str(tmp_path)).collect()} == {2, 3, 4}, name
    assert [r.children for r in QUERIES["parent_swap_all"](spark, str(tmp_path)).collect()] == [[2, 3, 4]]


def test_searches_read_all_documents(spark):
    hits = QUERIES["bm25_topk_all"](spark, DATA).join(table(spark, DATA, "documents", "doc_id", "source"), "doc_id")
    assert hits.agg(F.count_distinct("source").alias("n")).first().n > 1


def test_headings_end_with_any_line_end(spark, tmp_path):
    head = "12 GENERAL TERMS"
    rows = [(1, f"intro\n{head}\nmore"), (2, f"intro\r\n{head}\r\nmore"), (3, f"intro\r{head}\rmore"), (4, f"{head}\r\n"), (5, "no\r\nheading"), (6, "ARTICLE 5 Fees\u2028due\r\nmore"), (7, None)]
    spark.createDataFrame(rows, "page_id bigint, page_content string").write.parquet(f"{tmp_path}/document_pages.parquet")
    got = {r.page_id: r.hint for r in QUERIES["section_hint_all"](spark, str(tmp_path)).collect()}
    assert got == {1: head, 2: head, 3: head, 4: head, 5: None, 6: "ARTICLE 5 Fees\u2028due", 7: None}


def test_words_beside_accents(spark, tmp_path):
    asked = {"Gilt das für it?": True, "Perché it applies": True, "éit": False, "Qualité": False, "ité": False, "Añade this, por favor": True, "¿THE SAME?": True, "it": True, "site": False, "it_1": False, None: None}
    spark.createDataFrame(list(enumerate(asked)), "source_row bigint, question string").write.parquet(f"{tmp_path}/golden_dataset.parquet")
    got = {r.source_row: r.refers for r in QUERIES["needs_rephrase_all"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(asked.values()))


def provenance_by_force(golden, pages):
    """Each passage against each page."""
    squeezed = lambda t: " ".join((t or "").replace("\0", " ").lower().split())
    texts, out = {r.page_id: squeezed(r.page_content) for r in pages}, {}
    for r in golden:
        p = squeezed((r.reference_contexts or [None])[0])
        held = {i: max(n for n in (400, 250, 150, 80) if p[:n] in t) for i, t in texts.items() if len(p[:80]) >= 40 and p[:80] in t}
        best = [i for i, n in held.items() if n == max(held.values())]
        reason = "no_reference_contexts" if not p else "no_match" if not best else "matched" if len(best) == 1 else "ambiguous"
        out[r.source_row] = (min(best, default=None), max(held.values(), default=None), len(best), reason)
    return out


def test_provenance_of_all_golden_rows(spark):
    golden = table(spark, DATA, "golden_dataset", "source_row", "reference_contexts").collect()
    want = provenance_by_force(golden, table(spark, DATA, "document_pages", "page_id", "page_content").collect())
    got = {r.source_row: (r.page_id, r.prefix, r.n_docs, r.reason) for r in QUERIES["provenance_match_all"](spark, DATA).collect()}
    assert len(got) == len(golden) and got == want
    assert {r.reason: r.n for r in QUERIES["match_summary_all"](spark, DATA).collect()} == Counter(w[3] for w in want.values())


def precision_by_force(reference, contexts):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    ws = words(reference)
    asked = runs(ws, min(3, len(ws))) if ws else set()
    bits = [bool(asked) and len(asked & runs(words(c), min(3, len(ws)))) >= 0.5 * len(asked) for c in contexts]
    return round(sum(sum(bits[: i + 1]) / (i + 1) for i, b in enumerate(bits) if b) / sum(bits), 6) if any(bits) else 0.0


def test_precision_by_the_whole_reference(spark, tmp_path):
    reference = "The agreement ends after thirty days of written notice by either party."
    rest, opening = "... ends after thirty days of WRITTEN notice by either party", "The agreement is governed by the law of Delaware."
    rows = [(1, reference, [opening, rest]), (2, reference, [opening]), (3, reference, [rest, None]), (4, "Thirty days", ["in thirty days", "thirty business days"]), (5, "--", ["--"]), (6, "a b c", ["x a b c", "a b"])]
    spark.createDataFrame(rows, "result_id bigint, reference string, retrieved_contexts array<string>").write.parquet(f"{tmp_path}/ragas_eval_results.parquet")
    got = {r.result_id: r.precision for r in QUERIES["context_precision_all"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 1.0, 4: 1.0, 5: 0.0, 6: 1.0}
    assert got == {i: precision_by_force(ref, cs) for i, ref, cs in rows}


def test_precision_of_all_results(spark):
    rows = table(spark, DATA, "ragas_eval_results", "result_id", "reference", "retrieved_contexts").filter("reference IS NOT NULL AND size(retrieved_contexts) > 0").collect()
    got = {r.result_id: r.precision for r in QUERIES["context_precision_all"](spark, DATA).collect()}
    assert got == {r.result_id: precision_by_force(r.reference, r.retrieved_contexts) for r in rows}
