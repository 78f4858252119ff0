import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import layout
from vellum.operators import retrieval as rt
from vellum.operators.chunks import recursive_chunks, split_text, window_chunks
from vellum.operators.provenance import provenance


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_page_ranges(spark):
    arr = lambda *p: F.array(*map(F.lit, p)).cast("array<int>")
    assert one(spark, tx.page_ranges(arr(3, 4, 5, 7))) == "pp. 3-5, 7"
    assert one(spark, tx.page_ranges(arr(2, 2))) == "p. 2"
    assert one(spark, tx.page_ranges(arr())) == ""


def test_json_rescue_and_names(spark):
    assert one(spark, tx.rescued_json(F.lit('Sure:\n```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, tx.rescued_json(F.lit("none"))) is None
    assert one(spark, tx.base_name(F.lit("..\\..\\x.pdf"))) == "x.pdf"
    assert one(spark, tx.base_name(F.lit("../.."))) is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40))
def test_splitter_covers_text_in_order(text, size):
    chunks = split_text(text, size, 0, ["\n\n", "\n", " ", ""])
    assert all(0 < len(c) <= size for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())


def test_splitter_keeps_long_words_without_last_separator():
    assert split_text("a" * 50 + " b", 10, 0, ["\n\n", "\n", " "]) == ["a" * 50, "b"]


def test_recursive_and_window_chunks(spark):
    pages = spark.createDataFrame([(1, "x " * 1500), (2, None), (3, "")], "page_id bigint, text string")
    r = recursive_chunks(pages, ["page_id"], "text").toPandas()
    assert set(r.page_id) == {1} and r.chunk.str.len().max() <= 350 and r.parent.str.len().max() <= 2000
    assert window_chunks(pages, "text").filter("page_id = 1").count() == 10


def test_nearest_matches_brute_force_over_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "v": list(v)}))
    got = rt.nearest(df.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), df, "id", "v", 5, block=37).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, g in got.groupby("query_id"):
        assert list(g.sort_values("rank").id) == list(np.lexsort((range(300), -np.round(u @ u[q], 6)))[:5])


def test_mmr_with_full_weight_is_similarity_order(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20, 4))
    c = spark.createDataFrame(pd.DataFrame({"q": 1, "g": 0, "id": range(20), "qv": [list(v[0] + 1)] * 20, "v": [list(x) for x in v]}))
    got = rt.mmr(c, "q", "g", "id", 20, 1.0).orderBy("pick").toPandas().id
    sim = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v[0] + 1)
    assert list(got) == list(np.argsort(-sim))


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q int, d int, rank int")
    assert [r.d for r in rt.fuse([(a, 0.5), (b, 0.5)], "q", "d").orderBy("rank").collect()] == [11, 10, 12]


def test_provenance_reasons(spark):
    text = "the licensee shall return all confidential materials to the licensor within thirty days of the end of this agreement " * 4
    docs = spark.createDataFrame([(1, "Intro. " + text), (2, text), (3, "nothing"), (4, None)], "doc bigint, text string")
    p = spark.createDataFrame([(1, "Intro. " + text), (2, text), (3, "q " * 60), (4, None), (5, "too short")], "k int, p string")
    got = {r.k: (r.reason, r.doc, r.prefix) for r in provenance(p, "k", "p", docs, "doc", "text").collect()}
    assert got == {1: ("matched", 1, 400), 2: ("ambiguous", 1, 400), 3: ("no_match", None, None), 4: ("no_reference_contexts", None, None), 5: ("no_match", None, None)}


def test_reading_order_of_two_columns(spark):
    rows = [(1, 600.0, 0, 0, 40.0, 0.0, 560.0, 10.0, "title"), (1, 600.0, 1, 0, 320.0, 22.5, 560.0, 30.0, "right"), (1, 600.0, 2, 0, 40.0, 50.0, 280.0, 60.0, "low left"), (1, 600.0, 3, 0, 40.0, 22.5, 280.0, 30.0, "left"), (1, 600.0, 4, 1, 0.0, 0.0, 9.0, 9.0, "image")]
    b = spark.createDataFrame(rows, "page int, page_width double, block_no int, block_type int, x0 double, y0 double, x1 double, y1 double, text string")
    assert layout.page_text(b, ["page"]).first().text == "title\n\nleft\n\nlow left\n\nright"
