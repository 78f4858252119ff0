"""Names, provenance, lexical search, parents, turns, frames and files against brute force and by their edge cases."""

import math
import random
import time
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import hybrid, names, provenance, retrieval
from vellum.operators.scoring import Scorer
from vellum.sources import files
from vellum.streaming.stateful import fold_frames, refresh_index


def plain(n):
    n = n.lower()
    return "".join(c for c in (n[:-4] if n.endswith(".pdf") else n) if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def test_names_against_brute_force(spark):
    rng = random.Random(4)
    have = [f"{rng.choice(['Acme', 'Bolt', 'Corvus'])} {rng.choice(['Lease', 'Supply', 'Loan'])} {i}.PDF" for i in range(40)]
    want = [h[: rng.randrange(5, len(h))] for h in have[:10]] + [h.replace("e", "o") + "x" for h in have[10:20]] + ["zzzzqqqq", "", None, "!!", have[0], have[0], "a.pdf.b.pdf"]
    w = spark.createDataFrame([(x,) for x in want], "name string")
    f = spark.createDataFrame([(x, 1) for x in [*have, None]], "file string, name int")
    for block in (7, 1000):
        got = {r.name: (r.file, r.how) for r in names.match_names(w, "name", f, "file", block).collect()}
        for n in {x for x in want if x and plain(x)}:
            held = [h for h in sorted(have) if plain(n) in plain(h) or plain(h) in plain(n)]
            ratios = sorted((-SequenceMatcher(None, plain(h), plain(n)).ratio(), h) for h in have)
            due = (held[0], "contains") if held else (ratios[0][1], "similar") if -ratios[0][0] >= 0.6 else None
            assert got.get(n) == due, n
        assert not {None, "", "!!"} & set(got)
    assert names.match_names(w.limit(0), "name", f, "file").count() == 0


def named_by_force(n, have):
    """File, how and ratio of one wanted name, each file looked at."""
    held = [h for h in have if plain(h) and (plain(n) in plain(h) or plain(h) in plain(n))]
    if held:
        return (min(held), "contains", 1.0)
    r, h = min((-SequenceMatcher(None, plain(h), plain(n)).ratio(), h) for h in have if plain(h))
    return (h, "similar", round(-r, 6)) if -r >= 0.6 else None


def test_names_long_equal_and_repetitive(spark):
    """Names over a word of bits, over 200 characters (where difflib drops frequent ones), of two letters, and files of the same letters and digits."""
    rng = random.Random(8)
    word = lambda n, of="abcdefgh01": "".join(rng.choice(of) for _ in range(n))
    have = [word(rng.choice([3, 30, 63, 64, 65, 130, 260])) + ".pdf" for _ in range(60)] + [word(40, "ab") for _ in range(20)]
    have += [h.upper() for h in have[:5]] + [f"_{h}" for h in have[5:10]] + ["--.pdf", "Ünï 7 (b).pdf"]
    cut_ = lambda h: "".join(c for c in h if rng.random() > 0.2)
    want = sorted({cut_(h) for h in have} | {cut_(h) + word(9) for h in have} | {h[2:] for h in have[:20]} | {word(40, "ab") for _ in range(20)} | {"x" + have[0] + "y", "ab", "7"})
    w, f = spark.createDataFrame([(x,) for x in want], "name string"), spark.createDataFrame([(x,) for x in have], "file string")
    due = {n: named_by_force(n, have) for n in want if plain(n)}
    assert {d and d[1] for d in due.values()} == {None, "contains", "similar"}
    for block in (30, 1000):
        assert {r.name: (r.file, r.how, r.ratio) for r in names.match_names(w, "name", f, "file", block).collect()} == {n: d for n, d in due.items() if d}


def test_many_names_do_not_meet_all_files(spark, monkeypatch):
    """3,000 names against 3,000 files: no name is aligned with more than a few files, and all is done long before all pairs would be."""
    rng = random.Random(5)
    part = lambda: "".join(rng.choice(["mor", "vel", "zan", "kel", "tuv", "bri", "ras", "opa"]) for _ in range(4))
    have = [f"{part()}_2012{i:04d}_EX-10_{rng.choice(['Loan', 'Supply', 'Franchise'])} Agreement.pdf" for i in range(3000)]
    want = have[:1500] + [h[2:26] + "_v2.pdf" for h in have[1500:]]
    w, f = spark.createDataFrame([(x,) for x in want], "name string"), spark.createDataFrame([(x,) for x in have], "file string")
    began = time.time()
    got = {r.name: (r.file, r.how, r.ratio) for r in names.match_names(w, "name", f, "file").collect()}
    assert time.time() - began < 60
    assert all(got[h] == (h, "contains", 1.0) for h in have[:1500])
    asked = [n for n in want[1500:] if got.get(n, (None, None))[1] != "contains"][:10]
    assert all(got.get(n) == named_by_force(n, have) for n in asked)
    aligned = []
    monkeypatch.setattr(names, "SequenceMatcher", type("Counted", (SequenceMatcher,), {"ratio": lambda self: aligned.append(1) or SequenceMatcher.ratio(self)}))
    batch = pa.RecordBatch.from_pylist([{"key": plain(h), "file": h} for h in have])
    assert sum(b.num_rows for b in names._likest([plain(n) for n in asked])([batch])) and len(aligned) <= 10 * len(asked)


def test_containing_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 9)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(60)] + [(100, None), (101, ""), (102, "xy " * 3000 + "end of it")]
    norm = {i: " ".join((t or "").split()).lower() for i, t in docs}
    needles = {}
    for k in range(80):
        t = norm[rng.randrange(60)]
        a = rng.randrange(max(1, len(t)))
        n = t[a : a + rng.choice([1, 2, 4, 8, 15, 30, 60, 90])].strip()
        if n:
            needles[k] = n
    needles |= {200: "end of it", 201: "not there at all", 202: needles[next(iter(needles))]}
    p = spark.createDataFrame(list(needles.items()), "k int, needle string")
    d = spark.createDataFrame([(*r, r[0]) for r in docs], "doc int, text string, needle int")
    want = {(k, i) for k, n in needles.items() for i, t in docs if t is not None and n in norm[i]}
    for block, size in ((65536, 1 << 20), (20, 500)):
        monkeypatch.setattr(provenance, "NEEDLES", block)
        monkeypatch.setattr(provenance, "CHARACTERS", size)
        assert {(r.k, r.doc) for r in provenance.containing(p, "k", d, "doc", "text").collect()} == want
    assert provenance.containing(p.limit(0), "k", d, "doc", "text").count() == 0


def test_paragraph_votes(spark):
    a, b, c = "the first paragraph of the passage is this", "the second paragraph goes on like that here", "a third one stands in another file only"
    docs = spark.createDataFrame([("x", f"{a} and more"), ("x", f"so {b.upper()}"), ("y", f"{a}  {c}"), ("z", None)], "f string, text string")
    p = spark.createDataFrame([(1, f"{a}\n\n{b}\n\nshort"), (2, f"{a}\n\n{c}"), (3, a), (4, None), (5, "nothing of this kind is to be found")], "k int, p string")
    assert {(r.k, r.f, r.votes) for r in provenance.paragraph_votes(p, "k", "p", docs, "f", "text").collect()} == {(1, "x", 2), (2, "y", 2), (3, "x", 1), (3, "y", 1)}


@pytest.mark.parametrize("mode,pad", [("nonneg", False), ("okapi_floor", True)])
def test_bm25_against_brute_force(spark, monkeypatch, mode, pad):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randrange(n)))
    docs, asks = [(i, text(30)) for i in range(70)] + [(90, None)], [(i, text(5)) for i in range(12)] + [(50, "zz"), (51, None)]
    q, d = spark.createDataFrame(asks, "q bigint, t string"), spark.createDataFrame(docs, "doc bigint, t string")
    toks = {i: t.split() for i, t in docs if t is not None}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {w: sum(w in set(t) for t in toks.values()) for w in "abcdefgh"}
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) if mode == "nonneg" else floor if raw[w] < 0 else raw[w] for w in df}
    want = {}
    for i, t in asks:
        if t is not None:
            score = {k: round(sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in t.split() if w in idf and w in ws), 6) for k, ws in toks.items()}
            want[i] = sorted(((-s, k) for k, s in score.items() if s > 0 or pad))[:10]
    for block, cells in ((4096, 1 << 22), (5, 40)):
        monkeypatch.setattr(retrieval, "QUERIES", block)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        got = {}
        for r in retrieval.bm25(q, "q", "t", d, "doc", "t", 10, mode=mode, pad=pad).orderBy("rank").collect():
            got.setdefault(r.q, []).append((-r.score, r.doc))
        assert got == {k: v for k, v in want.items() if v}
    assert retrieval.bm25(q, "q", "t", d.limit(0), "doc", "t", 10, mode=mode, pad=pad).count() == 0
    assert retrieval.bm25(q.limit(0), "q", "t", d, "doc", "t", 10, mode=mode, pad=pad).count() == 0


def test_parents_in_order_met_and_children_without_last(spark):
    hits = spark.createDataFrame([(1, 10, 1, None, None), (1, 11, 2, "p", 7), (1, 12, 3, "r", 1), (1, 13, 4, "p", 3), (1, 14, 5, "p", 7), (1, 15, 6, None, 2)], "q int, c int, rank int, parent_id string, page int")
    got = [(r.parent_id, r.c, r.pages) for r in hybrid.swap_to_parents(hits, "q", "c").orderBy("rank").collect()]
    assert got == [("p", None, [7, 3]), ("r", None, [1]), (None, 10, []), (None, 15, [2])]


def test_a_scorer_of_ones_own(spark):
    q = spark.createDataFrame([(1, "alpha")], "q bigint, t string")
    c = spark.createDataFrame([(i, i, f"alpha {i}", None if i == 3 else f"p{i}") for i in range(6)], "c bigint, page int, t string, parent_id string")
    parents = spark.createDataFrame([(f"p{i}", "x" * i) for i in range(6)], "parent_id string, parent_text string")
    own = Scorer(rerank=lambda question, text: F.length(text).cast("double"))
    got = hybrid.hybrid_search(q, "q", "t", c, "c", "t", parents, 6, 3, own).orderBy("rank").collect()
    assert [(r.parent_id, r.c) for r in got] == [(None, 3), ("p5", None), ("p4", None)]


def test_turns_and_frames(spark):
    turns = spark.createDataFrame([(1, "s", "u", "q", "a", 5), (2, "s", "other", "q", "a", 6), (3, "none", "u", "q", "a", 7), (4, "s", "u", "q2", None, 8)], "turn_id int, session_id string, user_id string, question string, answer string, at int")
    sessions = spark.createDataFrame([("s", "u")], "id string, user_id string")
    messages, touched = files.persist_turns(turns, sessions)
    assert {(r.turn_id, r.seq, r.role, r.content) for r in messages.collect()} == {(1, 0, "user", "q"), (1, 1, "assistant", "a"), (4, 0, "user", "q2"), (4, 1, "assistant", None)}
    assert [tuple(r) for r in touched.collect()] == [("s", 8)]
    frames = spark.createDataFrame([("a", 3, "done", "[1]"), ("a", 1, "token", "he"), ("a", 2, "token", "llo"), ("a", 2, "token", "llo"), ("a", 4, "verification", "{}"), ("b", 1, "token", "x"), ("b", 2, "error", "bad"), ("c", 1, "ping", "")], "id string, seq int, kind string, payload string")
    assert {tuple(r) for r in fold_frames(frames).collect()} == {("a", "hello", "[1]", "{}", False, 4), ("b", "bad", None, None, True, 2)}


def test_text_helpers(spark):
    df = spark.createDataFrame([(["A b. ", "a B.", " ", "C", "c "], "x.pdf.y.PDF", 1536)], "c array<string>, n string, s bigint")
    r = df.select(tx.first_spelling(F.col("c")).alias("c"), tx.normal_name(F.col("n")).alias("n"), tx.human_size(F.col("s")).alias("s"), tx.retry_after(F.lit("no")).alias("d")).first()
    assert tuple(r) == (["A b.", "C"], "xpdfy", "2KB", 2.0)


def test_files_that_are_odd_or_absent(spark, tmp_path):
    rows, rejects = files.tolerant_json(spark, f"file://{tmp_path}/none.jsonl", "a int")
    assert rows.count() == 0 and rejects.count() == 0 and rows.columns == ["a"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    rows, rejects = files.tolerant_json(spark, f"file://{tmp_path}/x.jsonl", "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2] and [r.value for r in rejects.collect()] == ["not json"]
    for n in ("a.pdf", "b.PDF", "c.Pdf", "d.txt"):
        (tmp_path / n).write_text("x")
    assert {r.path[-5:] for r in files.listing(spark, str(tmp_path)).collect()} == {"a.pdf", "b.PDF", "c.Pdf"}
    (tmp_path / "prompt.txt").write_text("\n Answer briefly. \n")
    assert files.prompt(spark, f"{tmp_path}/prompt.txt") == "Answer briefly."
    df = spark.createDataFrame([("y" * 200, 1, ["a", "b"])], "answer string, score int, tags array<string>")
    files.append_log(df, f"{tmp_path}/log")
    files.append_log(df, f"{tmp_path}/log")
    assert [len(r.answer) for r in spark.read.json(f"{tmp_path}/log").collect()] == [120, 120]
    files.append_rows(df, f"{tmp_path}/rows")
    files.append_rows(df, f"{tmp_path}/rows")
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 2
    files.export(df, f"{tmp_path}/out", ["tags"])
    assert spark.read.csv(f"{tmp_path}/out/csv", header=True, escape='"').first().tags == '["a","b"]' and spark.read.json(f"{tmp_path}/out/json").first().tags == ["a", "b"]


def test_index_follows_a_stream_of_loads(spark, tmp_path):
    src, index = f"{tmp_path}/src", f"{tmp_path}/index"
    load = lambda rows: spark.createDataFrame(rows, "file string, page int, text string").write.mode("append").parquet(src)
    run = lambda: refresh_index(spark.readStream.schema("file string, page int, text string").parquet(src), index, ["file"], f"{tmp_path}/ck").awaitTermination()
    load([("a", 1, "old"), ("a", 2, "old"), ("b", 1, "kept")])
    run()
    load([("a", 1, "new")])
    run()
    assert {(r.file, r.page, r.text) for r in spark.read.parquet(index).collect()} == {("a", 1, "new"), ("b", 1, "kept")}
