"""Edge cases of each operator, and results against brute force, a public library, round trips and held-out accuracy."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from vellum.llm import conversations as conv
from vellum.llm import lines, mixing, pairs, residue, tokenize, truncation

T = [datetime(2024, 1, 1, 0, i) for i in range(60)]
S = "0f8fad5b-d9cb-469f-a165-70867728950e"


# conversations


def dropped(spark, rows):
    m = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, session_id string, role string, content string, created_at timestamp, node string, state int")
    return {r.session_id for r in conv.broken_sessions(m).collect()}


def test_conversations_kept_and_dropped(spark):
    good = [("1", S.upper(), "Human", "hi", T[0]), ("2", "{" + S + "}", " bot ", "hello", T[0]), ("2", S, "bot", "hello", T[0]), ("9", S, "system", None, T[1]), ("3", S, "user", "more", T[3]), ("4", S, "ai", "answer", T[4])]
    assert dropped(spark, good) == set()
    assert dropped(spark, [*good, ("5", S, "user", "and?", T[5])]) == {S}
    for content in (None, "", "  ​", "N/A", "<empty>", "[]"):
        assert dropped(spark, [*good[:-1], ("4", S, "ai", content, T[4])]) == {S}, content
    for role in (None, "", "?", "unknown"):
        assert dropped(spark, [*good[:-1], ("4", S, role, "x", T[4])]) == {S}, role
    assert dropped(spark, [("1", S, "system", "x", T[0])]) == {S}
    assert dropped(spark, [("1", None, "user", "x", T[0]), ("2", "  ", "user", "x", T[0])]) == set()
    assert dropped(spark, []) == set()
    assert dropped(spark, [(None, S, "user", "q", None), (None, S, "user", "q", None), ("b", S, "assistant", "a" * 100000, T[1])]) == set()


def test_contents_stay_with_their_row(spark):
    rows = [(None, S, "user", "question", T[0]), ("2", S, "bot", "answer", T[1]), ("2", S, "bot", "changed later", T[2])]
    m = spark.createDataFrame(rows, "id string, session_id string, role string, content string, created_at timestamp")
    assert [(r.place, r.id, r.content) for r in conv.ordered_conversations(m).orderBy("place").collect()] == [(0, None, "question"), (1, "2", "answer")]


def test_paths_after_unusable_messages_are_orphans(spark):
    rows = [("1", S, "user", "q", T[0]), ("2", S, "ai", "(no content)", T[1]), ("3", S, "user", "q", T[2]), ("4", S, "ai", "a", T[3]), ("5", S, "?", "a", T[4])]
    m = spark.createDataFrame(rows, "id string, session_id string, role string, content string, created_at timestamp")
    assert {(r.state, r.messages, r.sessions) for r in conv.path_report(m).collect()} == {("ok", 1, 1), ("unusable", 2, 1), ("orphan", 2, 1)}
    assert dropped(spark, rows) == {S} and conv.path_report(m.limit(0)).count() == 0


def test_pointer_jumping_against_walking(spark):
    random.seed(5)
    parent = {i: random.choice([None, i - 1, random.randrange(i)]) if i else None for i in range(400)}
    parent |= {1000: 1001, 1001: 1002, 1002: 1000, 1003: 1000, 2000: 99999, 2001: 2000}
    df = spark.createDataFrame(list(parent.items()), "node bigint, parent bigint")

    def walk(i):
        seen, d = set(), 0
        while True:
            if i in seen:
                return "cycle", None, None
            seen.add(i)
            p = parent[i]
            if p is None:
                return "ok", i, d
            if p not in parent:
                return "orphan", p, d + 1
            i, d = p, d + 1

    for r in conv.resolve_paths(df).collect():
        state, root, depth = walk(r.node)
        assert r.state == state, r
        if state != "cycle":
            assert (r.root, r.depth) == (root, depth), r


def test_one_session_over_many_partitions(spark):
    rows = [(f"{i:05d}", S, "user" if i % 2 == 0 else "assistant", "x", datetime(2024, 1, 1 + i // 1440, i // 60 % 24, i % 60)) for i in range(3000)]
    assert dropped(spark, rows) == set()
    m = spark.createDataFrame(rows, "id string, session_id string, role string, content string, created_at timestamp")
    assert [r.id for r in conv.ordered_conversations(m).orderBy("place").collect()] == [r[0] for r in rows]


# lines


def test_repeated_lines(spark):
    page = lambda i, extra: (i, "f", i, f"© Acme  LLC {i}!\r\nBody {chr(97 + i) * 3}\n---\n{extra}")
    rows = [page(i, "Page 1 of 9" if i < 4 else "p") for i in range(6)] + [(10, "f", 0, "© acme llc 7\n"), (11, None, 1, "© Acme LLC"), (12, "f", None, None), (13, "f", 3, "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, source_file string, page int, page_content string, h1 string")
    got = {(r.page_id, r.line_no) for r in lines.repeated_lines(df).collect()}
    assert got == {(i, 1) for i in range(6)} | {(10, 1)}
    clean = {r.page_id: (r.clean, r.n_removed) for r in lines.without_repeated_lines(df).collect()}
    assert clean[0][0].startswith("Body aaa\n---") and clean[0][1] == 1 and clean[12] == (None, 0) and len(clean) == len(rows)
    assert lines.repeated_lines(df.limit(0)).count() == 0


def test_a_fifth_of_the_pages(spark):
    df = spark.createDataFrame([(i, "f", i, "same line" if i < 5 else f"other {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(26)], "page_id bigint, source_file string, page int, page_content string")
    assert lines.repeated_lines(df).count() == 0
    assert lines.repeated_lines(df.filter("page_id < 25")).count() == 5


# tokens


TEXTS = ["", None, " ", "\n\n  \t", "Hello world", "don't I'll WE'VE", "naïve café — “quoted”…", "日本語とEnglish混在 👍🏽👨‍👩‍👧", "x" * 3000, "1234567890 ½ ²", "<|endoftext|>", "a b c\x85d\x1ce", "﻿​", "Ā ā Ă ą", "\\x \\u20 &quot", "    indented\n\tcode();", "ab" * 400 + "é" * 50]


def test_ids_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokenize.VOCABULARY.replace(".tiktoken", ".json"))
    lib.encode_special_tokens = True
    random.seed(3)
    texts = TEXTS + ["".join(random.choice("abcdeé ßü\n'.,0189ñ中 ") for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, i, i, i) for i, t in enumerate([*texts, "Hello world"])], "doc_id int, text string, ranks int, known int, pieces int")
    enc = tokenize.encode(df)
    for r in enc.collect():
        assert r.ids == lib.encode(r.text or "", add_special_tokens=False).ids, repr(r.text)
    assert tokenize.decode(enc, out="back").filter("back <> coalesce(text, '')").count() == 0
    assert [r.ids for r in tokenize.encode(df, size=1).orderBy("doc_id").collect()] == [r.ids for r in enc.orderBy("doc_id").collect()]
    assert tokenize.encode(df.limit(0)).count() == 0


# mixing


def test_plan_reaches_targets_and_respects_repeats():
    w, budget, a = mixing.plan({"a": 1000, "b": 100, "c": 0}, {"a": 0.5, "b": 0.5, "c": 0.2}, {"a": 1, "b": 2, "c": 3})
    assert a == 1.0 and w == {"a": 0.5, "b": 0.5} and budget == 400
    w, budget, a = mixing.plan({"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 2}, budget=1000)
    assert 0 < a < 1 and abs(w["b"] * budget - 200) < 1e-3
    w, budget, a = mixing.plan({"a": 10, "b": 10}, {"a": 0.9, "b": 0.1}, {"a": 1, "b": 5}, budget=10**9)
    assert budget == 60 and w["a"] * budget <= 10.001
    assert mixing.plan({}, {}, {}) == ({}, 0.0, 1.0)
    w, budget, t = mixing.plan({"a": 1000, "b": 100, "c": 10}, {"a": 0.4, "b": 0.3, "c": 0.3}, {"a": 1, "b": 1, "c": 2}, target_entropy=0.9)
    assert 0 < t < 1 and abs(mixing.entropy(w) - 0.9) < 1e-6 and abs(w["c"] * budget - 20) < 1e-6
    w, budget, t = mixing.plan({"a": 1000, "b": 100, "c": 10}, {"a": 0.4, "b": 0.3, "c": 0.3}, {"a": 1, "b": 1, "c": 2}, budget=900, target_entropy=0.9)
    assert abs(sum(w.values()) - 1) < 1e-9 and w["c"] * budget <= 20.001 and w["b"] * budget <= 100.001


def test_temperature_meets_entropy():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    w, t = mixing.temperature_weights(shares, 1.0)
    assert abs(mixing.entropy(w) - 1.0) < 1e-6 and 0 < t < 1


def test_mix(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None, i % 5 * 10) for i in range(3000)] + [(5000 + i, "tiny", 7) for i in range(4)], "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("none", 0.1, 2), ("tiny", 0.001, 5), (None, 0.5, 1), ("c", None, 2)], "source string, target_share double, max_repeats int")
    rows, shares = mixing.mix(docs, targets)
    got = {r.source: r for r in shares.collect()}
    total = 0.6 + 0.3 + 0.001
    for s, p in (("a", 0.6), ("b", 0.3)):
        assert abs(got[s].reached_share - p / total) < 0.003 and got[s].most_copies <= {"a": 1, "b": 3}[s]
    assert got["none"].tokens == 0 and got["c"].tokens == 0
    assert rows.filter("copies < 1 OR n_tokens = 0 OR source IS NULL OR source = 'c'").count() == 0
    assert rows.count() == rows.select("doc_id").distinct().count()
    rows, shares = mixing.mix(docs, targets, epochs=0.9)
    exponents = {r.exponent for r in shares.collect()}
    assert len(exponents) == 1 and 0 < exponents.pop() < 1
    assert rows.join(targets, "source").filter("copies > max_repeats").count() == 0
    empty_rows, empty_shares = mixing.mix(docs.limit(0), targets)
    assert empty_rows.count() == 0 and empty_shares.count() == 5


# residue

RESIDUE = [
    "Dear {{ client_name }}, the fee is due.", "The [INSERT PARTY NAME] shall pay.", "paid to <<Betrag>> at once", "Rent of ____________ is payable on the first.", "Notices go to [●] by mail.", "XXXXXX AGREEMENT", "up to «importe» a year", "the #GOVERNING_LAW# of",
    "owed by %NAME_OF_SUPPLIER% today", "the @@lugar@@ rose", "on ${START_DATE} at", "{% if_party %} pays", "see [TBD] below", "fill <AMOUNT> here", "made on the ____ day of May, 20__",
    "404 Page not found\nThe file you asked for was moved or has been removed.", "<noscript>Please enable JavaScript to continue</noscript>", "Lorem ipsum dolor sit amet magna aliqua", "abc abc abc abc abc abc", "Bitte aktivieren Sie JavaScript, um fortzufahren.\nWird geladen …",
    "SAMPLE DOCUMENT 3 - for demonstration, no content.", '{"status": 503, "error": "Acceso denegado", "trace": "c23b"}', "Accès refusé. Réessayer. (404/47b7)", "asdf jkl asdf jklö", "Paragraph 1\n………………\nParagraph 2\n……",
    "signed on XX/XX/20XX by both", "dated DD.MM.YYYY in Oslo", "Who {0} title to it?", "owned by __RAISON_SOCIALE__ at once", "The [insert " + "a long description of the services to be rendered and of the place " * 3 + "] is due.", "it%(name)s pays", "for%%NAME%% it", "qwertz uiop zuio",
    "This server refused your request because your session has expired.\nPlease log in again.", "Sorry, the website is unavailable at the moment. Come back later.", "Cookies must be allowed and scripts are required in this browser.", "Die Verbindung zum Server ist fehlgeschlagen. Bitte versuchen Sie es später.",
]
SOUND = [
    None, "", " \n", "​", "Signed for Acme Ltd.: ______________________", "Portions marked [***] were left out at the request of Acme Ltd.", "See Annex <B> where the deviation is < 0.5% or > 43%.", "Send notices to <desk@acme.example> and quote file #4 [sic] [1].",
    "Authors mark an open field with double braces, like “{{party}}”, and the clerk refuses such filings.", "The portal works without JavaScript; if a user disables scripts, the Seller shall show every notice.", "Any message “access denied” shown to a user counts as downtime under Section 4.",
    "The Borrower shall not use placeholder text or dummy data in the production system.", "Le prêteur veille à ce que la mention « page introuvable » reste rare.", "The rate is 5% and the discount 10%.", "```\n{{ code }}\n```\nThe licence covers the example above.", "The seller shall reload the page where access is denied to the buyer.", "The file moved to the tenant under Section 4 was not found by the lender.", "x " * 3 + "The parties agree. " * 2000 + "End.",
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(RESIDUE + SOUND)], "doc_id int, text string, filler string")  # a clashing name
    got = {r.doc_id: r.residue for r in residue.residue(df).collect()}
    assert [t for i, t in enumerate(RESIDUE) if not got[i]] == []
    assert [t[:60] if t else t for i, t in enumerate(SOUND, len(RESIDUE)) if got[i]] == []
    assert residue.residue(df.limit(0)).count() == 0


# truncation


def test_truncation_holds_out_and_finds_cuts(spark):
    logs = spark.read.parquet(f"{DATA}/audit_logs.parquet").select("id", "action", "detail")
    texts = ["Which law governs the agreem...", "Who owns the dis�", "limited to &qu", "What fee does Acme rec\\u20", "Which law governs the agreement between Acme Inc. and the Lender?", None, "", "  ", "…"]
    more = spark.createDataFrame([(-i, "ask", t) for i, t in enumerate(texts, 1)], "id bigint, action string, detail string")
    both = logs.unionByName(more).withColumns({"vid": F.lit(1), "places": F.lit("x"), "v1": F.lit(2)})
    model = truncation.fit(both, "detail", "action", "id", measure=True)
    assert model.holdout["cuts_found"] > 0.9 and model.holdout["whole_kept"] > 0.9
    out = model.score(both, "detail", "action")
    assert out.columns == [*both.columns, "p_cut"] and out.count() == both.count()
    p = {r.id: r.p_cut for r in out.filter("id < 0").collect()}
    assert all(p[-i] > truncation.THRESHOLD for i in (1, 2, 3, 4)) and p[-5] < truncation.THRESHOLD and [p[-i] for i in (6, 7, 8, 9)] == [0.0] * 4


def test_truncation_keeps_stock_phrases_and_finds_planted_cuts(spark):
    """Recall and precision on values whose truth is known, most of them frequent phrases without a closing mark; the share flagged must not grow."""
    rng = random.Random(11)
    things, firms, roles = "delivery warranties insurance notices records assignment confidentiality royalties".split(), "Mira Tolvan Quessel Brandt Oriel Castor Jove Lindqvist".split(), "Seller Buyer Tenant Agent Carrier Lender".split()
    makers = [
        lambda: f"show me the section on {rng.choice(things)}", lambda: f"what does the contract say about {rng.choice(things)} and {rng.choice(things)}", lambda: f"who signed the {rng.choice(things)} agreement", lambda: f"liability cap {rng.choice(roles)}",
        lambda: f"Which law governs the agreement between {rng.choice(firms)} {rng.choice(firms)} Ltd. and the {rng.choice(roles)}?", lambda: f"The {rng.choice(roles)} shall pay {rng.choice(firms)} Inc. a fee of {rng.randrange(999)} dollars for the {rng.choice(things)} within {rng.randrange(90)} days.",
    ]
    shares = []
    for n, recall in ((2000, 0.7), (9000, 0.85)):
        rows = []
        for i in range(n):
            t = rng.choice(makers)()
            lost = rng.random() < 0.08 and len(t) > 30
            rows.append((i, "a", t[: rng.randrange(8, len(t) - 4)] if lost else t, lost))
        whole = {r[2] for r in rows if not r[3]}
        rows = [(i, g, t, lost and t not in whole) for i, g, t, lost in rows]
        df = spark.createDataFrame(rows, "id bigint, g string, t string, lost boolean")
        got = truncation.truncated_rows(df, "t", "g", "id").select("lost", "truncated").toPandas()
        both = (got.lost & got.truncated).sum()
        assert both / got.lost.sum() > recall and both / got.truncated.sum() > 0.95
        shares.append(got.truncated.mean())
    assert abs(shares[0] - shares[1]) < 0.02


def test_truncation_without_examples(spark):
    df = spark.createDataFrame([], "id int, action string, detail string")
    assert truncation.truncated_rows(df, "detail", "action").count() == 0
    few = spark.createDataFrame([(1, None, "one value"), (2, "a", "cut off…"), (2, "a", "cut off…"), (3, "a", "x" * 100000)], "id int, action string, detail string")
    rows = truncation.truncated_rows(few, "detail", "action")
    assert {(r.id, r.truncated) for r in rows.collect()} == {(1, False), (2, True), (3, False)}
    assert {(r.action, r.records, r.truncated) for r in truncation.truncation_by_group(rows.filter("id < 3"), "id", "action").collect()} == {(None, 1, 0), ("a", 1, 1)}


# pairs


def brute_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_subsequence_against_brute_force(spark):
    random.seed(1)
    rows = [([random.choice("abc") for _ in range(random.randrange(9))], [random.choice("abc") for _ in range(random.randrange(9))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", pairs.common_subsequence(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == brute_lcs(r.a, r.b) for r in df.collect())
    long = [([random.choice("abcd") for _ in range(random.randrange(50, 200))], [random.choice("abcd") for _ in range(random.randrange(50, 200))]) for _ in range(20)]
    df = spark.createDataFrame([*long, (["a"] * 60, ["a"] * 60), (["a"] * 61, ["a"] * 121)], "a array<string>, b array<string>").select("a", "b", pairs.common_subsequence(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == brute_lcs(r.a, r.b) for r in df.collect())
    words = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: i.cast("string")).alias("a"))
    assert words.select(pairs.common_subsequence(F.col("a"), F.reverse("a")).alias("x"), pairs.common_subsequence(F.col("a"), F.col("a")).alias("y")).first() == (1, 3000)


def test_other_language(spark):
    qa = {"en": ("Which law governs the agreement with the Seller?", "The agreement is governed by the law of Norway, and disputes go to the court of the Seller."), "de": ("Welche Frist gilt für den Käufer, wenn die Zahlung ausbleibt?", "Der Käufer muss innerhalb von zehn Tagen nach der Mitteilung handeln, wenn nicht anders vereinbart ist."), "fr": ("Que peut faire le vendeur si le paiement reste en retard ?", "Il peut suspendre les livraisons, à condition de prévenir par écrit dans les dix jours."), "es": ("¿Qué puede hacer el vendedor si el pago sigue pendiente?", "Podrá suspender las entregas, siempre que lo comunique antes por escrito."), "it": ("Entro quale termine il fornitore deve comunicare ogni cambio?", "Il fornitore deve comunicare ogni cambio entro dieci giorni dopo la consegna della merce.")}
    langs = list(qa)
    rows = [(i, qa[lang][0], qa[lang][1], False) for i, lang in enumerate(langs * 30)]
    rows += [(1000 + i, qa[a][0], qa[b][1], True) for i, (a, b) in enumerate((a, b) for a in langs for b in langs if a != b)]
    rows += [(2000, qa["de"][0], "Norway Shipping Inc.", False), (2001, qa["de"][0], "EUR 88,000", False), (2002, None, qa["fr"][1], False), (2003, qa["fr"][0], None, False), (2004, "1 2 3", qa["fr"][1], False), (2005, qa["en"][0], qa["de"][1].upper(), True)]
    df = spark.createDataFrame(rows, "id bigint, q string, a string, other boolean")
    got = {r.id for r in pairs.defects(df, "q", "a", F.lit(False)).filter("defect = 'other_language'").collect()}
    assert got == {r[0] for r in rows if r[3]}


def test_copies_and_refusals(spark):
    q = "Which law governs the agreement between Acme Ltd. and the Seller?"
    cases = {q: True, f"“{q.lower()[:-1]}”": True, f"Q: {q}": True, q.upper() + "\n": True, f"You asked: {q} The law of Fethlumburg.": False, f"{q} No": False, "The law of Fethlumburg": False, "": False, None: False}
    df = spark.createDataFrame([(q, a) for a in cases], "q string, a string").select("a", pairs.is_copy(F.col("q"), F.col("a")).alias("x"))
    assert {r.a: r.x for r in df.collect()} == cases
    yes = ["I cannot help with this request.", "Sorry – no answer can be given here.", "As an assistant for contracts, I must decline to answer.", "Leider liegt mir dazu keine Angabe vor, daher muss ich passen.", "Por desgracia, no puedo responder a esta pregunta.", "Désolé, aucune réponse ne peut être donnée ici.", "Purtroppo non posso rispondere a questa domanda."]
    yes += ["Thank you. You ask about the lease of 2012. I looked it up. Sadly I am not able to answer that question.", "It is not possible for me to answer this."]
    no = ["No", None, "", "No assignment can be given without consent.", "The Seller is not able to assign it. " + "Title stays with the Seller until the price is paid in full. " * 20 + "I can not answer this question further.", "No, an assignment is valid only with the prior written consent of Acme.", "The other party cannot refuse on that ground.", "The Seller may decline the offer."]
    df = spark.createDataFrame([(a,) for a in yes + no], "a string").select("a", pairs.is_refusal(F.col("a")).alias("x"))
    assert {r.a for r in df.collect() if r.x} == set(yes)


def test_defects_with_nulls_and_empty(spark):
    rows = [(1, "What is due?", None, "fact", "c"), (2, None, "I cannot help with this request.", None, "c"), (3, "q", "I cannot help with this request.", "GUARD RAIL", "c"), (4, None, None, None, None), (5, "What is due?", " N/A ", "x", "c")]
    df = spark.createDataFrame(rows, "id int, q string, a string, intent string, defect string")
    out = pairs.defects(df, "q", "a", pairs.labelled_intent(F.col("intent")) == "guardrail")
    assert {r.id: r.defect for r in out.collect()} == {1: "empty", 2: "refusal", 3: None, 4: "empty", 5: "empty"}
    assert pairs.defects(df.limit(0), "q", "a", F.lit(False)).count() == 0
