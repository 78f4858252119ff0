"""Defective prompt and response pairs (problem 5).

empty: nothing, or only a stand-in. copy: the response's tokens are nearly all the prompt's, in its order (longest common
subsequence), the prompt is covered nearly whole, and the response ends where the prompt ends, so that nothing was
answered after it; the sequence is computed only where shingle containment and length leave it possible. refusal:
sentences that align with refusal templates (shingle containment, then longest common subsequence of tokens) make up enough of
the response. other_language: the words of the response speak for another language than those of the prompt. truncated: the
model of vellum.llm.truncation.

Word weights for languages are learned here: prompts are told apart by fixed function words first, and every word of the corpus
counts, by its hash, for the language of the prompts whose pairs it stands in; with these weights every prompt and response is judged. Words
seen rarely weigh little, and words that begin with a capital nothing, as names belong to no language.

Defined results: one defect at most, in the order empty, copy, refusal, other_language, truncated; a refusal where it is
due (excused) is no defect of any kind; with a null or empty prompt there is no copy and no other language; rows are judged
one by one, repeated rows alike; a language without function words here is judged by what its words share with the others, which is
mostly nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import truncation
from vellum.llm.conversations import says_nothing
from vellum.llm.tokenize import fresh, let
from vellum.session import cut

#: Share of the response's tokens, and of the prompt's, in the longest common subsequence of a copy.
COPY_SHARE = 0.8
#: Share of the response's shingles of two words that the prompt contains, below which no copy is possible.
SHINGLES = 0.5
#: Places of the language weights, and how many sightings it takes to believe half of what a place says.
WIDTH, DOUBT = 1 << 15, 5.0
#: How much more likely, in nats, a response must be in another language, in all and per word.
MARGIN, MARGIN_PER_WORD = 1.5, 0.25

#: How refusals are worded. Share of a template's shingles and tokens that a sentence must hold, and of the sentence that they
#: must make up; share of a response's tokens in such sentences.
TEMPLATE_SHINGLES, TEMPLATE_TOKENS, OF_SENTENCE, OF_RESPONSE = 0.6, 0.75, 0.3, 0.25
TEMPLATES = [
    "i can not answer this question", "i can not help with this request", "i can not assist with that", "i am unable to answer that question", "i am unable to help you with this", "i am not able to provide an answer to this", "i will not be able to help with that", "i must decline to answer", "i have to decline this request", "i do not have enough information to answer",
    "i can not give legal advice", "i can not provide this information", "i can not comment on that", "i do not know the answer", "this is not something i can answer", "that is not something i can discuss", "this is not something i can comment on", "no answer can be given", "it is not possible to answer this question", "it is not possible for me to say",
    "the documents do not contain enough information to answer", "the context does not provide an answer", "the retrieved passages give no answer", "the documents give me no basis for an answer", "there is nothing in the documents on this", "there is not enough context to answer", "there is nothing in the pages from which i can answer", "i do not have enough context to respond", "there is no information about this in the documents", "this question is outside the scope of what i can answer",
    "ich kann diese frage nicht beantworten", "ich kann dazu nichts sagen", "ich kann dazu keine auskunft geben", "dazu kann ich keine auskunft geben", "diese frage kann ich nicht beantworten", "dabei kann ich nicht helfen", "ich darf dazu keine angaben machen", "dazu liegt mir keine angabe vor", "mir liegen dazu keine angaben vor", "mir liegen dazu keine informationen vor", "die unterlagen enthalten dazu keine angaben", "die unterlagen geben dazu nichts her", "die vorliegenden passagen reichen für eine antwort nicht aus", "eine antwort ist nicht möglich", "daher muss ich passen",
    "je ne peux pas répondre à cette question", "je ne peux pas vous aider", "je ne suis pas en mesure de répondre", "je ne dispose pas des informations nécessaires", "je dois refuser de répondre", "aucune réponse ne peut être donnée", "il ne m est pas possible de répondre", "il n est pas possible de donner une réponse", "les documents ne permettent pas de répondre", "les passages ne contiennent pas de réponse", "les extraits ne donnent aucune réponse",
    "no puedo responder a esta pregunta", "no puedo ayudar con esta solicitud", "no estoy en condiciones de responder", "no me es posible responder", "no es posible responder a esta pregunta", "no dispongo de información suficiente", "debo rechazar esta solicitud", "los documentos no contienen información sobre esto", "los pasajes no permiten responder", "no se puede dar una respuesta", "no es posible dar una respuesta",
    "non posso rispondere a questa domanda", "non posso aiutare con questa richiesta", "non sono in grado di rispondere", "non mi è possibile rispondere", "non è possibile rispondere a questa domanda", "non dispongo di informazioni sufficienti", "devo rifiutare questa richiesta", "i documenti non contengono informazioni al riguardo", "i passaggi non permettono di rispondere", "nessuna risposta può essere data", "non è possibile dare una risposta",
]
#: Short forms and what they stand for, so that wordings compare. Fixed values.
_SHORT_FORMS = [("[’‘`´]", "'"), (r"\bcan(?:no|')t\b", "can not"), (r"\bwon't\b", "will not"), (r"n't\b", " not"), (r"\bi'm\b", "i am"), (r"\b(could|may) not\b", "can not")]

#: Function words that tell the languages apart. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and for to is are which what who how does under with shall must by after once where can up this that from".split(),
    "de": "der die das dem den und für von nicht ist welche welcher wird mit bei nach wann bis was darf hat wenn ein eine zu auf gilt keine".split(),
    "fr": "le les des du pour est dans une quel quelle que peut sous avec par sur aux lorsque si faire envers doit délai jusqu".split(),
    "es": "el los las del una para por qué cuando hasta puede hacer plazo tiene según tras se debe responde si en frente".split(),
    "it": "il gli della dello per che con entro dopo quale fino verso deve vale termine non alla nella sono risponde se".split(),
}
LANGUAGES = list(FUNCTION_WORDS)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; marks and apostrophes part words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


_BITS = 60


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of strings, bit-parallel: a row of the table is kept as the
    bits where it does not grow, _BITS of them a number, and folded per token of a by one addition with carry."""
    full = F.lit((1 << _BITS) - 1)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / _BITS).cast("int")), lambda k: F.slice(b, k * _BITS + 1, F.lit(_BITS)))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    blank = F.array().cast("array<bigint>")

    def row(bs: Column, state: Column, x: Column) -> Column:
        def block(acc: Column, p: Column) -> Column:
            def add(y: Column) -> Column:
                total = p["v"] + y["u"] + acc["carry"]
                kept = p["v"].bitwiseAND(F.bitwise_not(y["m"]))
                return F.struct(F.shiftright(total, _BITS).alias("carry"), F.concat(acc["out"], F.array(total.bitwiseAND(full).bitwiseOR(kept))).alias("out"))

            hits = F.aggregate(F.transform(p["b"], lambda t, i: F.when(t == x, bit(i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, t: s + t)
            return let(F.struct(hits.alias("m"), hits.bitwiseAND(p["v"]).alias("u")), acc, add)

        zero = F.struct(F.lit(0).cast("bigint").alias("carry"), blank.alias("out"))
        return F.aggregate(F.transform(bs, lambda c, i: F.struct(c.alias("b"), F.get(state, i).alias("v"))), zero, block)["out"]

    def count(bs: Column) -> Column:
        start = F.transform(bs, lambda _: full)
        unset = F.transform(F.aggregate(a, start, lambda state, x: row(bs, state, x)), lambda v: _BITS - F.bit_count(v))
        return F.aggregate(unset, F.lit(0), lambda s, n: s + n)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(let(blocks, F.lit(0), count))


def _pairs_of(ws: Column) -> Column:
    return F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1)))


def is_copy(prompt: Column, response: Column, share: float = COPY_SHARE) -> Column:
    """Whether response only gives prompt back."""

    def judge(x: Column) -> Column:
        q, a = x["q"], x["a"]
        held = F.size(F.array_intersect(_pairs_of(a), _pairs_of(q))) / F.greatest(F.size(F.array_distinct(_pairs_of(a))), F.lit(1))
        fits = (F.size(q) > 0) & (F.size(a) >= share * F.size(q)) & (F.size(a) <= F.size(q) / share + 2) & (held >= SHINGLES)
        ends = F.array_contains(F.slice(q, F.greatest(F.size(q) - 2, F.lit(1)), F.lit(3)), F.element_at(a, -1))
        return F.when(fits & F.coalesce(ends, F.lit(False)), let(common_subsequence(q, a), F.lit(False), lambda n: (n >= share * F.size(q)) & (n >= share * F.size(a)))).otherwise(F.lit(False))

    return F.coalesce(let(F.struct(tokens(prompt).alias("q"), tokens(response).alias("a")), F.lit(False), judge), F.lit(False))


def _template_row() -> Column:
    """The templates, each with its tokens and shingles."""
    words = [t.split() for t in TEMPLATES]
    lit = lambda ws: F.array(*map(F.lit, ws))
    return F.array(*[F.struct(lit(ws).alias("ws"), lit([f"{x} {y}" for x, y in zip(ws, ws[1:], strict=False)]).alias("shingles")) for ws in words])


def is_refusal(response: Column) -> Column:
    """Whether sentences that align with a refusal template make up enough of response."""
    plain = F.lower(response)
    for short, long in _SHORT_FORMS:
        plain = F.regexp_replace(plain, short, long)
    all_shingles = sorted({f"{x} {y}" for t in TEMPLATES for x, y in zip(t.split(), t.split()[1:], strict=False)})

    def aligned(x: Column) -> Column:
        def fits(t: Column) -> Column:
            held = F.size(F.array_intersect(t["shingles"], x["shingles"])) >= TEMPLATE_SHINGLES * F.size(t["shingles"])
            return F.when(held, let(common_subsequence(t["ws"], x["ws"]), F.lit(False), lambda n: (n >= TEMPLATE_TOKENS * F.size(t["ws"])) & (n >= OF_SENTENCE * F.size(x["ws"])))).otherwise(F.lit(False))

        # a fixed set is kept hashed between rows, which an array is not
        return F.when(F.size(F.filter(x["shingles"], lambda s: s.isin(*all_shingles))) >= 2, F.exists(_template_row(), fits)).otherwise(F.lit(False))

    def share(ss: Column) -> Column:
        sizes = F.transform(ss, lambda x: F.struct(F.size(x["ws"]).alias("n"), F.when(aligned(x), F.size(x["ws"])).otherwise(0).alias("hit")))
        sums = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("hit")), lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), (s["hit"] + x["hit"]).alias("hit")))
        return let(sums, F.lit(False), lambda s: (s["hit"] > 0) & (s["hit"] >= OF_RESPONSE * s["n"]))

    sentences = F.transform(F.split(plain, r"(?<=[.!?])\s+|\n+"), lambda s: let(tokens(s), F.lit(None).cast("struct<ws:array<string>,shingles:array<string>>"), lambda ws: F.struct(ws.alias("ws"), _pairs_of(ws).alias("shingles"))))
    return F.coalesce(let(sentences, F.lit(False), share), F.lit(False))


def _seeded_language(prompt: Column) -> Column:
    """The language most of whose function words stand in prompt; null without any or with a tie."""

    def best(ws: Column) -> Column:
        n = lambda lang: F.size(F.filter(ws, lambda w: w.isin(*FUNCTION_WORDS[lang])))
        return let(F.array(*[n(lang) for lang in LANGUAGES]), F.lit(None).cast("string"), top)

    def top(c: Column) -> Column:
        most = F.array_max(c)
        one = F.size(F.filter(c, lambda x: x == most)) == 1
        return F.when((most > 0) & one, F.get(F.array(*map(F.lit, LANGUAGES)), (F.array_position(c, most) - 1).cast("int")))

    return let(tokens(prompt), F.lit(None).cast("string"), best)


def _plain_words(text: Column) -> Column:
    """The words of text that do not begin with a capital, as names belong to no language; in a sentence without lower case, all."""
    shown = F.when((F.upper(text) == text) & text.rlike(r"(?:\p{L}+\P{L}+){3}\p{L}"), F.lower(text)).otherwise(text)
    return F.filter(F.split(shown, r"[^\p{L}\p{M}\p{N}]+"), lambda w: (F.length(w) > 1) & w.rlike(r"^[\p{L}&&[^\p{Lu}]]"))


def _place(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(WIDTH)).cast("int")


def language_weights(pairs: DataFrame, prompt: str, response: str) -> DataFrame:
    """One row: WIDTH arrays of the log-likelihood under each of LANGUAGES of the words with that hash."""
    both = F.concat(_plain_words(F.col(prompt)), F.coalesce(_plain_words(F.col(response)), F.array().cast("array<string>")))
    words = pairs.select(_seeded_language(F.col(prompt)).alias("lang"), F.explode(both).alias("word")).filter("lang IS NOT NULL")
    counts = words.groupBy(_place(F.col("word")).alias("place")).agg(*[F.count_if(F.col("lang") == lang).alias(lang) for lang in LANGUAGES])
    blank = pairs.sparkSession.range(WIDTH).select(F.col("id").cast("int").alias("place"), *[F.lit(0).cast("bigint").alias(lang) for lang in LANGUAGES])
    counts = counts.unionByName(blank).groupBy("place").agg(*[F.sum(lang).alias(lang) for lang in LANGUAGES])
    row = counts.agg(F.array_sort(F.collect_list(F.struct("place", *LANGUAGES))).alias("s"), F.struct(*[(F.sum(lang) + 1).alias(lang) for lang in LANGUAGES]).alias("t"))  # WIDTH entries
    all_ = sum((F.col(f"t.{lang}") for lang in LANGUAGES), F.lit(0))
    rate = lambda x, lang: x[lang] / F.col(f"t.{lang}") + DOUBT / all_
    return row.select(F.transform("s", lambda x: let(F.array(*[rate(x, lang) for lang in LANGUAGES]), F.array().cast("array<double>"), _logs)).alias("logs"))


def _logs(rates: Column) -> Column:
    return let(F.aggregate(rates, F.lit(0.0), lambda s, r: s + r), F.array().cast("array<double>"), lambda total: F.transform(rates, lambda r: F.log(r / total)))


def _speaks(text: Column, weights: Column) -> Column:
    """struct of s (sum of log-likelihoods by language) and n (words)."""

    def sums(ws: Column) -> Column:
        logs = F.transform(ws, lambda w: F.get(weights, _place(w)))
        zero = F.array(*[F.lit(0.0)] * len(LANGUAGES))
        return F.struct(F.aggregate(logs, zero, lambda a, x: F.zip_with(a, x, lambda s, t: s + t)).alias("s"), F.size(logs).alias("n"))

    none = F.lit(None).cast("struct<s:array<double>,n:int>")
    return let(_plain_words(text), none, sums)


def _other_language(prompt: Column, response: Column, weights: Column) -> Column:
    """Whether response speaks for another language than prompt does."""

    def judge(x: Column) -> Column:
        best = F.array_max(x["q"]["s"])
        clear = F.size(F.filter(x["q"]["s"], lambda v: best - v < MARGIN)) == 1
        own = F.get(x["a"]["s"], (F.array_position(x["q"]["s"], best) - 1).cast("int"))
        return clear & (x["a"]["n"] > 0) & (F.array_max(x["a"]["s"]) - own > F.greatest(F.lit(MARGIN), MARGIN_PER_WORD * x["a"]["n"]))

    return F.coalesce(let(F.struct(_speaks(prompt, weights).alias("q"), _speaks(response, weights).alias("a")), F.lit(False), judge), F.lit(False))


def defects(pairs: DataFrame, prompt: str, response: str, excused: Column, group: str | None = None) -> DataFrame:
    """pairs with defect (null: none). excused: whether a refusal is the right response. group: what the model of lost ends tells apart."""
    weights = cut(language_weights(pairs, prompt, response))
    cut_model = truncation.fit(pairs, response, group)
    p_cut, lang_weights, refuses, other = (fresh(pairs, n) for n in ("p_cut", "lang_weights", "refuses", "other"))
    scored = cut_model.score(pairs, response, group, out=p_cut)
    held = scored.select("*", weights.scalar().alias(lang_weights), is_refusal(F.col(response)).alias(refuses))
    elsewhere = let(F.col(lang_weights), F.lit(False), lambda w: _other_language(F.col(prompt), F.col(response), w))
    held = held.select(*scored.columns, refuses, elsewhere.alias(other))
    defect = (
        F.when(says_nothing(F.col(response)), "empty")
        .when(is_copy(F.col(prompt), F.col(response)), "copy")
        .when(F.col(refuses) & F.coalesce(excused, F.lit(False)), F.lit(None).cast("string"))
        .when(F.col(refuses), "refusal")
        .when(F.col(other), "other_language")
        .when(F.col(p_cut) >= truncation.THRESHOLD, "truncated")
    )
    return held.select(*[c for c in pairs.columns if c != "defect"], defect.alias("defect"))


def labelled_intent(intent: Column) -> Column:
    """An intent's label without regard to case, spaces and punctuation."""
    return F.lower(F.regexp_replace(intent, r"[^\p{L}]", ""))
