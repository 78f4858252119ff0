"""Texts that lost their end (problem 1, and the truncated answers of problem 5).

Intact values are cut artificially to make positives; a hashed logistic regression over closing characters, punctuation, the
distance to a length limit and how often texts go on or end after such words then scores every different value once.

What goes on and what ends is counted over all records, not over a sample: for every word, under it and the one and two words
before it, under the last four and six words with names masked, and from the sentence's start, how often a text goes on there and how
often a sentence or text ends. Phrases that come back whole so tell themselves from cuts that come back. The counts are combined on the map side, kept by the hash of their key, and joined to the ends
that ask for them; a record's own share is taken off again (and a cut's, from the record it was cut from). All of these enter as
proportions in classes, so the share of records flagged does not depend on the amount of data.

Only the fit is bounded: it uses values that stand for SAMPLE records, spread over groups. Values as long as a limit of their group and without
a closing mark are not taken for intact. Cuts lie anywhere in a value, within its last four characters, and at the group's own limits (a value is
repeated until it is long enough); a part of them gets what systems put in place of a lost end. No value is judged by an earlier fit.

Defined results: null, empty, blank texts and those without a letter or digit are never truncated; with fewer than 20 intact values
to learn from only a stand-in for the lost end counts (an ellipsis, half a character, escape or entity); repeated rows score
alike; texts of any length are counted and scored in whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.tokenize import fresh, let
from vellum.session import cut

#: Records the model is fitted on, about.
SAMPLE = 12000
#: Artificial cuts per value: within the last four characters, at a limit of the group, and anywhere.
CUTS = 5
#: Places of the weights.
WIDTH = 1 << 15
#: Weight of an artificial cut against a whole value: cut records are rarer than whole ones.
PRIOR = 0.4
#: How many times more values than at the lengths beside it make a length a limit.
LIMIT_EXCESS = 5
#: Beginnings of words are counted up to this length.
STEM = 32
THRESHOLD = 0.3
FEWEST = 20

_BOUNDARY = r"(?<!\b(?:Inc|Corp|Ltd|S\.A|B\.V|S\.r\.l|Nr|No|Art|vgl|bzw|z\.B|Mr|Dr|EX-\d\d|EX-\d))(?<=[.!?…])[\"”»)]*\s+|\n+"
#: What may stand in place of a lost end: an ellipsis, half a character, half an escape or half an entity.
_ELLIPSIS = r"(?:…|\.\.\.|\[(?:\.{2,3}|…)\]|\x{FFFD}|\\[ux][0-9A-Fa-f]{0,3}|&#?[A-Za-z0-9]{0,6})[\s\"”»)\]]*$"
#: The same, as they are put at the end of artificial cuts.
STAND_INS = ("…", "...", " [...]", "�", "\\u20", "&am")
_SAYS = r"[\p{L}\p{N}]"
_CLOSED = r"[.!?。？！][\s\"”’»)\]]*$"
_TOKEN = r"[\p{L}\p{M}]+|0|[^\s\p{Z}\p{L}\p{M}\p{N}]"
KINDS = ("w1", "w2", "w3", "m4", "m6", "start", "stem", "len")
_SEEN = 8  # words a key looks back over


def _bare(text: Column) -> Column:
    """text without closing marks and without a stand-in for the rest; a comma or an opening mark stays. Runs of digits become 0."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _ELLIPSIS, ""), r"[\s\p{Z}.!?。？！\"”’»)\]]+$", ""), r"\p{N}+", "0")


def _words(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(_TOKEN), F.lit(0))


def _keys(window: list[Column]) -> dict[str, Column]:
    """The keys of a place: window holds the word there and those before it, the last first ("^" before the start)."""
    low = [F.lower(w) for w in window]
    mask = [F.when(a == b, a).otherwise("N") for a, b in zip(low, window, strict=True)]
    h = lambda kind, cols: F.xxhash64(F.lit(kind), *cols)
    return {"w1": h("w1", low[:1]), "w2": h("w2", low[:2]), "w3": h("w3", low[:3]), "m4": h("m4", mask[:4]), "m6": h("m6", mask[:6]), "start": F.when(low[-1] == "^", h("start", low))}


def _places(values: DataFrame) -> DataFrame:
    """key, goes, ends: a row for each place and kind of key of the values' sentences; ends: 1 where a sentence or text ends."""
    s = values.select((F.col("times") + 1).alias("rows"), F.explode(F.split("t", _BOUNDARY)).alias("s")).filter(F.col("s").rlike(_SAYS))
    s = s.select("rows", F.concat(F.array(*[F.lit("^")] * (_SEEN - 1)), _words(_bare(F.col("s")))).alias("a"))
    n = F.size("a") - (_SEEN - 1)
    shifted = [F.slice("a", F.lit(_SEEN - k), n).alias(f"a{k}") for k in range(_SEEN)]
    last = F.concat(F.array_repeat(F.lit(0), n - 1), F.array(F.lit(1))).alias("last")
    p = s.select("rows", F.explode(F.arrays_zip(*shifted, last)).alias("z"))
    keys = _keys([F.col(f"z.a{k}") for k in range(_SEEN)])
    weighed = [F.struct(v.alias("key"), F.col("rows").alias("n")) for k, v in keys.items()]
    p = p.select(F.explode(F.array(*weighed)).alias("k"), F.col("z.last").alias("last")).filter("k.key IS NOT NULL")
    return p.groupBy("k.key").agg(F.sum("k.n").alias("n"), F.sum(F.col("k.n") * F.col("last")).alias("ends")).filter("n > 1")


def _stems(values: DataFrame) -> DataFrame:
    """key, n: in how many places a longer word begins with the stem; ends: in how many the stem is the word."""
    words = values.select((F.col("times") + 1).alias("rows"), F.explode(_words(F.regexp_replace(F.lower("t"), r"\p{N}+", "0"))).alias("w")).filter(F.col("w").rlike(r"^\p{L}"))
    words = words.groupBy("w").agg(F.sum("rows").alias("n"))
    lengths = F.sequence(F.lit(1), F.least(F.length("w"), F.lit(STEM)))
    stems = words.select("w", "n", F.explode(lengths).alias("k"))
    stems = stems.groupBy(F.xxhash64(F.lit("stem"), F.left("w", F.col("k"))).alias("key")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k") == F.length("w"), F.col("n")).otherwise(0)).alias("ends"))
    return stems.filter("n > 1")


def _lengths(values: DataFrame) -> DataFrame:
    """g, len, n, around: different values of a length, and of the four lengths on either side, by group."""
    sizes = values.groupBy("g", F.length("t").alias("len")).agg(F.count(F.lit(1)).alias("n"))  # a row a group and length
    near = Window.partitionBy("g").orderBy("len").rangeBetween(-4, 4)
    return sizes.withColumn("around", F.sum("n").over(near) - F.col("n"))


def _is_limit(n: Column, around: Column) -> Column:
    return n >= LIMIT_EXCESS * (around / 8 + 1)


def _length_key(group: Column, text: Column) -> Column:
    return F.xxhash64(F.lit("len"), group, F.length(text))


def _asked(text: Column, group: Column) -> Column:
    """The keys of a text's end, in the order of KINDS."""

    def build(a: Column) -> Column:
        window = [F.coalesce(F.try_element_at(a, F.lit(-1 - k)), F.lit("^")) for k in range(_SEEN)]
        keys = _keys(window)
        stem = F.when(F.length(window[0]) <= STEM, F.xxhash64(F.lit("stem"), F.lower(window[0])))
        return F.array(*[keys[k] for k in KINDS[:6]], stem, _length_key(group, text))

    last = F.coalesce(F.try_element_at(F.filter(F.split(F.regexp_replace(text, _ELLIPSIS, ""), _BOUNDARY), lambda s: s.rlike(_SAYS)), F.lit(-1)), F.lit(""))
    return let(_words(_bare(last)), F.array().cast("array<bigint>"), build)


def _share(x: Column) -> Column:
    """The class of the share of places where a text ends."""
    r = x["ends"] / x["n"]
    return F.when(x["n"] <= 0, "-").when(r <= 0, "0").when(r < 0.02, "1").when(r < 0.05, "2").when(r < 0.1, "3").when(r < 0.2, "4").when(r < 0.4, "5").when(r < 0.7, "6").when(r < 0.95, "7").otherwise("8")


def _class(n: Column, most: int = 5) -> Column:
    return F.least(F.floor(F.log2(F.greatest(n, F.lit(0)) + 1)), F.lit(most)).cast("string")


def _features(e: DataFrame) -> DataFrame:
    """e with places (array<int>): e has t, g and a struct a kind with n and ends."""
    t = F.regexp_replace("t", r"[\s\p{Z}]+$", "")
    e = e.withColumns(
        {
            "closing": F.when(F.col("t").rlike(_ELLIPSIS), "stand-in").otherwise(F.regexp_extract(F.right(t, F.lit(5)), r"([^\p{L}\p{M}\p{N}]{0,4})$", 1)),
            "low": F.regexp_replace(F.right(F.lower(t), F.lit(4)), r"\p{N}", "0"),
            "letter": F.regexp_extract(F.right(t, F.lit(9)), r"([\p{L}\p{N}])[^\p{L}\p{N}]*$", 1),
            "unpaired": F.concat(*[F.when(F.length(F.replace("t", F.lit(a), F.lit(""))) < F.length(F.replace("t", F.lit(b), F.lit(""))), "1").otherwise("0") for a, b in ("()", "“”", "[]", "«»", "{}")]),
            "blank": F.when(F.length(t) < F.length("t"), "b").otherwise("n"),
        }
    )
    letter = F.col("letter")
    e = e.withColumn("shape", F.when(letter == "", "-").when(letter.rlike(r"\p{N}"), "0").when(letter != F.lower(letter), "U").otherwise("l"))
    s = {k: _share(F.col(k)) for k in KINDS[:6]}
    e = e.select("*", *[v.alias("s_" + k) for k, v in s.items()], *[_class(F.col(k)["n"]).alias("n_" + k) for k in KINDS[:7]])
    limit = F.when(_is_limit(F.col("len")["ends"], F.col("len")["n"]), "y").otherwise("n")
    stem = F.when(F.col("stem")["n"] <= 0, "-").when(F.col("stem")["ends"] <= 0, "0").otherwise(_share(F.col("stem")))
    e = e.withColumns({"limit": limit, "s_stem": stem, "marked": F.when(F.col("closing").rlike(r"[.!?]"), "y").when(F.col("closing") == "", "n").otherwise("o")})
    c = lambda tag, *cols: F.concat_ws("|", F.lit(tag), *cols)
    kinds = KINDS[:6]
    lists = [c(k, "s_" + k, "n_" + k) for k in kinds] + [c("c" + k, "s_" + k, "closing") for k in kinds] + [c("g" + k, "s_" + k, "g", "marked") for k in kinds]
    lists += [
        c("46", "s_m4", "s_m6", "marked"), c("12", "s_w1", "s_w2", "marked"), c("23", "s_w2", "s_w3", "marked"), c("26", "s_w2", "s_m6", "marked"), c("34", "s_w3", "s_m4", "marked"), c("s6", "s_start", "s_m6", "marked"),
        c("e", "s_stem", "n_stem", "shape"), c("e1", "s_stem", "s_w1", "n_w1", "marked"), c("e2", "s_stem", "s_w2", "marked"), c("em", "s_stem", "s_m4", "shape", "marked"), c("ec", "s_stem", "closing"),
        c("gc", "g", "closing", "shape"), c("k", "closing", "shape", "n_w1"), c("u", "unpaired", "marked"), c("u1", "unpaired", "s_w2"),
        c("l", "limit", "closing"), c("l2", "limit", "s_w2", "marked"), c("l6", "limit", "s_m6", "marked"), c("gl", "g", "low"), c("lo", "low", "marked"), c("b", "blank", "s_w2", "marked"), c("b6", "blank", "s_m6", "marked"), c("cl", "closing"), c("bias"),
    ]
    return e.withColumn("places", F.array(*[F.pmod(F.xxhash64(x), F.lit(WIDTH)).cast("int") for x in lists]))


def _fit_weights(places: np.ndarray, label: np.ndarray, mass: np.ndarray, start: np.ndarray, rounds: int = 120, step: float = 0.1, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by full-batch Adam; places: a row an example, of equal length; mass: weight of each example; start: where to begin."""
    w, mean, square = start.copy(), np.zeros(WIDTH), np.zeros(WIDTH)
    flat, k, all_ = places.ravel(), places.shape[1], mass.sum()
    mass = mass / all_
    for r in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[places].sum(axis=1), -30, 30)))
        g = np.bincount(flat, weights=np.repeat((p - label) * mass, k), minlength=WIDTH) + ridge / all_ * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= step * (1 - r / (rounds + 1)) * (mean / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.999**r)) + 1e-9)
    return w


def _cuts(picked: DataFrame) -> DataFrame:
    """t, g, kind (0 whole, 1 cut, 2 whole without its mark), own (what its own record adds to the counts there: n and ends), mass (in the fit)."""
    t, size = F.col("t"), F.length("t")
    place = lambda j: F.pmod(F.xxhash64(F.lit(j), "t"), F.greatest(size - 1, F.lit(1))) + 1
    near = F.greatest(size - 1 - F.pmod(F.xxhash64(F.lit("end"), "t"), F.lit(4)), F.lit(1))
    limit = F.get("limits", F.pmod(F.xxhash64(F.lit("limit"), "t"), F.size("limits")).cast("int"))
    spaced = F.concat(t, F.lit(" "))
    long = F.repeat(spaced, F.coalesce((limit / (size + 1)).cast("int") + 2, F.lit(1)))
    rows = []
    for j in range(CUTS):
        at, whole = (near.cast("int"), t) if j == 0 else (limit.cast("int"), long) if j == 1 else (place(j).cast("int"), t)
        head, rest = F.left(whole, at), F.substring(whole, at + 1, F.lit(9))
        # a cut within a number leaves a number, which nothing tells from a whole one
        fair = head.rlike(_SAYS) & ~(head.rlike(r"\p{N}$") & rest.rlike(r"^\p{N}")) & (rest.rlike(_SAYS) if j != 1 else F.lit(True)) & ~head.rlike(_CLOSED)
        mid = head.rlike(r"[\p{L}\p{M}\p{N}]$") & rest.rlike(r"^[\p{L}\p{M}\p{N}]")
        stand_in = F.get(F.array(*map(F.lit, STAND_INS)), F.pmod(F.xxhash64(F.lit("in"), "t"), F.lit(len(STAND_INS))).cast("int")) if j == CUTS - 1 else F.lit("")
        one = F.when(mid, 0).otherwise(1)
        rows.append(F.when(fair, F.struct(F.concat(head, stand_in).alias("t"), F.lit(1).alias("kind"), one.alias("n"), F.lit(0).alias("ends"))))
    rows.append(F.struct(t.alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("n"), F.lit(1).alias("ends")))
    bare = F.regexp_replace(t, r"[\s.!?]+$", "")
    rows.append(F.when(t.rlike(_CLOSED) & bare.rlike(_SAYS), F.struct(bare.alias("t"), F.lit(2).alias("kind"), F.lit(1).alias("n"), F.lit(1).alias("ends"))))
    rows = picked.select("g", "mass", F.explode(F.array_compact(F.array(*rows))).alias("e"))
    return rows.select("g", (F.col("mass") * F.when(F.col("e.kind") == 1, PRIOR).otherwise(1.0)).alias("mass"), "e.*")


def _sample(values: DataFrame, size: int) -> DataFrame:
    """Values standing for about size records, half of them in proportion and half the same number per group. A value is picked by a
    hash of its text, with a chance that grows with its records, and mass makes up for what chance cannot hold."""
    records = F.col("times") + 1
    counts = values.groupBy("g").agg(F.sum(records).alias("in_group"))
    whole = counts.agg(F.struct(F.count(F.lit(1)).alias("groups"), F.sum("in_group").alias("records")).alias("w")).scalar()
    picked = values.join(counts.withColumn("_w", whole), "g")
    rate = F.least(size / 2 * (1 / F.col("in_group") / F.col("_w.groups") + 1 / F.col("_w.records")), F.lit(1.0))
    due = records * rate
    place = F.pmod(F.xxhash64(F.lit("sample"), "t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return picked.filter(place < due).withColumn("mass", F.greatest(due, F.lit(1.0)))


@dataclass
class TruncationModel:
    """scores: value (two hashes) and p_cut of every different value that says anything."""

    scores: DataFrame
    weights: np.ndarray
    holdout: dict[str, float] | None

    def score(self, df: DataFrame, text: str, group: str | None = None, out: str = "p_cut") -> DataFrame:
        """df, whose values the model has seen, with out: the probability that text lost its end."""
        v1, v2, p = fresh(df, "v1"), fresh(df, "v2"), fresh(df, "p")
        held = df.select("*", *[h.alias(n) for h, n in zip(_identity(F.col(text), _group(group)), (v1, v2), strict=True)])
        known = self.scores.select(F.col("v1").alias(v1), F.col("v2").alias(v2), F.col("p_cut").alias(p))
        return held.join(known, [v1, v2], "left").select(*[c for c in df.columns if c != out], F.coalesce(p, F.lit(0.0)).alias(out))


def _group(group: str | None) -> Column:
    return F.coalesce(F.col(group).cast("string"), F.lit("?")) if group else F.lit("all")


def _identity(text: Column, group: Column) -> tuple[Column, Column]:
    says = text.rlike(_SAYS)
    return F.when(says, F.xxhash64(F.lit(1), text, group)), F.when(says, F.xxhash64(F.lit(2), group, text))


def fit(df: DataFrame, text: str, group: str | None = None, id: str | None = None, sample: int = SAMPLE, measure: bool = False) -> TruncationModel:
    """Count over the values of df, fit on intact ones and artificial cuts of them, and score every value. id: records of
    one value and one id count once. measure: also hold a tenth of the sample out and report on it."""
    spark = df.sparkSession
    key = F.xxhash64(id) if id else F.monotonically_increasing_id()
    base = df.select(F.col(text).alias("t"), _group(group).alias("g"), key.alias("k")).filter(F.col("t").rlike(_SAYS))
    values = base.groupBy("g", "t").agg(F.when(F.min("k") == F.max("k"), 0).otherwise(F.count(F.lit(1)) - 1).alias("times"))
    values = cut(values.withColumn("vid", F.monotonically_increasing_id()))

    lengths = cut(_lengths(values))
    limits = lengths.filter(_is_limit(F.col("n"), F.col("around"))).groupBy("g").agg(F.collect_list("len").alias("limits"))
    as_counts = lengths.select(F.xxhash64(F.lit("len"), "g", F.col("len")).alias("key"), F.col("around").alias("n"), F.col("n").alias("ends"))
    counts = _places(values).unionByName(_stems(values)).unionByName(as_counts)

    picked = _sample(values.filter(~F.col("t").rlike(_ELLIPSIS)), sample).join(limits, "g", "left")
    at_limit = F.coalesce(F.array_contains("limits", F.length("t")), F.lit(False))
    made = _cuts(picked.filter(~at_limit | F.col("t").rlike(_CLOSED)))
    made = made.select("g", "t", "kind", "mass", F.struct("n", "ends").alias("own"), (-1 - F.monotonically_increasing_id()).alias("vid"))
    own = F.struct(F.lit(1).alias("n"), F.lit(1).alias("ends"))
    examples = cut(values.select("g", "t", F.lit(-1).alias("kind"), F.lit(0.0).alias("mass"), own.alias("own"), "vid").unionByName(made))

    asked = examples.select("vid", F.posexplode(_asked(F.col("t"), F.col("g"))).alias("at", "key")).filter("key IS NOT NULL")
    found = asked.join(counts, "key").groupBy("vid").agg(*[F.max(F.when(F.col("at") == i, F.struct("n", "ends"))).alias(k) for i, k in enumerate(KINDS)])
    seen = examples.join(found, "vid", "left")
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("ends"))
    less = lambda k: F.when(F.col(k).isNull(), zero).otherwise(F.struct((F.col(k)["n"] - F.col("own")["n"]).alias("n"), (F.col(k)["ends"] - F.col("own")["ends"]).alias("ends")))
    seen = seen.withColumns({k: less(k) for k in KINDS[:6]} | {"stem": F.when(F.col("stem").isNull(), zero).otherwise(F.struct((F.col("stem")["n"] - 1).alias("n"), F.greatest(F.col("stem")["ends"] - F.col("own")["n"], F.lit(0)).alias("ends"))), "len": F.coalesce("len", zero)})
    placed = _features(seen).select("vid", "kind", "mass", "places", *_identity(F.col("t"), F.col("g")), F.pmod(F.xxhash64("t"), F.lit(10)).alias("fold"))
    placed = cut(placed.toDF("vid", "kind", "mass", "places", "v1", "v2", "fold"))

    pdf = placed.filter("kind >= 0").select("kind", "mass", "places", "fold").toPandas()  # SAMPLE * (CUTS + 2) rows of numbers
    start, holdout = _start(spark), None
    w = start
    if (pdf.kind == 0).sum() >= FEWEST and (pdf.kind == 1).any():
        places, y = np.stack(pdf.places.to_numpy()).astype(np.int32), (pdf.kind == 1).to_numpy(float)
        mass = pdf.mass.to_numpy(float)
        if measure:
            train = (pdf.fold != 0).to_numpy()
            p = 1 / (1 + np.exp(-_fit_weights(places[train], y[train], mass[train], start)[places[~train]].sum(axis=1)))
            kind = pdf.kind.to_numpy()[~train]
            holdout = {"cuts_found": float((p >= THRESHOLD)[kind == 1].mean()), "whole_kept": float((p < THRESHOLD)[kind != 1].mean())}
        w = _fit_weights(places, y, mass, start)
    held = placed.filter("kind = -1").select("v1", "v2", "places", spark.createDataFrame([(w.tolist(),)], "w array<double>").scalar().alias("w"))
    z = let(F.col("w"), F.lit(0.0), lambda w: F.aggregate(F.col("places"), F.lit(0.0), lambda a, i: a + F.get(w, i)))
    return TruncationModel(held.select("v1", "v2", (1 / (1 + F.exp(-z))).alias("p_cut")), w, holdout)


def _start(spark) -> np.ndarray:
    """Weights before any example: a stand-in for a lost end speaks for a cut, nothing else does."""
    place = lambda s: F.pmod(F.xxhash64(F.lit(s)), F.lit(WIDTH)).cast("int")
    bias, stand_in = spark.range(1).select(place("bias"), place("cl|stand-in")).first()
    w = np.zeros(WIDTH)
    w[bias], w[stand_in] = -2.0, 6.0
    return w


def truncated_rows(df: DataFrame, text: str, group: str, id: str | None = None, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """df with p_cut and truncated."""
    return fit(df, text, group, id, sample).score(df, text, group).withColumn("truncated", F.col("p_cut") >= threshold)


def truncation_by_group(rows: DataFrame, id: str, group: str) -> DataFrame:
    """Per group: records (distinct ids), truncated ones, and their share."""
    once = rows.groupBy(id).agg(F.min(group).alias(group), F.bool_or("truncated").alias("truncated"))
    return once.groupBy(group).agg(F.count(F.lit(1)).alias("records"), F.count_if("truncated").alias("truncated")).withColumn("share", F.col("truncated") / F.col("records"))
