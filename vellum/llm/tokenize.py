"""Encoding of texts with a public byte-level BPE vocabulary, inside the JVM (problem 6).

A word's bytes are held as a string with one character per byte (ISO-8859-1), so that pieces join by concat and a rank is
one map look-up. The ranks enter the plan as one literal row: an array of small maps, picked by a hash of the piece,
because Spark searches a map from end to end. A word's merges are a fold: each step joins every pair of the lowest
rank, from left to right, until no pair has a rank; the steps left after that do nothing.

Words are folded once and not once per occurrence: all words of the corpus are counted (map-side combined), and those
whose count reaches 1 / dictionary of the total, of which there cannot be more than dictionary, are folded into a second
literal of the same shape. The different words of a document beyond it are folded once per document. Texts are never
shuffled and no word is left out, so the result does not depend on the size of the dictionary.

Defined results: null and empty texts give an empty array; blank text is text; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import cut

#: Where the public vocabularies lie; the environment may name another folder.
VOCABULARY = os.path.join(os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: The published word pattern of the vocabulary, with white space as Unicode has it. Fixed value.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 8192
#: At most so many words of at most so many bytes are sent to the tasks: below 7 MB.
DICTIONARY, DICTIONARY_WORD = 65536, 32
#: Marks around a piece; no byte has these characters.
OPEN, CLOSE = "\u0100", "\u0101"


@cache
def read_ranks(path: str) -> dict[str, int]:
    """Piece (a character per byte) to rank; the rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _bucket(key: Column) -> Column:
    return F.pmod(F.hash(key), F.lit(BUCKETS))


def look_up(buckets: Column, key: Column) -> Column:
    return F.get(buckets, _bucket(key))[key]


def bucketed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row: an array of BUCKETS maps, every key in the map that its hash picks."""
    filled = rows.select(_bucket(F.col(key)).alias("b"), F.struct(key, value).alias("e"))
    blank = rows.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(None).cast(filled.schema["e"].dataType).alias("e"))
    lists = filled.unionByName(blank).groupBy("b").agg(F.collect_list("e").alias("es"))  # nulls are left out
    return lists.agg(F.array_sort(F.collect_list(F.struct("b", "es"))).alias("s")).select(F.transform("s", lambda x: F.map_from_entries(x["es"])).alias("buckets"))


def rank_row(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """The literal rank map: one row, an array of maps from piece (marked by OPEN) to rank."""
    return bucketed(spark.createDataFrame([(OPEN + k, v) for k, v in read_ranks(path).items()], "piece string, rank int"), "piece", "rank")


def byte_string(text: Column) -> Column:
    """The UTF-8 bytes of text as a string with one character per byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def let(value: Column, zero: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound to a variable; zero has the type of the result."""
    return F.aggregate(F.array(value), zero, lambda _, x: body(x))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids of one word: the fold of ranked merges over its bytes.

    The state is a string of marked pieces, OPEN piece CLOSE, and whether it may still change; a merge replaces each adjacent
    pair of the lowest rank, from left to right.
    """
    last = F.lit(2147483647)
    state_of = lambda s, open_: F.struct(s.alias("s"), open_.alias("open"))
    yes, no = F.lit(True), F.lit(False)

    def step(state: Column, _: Column) -> Column:
        return F.when(state["open"], let(F.split(state["s"], CLOSE), state, lambda ps: let(_best(ps), state, lambda best: _merge(state, ps, best)))).otherwise(state)

    def _best(ps: Column) -> Column:
        firsts = F.slice(ps, F.lit(1), F.greatest(F.size(ps) - 2, F.lit(0)))
        return F.array_min(F.transform(firsts, lambda p, i: F.struct(F.coalesce(look_up(ranks, F.concat(p, F.substring(F.get(ps, i + 1), 2, 1 << 30))), last).alias("rank"), i.alias("at"))))

    def _merge(state: Column, ps: Column, best: Column) -> Column:
        a, b = F.get(ps, best["at"]), F.get(ps, best["at"] + 1)
        joined = F.replace(state["s"], F.concat(a, F.lit(CLOSE), b, F.lit(CLOSE)), F.concat(a, F.substring(b, 2, 1 << 30), F.lit(CLOSE)))
        return F.when(F.coalesce(best["rank"], last) == last, state_of(state["s"], no)).otherwise(state_of(joined, yes))

    def ids(state: Column) -> Column:
        return F.transform(F.filter(F.split(state["s"], CLOSE), lambda p: p != ""), lambda p: look_up(ranks, p))

    def fold(bytes_: Column) -> Column:
        start = state_of(F.regexp_replace(bytes_, "(?s)(.)", OPEN + "$1" + CLOSE), yes)
        return ids(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(bytes_) - 1, F.lit(1))), start, step))

    none = F.array().cast("array<int>")
    whole = lambda bytes_: let(look_up(ranks, F.concat(F.lit(OPEN), bytes_)), none, lambda id: F.when(id.isNotNull(), F.array(id)).otherwise(fold(bytes_)))
    return let(byte_string(word), none, whole)


def with_ranks(df: DataFrame, column: str, out: str, body: Callable[[Column, Column], Column], kind: str, path: str) -> DataFrame:
    """df with out = body(column, ranks). The literal is bound once, so that Spark keeps it in the plan and out of the rows."""
    ranks = fresh(df, "ranks")
    held = df.select("*", rank_row(df.sparkSession, path).scalar().alias(ranks))
    return held.select(*df.columns, let(F.col(ranks), F.lit(None).cast(kind), lambda r: body(F.col(column), r)).alias(out))


def dictionary(docs: DataFrame, text: str, size: int = DICTIONARY, path: str = VOCABULARY) -> DataFrame:
    """word and ids of the words that make up 1 / size of all words or more; there are size of them at most."""
    words = cut(docs.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    often = words.filter((F.octet_length("word") <= DICTIONARY_WORD) & (F.col("n") * size >= total.scalar())).select("word")
    return with_ranks(often, "word", "ids", fold_merges, "array<int>", path)


def encode(docs: DataFrame, text: str = "text", out: str = "ids", size: int = DICTIONARY, path: str = VOCABULARY) -> DataFrame:
    """docs with the column out (array<int>): the ids of text without special tokens."""
    spark = docs.sparkSession
    known = bucketed(dictionary(docs, text, size, path), "word", "ids")
    k, r = fresh(docs, "known"), fresh(docs, "ranks")
    held = docs.select("*", known.scalar().alias(k), rank_row(spark, path).scalar().alias(r))
    none = F.array().cast("array<int>")

    def ids(k: Column, r: Column) -> Column:
        return let(words_of(F.col(text)), none, lambda ws: let(F.transform(ws, lambda w: look_up(k, w)), none, lambda found: join(r, ws, found)))

    def join(r: Column, ws: Column, found: Column) -> Column:
        rare = F.array_distinct(F.filter(ws, lambda w, i: F.get(found, i).isNull()))
        folded = let(rare, F.lit(None).cast("map<string,array<int>>"), lambda ws: F.map_from_arrays(ws, F.transform(ws, lambda w: fold_merges(w, r))))
        with_rare = let(folded, none, lambda m: F.flatten(F.transform(ws, lambda w, i: F.coalesce(F.get(found, i), m[w]))))
        return F.when(F.exists(found, lambda x: x.isNull()), with_rare).otherwise(F.flatten(found))

    return held.select(*[c for c in docs.columns if c != out], F.coalesce(let(F.struct(F.col(k).alias("k"), F.col(r).alias("r")), none, lambda h: ids(h["k"], h["r"])), none).alias(out))


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str = VOCABULARY) -> DataFrame:
    """df with the column out: the text of ids, by joining the pieces' bytes; unknown ids give nothing."""
    spark = df.sparkSession
    pieces = spark.createDataFrame([(v, k) for k, v in read_ranks(path).items()], "id int, piece string")
    row = pieces.agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("s")).select(F.col("s.piece").alias("pieces"))
    all_pieces = fresh(df, "pieces")
    held = df.select("*", row.scalar().alias(all_pieces))
    text = let(F.col(all_pieces), F.lit(""), lambda p: F.array_join(F.transform(F.col(ids), lambda i: F.get(p, i)), ""))
    return held.select(*[c for c in df.columns if c != out], F.decode(F.encode(text, "ISO-8859-1"), "UTF-8").alias(out))
