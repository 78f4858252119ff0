"""Which document a passage came from: containment at the longest prefix, found by hashes of windows (never pair by pair)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import normal_space
from vellum.session import cut

#: Prefix lengths tried in turn, the shortest prefix that counts, and the probe and shortest probe of a paragraph. Fixed values.
PREFIXES, SHORTEST, PARAGRAPH, SHORTEST_PARAGRAPH = (400, 250, 150, 80), 40, 200, 30
#: Needles that are looked for in one pass over the texts: what is sent to the tasks is bounded by it, at PREFIXES[0] characters each.
NEEDLES = 65536
#: Windows are hashed at the longest of these lengths that a needle has; every needle has one.
ANCHORS = (64, 40, 20, 10, 5, 2, 1)
#: Characters of texts that a task hashes at once.
CHARACTERS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _window_hashes(text: np.ndarray, size: int, powers: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """A hash of every window of size characters, by differences of one running sum (all modulo 2**64)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * powers[: len(text)], dtype=np.uint64)])
    return (sums[size:] - sums[:-size]) * inverses[: len(text) - size + 1]


def _finder(needles: list[str], prefixes: tuple[int, ...]):
    """A function over Arrow batches (doc, text) that gives needle (its number), doc and prefix of each hit: the longest of prefixes of
    the needle that stands there. A needle is hit where its shortest prefix stands, cut as it may be."""
    least = min(prefixes)
    run_of = lambda base, n: np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)
    code = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    powers, inverses, by_size = run_of(_BASE, ANCHORS[0]), run_of(_INVERSE, ANCHORS[0]), {}
    for i, n in enumerate(needles):
        size = next(a for a in ANCHORS if a <= min(len(n), least))
        by_size.setdefault(size, []).append((int(_window_hashes(code(n[:size]), size, powers, inverses)[0]), i))
    tables = {size: (np.array([h for h, _ in sorted(rows)], np.uint64), [i for _, i in sorted(rows)]) for size, rows in by_size.items()}

    def search(text: str, starts: np.ndarray, hits: dict, powers: np.ndarray, inverses: np.ndarray) -> None:
        chars = code(text)
        for size, (hashes, numbers) in tables.items():
            if len(chars) < size:
                continue
            found = _window_hashes(chars, size, powers, inverses)
            lo = np.searchsorted(hashes, found)
            places = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == found)
            for at in places:
                j = lo[at]
                while j < len(hashes) and hashes[j] == found[at]:
                    n = needles[numbers[j]]
                    if text.startswith(n[:least], at):
                        key = (numbers[j], int(np.searchsorted(starts, at, "right")) - 1)
                        hits[key] = max(hits.get(key, 0), max(p for p in prefixes if text.startswith(n[:p], at)))
                    j += 1

    def run(batches):
        ways = run_of(_BASE, CHARACTERS * 2), run_of(_INVERSE, CHARACTERS * 2)
        for batch in batches:
            texts, lo = batch.column(1).to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHARACTERS):
                    size += len(texts[hi]) + 1
                    hi += 1
                hits: dict = {}
                if size <= CHARACTERS * 2:
                    search("\0".join(texts[lo:hi]), np.cumsum([0] + [len(t) + 1 for t in texts[lo : hi - 1]]), hits, *ways)
                else:  # one long text, in pieces that overlap by the longest prefix
                    for start in range(0, len(texts[lo]), CHARACTERS):
                        search(texts[lo][start : start + CHARACTERS + max(prefixes)], np.array([0]), hits, *ways)
                if hits:
                    rows = list(hits.items())
                    docs = batch.column(0).take(pa.array([lo + d for (_, d), _ in rows]))
                    yield pa.RecordBatch.from_arrays([pa.array([n for (n, _), _ in rows], pa.int32()), docs, pa.array([p for _, p in rows], pa.int32())], names=["needle", "doc", "prefix"])
                lo = hi

    return run


def containing(probes: DataFrame, probe: str, corpus: DataFrame, doc: str, text: str, prefixes: tuple[int, ...] = (PREFIXES[0],)) -> DataFrame:
    """probe key, doc and prefix, for each probe whose needle, cut to the shortest of prefixes, stands in a document's normalised text;
    prefix: the longest that stands in it.

    probes: columns of the key named by probe, and needle (normalised, not empty; no longer than the longest prefix). Several rows of one
    doc count as one. Needles go in blocks of NEEDLES; the texts are read once a block and never shuffled.
    """
    spark = probes.sparkSession
    wanted = cut(probes.filter("needle <> ''").select(probe, F.substring("needle", 1, max(prefixes)).alias("needle")))
    blocks = max(1, -(-wanted.count() // NEEDLES))
    texts = corpus.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), normal_space(F.col(text)).alias("text"))
    kind = dict(texts.dtypes)["doc"]
    out = spark.createDataFrame([], f"{probe} {dict(wanted.dtypes)[probe]}, doc {kind}, prefix int")
    for b in range(blocks):
        pdf = wanted.filter(F.pmod(F.xxhash64("needle", probe), F.lit(blocks)) == b).toPandas()  # NEEDLES, about
        if len(pdf):
            found = texts.mapInArrow(_finder(pdf.needle.tolist(), prefixes), f"needle int, doc {kind}, prefix int")
            keys = spark.createDataFrame(pdf[[probe]].assign(needle=range(len(pdf))), f"{probe} {dict(wanted.dtypes)[probe]}, needle int")
            out = out.unionByName(found.join(keys, "needle").select(probe, "doc", "prefix"))
    return out.groupBy(probe, "doc").agg(F.max("prefix").alias("prefix")).withColumnRenamed("doc", doc)


def provenance(passages: DataFrame, key: str, passage: str, corpus: DataFrame, doc: str, text: str) -> DataFrame:
    """key, doc, prefix, n_docs and reason of each passage: the documents that hold its longest prefix of PREFIXES.

    reason: matched (doc is the only one), ambiguous (the first by doc of n_docs), no_match, no_reference_contexts (null or empty).
    A prefix under SHORTEST characters as cut is not tried. A passage that runs over the end of a row's text is found only up to there.
    """
    base = passages.select(key, normal_space(F.col(passage)).alias("_p"))
    needles = base.filter(F.length(F.substring("_p", 1, PREFIXES[-1])) >= SHORTEST).select(key, F.substring("_p", 1, PREFIXES[0]).alias("needle"))
    hits = containing(needles, key, corpus, doc, text, PREFIXES)
    best = hits.groupBy(key, "prefix").agg(F.min(doc).alias(doc), F.count(F.lit(1)).alias("n_docs")).groupBy(key).agg(F.max(F.struct("prefix", doc, "n_docs")).alias("b"))
    out = base.join(best, key, "left")
    reason = F.when(F.coalesce(F.col("_p"), F.lit("")) == "", "no_reference_contexts").when(F.col("b").isNull(), "no_match").when(F.col("b.n_docs") > 1, "ambiguous").otherwise("matched")
    return out.select(key, F.col(f"b.{doc}").alias(doc), F.col("b.prefix").alias("prefix"), F.coalesce("b.n_docs", F.lit(0)).alias("n_docs"), reason.alias("reason"))


def paragraph_votes(passages: DataFrame, key: str, passage: str, corpus: DataFrame, doc: str, text: str) -> DataFrame:
    """key, doc and votes: the documents that hold most of a passage's paragraphs, by their first PARAGRAPH characters; all with the most votes.

    Paragraphs part at blank lines; those of fewer than SHORTEST_PARAGRAPH characters do not vote, repeated ones vote each time.
    """
    paragraphs = passages.select(key, F.posexplode(F.split(passage, "\n\n")).alias("at", "p")).select(key, F.substring(normal_space(F.col("p")), 1, PARAGRAPH).alias("needle"))
    paragraphs = paragraphs.filter(F.length("needle") >= SHORTEST_PARAGRAPH).groupBy(key, "needle").agg(F.count(F.lit(1)).alias("times"))
    ballots = cut(paragraphs.withColumn("ballot", F.monotonically_increasing_id()))
    hits = containing(ballots.select("ballot", "needle"), "ballot", corpus, doc, text, (PARAGRAPH,))
    votes = hits.join(ballots.select("ballot", key, "times"), "ballot").groupBy(key, doc).agg(F.sum("times").alias("votes"))
    return votes.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("votes")))).filter("_r = 1").drop("_r")
