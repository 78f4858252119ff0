"""Mixing sources to target weights (problem 7).

Weights come from temperature mixing along the line between the natural shares q and the targets p: w(a) ~ q**(1-a) * p**a.
a = 1 gives the targets themselves; where a fixed budget would repeat a source more often than it may be, a is bisected down
to the largest value that fits. Without a budget, the budget is the largest that the targets and the limits on repetition
allow, so that a = 1 always fits. With a target entropy the weights are the plain form, q**t with t bisected to it. These
numbers are one per source; sources are bounded by the target table.

The weights are realised source by source as budgeted block permutations: whole passes over the source, then a part of a
pass in the order of a seeded hash. That order is cut into BLOCKS ranges of the hash per source; sums per block are
combined on the map side and prefix sums run over blocks, so that only the one block that the budget ends in is ordered
row by row, a BLOCKS-th of its source.

Defined results: sources without a target, null sources and targets without tokens give no rows; the remaining targets are
scaled to sum to one; documents without tokens (null or empty text) are not used; repeated doc_ids are separate
documents; a null, negative or zero target or limit gives the source nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the permutation's hash per source.
BLOCKS = 4096


def normalise(w: dict[str, float]) -> dict[str, float]:
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else {}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def temperature_weights(shares: dict[str, float], target_entropy: float, rounds: int = 60) -> tuple[dict[str, float], float]:
    """(shares ** t, scaled to one, t) with t in [0, 8] bisected to target_entropy (the nearest that can be had)."""
    shares = {k: v for k, v in shares.items() if v > 0}
    lo, hi = 0.0, 8.0  # entropy falls as t grows
    for _ in range(rounds):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if entropy(normalise({k: v**t for k, v in shares.items()})) > target_entropy else (lo, t)
    return normalise({k: v**lo for k, v in shares.items()}), lo


def _filled(want: dict[str, float], most: dict[str, float], budget: float) -> dict[str, float]:
    """want, but what is full gives the rest of its share to the others in proportion."""
    full: dict[str, float] = {}
    rest = dict(want)
    while over := [k for k in rest if rest[k] / sum(rest.values()) * (budget - sum(full.values())) > most[k]]:
        full |= {k: float(most[k]) for k in over}
        rest = {k: v for k, v in rest.items() if k not in full}
    left = budget - sum(full.values())
    return {k: full[k] / budget if k in full else rest[k] / sum(rest.values()) * left / budget for k in want}


def plan(tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int], budget: float | None = None, target_entropy: float | None = None, rounds: int = 60) -> tuple[dict[str, float], float, float]:
    """(weights, budget in tokens, exponent) for the sources that have tokens, a target and a limit above zero."""
    use = [k for k in target if tokens.get(k, 0) > 0 and (target[k] or 0) > 0 and (repeats.get(k) or 0) > 0]
    p, q = normalise({k: float(target[k]) for k in use}), normalise({k: float(tokens[k]) for k in use})
    if not use:
        return {}, 0.0, 1.0
    most = {k: float(tokens[k] * repeats[k]) for k in use}
    fits = lambda w, total: all(w[k] * total <= most[k] * (1 + 1e-12) for k in use)
    if target_entropy is not None:
        w, t = temperature_weights(q, target_entropy, rounds)
        total = min(min(most[k] / w[k] for k in use) if budget is None else budget, sum(most.values()))
        return (w if fits(w, total) else _filled(w, most, total)), total, t
    if budget is None:
        budget = min(most[k] / p[k] for k in use)
    budget = min(budget, sum(most.values()))
    weights = lambda a: normalise({k: q[k] ** (1 - a) * p[k] ** a for k in use})
    if fits(weights(1.0), budget):
        return weights(1.0), budget, 1.0
    if not fits(weights(0.0), budget):  # even natural shares repeat some source too often
        return _filled(p, most, budget), budget, 0.0
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        a = (lo + hi) / 2
        lo, hi = (a, hi) if fits(weights(a), budget) else (lo, a)
    return weights(lo), budget, lo


def quotas(sums: DataFrame, targets: DataFrame, budget: float | None = None, epochs: float | None = None, target_entropy: float | None = None) -> DataFrame:
    """A row per target source: source, target_share, weight, exponent, due (size wanted), passes (whole ones) and part (of one more).

    sums: source and tokens. budget: the size of the mix; or epochs: as many times the size of all usable sources.
    """
    limits = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    known = limits.join(sums, "source", "left").collect()  # one row a target
    tokens, target = {r.source: r.tokens or 0 for r in known}, {r.source: r.target_share or 0.0 for r in known}
    repeats = {r.source: r.max_repeats or 0 for r in known}
    if epochs is not None:
        budget = epochs * sum(tokens[k] for k in tokens if target[k] > 0 and repeats[k] > 0)
    weights, total, exponent = plan(tokens, target, repeats, budget, target_entropy)
    wanted = []
    for r in known:
        due = round(weights.get(r.source, 0.0) * total)
        passes = min(due // r.tokens, r.max_repeats) if due else 0
        part = due - passes * r.tokens if due and passes < r.max_repeats else 0
        wanted.append((r.source, float(r.target_share or 0.0), float(weights.get(r.source, 0.0)), float(exponent), int(due), int(passes), int(part)))
    return targets.sparkSession.createDataFrame(wanted, "source string, target_share double, weight double, exponent double, due bigint, passes bigint, part bigint")


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, epochs: float | None = None, target_entropy: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, shares). rows: doc_id, source, n_tokens, copies (how often the document is used).

    docs: doc_id, source, n_tokens; read more than once, so pass a written table. targets: source, target_share,
    max_repeats (one row a source; of several the first by share and limit). shares: what each target source got.
    """
    docs = docs.select("doc_id", "source", "n_tokens").filter((F.col("n_tokens") > 0) & F.col("source").isNotNull())
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    quota = quotas(sums, targets, budget, epochs, target_entropy)

    order = F.xxhash64(F.lit(seed), "source", "doc_id")
    d = docs.join(quota.drop("target_share", "weight", "exponent", "due"), "source").filter("passes + part > 0")
    d = d.withColumn("order", order).withColumn("block", F.shiftright(F.col("order"), 64 - int(math.log2(BLOCKS))))
    blocks = d.filter("part > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("part").alias("limit"))
    before = F.coalesce(F.sum("in_block").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).select("source", "block", "before", (F.col("before") + F.col("in_block") <= F.col("limit")).alias("whole"), "limit")
    edge = blocks.filter("NOT whole AND before < limit").select("source", "block", "before")
    whole = blocks.filter("whole").select("source", "block", F.lit(True).alias("taken"))
    w = Window.partitionBy("source", "block").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(whole, ["source", "block"], "left").join(edge, ["source", "block"], "left")
    at_edge = d.filter("before IS NOT NULL").withColumn("upto", F.col("before") + F.sum("n_tokens").over(w))
    at_edge = at_edge.withColumn("taken", F.col("upto") - F.col("n_tokens") / 2 <= F.col("part")).drop("upto")
    d = d.filter("before IS NULL").unionByName(at_edge)
    copies = F.col("passes") + F.when(F.coalesce("taken", F.lit(False)), 1).otherwise(0)
    rows = d.select("doc_id", "source", "n_tokens", copies.cast("bigint").alias("copies")).filter("copies > 0")
    got = rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("uses"), F.count(F.lit(1)).alias("docs"), F.max("copies").alias("most_copies"))
    shares = quota.join(got, "source", "left").select(
        "source", "target_share", "weight", "exponent", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
    whole_mix = shares.agg(F.sum("tokens").alias("t"))
    return rows, shares.withColumn("reached_share", F.col("tokens") / F.nullif(whole_mix.scalar(), F.lit(0)))
