"""Rates with bootstrap intervals, agreement, lengths, perplexity and training logs.

A bootstrap of 0/1 flags depends on their number and sum only, so intervals are
computed from counts: resample r adds up, over all positions j, whether a seeded
draw of (r, j) falls on a true flag. The digest of (r, j) is the same for all groups,
so those of like size are drawn together, and long resamples in parts of EXACT_N
positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import importable

#: Positions of a resample that are drawn at once.
EXACT_N = 1 << 14
RESAMPLES = 1000
#: Over which the resamples of all groups are dealt.
TASKS = 32


def digests(seed: int, r: int, lo: int, hi: int) -> np.ndarray:
    """What seeded.draw takes modulo n, for positions lo to hi - 1 of resample r."""
    head = f"{seed}:{r}:".encode()
    made = b"".join([md5(head + b"%d" % j, usedforsecurity=False).digest() for j in range(lo, hi)])
    return np.frombuffer(made, ">u4")[::4].astype(np.uint32)


def part_sums(drawn: np.ndarray, lo: int, cases: list[tuple[int, int, int]]) -> list[int]:
    """Of each case (n, up, down): the sum of a resample over the positions drawn, from lo on; up values are 1, down are -1."""
    places: dict[int, np.ndarray] = {}
    out = []
    for n, up, down in cases:
        if n not in places:
            here = drawn[: max(0, n - lo)]
            places[n] = here % np.uint32(n) if n < 1 << 32 else here
        at = places[n]
        out.append(int(np.count_nonzero(at < up) - np.count_nonzero((at >= up) & (at < up + down))) if down else int(np.count_nonzero(at < up)))
    return out


def resampled(cases: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(n, up, down, m): means of all resamples of n values, of which `up` are 1, `down` are -1 and the rest 0."""
    importable(cases.sparkSession)
    like = cases.groupBy(F.length(F.bin("n")).alias("like")).agg(F.collect_list(F.struct("n", "up", "down")).alias("cases"), F.max("n").alias("most"))
    rounds = like.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    parts = rounds.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1, F.lit(EXACT_N).cast("long"))))
    step = EXACT_N

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                wanted = [(c["n"], c["up"], c["down"]) for c in x["cases"] if c["n"] > x["lo"]]
                drawn = digests(seed, x["r"], x["lo"], min(x["lo"] + step, x["most"]))
                rows += [(*c, x["r"], s) for c, s in zip(wanted, part_sums(drawn, x["lo"], wanted))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["n", "up", "down", "r", "s"])

    sums = parts.repartition(TASKS, "like", "r", "lo").mapInArrow(run, "n long, up long, down long, r long, s long")
    return sums.groupBy("n", "up", "down", "r").agg((F.sum("s") / F.col("n")).alias("m"))


def with_interval(counts: DataFrame, up: str, down: str, resamples: int, seed: int, level: float = 95.0) -> DataFrame:
    """Adds ci_lo and ci_hi, null if n is 0; groups with the same counts share them."""
    tail = (100 - level) / 200
    key = [F.col(c).cast("long").alias(name) for c, name in (("n", "n"), (up, "up"), (down, "down"))]
    made = resampled(counts.select(*key).where("n > 0").distinct(), resamples, seed)
    ends = made.groupBy("n", "up", "down").agg(F.percentile("m", tail).alias("ci_lo"), F.percentile("m", 1 - tail).alias("ci_hi"))
    ends = ends.select(F.struct("n", "up", "down").alias("_case"), "ci_lo", "ci_hi")
    return counts.withColumn("_case", F.struct(*key)).join(ends, "_case", "left").drop("_case")


def rates(flags: DataFrame, keys: list[str], flag: str = "passed", resamples: int = RESAMPLES, seed: int = 0, every: DataFrame | None = None) -> DataFrame:
    """(keys, k, n, rate, ci_lo, ci_hi); keys of `every` without flags get n = 0 and nulls."""
    counts = flags.groupBy(*keys).agg(F.count_if(flag).alias("k"), F.count(flag).alias("n"))
    if every is not None:
        counts = every.select(*keys).distinct().join(counts, keys, "left").na.fill(0, ["k", "n"])
    made = with_interval(counts.withColumn("_none", F.lit(0).cast("long")), "k", "_none", resamples, seed)
    return made.select(*keys, "k", "n", F.try_divide("k", "n").alias("rate"), "ci_lo", "ci_hi")


def paired_differences(pairs: DataFrame, keys: list[str], a: str, b: str, resamples: int = RESAMPLES, seed: int = 0, every: DataFrame | None = None) -> DataFrame:
    """(keys, n, a_correct, b_correct, diff, ci_lo, ci_hi) of mean(b) - mean(a), resampling rows with both flags."""
    counts = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(a).alias("a_correct"),
        F.count_if(b).alias("b_correct"),
        F.count_if(F.col(b) & ~F.col(a)).alias("_up"),
        F.count_if(F.col(a) & ~F.col(b)).alias("_down"),
    )
    if every is not None:
        counts = every.select(*keys).distinct().join(counts, keys, "left").na.fill(0)
    diff = F.try_divide(F.col("_up") - F.col("_down"), F.col("n"))
    return with_interval(counts, "_up", "_down", resamples, seed).select(*keys, "n", "a_correct", "b_correct", diff.alias("diff"), "ci_lo", "ci_hi")


def agreement(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, n, exact_match, cohens_kappa); kappa is null where chance agreement is certain."""
    cells = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("c"))
    by = lambda col: cells.groupBy(*keys, F.col(col).alias("_class")).agg(F.sum("c").alias(f"_{col}"))
    same = lambda left, right: [left[k].eqNullSafe(right[k]) for k in keys]
    totals = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("_same"))
    margins = by(a).join(by(b), [*keys, "_class"]).groupBy(*keys).agg(F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias("_chance"))
    joined = totals.join(margins, keys, "left") if keys else totals.crossJoin(margins)
    chance = F.coalesce("_chance", F.lit(0))
    kappa = F.when(chance != F.col("n") * F.col("n"), (F.col("_same") / F.col("n") - chance / (F.col("n") * F.col("n"))) / (1 - chance / (F.col("n") * F.col("n"))))
    return joined.select(*keys, "n", (F.col("_same") / F.col("n")).alias("exact_match"), kappa.alias("cohens_kappa"))


def perplexity(nll: Column, tokens: Column) -> Column:
    """exp of the mean over all tokens, null without tokens; an aggregate."""
    return F.exp(F.try_divide(F.sum(nll), F.sum(tokens)))


def answer_nll(tokens: DataFrame, keys: list[str], first_answer: str = "n_prompt") -> DataFrame:
    """(keys, nll, n_tokens) from (keys, pos, logp, n_prompt): tokens from n_prompt on."""
    counted = F.col("pos") >= F.col(first_answer)
    return tokens.groupBy(*keys).agg(F.coalesce(F.sum(F.when(counted, -F.col("logp"))), F.lit(0.0)).alias("nll"), F.count_if(counted).alias("n_tokens"))


def histogram_bins(short: int, limit: int) -> list[tuple[int, int | None]]:
    """Bins [lo, hi) between fixed edges, and one from the limit on. They may overlap if short is large."""
    edges = (0, short, 50, 100, 200, limit)  # fixed values but for short and limit
    return [(lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo] + [(limit, None)]


def length_stats(rows: DataFrame, keys: list[str], value: str = "new_tokens", short: int = 20, limit: int = 384) -> DataFrame:
    """Count, mean, percentiles, extremes, how many are short or at the limit, and bins `lo-hi` and `>=limit`."""
    v = F.col(value)
    percentiles = [F.percentile(v, p / 100).alias("median" if p == 50 else f"p{p}") for p in (10, 25, 50, 75, 90)]
    bins = [F.count_if((v >= lo) & (v < hi) if hi is not None else v >= lo).alias(f"bin_{lo}_{hi if hi is not None else 'up'}") for lo, hi in histogram_bins(short, limit)]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), *percentiles, F.min(v).alias("least"), F.max(v).alias("most"),
        F.count_if(v >= limit).alias("at_limit"), F.count_if(v < short).alias("short"), *bins,
    )


def trajectory(log: DataFrame, columns: list[str]) -> DataFrame:
    """Entries with a loss, in the given columns."""
    return log.where(F.col("loss").isNotNull()).select("step", *columns)


def change(log: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, first, last, delta) of the values present by step; null with fewer than two."""
    v = F.col(column)
    ends = log.where(v.isNotNull()).groupBy(*keys).agg(F.min_by(v, "step").alias("a"), F.max_by(v, "step").alias("b"), F.count("*").alias("c"))
    some = lambda x: F.when(F.col("c") >= 2, x)
    return ends.select(*keys, some(F.col("a")).alias("first"), some(F.col("b")).alias("last"), some(F.col("b") - F.col("a")).alias("delta"))


def truncation_counts(rows: DataFrame, most: int, given: int) -> DataFrame:
    """Completions that the length limit cuts, from prompt_ids, chosen_ids and rejected_ids."""
    cut = lambda side: F.count_if(F.size("prompt_ids") + F.size(f"{side}_ids") > most)
    return rows.agg(F.count("*").alias("pairs"), cut("chosen").alias("chosen_truncated"), cut("rejected").alias("rejected_truncated"), (F.lit(given) - F.count("*")).alias("dropped_prompt_too_long"))


def completion_sums(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, logp, n, per_token) from (keys, logp, mask): masked sums; per token divides by one at least."""
    sums = tokens.groupBy(*keys).agg(F.sum(F.col("logp") * F.col("mask")).alias("logp"), F.sum("mask").alias("n"))
    return sums.withColumn("per_token", F.col("logp") / F.greatest(F.col("n"), F.lit(1)))


def reward_metrics(logps: DataFrame, keys: list[str], beta: float = 0.1) -> DataFrame:
    """Means over pairs of rewards, margin, accuracy (strict wins) and loss, from policy and reference log-probabilities."""
    reward = lambda side: beta * (F.col(f"policy_{side}") - F.col(f"reference_{side}"))
    made = logps.withColumn("chosen_reward", reward("chosen")).withColumn("rejected_reward", reward("rejected")).withColumn("margin", F.col("chosen_reward") - F.col("rejected_reward"))
    loss = F.greatest(-F.col("margin"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("margin")))
    return made.groupBy(*keys).agg(F.avg("chosen_reward").alias("chosen_reward"), F.avg("rejected_reward").alias("rejected_reward"), F.avg("margin").alias("margin"), F.avg((F.col("margin") > 0).cast("int")).alias("accuracy"), F.avg(loss).alias("loss"))
