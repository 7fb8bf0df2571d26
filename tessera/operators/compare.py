"""Systems compared on the same prompts: per system, and pairwise on subsets.

scores has system, index, text, new_tokens, stopped, overall, failed, the rules as
structs, and rouge_l.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rules, text


def with_clean(scores: DataFrame, limit: int) -> DataFrame:
    """clean: stopped, and before the limit."""
    return scores.withColumn("clean", F.col("stopped") & (F.col("new_tokens") < limit))


def by_system(scores: DataFrame, limit: int) -> DataFrame:
    """One row for each system: counts k of n, means, and for each rule k of the n it applies to."""
    applied = lambda r: F.col(r)["applies"]
    per_rule = [c for r in rules.RULES for c in (F.count_if(applied(r) & F.col(r)["passed"]).alias(f"{r}_k"), F.count_if(applied(r)).alias(f"{r}_n"))]
    return with_clean(scores, limit).groupBy("system").agg(
        F.count("*").alias("n"),
        F.avg(text.word_count(F.col("text"))).alias("words_mean"),
        F.count_if("stopped").alias("stopped"),
        F.count_if("clean").alias("stopped_cleanly"),
        F.avg("rouge_l").alias("rouge_l_mean"),
        F.count_if("overall").alias("overall"),
        F.count_if(F.col("clean") & F.col("overall")).alias("overall_when_stopped"),
        *per_rule,
    )


def short_examples(scores: DataFrame, short: int, n: int) -> DataFrame:
    """(system, examples): the first n short answers in row order. Each of 64 parts of a system keeps n, then the system does."""
    first = lambda df, *keys: df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("index"))).where(F.col("_place") <= n)
    found = scores.where(F.col("new_tokens") < short).select("system", "index", "new_tokens", "text", F.pmod("index", F.lit(64)).alias("_part"))
    kept = first(first(found, "system", "_part"), "system")
    return kept.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("index", "new_tokens", "text"))).alias("examples"))


def side_by_side(scores: DataFrame, pairs: list[tuple[str, str]], limit: int) -> DataFrame:
    """One row for each pair of systems and index that both answered, with columns a_* and b_*.

    The answers to a prompt meet once, whatever the number of pairs, so scores are computed once.
    """
    columns = ("new_tokens", "clean", "overall", "rouge_l", "failed")
    systems = sorted({s for p in pairs for s in p})
    answer = F.struct(*columns)
    met = with_clean(scores, limit).groupBy("index").agg(*[F.max(F.when(F.col("system") == s, answer)).alias(f"_{i}") for i, s in enumerate(systems)])
    entry = lambda a, b: F.struct(F.lit(f"{a}->{b}").alias("pair"), F.col(f"_{systems.index(a)}").alias("a"), F.col(f"_{systems.index(b)}").alias("b"))
    every = met.select("index", F.explode(F.array(*[entry(a, b) for a, b in pairs])).alias("p")).where(F.col("p.a").isNotNull() & F.col("p.b").isNotNull())
    return every.select("p.pair", "index", *[F.col(f"p.{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in columns])


def pair_subsets(scores: DataFrame, pairs: list[tuple[str, str]], limit: int = 384, short: int = 20) -> DataFrame:
    """(pair, subset, n, means and overall counts of both sides, median length ratio where both stopped)."""
    subsets: dict[str, Column] = {
        "both_stopped": F.col("a_clean") & F.col("b_clean"),
        "a_did_not_stop": ~F.col("a_clean"),
        "b_short": F.col("b_new_tokens") < short,
        "a_stopped": F.col("a_clean"),
    }
    both = side_by_side(scores, pairs, limit)
    tagged = both.withColumn("subset", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))))
    made = tagged.groupBy("pair", "subset").agg(
        F.count("*").alias("n"),
        *[F.avg(f"{s}_{v}").alias(f"{s}_{v}") for s in "ab" for v in ("new_tokens", "rouge_l")],
        *[F.count_if(f"{s}_overall").alias(f"{s}_overall") for s in "ab"],
        F.percentile(F.when(F.col("subset") == "both_stopped", F.try_divide("b_new_tokens", "a_new_tokens")), 0.5).alias("median_length_ratio"),
    )
    array = lambda names: F.array(*[F.lit(n) for n in names])
    every = scores.sparkSession.range(1).select(F.explode(array([f"{a}->{b}" for a, b in pairs])).alias("pair")).withColumn("subset", F.explode(array(subsets)))
    return every.join(made, ["pair", "subset"], "left").na.fill(0, ["n", "a_overall", "b_overall"]).select(*made.columns)


def changes(scores: DataFrame, pairs: list[tuple[str, str]], limit: int = 384) -> DataFrame:
    """(pair, kind, index, rules): a row for each prompt that b fixed or regressed on, with the rules that b failed there."""
    kind = F.when(~F.col("a_overall") & F.col("b_overall"), "fixed").when(F.col("a_overall") & ~F.col("b_overall"), "regressed")
    return side_by_side(scores, pairs, limit).select("pair", kind.alias("kind"), "index", F.array_join("b_failed", "+").alias("rules")).where("kind is not null")


def pair_changes(scores: DataFrame, pairs: list[tuple[str, str]], limit: int = 384) -> DataFrame:
    """(pair, b_shorter, fixed, regressed, their sorted indices, and the rules that b failed on regressed ones).

    A report with all indices of a pair in one row, for evaluation sets; `changes` has them as rows.
    """
    fixed, regressed = ~F.col("a_overall") & F.col("b_overall"), F.col("a_overall") & ~F.col("b_overall")
    indices = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("index"))))
    made = side_by_side(scores, pairs, limit).groupBy("pair").agg(
        F.count_if(F.col("b_new_tokens") < F.col("a_new_tokens")).alias("b_shorter"),
        F.count_if(fixed).alias("fixed"),
        indices(fixed).alias("fixed_indices"),
        F.count_if(regressed).alias("regressed"),
        indices(regressed).alias("regressed_indices"),
        F.transform(F.array_sort(F.collect_list(F.when(regressed, F.struct("index", "b_failed")))), lambda x: F.array_join(x["b_failed"], "+")).alias("regressed_rules"),
    )
    none = F.array()
    names = F.array(*[F.lit(f"{a}->{b}") for a, b in pairs])
    every = scores.sparkSession.range(1).select(F.explode(names).alias("pair"))
    lists = {c: F.coalesce(c, none.cast("array<string>" if c == "regressed_rules" else "array<bigint>")) for c in ("fixed_indices", "regressed_indices", "regressed_rules")}
    return every.join(made, "pair", "left").na.fill(0).withColumns(lists).select(*made.columns)


def examples(rows: DataFrame, scores: DataFrame, indices: list[int], systems: list[str]) -> DataFrame:
    """The asked-for rows with every system's answer as a struct column."""
    answer = F.struct("text", "new_tokens", "stopped", "rouge_l", "failed")
    chosen = scores.where(F.col("index").isin(indices)).groupBy("index").pivot("system", systems).agg(F.first(answer))
    return rows.where(F.col("index").isin(indices)).select("index", "instruction", "input", "output").join(chosen, "index")


def first_side_by_side(generations: DataFrame, systems: list[str], n: int) -> DataFrame:
    """The first n rows with each system's text and whether it stopped."""
    return generations.where(F.col("index") < n).groupBy("index").pivot("system", systems).agg(F.first(F.struct("text", "stopped")))
