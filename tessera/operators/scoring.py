"""Scoring generations against their rows, verdicts, and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rules, text
from tessera.functions.binding import once


def scored(rows: DataFrame, generations: DataFrame, limit: int) -> DataFrame:
    """generations (index, text, new_tokens, stopped, ...) with one struct for each rule, failed and overall.

    rows has index, instruction, input and output. A prompt's class is computed once
    and the rows are joined by index, so k systems or samples share it.
    """
    prompt = text.plain_prompt(F.col("instruction"), F.col("input"))
    prompts = rows.select("index", prompt.alias("_prompt"), F.col("output").alias("_reference"))
    prompts = prompts.withColumn("_domain", once(rules.is_domain(F.col("_prompt"))))
    joined = generations.join(prompts, "index")
    made = rules.scored(joined, "_domain", "_prompt", "_reference", "text", "stopped", "new_tokens", limit)
    out = made.withColumn("failed", once(rules.failed({n: F.col(n) for n in rules.RULES})))
    return out.withColumn("overall", F.size("failed") == 0).drop("_prompt", "_reference", "_domain")


def long_rules(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, applies, passed, reason), and a rule `overall` that always applies."""
    entry = lambda n, r: F.struct(F.lit(n).alias("rule"), r["applies"].alias("applies"), r["passed"].alias("passed"), r["reason"].alias("reason"))
    overall = F.struct(F.lit("overall").alias("rule"), F.lit(True).alias("applies"), F.col("overall").alias("passed"), F.lit("").alias("reason"))
    entries = F.array(*[entry(n, F.col(n)) for n in rules.RULES], overall)
    return scores.select(*keys, F.explode(entries).alias("r")).select(*keys, "r.*")


def failed_reasons() -> Column:
    """`rule: reason` of each rule that applies and failed, in order."""
    entry = lambda n: F.when(F.col(n)["applies"] & ~F.col(n)["passed"], F.concat(F.lit(f"{n}: "), F.col(n)["reason"]))
    return F.array_compact(F.array(*[entry(n) for n in rules.RULES]))


def with_verdict(scores: DataFrame) -> DataFrame:
    return scores.withColumn("verdict", rules.verdict(F.col("failed"), F.col("stopped"))).withColumn("reject_reasons", rules.reject_reasons(F.col("failed"), F.col("stopped")))


def first_rejected(samples: DataFrame) -> DataFrame:
    """(prompt_index, r): of each prompt the first rejected sample by number, not the worst."""
    whole = F.struct(*[F.col(c) for c in samples.columns if c != "prompt_index"])
    return samples.where(F.col("verdict") == "rejected").groupBy("prompt_index").agg(F.min_by(whole, "sample").alias("r"))


def candidates(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Prompts with a rejected sample; dropped: its text is the reference."""
    turns = text.messages(F.col("instruction"), F.col("input"), F.col("output"))
    prompts = rows.select(F.col("index").alias("prompt_index"), text.prompt_key(F.col("instruction"), F.col("input")).alias("prompt_key"), turns.alias("turns"))
    found = prompts.join(first_rejected(samples), "prompt_index")
    return found.withColumn("chosen", F.element_at("turns", -1)["content"]).withColumn("dropped", text.strip(F.col("r.text")) == F.col("chosen"))


def build_pairs(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """One pair for each prompt with a rejected sample that isn't the reference, numbered in prompt order."""
    kept = candidates(rows, samples).where("not dropped")
    numbered = with_rank(kept, "prompt_index", "index")
    return numbered.select(
        "index",
        "prompt_index",
        "prompt_key",
        text.prompt_messages(F.col("turns")).alias("prompt"),
        "chosen",
        F.col("r.text").alias("rejected"),
        F.col("r.sample").alias("rejected_sample"),
        F.col("r.stopped").alias("rejected_stopped"),
        F.col("r.new_tokens").alias("rejected_new_tokens"),
        F.col("r.reject_reasons").alias("rejected_reasons"),
        F.col("r.failed").alias("rejected_failed_rules"),
        F.struct(*[F.col(f"r.{n}").alias(n) for n in rules.RULES]).alias("rejected_rubric"),
    )


def with_rank(rows: DataFrame, by: str, name: str, width: int = 4096) -> DataFrame:
    """Adds the place, from 0, in the order of a distinct integer column.

    Counts of ranges, of ranges of 65,536 of those, and so on give each range its offset,
    so that no task orders more than `width` rows or 65,536 counts, however large the
    integers are.
    """
    levels = [rows.groupBy(F.floor(F.col(by) / width).alias("_l0")).agg(F.count("*").alias("_n"))]
    for k in (1, 2):
        levels.append(levels[-1].groupBy(F.floor(F.col(f"_l{k - 1}") / 65_536).alias(f"_l{k}")).agg(F.sum("_n").alias("_n")))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = levels[2].select("_l2", before(Window.orderBy("_l2")).alias("_offset"))
    for k in (1, 0):
        up = f"_l{k + 1}"
        within = levels[k].withColumn(up, F.floor(F.col(f"_l{k}") / 65_536))
        within = within.withColumn("_in", before(Window.partitionBy(up).orderBy(f"_l{k}")))
        offsets = within.join(offsets, up).select(f"_l{k}", (F.col("_offset") + F.col("_in")).alias("_offset"))
    ranged = rows.withColumn("_l0", F.floor(F.col(by) / width))
    place = F.row_number().over(Window.partitionBy("_l0").orderBy(by)) - 1
    return ranged.join(offsets, "_l0").withColumn(name, F.col("_offset") + place).drop("_l0", "_offset")


def pair_counts(samples: DataFrame, prompts: int, pairs: int, dropped: int) -> DataFrame:
    """One row of counters over the samples of a run."""
    is_ = lambda v: F.col("verdict") == v
    has = lambda column, value: F.array_contains(column, value)
    share = lambda k: F.try_divide(k, F.count("*"))
    by_prompt = samples.groupBy("prompt_index").agg(F.bool_or(is_("rejected")).alias("any"), F.bool_and(is_("pass")).alias("all"))
    per_prompt = by_prompt.agg(F.count_if("any").alias("prompts_with_rejected_sample"), F.count_if("all").alias("prompts_all_samples_pass"))
    totals = samples.agg(
        F.count("*").alias("samples"),
        F.count_if(is_("rejected")).alias("samples_rejected"),
        F.count_if(is_("ambiguous")).alias("ambiguous_skipped"),
        F.count_if(is_("pass")).alias("samples_pass"),
        *[F.count_if(has("reject_reasons", r)).alias(f"rejections_{r}") for r in rules.REASONS],
        *[share(F.count_if(has("reject_reasons", r))).alias(f"rejected_share_{r}") for r in rules.REASONS],
        *[F.count_if(has("failed", r)).alias(f"failures_{r}") for r in rules.RULES],
        *[F.count_if(has("failed", r) & ~is_("rejected")).alias(f"{r}_failures_not_rejected") for r in rules.RULES[3:]],
        share(F.count_if(~F.col("stopped"))).alias("no_stop_share"),
        share(F.count_if("stopped")).alias("stopped_share"),
        F.avg("new_tokens").alias("mean_new_tokens"),
    )
    fixed: dict[str, Column] = {
        "prompts": F.lit(prompts).cast("long"),
        "pairs_kept": F.lit(pairs).cast("long"),
        "pairs_dropped_rejected_equals_chosen": F.lit(dropped).cast("long"),
        "yield": F.lit(pairs / prompts if prompts else None).cast("double"),
    }
    both = totals.crossJoin(per_prompt).withColumns(fixed)
    return both.withColumn("prompts_without_rejected_sample", F.col("prompts") - F.col("prompts_with_rejected_sample"))


def run_counts(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """pair_counts of a run with its pairs counted too, in one pass over the samples: counters of each prompt, then their sums."""
    is_ = lambda v: F.col("verdict") == v
    has = lambda column, value: F.array_contains(column, value)
    sums = {
        "samples": F.count("*"),
        "samples_rejected": F.count_if(is_("rejected")),
        "ambiguous_skipped": F.count_if(is_("ambiguous")),
        "samples_pass": F.count_if(is_("pass")),
        **{f"rejections_{r}": F.count_if(has("reject_reasons", r)) for r in rules.REASONS},
        **{f"failures_{r}": F.count_if(has("failed", r)) for r in rules.RULES},
        **{f"{r}_failures_not_rejected": F.count_if(has("failed", r) & ~is_("rejected")) for r in rules.RULES[3:]},
        "stopped": F.count_if("stopped"),
        "new_tokens": F.sum("new_tokens"),
    }
    first = F.min_by(F.when(is_("rejected"), F.col("text")), F.when(is_("rejected"), F.col("sample")))
    by_prompt = samples.groupBy("prompt_index").agg(*[c.alias(n) for n, c in sums.items()], F.bool_or(is_("rejected")).alias("any"), F.bool_and(is_("pass")).alias("all"), first.alias("_text"))
    prompts = rows.select(F.col("index").alias("prompt_index"), text.strip(F.col("output")).alias("_reference"))
    joined = prompts.join(by_prompt, "prompt_index", "left").withColumn("_same", text.strip(F.col("_text")) == F.col("_reference"))
    total = joined.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums],
        F.count("*").alias("prompts"),
        F.count_if("any").alias("prompts_with_rejected_sample"),
        F.count_if("all").alias("prompts_all_samples_pass"),
        F.count_if(F.col("any") & ~F.col("_same")).alias("pairs_kept"),
        F.count_if(F.col("any") & F.col("_same")).alias("pairs_dropped_rejected_equals_chosen"),
    )
    share = lambda n: F.try_divide(F.col(n), F.col("samples"))
    made = total.withColumns(
        {f"rejected_share_{r}": share(f"rejections_{r}") for r in rules.REASONS}
        | {"no_stop_share": F.try_divide(F.col("samples") - F.col("stopped"), F.col("samples")), "stopped_share": share("stopped"), "mean_new_tokens": share("new_tokens")}
        | {"yield": F.try_divide("pairs_kept", "prompts"), "prompts_without_rejected_sample": F.col("prompts") - F.col("prompts_with_rejected_sample")}
    )
    return made.drop("stopped", "new_tokens")


def training_rows(pairs: DataFrame) -> DataFrame:
    """Pairs as preference training reads them: the prompt's turns, and each answer as an assistant's turn."""
    turn = lambda c: F.array(text.message("assistant", F.col(c))).alias(c)
    return pairs.select("index", "prompt", turn("chosen"), turn("rejected"), "rejected_stopped")


def throughput(samples: Column, tokens: Column, seconds: Column) -> Column:
    """struct<samples_per_minute, tokens_per_second>, null without time; for newly generated rows only."""
    per = lambda x: F.round(F.try_divide(x, seconds), 2)
    return F.struct(per(samples * 60).alias("samples_per_minute"), per(tokens).alias("tokens_per_second"))
