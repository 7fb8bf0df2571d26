"""Blind grading: sheet and key, unblinding, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import seeded, text
from tessera.operators import metrics
from tessera.operators.checks import GRADES, LABELS, SYSTEMS

# The differences reported, label, first and second system.
DIFFERENCES = (("sft - base", "base", "sft"), ("dpo - sft", "sft", "dpo"))


def blind_key(indices: DataFrame, seed: int) -> DataFrame:
    """(index, system, label): systems in a seeded order that depends on the index."""
    every = indices.select("index").distinct().withColumn("system", F.explode(F.array(*[F.lit(s) for s in SYSTEMS])))
    order = Window.partitionBy("index").orderBy(seeded.digest(f"blind-grading:{seed}", F.col("index"), F.col("system")), "system")
    return every.withColumn("label", F.get(F.array(*[F.lit(x) for x in LABELS]), F.row_number().over(order) - 1))


def sheet(rows: DataFrame, generations: DataFrame, key: DataFrame) -> DataFrame:
    """(index, prompt, reference, answers): nothing that tells the systems apart."""
    answers = key.join(generations.select("index", "system", "text"), ["index", "system"]).groupBy("index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "text")))).alias("answers"))
    prompt = text.shown_prompt(F.col("instruction"), F.col("input"))
    return rows.select("index", prompt.alias("prompt"), F.col("output").alias("reference")).join(answers, "index")


def unblind(grades: DataFrame, key: DataFrame) -> DataFrame:
    """grades with the system instead of the label."""
    return grades.join(key, ["index", "label"]).drop("label")


def summary(grades: DataFrame, rubric: DataFrame, resamples: int = metrics.RESAMPLES, seed: int = 0) -> DataFrame:
    """(grader, system, measure, k, n, rate, ci_lo, ci_hi): shares of correct answers, also split by the rubric, and class counts."""
    joined = grades.join(rubric.select("index", "system", "overall"), ["index", "system"], "left")
    correct = F.col("grade") == "correct"
    measures = {
        "correct": correct,
        "correct_or_partly": F.col("grade") != "wrong",
        "correct_if_rubric_pass": F.when(F.col("overall"), correct),
        "correct_if_rubric_fail": F.when(~F.col("overall"), correct),
        **{f"is_{g}": F.col("grade") == g for g in GRADES},
    }
    entries = F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("passed")) for n, c in measures.items()])
    flat = joined.select("grader", "system", F.explode(entries).alias("m")).select("grader", "system", "m.*")
    return metrics.rates(flat, ["grader", "system", "measure"], "passed", resamples, seed)


def differences(grades: DataFrame, both_pass: DataFrame | None = None, resamples: int = metrics.RESAMPLES, seed: int = 0) -> DataFrame:
    """(grader, difference, n, a_correct, b_correct, diff, ci_lo, ci_hi); both_pass keeps prompts on which its rubric passes both systems.

    All systems of a prompt meet once, so grades and rubric are computed once.
    """
    is_ = lambda s: F.col("system") == s
    sides = grades.groupBy("grader", "index").agg(*[F.bool_or(F.when(is_(s), F.col("grade") == "correct")).alias(f"ok_{s}") for s in SYSTEMS])
    passed = lambda s: F.lit(True)
    if both_pass is not None:
        passing = both_pass.groupBy("index").agg(*[F.coalesce(F.bool_or(is_(s) & F.col("overall")), F.lit(False)).alias(f"pass_{s}") for s in SYSTEMS])
        sides = sides.join(passing, "index")
        passed = lambda s: F.col(f"pass_{s}")
    entry = lambda label, a, b: F.when(passed(a) & passed(b), F.struct(F.lit(label).alias("difference"), F.col(f"ok_{a}").alias("a_ok"), F.col(f"ok_{b}").alias("b_ok")))
    pairs = sides.select("grader", F.explode(F.array_compact(F.array(*[entry(*d) for d in DIFFERENCES]))).alias("d")).select("grader", "d.*").where("a_ok is not null and b_ok is not null")
    every = grades.select("grader").distinct().withColumn("difference", F.explode(F.array(*[F.lit(d[0]) for d in DIFFERENCES])))
    return metrics.paired_differences(pairs, ["grader", "difference"], "a_ok", "b_ok", resamples, seed, every=every)


def grader_agreement(grades: DataFrame) -> DataFrame:
    """(first, second, n, exact_match, cohens_kappa) of every two graders over the items both graded."""
    one = lambda n: grades.select(F.col("grader").alias(n), "index", "system", F.col("grade").alias("a" if n == "first" else "b"))
    pairs = one("first").join(one("second"), ["index", "system"]).where(F.col("first") < F.col("second"))
    return metrics.agreement(pairs, ["first", "second"])


def against_discarded(kept: DataFrame, discarded: DataFrame) -> DataFrame:
    """Of a discarded grader: correct answers by system, distinct reasons, and agreement with each kept grader."""
    counts = discarded.groupBy("grader").agg(F.count_if(F.col("grade") == "correct").alias("correct"), F.countDistinct("reason").alias("distinct_reasons"))
    one = discarded.select(F.col("grader").alias("discarded"), "index", "system", F.col("grade").alias("b"))
    pairs = kept.select("grader", "index", "system", F.col("grade").alias("a")).join(one, ["index", "system"])
    return metrics.agreement(pairs, ["grader", "discarded"]).join(counts.withColumnRenamed("grader", "discarded"), "discarded")
