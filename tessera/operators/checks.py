"""Leakage, alignment and grade checks; the frames hold what is wrong, the check functions raise."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grades, the labels of blind answers, and the systems compared.
GRADES = ("correct", "partly", "wrong")
LABELS = ("A", "B", "C")
SYSTEMS = ("base", "sft", "dpo")


class SplitMismatch(RuntimeError):
    """A rebuilt split isn't the saved one."""


def key_differences(saved: DataFrame, rebuilt: DataFrame, train: DataFrame, key: str = "key") -> DataFrame:
    """One row: saved keys that are missing, rebuilt keys that are new, and saved keys that are in training."""
    marks = [df.select(key).distinct().withColumn("mark", F.lit(m)) for df, m in ((saved, 1), (rebuilt, 2), (train, 4))]
    seen = reduce(DataFrame.unionByName, marks).groupBy(key).agg(F.sum("mark").alias("marks"))
    has = lambda m: F.col("marks").bitwiseAND(m) > 0
    return seen.agg(F.count_if(has(1) & ~has(2)).alias("missing"), F.count_if(~has(1) & has(2)).alias("unexpected"), F.count_if(has(1) & has(4)).alias("in_training"))


def check_split(saved: DataFrame, rebuilt: DataFrame, train: DataFrame, key: str = "key") -> None:
    d = key_differences(saved, rebuilt, train, key).first()
    if d.missing or d.unexpected:
        raise SplitMismatch(f"rebuilt split differs: {d.missing} saved prompts missing, {d.unexpected} unexpected")
    if d.in_training:
        raise SplitMismatch(f"{d.in_training} training prompts are held-out prompts too")


def leaked(rows: DataFrame, held_out: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key is held out."""
    return rows.join(held_out.select(key).distinct(), key, "left_semi")


def prompt_set_hash(rows: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """SHA-256 of the keys, one per line: sorted, or in the given column's order.

    The digest is defined over one string, so one task reads all keys in order; it sorts
    on disk and holds a batch of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n, some = sha256(usedforsecurity=False), 0, False
        for batch in batches:
            for k in batch.column(0).to_pylist():
                n += 1
                if k is not None:
                    digest.update(("\n" if some else "").encode() + k.encode())
                    some = True
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([n])], names=["sha256", "n"])

    placed = rows.select(F.col(key).alias("_key"), *([F.col(order).alias("_order")] if order else []))
    by = ["_order", "_key"] if order else ["_key"]
    made = placed.repartition(1).sortWithinPartitions(*by).select("_key").mapInArrow(run, "sha256 string, n long")
    nothing = F.sha2(F.lit("").cast("binary"), 256)  # an empty table may have no task
    return made.agg(F.coalesce(F.max("sha256"), nothing).alias("sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def single_value(df: DataFrame, column: str):
    """The one value of a column, such as the token limit that all systems must share."""
    r = df.agg(F.countDistinct(column).alias("n"), F.count_if(F.col(column).isNull()).alias("nulls"), F.min(column).alias("value")).first()
    if r.n != 1 or r.nulls:
        raise ValueError(f"{column} must have one value, found {r.n + bool(r.nulls)}")
    return r.value


def skipped_systems(expected: DataFrame, available: DataFrame) -> DataFrame:
    """(system, reason) of expected systems, with the adapter each needs, that have no adapter."""
    found = available.select("adapter").distinct().withColumn("there", F.lit(True))
    joined = expected.join(found, "adapter", "left")
    return joined.where(F.col("adapter").isNotNull() & F.col("there").isNull()).select("system", F.concat(F.lit("no adapter at "), "adapter").alias("reason"))


def check_system_names(names: DataFrame, column: str = "system") -> None:
    """Unique, and made of letters, digits, dots, dashes and underscores."""
    bad = names.groupBy(column).agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~F.col(column).rlike(r"^[A-Za-z0-9_.-]+\z") | F.col(column).isNull()).first()
    if bad:
        raise ValueError(f"bad or repeated system name {bad[0]!r}")


def misaligned(generations: DataFrame, rows: DataFrame) -> DataFrame:
    """(index) of rows and generations that don't answer one another; both have index and prompt_key."""
    a = rows.select(F.col("index").alias("i"), F.col("prompt_key").alias("wanted"))
    b = generations.select(F.col("index").alias("j"), F.col("prompt_key").alias("given"))
    both = a.join(b, F.col("i") == F.col("j"), "full")
    return both.where(~F.col("wanted").eqNullSafe(F.col("given")) | F.col("i").isNull() | F.col("j").isNull()).select(F.coalesce("i", "j").alias("index"))


def check_generations(generations: DataFrame, rows: DataFrame, name: str) -> None:
    counts = generations.count(), rows.count()
    if counts[0] != counts[1]:
        raise ValueError(f"{name}: {counts[0]} generations for {counts[1]} rows")
    if (first := misaligned(generations, rows).agg(F.min("index").alias("i")).first().i) is not None:
        raise ValueError(f"{name}: row {first} does not match the eval rows")


def grade_problem(expected: Column) -> Column:
    """What is wrong with a grade by itself, in the order of the checks, or null."""
    blank = F.col("reason").isNull() | (F.trim(F.regexp_replace("reason", r"\s+", " ")) == "")
    return (
        F.when(F.col("index").isNull(), "bad index")
        .when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "invalid label")
        .when(~F.coalesce(F.col("grade").isin(*GRADES), F.lit(False)), "invalid grade")
        .when(blank, "empty reason")
        .when(~expected, "unexpected grade")
    )


def grade_problems(grades: DataFrame, indices: DataFrame) -> DataFrame:
    """(problem, index, label) of every fault; grades has index, label, grade, reason, indices has index."""
    wanted = indices.select("index").distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in LABELS])))
    marked = grades.join(wanted.withColumn("wanted", F.lit(True)), ["index", "label"], "left")
    judged = marked.withColumn("problem", grade_problem(F.coalesce("wanted", F.lit(False))))
    bad = judged.where("problem is not null").select("problem", "index", "label")
    good = judged.where("problem is null").groupBy("index", "label").agg(F.count("*").alias("n"))
    twice = good.where("n > 1").select(F.lit("duplicate grade").alias("problem"), "index", "label")
    missing = wanted.join(good, ["index", "label"], "left_anti").select(F.lit("missing grade").alias("problem"), "index", "label")
    return bad.unionByName(twice).unionByName(missing)


def check_grades(grades: DataFrame, indices: DataFrame) -> None:
    found = grade_problems(grades, indices).groupBy("problem").agg(F.count("*").alias("n"), F.min(F.struct("index", "label")).alias("first")).collect()
    if found:
        raise ValueError("; ".join(f"{r.n} x {r.problem}, first: {tuple(r.first)}" for r in sorted(found, key=lambda r: r.problem)))


class WrongBase(ValueError):
    """An adapter is used without the base it was trained on, or on another."""


def base_adapters(systems: DataFrame, adapters: DataFrame) -> DataFrame:
    """(system, sha256, problem) of every system: its base adapter's digest, and what is wrong with it, or null.

    systems: (system, adapter, base_adapter); adapters: (adapter, sha256, base_path, base_sha256),
    the last two being what an adapter says of the base it was trained on, or null.
    """
    own = adapters.select("adapter", "base_path", "base_sha256")
    base = adapters.select(F.col("adapter").alias("base_adapter"), "sha256")
    joined = systems.select("system", "adapter", "base_adapter").join(own, "adapter", "left").join(base, "base_adapter", "left")
    short = lambda c: F.substring(c, 1, 12)
    given, trained = F.col("base_adapter").isNotNull(), F.col("base_sha256").isNotNull()
    problem = (
        F.when(~given & trained, F.concat("system", F.lit(": "), "adapter", F.lit(" was trained on top of "), "base_path", F.lit("; set base_adapter")))
        .when(given & F.col("sha256").isNull(), F.concat("system", F.lit(": no base adapter at "), "base_adapter"))
        .when(given & trained & (F.col("sha256") != F.col("base_sha256")), F.concat("system", F.lit(": base adapter has sha256 "), short("sha256"), F.lit(", trained on "), short("base_sha256")))
    )
    return joined.select("system", F.when(given, F.col("sha256")).alias("sha256"), problem.alias("problem"))


def check_base_adapters(systems: DataFrame, adapters: DataFrame) -> None:
    if bad := base_adapters(systems, adapters).where("problem is not null").agg(F.min("problem").alias("p")).first().p:
        raise WrongBase(bad)


def sheet_problems(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """(index, problem): prompts that a sheet and its key don't both have once, and labels that are not LABELS for SYSTEMS.

    sheet has index; key has index, system and label.
    """
    lines = sheet.groupBy("index").agg(F.count("*").alias("lines"))
    sets = key.groupBy("index").agg(F.array_sort(F.collect_list("label")).alias("labels"), F.array_sort(F.collect_list("system")).alias("systems"))
    array = lambda names: F.array(*[F.lit(n) for n in sorted(names)])
    problem = (
        F.when(F.col("lines").isNull(), "not on the sheet")
        .when(F.col("labels").isNull(), "not in the key")
        .when(F.col("lines") > 1, "twice on the sheet")
        .when((F.col("labels") != array(LABELS)) | (F.col("systems") != array(SYSTEMS)), "bad labels")
    )
    return lines.join(sets, "index", "full").select("index", problem.alias("problem")).where("problem is not null")


def check_sheet(sheet: DataFrame, key: DataFrame) -> None:
    found = sheet_problems(sheet, key).agg(F.count("*").alias("n"), F.min(F.struct("index", "problem")).alias("first")).first()
    if found.n:
        raise ValueError(f"the sheet does not match its key: {found.n} prompts, first {found.first['index']}: {found.first['problem']}")
