"""Filtering, de-duplication, seeded order and splits of instruction rows.

Rows have row_id (dataset order), instruction, input and output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import seeded, text


def length_filter(rows: DataFrame, least: int = 40, most: int = 1500) -> DataFrame:
    """Outputs of least to most characters as they are, and an instruction that isn't blank."""
    return rows.where(F.length("output").between(least, most) & (F.length(text.strip(F.col("instruction"))) > 0))


def with_key(rows: DataFrame, name: str = "key") -> DataFrame:
    return rows.withColumn(name, text.prompt_key(F.col("instruction"), F.col("input")))


def keep_first(rows: DataFrame, key: Column, order: str = "row_id") -> DataFrame:
    """The row that comes first of each key.

    An aggregate rather than a window: tasks reduce their own rows first, so a key
    that fills a third of the table never meets in one task.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key.alias("_key")).agg(F.min_by(whole, order).alias("_row")).select("_row.*")


def positions(rows: DataFrame, order: Column, name: str = "position", ties: str = "row_id") -> DataFrame:
    """Adds the place, from 0, in the order of a hexadecimal digest, without one task for all rows.

    Rows are cut by the digest's first five digits; counts of those ranges, of which there
    are 2**20 at most, give each its offset, and only a range is sorted by itself: a
    hundred thousand rows if there are 1e11.
    """
    keyed = rows.withColumn("_order", order).withColumn("_range", F.conv(F.substring("_order", 1, 5), 16, 10).cast("int"))
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_order", ties)) - 1
    return keyed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_offset") + within).drop("_order", "_range", "_offset")


def unique_rows(rows: DataFrame, least: int = 40, most: int = 1500) -> DataFrame:
    kept = length_filter(rows, least, most)
    return keep_first(kept, text.prompt_key(F.col("instruction"), F.col("input")))


def split(rows: DataFrame, train_size: int, eval_size: int, seed: int, least: int = 40, most: int = 1500) -> DataFrame:
    """Rows with split (train, eval or rest) and position in the seeded order; too few rows are an error."""
    placed = positions(unique_rows(rows, least, most), seeded.digest(seed, F.col("row_id")))
    if (n := placed.count()) < train_size + eval_size:
        raise ValueError(f"only {n} rows after filtering")
    part = F.when(F.col("position") < train_size, "train").when(F.col("position") < train_size + eval_size, "eval").otherwise("rest")
    return placed.withColumn("split", part)


def split_stats(rows: DataFrame, placed: DataFrame, least: int = 40, most: int = 1500) -> DataFrame:
    """One row: sizes and duplicates dropped."""
    kept = length_filter(rows, least, most).agg(F.count("*").alias("kept"))
    sizes = placed.agg(F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "eval").alias("eval_rows"), F.count("*").alias("unique"))
    return sizes.crossJoin(kept).select("train_rows", "eval_rows", (F.col("kept") - F.col("unique")).alias("duplicates_dropped"))


def first_prompts(placed: DataFrame, n: int) -> DataFrame:
    """The first n training rows."""
    out = placed.where((F.col("split") == "train") & (F.col("position") < n))
    if (found := out.count()) < n:
        raise ValueError(f"only {found} training rows, {n} asked for")
    return out


def pick(rows: DataFrame, n: int, seed: int, index: str = "index") -> DataFrame:
    """n rows by seeded order; the caller sorts by index."""
    total = rows.count()
    if not 0 < n <= total:
        raise ValueError(f"cannot pick {n} of {total} prompts")
    return positions(rows, seeded.digest(seed, F.col(index)), "_place", index).where(F.col("_place") < n).drop("_place")


def held_out_size(n: int, fraction: float) -> int:
    """round() is half to even."""
    return min(max(1, round(fraction * n)), n - 1) if n >= 2 else 0


def split_pairs(pairs: DataFrame, fraction: float, seed: int, index: str = "index") -> DataFrame:
    """pairs with held, for a seeded share of them."""
    held = held_out_size(pairs.count(), fraction)
    placed = positions(pairs, seeded.digest(seed, F.col(index)), "_place", index)
    return placed.withColumn("held", F.col("_place") < held).drop("_place")


def sample_plan(prompts: DataFrame, k: int, batch: int, seed: int, index: str = "prompt_index") -> DataFrame:
    """k samples of each prompt in blocks, with their number, batch and batch seed."""
    plan = prompts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("index", F.col(index) * k + F.col("sample"))
    return plan.withColumn("batch", F.floor(F.col("index") / batch)).withColumn("batch_seed", F.col("batch") + seed)
