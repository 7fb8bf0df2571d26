"""Skew-safe joins and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import discard, importable, save, shared_folder

__all__ = ["components", "discard", "free_name", "importable", "lookup_join", "salted_join", "save", "shared_folder"]


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, lengthened until it clashes with no column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: At most this many keys can each hold over a thousandth of the rows, so what
#: is broadcast for them has a fixed bound whatever the size of the input.
HEAVY_SHARE = 1000
HEAVY_LEAST = 10_000


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, total: int, least: int = HEAVY_LEAST) -> DataFrame:
    """Left join to a table with one row for each key, however uneven the keys are.

    counts has (key, n), n being the key's rows in `rows`. Keys that hold over
    1/HEAVY_SHARE of all rows (and over `least`), fewer than HEAVY_SHARE in number, are
    broadcast; the others shuffle in parts none of which one key can fill.
    """
    heavy = counts.where(F.col("n") > max(least, total // HEAVY_SHARE)).select(key)
    heavy_lookup = F.broadcast(heavy).join(lookup, key, "inner")
    light = rows.join(F.broadcast(heavy), key, "left_anti").join(lookup, key, "left")
    return light.unionByName(rows.join(F.broadcast(heavy_lookup), key, "inner"))


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, total: int, spread: Column) -> DataFrame:
    """Inner join to a table with one wide row for each key, which is never broadcast.

    A key's row is copied once for each 1/HEAVY_SHARE of all rows that the key holds, so
    fewer than HEAVY_SHARE copies are made; its rows are dealt over them by `spread`.
    """
    share = max(HEAVY_LEAST, total // HEAVY_SHARE)
    salt = free_name(rows, "salt")
    heavy = counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_copies"))
    copied = lookup.join(F.broadcast(heavy), key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn(salt, F.pmod(spread, F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    return dealt.join(copied, [key, salt]).drop(salt)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node reachable.

    edges: (a, b), of one orderable type. Alternates large-star and small-star
    steps until nothing changes. A node that has a large share of the links, as the
    centre of a star has, is looked up by broadcast. Each round is a written table, so
    no lineage grows, and only counts and a checksum come to the driver.
    """
    spark = edges.sparkSession
    state = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    path = f"{folder}/round-start"
    state, before, n = save(state, path), None, 0
    while True:
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if seen == before or seen[0] == 0:
            break
        before, links, step = seen, seen[0], f"{folder}/step-{n}"
        both = state.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
            state.select(F.col("u").alias("x"), F.col("v").alias("y"))
        )
        least = save(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n")), f"{step}/least")
        large = lookup_join(both, least.drop("n"), "x", least.select("x", "n"), 2 * links).where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        large = save(large, f"{step}/large")
        parent = save(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), f"{step}/parent")
        moved = lookup_join(large, parent.drop("n"), "v", parent.select("v", "n"), links).where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = moved.unionByName(parent.select("v", F.col("m").alias("u"))).distinct()
        new_path = f"{folder}/round-{n}"
        state = save(after, new_path)
        discard(spark, path)
        discard(spark, step)
        path, n = new_path, n + 1
    roots = state.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return state.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
