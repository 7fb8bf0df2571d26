"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Targets: the sources, in code point order with null last, carry the given weights
in turn and share all words; a target stops at `most_epochs` times its source's
size and the excess goes to the others by weight (water-filling, solved in one
ordered pass over the sources).

Selection: a source's target first takes whole epochs. The rest is drawn without
replacement: each document has an exponential key, -ln(u) divided by its quality
weight; keys are sorted within the source and sizes summed along them up to the
rest. The document that would cross the rest is passed over, and a second sum
runs over those that fit in the gap. What then remains is closed by the one
document left whose size comes nearest to it, if that helps. u comes from an MD5
digest of the seed and the id, so reruns agree.

No source is gathered in one task: rows with equal id, source and size are counted
first and go on as one, keys are cut into ranges, sizes are summed by (source, range)
before the shuffle, and only one range's rows are sorted together. Ranges are cut by
the distribution of keys at the least weight, and there are as many more of them as the
largest weight exceeds the least, so none is expected to hold over RANGE_ROWS rows.

Defined results: a null or empty text has size 0, a text of any length is counted
whole; a null doc_id draws like the empty id; repeated rows draw the same key and are
taken or left together; labels with a null id or no matching document are ignored,
several labels of a document count by their mean; an empty table gives an empty
result; a null source is a source; other columns are not read, and those added get
longer names where they would clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import discard, free_name, lookup_join, save, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one range of keys should hold.
RANGE_ROWS = 10_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most_epochs: int = 3
    seed: int = 17
    #: Quality weights of documents labelled 1, labelled 0, and not labelled.
    good: float = 2.0
    bad: float = 0.5
    unknown: float = 1.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A string that is never null and sorts as sources do, null last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform over (0, 1), from 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """sizes: (s, source_size), one row for each source; adds target. Rows here are sources, not documents."""
    everything = Window.orderBy("s")
    by_ratio = Window.orderBy("ratio", "s")
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    ranked = (
        sizes.withColumn("w", F.get(weights, F.pmod(F.row_number().over(everything) - 1, len(mix.weights))))
        .withColumn("cap", F.col("source_size") * float(mix.most_epochs))
        .withColumn("ratio", F.col("cap") / F.col("w"))
    )
    level = (
        F.sum("source_size").over(Window.partitionBy(F.lit(0)))
        - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("open", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    shared = F.max("open").over(Window.partitionBy(F.lit(0)))
    return filled.select("s", "source_size", F.least("cap", F.coalesce(shared, F.lit(0.0)) * F.col("w")).alias("target"))


def prefix_sums(rows: DataFrame, size: Column) -> DataFrame:
    """Adds upto: the sum of size along the keys of a source, up to the row and its equals.

    rows has s, part (the range of the key), key, doc_id, size and n, the documents that a
    row stands for. Sums of (s, part) come first; a part's rows are then sorted by themselves.
    """
    rows = rows.withColumn("counted", (size * F.col("n")).cast("long"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("s", "part").agg(F.sum("counted").alias("part_size"))
    offsets = parts.select("s", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("s", "part").orderBy("key", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("offset") + F.sum("counted").over(within)
    return rows.join(offsets, ["s", "part"]).withColumn("upto", upto).drop("offset", "counted")


def mixed(docs: DataFrame, labels: DataFrame | None = None, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, s, size, source_size, target, taken) of every document; s is source_key of its source."""
    found = drawn(docs, F.lit(0), labels, mix)
    step = 1000  # of equal documents, so that no long array is made
    parts = found.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))))
    rows = parts.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step), F.col("n") - F.col("_part") * step))))
    return rows.select("doc_id", "s", "size", "source_size", "target", "taken")


def drawn(docs: DataFrame, mark: Column, labels: DataFrame | None, mix: Mix) -> DataFrame:
    """(doc_id, s, size, mark, n, source_size, target, taken): a row for the n documents with equal id, source, size and mark."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    sized = docs.select("doc_id", source_key(F.col("source")).alias("s"), size_of(F.col("text")).alias("size"), mark.alias("mark"))
    sized = sized.groupBy("doc_id", "s", "size", "mark").agg(F.count("*").alias("n"))
    weight: Column = F.lit(mix.unknown)
    if labels is not None:
        quality = (
            labels.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("q"))
            .where(F.col("labelled").isNotNull() & F.col("q").isNotNull())
            .groupBy("labelled")
            .agg(F.avg("q").alias("q"))
        )
        sized = sized.join(quality, F.col("doc_id") == F.col("labelled"), "left")
        weight = F.coalesce(F.lit(mix.bad) + F.lit(mix.good - mix.bad) * F.col("q"), F.lit(mix.unknown))
    key = -F.log(draw(F.col("doc_id"), mix.seed)) / weight
    sized = save(sized.select("doc_id", "s", "size", "mark", "n", key.alias("key")), f"{folder}/sized")

    total_of = lambda c: F.sum(c * F.col("n"))
    by_source = sized.groupBy("s").agg(total_of(F.col("size")).alias("source_size"), F.count("*").alias("rows"))
    with_targets = by_source.select("s", "rows").join(targets(by_source.select("s", "source_size"), mix), "s")
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    plan = with_targets.withColumn("epochs", F.least(share, F.lit(mix.most_epochs)).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    least, most = (f(mix.good, mix.bad, mix.unknown) for f in (min, max))
    plan = save(plan.withColumn("ranges", F.ceil(F.col("rows") * (most / least / RANGE_ROWS))), f"{folder}/plan")
    counts, total = plan.select("s", F.col("rows").alias("n")), plan.agg(F.sum("rows")).first()[0] or 0

    part = F.floor(F.col("ranges") * (1 - F.exp(-F.col("key") * least))).cast("long")
    keyed = lookup_join(sized, plan.select("s", "rest", "ranges"), "s", counts, total).withColumn("part", part)
    first = prefix_sums(keyed, F.col("size")).withColumn("in_first", F.col("upto") <= F.col("rest"))
    first = save(first.drop("upto", "ranges"), f"{folder}/first")

    got = first.groupBy("s").agg(total_of(F.when(F.col("in_first"), F.col("size")).otherwise(0)).alias("got"))
    gaps = plan.join(got, "s").select("s", "source_size", "target", "epochs", (F.col("rest") - F.col("got")).alias("gap"))
    gaps = save(gaps, f"{folder}/gaps")
    rows = lookup_join(first.drop("rest"), gaps, "s", counts, total)
    fits = ~F.col("in_first") & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    second = prefix_sums(rows, F.when(fits, F.col("size")).otherwise(0))
    second = second.withColumn("chosen", F.col("in_first") | (fits & (F.col("upto") <= F.col("gap"))))
    second = save(second.drop("upto", "in_first", "part"), f"{folder}/second")

    added = second.groupBy("s").agg(total_of(F.when(F.col("chosen"), F.col("size")).otherwise(0)).alias("added"))
    ends = plan.join(added, "s").select("s", (F.col("rest") - F.col("added")).alias("left"))
    left = lookup_join(second.where("not chosen and size > 0"), save(ends, f"{folder}/ends"), "s", counts, total).where(F.col("size") < 2 * F.col("left"))
    nearest = left.groupBy("s").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "key", "doc_id", "size")).alias("last"))
    done = lookup_join(second, save(nearest, f"{folder}/nearest"), "s", counts, total)
    last = F.coalesce((F.col("key") == F.col("last.key")) & F.col("doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("size") == F.col("last.size")), F.lit(False))
    copies = F.least(F.col("epochs") + F.when(F.col("chosen") | last, 1).otherwise(0), F.lit(mix.most_epochs))
    for name in ("sized", "first"):
        discard(spark, f"{folder}/{name}")
    return done.select("doc_id", "s", "size", "mark", "n", F.col("source_size").cast("long"), "target", (F.col("size") * copies).cast("long").alias("taken"))


def mixture(docs: DataFrame, labels: DataFrame | None = None, mix: Mix = Mix()) -> DataFrame:
    """The documents taken, with size, source_size, target and taken (words, repeats counted).

    Documents find what was decided by id, source and a hash of the text, so words are counted once.
    """
    names = {c: free_name(docs, c) for c in ("size", "source_size", "target", "taken")}
    inner = {c: free_name(docs, f"_{c}") for c in ("doc_id", "s", "mark", *names)}
    mark = F.xxhash64("text")
    taken = drawn(docs, mark, labels, mix).where("taken > 0").select(*[F.col(c).alias(n) for c, n in inner.items()])
    same = F.col("doc_id").eqNullSafe(F.col(inner["doc_id"])) & (source_key(F.col("source")) == F.col(inner["s"])) & (mark == F.col(inner["mark"]))
    return docs.join(taken, same).select(*docs.columns, *[F.col(inner[c]).alias(n) for c, n in names.items()])
