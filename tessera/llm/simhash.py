"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

Fingerprints: one pass over whole texts, no shuffle. Links: the 64 bits are cut
into `BLOCKS` blocks; two fingerprints that differ in at most `distance` bits
agree on at least BLOCKS - distance whole blocks, so they meet in a bucket of one
of the block combinations. Six blocks for a distance of 3 give 20 tables keyed by
about 32 bits: by chance a bucket holds one fingerprint up to billions of rows.

Equal fingerprints are one node. A bucket with many different fingerprints is cut
into chunks, and every pair of chunks is a row of its own, compared inside one
Python call that returns a spanning forest of the links, never the pairs.

Defined results: a null or empty text has no words and the fingerprint zero;
repeated rows get equal results; a null doc_id takes part in links but names no
component (component_id is null if no document reachable has an id); an empty
table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tessera.llm.tables import components, free_name, importable, lookup_join, save, shared_folder

SEED = 42
BLOCKS = 6
#: Fingerprints of one bucket that are compared at once, at most about twice as many.
CHUNK = 2048


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a text in UTF-8."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxh64_digest(joined, SEED)
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        digests = b"".join([xxh64_digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])])
    n = len(digests) // 8
    ones = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint_of(spark: SparkSession, text: Column, shingle: int = 3) -> Column:
    """The signed fingerprint of each text."""
    importable(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t.as_py(), shingle) for t in batch], pa.int64())

    return F.arrow_udf(run, "long").asNondeterministic()(text.cast("string").cast("binary"))


def masks(distance: int, blocks: int = BLOCKS) -> list[int]:
    """A signed 64-bit mask for each combination of blocks that must agree."""
    if not 0 <= distance < blocks:
        raise ValueError("distance must be below the number of blocks")
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    sums = [sum(c) for c in combinations(parts, blocks - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in sums]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect whatever chains of close fingerprints connect."""
    if len(fps) == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(a, b)] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance else []
    left, out = fps, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= distance
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                todo += list(found)
                left = left[~near]
    return out


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links that connect all of the distinct values fp that are within distance, directly or in steps."""
    importable(fps.sparkSession)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(distance))])
    keyed = fps.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.k")
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    tiles = (
        keyed.join(shared.select("t", "k", chunks.alias("chunks")), ["t", "k"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .groupBy("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            found = {(min(e), max(e)) for lo, hi in zip(offsets, offsets[1:]) for e in forest(flat[lo:hi], distance)}
            pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long").distinct()


def grouped(rows: DataFrame, distance: int, folder: str) -> DataFrame:
    """(fp, component_id, home, n) of every distinct fp of rows (doc_id, fp).

    component_id is the smallest id reachable through links, home the smallest
    fingerprint of the component that has it, n the rows with fp.
    """
    nodes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), f"{folder}/nodes")
    found = save(components(links(nodes.select("fp"), distance), folder), f"{folder}/components")
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("first"))
    lookup = rooted.join(named, "root").select("fp", F.col("first.least").alias("component_id"), F.col("first.fp").alias("home"), "n")
    return save(lookup, f"{folder}/lookup")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable through links."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    fp = fingerprint_of(spark, F.col(text_col), shingle)
    rows = save(docs.select(F.col(id_col).alias("doc_id"), fp.alias("fp")), f"{folder}/fingerprints")
    lookup = grouped(rows, distance, folder)
    total = lookup.agg(F.sum("n")).first()[0] or 0
    out = lookup_join(rows, lookup.select("fp", "component_id"), "fp", lookup.select("fp", "n"), total)
    return out.select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: one with the smallest id, and of repeated rows any one."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    name, row = free_name(docs, "fp"), free_name(docs, "row")
    marked = docs.withColumn(name, fingerprint_of(spark, F.col(text_col), shingle)).withColumn(row, F.monotonically_increasing_id())
    marked = save(marked, f"{folder}/marked")
    narrow = marked.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(name).alias("fp"))
    lookup = grouped(narrow, distance, folder)
    total = lookup.agg(F.sum("n")).first()[0] or 0
    homes = lookup.where("fp = home").select("fp", F.lit(True).alias("is_home"), "component_id")
    found = lookup_join(narrow, homes, "fp", lookup.select("fp", "n"), total)
    first = found.where(F.col("is_home") & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("fp").agg(F.min("row").alias(row))
    return marked.join(first.select(row), row, "left_semi").select(*docs.columns)


def hex16(fp: str = "fp"):
    """Sixteen lower-case hex digits of a signed 64-bit column."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
