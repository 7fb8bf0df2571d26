"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Codes: a rotation of the leading principal directions is learned (ITQ: signs and
an orthogonal Procrustes fit in turn) on at most SAMPLE vectors drawn by a hash;
several rotations give 64 bits each. Tables: every code is cut into blocks a little
wider than the logarithm of the number of vectors, and a vector is filed once under
each block. The number of rotations is the least for which a pair at the threshold is
expected to share a block with `recall`.

A candidate is a pair that shares a block and whose first 64 bits differ in at most
`near_bits`; this depends on the pair alone, not on the table. In buckets of up to
LIGHT vectors only those that have a candidate go on, not pairs; in larger ones all
do. Their original vectors are then compared, in double precision, in tiles of
FILED x FILED vectors of a bucket, worked through in strips; a tile returns counts
and a star for each connected group, never pairs. A pair that meets in several
tables counts in the first of them only.

Equal vectors are one class and are not compared with each other. The work left
for a group of many different vectors that are all close is the counting itself. A
bucket of n vectors sends each of them to n / FILED tiles, and tiles are gathered
in groups of about ROWS rows, so what a task holds doesn't grow with a bucket.

Defined results: vectors that are null, empty, zero, hold null or non-finite
components, link with nothing; the vectors of each length are a group of their own,
compared with each other as any; a null id is counted as a row but names no component (component_id is null if none reachable
has an id, and kept is false); repeated rows link with each other; an empty table
gives an empty one; other columns, the label among them, are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import components, discard, importable, lookup_join, save, shared_folder

SAMPLE = 5000
#: Vectors of a bucket that are sifted by code alone, of a side of a tile, and of a strip; rows that a task should handle at once.
LIGHT, FILED, PROBING, ROWS = 256, 4096, 512, 20_000
#: Rows of a bucket, or of a thousandth of all, from which its size is broadcast.
HEAVY = 1000


@dataclass(frozen=True)
class Plan:
    threshold: float
    width: int
    rotations: int
    #: Of the first 64 bits, and of all, that the codes of two linked vectors may differ in.
    near_bits: int
    most_bits: int

    @property
    def blocks(self) -> int:
        return 64 // self.width

    def masks(self) -> list[tuple[int, int, int]]:
        """(table, rotation, unsigned mask of the block)."""
        one = (1 << self.width) - 1
        return [(r * self.blocks + b, r, one << (b * self.width)) for r in range(self.rotations) for b in range(self.blocks)]


def plan_for(n: int, threshold: float, recall: float = 0.99) -> Plan:
    """Block width from the number of vectors, rotations from the angle at the threshold."""
    width = min(32, max(8, math.ceil(math.log2(max(2, n))) + 2))
    p = math.acos(min(1.0, threshold)) / math.pi
    met = (1 - p) ** width
    tables = 1 if met >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - met))
    rotations = max(1, math.ceil(tables / (64 // width)))
    most = lambda bits: min(bits, math.ceil(p * bits + 6 * math.sqrt(bits * p * (1 - p))) + 1)
    return Plan(threshold, width, rotations, most(64), most(64 * rotations))


def fit(sample: np.ndarray, rotations: int, rounds: int = 30, seed: int = 11) -> np.ndarray:
    """(dimension, 64 * rotations): directions whose signs are the bits."""
    d = sample.shape[1]
    c = min(d, 64)
    rng = np.random.default_rng(seed)
    _, _, axes = np.linalg.svd(sample, full_matrices=False) if len(sample) else (0, 0, np.zeros((0, d)))
    if len(axes) < c:  # fewer vectors than directions
        axes = np.linalg.qr(np.concatenate([axes.T, rng.normal(size=(d, d))], axis=1))[0].T
    basis = axes[:c].T
    projected, out = sample @ basis, []
    for _ in range(rotations * math.ceil(64 / c)):
        turn = np.linalg.qr(rng.normal(size=(c, c)))[0]
        for _ in range(rounds if len(sample) else 0):
            u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
            turn = (u @ v).T
        out.append(basis @ turn)
    per = math.ceil(64 / c)
    return np.concatenate([np.concatenate(out[r * per : (r + 1) * per], axis=1)[:, :64] for r in range(rotations)], axis=1)


def codes(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Signed 64-bit words, one column for each rotation."""
    bits = (vectors @ directions >= 0).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(len(vectors), -1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if len(column) else np.zeros((0, d))


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, ok): v as doubles."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return kept.withColumn("ok", F.coalesce(F.when(v.isNotNull() & (F.size(v) > 0), finite & some), F.lit(False)))


def strips(n: int) -> list[slice]:
    return [slice(lo, min(n, lo + PROBING)) for lo in range(0, n, PROBING)]


def tile_links(x: np.ndarray, y: np.ndarray, near: tuple[np.ndarray, np.ndarray], other: np.ndarray, plan: Plan) -> np.ndarray:
    """Which vectors of y link with which of x; near holds their first 64 bits, other is False for a vector and itself."""
    out = np.empty((len(y), len(x)), bool)
    for at in strips(len(y)):
        out[at] = y[at] @ x.T >= plan.threshold
        if (link := out[at] & other[at]).any():
            link &= np.bitwise_count(near[0][at][:, None] ^ near[1][None, :]) <= plan.near_bits
        out[at] = link
    return out


def fresh(link: np.ndarray, words: tuple[np.ndarray, np.ndarray], earlier: list[tuple[int, int, int]]) -> np.ndarray:
    """The links of pairs that share a block in none of the earlier tables."""
    out = link.copy()
    for _, r, mask in earlier:
        a, b = (w[:, r] & np.uint64(mask) for w in words)
        for at in strips(len(a)):
            out[at] &= a[at][:, None] != b[None, :]
    return out


def settled(link: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest class of each connected group, for both sides: labels spread over the links until nothing changes."""
    none = np.iinfo(np.int64).max
    while True:
        to_y, to_x = y.copy(), x.copy()
        for at in strips(len(y)):
            to_y[at] = np.minimum(y[at], np.where(link[at], x[None, :], none).min(axis=1))
        for at in strips(len(y)):
            to_x = np.minimum(to_x, np.where(link[at], to_y[at][:, None], none).min(axis=0))
        if (to_y == y).all() and (to_x == x).all():
            return y, x
        y, x = to_y, to_x


def compare(table: pa.Table, plan: Plan, d: int) -> pa.Table:
    """Counts and connecting links of the tiles (t, k, i, j) in a group of rows; own is the chunk of the row."""
    col = {n: table.column(n).to_numpy() for n in ("t", "k", "i", "j", "own", "cid", "m")}
    vectors = matrix(table.column("v").combine_chunks(), d)
    words = matrix(table.column("code").combine_chunks(), plan.rotations).astype(np.int64).view(np.uint64)
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else vectors
    order = np.lexsort((col["cid"], col["own"], col["j"], col["i"], col["k"], col["t"]))
    keys = np.stack([col[n][order] for n in ("t", "k", "i", "j")], axis=1)
    cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])) if len(keys) else []
    masks, rows = plan.masks(), {"cid": [], "n": [], "root": []}
    for lo, hi in zip(cuts, cuts[1:]):
        at = order[lo:hi]
        t, _, i, j = (int(v) for v in keys[lo])
        y, x = at[col["own"][at] == i], at[col["own"][at] == j]
        if not len(x) or not len(y):
            continue
        cy, cx = col["cid"][y], col["cid"][x]
        link = tile_links(vectors[x], vectors[y], (words[y, 0], words[x, 0]), cy[:, None] != cx[None, :], plan)
        if not link.any():
            continue
        first = fresh(link, (words[y], words[x]), masks[:t])
        ly, lx = settled(link, cy, cx)
        sides = [(cy, first @ col["m"][x], ly)] + ([(cx, first.T @ col["m"][y], lx)] if i != j else [])
        for ids, n, roots in sides:
            some = (n > 0) | (roots != ids)
            rows["cid"].append(ids[some])
            rows["n"].append(n[some])
            rows["root"].append(roots[some])
    return pa.table({k: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for k, v in rows.items()})


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    importable(vectors.sparkSession)
    read = valid(vectors, id_col, vector_col)
    lengths = [r.d for r in read.where("ok").select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    out = read.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for d in lengths:
        out = of_length(read.where(F.col("ok") & (F.size("v") == d)), d, threshold).unionByName(out)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def of_length(read: DataFrame, d: int, threshold: float) -> DataFrame:
    """(vec_id, n_links, component_id) of valid vectors (vec_id, v) of d numbers."""
    spark = read.sparkSession
    folder = shared_folder(spark)
    key = F.concat_ws(":", F.xxhash64("v"), F.xxhash64("v", F.lit("again")))
    rows = read.select("vec_id", "v", key.alias("key"))
    grouped = rows.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = save(grouped.withColumn("cid", F.monotonically_increasing_id()), f"{folder}/classes")
    n = classes.count()
    plan = plan_for(n, threshold)

    share = min(1.0, 0.8 * SAMPLE / max(1, n))
    drawn = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v", "key").orderBy("key").limit(SAMPLE)
    sample = np.array([r.v for r in drawn.collect()]).reshape(-1, d)
    directions = spark.sparkContext.broadcast(fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), plan.rotations))

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            words = codes(matrix(batch, d), directions.value)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32()), pa.array(words.ravel()))

    coded = save(classes.select("cid", "m", "v", F.arrow_udf(encode, "array<long>")("v").alias("code")), f"{folder}/codes")

    filed = F.array(*[F.struct(F.lit(t).alias("t"), F.get("code", F.lit(r)).bitwiseAND(F.lit(signed(mask))).alias("k")) for t, r, mask in plan.masks()])
    files = coded.select("cid", F.get("code", F.lit(0)).alias("near"), F.explode(filed).alias("bucket"))
    sizes = save(files.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/sizes")
    chunks = sizes.select("bucket", F.when(F.col("n") <= min(LIGHT, FILED), 0).otherwise(F.ceil(F.col("n") / FILED)).cast("int").alias("chunks"))
    shared = lookup_join(files, chunks, "bucket", sizes, n * len(plan.masks()), HEAVY).where("chunks is not null")
    close = lambda x, y: (x["cid"] != y["cid"]) & (F.bit_count(x["near"].bitwiseXOR(y["near"])) <= plan.near_bits)
    light = shared.where("chunks = 0").groupBy("bucket").agg(F.collect_list(F.struct("cid", "near")).alias("all"))
    light = light.select("bucket", F.explode(F.filter("all", lambda x: F.exists("all", lambda y: close(x, y)))).alias("one")).select("bucket", "one.cid", F.lit(1).alias("chunks"))
    met = save(light.unionByName(shared.where("chunks > 0").select("bucket", "cid", "chunks")), f"{folder}/met")
    tiles = (
        met.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("bucket.t", "bucket.k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid")
    )
    groups = max(1, math.ceil((met.agg(F.sum("chunks")).first()[0] or 0) / ROWS))
    group = F.pmod(F.xxhash64("t", "k", "i", "j"), F.lit(groups)).alias("g")
    found = (
        tiles.join(coded, "cid")
        .select(group, "t", "k", "i", "j", "own", "cid", "m", "v", "code")
        .groupBy("g")
        .applyInArrow(lambda table: compare(table, plan, d), "cid long, n long, root long")
    )
    found = save(found, f"{folder}/found")
    for name in ("codes", "sizes", "met"):
        discard(spark, f"{folder}/{name}")
    linked = found.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = components(found.where("root <> cid").select(F.col("cid").alias("a"), F.col("root").alias("b")), folder)
    joined = (
        classes.select("key", "cid", "least", "m")
        .join(linked, "cid", "left")
        .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = joined.join(named, "root").select("key", "m", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    lookup = save(lookup, f"{folder}/lookup")
    counts = lookup.select("key", F.col("m").alias("n"))
    return lookup_join(rows.select("vec_id", "key"), lookup.drop("m"), "key", counts, n).select("vec_id", "n_links", "component_id")
