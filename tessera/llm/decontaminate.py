"""Benchmark decontamination by suffix arrays of the training texts.

Each slice of documents becomes a shard: its words in order, a separator after
each document, and the array of all its suffixes sorted by their first `window`
words (prefix doubling; only tied suffixes are sorted again). Every test suffix
of the benchmark is binary-searched in every shard, one word deeper at a time, so
a range of the array holds all places where a window occurs. Windows at
neighbouring places on one diagonal are one longer verbatim match.

Texts never leave their task: no shuffle. The benchmark's words are broadcast, if
there are no more than MOST_BYTES of text; a larger benchmark is dealt into parts, each
of which passes over all documents, and the parts' matches are merged by document. One
item is never cut.

Defined results: a null text has no words, one of any length is a shard by itself; an
item without words has no window; an item with a null id marks words but is not
listed; repeated items and repeated documents are each treated as rows of their own,
an id is listed once for a document; an empty benchmark leaves all clean; ids may be of
any type; columns other than the ids and texts are passed on, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.tables import free_name, importable, save, shared_folder
from tessera.llm.words import BY_ALNUM, slices, tokenize

WINDOW = 8
#: Of benchmark text that may be broadcast.
MOST_BYTES = 64 << 20


@dataclass
class Tests:
    """The benchmark's words, and its windows: the first word, the length and the item of each."""

    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    ids: list
    begins: np.ndarray


def tests_of(items: list[tuple[int | None, bytes | None]], window: int) -> Tests:
    words, bounds = tokenize([t for _, t in items], BY_ALNUM)
    starts, lengths, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        if n := int(hi - lo):
            s = np.arange(lo, lo + max(1, n - window + 1))
            starts.append(s)
            lengths.append(np.full(len(s), min(n, window)))
            owner.append(np.full(len(s), i))
    return Tests(words, np.concatenate(starts), np.concatenate(lengths), np.concatenate(owner), [d for d, _ in items], bounds[:-1])


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first depth words."""
    n = len(words)
    order = np.argsort(words)
    ranks = np.empty(n + 1, np.int64)
    ranks[n] = -1
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    ranks[order] = np.maximum.accumulate(np.where(new, at, 0))
    k = 1
    while k < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        pos = order[slots]
        key = ranks[pos] * (n + 1) + ranks[np.minimum(pos + k, n)] + 1
        by = np.argsort(key)
        pos, key = pos[by], key[by]
        order[slots] = pos
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] = fresh
        ranks[pos] = np.maximum.accumulate(np.where(fresh, slots, 0))
        k *= 2
    return order


def occurrences(words: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Places in words, and the window that stands there, for all occurrences."""
    padded = np.concatenate([words, np.zeros(int(tests.lengths.max(initial=0)) + 1, np.uint64)])
    first = words[order]
    live = np.arange(len(tests.starts))
    target = tests.words[tests.starts]
    lo, hi = np.searchsorted(first, target, "left"), np.searchsorted(first, target, "right")
    places, windows, depth = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    while True:
        keep = lo < hi
        live, lo, hi = live[keep], lo[keep], hi[keep]
        done = tests.lengths[live] == depth
        counts = (hi - lo)[done]
        if total := int(counts.sum()):
            offset = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            places.append(order[np.repeat(lo[done], counts) + offset])
            windows.append(np.repeat(live[done], counts))
        live, lo, hi = live[~done], lo[~done], hi[~done]
        if not len(live):
            return np.concatenate(places), np.concatenate(windows)
        target = tests.words[tests.starts[live] + depth]
        ends = []
        for below in (np.less, np.less_equal):
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                right = open_ & below(padded[order[np.minimum(mid, len(order) - 1)] + depth], target)
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            ends.append(a)
        lo, hi = ends
        depth += 1


def longest_runs(places: np.ndarray, tests: Tests, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of maximal verbatim matches, and the window each begins with: windows one after another in both texts."""
    begin = tests.starts[windows]
    by = np.lexsort((places, places - begin))
    p, d, item = places[by], (places - begin)[by], tests.items[windows][by]
    new = np.ones(len(p), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (item[1:] != item[:-1])
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(p)) - 1
    return p[heads], p[ends] - p[heads] + tests.lengths[windows][by][heads], windows[by][heads]


@dataclass
class Found:
    """Of each text: its words, those hit, the longest match, the items found, and (item, start, item_start, length) of each maximal match."""

    n_words: np.ndarray
    n_hit: np.ndarray
    longest: np.ndarray
    items: list[list]
    matches: list[list[tuple]]


def search(texts: list[bytes | None], tests: Tests, window: int) -> Found:
    found, bounds = tokenize(texts, BY_ALNUM)
    n_words = np.diff(bounds)
    words = np.zeros(len(found) + len(texts), np.uint64)
    words[np.arange(len(found)) + np.repeat(np.arange(len(texts)), n_words)] = found
    starts = bounds[:-1] + np.arange(len(texts))
    out = Found(n_words, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [[] for _ in texts], [[] for _ in texts])
    if not len(found) or not len(tests.starts):
        return out
    places, windows = occurrences(words, suffix_array(words, window), tests)
    if len(places):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + tests.lengths[windows], -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
        out.n_hit = covered[starts + n_words] - covered[starts]
        heads, lengths, opening = longest_runs(places, tests, windows)
        owner = np.searchsorted(starts, heads, "right") - 1
        np.maximum.at(out.longest, owner, lengths)
        item, first = tests.items[opening], tests.starts[opening] - tests.begins[tests.items[opening]]
        for i, k, at, begin, n in zip(owner.tolist(), item.tolist(), (heads - starts[owner]).tolist(), first.tolist(), lengths.tolist()):
            out.matches[i].append((tests.ids[k], at, begin, n))
            if tests.ids[k] is not None:
                out.items[i].append(tests.ids[k])
    out.items = [sorted(set(x)) for x in out.items]
    return out


def shard(texts: list[bytes | None], tests: Tests, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list]]:
    """Of each text: its words, those hit, the longest match, and the items found."""
    found = search(texts, tests, window)
    return found.n_words, found.n_hit, found.longest, found.items


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").cast("binary").alias("t"))


def text_bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.length("t"))).first()[0] or 0


def scanner(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text"):
    """A function from a text column to struct<n_words, n_hit, longest, items, matches>, for a benchmark that may be broadcast."""
    items = items_of(benchmark, id_col, text_col)
    if (size := text_bytes(items)) > MOST_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text, over {MOST_BYTES}: give it in parts")
    return searcher(items, window)


def searcher(items: DataFrame, window: int):
    spark = items.sparkSession
    importable(spark)
    kind = items.schema["i"].dataType
    sent = spark.sparkContext.broadcast(tests_of([(r.i, bytes(r.t) if r.t is not None else None) for r in items.collect()], window))
    name = to_arrow_type(kind)
    match = pa.struct([("item", name), ("start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())])
    shape = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(name)), ("matches", pa.list_(match))])

    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            values, parts = batch.to_pylist(), []
            for lo, hi in slices(values):
                found = search(values[lo:hi], sent.value, window)
                matches = [[dict(zip(("item", "start", "item_start", "length"), m)) for m in x] for x in found.matches]
                columns = [pa.array(found.n_words), pa.array(found.n_hit), pa.array(found.longest), pa.array(found.items, pa.list_(name)), pa.array(matches, pa.list_(match))]
                parts.append(pa.StructArray.from_arrays(columns, fields=list(shape)))
            yield pa.concat_arrays(parts) if parts else pa.array([], shape)

    id_type = kind.simpleString()
    ddl = f"n_words long, n_hit long, longest long, items array<{id_type}>, matches array<struct<item:{id_type},start:bigint,item_start:bigint,length:bigint>>"
    return lambda text: F.arrow_udf(scan, ddl).asNondeterministic()(text.cast("string").cast("binary"))


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "item_id") -> tuple[DataFrame, str]:
    """docs with one more column, struct<n_words, n_hit, longest, items, matches>, and its name.

    matches: (item, start, item_start, length) of each maximal verbatim match, in words from 0.
    """
    name = free_name(docs, "hits")
    items = items_of(benchmark, id_col, "text")
    if (size := text_bytes(items)) <= MOST_BYTES:
        return docs.withColumn(name, searcher(items, window)(F.col(text_col))), name
    spark, row = docs.sparkSession, free_name(docs, "row")
    folder = shared_folder(spark)
    numbered = save(docs.withColumn(row, F.monotonically_increasing_id()), f"{folder}/documents")
    parts = math.ceil(2 * size / MOST_BYTES)
    dealt = save(items.distinct().withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts))), f"{folder}/items")
    passes = []
    for k in range(parts):
        found = numbered.select(F.col(row).alias("row"), searcher(dealt.where(F.col("part") == k).select("i", "t"), window)(F.col(text_col)).alias("h"))
        found = found.select("row", "h.n_words", "h.longest", "h.items", "h.matches")
        passes.append(save(found if k == 0 else found.where(F.size("matches") > 0), f"{folder}/pass-{k}"))
    every = reduce(DataFrame.unionByName, passes)
    flat = lambda c: F.flatten(F.collect_list(c))
    merged = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.max("longest").alias("longest"), F.array_sort(F.array_distinct(flat("items"))).alias("items"), flat("matches").alias("matches"))
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["length"]).alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda s, m: F.struct((s["n"] + F.greatest(m["end"] - F.greatest(m["start"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], m["end"]).alias("upto"))
    hits = merged.select(F.col("row").alias(row), F.struct("n_words", F.aggregate(spans, zero, step, lambda s: s["n"]).alias("n_hit"), "longest", "items", "matches").alias(name))
    return numbered.join(hits, row).select(*docs.columns, name), name


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


def contaminated(hits: Column, least_items: int = 2) -> Column:
    return F.size(hits["items"]) >= least_items


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = 1) -> DataFrame:
    """docs without those that hold windows of least_items benchmark items or more."""
    found, name = with_hits(docs, benchmark, window)
    return found.where(~contaminated(F.col(name), least_items)).select(*docs.columns)
