"""Perplexity under an interpolated modified Kneser-Ney trigram model.

Counting, in Spark: words become ids (their rank in the sorted array of word
hashes); every task packs its distinct trigrams and counts into compressed blocks
dealt by the middle word, so that a block's reader sees whole contexts (a, b) and
all left neighbours of (b, c) at once. Words over 1/(4 P) of all tokens, fewer
than 4 P, are spread by their left neighbour instead, and their continuation
counts merge in a second, small exchange. Nothing is pruned.

Store: for each of P parts one file in the shared folder with sorted arrays of
n-gram hashes (a table by the leading bits, then 32 bits for each entry) and their
counts. Workers map the files into memory and look up whole batches at once, so a
worker holds pages of what it reads and no copy of the model; tasks get the folder's
name, and find the layout, the heavy words and the list of files in files too. A file
that should be there and is not, as in a folder that isn't shared, raises. The folder
must be mounted as a file system; others are refused, and so are 2**32 words or more.
 A lookup of an n-gram that
was never seen is mistaken for another's with a probability of about 16 / 2**32.

    p3(w|u,v) = (c - D) / S(u,v) + G(u,v) p2(w|v), p2 and p1 likewise with counts of
    distinct left neighbours (plain counts after the start mark), p1 with the
    uniform distribution over the vocabulary and one unknown word.

Tokens: words of the lower-cased text (A-Z only), then one end. Defined results: a
null or empty text is the end alone; a null id is never held out; repeated rows
count as often as they occur; with nothing to learn from every probability is
uniform over the unknown word (score 0); an empty table gives an empty one. Texts of
any length are read whole, two megabytes or one longer text at a time. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import discard, importable, save, shared_folder
from tessera.llm.words import BY_SPACE, mix, slices, tokenize

#: The hash of the end of a text, which is counted as a word.
END = np.uint64(0x7E57E2D0FACE0FF1)
#: Tokens that a task holds before it packs them, and that a part should have.
HELD = 3_000_000
PART_TOKENS = 1_000_000
#: Parts that one task should build, and that one file of the finished model holds.
PARTS_PER_TASK, GROUP = 4, 64
#: Of each kind of file: its arrays and their types.
KINDS = {
    "words": {"hash": "<u8"},
    "two": {"two.table": "<u4", "two.keys": "<u4"},
    "three": {"three.table": "<u4", "three.keys": "<u4", "context.table": "<u4", "context.keys": "<u4"},
    "stats": {},
}
NUMBERS = {"words": ("count",), "two": ("two.count",), "three": ("three.count", *[f"context.{n}" for n in ("sum", "n1", "n2", "n3")]), "stats": ("sum", "n1", "n2", "n3", "left")}
KINDS = {k: v | {x: t for n in NUMBERS[k] for x, t in ((n, "|u1"), (f"{n}.at", "<u4"), (f"{n}.many", "<i8"))} for k, v in KINDS.items()}
KINDS["heavy"] = KINDS["two"]
UNKNOWN = -1
MOST_TASKS = 10_000


def local_path(folder: str) -> str:
    """The shared folder as the file system sees it."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"the model is mapped into memory: {folder} must be a mounted file system")
    return folder


# Blocks: integer arrays, delta-coded where sorted, split by byte and compressed.


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length; the first must be sorted."""
    n = len(arrays[0])
    head, body = [n], []
    for i, a in enumerate(arrays):
        a = a.astype(np.uint64)
        if i == 0 and n:
            a = np.diff(a, prepend=np.uint64(0))
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        head.append(width)
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(n, 8)[:, :width].T).tobytes())
    return np.array(head, "<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(data: bytes, arrays: int) -> list[np.ndarray]:
    head = np.frombuffer(data[: 8 * (arrays + 1)], "<u8")
    n, out, at = int(head[0]), [], 0
    body = zstandard.ZstdDecompressor().decompress(data[8 * (arrays + 1) :], max_output_size=max(1, int(n * head[1:].sum())))
    for i, width in enumerate(map(int, head[1:])):
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        a = a.view(np.uint64).reshape(n)
        out.append(np.cumsum(a, dtype=np.uint64) if i == 0 else a)
    return out


# Files of named arrays, mapped into memory.


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    write_pieces(path, {n: (a.dtype.str, len(a), [a]) for n, a in arrays.items()})


def write_pieces(path: str, arrays: dict[str, tuple[str, int, Iterable[np.ndarray]]]) -> None:
    """Type, length and pieces of each array. The file appears under its name when whole, so a task that runs again or twice does no harm."""
    at, head = 0, {}
    for name, (kind, n, _) in arrays.items():
        head[name] = [kind, n, at]
        at += -(-n * np.dtype(kind).itemsize // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for kind, n, pieces in arrays.values():
            for a in pieces:
                f.write(np.ascontiguousarray(a, kind).data)
            f.write(b"\0" * (-n * np.dtype(kind).itemsize % 8))
    os.replace(part, path)


@lru_cache(maxsize=16_384)
def read_arrays(path: str) -> dict[str, np.ndarray]:
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} of the model is gone or not shared with this machine")
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    return {name: np.frombuffer(data, kind, n, 8 + size + at) if n else np.zeros(0, kind) for name, (kind, n, at) in json.loads(data[8 : 8 + size]).items()}


#: Numbers are stored as bytes; this one stands for any that is as large or larger, which are listed by place.
MANY = 255


def in_bytes(arrays: dict[str, np.ndarray], kind: str) -> dict[str, np.ndarray]:
    out = dict(arrays)
    for name in NUMBERS[kind]:
        at = np.flatnonzero(arrays[name] >= MANY)
        out |= {name: np.minimum(arrays[name], MANY).astype(np.uint8), f"{name}.at": at.astype(np.uint32), f"{name}.many": arrays[name][at].astype(np.int64)}
    return out


def number(arrays: dict[str, np.ndarray], name: str, places: np.ndarray) -> np.ndarray:
    out = arrays[name][places].astype(np.int64)
    if len(many := np.flatnonzero(out == MANY)):
        out[many] = arrays[f"{name}.many"][np.searchsorted(arrays[f"{name}.at"], places[many])]
    return out


def hash_table(prefix: str, keys: np.ndarray, values: dict[str, np.ndarray], bits: int | None = None) -> dict[str, np.ndarray]:
    """Sorted hashes as a table by leading bits and 32 further bits, and numbers in their order."""
    order = np.argsort(keys)
    keys = keys[order]
    bits = bits or max(1, len(keys).bit_length() - 5)
    slots = (keys >> np.uint64(64 - bits)).astype(np.int64)
    rest = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    table = np.searchsorted(slots, np.arange((1 << bits) + 1)).astype(np.uint32)
    return {f"{prefix}.table": table, f"{prefix}.keys": rest} | {f"{prefix}.{k}": v[order] for k, v in values.items()}


def find(arrays: dict[str, np.ndarray], prefix: str, keys: np.ndarray, bits: int | None = None, local: np.ndarray | int = 0) -> np.ndarray:
    """The place of each key, or -1; local: which of a file's parts a key belongs to."""
    stored = arrays[f"{prefix}.keys"]
    if not len(keys) or not len(stored):
        return np.full(len(keys), -1)
    table = arrays[f"{prefix}.table"]
    bits = bits or (len(table) - 1).bit_length() - 1
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64) + (local << bits)
    rest = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    lo, end = table[slot].astype(np.int64), table[slot + 1].astype(np.int64)
    hi = end.copy()
    for _ in range(int((hi - lo).max()).bit_length()):
        mid = (lo + hi) >> 1
        below = (lo < hi) & (stored[np.minimum(mid, len(stored) - 1)] < rest)
        lo, hi = np.where(below, mid + 1, lo), np.where(below | (lo >= hi), hi, mid)
    found = (lo < end) & (stored[np.minimum(lo, len(stored) - 1)] == rest)
    return np.where(found, lo, -1)


def joined(pieces: list[dict[str, np.ndarray] | None], name: str, bits: int) -> Iterator[np.ndarray]:
    """One array of a file of several parts: the parts' arrays end to end, places and tables shifted; None is a part without any."""
    values = name.removesuffix(".at") if name.endswith(".at") else f"{name.removesuffix('.table')}.keys"
    shift = 0
    for x in pieces:
        if name.endswith(".table"):
            yield np.full(1 << bits, shift, np.uint32) if x is None else x[name][:-1] + np.uint32(shift)
        elif x is not None:
            yield x[name] + np.uint32(shift) if name.endswith(".at") else x[name]
        if x is not None and name.endswith((".table", ".at")):
            shift += len(x[values])
    if name.endswith(".table"):
        yield np.array([shift], np.uint32)


def merge(path: str, pieces: list[str | None], names: dict[str, str], bits: int) -> None:
    """Write a file of several parts and remove the parts' own files; nothing to do if an earlier run of the task has done so."""
    if os.path.exists(path):
        return
    read = [read_arrays.__wrapped__(p) if p else None for p in pieces]
    size = lambda n: sum(len(x) for x in joined(read, n, bits))
    write_pieces(path, {n: (kind, size(n), joined(read, n, bits)) for n, kind in names.items()})
    for p in pieces:
        if p and os.path.exists(p):
            os.unlink(p)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A bijection of two ids to 64 bits."""
    return mix(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))


def triple_key(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(pair_key(a, b) + c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Layout:
    """Where the model lies and how it is cut: what workers need to find their way.

    Parts are what a task builds at once; `group` of them are one file, so that a lookup
    of many n-grams opens few files. The file `layout` has bases, the id of each part's
    first word, and heavy, the sorted ids of heavy words.
    """

    folder: str
    parts: int
    bits: int
    words: int = 0
    tokens: int = 0
    texts: int = 0
    group: int = 64

    @property
    def bases(self) -> np.ndarray:
        return read_arrays(f"{self.folder}/layout")["bases"]

    @property
    def heavy(self) -> np.ndarray:
        return read_arrays(f"{self.folder}/layout")["heavy"]

    @property
    def start(self) -> int:
        """The id of the start mark, which is a part of its own behind the words'."""
        return self.words

    def path(self, kind: str, part: int) -> str:
        return f"{self.folder}/{kind}-{part:08d}"

    def read(self, kind: str, group: int) -> dict[str, np.ndarray]:
        return read_arrays(self.path(f"all-{kind}", group))

    def word_part(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(32)).astype(np.int64) * self.parts >> 32

    def id_part(self, ids: np.ndarray) -> np.ndarray:
        """The part of each word id."""
        return np.where(ids == self.start, self.parts, np.searchsorted(self.bases, ids, "right") - 1)

    def first_of(self, group: int) -> int:
        """The id of a group's first word."""
        return int(self.bases[min(group * self.group, self.parts)])

    def is_heavy(self, ids: np.ndarray) -> np.ndarray:
        heavy = self.heavy
        if not len(heavy):
            return np.zeros(len(ids), bool)
        return heavy[np.minimum(np.searchsorted(heavy, ids), len(heavy) - 1)] == ids

    def part_of(self, middle: np.ndarray, side: np.ndarray) -> np.ndarray:
        """The part of (side, middle) contexts or (middle, side) continuations."""
        alone = mix(middle.astype(np.uint64))
        spread = pair_key(middle, side)
        return (np.where(self.is_heavy(middle), spread, alone) % np.uint64(self.parts)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted word hashes, or UNKNOWN."""
        out = np.full(len(hashes), UNKNOWN, np.int64)
        for g, lo, hi in stretches(self.word_part(hashes) // self.group):
            known = self.read("words", g)["hash"]
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[lo:hi]), len(known) - 1)
                out[lo:hi] = np.where(known[at] == hashes[lo:hi], at + self.first_of(g), UNKNOWN)
        return out

    def word_values(self, kind: str, names: tuple[str, ...], ids: np.ndarray) -> list[np.ndarray]:
        """Values of sorted ids, 0 for UNKNOWN and for the start mark where a kind has none."""
        out = [np.zeros(len(ids), np.int64) for _ in names]
        known = int(np.searchsorted(ids, 0))
        for g, lo, hi in stretches(self.id_part(ids[known:]) // self.group):
            arrays, lo, hi = self.read(kind, g), lo + known, hi + known
            at = ids[lo:hi] - self.first_of(g)
            there = at < len(arrays[names[0]])
            for o, name in zip(out, names):
                o[lo:hi][there] = number(arrays, name, at[there])
        return out


def stretches(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of each run in sorted parts."""
    begin = runs(parts)
    for lo, hi in zip(begin, [*begin[1:], len(parts)]):
        yield int(parts[lo]), int(lo), int(hi)


def sequences(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each ending with END, and where each begins."""
    found, bounds = tokenize(texts, BY_SPACE)
    n = np.diff(bounds)
    starts = bounds[:-1] + np.arange(len(n))
    out = np.full(len(found) + len(n), END, np.uint64)
    out[np.arange(len(found)) + np.repeat(np.arange(len(n)), n)] = found
    return out, np.append(starts, len(out))


def trigrams(layout: Layout, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Ids (u, v, w) that end at each token, the distinct ids, each token's place among them, and texts' bounds."""
    hashes, bounds = sequences(texts)
    distinct, which = np.unique(hashes, return_inverse=True)
    known = layout.ids(distinct)
    w = known[which]
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    begin = bounds[:-1]
    v[begin] = layout.start
    u[begin] = layout.start
    second = begin[np.diff(bounds) > 1] + 1
    u[second] = layout.start
    return u, v, w, bounds


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where new rows begin in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, 5)]


def context_stats(counts: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    """Sum, and numbers of counts 1, 2 and more, of each context."""
    add = lambda x: np.add.reduceat(x.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    return {"sum": add(counts), "n1": add(counts == 1), "n2": add(counts == 2), "n3": add(counts > 2)}


OUT = "kind string, part long, data binary, numbers array<long>"
OUT_SCHEMA = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("data", pa.binary()), ("numbers", pa.list_(pa.int64()))])


def out_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], OUT_SCHEMA.field(i).type) for i in range(4)], schema=OUT_SCHEMA)


def unigram_blocks(layout: Layout, b: np.ndarray, c: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """What rows (b, c, count), sorted by b, tell of their words: b as a context, c as a continuation."""
    begin = runs(b)
    stats = context_stats(counts, begin)
    right, times = np.unique(c, return_counts=True)
    ids = np.union1d(b[begin], right)
    columns = {k: np.zeros(len(ids), np.int64) for k in ("sum", "n1", "n2", "n3", "left")}
    for k, v in stats.items():
        columns[k][np.searchsorted(ids, b[begin])] = v
    columns["left"][np.searchsorted(ids, right)] = times
    return [("word", p, pack(ids[lo:hi], *[x[lo:hi] for x in columns.values()]), None) for p, lo, hi in stretches(layout.id_part(ids))]


def bigram_part(layout: Layout, kind: str, part: int, b: np.ndarray, c: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Store final continuation counts and pass on what they tell of single words."""
    write_arrays(layout.path(kind, part), in_bytes(hash_table("two", pair_key(b, c), {"count": counts}, layout.bits), "two"))
    return [(f"counts2 {kind}", part, None, counts_of_counts(counts)), *unigram_blocks(layout, b, c, counts)]


def trigram_part(layout: Layout, part: int, blocks: list[bytes]) -> list[tuple]:
    """Merge a part's trigrams, store them and their contexts, and pass on continuation counts."""
    columns = [np.concatenate(x) for x in zip(*[unpack(d, 3) for d in blocks])]
    order = np.lexsort((columns[1], columns[0]))
    ba, c, n = (x[order] for x in columns)
    begin = runs(ba, c)
    n = np.add.reduceat(n.astype(np.int64), begin)
    ba, c = ba[begin], c[begin].astype(np.int64)
    b, a = (ba >> np.uint64(32)).astype(np.int64), (ba & np.uint64(0xFFFFFFFF)).astype(np.int64)
    context = runs(ba)
    arrays = hash_table("three", triple_key(a, b, c), {"count": n}, layout.bits)
    arrays |= hash_table("context", pair_key(a[context], b[context]), context_stats(n, context), layout.bits)
    write_arrays(layout.path("three", part), in_bytes(arrays, "three"))
    out = [("counts3 three", part, None, counts_of_counts(n))]
    # Distinct left neighbours of (b, c); after the start mark, plain counts.
    order = np.lexsort((c, b))
    b, c, n = b[order], c[order], np.where(b[order] == layout.start, n[order], 1)
    begin = runs(b, c)
    b, c, n = b[begin], c[begin], np.add.reduceat(n, begin)
    heavy = layout.is_heavy(b)
    out += bigram_part(layout, "two", part, b[~heavy], c[~heavy], n[~heavy])
    if heavy.any():
        b, c, n = b[heavy], c[heavy], n[heavy]
        to = layout.part_of(b, c)
        for p in np.unique(to):
            x = to == p
            out.append(("heavy", int(p), pack(b[x].astype(np.uint64) << np.uint64(32) | c[x].astype(np.uint64), n[x]), None))
    return out


def heavy_part(layout: Layout, part: int, blocks: list[bytes]) -> list[tuple]:
    columns = [np.concatenate(x) for x in zip(*[unpack(d, 2) for d in blocks])]
    order = np.argsort(columns[0])
    bc, n = columns[0][order], columns[1][order].astype(np.int64)
    begin = runs(bc)
    bc, n = bc[begin], np.add.reduceat(n, begin)
    return bigram_part(layout, "heavy", part, (bc >> np.uint64(32)).astype(np.int64), (bc & np.uint64(0xFFFFFFFF)).astype(np.int64), n)


def word_part(layout: Layout, part: int, blocks: list[bytes]) -> list[tuple]:
    columns = [np.concatenate(x) for x in zip(*[unpack(d, 6) for d in blocks])]
    base = layout.bases[part] if part < layout.parts else layout.start
    size = int(layout.bases[part + 1] - base) if part < layout.parts else 1
    at = columns[0].astype(np.int64) - base
    names = ("sum", "n1", "n2", "n3", "left")
    totals = {k: np.bincount(at, v.astype(np.float64), size).astype(np.int64) for k, v in zip(names, columns[1:])}
    write_arrays(layout.path("stats", part), in_bytes(totals, "stats"))
    left = totals["left"]
    return [("counts1 stats", part, None, [*counts_of_counts(left), int((left > 2).sum()), int(left.sum())])]


def grouped(df: DataFrame, layout: Layout, work) -> DataFrame:
    """Rows (part, data) gathered by part and handed to work(layout, part, blocks)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return out_table(work(layout, key[0].as_py(), table.column("data").to_pylist()))

    return by_parts(df, layout.parts).groupBy("part").applyInArrow(run, OUT)


def by_parts(df: DataFrame, parts: int) -> DataFrame:
    """df dealt by part over a number of tasks that grows with the parts, so a task has a few of them at any size."""
    tasks = -(-parts // PARTS_PER_TASK)
    return df.repartition(tasks, "part") if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def count_words(rows: DataFrame) -> DataFrame:
    """(hash, n) of all tokens of column t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            names, which = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(which, np.concatenate([c for _, c in held]), len(names)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], names=["hash", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in slices(texts):
                held.append(np.unique(sequences(texts[lo:hi])[0], return_counts=True))
                if sum(len(h) for h, _ in held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return rows.select("t").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def trigram_blocks(rows: DataFrame, layout: Layout) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            a, b, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            ba = b.astype(np.uint64) << np.uint64(32) | a.astype(np.uint64)
            order = np.lexsort((c, ba))
            ba, c = ba[order], c[order]
            begin = runs(ba, c)
            n = np.diff(np.append(begin, len(c)))
            ba, c = ba[begin], c[begin]
            to = layout.part_of((ba >> np.uint64(32)).astype(np.int64), (ba & np.uint64(0xFFFFFFFF)).astype(np.int64))
            order = np.argsort(to.astype(np.int32), kind="stable")
            ba, c, n = ba[order], c[order], n[order]
            blocks = [(p, pack(ba[lo:hi], c[lo:hi], n[lo:hi])) for p, lo, hi in stretches(to[order])]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blocks], pa.int64()), pa.array([d for _, d in blocks], pa.binary())], names=["part", "data"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in slices(texts):
                held.append(tuple(x.astype(np.uint32) for x in trigrams(layout, texts[lo:hi])[:3]))
                if sum(len(h[0]) for h in held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return rows.select("t").mapInArrow(run, "part long, data binary")


@dataclass
class Model:
    layout: Layout
    discounts: list[list[float]]
    #: Of continuation counts of single words: their sum, and the mass left for the uniform distribution.
    left_sum: int = 0
    left_mass: float = 1.0

    def lessened(self, order: int, counts: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[order - 1]])
        return counts - d[np.minimum(counts, 3)]

    def backoff(self, order: int, n1, n2, n3, total) -> np.ndarray:
        d = self.discounts[order - 1]
        return np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)

    def token_scores(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 p and the training count of every token, and where each text's tokens begin."""
        lay = self.layout
        u, v, w, bounds = trigrams(lay, texts)
        ids, which = np.unique(np.concatenate([v, w]), return_inverse=True)
        known = ids != UNKNOWN
        left, total, n1, n2, n3 = lay.word_values("stats", ("left", "sum", "n1", "n2", "n3"), ids)
        (count,) = lay.word_values("words", ("count",), ids)
        p1 = np.where(known & (left > 0), self.lessened(1, left) / max(1, self.left_sum), 0.0) + self.left_mass / (lay.words + 1)
        after, word = which[: len(v)], which[len(v) :]
        count2 = self.counts("two", v, w)
        p2 = np.where(count2 > 0, self.lessened(2, count2) / np.maximum(total[after], 1), 0.0) + self.backoff(2, n1, n2, n3, total)[after] * p1[word]
        count3, (sums, m1, m2, m3) = self.counts3(u, v, w)
        p3 = np.where(count3 > 0, self.lessened(3, count3) / np.maximum(sums, 1), 0.0) + self.backoff(3, m1, m2, m3, sums) * p2
        return np.log10(p3), count[word], bounds

    def counts(self, prefix: str, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Continuation counts of (b, c)."""
        lay, out = self.layout, np.zeros(len(b), np.int64)
        live = np.flatnonzero((b != UNKNOWN) & (c != UNKNOWN))
        heavy = lay.is_heavy(b[live])
        for kind, rows in (("two", live[~heavy]), ("heavy", live[heavy])):
            part = lay.part_of(b[rows], c[rows])
            for g, x in by_group(part // lay.group):
                at, arrays = rows[x], lay.read(kind, g)
                place = find(arrays, prefix, pair_key(b[at], c[at]), lay.bits, part[x] % lay.group)
                hit = place >= 0
                out[at[hit]] = number(arrays, f"{prefix}.count", place[hit])
        return out

    def counts3(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Counts of trigrams, and sums and numbers of their contexts."""
        lay, out = self.layout, np.zeros(len(a), np.int64)
        stats = [np.zeros(len(a), np.int64) for _ in range(4)]
        live = np.flatnonzero((a != UNKNOWN) & (b != UNKNOWN))
        part = lay.part_of(b[live], a[live])
        for g, x in by_group(part // lay.group):
            at, local, arrays = live[x], part[x] % lay.group, lay.read("three", g)
            place = find(arrays, "context", pair_key(a[at], b[at]), lay.bits, local)
            at, local, place = (v[place >= 0] for v in (at, local, place))
            for s, name in zip(stats, ("sum", "n1", "n2", "n3")):
                s[at] = number(arrays, f"context.{name}", place)
            at, local = (v[c[at] != UNKNOWN] for v in (at, local))
            place = find(arrays, "three", triple_key(a[at], b[at], c[at]), lay.bits, local)
            hit = place >= 0
            out[at[hit]] = number(arrays, "three.count", place[hit])
        return out, stats


def by_group(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group, and its places."""
    order = np.argsort(groups.astype(np.int32), kind="stable")
    for g, lo, hi in stretches(groups[order]):
        yield g, order[lo:hi]


def discounts_of(t: list[int]) -> list[float]:
    """Chen and Goodman's discounts from numbers of counts 1 to 4; fixed ones where the numbers can't tell."""
    if min(t[:4]) == 0:
        return [0.5, 1.0, 1.5]
    y = t[0] / (t[0] + 2 * t[1])
    d = [k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3)]
    return d if all(0 < x <= k for x, k in zip(d, (1, 2, 3))) else [0.5, 1.0, 1.5]


def fit(docs: DataFrame, learn: Column, text_col: str = "text") -> Model:
    """Count the rows for which learn holds and store their model in the shared folder."""
    spark = docs.sparkSession
    importable(spark)
    shared = shared_folder(spark)
    folder = local_path(shared)
    os.makedirs(f"{folder}/model")
    rows = docs.where(learn).select(F.col(text_col).cast("string").cast("binary").alias("t"))
    size, texts = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)), F.count("*")).first()
    parts = max(4, 1 << (int(size / 6 / PART_TOKENS)).bit_length())
    layout = Layout(f"{folder}/model", parts, max(1, PART_TOKENS.bit_length() - 5), texts=texts, group=GROUP)
    if not texts:
        write_arrays(f"{layout.folder}/layout", {"bases": np.zeros(parts + 1, np.int64), "heavy": np.zeros(0, np.int64)})
        for kind in KINDS:
            merged(spark, layout, kind, spark.createDataFrame([], "part long"))
        return Model(layout, [[0.5, 1.0, 1.5]] * 3)

    def store_words(key: tuple, table: pa.Table) -> pa.Table:
        h, n = table.column("hash").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(h)
        write_arrays(layout.path("words", key[0].as_py()), in_bytes({"hash": h[order], "count": n[order]}, "words"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    part = (F.shiftrightunsigned("hash", 32) * F.lit(parts) / F.lit(float(1 << 32))).cast("long")
    counted = count_words(rows).select("hash", "n", part.alias("part"))
    stored = save(by_parts(counted, parts).groupBy("part").applyInArrow(store_words, "part long, words long, tokens long"), f"{shared}/words")
    merged(spark, layout, "words", stored)
    sizes = stored.toPandas()  # three numbers for each part
    held = np.zeros(parts, np.int64)
    held[sizes.part] = sizes.words
    layout = Layout(layout.folder, parts, layout.bits, int(held.sum()), int(sizes.tokens.sum()), texts, layout.group)
    if layout.words >= (1 << 32) - 1:
        raise ValueError(f"{layout.words} words: ids have 32 bits")
    bases = np.concatenate([[0], np.cumsum(held)])
    write_arrays(f"{layout.folder}/layout", {"bases": bases, "heavy": heavy_words(spark, layout, bases)})

    made = save(grouped(trigram_blocks(rows, layout), layout, trigram_part), f"{shared}/trigrams")
    merged(spark, layout, "three", made.where("kind = 'counts3 three'"))
    merged(spark, layout, "two", made.where("kind = 'counts2 two'"))
    more = save(grouped(made.where("kind = 'heavy'").select("part", "data"), layout, heavy_part), f"{shared}/heavy")
    merged(spark, layout, "heavy", more.where("kind = 'counts2 heavy'"))
    both = made.unionByName(more)
    last = save(grouped(both.where("kind = 'word'").select("part", "data"), layout, word_part), f"{shared}/single")
    merged(spark, layout, "stats", last.where("kind = 'counts1 stats'"))
    totals = {}
    for r in both.unionByName(last).where("kind like 'counts%'").groupBy(F.substring("kind", 1, 7).alias("kind")).agg(*[F.sum(F.get("numbers", F.lit(i))).alias(f"x{i}") for i in range(6)]).collect():
        totals[r.kind] = [r[f"x{i}"] for i in range(6)]
    for name in ("words", "trigrams", "heavy", "single"):
        discard(spark, f"{shared}/{name}")
    discounts = [discounts_of(totals.get(f"counts{k}", [0] * 4)) for k in (1, 2, 3)]
    t1, t2, _, _, t3, total = totals["counts1"]
    mass = (discounts[0][0] * t1 + discounts[0][1] * t2 + discounts[0][2] * t3) / total
    return Model(layout, discounts, total, mass)


def merged(spark: SparkSession, layout: Layout, kind: str, made: DataFrame) -> None:
    """Join the files of the parts in `made` into one for each group, empty ones included, so that every file must be there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, has in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = range(group * layout.group, min((group + 1) * layout.group, layout.parts + 1))
                merge(layout.path(f"all-{kind}", group), [layout.path(kind, p) if p in set(has or ()) else None for p in parts], KINDS[kind], layout.bits)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["group"])

    groups = layout.parts // layout.group + 1
    has = made.groupBy(F.floor(F.col("part") / layout.group).cast("long").alias("group")).agg(F.collect_set("part").alias("parts"))
    every = spark.range(0, groups, 1, 1).withColumnRenamed("id", "group").join(has, "group", "left").repartition(min(groups, MOST_TASKS), "group")
    every.mapInArrow(run, "group long").write.format("noop").mode("overwrite").save()


def heavy_words(spark: SparkSession, layout: Layout, bases: np.ndarray) -> np.ndarray:
    """Sorted ids of words with over 1 / (4 P) of all tokens, fewer than 4 P, and of the start mark; each group names its own."""
    least, groups = layout.tokens / (4 * layout.parts), layout.parts // layout.group + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                arrays = layout.read("words", g)
                found = np.flatnonzero(number(arrays, "count", np.arange(len(arrays["count"]))) > least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), g)), pa.array(found)], names=["g", "at"])

    found = spark.range(0, groups, 1, min(groups, MOST_TASKS)).mapInArrow(run, "g long, at long").toPandas()
    return np.sort(np.append(bases[found.g.to_numpy(np.int64) * layout.group] + found["at"].to_numpy(np.int64), layout.start)).astype(np.int64)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row; scores are log10 probabilities."""
    importable(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay = model.layout
        for batch in batches:
            texts, parts = batch.column(1).to_pylist(), []
            for lo, hi in slices(texts):
                logs, counts, bounds = model.token_scores(texts[lo:hi])
                base = np.log10((counts + 0.5) / (lay.tokens + 0.5 * (lay.words + 1)))
                begin = bounds[:-1]
                parts.append([np.diff(bounds), np.add.reduceat((counts > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(logs, begin)])
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return kept.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def perplexities(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """Scores of all rows under a model of those not held out, with held_out, train_tokens and perplexity."""
    out = held_out(F.col("doc_id"), folds, fold)
    model = fit(docs.select("doc_id", "text"), ~out)
    return scored(docs, model).select(
        "doc_id",
        out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.layout.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
