import hashlib
import re

import numpy as np
import pytest

from tessera.llm import decontaminate as d
from tessera.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=8):
    out = []
    windows = {}
    for i, t in items:
        w = words(t)
        if w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    for doc, t in docs:
        w, hit, names = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        names.discard(None)
        digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, len(names) >= 2))
    return sorted(out, key=str)


def answer(docs, items, window=8):
    found, name = d.with_hits(docs, items, window)
    h = d.F.col(name)
    rows = found.select("doc_id", h["n_words"], h["n_hit"], d.F.size(h["items"]), d.items_digest(h["items"]), d.contaminated(h)).collect()
    return sorted(map(tuple, rows), key=str)


def test_edge_cases_against_brute_force(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [(1, a), (2, "Beta-Gamma; delta epsilon ZETA eta theta iota kappa lambda"), (3, "solo"), (4, None), (5, ""), (None, "mu nu xi"), (7, a), (7, a), (30, "ümlaut wörd çé")]
    docs = [(1, "so " + a.upper() + " lambda end"), (2, a[:-6]), (2, a[:-6]), (3, None), (4, ""), (None, "mu nu xi"), (5, "Solo." * 3), (6, "ümlaut WöRD çé x"), (7, (a + " ") * 400), (8, "alpha beta gamma delta"), (9, "... !!"), (10, "x " * 200_000 + a)]
    ddf = spark.createDataFrame([(i, t, "c", [1]) for i, t in docs], "doc_id long, text string, hits string, items array<int>")
    bdf = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, n_hit string")
    assert answer(ddf, bdf) == brute(docs, items)
    kept = d.decontaminated(ddf, bdf)
    assert kept.columns == ddf.columns
    assert {r.doc_id for r in kept.collect()} == {None, 3, 4, 8, 9}


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert answer(docs, none) == brute([(1, "a b")], [])
    assert answer(docs.where("false"), none) == []


def test_sf_tables_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()]
    rows = queries.op8_suffix_decontamination(spark, sf).collect()
    expected = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert sorted(map(tuple, rows), key=str) == expected
    assert any(r.n_hit for r in rows)


def test_suffix_array_sorts_by_depth():
    w = np.random.default_rng(0).integers(1, 4, 500).astype(np.uint64)
    order = d.suffix_array(w, 8)
    keys = [tuple(w[i : i + 8]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(500))


def test_longest_match():
    tests = d.tests_of([(1, b"a b c d e f g h i j k l")], 8)
    _, hit, longest, items = d.shard([b"x b c d e f g h i j k y", b"a b c d e f g z"], tests, 8)
    assert list(hit) == [10, 0] and list(longest) == [10, 0] and items == [[1], []]


def test_oversized_benchmark_is_refused(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST_BYTES", 3)
    with pytest.raises(ValueError, match="in parts"):
        d.scanner(spark.createDataFrame([(1, "abcd")], "item_id long, text string"))


def test_a_large_benchmark_passes_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 30, n))
    items = [(i, text(20)) for i in range(25)] + [(3, None), (None, text(9)), (7, "solo"), (8, "long " * 200)]
    docs = [(i, text(15) + " " + items[i % 25][1] + " x " + items[(i * 7) % 25][1][:40] + " solo") for i in range(30)] + [(100, None), (101, ""), (102, "long " * 500), (102, "long " * 500), (103, items[26][1])]
    ddf = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, hits string, row int")
    bdf = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, str(sorted(map(str, r.h.matches))), r.h.longest) for r in d.with_hits(ddf, bdf)[0].select("doc_id", d.F.col("hits_").alias("h")).collect()}
    monkeypatch.setattr(d, "MOST_BYTES", 400)
    assert answer(ddf, bdf) == brute(docs, items)
    parts = {(r.doc_id, str(sorted(map(str, r.h.matches))), r.h.longest) for r in d.with_hits(ddf, bdf)[0].select("doc_id", d.F.col("hits_").alias("h")).collect()}
    assert parts == whole
    kept = d.decontaminated(ddf, bdf)
    assert kept.columns == ddf.columns and {r.doc_id for r in kept.collect()} == {100, 101, 103}


def test_locations_and_ids_of_any_type(spark):
    bdf = spark.createDataFrame([("b-2", "a b c d e f g h i j"), ("b-10", "p q r")], "item_id string, text string")
    ddf = spark.createDataFrame([(1, "x c d e f g h i j y P Q R a b c d e f g h i")], "doc_id long, text string")
    r = d.with_hits(ddf, bdf)[0].first().hits
    assert r["items"] == ["b-10", "b-2"] and r.longest == 9 and r.n_hit == 8 + 3 + 9
    assert sorted((m["item"], m.start, m.item_start, m.length) for m in r.matches) == [("b-10", 10, 0, 3), ("b-2", 1, 2, 8), ("b-2", 13, 0, 9)]
