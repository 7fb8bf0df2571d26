import hashlib
import math
import re
from collections import defaultdict

import pytest

from tessera.llm import mixing, queries


def water(sizes, weights):
    """The contract's own words: cap at three times, share the excess by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(w[s] for s in open_)
        t = {s: left * w[s] / total for s in open_}
        above = [s for s in open_ if t[s] > 3 * sizes[s] * (1 + 1e-12)]
        if not above:
            return fixed | t
        for s in above:
            fixed[s] = 3.0 * sizes[s]
            left -= fixed[s]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += size(text)
    want = water(sizes, (5, 2, 1)) if sizes else {}
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        source = None if r.s == "b" else r.s[1:]
        assert r.target == pytest.approx(want[source]) and r.source_size == sizes[source]
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    return taken, want


def test_targets_and_edge_cases(spark):
    docs = [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}") for i in range(400)]
    docs += [(1000 + i, "x\ty\n" * 20, None) for i in range(30)]
    docs += [(2000, None, "empty"), (2001, " ", "empty"), (None, "a b c", "s1"), (None, "a b c", "s1"), (3000, "v " * 50_000, "long"), (7, "w " * 50, "s2"), (4000, "é", "Z"), (4001, "é è", "É")]
    df = spark.createDataFrame([(*d, "a", 2.0) for d in docs], "doc_id long, text string, source string, key string, target double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (3, 0, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mixed(df, labels).collect()
    taken, want = check(rows, docs)
    for s in ("s0", "s1", "s2", "s3", "s4", None):
        assert abs(taken[s] - want[s]) <= 30
    again = mixing.mixed(df.repartition(3), labels).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    kept = mixing.mixture(df, labels)
    assert kept.columns[:5] == df.columns and kept.columns[5:] == ["size", "source_size", "target_", "taken"]
    assert kept.count() == sum(r.taken > 0 for r in rows)


def test_prefix_is_by_exponential_keys(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    docs = [(i, "w " * 10, "a" if i < 100 else "b") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.mixed(df).collect()}

    def key(i):
        u = (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u)

    for ids in (range(100), range(100, 400)):
        epochs = math.floor(rows[ids[0]].target / rows[ids[0]].source_size + 1e-9)
        extra = [i for i in ids if rows[i].taken > epochs * 10]
        assert set(extra) == set(sorted(ids, key=key)[: len(extra)])
        assert abs(sum(rows[i].taken for i in ids) - rows[ids[0]].target) <= 10


def test_sf_and_empty(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in d.collect()]
    taken, want = check(mixing.mixed(d, spark.read.parquet(f"{sf}/labels.parquet")).collect(), docs)
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5
    assert mixing.mixed(d.where("false")).count() == 0
    assert "s" not in queries.op9_source_mixing(spark, sf).columns


def test_good_documents_are_drawn_more_often(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i % 2 else "b") for i in range(4000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i // 2 % 2, 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    low = [r for r in mixing.mixed(df, labels).collect() if r.s == "ab"]
    picked = [r for r in low if r.taken]
    assert sum(r.doc_id // 2 % 2 for r in picked) > 0.6 * len(picked)


def test_a_third_of_equal_rows_and_skewed_quality(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    docs = [(i, "w " * (1 + i * 13 % 90), f"s{i % 2}") for i in range(1200)] + [(None, "a b c", "s0")] * 500 + [(None, "a b", None)] * 100
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(1200)], "doc_id long, quality int")
    rows = mixing.mixed(df, labels).collect()
    taken, want = check(rows, docs)
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= 1600 for s in want)
    grouped = mixing.drawn(df, mixing.F.lit(0), labels, mixing.Mix())
    assert grouped.count() == 1202 and grouped.agg(mixing.F.sum("n")).first()[0] == len(docs)


def test_no_python_in_the_plans(spark, monkeypatch):
    plans, whole = [], mixing.save

    def kept(df, path):
        plans.append(df._jdf.queryExecution().toString())
        return whole(df, path)

    monkeypatch.setattr(mixing, "save", kept)
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    plans.append(mixing.mixed(docs, labels)._jdf.queryExecution().toString())
    plans.append(mixing.mixture(docs, labels)._jdf.queryExecution().toString())
    assert len(plans) > 10 and not any(w in p for p in plans for w in ("Python", "Pandas", "Arrow"))
