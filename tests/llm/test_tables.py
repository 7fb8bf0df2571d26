import numpy as np

from tessera.llm import tables


def smallest(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_of_hubs_chains_and_cliques(spark, monkeypatch):
    monkeypatch.setattr(tables, "HEAVY_LEAST", 20)
    rng = np.random.default_rng(1)
    edges = [(5000, i) for i in range(300)] + [(7000 + i, 6000) for i in range(200)] + [(10_000 + i, 10_001 + i) for i in range(120)]
    edges += [(int(a), int(b)) for a, b in rng.integers(20_000, 20_400, (300, 2)) if a != b] + [(1, 1), (30_000, 5000), (30_000, 6000), (5000, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    folder = tables.shared_folder(spark)
    got = {r.node: r.root for r in tables.components(df, folder).collect()}
    assert got == {x: r for x, r in smallest([e for e in edges if e[0] != e[1]]).items()}
    none = tables.components(df.where("false"), tables.shared_folder(spark))
    assert none.count() == 0


def test_joins_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(tables, "HEAVY_LEAST", 5)
    monkeypatch.setattr(tables, "HEAVY_SHARE", 10)
    keys = [0] * 70 + [1] * 25 + list(range(2, 40)) + [None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k long")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(30)], "k long, v string")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k is not null")
    left = {(r.i, r.v) for r in tables.lookup_join(rows, lookup, "k", counts, len(keys)).collect()}
    assert left == {(i, f"v{k}" if k is not None and k < 30 else None) for i, k in enumerate(keys)}
    inner = sorted((r.i, r.v) for r in tables.salted_join(rows, lookup, "k", counts, len(keys), tables.F.xxhash64("i")).collect())
    assert inner == [(i, f"v{k}") for i, k in enumerate(keys) if k is not None and k < 30]
