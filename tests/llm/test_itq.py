import math

import numpy as np

from tessera.llm import itq, queries


def brute(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i][1] for i in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    out, comp = {}, np.arange(len(good))
    for s in range(len(good)):
        todo = [s] if comp[s] == s and s not in out else []
        seen = {s}
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(link[a]):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if s not in out:
            ids = [rows[good[k]][0] for k in seen if rows[good[k]][0] is not None]
            for k in seen:
                out[k] = min(ids, default=None)
    result = []
    for i, (d, _) in enumerate(rows):
        if i in good:
            k = good.index(i)
            c = out[k]
            result.append((d, int(link[k].sum()), c, d is not None and d == c))
        else:
            result.append((d, 0, d, d is not None))
    return sorted(result, key=str)


def noisy(rng, centre, n, angle):
    out = []
    for _ in range(n):
        side = rng.normal(size=len(centre))
        side -= side @ centre * centre
        out.append(list(map(float, math.cos(angle) * centre + math.sin(angle) * side / np.linalg.norm(side))))
    return out


def unit(rng, d):
    v = rng.normal(size=d)
    return v / np.linalg.norm(v)


def test_against_brute_force_with_edge_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, list(map(float, unit(rng, 64)))) for i in range(300)]
    n = 300
    for size, angle in ((2, 0.05), (5, 0.1), (60, 0.1), (20, 0.22)):
        for v in noisy(rng, unit(rng, 64), size, angle):
            rows.append((n, v))
            n += 1
    same = rows[3][1]
    rows += [(n + 1, same), (n + 1, same), (None, same), (n + 2, [2 * x for x in same]), (n + 3, None), (n + 4, [0.0] * 64), (n + 5, [float("nan")] * 64), (n + 6, [None] * 64), (n + 7, [float("inf")] + [1.0] * 63), (n + 8, [])]
    rows += [(n + 9, [1.0] * 3 + [0.0] * 61), (None, None), (n + 10, [-x for x in same])]
    df = spark.createDataFrame([(i, v, 1, 5) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted(map(tuple, itq.near_duplicates(df).collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    links = lambda r: sum(x[1] for x in r)
    assert links(got) <= links(want) and links(got) >= 0.97 * links(want)
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(want)


def test_tiles_lose_and_repeat_nothing(spark, monkeypatch):
    monkeypatch.setattr(itq, "FILED", 7)
    monkeypatch.setattr(itq, "PROBING", 11)
    monkeypatch.setattr(itq, "ROWS", 100)
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(noisy(rng, unit(rng, 32), 120, 0.08))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = itq.near_duplicates(df).collect()
    assert all(r.component_id == 0 for r in got) and sum(r.n_links for r in got) >= 0.97 * 120 * 119
    assert max(r.n_links for r in got) <= 119


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    plan = itq.plan_for(50_000, 0.95)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([noisy(rng, v, 1, math.acos(0.951))[0] for v in x])
    directions = itq.fit(x, plan.rotations)
    a, b = itq.codes(x, directions).view(np.uint64), itq.codes(y, directions).view(np.uint64)
    met = np.zeros(len(x), bool)
    for _, r, mask in plan.masks():
        met |= np.bitwise_count((a[:, r] ^ b[:, r]) & np.uint64(mask)) <= 1
    met &= np.bitwise_count(a ^ b).sum(axis=1) <= plan.most_bits
    assert met.mean() > 0.95


def test_rotation_balances_bits():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64)) * np.linspace(3, 0.2, 64)
    d = itq.fit(x, 1)
    assert np.allclose(d.T @ d, np.eye(64), atol=1e-8)
    bits = x @ d >= 0
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.1


def test_sf_and_empty(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op5_itq_near_duplicates(spark, sf).collect()), key=str) == brute(rows)
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_every_length_are_compared(spark):
    rows = [(i, [1.0, 0.01 * i, 0.0] + [0.0] * 61) for i in range(3)]
    rows += [(10, [3.0, 4.0]), (11, [3.0, 4.0]), (12, [3.0, 4.1]), (13, [-4.0, 3.0]), (14, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(df).collect()}
    assert got == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 0, False), 10: (2, 10, True), 11: (2, 10, False), 12: (2, 10, False), 13: (0, 13, True), 14: (0, 14, True)}


def test_recall_of_the_operator_on_planted_links(spark):
    rng = np.random.default_rng(8)
    for d, spread in ((64, 4.0), (256, 1.0)):
        scale = np.linspace(spread, 1, d)
        rows, n = [], 1000
        for i in range(n):
            v = rng.normal(size=d) * scale
            v /= np.linalg.norm(v)
            rows += [(2 * i, list(map(float, v))), (2 * i + 1, noisy(rng, v, 1, math.acos(0.952))[0])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = itq.near_duplicates(df).collect()
        x = np.array([v for _, v in rows])
        want = int((x @ x.T >= 0.95).sum() - len(x))
        assert want >= 2 * n and 0.95 * want <= sum(r.n_links for r in got) <= want
        by = {r.vec_id: r.component_id for r in got}
        assert np.mean([by[2 * i] == by[2 * i + 1] for i in range(n)]) >= 0.95


def test_counts_and_links_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(itq, "LIGHT", 20)
    rows = [(i, v) for i, v in enumerate(noisy(rng, unit(rng, 48), 400, 0.2) + noisy(rng, unit(rng, 48), 60, 0.15))]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {r[0]: r[1] for r in brute(rows)}
    assert sum(r.n_links for r in got) >= 0.97 * sum(want.values()) and all(r.n_links <= want[r.vec_id] for r in got)
    groups = {}
    for r in got:
        groups.setdefault(r.component_id, []).append(r.n_links)
    assert all((0 in links) == (links == [0]) for links in groups.values())


def test_groups_are_bounded_for_a_dense_bucket(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(itq, "ROWS", 2000)
    monkeypatch.setattr(itq, "FILED", 250)
    whole = itq.compare

    def counted(table, plan, d):
        if table.num_rows > 4 * 2000:
            sizes.add(1)
        return whole(table, plan, d)

    monkeypatch.setattr(itq, "compare", counted)
    rng = np.random.default_rng(10)
    rows = [(i, v) for i, v in enumerate(noisy(rng, unit(rng, 32), 2000, 0.05))]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sizes.value == 0 and {r.component_id for r in got} == {0}
    assert sum(r.n_links for r in got) >= 0.99 * 2000 * 1999
