import math
import re

import numpy as np
import pytest

from tessera.llm import queries, toxicity


def test_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").select("text", "toxic").collect()
    s, y = model.severity([r.text.encode() for r in rows]), np.array([r.toxic for r in rows])
    assert (s[y == 1] >= 0.5).mean() > 0.85 and (s[y == 0] >= 0.5).mean() < 0.02
    assert (np.diff(model.thresholds) > 0).all()


def test_gradient_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    texts, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 4))
        words = [f"w{rng.integers(40)}" for _ in range(30)] + [f"bad{k}x" for k in range(g)]
        texts.append(" ".join(rng.permutation(words)).encode())
        grades.append(g)
    model = toxicity.train(texts, np.array(grades))
    s = model.severity(texts)
    means = [s[np.array(grades) == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2
    assert np.abs(s - grades).mean() < 0.4


def test_severity_rises_with_the_number_of_hits(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_toxicity_severity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.severity <= 3 and r.toxic == (r.severity >= 0.5) for r in rows)


def test_edge_cases(spark):
    docs = [(i, f"some words number {i % 7} here" + (" vile" if i % 2 else ""), 1, "g") for i in range(80)]
    docs += [(100, None, 1, "g"), (101, "", 1, "g"), (None, "vile", 1, "g"), (102, "vile " * 200_000, 1, "g"), (103, "VILE!", 1, "g"), (103, "VILE!", 1, "g"), (104, "vïle", 1, "g")]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int, severity string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(61, 0, None), (None, 1, 1), (9999, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.severities(df, labels).collect()
    by = {r.doc_id: r.toxic for r in got}
    assert len(got) == len(docs)
    assert by[103] and by[102] and by[None] and by[71] and not by[70] and not by[100] and not by[101]
    assert toxicity.severities(df.where("false"), labels).count() == 0
    assert {r.severity for r in toxicity.severities(df, labels.where("false")).collect()} == {0.0}
    assert {r.severity for r in toxicity.severities(df, labels.where("toxic = 0")).collect()} == {0.0}


def test_severity_against_a_plain_version(spark):
    from tessera.llm.words import hashes, mix

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weight = {int(h): float(w) for h, w in zip(model.words, model.weights)}

    def key(part, size):
        data = np.frombuffer(part, np.uint8)
        h = hashes(data, np.array([0]), np.array([len(data)]))
        return int(h[0]) if size is None else int(mix(h + np.uint64(size))[0])

    def plain(text):
        found = set()
        for word in set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))):
            found.add(key(word, None))
            found |= {key(word[:k], k) for k in toxicity.PREFIXES if len(word) > k}
        z = sum(weight.get(f, 0.0) for f in found)
        return sum(1 / (1 + math.exp(min(500, max(-500, c - z)))) for c in model.thresholds)

    got = {r.doc_id: r for r in queries.op6_toxicity_severity(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    picked = sorted(got, key=lambda i: -got[i].severity)[:40] + sorted(got)[::25]
    assert len(weight) > 10 and {got[i].toxic for i in picked} == {True, False}
    for i in picked:
        assert got[i].severity == pytest.approx(plain(texts[i]), abs=1e-9) and got[i].grade == int(got[i].severity + 0.5) and got[i].toxic == (got[i].severity >= 0.5)
