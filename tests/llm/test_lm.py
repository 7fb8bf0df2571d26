import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import lm, queries


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


class Plain:
    """The model from its definition, with dictionaries."""

    def __init__(self, texts):
        self.count = Counter(w for t in texts for w in tokens(t))
        self.n, self.v = sum(self.count.values()), len(self.count)
        three = Counter()
        for t in texts:
            x = ["\t", "\t", *tokens(t)]
            three.update(zip(x, x[1:], x[2:]))
        two = Counter()
        for (_, b, c), n in three.items():
            two[b, c] += n if b == "\t" else 1
        one = Counter(c for _, c in two)
        self.levels = [{(w,): n for w, n in one.items()}, two, three]
        self.d, self.sums, self.numbers = [], [], []
        for level in self.levels:
            t = [sum(n == k for n in level.values()) for k in (1, 2, 3, 4)]
            self.d.append(lm.discounts_of(t))
            s, m = Counter(), defaultdict(lambda: [0, 0, 0])
            for gram, n in level.items():
                s[gram[:-1]] += n
                m[gram[:-1]][min(n, 3) - 1] += 1
            self.sums.append(s)
            self.numbers.append(m)

    def p(self, gram):
        k = len(gram) - 1
        lower = self.p(gram[1:]) if k else 1 / (self.v + 1)
        s = self.sums[k].get(gram[:-1], 0)
        if not s:
            return lower
        n = self.levels[k].get(gram, 0)
        first = (n - self.d[k][min(n, 3) - 1]) / s if n else 0
        return first + sum(d * m for d, m in zip(self.d[k], self.numbers[k][gram[:-1]])) / s * lower

    def score(self, text):
        x = ["\t", "\t", *tokens(text)]
        return sum(math.log10(self.p(g)) for g in zip(x, x[1:], x[2:]))

    def base(self, text):
        return sum(math.log10((self.count[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in tokens(text))


def check(rows, docs):
    plain = Plain([t for d, t in docs if d is None or zlib.crc32(str(d).encode()) % 5 != 1])
    assert len(rows) == len(docs)
    texts = defaultdict(list)
    for d, t in docs:
        texts[d].append(t)
    for r in rows:
        text = texts[r.doc_id][0] if len(set(texts[r.doc_id])) == 1 else None
        if text is None and texts[r.doc_id][0] is not None:
            continue
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.n_tokens == len(tokens(text)) and r.train_tokens == plain.n
        assert r.n_known == sum(plain.count[w] > 0 for w in tokens(text))
        assert r.base_score == pytest.approx(plain.base(text), rel=1e-9)
        assert r.score == pytest.approx(plain.score(text), rel=1e-6)


def test_against_definition_with_edge_cases(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 60)) if x < 400)) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, " \t"), (None, "w1 w2 w3"), (1003, "W1 É w1"), (1003, "W1 É w1"), (1004, "w1 " * 50_000), (1005, "</s> <s> zzz")]
    df = spark.createDataFrame([(d, t, 1, 2.0) for d, t in docs], "doc_id long, text string, hash int, score double")
    check(lm.perplexities(df).collect(), docs)


def test_many_parts_and_heavy_words(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) if x < 3000)) for i in range(200)]
    monkeypatch.setattr(lm, "PART_TOKENS", 100)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = lm.fit(df, lm.F.lit(True))
    assert model.layout.parts >= 32 and len(model.layout.heavy) > 2
    plain = Plain([t for _, t in docs])
    for r in lm.scored(df, model).collect():
        assert r.score == pytest.approx(plain.score(dict(docs)[r.doc_id]), rel=1e-6)
    for context in (("\t", "\t"), ("\t", "w1"), ("w1", "w2"), ("w999999", "w1")):
        assert sum(plain.p((*context, w)) for w in [*plain.count, "<unk>"]) == pytest.approx(1)


def test_sf_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op1_kneser_ney_scoring(spark, sf).collect()
    check(rows, docs)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    model = lm.fit(df, lm.F.lit(False))
    assert [tuple(r) for r in lm.scored(df, model).collect()] == [(2, 3, 0, 0.0, 0.0)]
    assert lm.perplexities(df.where("false")).count() == 0


def test_blocks_and_tables_round_trip():
    a = np.sort(np.random.default_rng(0).integers(0, 1 << 60, 1000).astype(np.uint64))
    b = np.arange(1000, dtype=np.uint64) % 300
    assert [list(x) for x in lm.unpack(lm.pack(a, b), 2)] == [list(a), list(b)]
    assert [len(x) for x in lm.unpack(lm.pack(a[:0], b[:0]), 2)] == [0, 0]
    keys = lm.mix(a)
    arrays = lm.hash_table("x", keys, {"count": b})
    place = lm.find(arrays, "x", np.concatenate([keys, lm.mix(a + np.uint64(1))]))
    assert (arrays["x.count"][place[:1000]] == b).all() and (place[1000:] == -1).all()


def test_a_missing_part_raises(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_TOKENS", 100)
    df = spark.createDataFrame([(i, f"a b c{i} d{i % 7} e") for i in range(300)], "doc_id long, text string")
    model = lm.fit(df, lm.F.lit(True))
    kept = lm.scored(df, model).collect()
    path = model.layout.path("all-three", 0)
    os.rename(path, path + ".gone")
    moved = lm.Model(lm.Layout(model.layout.folder + "/.", *[getattr(model.layout, x) for x in ("parts", "bits", "words", "tokens", "texts", "group")]), model.discounts, model.left_sum, model.left_mass)
    with pytest.raises(Exception, match="gone or not shared"):
        lm.scored(df, moved).collect()
    os.rename(path + ".gone", path)
    assert sorted(lm.scored(df, moved).collect()) == sorted(kept)


def test_too_many_words_are_refused(spark, monkeypatch):
    df = spark.createDataFrame([(0, "a b c")], "doc_id long, text string")
    whole = lm.Layout
    monkeypatch.setattr(lm, "Layout", lambda folder, parts, bits, words=0, *rest, **more: whole(folder, parts, bits, words << 32, *rest, **more))
    with pytest.raises(ValueError, match="32 bits"):
        lm.fit(df, lm.F.lit(True))


def test_parts_of_several_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(lm, "PART_TOKENS", 60)
    monkeypatch.setattr(lm, "GROUP", 4)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 2000) + " the" * 300) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = lm.fit(df, lm.F.lit(True))
    assert model.layout.parts >= 32 and not [f for f in os.listdir(model.layout.folder) if not f.startswith(("all-", "layout", ".all-", ".layout"))]
    plain = Plain([t for _, t in docs])
    for r in lm.scored(df, model).collect():
        assert r.score == pytest.approx(plain.score(dict(docs)[r.doc_id]), rel=1e-6)
        assert r.base_score == pytest.approx(plain.base(dict(docs)[r.doc_id]), rel=1e-9)
