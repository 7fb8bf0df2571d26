import itertools
import math
import re
import zlib

import numpy as np
import pytest

from tessera.llm import langid, queries


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    scores, moves, start = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([5, 3])
    post, pairs, logs = langid.marginals(scores, lengths, moves, start)
    expected_pairs = np.zeros((3, 3))
    for i, n in enumerate(lengths):
        total, marginal, both = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(scores[i, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for t, y in enumerate(path):
                marginal[t, y] += w
            for a, b in itertools.pairwise(path):
                both[a, b] += w
        assert np.allclose(post[i, :n], marginal / total)
        assert np.allclose(post[i, n:], 0)
        assert np.isclose(logs[i], np.log(total))
        expected_pairs += both / total
    assert np.allclose(pairs, expected_pairs)


def test_features_are_the_grams_of_each_word():
    words = langid.read_words([b"ab, ab cd\xc3\xa9", None, b""])
    assert list(np.diff(words.bounds)) == [3, 0, 0] and len(words.hashes) == 2
    ids, begin = langid.features(words)
    sizes = sorted(np.diff(np.append(begin, len(ids))))
    assert sizes == [4 + 3 + 2 + 1 + 1, 6 + 5 + 4 + 3 + 1]


def test_windows_cover_all_words():
    first, lengths, owner = langid.windows(np.array([0, 300, 300, 301]), 128)
    assert list(first) == [0, 128, 256, 300] and list(lengths) == [128, 128, 44, 1] and list(owner) == [0, 0, 0, 2]


@pytest.fixture(scope="module")
def rows(spark):
    return queries.op2_crf_language_id(spark, "/root/testdata/sf0.01").collect()


def test_held_out_accuracy(spark, rows):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97


def test_words_of_code_switched_text_are_labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, ~langid.held_out(docs.doc_id, 3, 1), 60)
    plain = docs.where("doc_id % 3 = 2 and length(text) between 600 and 3000")
    a, b = (plain.where(f"lang = '{x}'").orderBy("doc_id").first().text.lower().encode() for x in ("en", "de"))
    post, bounds = langid.label_words([a[:500] + b" " + b[:500]], model)
    cut = len(langid.read_words([a[:500]]).which)
    named = np.array(model.languages)[post.argmax(axis=1)]
    assert np.mean(named[:cut] == "en") > 0.9 and np.mean(named[cut:] == "de") > 0.9
    assert np.allclose(post.sum(axis=1), 1, atol=1e-3)


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, source string, language int, score string"
    good = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog of the house", "en"), ("der hund und die katze von dem haus", "de")] * 20)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 !!", None), (None, "the house", "en"), (103, "ÉÉÉ", None), (103, "ÉÉÉ", None), (104, "the " * 100_000, None), (105, "— …", "en")]
    df = spark.createDataFrame([(i, t, lang, "s", 1, "x") for i, t, lang in good + odd], schema)
    got = langid.identified(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(good) + len(odd)
    for i in (100, 101, 102, 105):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[104].lang_pred == "en" and by[104].words == 100_000 and by[None].held_out is False
    assert langid.identified(df.where("false")).count() == 0
    nothing = langid.identified(df.withColumn("lang", langid.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    kept = langid.accepted(df, langid.fit(df, langid.F.lit(True)))
    assert kept.columns == df.columns and kept.where("doc_id in (100, 101, 102, 105)").count() == 0


def plain_posterior(text, model):
    """Marginals of each word by the definition: one chain over the whole text, features and sums word by word."""
    words = re.findall(r"[a-z\x80-\xff]+", text.lower().encode().decode("latin-1"))
    k, memory = len(model.languages), {}
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def emission(word):
        if word not in memory:
            marked = [1, *word.encode("latin-1"), 2]
            ids = []
            for n in range(1, 5):
                for at in range(len(marked) - n + 1):
                    gram = n
                    for b in marked[at : at + n]:
                        gram = gram << 8 | b
                    ids.append(mixed(gram & mask) % langid.FEATURES)
            own = int(langid.read_words([word.encode("latin-1")]).hashes[0])
            ids.append(mixed(own ^ 0xA5A5) % langid.FEATURES)
            listed = [model.members[i] for i, h in enumerate(model.lexicon) if int(h) == own]
            lexical = listed[0] @ model.lexicon_weights if listed else np.zeros(k)
            memory[word] = [math.fsum(float(model.weights[i, c]) for i in ids) + float(lexical[c]) for c in range(k)]
        return memory[word]

    def normal(x):
        return [v / sum(x) for v in x]

    scores = [emission(w) for w in words]
    p = [[math.exp(v - max(s)) for v in s] for s in scores]
    move = [[math.exp(float(v)) for v in row] for row in model.transitions]
    ahead = [normal([math.exp(float(model.start[c])) * p[0][c] for c in range(k)])]
    for t in range(1, len(words)):
        ahead.append(normal([sum(ahead[-1][b] * move[b][c] for b in range(k)) * p[t][c] for c in range(k)]))
    behind = [[1.0] * k]
    for t in range(len(words) - 1, 0, -1):
        behind.append(normal([sum(move[c][b] * p[t][b] * behind[-1][b] for b in range(k)) for c in range(k)]))
    return [normal([a * b for a, b in zip(x, y)]) for x, y in zip(ahead, reversed(behind))]


def test_query_against_a_plain_version(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, ~langid.held_out(docs.doc_id, 3, 1))
    texts = {r.doc_id: r.text for r in docs.collect()}
    long = sorted((r for r in rows if r.lang_pred != "und"), key=lambda r: -r.words)
    for r in [*long[:2], *long[200:900:35], *long[-5:]]:
        post = np.array(plain_posterior(texts[r.doc_id], model))
        assert r.words == len(post) and r.lang_pred == model.languages[post.sum(axis=0).argmax()]
        assert r.score == pytest.approx(post.sum(axis=0).max() / len(post), abs=2e-4)


def test_labels_do_not_depend_on_the_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, langid.F.lit(True), 40)
    texts = [r.text.lower().encode() for r in docs.where("length(text) between 500 and 4000").orderBy("doc_id").limit(40).collect()]
    texts += [b"", None, b"1 2", b"one", b" ".join(texts[:20])]
    whole, bounds = langid.label_words(texts, model, 1 << 20)
    for size in (1, 2, 7, 128):
        assert np.allclose(langid.label_words(texts, model, size)[0], whole, atol=1e-4)


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "FEATURES", 1 << 8)
    rows = [(i, f"word{i} of{i % 210}", f"l{i % 210:03}") for i in range(420)] + [(1000 + i, "common words here", "big") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, langid.F.lit(True), 2)
    assert len(model.languages) == 211
