import re
from collections import defaultdict

import pytest
from test_decontaminate import words
from test_langid import plain_posterior
from test_mixing import size, water
from test_secrets import base
from test_simhash import brute, plain_fingerprint

import corpus_pipeline
from tessera.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "benchmark_decontamination", "secret_scan", "source_mixing"]
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes
    assert stages[5].columns == [*stages[0].columns, "size", "source_size", "target", "taken"]


def test_language_stage_keeps_documents_with_a_language(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[:2])
    assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
    lettered = {i for i, r in before.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    assert set(after) <= lettered


def test_simhash_stage_keeps_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({c for _, _, c in brute(rows)})


def test_decontamination_stage_against_brute_force(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))} - {()}
    sizes = {len(w) for w in windows}
    leaks = lambda t: any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))
    assert {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in stages[2].collect() if not leaks(r.text)}


def test_secrets_stage_hides_secrets_and_changes_nothing_else(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    changed = 0
    for r in stages[4].collect():
        old = before.pop(r.doc_id)
        if base(old.text):
            changed += 1
            assert "[SECRET]" in r.text and not base(r.text) and r.n_chars == len(r.text)
        elif r.text != old.text:
            assert "[SECRET]" in r.text
        else:
            assert r == old
    assert not before and changed


def test_mixing_stage_comes_near_its_targets(stages):
    rows = stages[4].collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want = water(sizes, (5, 2, 1))
    for r in stages[5].collect():
        assert 0 < r.taken <= 3 * r["size"] and r["size"] == size(r.text)
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 20


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[5].collect()))


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, hits int, spans int, size int, language int, _id int"
    text = "the house and the garden of the old man by the river " * 3
    rows = [(1, text, "en"), (1, text, "en"), (2, text, "en"), (None, text, None), (None, "completely other words in this text here today", "en"), (3, None, "en"), (4, "", None), (5, "der hund und die katze", "de"), (6, "un token=abcdefgh12 le la les", "fr"), (7, "die " * 30_000, "de")]
    docs = spark.createDataFrame([(i, t, lang, None if i == 5 else "s", len(t or ""), "a", 1, 2, 3, 4, 5) for i, t, lang in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.where("false"), SF)
        assert none.columns == docs.columns and none.count() == 0, name
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
    kept = corpus_pipeline.simhash_dedup(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "5", "6", "7", "None"]
    assert {plain_fingerprint(r.text) for r in kept} == {plain_fingerprint(t) for _, t, _ in rows}
    mixed = corpus_pipeline.source_mixing(spark, docs, SF)
    assert mixed.columns[: len(docs.columns)] == docs.columns and mixed.count() > 0
    assert corpus_pipeline.source_mixing(spark, docs.where("false"), SF).count() == 0


def test_language_stage_against_a_plain_version(spark, stages):
    before, kept = stages[0].collect(), {r.doc_id for r in stages[1].collect()}
    model = langid.fit(stages[0], langid.F.lit(True))
    lettered = lambda t: t and re.search(r"[^\W\d_]", t)
    dropped = [r for r in before if r.doc_id not in kept]
    for r in [*dropped, *[r for r in before if r.text and len(r.text) < 4000][::20]]:
        post = plain_posterior(r.text, model) if lettered(r.text) else []
        score = max(map(sum, zip(*post))) / len(post) if post else 0.0
        assert abs(score - 0.4) < 1e-3 or (r.doc_id in kept) == (score >= 0.4)
