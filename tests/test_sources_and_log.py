import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tessera.sources import config, jsonl
from tessera.streaming import log

KEY = {"model": "m", "n_prompts": 3}


def write(path, *lines, end="\n"):
    path.write_text("\n".join([json.dumps({"cache_key": KEY}), *lines]) + end)
    return str(path)


def test_cached_records(spark, tmp_path):
    rows = [json.dumps({"index": i, "prompt_key": f"k{i}"}) for i in range(3)]
    schema = "index long, prompt_key string"
    read = lambda p, key=KEY: [r["index"] for r in jsonl.records(spark, p, schema, key).orderBy("record").collect()]
    assert read(write(tmp_path / "a.jsonl", *rows)) == [0, 1, 2]
    assert read(write(tmp_path / "b.jsonl", *rows), {"model": "other"}) == []
    assert read(write(tmp_path / "c.jsonl", *rows, end="")) == [0, 1]
    assert read(write(tmp_path / "d.jsonl", rows[0], '{"index": 1, "pro', rows[2])) == [0]
    assert jsonl.read_header(tmp_path / "a.jsonl") == {"cache_key": KEY}
    (tmp_path / "cut").write_text('{"a": 1}')
    (tmp_path / "list").write_text("[1]\n")
    assert [jsonl.read_header(tmp_path / x) for x in ("cut", "list", "none")] == [None, None, None]


def test_eval_rows(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps([{"instruction": f"q{i}", "output": "a"} for i in range(4)], indent=1))
    rows = jsonl.eval_rows(spark, str(tmp_path / "rows.json"), 2).orderBy("index").collect()
    assert [(r["index"], r.instruction, r.input) for r in rows] == [(0, "q0", None), (1, "q1", None)]


def test_grades(spark, tmp_path):
    good = '{"index": 1, "label": "A", "grade": "wrong", "reason": "r"}'
    (tmp_path / "grades_one.jsonl").write_text(good + "\n\n" + good + "\n")
    got = jsonl.grades(spark, str(tmp_path / "*.jsonl")).collect()
    assert [r.grader for r in got] == ["one", "one"] and got[0].label == "A"
    (tmp_path / "grades_two.jsonl").write_text(good + "\nnot json\n")
    with pytest.raises(ValueError, match=r"grades_two.jsonl line 2"):
        jsonl.grades(spark, str(tmp_path / "grades_two.jsonl"))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "one.jsonl").write_text(good)
    with pytest.raises(ValueError, match="2 files"):
        jsonl.grades(spark, f"{tmp_path}/more/one.jsonl,{tmp_path}/grades_one.jsonl".split(","))


def test_pairs_with_checksum(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "b", None), (0, "a", 2)], "index long, chosen string, x int")
    manifest = jsonl.write_pairs(pairs, tmp_path / "p", {"adapter_sha256": "abc"})
    assert (tmp_path / "p/pairs.jsonl").read_text().splitlines()[0] == '{"index":0,"chosen":"a","x":2}'
    assert manifest["pairs_sha256"] == jsonl.file_sha256(tmp_path / "p/pairs.jsonl")
    assert jsonl.read_pairs(spark, tmp_path / "p", "abc").count() == 2
    with pytest.raises(ValueError, match="another adapter"):
        jsonl.read_pairs(spark, tmp_path / "p", "zzz")
    (tmp_path / "p/pairs.jsonl").write_text("{}\n")
    with pytest.raises(ValueError, match="changed"):
        jsonl.read_pairs(spark, tmp_path / "p", "abc")


def test_atomic_write_leaves_nothing_behind(tmp_path, monkeypatch):
    jsonl.write_atomic(tmp_path / "x", "one")
    monkeypatch.setattr(jsonl.os, "replace", lambda *a: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        jsonl.write_atomic(tmp_path / "x", "two")
    assert (tmp_path / "x").read_text() == "one" and len(list(tmp_path.iterdir())) == 1


@dataclass(frozen=True)
class Inner:
    a: int = 1
    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Outer:
    inner: Inner = Inner()
    b: float = 0.5


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("inner: {a: 3, names: [x, y], unknown: 1}\nextra: 2\n")
    got = config.load(tmp_path / "c.yaml", Outer)
    assert got == Outer(Inner(3, ("x", "y"))) and config.to_dict(got)["b"] == 0.5


def test_resume_decisions():
    assert log.decide(None, KEY, True) == "fresh"
    assert log.decide(KEY, KEY, True) == "resume" and log.decide(KEY, KEY | {"n_prompts": 9}, True) == "resume"
    assert log.decide(KEY, KEY | {"model": "x"}, False) == "regenerate"
    for key in (KEY | {"model": "x"}, KEY | {"n_prompts": 1}):
        with pytest.raises(log.StaleCache):
            log.decide(KEY, key, True)
    assert [log.usable_prefix(m, 3, 2) for m in (0, 1, 2, 3)] == [0, 0, 2, 3]
    with pytest.raises(RuntimeError):
        log.may_start(True, True, False)
    with pytest.raises(RuntimeError):
        log.may_start(True, False, True)
    log.may_start(False, False, False)
    assert log.check_drift({"commit": "a"}, {"commit": "b"}, True) and not log.check_drift({"commit": "a"}, {"commit": "a"}, False)
    with pytest.raises(RuntimeError, match="commit"):
        log.check_drift({"commit": "a"}, {"commit": "b"}, False)
    assert log.fingerprint({"a": 1, "b": 2}) == log.fingerprint({"b": 2, "a": 1})


def test_prefix_and_rest(spark):
    plan = spark.createDataFrame([(i, f"k{i}") for i in range(5)], "index long, prompt_key string")
    records = spark.createDataFrame([(0, "k0"), (1, "k1"), (2, "other"), (3, "k3")], "index long, prompt_key string")
    assert log.matching_prefix(records, plan).first().n == 2
    assert log.matching_prefix(plan, plan).first().n == 5
    assert [r["index"] for r in log.remaining(plan, records).collect()] == [4]


def test_stream_appends_each_file_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    df = spark.range(10).select(F.col("id").alias("index"))
    df.where("index < 6").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        log.append(spark, source, df.schema, out, check)
        assert spark.read.parquet(out).count() == 6
    df.where("index >= 6").coalesce(1).write.mode("append").parquet(source)
    log.append(spark, source, df.schema, out, check, transform=lambda b: b.withColumn("index", F.col("index") * 10))
    assert sorted(r["index"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 5, 60, 70, 80, 90]


def test_newest_checkpoint(tmp_path):
    assert log.newest_checkpoint(tmp_path, "done") is None
    for n, done in ((9, True), (10, True), (11, False)):
        (tmp_path / f"checkpoint-{n}").mkdir()
        if done:
            (tmp_path / f"checkpoint-{n}" / "done").write_text("")
    assert log.newest_checkpoint(tmp_path, "done").name == "checkpoint-10"


def test_each_file_has_its_own_header(spark, tmp_path):
    row = json.dumps({"index": 1, "prompt_key": "k"})
    write(tmp_path / "a.jsonl", row)
    (tmp_path / "b.jsonl").write_text(json.dumps({"cache_key": {"model": "x"}}) + "\n" + row + "\n" + row + "\n")
    for key, n in ((KEY, 1), ({"model": "x"}, 2), ({"model": "y"}, 0)):
        assert jsonl.records(spark, str(tmp_path / "*.jsonl"), "index long, prompt_key string", key).count() == n


def test_sheet_and_key_apart(spark, tmp_path):
    from tessera.operators import grading

    rows = spark.createDataFrame([(i, f"q{i}", None, f"ref {i}") for i in range(12)], "index long, instruction string, input string, output string")
    key = grading.blind_key(rows, 5)
    gens = key.select("index", "system", F.concat(F.lit("answer of "), "system").alias("text"))
    jsonl.write_sheet(grading.sheet(rows, gens, key), key, tmp_path / "s", {"seed": 5, "rubric_version": "1"})
    assert "system" not in (tmp_path / "s/sheet.jsonl").read_text() and len((tmp_path / "s/sheet.jsonl").read_text().splitlines()) == 12
    sheet, back, facts = jsonl.read_sheet(spark, tmp_path / "s")
    assert facts == {"seed": 5, "rubric_version": "1"} and sorted(map(tuple, back.collect())) == sorted(map(tuple, key.select("index", "system", "label").collect()))
    assert sheet.where("index = 3").first().answers.keys() == {"A", "B", "C"}
    (tmp_path / "s/sheet.jsonl").write_text("".join((tmp_path / "s/sheet.jsonl").read_text().splitlines(True)[1:]))
    with pytest.raises(ValueError, match="not on the sheet"):
        jsonl.read_sheet(spark, tmp_path / "s")


def test_provenance_fails_closed(tmp_path):
    import subprocess

    from tessera.sources import run

    out = run.provenance(tmp_path)
    assert out["commit"] is None and out["scratch"] and out["dirty"] and "no repository" in out["scratch_reason"]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init")
    (tmp_path / "a").write_text("1")
    git("add", "a")
    git("commit", "-m", "one")
    clean = run.provenance(tmp_path)
    assert len(clean["commit"]) == 40 and not clean["scratch"] and clean["scratch_reason"] is None
    (tmp_path / "b").write_text("2")
    assert run.provenance(tmp_path)["scratch_reason"] == "the working tree has changes"


def test_run_summary(spark, tmp_path):
    from tessera.sources import run

    lines = [(1, 2.0, None), (2, None, 0.9), (3, 1.0, None), (4, None, 0.4)]
    df = spark.createDataFrame(lines, "step int, loss double, eval_loss double")
    found = run.summary(df, {"config": {"a": 1}, "trainable_pct": run.share(1, 3)})
    assert (found["train_loss"], found["eval_loss_before"], found["eval_loss_after"], found["trainable_pct"]) == (1.5, 0.9, 0.4, 33.333)
    assert [x["step"] for x in found["log_history"]] == [1, 2, 3, 4] and "resumed_from" not in found
    part = run.summary(df, {}, resumed_from=2)
    assert (part["train_loss"], part["resumed_segment_only"], part["eval_loss_before"]) == (1.0, True, None)
    run.write_summary(tmp_path / "summary.json", found)
    assert json.loads((tmp_path / "summary.json").read_text()) == found


def test_sampling_settings():
    assert (config.Sampling().decoding, config.Sampling().samples) == ("greedy", 1)
    for wrong, said in (({"samples": 2}, "greedy"), ({"decoding": "beam"}, "decoding"), ({"max_new_tokens": 64}, "384"), ({"decoding": "sample", "samples": 0}, "positive")):
        with pytest.raises(ValueError, match=said):
            config.Sampling(**wrong)
