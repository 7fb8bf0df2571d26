import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import checks, compare, grading, metrics, plans, report, scoring, split

ROW = "row_id long, instruction string, input string, output string"
LONG = "x" * 60


def rows_of(spark, items):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(items)], ROW)


def test_unique_rows(spark):
    nine = [("q1", None), ("q1", ""), ("q2", None), ("  q2 ", None), ("q3", "ctx"), ("q3", "ctx   here\n"), ("q3", None), ("Q1", None), ("q4", None)]
    kept = split.unique_rows(rows_of(spark, [(*r, f"{LONG}{i}") for i, r in enumerate(nine)])).orderBy("row_id").collect()
    assert [r.row_id for r in kept] == [0, 2, 4, 5, 6, 7, 8]
    lengths = rows_of(spark, [("a", None, "x"), ("b", None, "x" * 10_000), ("c", None, "x" * 100), ("  ", None, LONG)])
    assert [r.row_id for r in split.length_filter(lengths, 20).collect()] == [2]


def test_split_is_seeded_and_disjoint(spark):
    rows = rows_of(spark, [(f"q{i}", None, LONG) for i in range(50)])
    a = split.split(rows, 20, 5, 0).orderBy("row_id").collect()
    b = split.split(rows.repartition(7), 20, 5, 0).orderBy("row_id").collect()
    assert a == b and sorted(r.position for r in a) == list(range(50))
    assert [sum(r.split == s for r in a) for s in ("train", "eval", "rest")] == [20, 5, 25]
    assert a != split.split(rows, 20, 5, 1).orderBy("row_id").collect()
    with pytest.raises(ValueError, match="only 50"):
        split.split(rows, 50, 5, 0)
    assert split.first_prompts(split.split(rows, 20, 5, 0), 3).count() == 3
    assert split.split_stats(rows, split.split(rows, 20, 5, 0)).first().asDict() == {"train_rows": 20, "eval_rows": 5, "duplicates_dropped": 0}


def test_pick_and_pair_split(spark):
    rows = spark.range(20).select(F.col("id").alias("index"))
    assert split.pick(rows, 5, 1).distinct().count() == 5
    with pytest.raises(ValueError):
        split.pick(rows, 21, 1)
    assert split.split_pairs(rows, 0.1, 0).where("held").count() == 2
    assert [split.held_out_size(n, 0.1) for n in (0, 1, 2, 20, 105)] == [0, 0, 1, 2, 10]
    plan = split.sample_plan(rows.select(F.col("index").alias("prompt_index")), 2, 8, 100).orderBy("index").collect()
    assert [(r["index"], r.sample, r.batch_seed) for r in plan[:3]] == [(0, 0, 100), (1, 1, 100), (2, 0, 100)] and plan[-1].batch == 4


def test_leakage(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    checks.check_split(keys("a", "b"), keys("b", "a", "a"), keys("c"))
    with pytest.raises(checks.SplitMismatch, match="1 saved prompts missing, 1 unexpected"):
        checks.check_split(keys("a", "b"), keys("b", "c"), keys("z"))
    with pytest.raises(checks.SplitMismatch, match="1 training prompts"):
        checks.check_split(keys("a"), keys("a"), keys("a", "b"))
    assert checks.leaked(keys("a", "b"), keys("b", "b")).collect() == [("b",)]


def test_alignment(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "index long, prompt_key string")
    checks.check_generations(rows, rows, "x")
    swapped = spark.createDataFrame([(0, "b"), (1, "a")], "index long, prompt_key string")
    with pytest.raises(ValueError, match="row 0"):
        checks.check_generations(swapped, rows, "x")
    with pytest.raises(ValueError, match="1 generations for 2"):
        checks.check_generations(rows.where("index = 0"), rows, "x")


GOOD = "A plain answer that says one thing."
LOOP = "over and over again " * 5


def scored_pairs(spark, samples, prompts=6):
    rows = spark.createDataFrame([(i, f"q{i}", None, f"  reference {i} ") for i in range(prompts)], "index long, instruction string, input string, output string")
    made = [(p, p * 2 + s, s, t, n, stop) for p, s, t, n, stop in samples]
    df = spark.createDataFrame(made, "prompt_index long, sample_index long, sample int, text string, new_tokens int, stopped boolean").withColumn("index", F.col("prompt_index"))
    return rows, scoring.with_verdict(scoring.scored(rows, df, 256))


def test_pairs(spark):
    table = [
        (0, 0, GOOD, 9, True), (0, 1, LOOP, 20, True), (1, 0, "x <|im_end|>", 5, True), (1, 1, LOOP, 256, False), (2, 0, GOOD, 9, True), (2, 1, GOOD, 9, True),
        (3, 0, GOOD, 256, False), (3, 1, GOOD, 9, True), (4, 0, LOOP, 256, False), (4, 1, GOOD, 256, False), (5, 0, GOOD, 9, True), (5, 1, "<|im_end|>", 3, True),
    ]
    rows, samples = scored_pairs(spark, table)
    pairs = scoring.build_pairs(rows, samples).orderBy("index").collect()
    assert [(p["index"], p.prompt_index, p.rejected_sample) for p in pairs] == [(0, 0, 1), (1, 1, 0), (2, 4, 0), (3, 5, 1)]
    assert len(pairs[0]) == 12 and pairs[0].chosen == "reference 0" and [m.role for m in pairs[0].prompt] == ["system", "user"]
    assert pairs[2].rejected_reasons == ["repetition", "no_stop_and_repetition"]
    c = scoring.pair_counts(samples, 6, 4, 0).first()
    assert (c.samples, c.samples_rejected, c.ambiguous_skipped, c.samples_pass) == (12, 5, 2, 5)
    assert (c.prompts_with_rejected_sample, c.prompts_without_rejected_sample, c.prompts_all_samples_pass) == (4, 2, 1)
    assert c["yield"] == pytest.approx(4 / 6) and c.stopped_share == pytest.approx(8 / 12)
    assert scoring.pair_counts(samples.where("false"), 0, 0, 0).first()["yield"] is None


def test_rejected_text_that_is_the_reference_is_dropped(spark):
    rows, samples = scored_pairs(spark, [(0, 0, " reference 0\n<|x|>", 3, True), (1, 0, LOOP, 3, True)], 2)
    same = rows.withColumn("output", F.when(F.col("index") == 1, F.lit(LOOP)).otherwise(F.col("output")))
    found = scoring.candidates(same, samples).orderBy("prompt_index").collect()
    assert [r.dropped for r in found] == [False, True]
    assert scoring.build_pairs(same, samples).count() == 1


def test_rates_and_intervals(spark):
    flags = spark.createDataFrame([("t", True)] * 4 + [("f", False)] * 4 + [("h", True), ("h", False)], "g string, passed boolean")
    every = spark.createDataFrame([("t",), ("f",), ("h",), ("none",)], "g string")
    got = {r.g: r for r in metrics.rates(flags, ["g"], every=every).collect()}
    assert (got["t"].ci_lo, got["t"].ci_hi, got["f"].ci_lo, got["f"].ci_hi) == (1, 1, 0, 0)
    assert (got["h"].ci_lo, got["h"].ci_hi, got["h"].rate) == (0, 1, 0.5)
    assert (got["none"].k, got["none"].n, got["none"].rate, got["none"].ci_lo) == (0, 0, None, None)


def test_large_groups_use_the_limit(spark, monkeypatch):
    n = 400
    counts = spark.createDataFrame([("x", 120, 0, n)], "g string, k long, z long, n long")
    exact = metrics.with_interval(counts, "k", "z", 1000, 0).first()
    monkeypatch.setattr(metrics, "EXACT_N", 10)
    near = metrics.with_interval(counts, "k", "z", 1000, 0).first()
    assert abs(exact.ci_lo - near.ci_lo) < 0.012 and abs(exact.ci_hi - near.ci_hi) < 0.012 and exact.ci_lo < 0.3 < exact.ci_hi


def test_large_groups_are_drawn_position_by_position(spark):
    from hashlib import md5

    n, up, down = 2121, 2, 3
    draw = lambda r, j: int(md5(f"0:{r}:{j}".encode()).hexdigest()[:8], 16) % n
    sums = [sum((d < up) - (up <= d < up + down) for d in (draw(r, j) for j in range(n))) for r in range(60)]
    want = np.quantile(np.array(sums) / n, [0.025, 0.975])
    counts = spark.createDataFrame([("x", up, down, n)], "g string, k long, z long, n long")
    got = metrics.with_interval(counts, "k", "z", 60, 0).first()
    assert (got.ci_lo, got.ci_hi) == pytest.approx(tuple(want), abs=1e-12)
    rate = metrics.with_interval(counts.withColumn("z", F.lit(0)), "k", "z", 200, 0).first()
    assert rate.ci_lo >= 0


def test_paired_differences(spark):
    a, b = "100100", "110110"
    pairs = spark.createDataFrame([("g", x == "1", y == "1") for x, y in zip(a, b)], "g string, a boolean, b boolean")
    r = metrics.paired_differences(pairs, ["g"], "a", "b").first()
    assert (r.n, r.a_correct, r.b_correct) == (6, 2, 4) and r["diff"] == pytest.approx(2 / 6) and r.ci_lo <= r["diff"] <= r.ci_hi
    none = metrics.paired_differences(pairs.where("false"), ["g"], "a", "b", every=pairs).first()
    assert (none.n, none["diff"], none.ci_lo) == (0, None, None)


def test_agreement(spark):
    pairs = spark.createDataFrame([("k", x, y) for x, y in zip("cccpww", "ccppwc")] + [("same", "w", "w")] * 3, "g string, a string, b string")
    got = {r.g: r for r in metrics.agreement(pairs, ["g"]).collect()}
    assert got["k"].exact_match == pytest.approx(4 / 6) and got["k"].cohens_kappa == pytest.approx(11 / 23)
    assert got["same"].exact_match == 1 and got["same"].cohens_kappa is None


def test_logs_and_sums(spark):
    log = spark.createDataFrame([("r", 1, 0.7), ("r", 2, None), ("r", 3, 0.1), ("one", 1, 0.5)], "run string, step int, loss double")
    got = {r.run: r for r in metrics.change(metrics.trajectory(log, ["run", "loss"]), ["run"], "loss").collect()}
    assert got["r"].delta == pytest.approx(-0.6) and got["one"].first is None
    t = spark.createDataFrame([("a", 0, -1.0, 1), ("a", 1, -2.0, 1), ("b", 0, -3.0, 5)], "k string, pos int, logp double, n_prompt int")
    nll = metrics.answer_nll(t, ["k"])
    assert {r.k: (r.nll, r.n_tokens) for r in nll.collect()} == {"a": (2.0, 1), "b": (0.0, 0)}
    assert nll.where("k = 'b'").agg(metrics.perplexity(F.col("nll"), F.col("n_tokens"))).first()[0] is None
    ids = spark.createDataFrame([([1] * 5, [1] * 6, [1] * 2)], "prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>")
    assert tuple(metrics.truncation_counts(ids, 10, 3).first()) == (1, 1, 0, 2)
    zero = spark.createDataFrame([("x", 1.0, 1.0, 2.0, 2.0)], "k string, policy_chosen double, reference_chosen double, policy_rejected double, reference_rejected double")
    r = metrics.reward_metrics(zero, ["k"]).first()
    assert r.accuracy == 0 and r.loss == pytest.approx(0.6931471805599453)


def test_length_stats(spark):
    rows = spark.createDataFrame([("b", n) for n in (5, 10, 20, 8)], "system string, new_tokens int")
    r = metrics.length_stats(rows, ["system"]).first()
    assert (r["mean"], r.median, r.short, r.bin_0_20, r.at_limit) == (10.75, 9, 3, 3, 0)
    assert metrics.histogram_bins(60, 384)[1] == (100, 200) or metrics.histogram_bins(60, 384)[1] == (50, 100)


def test_step_plans():
    assert plans.preference_steps(100, 2, 8, 3, 0.01) == {"total_steps": 21, "save_steps": 4, "warmup_steps": 1}
    assert plans.preference_steps(100, 2, 8, 3, 0.1)["warmup_steps"] == 2
    assert plans.preference_steps(95, 2, 8, 3, 0.01) == {"total_steps": 18, "save_steps": 4, "warmup_steps": 1}
    assert plans.preference_steps(4, 2, 8, 1, 0.1, 50) == {"total_steps": 1, "save_steps": 1, "warmup_steps": 0}
    assert plans.sft_steps(2000, 2, 8, 1, 0.03) == {"steps_per_epoch": 125, "warmup_steps": 3}


@pytest.fixture(scope="module")
def systems(spark):
    """Four rows answered by a (clean, capped loop, clean, capped) and b (all clean, short)."""
    rows = spark.createDataFrame([(i, f"q{i}", None, f"ref {i}") for i in range(4)], "index long, instruction string, input string, output string")
    tokens = {"a": [(30, True), (384, False), (60, True), (384, False)], "b": [(5, True), (10, True), (20, True), (8, True)]}
    texts = {"a": [GOOD, LOOP, GOOD, LOOP], "b": [GOOD] * 4}
    data = [(s, i, texts[s][i], n, stop) for s in "ab" for i, (n, stop) in enumerate(tokens[s])]
    gens = spark.createDataFrame(data, "system string, index long, text string, new_tokens int, stopped boolean")
    return rows, scoring.scored(rows, gens, 384).withColumn("rouge_l", F.lit(0.5)).cache()


def test_compare(systems):
    rows, scores = systems
    by = {r.system: r for r in compare.by_system(scores, 384).collect()}
    assert (by["a"].stopped_cleanly, by["a"].overall, by["a"].repetition_k, by["a"].overall_when_stopped) == (2, 2, 2, 2)
    assert (by["b"].overall, by["b"].repetition_n) == (4, 4)
    subsets = {r.subset: r for r in compare.pair_subsets(scores, [("a", "b")]).collect()}
    assert (subsets["both_stopped"].n, subsets["both_stopped"].a_new_tokens, subsets["both_stopped"].b_new_tokens) == (2, 45.0, 12.5)
    assert subsets["both_stopped"].median_length_ratio == pytest.approx((5 / 30 + 20 / 60) / 2) and subsets["b_short"].n == 3
    r = compare.pair_changes(scores, [("a", "b")]).first()
    assert (r.b_shorter, r.fixed, r.fixed_indices, r.regressed) == (4, 2, [1, 3], 0)
    back = compare.pair_changes(scores, [("b", "a")]).first()
    assert back.regressed_indices == [1, 3] and back.regressed_rules == ["clean_stop+repetition"] * 2
    short = {r.system: [e["index"] for e in r.examples] for r in compare.short_examples(scores, 20, 2).collect()}
    assert short == {"b": [0, 1]}
    example = compare.examples(rows, scores, [1], ["a", "b"]).first()
    assert example.a.failed == ["clean_stop", "repetition"] and example.b.new_tokens == 10
    assert compare.first_side_by_side(scores, ["a", "b"], 2).count() == 2


def test_grading(spark):
    index = spark.range(30).select(F.col("id").alias("index"))
    key = grading.blind_key(index, 1)
    assert key.collect().__len__() == 90 and key.groupBy("index").agg(F.countDistinct("label").alias("n")).where("n <> 3").count() == 0
    assert len({tuple(r.s) for r in key.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("label", "system")))["system"].alias("s")).collect()}) > 1
    rows = index.select("index", F.lit("q").alias("instruction"), F.lit("c").alias("input"), F.lit("ref").alias("output"))
    gens = key.select("index", "system", F.col("system").alias("text"))
    sheet = grading.sheet(rows, gens, key)
    assert sheet.columns == ["index", "prompt", "reference", "answers"] and sheet.first().prompt == "q\n\nContext: c"
    blind = key.select("index", "label", F.lit("correct").alias("grade"), F.lit("r").alias("reason"))
    checks.check_grades(blind, index)
    assert grading.unblind(blind, key).select("index", "system").distinct().count() == 90
    bad = spark.createDataFrame(
        [(None, "A", "wrong", "r"), (0, "D", "wrong", "r"), (0, "A", "great", "r"), (0, "B", "wrong", " "), (99, "A", "wrong", "r"), (0, "C", "wrong", "r"), (0, "C", "partly", "r")],
        "index long, label string, grade string, reason string",
    )
    got = {r.problem: r.n for r in checks.grade_problems(bad, index.where("index = 0")).groupBy("problem").agg(F.count("*").alias("n")).collect()}
    assert got == {"bad index": 1, "invalid label": 1, "invalid grade": 1, "empty reason": 1, "unexpected grade": 1, "duplicate grade": 1, "missing grade": 2}
    with pytest.raises(ValueError, match="missing grade"):
        checks.check_grades(blind.where("index > 0"), index)


def test_both_pass(spark):
    flags = {"base": "110100", "sft": "010111"}
    grades = spark.createDataFrame([("g", i, s, "correct" if f == "1" else "wrong", "r") for s, fs in [*flags.items(), ("dpo", "000000")] for i, f in enumerate(fs)], "grader string, index long, system string, grade string, reason string")
    passing = spark.createDataFrame([(i, s, i in (0, 1, 3) and s != "dpo") for i in range(6) for s in ("base", "sft", "dpo")], "index long, system string, overall boolean")
    got = {r.difference: r for r in grading.differences(grades, both_pass=passing).collect()}
    assert (got["sft - base"].n, got["sft - base"].a_correct, got["sft - base"].b_correct) == (3, 3, 2)
    assert (got["dpo - sft"].n, got["dpo - sft"]["diff"]) == (0, None)
    other = grades.withColumn("grader", F.lit("h"))
    text_out = report.grading_report(grading.summary(grades, passing), grading.differences(grades), grading.grader_agreement(grades.union(other)))
    assert "| g vs h | 18 | 100.0% | 1.000 |" in text_out and "## Grader g" in text_out
    d = grading.against_discarded(grades, other).first()
    assert d.exact_match == 1.0 and d.distinct_reasons == 1


def test_reports(spark, systems):
    _, scores = systems
    rates = metrics.rates(scoring.long_rules(scores, ["system"]).where("applies"), ["system", "rule"])
    table = report.rates_table(rates, ["format", "repetition", "domain_terms"], {"dpo": "no adapter"})
    assert "| a | 100.0 (4/4) [100.0, 100.0] | 50.0 (2/4)" in table and "n/a (0/0)" in table and "skipped: no adapter" in table
    assert '"x": null' in report.as_json(spark.sql("select cast(null as int) as x"))
    assert text.SYSTEM_PROMPT
    t = scoring.throughput(F.lit(10), F.lit(100), F.lit(0))
    assert spark.range(1).select(t.alias("t")).first().t.samples_per_minute is None


def test_failed_reasons_and_guards(spark, systems):
    _, scores = systems
    got = scores.where("system = 'a' and index = 1").select(scoring.failed_reasons()).first()[0]
    assert got[0] == "clean_stop: no stop token after 384 tokens" and got[1].startswith("repetition: 'over and over again'")
    limits = spark.createDataFrame([("a", 384), ("b", 384), ("c", 10)], "system string, n int")
    assert checks.single_value(limits.where("n = 384"), "n") == 384
    with pytest.raises(ValueError, match="one value"):
        checks.single_value(limits, "n")
    wanted = spark.createDataFrame([("base", None), ("sft", "x"), ("dpo", "y")], "system string, adapter string")
    there = spark.createDataFrame([("x",)], "adapter string")
    assert [tuple(r) for r in checks.skipped_systems(wanted, there).collect()] == [("dpo", "no adapter at y")]
    checks.check_system_names(wanted)
    for names in ([("a/b",)], [("a",), ("a",)]):
        with pytest.raises(ValueError, match="system name"):
            checks.check_system_names(spark.createDataFrame(names, "system string"))


def test_run_counts_are_pair_counts_in_one_pass(spark):
    table = [(0, 0, GOOD, 9, True), (0, 1, LOOP, 20, True), (1, 0, LOOP, 256, False), (1, 1, GOOD, 9, True), (2, 0, GOOD, 256, False), (2, 1, "<|x|>", 9, True), (3, 0, GOOD, 9, True), (3, 1, GOOD, 9, True)]
    rows, samples = scored_pairs(spark, table, 5)
    same = rows.withColumn("output", F.when(F.col("index") == 1, F.lit(LOOP)).otherwise(F.col("output")))
    got, want = scoring.run_counts(same, samples).first().asDict(), scoring.pair_counts(samples, 5, 2, 1).first().asDict()
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    empty = scoring.run_counts(rows.where("false"), samples.where("false")).first()
    assert empty.samples == 0 and empty["yield"] is None


def test_training_rows(spark):
    rows, samples = scored_pairs(spark, [(0, 0, LOOP, 9, False)], 1)
    r = scoring.training_rows(scoring.build_pairs(rows, samples)).first()
    assert [m.role for m in r.prompt] == ["system", "user"] and [tuple(m) for m in r.chosen] == [("assistant", "reference 0")]
    assert [tuple(m) for m in r.rejected] == [("assistant", LOOP)] and r.rejected_stopped is False


def test_changes_as_rows(systems):
    _, scores = systems
    got = {(r.pair, r["index"], r.kind, r.rules) for r in compare.changes(scores, [("a", "b"), ("b", "a")]).collect()}
    assert got == {("a->b", 1, "fixed", ""), ("a->b", 3, "fixed", ""), ("b->a", 1, "regressed", "clean_stop+repetition"), ("b->a", 3, "regressed", "clean_stop+repetition")}
    none = compare.pair_changes(scores.where("false"), [("a", "b")]).first()
    assert (none.fixed, none.fixed_indices, none.regressed_rules) == (0, [], [])


def test_ranks_of_far_apart_integers(spark):
    ids = [0, 1, 5, 4095, 4096, 4097, 10**6, 10**9, 10**9 + 1, 10**12, 4 * 10**15, 9 * 10**18]
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(5)
    assert [tuple(r) for r in scoring.with_rank(df, "k", "place").orderBy("k").collect()] == [(k, i) for i, k in enumerate(ids)]


def test_prompt_set_hash_by_definition(spark):
    from hashlib import sha256

    keys = [f"k {i % 700} é" for i in range(2000)] + [""]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "index long, key string").repartition(7)
    digest = lambda ks: sha256("\n".join(ks).encode()).hexdigest()
    assert tuple(checks.prompt_set_hash(df).first()) == (digest(sorted(keys)), 2001)
    assert tuple(checks.prompt_set_hash(df, order="index").first()) == (digest(keys), 2001)
    assert tuple(checks.prompt_set_hash(df.where("false")).first()) == (digest([]), 0)


def test_base_adapters(spark):
    adapters = spark.createDataFrame([("a", "1" * 64, None, None), ("b", "2" * 64, "a", "1" * 64), ("c", "3" * 64, "a", "9" * 64)], "adapter string, sha256 string, base_path string, base_sha256 string")
    systems = lambda *rows: spark.createDataFrame(rows, "system string, adapter string, base_adapter string")
    good = systems(("base", None, None), ("x", "a", None), ("y", "b", "a"))
    checks.check_base_adapters(good, adapters)
    assert {r.system: r.sha256 for r in checks.base_adapters(good, adapters).collect()} == {"base": None, "x": None, "y": "1" * 64}
    for row, said in ((("y", "b", None), "was trained on top of a"), (("z", "c", "a"), "trained on 999999999999"), (("q", "a", "gone"), "no base adapter at gone")):
        with pytest.raises(checks.WrongBase, match=said):
            checks.check_base_adapters(systems(row), adapters)


def test_sheets_and_keys_are_matched(spark):
    key = grading.blind_key(spark.range(5).select(F.col("id").alias("index")), 3)
    lines = key.select("index").distinct()
    checks.check_sheet(lines, key)
    bad = checks.sheet_problems(lines.where("index > 0").unionByName(lines.where("index = 1")), key.where("index <> 2 and not (index = 3 and label = 'A')"))
    assert {r["index"]: r.problem for r in bad.collect()} == {0: "not on the sheet", 1: "twice on the sheet", 2: "not in the key", 3: "bad labels"}
    with pytest.raises(ValueError, match="first 0: not on the sheet"):
        checks.check_sheet(lines.where("index > 0"), key)


def test_times(spark):
    from tessera.functions import times

    df = spark.sql("select timestamp_ntz'2024-02-29 23:59:58.9' as a, timestamp_ntz'2024-03-01 00:01:00.1' as b, cast(null as timestamp_ntz) as c")
    r = df.select(times.iso(F.col("a")).alias("a"), times.seconds(F.col("a"), F.col("b")).alias("s"), times.iso(F.col("c")).alias("c"), times.now().alias("n")).first()
    assert (r.a, r.s, r.c) == ("2024-02-29T23:59:58", 61, None) and r.n.endswith("+00:00") and len(r.n) == 25
