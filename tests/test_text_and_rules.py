import pytest
from pyspark.sql import functions as F

from tessera.functions import lexicon, numbers, rouge, rules, text, tokens


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_prompt_keys(spark):
    rows = [("  What is  an ETF? ", ""), ("What is an ETF?", None), ("what is an ETF?", None), ("What is an ETF?", "x"), ("a\x1cb c\u0085d", "\n")]
    got = values(spark, rows, "i string, x string", text.prompt_key(F.col("i"), F.col("x")))
    assert got == ["What is an ETF?", "What is an ETF?", "what is an ETF?", "What is an ETF? x", "a b c d"]


def test_messages_and_words(spark):
    turns = values(spark, [(" q ", " c ", " a\n"), ("q", "  ", "a"), ("q", "", "a"), ("q", None, "a")], "i string, x string, o string", text.messages(F.col("i"), F.col("x"), F.col("o")))
    assert [t[1].content for t in turns] == ["q\n\nContext: c", "q\n\nContext: ", "q", "q"]
    assert turns[0][0].content == text.SYSTEM_PROMPT and turns[0][2].content == "a"
    assert values(spark, [("",), (" a  b\tc\n",), (" ",)], "t string", text.word_count(F.col("t"))) == [0, 3, 0]


@pytest.mark.parametrize(
    "answer",
    ["", " \n", "a <|im_end|>", "<|im_start|>user", "user: hi", "x\nAssistant : y", "### Instruction", "Human:", "ok\nuser", "Question: x", "###response"],
)
def test_format_fails(spark, answer):
    assert values(spark, [(answer,)], "a string", rules.format_rule(rules.marks(F.col("a")))["passed"]) == [False]


def test_format_passes(spark):
    ok = ["The user: is fine", "User accounts are", "a | b", "< |x|>", "systematic", "ok\r  system"]
    assert all(values(spark, [(a,) for a in ok], "a string", rules.format_rule(rules.marks(F.col("a")))["passed"]))


def test_clean_stop(spark):
    rows = [(False, 80, 256), (True, 256, 256), (True, 80, 256)]
    got = values(spark, rows, "s boolean, n int, m int", rules.clean_stop_rule(F.col("s"), F.col("n"), F.col("m")))
    assert [(g.passed, g.reason) for g in got] == [(False, "no stop token after 80 tokens"), (False, "hit the 256-token limit"), (True, "ok")]


def test_repetition(spark):
    gram = "you can use it "
    rows = ["x ".join([gram] * 4), "y z ".join([gram] * 3), "One two three four. Then. ONE two, three four!", "Yes. Yes. Yes.", "a b c", ""]
    got = values(spark, [(a,) for a in rows], "a string", rules.repetition_rule(rules.loops(F.col("a"))))
    assert [g.passed for g in got] == [False, True, False, True, True, True]
    assert got[0].reason == "'you can use it' occurs 4 times" and got[2].reason == "sentence 'one two three four' occurs 2 times"


POSITIVE = ["How do I invest?", "my bank", "bankers agree", "Interest earned at a good rate", "$50,000 gift", "£100k", "the rate of interest", "buy shares now", "401(k) rules", "W: bank", "earn some interest", "interest of 5%"]
NEGATIVE = ["sat on the river bank", "food bank", "a list: bank, car", "of interest to teenagers", "your interests", "heart rate", "$15 each", "capital of France", "share a story", "ébank", "retirés", "taxi"]


def test_domain(spark):
    got = values(spark, [(t,) for t in POSITIVE + NEGATIVE], "t string", rules.is_domain(F.col("t")))
    expected = [t != "W: bank" for t in POSITIVE] + [False for _ in NEGATIVE]
    assert got == expected
    assert values(spark, [("pay the fee",), ("$5",), ("nothing",), ("I refused to pay",)], "t string", rules.answer_term(F.col("t"))) == ["pay", "$5", "", "pay"]


CASES = {
    "$1,000": [{"1e3"}], "5%": [{"5e0", "5e-2"}], "5 percent": [{"5e0", "5e-2"}], "3.50": [{"35e-1"}], "$1.5 million": [{"15e-1", "15e5"}], "$50k": [{"5e1", "5e4"}], "-2.5%": [{"25e-1", "25e-3"}],
    ".5%": [{"5e-1", "5e-3"}], "401(k) and 403(b)": [], "S&P 500": [], "W-2": [], "1099": [], "Q1": [], "2nd": [], "10x": [], "v2.0": [], "1,2345": [{"1e0"}, {"2345e0"}], "5%x": [{"5e0"}], "5 m": [{"5e0", "5e6"}], "0": [{"0"}],
    "1" + "0" * 40: [{"1e40"}], "form 1040": [],
}


def test_figures(spark):
    got = values(spark, [(t,) for t in CASES], "t string", F.transform(numbers.figures(F.col("t")), lambda f: f["values"]))
    assert [[set(v) for v in g] for g in got] == list(CASES.values())
    flags = values(spark, [("3 steps in 1999, 11 of 2.0 and 5%, 2100 1,950 $7",)], "t string", F.transform(numbers.figures(F.col("t")), lambda f: f["exempt"]))
    assert flags == [[True, True, False, False, False, False, False, False]]


def test_ungrounded(spark):
    rows = [("tax of 3%", "it is 7%", "12%"), ("tax", "3% and 7%", "3% or 0.07"), ("tax", "$25,000", "25000 in 1999"), ("tax", "none", "$52.50 at 5%")]
    got = values(spark, rows, "p string, r string, a string", rules.ungrounded(F.col("p"), F.col("r"), F.col("a")))
    assert got == [["12%"], [], [], ["$52.50", "5%"]]


def test_verdicts(spark):
    rows = [(["format"], True), (["repetition"], False), (["clean_stop"], False), ([], True), (["domain_terms", "ungrounded_numbers"], True), (["format", "clean_stop", "repetition"], False)]
    df = spark.createDataFrame(rows, "f array<string>, s boolean")
    got = df.select(rules.verdict(F.col("f"), F.col("s")), rules.reject_reasons(F.col("f"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("rejected", ["format"]), ("rejected", ["repetition", "no_stop_and_repetition"]), ("ambiguous", []), ("pass", []), ("pass", []), ("rejected", ["format", "repetition", "no_stop_and_repetition"])]


def test_tokens(spark):
    ids = spark.createDataFrame([([9, 8, 1, 7, 0],), ([9, 8, 7],), ([],)], "x array<int>")
    got = [r[0] for r in ids.select(tokens.trim_at_stop(F.col("x"), [1, 2])).collect()]
    assert [(list(g.ids), g.stopped) for g in got] == [([9, 8, 1], True), ([9, 8, 7], False), ([], False)]
    ends = spark.createDataFrame([([5, 6, 2, 9], False), ([5, 6, 2, 9], True), ([5, 2, 6, 2], False), ([5], False)], "x array<int>, s boolean")
    assert [list(r[0]) for r in ends.select(tokens.strip_unstopped_end(F.col("x"), F.col("s"), 2)).collect()] == [[5, 6], [5, 6, 2, 9], [5, 2, 6], [5]]
    assert values(spark, [([3, None, 3, 7, 9], 9)], "x array<int>, u int", tokens.stop_ids(F.col("x"), F.col("u"))) == [[3, 7]]
    import math

    logits = spark.createDataFrame([([0.0, math.log(2), 0.0, 0.0], 1), ([0.0, math.log(2), 0.0, 0.0], 0), ([1.0, 3.0, 3.0, 0.0, 3.0], 4), ([1.0, 3.0, 3.0, 0.0, 3.0], 0), ([1.0, 3.0, 3.0, 0.0, 3.0], 3)], "x array<double>, t int")
    rows = logits.select(tokens.token_probability(F.col("x"), F.col("t")).alias("p"), tokens.token_rank(F.col("x"), F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [1, 2, 1, 4, 5] and rows[0].p == pytest.approx(0.4) and rows[1].p == pytest.approx(0.2)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_rouge(spark):
    import random

    random.seed(0)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 12))] for _ in range(2))
        assert rouge.lcs(a, b) == plain_lcs(a, b)
    assert rouge.f1("the cat sat", "the cat sat on the mat") == pytest.approx(2 / 3)
    assert rouge.f1("", "x") == 0.0 and rouge.f1(None, "x") is None
    df = spark.createDataFrame([("a b", "a b"), ("x", "y")], "p string, r string")
    assert [r[0] for r in df.select(rouge.rouge_l(F.col("p"), F.col("r"))).collect()] == [1.0, 0.0]


def test_stems():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit vietnamization vietnam triplicate triplic hopeful hope goodness good revival reviv allowance allow adjustment adjust adoption adopt probate probat rate rate cease ceas controlling control rolling roll".split()
    assert {w: rouge.stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))


def test_lexicon_sizes():
    assert len(lexicon.PROMPT_TERMS) == 135 and len(lexicon.ANSWER_TERMS) == 39


def test_commonest_runs_by_counting():
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    lists = [[f"w{int(x)}" for x in rng.integers(0, k, n)] for k, n in ((2, 40), (3, 0), (1, 9), (5, 3), (2, 4), (9, 300))] + [None, ["a", "b"] * 30]
    for width in (1, 2, 4):
        got = rules.commonest(pa.array(lists, pa.list_(pa.string())), width).to_pylist()
        for x, r in zip(lists, got):
            runs = Counter(" ".join(x[i : i + width]) for i in range(len(x or []) - width + 1))
            assert r == ({"n": runs.most_common(1)[0][1], "item": runs.most_common(1)[0][0]} if runs else {"n": 0, "item": None})
    sliced = pa.array(lists, pa.list_(pa.string())).slice(2, 3)
    assert rules.commonest(sliced, 2).to_pylist() == rules.commonest(pa.array(lists[2:5], pa.list_(pa.string())), 2).to_pylist()


def test_stemmed_rouge_by_the_table():
    import numpy as np

    def table(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return int(t[-1, -1])

    stems = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "adjustable": "adjust", "effective": "effect", "probate": "probat", "controlling": "control", "the": "the"}
    assert {w: rouge.stem(w) for w in stems} == stems
    rng = np.random.default_rng(4)
    for _ in range(40):
        p, r = (" ".join(rng.choice(list(stems), rng.integers(0, 40))) for _ in "pr")
        a, b = ([stems[w] for w in t.split()] for t in (p, r))
        common = table(a, b)
        assert rouge.f1(p, r) == (2 * common / (len(a) + len(b)) if common else 0.0)
