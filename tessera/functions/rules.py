"""Rule-based checks of an answer, as columns: struct<applies, passed, reason>.

Rules are registered by name in a fixed order; a rule that doesn't apply counts as
neither passed nor failed in rates. Counting the grams of an answer by built-in
functions would take either a shuffle of all grams or an interpreted loop for each
row, so that one step is an Arrow function over whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon, numbers, text
from tessera.functions.binding import let, once
from tessera.sources.shared import importable

VERSION = "1"
# The rules and the reasons to reject, in the order in which they are reported.
RULES = ("format", "clean_stop", "repetition", "domain_terms", "ungrounded_numbers")
REASONS = ("format", "repetition", "no_stop_and_repetition")
# A gram of so many words that often is a loop; shorter sentences may repeat.
GRAM, GRAM_TIMES, SENTENCE_WORDS = 4, 4, 4
# What a decoded answer must not hold.
MARKER = r"<\|[a-z_]+\|>"
ROLE_LINE = (
    r"(?imd)^[ \t]*(?:(?:user|assistant|system|human|question|instruction|response)[ \t]*:"
    r"|###[ \t]*(?:instruction|input|response)|(?:user|assistant|system)[ \t]*$)"
)
WORD = "[a-z0-9']+"
SENTENCE_END = r"[.!?\n]+"


def result(applies: Column, passed: Column, reason: Column) -> Column:
    return F.struct(applies.alias("applies"), passed.alias("passed"), reason.alias("reason"))


def passed_or(failure: Column) -> Column:
    """A rule that applies and fails for the reason given, if there is one."""
    return result(F.lit(True), failure.isNull(), F.coalesce(failure, F.lit("ok")))


def marks(answer: Column) -> Column:
    """struct<blank, marker, role>: what the format rule looks for."""
    return F.struct((text.collapse(answer) == "").alias("blank"), F.regexp_extract(answer, MARKER, 0).alias("marker"), F.regexp_extract(answer, ROLE_LINE, 0).alias("role"))


def format_rule(found: Column) -> Column:
    quoted = F.concat(F.lit("role line '"), F.btrim(found["role"], F.lit(" \t")), F.lit("'"))
    return passed_or(
        F.when(found["blank"], F.lit("empty answer"))
        .when(found["marker"] != "", F.concat(F.lit("leaked chat marker "), found["marker"]))
        .when(found["role"] != "", quoted)
    )


def clean_stop_rule(stopped: Column, new_tokens: Column, limit: Column) -> Column:
    number = lambda c: c.cast("string")
    return passed_or(
        F.when(~stopped, F.concat(F.lit("no stop token after "), number(new_tokens), F.lit(" tokens"))).when(
            new_tokens >= limit, F.concat(F.lit("hit the "), number(limit), F.lit("-token limit"))
        )
    )


def commonest(lists: pa.ListArray, width: int) -> pa.StructArray:
    """struct<n, item> of each list's commonest run of `width` strings, joined by spaces: the first seen of equals; n is 0 without one.

    All lists at once: strings become numbers, runs become one number each by ranking
    pairs of numbers, and equal runs of a list stand together after one sort.
    """
    n, strings = len(lists), lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    count, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.flatnonzero(np.arange(len(strings)) + width <= offsets[1:][owner])
    if len(at):
        numbered = pc.dictionary_encode(strings).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        run = numbered[at]
        for k in range(1, width):
            _, run = np.unique(run * (numbered.max() + 1) + numbered[at + k], return_inverse=True)
        owner = owner[at]
        order = np.lexsort((run, owner))
        new = np.ones(len(at), bool)
        new[1:] = (owner[order[1:]] != owner[order[:-1]]) | (run[order[1:]] != run[order[:-1]])
        begin = np.flatnonzero(new)
        times, first, whose = np.diff(np.append(begin, len(at))), at[order[begin]], owner[order[begin]]
        best = np.lexsort((first, -times, whose))
        best = best[np.diff(whose[best], prepend=-1) > 0]
        count[whose[best]], place[whose[best]] = times[best], first[best]
    places = pa.array(place, mask=count == 0)
    item = pc.binary_join_element_wise(*[strings.take(pc.add(places, k)) for k in range(width)], " ")
    return pa.StructArray.from_arrays([pa.array(count), item], names=["n", "item"])


def words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def sentences(lowered: Column) -> Column:
    """Sentences of enough words, each as its words joined by a space."""
    found = F.transform(F.split(lowered, SENTENCE_END), words)
    return F.transform(F.filter(found, lambda w: F.size(w) >= SENTENCE_WORDS), lambda w: F.array_join(w, " "))


def loops(answer: Column) -> Column:
    """struct<gram, sentence>, each struct<n, item>: the commonest of each."""
    if spark := SparkSession.getActiveSession():
        importable(spark)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for found, said in batches:
            yield pa.StructArray.from_arrays([commonest(found, GRAM), commonest(said, 1)], names=["gram", "sentence"])

    lowered = F.lower(answer)
    kind = "struct<n:long,item:string>"
    return F.arrow_udf(run, f"gram {kind}, sentence {kind}").asNondeterministic()(words(lowered), sentences(lowered))


def repetition_rule(found: Column) -> Column:
    said = lambda x, start: F.concat(F.lit(f"{start}'"), x["item"], F.lit("' occurs "), x["n"].cast("string"), F.lit(" times"))
    gram, sentence = found["gram"], found["sentence"]
    return passed_or(F.when(gram["n"] >= GRAM_TIMES, said(gram, "")).when(sentence["n"] >= 2, said(sentence, "sentence ")))


def is_domain(prompt: Column) -> Column:
    """Whether a prompt is about finance."""
    found = F.lit(False)
    for pattern in lexicon.PROMPT_PATTERNS:
        found = found | prompt.rlike(pattern)
    return found


def answer_term(answer: Column) -> Column:
    """The first term or sum that keeps an answer on topic, or an empty string."""
    return F.regexp_extract(answer, lexicon.ANSWER_PATTERN, 0)


def domain_rule(domain: Column, term: Column) -> Column:
    reason = F.when(~domain, F.lit("not a finance row")).when(term != "", F.concat(F.lit("uses '"), term, F.lit("'"))).otherwise(F.lit("no finance term in a finance answer"))
    return result(domain, ~domain | (term != ""), reason)


def ungrounded(prompt: Column, reference: Column, answer: Column) -> Column:
    """Texts of the figures in an answer that share no value with prompt or reference."""
    source = numbers.all_values(numbers.figures(F.concat(prompt, F.lit("\n"), reference)))
    loose = let(source, lambda known: F.filter(numbers.figures(answer), lambda f: ~f["exempt"] & ~F.arrays_overlap(f["values"], known)))
    return F.transform(loose, lambda f: f["text"])


def numbers_rule(domain: Column, loose: Column) -> Column:
    reason = F.when(~domain, F.lit("not a finance row")).when(F.size(loose) > 0, F.concat(F.lit("not in prompt or reference: "), F.array_join(loose, ", "))).otherwise(F.lit("ok"))
    return result(domain, ~domain | (F.size(loose) == 0), reason)


def scored(df: DataFrame, domain: str, prompt: str, reference: str, answer: str, stopped: str, new_tokens: str, limit: int) -> DataFrame:
    """df with a struct column for each of the five rules; what they search for is found once for each row."""
    d, p, r, a = (F.col(c) for c in (domain, prompt, reference, answer))
    found = F.struct(
        marks(a).alias("marks"),
        F.when(d, answer_term(a)).otherwise(F.lit("")).alias("term"),
        F.when(d, ungrounded(p, r, a)).otherwise(F.array().cast("array<string>")).alias("loose"),
    )
    x = F.col("_found")
    made = F.struct(
        format_rule(x["marks"]).alias(RULES[0]),
        clean_stop_rule(F.col(stopped), F.col(new_tokens), F.lit(limit)).alias(RULES[1]),
        repetition_rule(F.col("_loops")).alias(RULES[2]),
        domain_rule(d, x["term"]).alias(RULES[3]),
        numbers_rule(d, x["loose"]).alias(RULES[4]),
    )
    out = df.withColumn("_loops", loops(a)).withColumn("_found", once(found)).withColumn("_rules", once(made))
    return out.withColumns({n: F.col("_rules")[n] for n in RULES}).drop("_loops", "_found", "_rules")


def failed(rules: dict[str, Column]) -> Column:
    """Names of the rules that apply and failed, in order."""
    return F.array_compact(F.array(*[F.when(r["applies"] & ~r["passed"], F.lit(n)) for n, r in rules.items()]))


def reject_reasons(failed_rules: Column, stopped: Column) -> Column:
    has = lambda rule: F.array_contains(failed_rules, rule)
    return F.array_compact(
        F.array(
            F.when(has("format"), F.lit(REASONS[0])),
            F.when(has("repetition"), F.lit(REASONS[1])),
            F.when(has("repetition") & ~stopped, F.lit(REASONS[2])),
        )
    )


def verdict(failed_rules: Column, stopped: Column) -> Column:
    """rejected, ambiguous or pass; domain and number rules never reject."""
    rejected = F.size(reject_reasons(failed_rules, stopped)) > 0
    return F.when(rejected, "rejected").when(F.array_contains(failed_rules, "clean_stop"), "ambiguous").otherwise("pass")
