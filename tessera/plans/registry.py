"""All queries over the provided tables, by name, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import numbers, rouge, rules, seeded, text, times, tokens
from tessera.operators import checks, compare, grading, metrics, plans, scoring, split
from tessera.plans import inputs, sql
from tessera.plans.inputs import LIMIT
from tessera.sources import jsonl
from tessera.sources.shared import importable, shared_folder

FLAGSHIP = "rubric_rates"
SEED = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Splits and leakage.

UNIQUE_DOCS = rf"""
  kept as (select *, {inputs.PROMPT_KEY} as key from rows where length(output) between 40 and 1500 and length(trim(regexp_replace(instruction, '\s+', ' ', 'g'))) > 0),
  uniq as (select * from kept qualify row_number() over (partition by key order by row_id) = 1),
  placed as (select *, row_number() over (order by md5('{SEED}:' || row_id), row_id) - 1 as position from uniq)
"""


def _sizes(placed: DataFrame) -> tuple[int, int]:
    """Four fifths and a tenth of the rows."""
    n = placed.count()
    return n * 8 // 10, n // 10


def _document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.document_rows(spark, sf_dir)
    train, held = _sizes(split.unique_rows(rows))
    return split.split(rows, train, held, SEED)


@query(f"""with rows as ({inputs.DOCUMENT_ROWS}), {UNIQUE_DOCS}, n as (select count(*) as u from uniq)
    select u * 8 // 10 as train_rows, u // 10 as eval_rows, (select count(*) from kept) - u as duplicates_dropped from n""")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_stats(inputs.document_rows(spark, sf_dir), _document_split(spark, sf_dir))


@query(f"""with rows as ({inputs.DOCUMENT_ROWS}), {UNIQUE_DOCS}, n as (select count(*) as u from uniq)
    select row_id, position, case when position < u * 8 // 10 then 'train' when position < u * 8 // 10 + u // 10 then 'eval' else 'rest' end as split from placed, n""")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_split(spark, sf_dir).select("row_id", "position", "split")


@query(rf"""with rows as ({inputs.CHAT_ROWS}) select row_id, {inputs.PROMPT_KEY} as prompt_key, 3 as turns,
    trim(instruction, ' ' || chr(10)) || case when length(coalesce(input, '')) > 0 then chr(10) || chr(10) || 'Context: ' || trim(input, ' ' || chr(10)) else '' end as user_turn,
    trim(output, ' ' || chr(10)) as answer, len(string_split(trim(regexp_replace(output, '\s+', ' ', 'g')), ' ')) as words from rows""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.chat_rows(spark, sf_dir)
    turns = text.messages(F.col("instruction"), F.col("input"), F.col("output"))
    made = rows.select("row_id", "output", text.prompt_key(F.col("instruction"), F.col("input")).alias("prompt_key"), turns.alias("turns"))
    return made.select(
        "row_id", "prompt_key", F.size("turns").alias("turns"), F.element_at(text.prompt_messages(F.col("turns")), -1)["content"].alias("user_turn"),
        F.get(text.completion(F.col("turns")), F.lit(0))["content"].alias("answer"), text.word_count(F.col("output")).alias("words"),
    )


@query(f"""with rows as ({inputs.DOCUMENT_ROWS}), {UNIQUE_DOCS}, n as (select count(*) as u from uniq),
    parts as (select key, position < u * 8 // 10 as train, position >= u * 8 // 10 and position < u * 8 // 10 + u // 10 as eval from placed, n),
    saved as (select distinct trim(regexp_replace(text, '\\s+', ' ', 'g')) as key from benchmark union select key from parts where eval),
    rebuilt as (select key from parts where eval), train as (select key from parts where train)
    select (select count(*) from (select key from saved except select key from rebuilt)) as missing, (select count(*) from (select key from rebuilt except select key from saved)) as unexpected,
           (select count(*) from (select key from saved intersect select key from train)) as in_training""")
def split_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt evaluation split against saved keys, which here hold the benchmark's besides."""
    placed = split.with_key(_document_split(spark, sf_dir))
    held = placed.where("split = 'eval'")
    bench = inputs.table(spark, sf_dir, "benchmark").select(text.collapse(F.col("text")).alias("key"))
    return checks.key_differences(held.select("key").union(bench), held, placed.where("split = 'train'"))


@query(f"""with rows as ({inputs.DOCUMENT_ROWS}) select row_id from rows where {inputs.PROMPT_KEY} in (select trim(regexp_replace(text, '\\s+', ' ', 'g')) from benchmark)""")
def leaked_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = inputs.table(spark, sf_dir, "benchmark").select(text.collapse(F.col("text")).alias("key"))
    return checks.leaked(split.with_key(inputs.document_rows(spark, sf_dir)), bench).select("row_id")


BENCH_ROWS = f"select * from ({inputs.DOCUMENT_ROWS}) union all select -1 - row_number() over (order by item_id), '  ' || text, case when item_id % 3 = 0 then 'more' end, text from benchmark where text is not null"


@query(f"""with rows as ({BENCH_ROWS}) select row_id, {inputs.PROMPT_KEY} as key from rows where {inputs.PROMPT_KEY} in (select trim(regexp_replace(text, '\\s+', ' ', 'g')) from benchmark)""")
def leaked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and the benchmark's own items as rows of which two in three have the item's key."""
    bench = inputs.table(spark, sf_dir, "benchmark").where("text is not null")
    place = F.row_number().over(Window.orderBy("item_id"))
    items = bench.select((-1 - place).cast("long").alias("row_id"), F.concat(F.lit("  "), "text").alias("instruction"), F.when(F.col("item_id") % 3 == 0, "more").alias("input"), F.col("text").alias("output"))
    rows = inputs.document_rows(spark, sf_dir).unionByName(items)
    keys = bench.select(text.collapse(F.col("text")).alias("key"))
    return checks.leaked(split.with_key(rows), keys).select("row_id", "key")


@query(f"""with g as ({inputs.INDEXED_ROWS}), k as (select index, {inputs.PROMPT_KEY} as key from g)
    select 'sorted' as kind, sha256(string_agg(key, chr(10) order by key)) as sha256, count(*) as n from k union all
    select 'ordered', sha256(string_agg(key, chr(10) order by index)), count(*) from k""")
def prompt_set_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.with_key(inputs.indexed_rows(spark, sf_dir))
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "sha256", "n")
    return kind(checks.prompt_set_hash(rows), "sorted").unionByName(kind(checks.prompt_set_hash(rows, order="index"), "ordered"))


@query(f"""with g as ({inputs.INDEXED_ROWS}) select index, md5('{SEED}:' || index) as digest from g order by md5('{SEED}:' || index), index limit 20""")
def picked_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty prompts by seeded order: the sample is the feature."""
    rows = inputs.indexed_rows(spark, sf_dir).select("index")
    return split.pick(rows, 20, SEED).select("index", seeded.digest(SEED, F.col("index")).alias("digest"))


@query(f"""with g as ({inputs.INDEXED_ROWS}) select index * 2 + s as index, index as prompt_index, s::int as sample, (index * 2 + s) // 16 as batch, (index * 2 + s) // 16 + {SEED} as batch_seed from g, range(2) as t(s)""")
def sample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = inputs.indexed_rows(spark, sf_dir).select(F.col("index").alias("prompt_index"))
    return split.sample_plan(prompts, 2, 16, SEED).select("index", "prompt_index", "sample", "batch", "batch_seed")


@query(f"""with g as ({inputs.GENERATIONS}), bad as (select system, index, case when index % 50 = 7 then prompt_key || '!' else prompt_key end as given, prompt_key as wanted from g)
    select system, count(*) as misaligned, min(index) as first_row from bad where given <> wanted group by system""")
def misaligned_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults found in generations of which every fiftieth has another key."""
    g = inputs.generations(spark, sf_dir)
    rows = split.with_key(inputs.indexed_rows(spark, sf_dir), "prompt_key").select("index", "prompt_key")
    spoiled = g.withColumn("prompt_key", F.when(F.col("index") % 50 == 7, F.concat("prompt_key", F.lit("!"))).otherwise(F.col("prompt_key")))
    out = None
    for s in checks.SYSTEMS:
        found = checks.misaligned(spoiled.where(F.col("system") == s), rows).agg(F.count("*").alias("misaligned"), F.min("index").alias("first_row")).where("misaligned > 0")
        found = found.select(F.lit(s).alias("system"), "misaligned", "first_row")
        out = found if out is None else out.unionByName(found)
    return out


# Rules, verdicts and pairs.

SCORES = sql.scores(inputs.GENERATIONS, LIMIT)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(inputs.indexed_rows(spark, sf_dir), inputs.generations(spark, sf_dir), LIMIT)


@query(SCORES + "select system, index, array_to_string(failed, '+') as failed, overall, verdict, domain as is_finance from scored")
def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.with_verdict(_scores(spark, sf_dir))
    return s.select("system", "index", F.array_join("failed", "+").alias("failed"), "overall", "verdict", F.col("domain_terms.applies").alias("is_finance"))


@query(SCORES + rf""", g as (select index, system, p, array_to_string(w[p : p + 3], ' ') as item from w, unnest(range(1, greatest(len(w) - 2, 1))) as t(p)),
    top_gram as (select index, system, item, count(*) as n from g group by index, system, item qualify row_number() over (partition by index, system order by count(*) desc, min(p)) = 1),
    said as (select index, system, p, array_to_string(kept[p], ' ') as item from (select index, system, list_filter(s, lambda x: len(x) >= {rules.SENTENCE_WORDS}) as kept from w), unnest(range(1, len(kept) + 1)) as t(p)),
    top_said as (select index, system, item, count(*) as n from said group by index, system, item qualify row_number() over (partition by index, system order by count(*) desc, min(p)) = 1)
    select s.system, s.index,
      case when regexp_matches(text, '^\s*$') then 'empty answer' when regexp_matches(text, '<\|[a-z_]+\|>') then 'leaked chat marker ' || regexp_extract(text, '<\|[a-z_]+\|>')
           when not format_ok then 'role line ''' || trim(regexp_extract(text, {sql.quoted(sql.ROLE)}), ' ' || chr(9)) || '''' else 'ok' end as format,
      case when not stopped then 'no stop token after ' || new_tokens || ' tokens' when new_tokens >= {LIMIT} then 'hit the {LIMIT}-token limit' else 'ok' end as clean_stop,
      case when tg.n >= {rules.GRAM_TIMES} then '''' || tg.item || ''' occurs ' || tg.n || ' times' when ts.n >= 2 then 'sentence ''' || ts.item || ''' occurs ' || ts.n || ' times' else 'ok' end as repetition,
      case when not domain then 'not a finance row' when domain_terms_ok then 'term found' else 'no finance term in a finance answer' end as domain_terms,
      case when not domain then 'not a finance row' when ungrounded_numbers_ok then 'ok'
           else 'not in prompt or reference: ' || array_to_string(list_transform(list_filter(regexp_extract_all(text, '\$(\d+)', 1), lambda x: not list_contains(regexp_extract_all(instruction || chr(10) || coalesce(input, ''), '\d+'), x)), lambda x: '$' || x), ', ') end as ungrounded_numbers
    from scored s left join top_gram tg using (index, system) left join top_said ts using (index, system)""")
def rubric_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule says of each answer; which finance term was found is left out."""
    s = _scores(spark, sf_dir)
    term = F.regexp_replace("domain_terms.reason", r"(?s)^uses '.*'$", "term found")
    return s.select("system", "index", *[F.col(f"{r}.reason").alias(r) if r != "domain_terms" else term.alias(r) for r in rules.RULES])


#: Prompts with one figure and answers with it in another form, or every fifth time with another figure.
FIGURE_ROWS = """select index, case k when 0 then 'It is ' || n || '%.' when 1 then 'We sold ' || n || '.5 million.' when 2 then 'A loan of $' || n || ',000 here.' when 3 then 'Pay ' || n || 'k now.' when 4 then 'At ' || n || ' percent.' else 'A sum of ' || n || '.25 each.' end as prompt,
    case k when 0 then 'That is 0.' || m || ' of it.' when 1 then 'So ' || m || ',500,000 sold.' when 2 then 'It was ' || m || ' thousand.' when 3 then 'That is $' || m || ',000.' when 4 then 'Or ' || m || '%.' else 'Each is ' || m || '.250.' end as answer, m = n as grounded
    from (select index, index % 6 as k, 11 + index % 80 as n, 11 + index % 80 + case when index % 5 = 0 then 3 else 0 end as m from ({rows}))"""
FIGURE = r"""list_transform(regexp_extract_all({text}, '\d+(?:,\d\d\d)*(?:\.\d+)?(?: million| thousand|k)?(?:%| percent)?'), lambda x: [round(replace(regexp_extract(x, '^[\d.,]+'), ',', '')::double, 6),
    round(replace(regexp_extract(x, '^[\d.,]+'), ',', '')::double * case when contains(x, 'million') then 1e6 when contains(x, 'thousand') or contains(x, 'k') then 1e3 when contains(x, '%') or contains(x, 'percent') then 0.01 else 1 end, 6)])"""


@query("with r as (" + FIGURE_ROWS.replace("{rows}", inputs.INDEXED_ROWS) + "), f as (select *, list_distinct(flatten(" + FIGURE.replace("{text}", "prompt") + ")) as known, " + FIGURE.replace("{text}", "answer") + """ as found from r)
    select index, prompt, answer, len(list_filter(found, lambda x: not list_has_any(x, known))) as loose, len(list_distinct(flatten(found))) as n_values, grounded from f""")
def grounded_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with multipliers, percent signs, decimals and grouping: how many of an answer's are not in its prompt."""
    made = inputs.indexed_rows(spark, sf_dir).selectExpr("index", "index % 6 as k", "11 + index % 80 as n", "11 + index % 80 + if(index % 5 = 0, 3, 0) as m")
    lead = F.expr("case k when 0 then concat('It is ', n, '%.') when 1 then concat('We sold ', n, '.5 million.') when 2 then concat('A loan of $', n, ',000 here.') when 3 then concat('Pay ', n, 'k now.') when 4 then concat('At ', n, ' percent.') else concat('A sum of ', n, '.25 each.') end")
    said = F.expr("case k when 0 then concat('That is 0.', m, ' of it.') when 1 then concat('So ', m, ',500,000 sold.') when 2 then concat('It was ', m, ' thousand.') when 3 then concat('That is $', m, ',000.') when 4 then concat('Or ', m, '%.') else concat('Each is ', m, '.250.') end")
    texts = made.select("index", lead.alias("prompt"), said.alias("answer"), (F.col("m") == F.col("n")).alias("grounded"))
    loose = F.size(rules.ungrounded(F.col("prompt"), F.lit(""), F.col("answer"))).cast("long")
    values = F.size(numbers.all_values(numbers.figures(F.col("answer")))).cast("long")
    return texts.select("index", "prompt", "answer", loose.alias("loose"), values.alias("n_values"), "grounded")


LONG = " union all ".join(f"select system, index, '{r}' as rule, {r}_ok as passed from scored" + (" where domain" if r in rules.RULES[3:] else "") for r in rules.RULES) + " union all select system, index, 'overall', overall from scored"


@query(
    SCORES
    + f""", flags as ({LONG}), counts as (select system, rule, count(*) filter (passed) as up, 0 as down, count(*) as n from flags group by system, rule),
    ci as ({sql.interval('counts', 'system, rule')})
    select c.system, c.rule, up as k, n, round(up / n::double, 6) as rate, ci_lo, ci_hi from counts c join ci using (system, rule)"""
)
def rubric_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates of each system and rule over the rows it applies to, with bootstrap intervals."""
    flags = scoring.long_rules(_scores(spark, sf_dir), ["system"]).where("applies")
    return rounded(metrics.rates(flags, ["system", "rule"]), "rate", "ci_lo", "ci_hi")


REFERENCES = f"select index, 'ref' as system, row_id, instruction, input, output, output as text, 1 as new_tokens, true as stopped from ({inputs.INDEXED_ROWS})"


@query(
    sql.scores(REFERENCES, 2)
    + f""", flags as ({LONG}) select rule, count(*) as applies, count(*) filter (passed) as passed, round(count(*) filter (passed) / count(*)::double, 4) as rate from flags group by rule
    union all select 'finance_rows', count(*), count(*) filter (domain), round(count(*) filter (domain) / count(*)::double, 4) from scored
    union all select 'numbers_without_reference', count(*) filter (domain), count(*) filter (domain and ungrounded_numbers_ok), round(count(*) filter (domain and ungrounded_numbers_ok) / (count(*) filter (domain))::double, 4) from scored"""
)
def references_under_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference answers scored as if generated; and the number rule without the reference as a source."""
    rows = inputs.indexed_rows(spark, sf_dir)
    answers = rows.select("index", F.col("output").alias("text"), F.lit(1).alias("new_tokens"), F.lit(True).alias("stopped"))
    scores = scoring.scored(rows, answers, 2)
    bare = scoring.scored(rows.withColumn("output", F.lit("")), answers, 2)
    applied = scoring.long_rules(scores, ["index"]).where("applies").select("rule", "passed")
    finance = scores.select(F.lit("finance_rows").alias("rule"), F.col("domain_terms.applies").alias("passed"))
    without = bare.where("ungrounded_numbers.applies").select(F.lit("numbers_without_reference").alias("rule"), F.col("ungrounded_numbers.passed").alias("passed"))
    every = applied.unionByName(finance).unionByName(without)
    k = F.count_if("passed")
    return every.groupBy("rule").agg(F.count("*").alias("applies"), k.alias("passed"), F.round(F.try_divide(k, F.count("*")), 4).alias("rate"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_verdict(scoring.scored(inputs.indexed_rows(spark, sf_dir), inputs.samples(spark, sf_dir), LIMIT))


PAIRS = (
    SCORES
    + """, sample as (select *, case system when 'base' then 0 else 1 end as sample from scored where system <> 'dpo'),
    chosen as (select * from sample where verdict = 'rejected' qualify row_number() over (partition by index order by sample) = 1),
    kept as (select *, row_number() over (order by index) - 1 as pair from chosen where trim(text, ' ' || chr(10)) <> trim(output, ' ' || chr(10)))"""
)


@query(PAIRS + """ select pair as index, index as prompt_index, trim(output, ' ' || chr(10)) as chosen, text as rejected, sample as rejected_sample, stopped as rejected_stopped, array_to_string(failed, '+') as rejected_failed_rules,
    array_to_string(list_filter([case when not format_ok then 'format' end, case when not repetition_ok then 'repetition' end, case when not repetition_ok and not stopped then 'no_stop_and_repetition' end], lambda x: x is not null), '+') as rejected_reasons from kept""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scoring.build_pairs(inputs.indexed_rows(spark, sf_dir), _samples(spark, sf_dir))
    joined = lambda c: F.array_join(c, "+").alias(c)
    return pairs.select("index", "prompt_index", "chosen", "rejected", "rejected_sample", "rejected_stopped", joined("rejected_failed_rules"), joined("rejected_reasons"))


@query(PAIRS + r""" select pair as index, 2 as prompt_turns, 'system' as first_role, trim(instruction, ' ' || chr(10)) || case when length(coalesce(input, '')) > 0 then chr(10) || chr(10) || 'Context: ' || trim(input, ' ' || chr(10)) else '' end as asked,
    'assistant' as chosen_role, trim(output, ' ' || chr(10)) as chosen, 'assistant' as rejected_role, text as rejected, stopped as rejected_stopped from kept""")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as arrays of messages, taken apart again."""
    made = scoring.training_rows(scoring.build_pairs(inputs.indexed_rows(spark, sf_dir), _samples(spark, sf_dir)))
    one = lambda c: F.element_at(c, 1)
    return made.select(
        "index", F.size("prompt").alias("prompt_turns"), one("prompt")["role"].alias("first_role"), F.element_at("prompt", -1)["content"].alias("asked"),
        one("chosen")["role"].alias("chosen_role"), one("chosen")["content"].alias("chosen"), one("rejected")["role"].alias("rejected_role"), one("rejected")["content"].alias("rejected"), "rejected_stopped",
    )


@query(PAIRS + f""", held as (select *, row_number() over (order by md5('{SEED}:' || pair), pair) - 1 as place from kept), n as (select count(*) as n from kept)
    select pair as index, place < least(greatest(1, round_even(0.1 * n, 0)), n - 1) as held from held, n""")
def pair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scoring.build_pairs(inputs.indexed_rows(spark, sf_dir), _samples(spark, sf_dir)).select("index")
    return split.split_pairs(pairs, 0.1, SEED).select("index", "held")


@query(PAIRS + """, per as (select index, bool_or(verdict = 'rejected') as r, bool_and(verdict = 'pass') as p from sample group by index)
    select count(*) as samples, count(*) filter (verdict = 'rejected') as samples_rejected, count(*) filter (verdict = 'ambiguous') as ambiguous_skipped, count(*) filter (verdict = 'pass') as samples_pass,
      count(*) filter (not format_ok) as rejections_format, count(*) filter (not repetition_ok) as rejections_repetition, count(*) filter (not repetition_ok and not stopped) as rejections_no_stop_and_repetition,
      count(*) filter (not clean_stop_ok) as failures_clean_stop, count(*) filter (not domain_terms_ok) as failures_domain_terms, count(*) filter (not ungrounded_numbers_ok) as failures_ungrounded_numbers,
      count(*) filter (not ungrounded_numbers_ok and verdict <> 'rejected') as ungrounded_numbers_failures_not_rejected, round(avg(new_tokens), 6) as mean_new_tokens, round(avg(stopped::int), 6) as stopped_share,
      (select count(*) from per where r) as prompts_with_rejected_sample, (select count(*) from per where p) as prompts_all_samples_pass, (select count(*) from kept) as pairs_kept,
      (select count(*) from chosen) - (select count(*) from kept) as pairs_dropped_rejected_equals_chosen, round((select count(*) from kept) / (select count(*) from per)::double, 6) as "yield" from sample""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = scoring.run_counts(inputs.indexed_rows(spark, sf_dir), _samples(spark, sf_dir))
    wanted = ["samples", "samples_rejected", "ambiguous_skipped", "samples_pass", *[f"rejections_{r}" for r in rules.REASONS], "failures_clean_stop", "failures_domain_terms", "failures_ungrounded_numbers",
              "ungrounded_numbers_failures_not_rejected", "mean_new_tokens", "stopped_share", "prompts_with_rejected_sample", "prompts_all_samples_pass", "pairs_kept", "pairs_dropped_rejected_equals_chosen", "yield"]
    return rounded(counts.select(*wanted), "mean_new_tokens", "stopped_share", "yield")


# Comparison of systems.


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with ROUGE-L against the reference."""
    importable(spark)
    refs = inputs.indexed_rows(spark, sf_dir).select("index", F.col("output").alias("reference"))
    joined = _scores(spark, sf_dir).join(refs, "index")
    return joined.withColumn("rouge_l", rouge.rouge_l(F.col("text"), F.col("reference"))).drop("reference")


SYSTEM_PAIRS = [("base", "sft"), ("sft", "dpo")]


@query(SCORES + r""" select system, count(*) as n, round(avg(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))), 6) as words_mean, count(*) filter (stopped) as stopped,
    count(*) filter (clean_stop_ok) as stopped_cleanly, count(*) filter (overall) as overall, count(*) filter (clean_stop_ok and overall) as overall_when_stopped,
    """ + ", ".join(f"count(*) filter ({r}_ok{' and domain' if r in rules.RULES[3:] else ''}) as {r}_k, count(*) filter ({'domain' if r in rules.RULES[3:] else 'true'}) as {r}_n" for r in rules.RULES) + " from scored group by system")  # fmt: skip
def system_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir).withColumn("rouge_l", F.lit(None).cast("double"))
    return rounded(compare.by_system(scores, LIMIT).drop("rouge_l_mean"), "words_mean")


@query(f"""with g as ({inputs.GENERATIONS}) select system, count(*) as n, round(avg(new_tokens), 6) as mean, """ + ", ".join(f"round(quantile_cont(new_tokens, {p / 100}), 6) as {'median' if p == 50 else f'p{p}'}" for p in (10, 25, 50, 75, 90)) + f""",
    min(new_tokens) as least, max(new_tokens) as most, count(*) filter (new_tokens >= {LIMIT}) as at_limit, count(*) filter (new_tokens < 20) as short, """
    + ", ".join(f"count(*) filter (new_tokens >= {lo}" + (f" and new_tokens < {hi}" if hi is not None else "") + f") as bin_{lo}_{'up' if hi is None else hi}" for lo, hi in metrics.histogram_bins(20, LIMIT)) + " from g group by system")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.length_stats(inputs.generations(spark, sf_dir), ["system"], limit=LIMIT), "mean", "p10", "p25", "median", "p75", "p90")


BOTH = """, ab as (select a.system || '->' || b.system as pair, a.index, a.new_tokens as an, b.new_tokens as bn, a.clean_stop_ok as ac, b.clean_stop_ok as bc, a.overall as ao, b.overall as bo, b.failed as bf
    from scored a join scored b using (index) where (a.system, b.system) in (('base', 'sft'), ('sft', 'dpo')))"""


@query(SCORES + BOTH + """, tagged as (select *, unnest(list_filter([case when ac and bc then 'both_stopped' end, case when not ac then 'a_did_not_stop' end, case when bn < 20 then 'b_short' end, case when ac then 'a_stopped' end], lambda x: x is not null)) as subset from ab),
    every as (select pair, subset from (select distinct pair from ab), (values ('both_stopped'), ('a_did_not_stop'), ('b_short'), ('a_stopped')) as t(subset))
    select e.pair, e.subset, count(t.index) as n, round(avg(an), 6) as a_new_tokens, round(avg(bn), 6) as b_new_tokens, count(*) filter (ao) as a_overall, count(*) filter (bo) as b_overall,
      round(median(case when e.subset = 'both_stopped' then bn / an::double end), 6) as median_length_ratio from every e left join tagged t using (pair, subset) group by e.pair, e.subset""")
def pair_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir).withColumn("rouge_l", F.lit(None).cast("double"))
    return rounded(compare.pair_subsets(scores, SYSTEM_PAIRS, LIMIT).drop("a_rouge_l", "b_rouge_l"), "a_new_tokens", "b_new_tokens", "median_length_ratio")


@query(SCORES + BOTH + """ select pair, count(*) filter (bn < an) as b_shorter, count(*) filter (not ao and bo) as fixed, coalesce(string_agg(index::varchar, ',' order by index) filter (not ao and bo), '') as fixed_indices,
    count(*) filter (ao and not bo) as regressed, coalesce(string_agg(index::varchar, ',' order by index) filter (ao and not bo), '') as regressed_indices,
    coalesce(string_agg(array_to_string(bf, '+'), ',' order by index) filter (ao and not bo), '') as regressed_rules from ab group by pair""")
def pair_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir).withColumn("rouge_l", F.lit(None).cast("double"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return compare.pair_changes(scores, SYSTEM_PAIRS, LIMIT).withColumns({c: joined(c) for c in ("fixed_indices", "regressed_indices", "regressed_rules")})


@query(SCORES + BOTH + """ select pair, case when bo then 'fixed' else 'regressed' end as kind, index, case when bo then '' else array_to_string(bf, '+') end as rules from ab where ao <> bo""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each prompt on which the second of two systems does better or worse."""
    return compare.changes(_scores(spark, sf_dir).withColumn("rouge_l", F.lit(None).cast("double")), SYSTEM_PAIRS, LIMIT)


@query(f"""with g as ({inputs.GENERATIONS}) select system, index, new_tokens::int as new_tokens, text from g where new_tokens < 60 qualify row_number() over (partition by system order by index) <= 5""")
def short_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five short answers of each system: the limit is the feature."""
    found = compare.short_examples(inputs.generations(spark, sf_dir), 60, 5)
    return found.select("system", F.explode("examples").alias("e")).select("system", "e.index", "e.new_tokens", "e.text")


@query(f"""with recursive g as ({inputs.GENERATIONS}), words as (select index, regexp_extract_all(lower(text), '[a-z0-9]+') as r, lead(regexp_extract_all(lower(output), '[a-z0-9]+'), 1, []) over (order by index) as p from g where system = 'dpo'),
    cells(index, i, j, l) as (select index, 0::bigint, j, 0 from words, unnest(range(len(p) + 1)) as u(j) union all
      select index, i + 1, j, max(x) over (partition by index order by j) from (
        select c.index, c.i, c.j, greatest(c.l, coalesce(lag(c.l) over (partition by c.index order by c.j) + (w.p[c.j] = w.r[c.i + 1])::int, 0)) as x from cells c join words w using (index) where c.i < len(w.r)))
    select w.index, max(l)::int as lcs, round(case when max(l) > 0 then 2 * max(l) / (len(any_value(p)) + len(any_value(r)))::double else 0 end, 9) as f1 from words w join cells c on w.index = c.index and c.i = len(w.r) and c.j = len(w.p) group by w.index""")
def rouge_l_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain ROUGE-L of one system's answers against the next row's output, which has other words."""
    importable(spark)
    answers = inputs.generations(spark, sf_dir).where("system = 'dpo'").select("index", "text")
    after = inputs.indexed_rows(spark, sf_dir).select((F.col("index") - 1).alias("index"), F.col("output").alias("reference"))
    made = answers.join(after, "index", "left").withColumn("f1", rouge.rouge_l(F.col("text"), F.coalesce("reference", F.lit("")), stemmed=False))
    count = lambda c: F.size(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return made.select("index", F.round(F.col("f1") * (count("text") + count("reference")) / 2).cast("int").alias("lcs"), F.round("f1", 9).alias("f1"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean stemmed and plain ROUGE-L F1 of each system."""
    importable(spark)
    refs = inputs.indexed_rows(spark, sf_dir).select("index", F.col("output").alias("reference"))
    joined = inputs.generations(spark, sf_dir).join(refs, "index")
    made = joined.select("system", rouge.rouge_l(F.col("text"), F.col("reference")).alias("s"), rouge.rouge_l(F.col("text"), F.col("reference"), stemmed=False).alias("p"))
    return made.groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("rouge_l"), F.round(F.avg("p"), 6).alias("rouge_l_plain"))


@query()
def pair_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsets of system pairs with their mean ROUGE-L."""
    return rounded(compare.pair_subsets(_compared(spark, sf_dir), SYSTEM_PAIRS, LIMIT).select("pair", "subset", "n", "a_rouge_l", "b_rouge_l"), "a_rouge_l", "b_rouge_l")


@query(f"""with g as ({inputs.GENERATIONS}) select index, max(case when system = 'base' then text end) as base, max(case when system = 'sft' then text end) as sft,
    bool_or(system = 'base' and stopped) as base_stopped, bool_or(system = 'sft' and stopped) as sft_stopped from g where index < 8 group by index""")
def first_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight rows side by side: the limit is the feature."""
    both = compare.first_side_by_side(inputs.generations(spark, sf_dir), ["base", "sft"], 8)
    return both.select("index", F.col("base.text").alias("base"), F.col("sft.text").alias("sft"), F.col("base.stopped").alias("base_stopped"), F.col("sft.stopped").alias("sft_stopped"))


# Grading.

KEY = f"""key as (select index, system, ['A', 'B', 'C'][row_number() over (partition by index order by md5('blind-grading:{SEED}:' || index || ':' || system), system)] as label from g)"""


@query(f"""with g as ({inputs.GENERATIONS}), {KEY} select g.index, any_value(trim(instruction, ' ' || chr(10)) || case when length(coalesce(input, '')) > 0 then chr(10) || chr(10) || 'Context: ' || trim(input, ' ' || chr(10)) else '' end) as prompt,
    any_value(output) as reference, max(case when label = 'A' then text end) as a, max(case when label = 'B' then text end) as b, max(case when label = 'C' then text end) as c from g join key using (index, system) group by g.index""")
def blind_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.indexed_rows(spark, sf_dir)
    made = grading.sheet(rows, inputs.generations(spark, sf_dir), grading.blind_key(rows, SEED))
    return made.select("index", "prompt", "reference", *[F.try_element_at("answers", F.lit(x)).alias(x.lower()) for x in checks.LABELS])


@query(f"""with g as ({inputs.GENERATIONS}), {KEY}, gr as ({inputs.GRADES}) select gr.grader, key.label, gr.system, gr.grade, count(*) as n from gr join key using (index, system) group by all""")
def unblinded_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind grades, mapped back to systems through the key."""
    key = grading.blind_key(inputs.indexed_rows(spark, sf_dir), SEED)
    blind = inputs.grades(spark, sf_dir).join(key, ["index", "system"]).drop("system")
    return grading.unblind(blind, key).join(key, ["index", "system"]).groupBy("grader", "label", "system", "grade").agg(F.count("*").alias("n"))


MEASURES = "[{m: 'correct', p: grade = 'correct'}, {m: 'correct_or_partly', p: grade <> 'wrong'}, {m: 'correct_if_rubric_pass', p: case when overall then grade = 'correct' end}, {m: 'correct_if_rubric_fail', p: case when not overall then grade = 'correct' end}, {m: 'is_correct', p: grade = 'correct'}, {m: 'is_partly', p: grade = 'partly'}, {m: 'is_wrong', p: grade = 'wrong'}]"


@query(SCORES + f""", gr as ({inputs.GRADES}), flags as (select grader, system, unnest({MEASURES}) as x from gr join (select index, system, overall from scored) using (index, system)),
    counts as (select grader, system, x.m as measure, count(*) filter (x.p) as up, 0 as down, count(x.p) as n from flags group by all), ci as ({sql.interval('counts', 'grader, system, measure')})
    select grader, system, measure, up as k, n, round(case when n > 0 then up / n::double end, 6) as rate, ci_lo, ci_hi from counts left join ci using (grader, system, measure)""")
def grading_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grading.summary(inputs.grades(spark, sf_dir), _scores(spark, sf_dir)), "rate", "ci_lo", "ci_hi")


def _difference_sql(both_pass: bool) -> str:
    keep = "and a.overall and b.overall" if both_pass else ""
    return SCORES + f""", gr as (select * from ({inputs.GRADES}) join (select index, system, overall from scored) using (index, system)),
    d as (select a.grader, b.system || ' - ' || a.system as difference, a.grade = 'correct' as x, b.grade = 'correct' as y from gr a join gr b using (grader, index) where (a.system, b.system) in (('base', 'sft'), ('sft', 'dpo')) {keep}),
    counts as (select e.grader, e.difference, count(d.x) as n, count(*) filter (x) as a_correct, count(*) filter (y) as b_correct, count(*) filter (y and not x) as up, count(*) filter (x and not y) as down
      from (select * from (values ('g1'), ('g2')) as t(grader), (values ('sft - base'), ('dpo - sft')) as u(difference)) e left join d using (grader, difference) group by all),
    ci as ({sql.interval('counts', 'grader, difference')})
    select grader, difference, n, a_correct, b_correct, round(case when n > 0 then (up - down) / n::double end, 6) as diff, ci_lo, ci_hi from counts left join ci using (grader, difference)"""  # fmt: skip


@query(_difference_sql(False))
def grading_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grading.differences(inputs.grades(spark, sf_dir)), "diff", "ci_lo", "ci_hi")


@query(_difference_sql(True))
def both_pass_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grading.differences(inputs.grades(spark, sf_dir), both_pass=_scores(spark, sf_dir)), "diff", "ci_lo", "ci_hi")


@query(f"""with gr as ({inputs.GRADES}), d as (select grader, index, system, case when index % 4 = 0 then 'wrong' else grade end as grade, case when index % 3 = 0 then 'terse' else 'because ' || index % 7 end as reason from gr where grader = 'g2'),
    p as (select x.grade as a, y.grade as b from gr x join d y using (index, system) where x.grader = 'g1'), t as (select count(*) as n, count(*) filter (a = b) as same from p),
    ch as (select sum(x.c * y.c) as chance from (select a as k, count(*) as c from p group by a) x join (select b as k, count(*) as c from p group by b) y using (k))
    select 'g1' as grader, 'g2' as discarded, n, round(same / n::double, 6) as exact_match, round((same / n::double - chance / (n * n)::double) / (1 - chance / (n * n)::double), 6) as cohens_kappa,
      (select count(*) from d where grade = 'correct') as correct, (select count(distinct reason) from d) as distinct_reasons from t, ch""")
def discarded_grader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first grader against the second, whose grades are spoiled and then discarded."""
    grades = inputs.grades(spark, sf_dir)
    spoiled = grades.where("grader = 'g2'").select("grader", "index", "system", F.expr("if(index % 4 = 0, 'wrong', grade)").alias("grade"), F.expr("if(index % 3 = 0, 'terse', concat('because ', index % 7))").alias("reason"))
    return rounded(grading.against_discarded(grades.where("grader = 'g1'"), spoiled), "exact_match", "cohens_kappa")


@query(f"""with g as ({inputs.GENERATIONS}), {KEY}, sheet as (select index from (select distinct index from key) where index % 13 <> 2 union all select distinct index from key where index % 17 = 5 and index % 13 <> 2),
    spoiled as (select index, system, case when index % 19 = 6 and label = 'A' then 'B' else label end as label from key where index % 11 <> 3 or index % 13 = 2),
    l as (select index, count(*) as lines from sheet group by index), k as (select index, array_to_string(list_sort(list(label)), '') as labels from spoiled group by index)
    select * from (select coalesce(l.index, k.index) as index, case when lines is null then 'not on the sheet' when labels is null then 'not in the key' when lines > 1 then 'twice on the sheet' when labels <> 'ABC' then 'bad labels' end as problem
      from l full join k on l.index = k.index) where problem is not null""")
def sheet_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults found in a sheet and a key of which some lines are gone, doubled or changed."""
    key = grading.blind_key(inputs.indexed_rows(spark, sf_dir), SEED)
    lines = key.select("index").distinct().where("index % 13 <> 2")
    sheet = lines.unionByName(lines.where("index % 17 = 5"))
    spoiled = key.where("index % 11 <> 3 or index % 13 = 2").withColumn("label", F.expr("if(index % 19 = 6 and label = 'A', 'B', label)"))
    return checks.sheet_problems(sheet, spoiled)


@query("""with a as (select 'a' || s_suppkey as adapter, md5('x' || s_suppkey) as sha256, case when s_suppkey % 3 = 0 then 'a' || (s_suppkey + 1) end as base_path, case when s_suppkey % 3 = 0 then md5((case when s_suppkey % 2 = 0 then 'x' else 'y' end) || (s_suppkey + 1)) end as base_sha256, s_suppkey as k from supplier),
    s as (select 's' || k as system, adapter, case when k % 4 <> 0 then 'a' || (k + 1) end as base_adapter from a)
    select s.system, case when s.base_adapter is not null then b.sha256 end as sha256,
      case when s.base_adapter is null and o.base_sha256 is not null then s.system || ': ' || s.adapter || ' was trained on top of ' || o.base_path || '; set base_adapter' when s.base_adapter is not null and b.sha256 is null then s.system || ': no base adapter at ' || s.base_adapter
           when s.base_adapter is not null and b.sha256 <> o.base_sha256 then s.system || ': base adapter has sha256 ' || substr(b.sha256, 1, 12) || ', trained on ' || substr(o.base_sha256, 1, 12) end as problem
    from s left join a o on s.adapter = o.adapter left join a b on s.base_adapter = b.adapter""")
def base_adapter_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as adapters; some name no base, or one that they weren't trained on."""
    k = F.col("s_suppkey")
    name, mark = (lambda n: F.concat(F.lit("a"), n.cast("string"))), (lambda x, n: F.md5(F.concat(F.lit(x), n.cast("string"))))
    trained = lambda c: F.when(k % 3 == 0, c)
    a = inputs.table(spark, sf_dir, "supplier").select(
        k, name(k).alias("adapter"), mark("x", k).alias("sha256"), trained(name(k + 1)).alias("base_path"), trained(F.when(k % 2 == 0, mark("x", k + 1)).otherwise(mark("y", k + 1))).alias("base_sha256")
    )
    systems = a.select(F.concat(F.lit("s"), k.cast("string")).alias("system"), "adapter", F.when(k % 4 != 0, name(k + 1)).alias("base_adapter"))
    return checks.base_adapters(systems, a)


@query(f"""with g as ({inputs.GENERATIONS}) select index, index as record, prompt_key, new_tokens::int as new_tokens, stopped from g where system = 'dpo'""")
def cached_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One system's generations, written as a cache behind its header and read back; a cache of other settings beside it is passed over."""
    folder = shared_folder(spark)
    g = inputs.generations(spark, sf_dir).where("system = 'dpo'").select("index", "prompt_key", "new_tokens", "stopped")
    for name, key in (("kept", {"model": "m", "limit": LIMIT}), ("other", {"model": "m", "limit": 1})):
        head = spark.range(1).select(F.lit(json.dumps({"cache_key": key})).alias("value"), F.lit(-1).cast("long").alias("place"))
        body = jsonl.to_jsonl(g).select("value", F.from_json("value", "index long")["index"].alias("place"))
        head.unionByName(body).repartition(1).sortWithinPartitions("place").select("value").write.text(f"{folder}/{name}")
    found = jsonl.records(spark, [f"{folder}/kept", f"{folder}/other"], "index long, prompt_key string, new_tokens int, stopped boolean", {"model": "m", "limit": LIMIT})
    return found.select("index", F.col("record").cast("long").alias("record"), "prompt_key", "new_tokens", "stopped")


def kappa_sql(pairs: str) -> str:
    return f"""p as ({pairs}), t as (select count(*) as n, count(*) filter (a = b) as same from p), ch as (select coalesce(sum(x.c * y.c), 0) as chance from (select a as k, count(*) as c from p group by a) x join (select b as k, count(*) as c from p group by b) y using (k))
    select n, round(same / n::double, 6) as exact_match, round(case when chance <> n * n then (same / n::double - chance / (n * n)::double) / (1 - chance / (n * n)::double) end, 6) as cohens_kappa from t, ch"""


@query(f"""with gr as ({inputs.GRADES}), {kappa_sql("select x.grade as a, y.grade as b from gr x join gr y using (index, system) where x.grader = 'g1' and y.grader = 'g2'")}""")
def grader_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grading.grader_agreement(inputs.grades(spark, sf_dir)).drop("first", "second"), "exact_match", "cohens_kappa")


@query("with " + kappa_sql("select quality as a, toxic as b from labels where quality is not null and toxic is not null"))
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = inputs.table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")).dropna()
    return rounded(metrics.agreement(pairs, []), "exact_match", "cohens_kappa")


@query(f"""with g as ({inputs.GENERATIONS}), {KEY}, base as (select index, label, case when index % 31 = 4 then 'great' else 'correct' end as grade, case when index % 37 = 5 then ' ' else 'because' end as reason from key),
    given as (select * from base where index % 29 <> 3 union all select * from base where index % 41 = 6),
    judged as (select *, case when grade = 'great' then 'invalid grade' when trim(reason) = '' then 'empty reason' end as problem from given)
    select problem, count(*) as n from (select problem from judged where problem is not null
      union all select 'duplicate grade' from judged where problem is null group by index, label having count(*) > 1
      union all select 'missing grade' from base b where not exists (select 1 from judged j where j.problem is null and j.index = b.index and j.label = b.label)) group by problem""")
def grade_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults found in grades into which some have been put."""
    rows = inputs.indexed_rows(spark, sf_dir)
    i = F.col("index")
    base = grading.blind_key(rows, SEED).select("index", "label", F.when(i % 31 == 4, "great").otherwise("correct").alias("grade"), F.when(i % 37 == 5, " ").otherwise("because").alias("reason"))
    given = base.where(i % 29 != 3).unionByName(base.where(i % 41 == 6))
    return checks.grade_problems(given, rows.select("index")).groupBy("problem").agg(F.count("*").alias("n"))


# Token arrays, logs and plans.

STOPS, END, UNKNOWN = [0, 1], 3, 5


@query(f"""with t as ({inputs.TOKEN_ARRAYS}), f as (select *, list_min(list_filter([list_position(ids, 0), list_position(ids, 1)], lambda p: p > 0)) as first, list_position(list_reverse(ids), {END}) as behind from t)
    select vec_id, array_to_string(case when first is not null then ids[1:first] else ids end, ',') as trimmed, first is not null as found,
      array_to_string(case when not stopped and behind > 0 then ids[1:len(ids) - behind] else ids end, ',') as stripped,
      list_sort(list_distinct(list_filter(ids, lambda x: x <> {UNKNOWN}))) [1] as least_id, len(list_distinct(list_filter(ids, lambda x: x <> {UNKNOWN}))) as distinct_ids from f""")
def token_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inputs.token_arrays(spark, sf_dir)
    cut, known = tokens.trim_at_stop(F.col("ids"), STOPS), tokens.stop_ids(F.col("ids"), F.lit(UNKNOWN))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return t.select(
        "vec_id", joined(cut["ids"]).alias("trimmed"), cut["stopped"].alias("found"), joined(tokens.strip_unstopped_end(F.col("ids"), F.col("stopped"), END)).alias("stripped"),
        F.array_min(known).alias("least_id"), F.size(known).alias("distinct_ids"),
    )


PROBE = f"""probe as (select vec_id, vec_id % 50 as place, exp(logits[1 + vec_id % 50] - list_max(logits)) / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) as p,
    len(list_filter(logits, lambda x: x > logits[1 + vec_id % 50])) + 1 as rank from ({inputs.TOKEN_ARRAYS}))"""


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inputs.token_arrays(spark, sf_dir).withColumn("place", (F.col("vec_id") % 50).cast("int"))
    return t.select("vec_id", "place", tokens.token_probability(F.col("logits"), F.col("place")).alias("p"), tokens.token_rank(F.col("logits"), F.col("place")).alias("rank"))


@query(f"with {PROBE} select vec_id, place::int as place, round(p, 9) as p, rank::int as rank from probe")
def token_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir).withColumn("p", F.round("p", 9))


@query(f"with {PROBE} select count(*) as n, round(median(p), 9) as median_probability, round(avg(p), 9) as mean_probability, median(rank) as median_rank, round(avg((rank = 1)::int), 6) as share_first from probe where place < 40")
def stop_token_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over rows whose token lies before position 40."""
    kept = _probe(spark, sf_dir).where("place < 40")
    return kept.agg(
        F.count("*").alias("n"), F.round(F.percentile("p", 0.5), 9).alias("median_probability"), F.round(F.avg("p"), 9).alias("mean_probability"), F.percentile("rank", 0.5).alias("median_rank"),
        F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("share_first"),
    )


@query("""with t as (select label, vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings),
    a as (select label, vec_id, sum(case when pos >= 10 then abs(x::double) else 0 end) as nll, count(*) filter (pos >= 10) as n from t group by label, vec_id)
    select label, sum(n)::bigint as n_tokens, round(exp(sum(nll) / sum(n)), 6) as perplexity from a group by label""")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of tokens whose log-probabilities are the embeddings' components from the tenth on."""
    e = inputs.table(spark, sf_dir, "embeddings")
    t = e.select("label", "vec_id", F.posexplode("embedding").alias("pos", "x")).select("label", "vec_id", "pos", (-F.abs(F.col("x").cast("double"))).alias("logp"), F.lit(10).alias("n_prompt"))
    per = metrics.answer_nll(t, ["label", "vec_id"])
    return per.groupBy("label").agg(F.sum("n_tokens").alias("n_tokens"), F.round(metrics.perplexity(F.col("nll"), F.col("n_tokens")), 6).alias("perplexity"))


@query(f"""with l as ({inputs.TRAINING_LOG}) select run, round(avg(loss), 6) as train_loss, count(loss) as entries, case when count(loss) >= 2 then round(min_by(loss, step) filter (loss is not null), 6) end as first,
    case when count(loss) >= 2 then round(max_by(loss, step) filter (loss is not null), 6) end as last, case when count(loss) >= 2 then round(max_by(loss, step) filter (loss is not null) - min_by(loss, step) filter (loss is not null), 6) end as delta,
    max(value) as peak from l group by run""")
def training_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss, how it changed, and the peak value of each run."""
    log = inputs.training_log(spark, sf_dir)
    means = log.groupBy("run").agg(F.avg("loss").alias("train_loss"), F.count("loss").alias("entries"), F.max("value").alias("peak"))
    moved = metrics.change(metrics.trajectory(log, ["run", "loss"]), ["run"], "loss")
    return rounded(means.join(moved, "run", "left"), "train_loss", "first", "last", "delta")


@query("""select user_id as run, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') as started, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') as ended, datesub('second', min(ts), max(ts)) as seconds from events group by user_id""")
def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each run began and ended, and how long it took."""
    ends = inputs.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("run", times.iso(F.col("a")).alias("started"), times.iso(F.col("b")).alias("ended"), times.seconds(F.col("a"), F.col("b")).alias("seconds"))


@query(f"""with t as ({inputs.TOKEN_ARRAYS}), c as (select len(ids) - len(list_filter(ids, lambda x: x < 8)) as p, len(list_filter(ids, lambda x: x < 4)) as ch, len(list_filter(ids, lambda x: x < 8)) as rj from t), kept as (select * from c where p < 40)
    select count(*) as pairs, count(*) filter (p + ch > 48) as chosen_truncated, count(*) filter (p + rj > 48) as rejected_truncated, (select count(*) from c) - count(*) as dropped_prompt_too_long from kept""")
def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inputs.token_arrays(spark, sf_dir)
    below = lambda n: F.filter("ids", lambda x: x < n)
    rows = t.select(F.filter("ids", lambda x: x >= 8).alias("prompt_ids"), below(4).alias("chosen_ids"), below(8).alias("rejected_ids"))
    kept = rows.where(F.size("prompt_ids") < 40)
    return metrics.truncation_counts(kept, 48, rows.count())


@query("""with x as (select l_returnflag as run, 0.1 * (l_discount * 10 - l_tax * 10) as c, 0.1 * (l_tax * 10 - l_quantity / 50) as r from lineitem)
    select run, round(avg(c), 6) as chosen_reward, round(avg(r), 6) as rejected_reward, round(avg(c - r), 6) as margin, round(avg((c - r > 0)::int), 6) as accuracy, round(avg(ln(1 + exp(-(c - r)))), 6) as loss from x group by run""")
def reward_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs.table(spark, sf_dir, "lineitem")
    logps = i.select(F.col("l_returnflag").alias("run"), (F.col("l_discount") * 10).alias("policy_chosen"), (F.col("l_tax") * 10).alias("reference_chosen"), (F.col("l_tax") * 10).alias("policy_rejected"), (F.col("l_quantity") / 50).alias("reference_rejected"))
    return rounded(metrics.reward_metrics(logps, ["run"]), "chosen_reward", "rejected_reward", "margin", "accuracy", "loss")


@query("""with x as (select l_orderkey % 100 as pair, l_linestatus as side, -l_tax as logp, (l_linenumber % 3 <> 0)::int as mask from lineitem)
    select pair, side, round(sum(logp * mask), 6) as logp, sum(mask)::bigint as n, round(sum(logp * mask) / greatest(sum(mask), 1), 6) as per_token from x group by pair, side""")
def completion_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs.table(spark, sf_dir, "lineitem")
    t = i.select((F.col("l_orderkey") % 100).alias("pair"), F.col("l_linestatus").alias("side"), (-F.col("l_tax")).alias("logp"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("mask"))
    return rounded(metrics.completion_sums(t, ["pair", "side"]), "logp", "per_token")


@query("""with n as (select count(*)::bigint as n from customer), t as (select greatest(1, ceil(ceil(n / 2.0) / 8)) as per, n from n)
    select n, ceil(per * 3)::bigint as total_steps, case when greatest(1, round_even(per * 3 / 5, 0)) >= per * 3 then greatest(1, per * 3 // 2) else greatest(1, round_even(per * 3 / 5, 0)) end::bigint as save_steps,
      case when per * 3 >= 10 then greatest(1, floor(0.1 * per * 3)) else floor(0.1 * per * 3) end::bigint as warmup_steps, greatest(1, n // 16) as sft_steps_per_epoch from t""")
def step_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a run over as many pairs as there are customers."""
    n = inputs.table(spark, sf_dir, "customer").count()
    plan = {"n": n} | plans.preference_steps(n, 2, 8, 3, 0.1) | {"sft_steps_per_epoch": plans.sft_steps(n, 2, 8, 1, 0.0)["steps_per_epoch"]}
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in plan.items()])
