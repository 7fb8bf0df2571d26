"""Instruction rows, generations, grades and logs derived from the provided tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import seeded, text
from tessera.operators.scoring import with_rank

LIMIT = 384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an instruction that repeats its text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("instruction"), F.lit(None).cast("string").alias("input"), F.col("text").alias("output"))


DOCUMENT_ROWS = "select doc_id as row_id, text as instruction, null::varchar as input, text as output from documents"


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn after it; the conversation's system turn is the input. Some prompts get a sum."""
    c = table(spark, sf_dir, "conversations")
    turns = Window.partitionBy("conv_id").orderBy("turn")
    system = c.where("role = 'system'").groupBy("conv_id").agg(F.min("text").alias("input"))
    after = c.withColumn("next_role", F.lead("role").over(turns)).withColumn("output", F.lead("text").over(turns))
    pairs = after.where("role = 'user' and next_role = 'assistant'").join(system, "conv_id", "left")
    row_id = F.col("conv_id") * 1000 + F.col("turn")
    asked = F.concat(F.lit(" How much tax is due on $"), (1000 + row_id % 9000).cast("string"), F.lit(" at "), (1 + row_id % 9).cast("string"), F.lit("%?"))
    asked = F.when(row_id % 5 == 0, asked).when(row_id % 7 == 0, F.lit(" Which bank should I use?")).otherwise(F.lit(""))
    return pairs.select(row_id.alias("row_id"), F.concat("text", asked).alias("instruction"), "input", "output")


CHAT_ROWS = """
select row_id, t || case when row_id % 5 = 0 then ' How much tax is due on $' || (1000 + row_id % 9000) || ' at ' || (1 + row_id % 9) || '%?'
                         when row_id % 7 = 0 then ' Which bank should I use?' else '' end as instruction, input, output
from (
  select conv_id * 1000 + turn as row_id, text as t, role,
         lead(role) over w as next_role, lead(text) over w as output,
         min(case when role = 'system' then text end) over (partition by conv_id) as input
  from conversations window w as (partition by conv_id order by turn)
) where role = 'user' and next_role = 'assistant'
"""


def indexed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rank(chat_rows(spark, sf_dir), "row_id", "index")


INDEXED_ROWS = f"select *, row_number() over (order by row_id) - 1 as index from ({CHAT_ROWS})"


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three systems: one loops, one answers in full, one is short; some leak markers or sums."""
    rows = indexed_rows(spark, sf_dir)
    words = F.split(text.collapse(F.col("output")), " ")
    n = F.size(words)
    due = F.when(F.col("row_id") % 5 == 0, F.concat(F.lit(" You owe $"), (1000 + F.col("row_id") % 9000).cast("string"), F.lit(" of tax."))).otherwise(F.lit(""))
    systems = F.array(
        F.struct(F.lit("base").alias("system"), F.concat_ws(" ", "output", "output", "output").alias("text"), F.least(3 * n, F.lit(LIMIT)).alias("new_tokens"), (3 * n < LIMIT).alias("stopped")),
        F.struct(
            F.lit("sft").alias("system"),
            F.concat(F.col("output"), due, F.when(F.col("row_id") % 17 == 0, F.lit("\nuser: ok")).otherwise(F.lit(""))).alias("text"),
            F.least(n, F.lit(LIMIT)).alias("new_tokens"),
            (n < LIMIT).alias("stopped"),
        ),
        F.struct(
            F.lit("dpo").alias("system"),
            F.concat(
                F.array_join(F.slice(words, 1, 40), " "),
                F.when(F.col("row_id") % 10 == 0, F.lit(" About $99999.")).otherwise(F.lit("")),
                F.when(F.col("row_id") % 23 == 0, F.lit("<|im_end|>")).otherwise(F.lit("")),
            ).alias("text"),
            F.least(n, F.lit(40)).alias("new_tokens"),
            F.lit(True).alias("stopped"),
        ),
    )
    key = text.prompt_key(F.col("instruction"), F.col("input"))
    return rows.select("index", key.alias("prompt_key"), F.explode(systems).alias("s")).select("index", "prompt_key", "s.*")


PROMPT_KEY = r"trim(regexp_replace(instruction || chr(10) || coalesce(input, ''), '\s+', ' ', 'g'))"
GENERATIONS = rf"""
select index, {PROMPT_KEY} as prompt_key, row_id, instruction, input, output, system,
  case system when 'base' then output || ' ' || output || ' ' || output
    when 'sft' then output || case when row_id % 5 = 0 then ' You owe $' || (1000 + row_id % 9000) || ' of tax.' else '' end || case when row_id % 17 = 0 then chr(10) || 'user: ok' else '' end
    else array_to_string(w[1:40], ' ') || case when row_id % 10 = 0 then ' About $99999.' else '' end || case when row_id % 23 = 0 then '<|im_end|>' else '' end end as text,
  case system when 'base' then least(3 * len(w), {LIMIT}) when 'sft' then least(len(w), {LIMIT}) else least(len(w), 40) end as new_tokens,
  case system when 'base' then 3 * len(w) < {LIMIT} when 'sft' then len(w) < {LIMIT} else true end as stopped
from (select *, string_split(trim(regexp_replace(output, '\s+', ' ', 'g')), ' ') as w from ({INDEXED_ROWS})), (values ('base'), ('sft'), ('dpo')) as t(system)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base and sft answers as two samples of each prompt."""
    g = generations(spark, sf_dir).where("system <> 'dpo'")
    number = F.when(F.col("system") == "base", 0).otherwise(1)
    return g.withColumn("prompt_index", F.col("index")).withColumn("sample", number)


def grades(spark: SparkSession, sf_dir: str, seed: int = 3) -> DataFrame:
    """Two graders' grades of every answer, the second often agreeing with the first."""
    g = generations(spark, sf_dir).select("index", "system")
    names = F.array(*[F.lit(x) for x in ("correct", "partly", "wrong")])
    one = seeded.draw(F.lit(3), f"{seed}:one", F.col("index"), F.col("system"))
    other = F.when(seeded.draw(F.lit(4), f"{seed}:agree", F.col("index"), F.col("system")) > 0, one).otherwise(seeded.draw(F.lit(3), f"{seed}:two", F.col("index"), F.col("system")))
    made = F.array(F.struct(F.lit("g1").alias("grader"), one.alias("n")), F.struct(F.lit("g2").alias("grader"), other.alias("n")))
    return g.withColumn("x", F.explode(made)).select("x.grader", "index", "system", F.get(names, F.col("x.n").cast("int")).alias("grade"), F.lit("because").alias("reason"))


def sql_draw(n: str, *parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 8))::bigint % {n})"


def _grades(seed: int = 3) -> str:
    d = lambda n, kind: sql_draw(n, f"'{seed}:{kind}'", "index", "system")
    return f"""
select grader, index, system, ['correct', 'partly', 'wrong'][1 + case when grader = 'g1' or {d(4, 'agree')} > 0 then {d(3, 'one')} else {d(3, 'two')} end] as grade
from ({GENERATIONS}), (values ('g1'), ('g2')) as gr(grader)
"""


GRADES = _grades()


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as steps of a run; clicks carry no loss."""
    e = table(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("run"), step.alias("step"), F.when(F.col("event_type") != "click", F.col("value")).alias("loss"), "value")


TRAINING_LOG = """
select user_id as run, row_number() over (partition by user_id order by ts, event_id) as step, case when event_type <> 'click' then value end as loss, value from events
"""


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as arrays of small ids, and as logits."""
    e = table(spark, sf_dir, "embeddings")
    ids = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 100) % 23).cast("int"))
    return e.select("vec_id", ids.alias("ids"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"), (F.col("vec_id") % 2 == 0).alias("stopped"))


TOKEN_ARRAYS = """
select vec_id, list_transform(embedding, lambda x: (floor(abs(x::double) * 100) % 23)::int) as ids, embedding::double[] as logits, vec_id % 2 = 0 as stopped from embeddings
"""
