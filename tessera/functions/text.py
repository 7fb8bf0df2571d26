"""Normalising text and rendering instruction rows.

Whitespace is Unicode's, with the four separators \\x1c-\\x1f, wherever text is
split, collapsed or trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"
# Fixed value: the system turn of every rendered row.
SYSTEM_PROMPT = "You are a concise personal-finance assistant. Answer the question directly in one or two short paragraphs."


def collapse(text: Column) -> Column:
    """Runs of whitespace as one space, none at either end."""
    return F.btrim(F.regexp_replace(text, rf"{SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"^{SPACE}+", ""), rf"{SPACE}+\z", "")


def word_count(text: Column) -> Column:
    one = collapse(text)
    return F.when(F.length(one) == 0, 0).otherwise(F.size(F.split(one, " ")))


def prompt_key(instruction: Column, context: Column) -> Column:
    """Identity of a prompt: instruction and input, whitespace collapsed, case kept."""
    return collapse(F.concat(instruction, F.lit("\n"), F.coalesce(context, F.lit(""))))


def plain_prompt(instruction: Column, context: Column) -> Column:
    """The text that the rules read: as it is, input or nothing after a line break."""
    return F.concat(instruction, F.lit("\n"), F.coalesce(context, F.lit("")))


def shown_prompt(instruction: Column, context: Column) -> Column:
    """As a user turn: an input that is not empty is appended, trimmed, even if blank."""
    with_context = F.concat(strip(instruction), F.lit("\n\nContext: "), strip(context))
    return F.when(F.coalesce(F.length(context), F.lit(0)) > 0, with_context).otherwise(strip(instruction))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(instruction: Column, context: Column, output: Column) -> Column:
    """System, user and assistant turns."""
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", shown_prompt(instruction, context)), message("assistant", strip(output)))


def prompt_messages(turns: Column) -> Column:
    """All turns but the last."""
    return F.slice(turns, 1, F.size(turns) - 1)


def completion(turns: Column) -> Column:
    return F.slice(turns, -1, 1)
