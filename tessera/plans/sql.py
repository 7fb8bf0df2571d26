"""The rules in DuckDB's regular expressions, which have no lookaround: what may not stand beside a term is matched instead."""

from __future__ import annotations

from tessera.functions import lexicon, rules

WORD = r"[\p{L}\p{N}_]"
EDGE = r"(?:$|[^\p{L}\p{N}_])"
START = r"(?:^|[^\p{L}\p{N}_])"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted('(?i)' + pattern)})"


def terms(words: tuple[str, ...]) -> str:
    return lexicon.alternatives(words, START, "", EDGE)


def is_domain(prompt: str) -> str:
    before = "|".join(lexicon.NOT_BEFORE_BANK)
    bank = f"regexp_replace({prompt}, '(?i)({before})bank', '\\1_bank', 'g')"
    bank = f"regexp_replace({bank}, '(?i)bank(s|er|ers)?(\\s*,)', 'bank_\\2', 'g')"
    same, amount, reach = r"[^.?!\n]", r"[$£€]\s?\d", lexicon.INTEREST_REACH - 1  # one character is matched by the edge
    ahead = rf"{START}interest(?:{amount}|[^.?!\n\p{{L}}\p{{N}}_]{same}{{0,{reach}}}?(?:\brate|\bearn|{amount}|\d\s?%))"
    behind = rf"(?:\brate|\bearn\w*|{amount}){same}{{0,{reach}}}?[^.?!\n\p{{L}}\p{{N}}_]interest{EDGE}"
    large = rf"[$£€]\s?(?:\d{{1,3}}(?:,\d{{3}})+|\d+(?:\.\d+)?\s?k){EDGE}"
    tests = [matches(prompt, terms(lexicon.PROMPT_TERMS)), matches(bank, f"{START}bank(?:s|er|ers)?{EDGE}"), matches(prompt, ahead), matches(prompt, behind), matches(prompt, large)]
    return "(" + " or ".join(tests) + ")"


def has_answer_term(answer: str) -> str:
    return matches(answer, terms(lexicon.PROMPT_TERMS + lexicon.ANSWER_TERMS) + r"|[$£€]\s?\d")


ROLE = (
    r"(?im)^[ \t]*(?:(?:user|assistant|system|human|question|instruction|response)[ \t]*:|###[ \t]*(?:instruction|input|response)|(?:user|assistant|system)[ \t]*$)"
)


def scores(generations: str, limit: int) -> str:
    """Rules of (index, system, instruction, input, output, text, new_tokens, stopped): applies and passed of each, failed, overall, verdict.

    Figures here are plain sums and percentages, as the derived rows hold them.
    """
    prompt = "(instruction || chr(10) || coalesce(input, ''))"
    ok = {
        "format": rf"not (regexp_matches(text, '^\s*$') or regexp_matches(text, '<\|[a-z_]+\|>') or regexp_matches(text, {quoted(ROLE)}))",
        "clean_stop": f"stopped and new_tokens < {limit}",
        "repetition": "not looped",
        "domain_terms": f"not domain or {has_answer_term('text')}",
        "ungrounded_numbers": rf"not domain or len(list_filter(regexp_extract_all(text, '\$(\d+)', 1), lambda x: not list_contains(regexp_extract_all({prompt}, '\d+'), x))) = 0",
    }
    columns = ", ".join(f"({c}) as {n}_ok" for n, c in ok.items())
    failed = ", ".join(f"case when not {n}_ok then '{n}' end" for n in rules.RULES)
    return rf"""
    with gen as materialized ({generations}), w as (
      select index, system, regexp_extract_all(lower(text), '[a-z0-9'']+') as w,
             list_transform(string_split_regex(lower(text), '[.!?\n]+'), lambda s: regexp_extract_all(s, '[a-z0-9'']+')) as s from gen
    ), loops as (
      select index, system from (select index, system, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i : i + 3], ' '))) as g from w)
      group by index, system, g having count(*) >= {rules.GRAM_TIMES}
      union select index, system from (select index, system, unnest(list_transform(list_filter(s, lambda x: len(x) >= {rules.SENTENCE_WORDS}), lambda x: array_to_string(x, ' '))) as g from w)
      group by index, system, g having count(*) >= 2
    ), flagged as (
      select gen.*, l.index is not null as looped, {is_domain(prompt)} as domain from gen left join (select distinct * from loops) l using (index, system)
    ), checked as (select *, {columns} from flagged),
    scored as (
      select *, list_filter([{failed}], lambda x: x is not null) as failed, {' and '.join(f'{n}_ok' for n in rules.RULES)} as overall,
             case when not format_ok or not repetition_ok then 'rejected' when not clean_stop_ok then 'ambiguous' else 'pass' end as verdict
      from checked
    )
    """


def interval(groups: str, keys: str, resamples: int = 1000, seed: int = 0) -> str:
    """(keys, ci_lo, ci_hi) from a relation with keys, up, down and n."""
    draw = f"(('0x' || substr(md5('{seed}:' || r || ':' || j), 1, 8))::bigint % n)"
    return f"""
      select {keys}, round(quantile_cont(m, 0.025), 6) as ci_lo, round(quantile_cont(m, 0.975), 6) as ci_hi from (
        select {keys}, r, sum(case when {draw} < up then 1 when {draw} < up + down then -1 else 0 end) / any_value(n)::double as m
        from {groups}, range({resamples}) as a(r), unnest(range(n)) as b(j) group by {keys}, r
      ) group by {keys}
    """
