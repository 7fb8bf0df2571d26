"""URL filters: rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a pattern in a small language: `||` at the start anchors at the host or
a subdomain and reads on in the path; `*` stands for any characters, `^` for a
character that is neither letter nor digit, or the end; all else is literal. A
literal token is a run of ASCII letters and digits that the pattern guarantees to
stand alone in any URL it matches. One pass counts how many URLs hold each token
of the rules; a rule is filed under its rarest one. URL tokens are joined to that
index, and only the rules so fetched run their regular expressions. A rule
without a token would have to run everywhere: it is refused, unless scan_bare asks
for that.

Verdict: the longest host rule that fits decides; without one, the longest other
pattern; without that, the URL is allowed.

Up to MOST_RULES rules are one literal of the plan and broadcast; more are a table that
joins by token. The URLs shuffle once, by row, after each row's matches have been merged.

Defined results: a null URL, or one without ://, has an empty host and path, fits
no host rule and is judged by the other patterns (a null one is allowed); repeated
rows are judged alike; a null page_id is kept; an empty table gives an empty one; a URL
of any length is judged whole; columns other than the id and the url are not read,
whatever their names.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def anchored(self) -> bool:
        return self.pattern.startswith("||")

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    def regex(self) -> str:
        """For host and path if anchored, else for the lower-cased URL."""
        if self.anchored:
            body = self.name
            host, slash, path = body.partition("/")
            return "^(?:[^/]*\\.)?" + literal(host.lower()) + translate(slash + path)
        return translate(self.pattern.lower().strip("*"))  # found anywhere, so a * at either end says nothing

    def tokens(self) -> list[str]:
        """Literal tokens, longest first, that stand alone wherever the rule matches."""
        out, text = [], self.name.lower()
        for m in re.finditer("[a-z0-9]+", text):
            before = text[m.start() - 1] if m.start() else ("." if self.anchored else "*")
            after = text[m.end()] if m.end() < len(text) else "*"
            if before != "*" and after != "*" and before.isascii() and after.isascii():
                out.append(m[0])
        return sorted(set(out), key=lambda t: (-len(t), t))


def literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text) if text.isascii() else re.escape(text)


def translate(pattern: str) -> str:
    special = {"*": ".*", "^": "(?:[^a-z0-9]|$)"}
    return "".join(special.get(c) or literal(c) for c in pattern)


#: The rules of the contract, host and path.
HOST_RULES = (
    Rule("allow", "||com/"),
    Rule("block", "||example.com/en/"),
    Rule("allow", "||www.example.com/en/"),
    Rule("block", "||net/es/"),
    Rule("block", "||net/fr/"),
)
#: What the method blocks elsewhere.
PATTERN_RULES = tuple(
    Rule("block", p)
    for p in (
        "/ads/", "/ad^*.js^", "/banner/", "/banners/", "/popup/", "/popunder/", "/adserver/", "^doubleclick^", "/pixel.gif^", "/beacon/",
        "/cart/", "/checkout/", "/login^", "/logout^", "/signin^", "/signup^", "/wp^admin^", "/cgi^bin/", "^phpsessid^", "^jsessionid^", "^sessionid^",
        "^casino^", "^poker^", "^viagra^", "^porn^", "^xxx^", "^torrent^", "^warez^", "^keygen^", "?replytocom=*", "/feed/", "/rss^", "/xmlrpc.php^",
    )
)
RULES = HOST_RULES + PATTERN_RULES


def parts(url: Column) -> tuple[Column, Column]:
    """Host, letters A-Z in lower case, and path; both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def constants(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of rules: one literal of the plan if there are few."""
    if len(rows) > MOST_RULES:
        return spark.createDataFrame(rows, schema)
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", scan_bare: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; scan_bare: rules without a token run on all rows."""
    bare = [r for r in rules if not r.tokens()]
    if bare and not scan_bare:
        raise ValueError(f"no literal token stands alone in {[r.pattern for r in bare]}")
    spark, near = pages.sparkSession, F.broadcast if len(rules) <= MOST_RULES else lambda df: df
    url = F.col(url_col).cast("string")
    lower = F.lower(F.coalesce(url, F.lit("")))
    tokens = F.array_distinct(F.split(lower, "[^a-z0-9]+"))

    known = sorted({t for r in rules for t in r.tokens()})
    wanted = constants(spark, [{"token": t} for t in known], "token string")
    seen = pages.select(F.explode(tokens).alias("token")).join(near(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    counts = {r.token: r.n for r in seen.collect()}  # at most the rules' own tokens
    index = [
        {"token": min(r.tokens(), key=lambda t: counts.get(t, 0)), "name": r.name, "judgement": r.verdict, "anchored": r.anchored, "regex": r.regex(), "length": len(r.name)}
        for r in rules
        if r.tokens()
    ]
    filed = constants(spark, index, "token string, name string, judgement string, anchored boolean, regex string, length int")

    host, path = parts(url)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), lower.alias("lower"), tokens.alias("tokens"))
    everywhere = [
        F.when((F.concat("host", "path") if r.anchored else F.col("lower")).rlike(r.regex()), F.struct(F.lit(r.anchored).alias("anchored"), F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("judgement")))
        for r in bare
    ]
    if everywhere:
        rows = rows.withColumn("bare", F.array_max(F.array(*everywhere)))
    fetched = rows.withColumn("token", F.explode("tokens")).drop("tokens").join(near(filed), "token", "left")
    subject = F.when(F.col("anchored"), F.concat("host", "path")).otherwise(F.col("lower"))
    fits = F.col("regex").isNotNull() & F.expr("regexp_like(subject, regex)")
    rank = F.struct(F.col("anchored"), F.col("length"), F.col("name"), F.col("judgement"))
    best = (
        fetched.withColumn("subject", subject)
        .withColumn("fit", F.when(fits, rank))
        .groupBy("row", "page_id", "host", "path")
        .agg(F.max(F.greatest("fit", "bare") if everywhere else "fit").alias("fit"))
    )
    return best.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("fit.anchored"), F.col("fit.name")).alias("rule"),
        F.coalesce(F.col("fit.judgement"), F.lit("allow")).alias("verdict"),
    )


def duckdb_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdicts by trying every rule on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r.name)}, {quote(r.verdict)}, {str(r.anchored).lower()}, {quote(r.regex())}, {len(r.name)})" for r in rules)
    return f"""
    with cut as (
      select row_number() over () as rid, page_id, lower(coalesce(url, '')) as low,
             case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
      from pages
    ), split as (
      select rid, page_id, low, lower(regexp_extract(rest, '^[^/?#]*')) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
    ), rules(name, judgement, anchored, regex, length) as (values {values}),
    fits as (
      select s.rid, r.* from split s join rules r
        on regexp_matches(case when r.anchored then s.host || s.path else s.low end, r.regex)
    ), best as (
      select * from fits qualify row_number() over (partition by rid order by anchored desc, length desc, name desc) = 1
    )
    select s.page_id, s.host, s.path, case when b.anchored then b.name end as rule, coalesce(b.judgement, 'allow') as verdict
    from split s left join best b using (rid)
    """
