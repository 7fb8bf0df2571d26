"""Secret scans: a trigram index decides which rules run on which texts.

Each rule's regular expression is parsed into a Boolean trigram query: what any
match must contain. A slice of texts is indexed by the trigrams that occur in
some query (postings: sorted text numbers of each trigram, letters in lower case);
queries intersect and unite postings, and a rule's expression runs only on the
texts that remain. A rule without mandatory trigrams runs on all texts. The index
is made and used within a task, so texts are never shuffled.

Defined results: a null or empty text has no spans; spans count code points, ends
exclusive; overlapping spans of different kinds are all kept; every row is scanned
by itself, so repeated rows get equal results; an empty table gives an empty one;
only the text column is read, whatever other columns there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import free_name, importable
from tessera.llm.words import slices


@dataclass(frozen=True)
class Rule:
    """least: characters that group `measured` of a match must have."""

    kind: str
    pattern: str
    ignore_case: bool = False
    measured: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: What is searched for, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Between lines of a key, also where a string literal or a join of lines hides the breaks.
GAP = r"(?:\s|\\[nr])+"
#: A key without its END line: headers, tokens of 16 letters or more, a shorter last one and PGP's checksum.
KEY_LINES = (
    rf"(?:[\x20\t]*(?:\r?\n|\\n)(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash):[^\r\n]*)*"
    rf"(?:(?:{GAP}[A-Za-z0-9+/]{{16,}}={{0,2}})+(?:{GAP}[A-Za-z0-9+/]{{1,75}}={{0,2}}(?=\s|\\|\Z))?(?:{GAP}=[A-Za-z0-9+/]{{4}})?)?"
)
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----)[\s\S])*-----END [A-Z ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----|{KEY_LINES})"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Most literal strings that are followed through a concatenation.
MOST_STRINGS = 64
#: A query is True (anything may match), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple


def both(queries: list[Query]) -> Query:
    kept = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def either(queries: list[Query]) -> Query:
    kept = list(dict.fromkeys(queries))
    return True if not kept or True in kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def of_strings(strings: list[bytes]) -> Query:
    return either([both([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def lowered(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass").lower()


def trigram_query(pattern: str) -> Query:
    """What the lower-case UTF-8 text must contain wherever the pattern matches."""
    parser = re._parser  # the standard library's own regular expression parser
    name = lambda op: str(op).lower()

    def charset(items: list) -> list[bytes] | None:
        out: list[bytes] = []
        for op, arg in items:
            if name(op) == "literal":
                out.append(lowered(arg))
            elif name(op) == "range" and arg[1] - arg[0] < 8:
                out += [lowered(c) for c in range(arg[0], arg[1] + 1)]
            else:
                return None
        return list(dict.fromkeys(out)) if len(out) <= 8 else None

    def walk(nodes) -> tuple[list[bytes] | None, Query]:
        """All strings that the nodes can match, or None, and the query if None."""
        strings, query = [b""], []
        whole = True
        for op, arg in nodes:
            exact, more = None, True
            match name(op):
                case "literal":
                    exact = [lowered(arg)]
                case "in":
                    exact = charset(arg)
                case "at" | "assert" | "assert_not":
                    exact = [b""]
                case "subpattern":
                    exact, more = walk(arg[-1])
                case "branch":
                    parts = [walk(x) for x in arg[1]]
                    if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_STRINGS:
                        exact = list(dict.fromkeys(s for e, _ in parts for s in e))
                    else:
                        more = either([of_strings(e) if e is not None else q for e, q in parts])
                case "max_repeat" | "min_repeat" | "possessive_repeat":
                    least, most, inner = arg
                    exact, more = walk(inner)
                    if (least, most) == (0, 1) and exact is not None:
                        exact = list(dict.fromkeys([b"", *exact]))
                    elif least == 0:
                        exact, more = None, True
                    elif exact is not None and (most != least or least > 4 or len(exact) ** least > MOST_STRINGS):
                        exact, more = None, of_strings(exact)
                    elif exact is not None:
                        exact = [b"".join(x) for x in product(exact, repeat=least)]
            if exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
                strings = list(dict.fromkeys(a + b for a in strings for b in exact))
                continue
            query.append(of_strings(strings))
            if exact is not None:
                strings, whole = exact, False
            else:
                query.append(more)
                strings, whole = [b""], False
        if whole:
            return strings, True
        return None, both([*query, of_strings(strings)])

    exact, query = walk(parser.parse(pattern, re.ASCII))
    return of_strings(exact) if exact is not None else query


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Index:
    """Postings of the wanted trigrams, for one slice of texts at a time."""

    def __init__(self, wanted: set[bytes]):
        self.grams = sorted(wanted)
        self.slot = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(self.grams):
            self.slot[int.from_bytes(g, "big")] = i + 1
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[ord("A") : ord("Z") + 1] += 32

    def postings(self, texts: list[bytes | None]) -> dict[bytes, np.ndarray]:
        data = self.lower[np.frombuffer(b"\xff".join([t or b"" for t in texts]), np.uint8)]
        if len(data) < 3:
            return {}
        found = self.slot[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(found)
        ends = np.cumsum([len(t) + 1 if t else 1 for t in texts])
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, "right"))
        gram, text = pairs // len(texts) - 1, pairs % len(texts)
        cuts = np.searchsorted(gram, np.arange(len(self.grams) + 1))
        return {g: text[a:b] for g, a, b in zip(self.grams, cuts, cuts[1:])}


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Numbers of the texts that the query admits."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings.get(query, np.zeros(0, np.int64))
    found = [candidates(q, postings, n) for q in query[1]]
    return reduce(np.intersect1d if query[0] == "and" else np.union1d, found)


def scan_slice(texts: list[bytes | None], rules: tuple[Rule, ...], queries: list[Query], index: Index) -> list[list[tuple[int, int, int]]]:
    """Of each text: (start, number of the rule, end) of all spans, in order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    postings = index.postings(texts)
    decoded: dict[int, str] = {}
    for k, (rule, query) in enumerate(zip(rules, queries)):
        pattern = rule.compiled()
        for i in candidates(query, postings, len(texts)):
            if not texts[i]:
                continue
            if i not in decoded:
                decoded[i] = texts[i].decode("utf-8", "replace")
            for m in pattern.finditer(decoded[i]):
                if m.end(rule.measured) - m.start(rule.measured) >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    return [sorted(x) for x in out]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def spans(spark, text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<kind, start, end>> by start, then by kind as listed."""
    importable(spark)
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = set().union(*map(trigrams, queries))

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(wanted)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            values, out = batch.to_pylist(), []
            for lo, hi in slices(values):
                out += scan_slice(values[lo:hi], rules, queries, index)
            yield pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in out], kind)

    return F.arrow_udf(scan, SPANS).asNondeterministic()(text.cast("string").cast("binary"))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column of spans, and its name."""
    name = free_name(docs, "spans")
    return docs.withColumn(name, spans(docs.sparkSession, F.col(text_col), rules)), name


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(found: Column, kinds: list[str]) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(kinds))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """docs with each run of overlapping spans replaced by the mark; length_col, if given, is the text's length."""
    found, name = with_spans(docs, rules, text_col)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        text = F.col(text_col)
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        apart = F.concat(state["done"], gap, F.lit(mark)).alias("done")
        joined = F.struct(state["done"].alias("done"), F.greatest(state["at"], span["end"]).alias("at"))
        return F.when((span["start"] < state["at"]) & (state["at"] > 0), joined).otherwise(F.struct(apart, span["end"].alias("at")))

    def finish(state: Column) -> Column:
        text = F.col(text_col)
        return F.concat(state["done"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    text = F.when(F.size(name) > 0, F.aggregate(F.col(name), start, step, finish)).otherwise(F.col(text_col))
    out = found.withColumn(text_col, text)
    if length_col:
        length = F.when(F.size(name) > 0, F.length(text_col)).otherwise(F.col(length_col))
        out = out.withColumn(length_col, length.cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
