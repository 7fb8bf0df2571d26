"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Model: P(grade > k) = sigmoid(w.x - c_k) with one weight vector for all ordered
thresholds c_0 < c_1 < ...; x marks which of the selected words and word beginnings occur in a text (words:
runs of ASCII letters and digits and non-ASCII characters, in lower case). They are
selected by a significant association with a grade above 0, and an L1 penalty makes
the weights sparse. Output: the expected grade, sum over k of P(grade > k).

Grades are any ordered integers from 0. The provided labels only say toxic or
not; `graded` derives a weak grade from them: 0 if not toxic, else 1 to 3 by how
many running words of the text are strongly associated with the label.

Training uses at most `most_rows` labelled documents of each label, drawn by a
hash of the id, none longer than LONGEST characters (documented bounds; scoring
has none). Scoring is one pass over whole texts without a shuffle.

Defined results: a null or empty text has no words and gets the severity of the
thresholds alone; without labels, or with one grade only, severity is the mean
grade seen, or 0; labels with nulls or without a document are ignored, of several
labels for one id the largest counts; repeated rows get equal results; an empty
table gives an empty one; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import free_name, importable
from tessera.llm.words import BY_ALNUM, hashes, mix, slices, spans

LONGEST = 40_000
GRADES = 4
#: Lengths in bytes of the word beginnings that are features besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: Share of grades above 0 that training rows are weighted to.
PRIOR = 0.2


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    #: Severity where there was nothing to tell grades apart.
    base: float = 0.0

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -500, 500)))

    def severity(self, texts: list[bytes | None]) -> np.ndarray:
        if not len(self.thresholds):
            return np.full(len(texts), self.base)
        which, text = presence(texts, self.words)
        return self.above(np.bincount(text, self.weights[which], len(texts))).sum(axis=1)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all running words and of the first 4 to 8 bytes of longer ones, the word of each, and where texts' words begin."""
    data = np.frombuffer(b"\n".join([t or b"" for t in texts]), np.uint8)
    starts, ends = spans(data, BY_ALNUM)
    lengths = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    found, word = [hashes(data, starts, ends)], [np.arange(len(starts))]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        found.append(mix(hashes(data, starts[longer], starts[longer] + k) + np.uint64(k)))
        word.append(longer)
    return np.concatenate(found), np.concatenate(word), bounds


def hits(texts: list[bytes | None], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the wanted features (sorted hashes) that occur, the text of each occurrence and its word."""
    found, word, bounds = features(texts)
    if not len(wanted) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
    hit = np.flatnonzero(wanted[at] == found)
    return at[hit], np.searchsorted(bounds, word[hit], "right") - 1, word[hit]


def presence(texts: list[bytes | None], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) numbers, each once."""
    parts = [np.zeros(0, np.int64)]
    for lo, hi in slices(texts):
        which, text, _ = hits(texts[lo:hi], wanted)
        parts.append(np.unique((text + lo) * max(1, len(wanted)) + which))
    pairs = np.concatenate(parts)
    return pairs % max(1, len(wanted)), pairs // max(1, len(wanted))


def associated(texts: list[bytes | None], positive: np.ndarray, least_z: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of features whose smoothed log odds of a positive text are least_z standard errors from 0, and the odds."""
    names, yes, no = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for lo, hi in slices(texts):
        found, word, bounds = features(texts[lo:hi])
        text = np.searchsorted(bounds, word, "right") - 1
        order = np.lexsort((text, found))
        found, text = found[order], text[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        found, good = np.concatenate([names, found[new]]), positive[lo:hi][text[new]]
        names, which = np.unique(found, return_inverse=True)
        yes = np.bincount(which, np.concatenate([yes, good]), len(names))
        no = np.bincount(which, np.concatenate([no, ~good]), len(names))
    n, m = positive.sum(), (~positive).sum()
    odds = np.log((yes + 0.5) / (n - yes + 0.5)) - np.log((no + 0.5) / (m - no + 0.5))
    error = np.sqrt(1 / (yes + 0.5) + 1 / (n - yes + 0.5) + 1 / (no + 0.5) + 1 / (m - no + 0.5))
    keep = np.abs(odds) >= least_z * error
    return names[keep], odds[keep]


def graded(texts: list[bytes | None], toxic: np.ndarray, strong: float = 3.0) -> np.ndarray:
    """Weak grades 0 to GRADES - 1: a toxic text's grade rises with its running words that are strongly associated."""
    names, odds = associated(texts, toxic)
    count = np.zeros(len(texts), np.int64)
    for lo, hi in slices(texts):
        _, text, word = hits(texts[lo:hi], names[odds >= strong])
        _, first = np.unique(word, return_index=True)
        count[lo:hi] = np.bincount(text[first], minlength=hi - lo)
    return np.where(toxic, 1 + (count > 1) + (count > 3), 0)


def train(texts: list[bytes | None], grades: np.ndarray, most_features: int = 4000, rounds: int = 400, penalty: float = 1e-3, rate: float = 0.05) -> Model:
    """Proximal Adam on the ordinal likelihood; grades that no row has share their neighbour's threshold."""
    top = int(grades.max(initial=0))
    empty = np.zeros(0, np.uint64)
    if top == 0 or not (grades == 0).any():
        return Model(empty, np.zeros(0), np.zeros(0), float(grades.mean()) if len(grades) else 0.0)
    names, odds = associated(texts, grades > 0)
    kept = np.sort(np.argsort(-np.abs(odds), kind="stable")[:most_features])
    names = names[kept]
    which, text = presence(texts, names)
    n = len(texts)
    w = np.zeros(len(names))
    rates = np.array([(grades > k).mean() for k in range(top)])
    c = -np.log(np.clip(rates, 1e-3, 1 - 1e-3) / (1 - np.clip(rates, 1e-3, 1 - 1e-3)))
    gaps = np.concatenate([c[:1], np.log(np.maximum(np.diff(c), 1e-3))])
    # Each threshold splits the rows into above and not; a composite of the binary likelihoods keeps the order.
    weight = np.where(grades > 0, PRIOR / (grades > 0).mean(), (1 - PRIOR) / (grades == 0).mean())
    values = [w, gaps]
    moments, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, rounds + 1):
        w, gaps = values
        spread = np.exp(gaps[1:])
        c = np.concatenate([gaps[:1], gaps[0] + np.cumsum(spread)])
        z = np.bincount(text, w[which], n)
        s = 1 / (1 + np.exp(np.clip(c[None, :] - z[:, None], -500, 500)))
        low = np.concatenate([np.ones((n, 1)), s], axis=1)[np.arange(n), grades]
        high = np.concatenate([s, np.zeros((n, 1))], axis=1)[np.arange(n), grades]
        p = np.maximum(low - high, 1e-12)
        slope = lambda x: x * (1 - x)
        dz = weight * (slope(low) * (grades > 0) - slope(high) * (grades < top)) / p / n
        dc = np.zeros(top)
        np.add.at(dc, grades[grades > 0] - 1, -(weight * slope(low) / p / n)[grades > 0])
        np.add.at(dc, grades[grades < top], (weight * slope(high) / p / n)[grades < top])
        tail = np.cumsum(dc[::-1])[::-1]
        grads = [np.bincount(which, dz[text], len(w)), np.concatenate([tail[:1], tail[1:] * spread])]
        for i, (v, g, m, q) in enumerate(zip(values, grads, moments, squares)):
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            scale = rate / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)
            v += scale * m / (1 - 0.9**step)
            if i == 0:
                v[:] = np.sign(v) * np.maximum(np.abs(v) - np.minimum(scale, 10.0) * penalty, 0)
    w, gaps = values
    c = np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))])
    used = w != 0
    return Model(names[used], w[used], c)


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 1500) -> list[tuple[bytes, int]]:
    """At most most_rows labelled texts with label 0 and as many with a larger one, by a hash of the id."""
    known = labels.select(F.col("doc_id").alias("i"), F.col(label).cast("int").alias("g")).where("i is not null and g >= 0").groupBy("i").agg(F.max("g").alias("g"))
    draw = F.xxhash64(F.col("i").cast("string"), F.lit("toxicity"))
    kinds = [known.where(c).orderBy(draw, "i").limit(most_rows) for c in ("g = 0", "g > 0")]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]))
    texts = docs.select(F.col("doc_id").alias("i"), F.col("text").cast("string").alias("t")).where(F.col("i").isNotNull() & (F.length("t") <= LONGEST))
    rows = texts.join(chosen, "i").groupBy("i").agg(F.min("t").alias("t"), F.max("g").alias("g")).collect()
    return [(r.t.encode(), r.g) for r in sorted(rows, key=lambda r: r.i)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 1500, weak: bool = True) -> Model:
    """weak: grade toxic rows by their words, for labels that only say yes or no."""
    rows = sample(docs, labels, label, most_rows)
    texts, grades = [t for t, _ in rows], np.array([g for _, g in rows], np.int64)
    return train(texts, graded(texts, grades > 0) if weak and len(rows) else grades)


def with_severity(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, the expected grade, and its name."""
    spark = docs.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = batch.to_pylist()
            parts = [sent.value.severity(values[lo:hi]) for lo, hi in slices(values)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    name = free_name(docs, "severity")
    score = F.arrow_udf(run, "double").asNondeterministic()
    return docs.withColumn(name, score(F.col(text_col).cast("string").cast("binary"))), name


def severities(docs: DataFrame, labels: DataFrame, most_rows: int = 1500) -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row; toxic: a severity of a half or more, grade: severity rounded."""
    found, name = with_severity(docs.select("doc_id", "text"), fit(docs, labels, most_rows=most_rows))
    s = F.col(name)
    return found.select("doc_id", s.alias("severity"), F.round(s).cast("int").alias("grade"), (s >= 0.5).alias("toxic"))
