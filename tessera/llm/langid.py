"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters (ASCII letters and all non-ASCII characters, in lower
case). Its features, hashed into FEATURES weights for each language: byte n-grams
of one to four inside ^word$, of which those that touch ^ or $ are its affixes;
the word itself; and membership in each language's lexicon of frequent training
words. Transitions between neighbouring words are learned with the rest by maximum
conditional likelihood on windows of WINDOW words, a share of which splice two
languages, as code-switched text does. Forward-backward labels every word of every
whole text as one chain; a document's language is the one with the largest
sum of word marginals, its score the mean marginal of that language.

A chain is worked through in windows side by side: each window's product of transition
and emission matrices carries the messages over to its neighbours, so the result does
not depend on WINDOW, and a text of any length is labelled exactly.

Training uses at most `per_language` documents of each language, drawn by a hash
of the id, none longer than `longest` characters (documented bounds; prediction has
none), and all their windows. Everything else is one pass without a shuffle.

Defined results: `und` with score 0 for a null text or one without a letter, and
for all texts if there is nothing to learn from; rows with a null id are never
held out and never learned from; repeated rows get equal results; the language,
source and id are no inputs of a prediction; an empty table gives an empty one; other
columns are passed on or not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import free_name, importable
from tessera.llm.words import hashes, mix, separators, slices, spans

FEATURES = 1 << 16
WINDOW = 128
LEXICON = 300
#: Windows whose scores are held at once.
BATCH = 1000
#: Everything but a-z and bytes of non-ASCII characters.
BY_LETTERS = separators((0x00, 0x60), (0x7B, 0x7F))


@dataclass
class Words:
    """Distinct words, and the position of each running word among them."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    which: np.ndarray
    bounds: np.ndarray


def read_words(texts: list[bytes | None]) -> Words:
    data = np.frombuffer(b"\n".join([t or b"" for t in texts]), np.uint8)
    starts, ends = spans(data, BY_LETTERS)
    lengths = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    found, first, which = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    return Words(data, starts[first], ends[first], found, which, bounds)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the distinct words, one after another, and where each word's begin."""
    lengths = words.ends - words.starts + 2
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    total = int(offsets[-1])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(total) - offsets[owner]
    at = words.starts[owner] + within - 1
    marked = np.where(within == 0, 1, np.where(within == lengths[owner] - 1, 2, words.data[np.clip(at, 0, len(words.data) - 1)] if total else 0)).astype(np.uint64)
    owners, ids = [], []
    for n in range(1, 5):
        keep = np.flatnonzero(within + n <= lengths[owner])
        gram = np.full(len(keep), n, np.uint64)
        for k in range(n):
            gram = gram << np.uint64(8) | marked[keep + k]
        owners.append(owner[keep])
        ids.append((mix(gram) % np.uint64(FEATURES)).astype(np.int32))
    owners.append(np.arange(len(lengths)))
    ids.append((mix(words.hashes ^ np.uint64(0xA5A5)) % np.uint64(FEATURES)).astype(np.int32))
    flat = np.concatenate(owners)
    order = np.argsort(flat, kind="stable")
    counts = np.bincount(flat, minlength=len(lengths))
    return np.concatenate(ids)[order], np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray
    members: np.ndarray
    lexicon_weights: np.ndarray

    def member_rows(self, found: np.ndarray) -> np.ndarray:
        """Which lexicons hold the words with these hashes."""
        if not len(self.lexicon):
            return np.zeros((len(found), len(self.languages)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, found), len(self.lexicon) - 1)
        return self.members[at] * (self.lexicon[at] == found)[:, None]

    def emissions(self, words: Words) -> np.ndarray:
        """Scores of the distinct words for each language."""
        if not len(words.hashes):
            return np.zeros((0, len(self.languages)), np.float32)
        ids, begin = features(words)
        return np.add.reduceat(self.weights[ids], begin, axis=0) + self.member_rows(words.hashes) @ self.lexicon_weights


def windows(bounds: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of consecutive windows that cover all words."""
    n = np.diff(bounds)
    per = -(-n // size)
    owner = np.repeat(np.arange(len(n)), per)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    first = bounds[:-1][owner] + rank * size
    return first, np.minimum(size, bounds[1:][owner] - first), owner


def marginals(
    scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, train: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded windows.

    scores: (windows, steps, languages). before: the weights of the languages of each window's
    first word, by what precedes it (exp(start) if nothing does); after: those of its last
    word, by what follows. Returns word marginals and, in training, expected transition
    counts and the log-likelihood's normaliser of each window.
    """
    n, steps, _ = scores.shape
    top = scores.max(axis=2, keepdims=True)
    p = np.exp(scores - top)
    move = np.exp(transitions)
    live = np.arange(steps)[None, :] < lengths[:, None]
    ahead = np.empty_like(p)
    scale = np.ones((n, steps), p.dtype)
    state = p[:, 0] * (np.exp(start) if before is None else before)
    for t in range(steps):
        if t:
            state = np.where(live[:, t, None], (ahead[:, t - 1] @ move) * p[:, t], ahead[:, t - 1])
        scale[:, t] = state.sum(axis=1)
        ahead[:, t] = state = state / scale[:, t, None]
    behind = np.ones_like(ahead[:, 0]) if after is None else after.astype(p.dtype)
    out = np.empty_like(p)
    pairs = np.zeros_like(transitions)
    for t in range(steps - 1, -1, -1):
        both = ahead[:, t] * behind
        out[:, t] = both / both.sum(axis=1, keepdims=True)
        if t:
            alive = live[:, t, None]
            weighted = p[:, t] * behind
            back = weighted @ move.T
            if train:
                joint = (ahead[:, t - 1] * alive).T @ (weighted / np.maximum((ahead[:, t - 1] * back).sum(axis=1, keepdims=True), 1e-30))
                pairs += joint * move
            behind = np.where(alive, back / np.maximum(back.max(axis=1, keepdims=True), 1e-30), behind)
    logs = np.where(live, np.log(scale) + top[:, :, 0], 0).sum(axis=1)
    return out * live[:, :, None], pairs, logs


def transfers(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """(windows, languages, languages): from the word before a window to its last word, each up to a factor."""
    n, steps, k = scores.shape
    p, move = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(transitions)
    state = np.repeat(np.eye(k, dtype=p.dtype)[None], n, axis=0)
    for t in range(steps):
        step = (state @ move) * p[:, t, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        state = np.where((t < lengths)[:, None, None], step, state)
    return state


def messages(first: np.ndarray, lengths: np.ndarray, owner: np.ndarray, which: np.ndarray, scores: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """What the rest of each window's text says of its first and of its last word."""
    n, k, move = len(first), len(model.languages), np.exp(model.transitions)
    before, after = np.repeat(np.exp(model.start)[None], n, axis=0), np.ones((n, k), np.float32)
    later = np.flatnonzero(np.append(False, owner[1:] == owner[:-1]))
    if not len(later):
        return before, after
    carry = np.empty((n, k, k), np.float32)
    for lo in range(0, len(later), BATCH):
        at = later[lo : lo + BATCH]
        carry[at] = transfers(scores[padded(first[at], lengths[at], which)], lengths[at], model.transitions)
    opening = np.setdiff1d(later - 1, later)
    ends = np.ones((n, k), np.float32)
    for lo in range(0, len(opening), BATCH):
        at = opening[lo : lo + BATCH]
        ends[at] = last_states(scores[padded(first[at], lengths[at], which)], lengths[at], model)
    rank = np.arange(n) - np.searchsorted(owner, owner)
    order = later[np.argsort(rank[later], kind="stable")]
    cuts = np.searchsorted(rank[order], np.arange(1, rank.max() + 2))
    for lo, hi in zip(cuts, cuts[1:]):
        at = order[lo:hi]
        before[at] = ends[at - 1] @ move
        state = np.einsum("ni,nij->nj", ends[at - 1], carry[at])
        ends[at] = state / state.max(axis=1, keepdims=True)
    for lo, hi in reversed(list(zip(cuts, cuts[1:]))):
        at = order[lo:hi]
        state = np.einsum("nij,nj->ni", carry[at], after[at])
        after[at - 1] = state / state.max(axis=1, keepdims=True)
    return before, after


def last_states(scores: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Forward weights of each window's last word, for windows that begin a text."""
    p, move = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(model.transitions)
    state = p[:, 0] * np.exp(model.start)
    for t in range(1, p.shape[1]):
        step = (state @ move) * p[:, t]
        state = np.where((t < lengths)[:, None], step / step.max(axis=1, keepdims=True), state)
    return state


def padded(first: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Distinct-word numbers of each window; places beyond its end repeat some word and are masked by length."""
    steps = int(lengths.max(initial=1))
    at = first[:, None] + np.arange(steps)[None, :]
    return which[np.minimum(at, len(which) - 1)]


def train(rows: list[tuple[bytes, str]], rounds: int = 40, spliced: float = 0.3, seed: int = 5, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Maximise the conditional likelihood of (text, language) rows by Adam over all windows, BATCH of them at a time."""
    languages = sorted({lang for _, lang in rows})
    k, rng = len(languages), np.random.default_rng(seed)
    words = read_words([t for t, _ in rows])
    first, lengths, owner = windows(words.bounds)
    number_of = {lang: i for i, lang in enumerate(languages)}
    label = np.array([number_of[lang] for _, lang in rows])[owner] if len(rows) else np.zeros(0, int)
    empty = Model(languages, np.zeros((FEATURES, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32), np.zeros(0, np.uint64), np.zeros((0, k), np.float32), np.zeros((k, k), np.float32))
    if not len(first):
        return empty
    number = padded(first, lengths, words.which).astype(np.int32)
    gold = np.repeat(label[:, None], number.shape[1], axis=1).astype(np.int16)
    for i in np.flatnonzero(rng.random(len(first)) < spliced):
        j = rng.integers(len(first))
        if label[i] != label[j] and min(lengths[i], lengths[j]) > 1:
            cut = rng.integers(1, min(lengths[i], lengths[j]))
            end = lengths[j]
            number[i, cut:end], gold[i, cut:end], lengths[i] = number[j, cut:end], label[j], end
    live = np.arange(number.shape[1])[None, :] < lengths[:, None]
    used = np.unique(number[live])
    number = np.minimum(np.searchsorted(used, number), len(used) - 1).astype(np.int32)
    words = Words(words.data, words.starts[used], words.ends[used], words.hashes[used], number, words.bounds)
    counts = np.bincount(number[live] * np.int64(k) + gold[live], minlength=len(words.hashes) * k).reshape(-1, k)
    members = np.zeros((len(words.hashes), k), np.float32)
    for lang in range(k):
        members[np.argsort(-counts[:, lang], kind="stable")[:LEXICON], lang] = 1
    members *= counts >= 3
    listed = members.any(axis=1)

    ids, begin = features(words)
    per_word = np.diff(np.append(begin, len(ids)))
    feature_owner = np.repeat(np.arange(len(per_word)), per_word)
    shapes = [(FEATURES, k), (k, k), (k,), (k, k)]
    values = [np.zeros(s, np.float64) for s in shapes]
    moments, squares = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    total = live.sum()
    gold_pairs = np.bincount((gold[:, :-1].astype(np.int64) * k + gold[:, 1:])[live[:, 1:]], minlength=k * k).reshape(k, k)
    gold_start = np.bincount(gold[:, 0], minlength=k)
    unit = np.eye(k, dtype=np.float32)
    for step in range(1, rounds + 1):
        weights, transitions, start, lexical = values
        word_scores = np.add.reduceat(weights.astype(np.float32)[ids], begin, axis=0) + members @ lexical.astype(np.float32)
        by_word, pairs, starts = np.zeros((len(per_word), k)), np.zeros((k, k)), np.zeros(k)
        for lo in range(0, len(number), BATCH):
            at = slice(lo, lo + BATCH)
            post, joint, _ = marginals(word_scores[number[at]], lengths[at], transitions.astype(np.float32), start.astype(np.float32))
            gap = (unit[gold[at]] * live[at][:, :, None] - post).reshape(-1, k)
            for c in range(k):
                by_word[:, c] += np.bincount(number[at].ravel(), gap[:, c], len(per_word))
            pairs += joint
            starts += post[:, 0].sum(axis=0)
        spread = by_word.astype(np.float32)[feature_owner]
        grads = [
            np.stack([np.bincount(ids, spread[:, c], FEATURES) for c in range(k)], axis=1) / total - decay * weights,
            (gold_pairs - pairs) / total - decay * transitions,
            (gold_start - starts) / total - decay * start,
            members.T @ by_word / total - decay * lexical,
        ]
        for v, g, m, s in zip(values, grads, moments, squares):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    kept = np.flatnonzero(listed)
    return Model(languages, *[v.astype(np.float32) for v in values[:3]], words.hashes[kept], members[kept], values[3].astype(np.float32))


def label_words(texts: list[bytes | None], model: Model, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every running word, and where each text's words begin."""
    words = read_words(texts)
    first, lengths, owner = windows(words.bounds, size)
    out = np.zeros((len(words.which), len(model.languages)), np.float32)
    if not len(first):
        return out, words.bounds
    scores = model.emissions(words)
    before, after = messages(first, lengths, owner, words.which, scores, model)
    for lo in range(0, len(first), BATCH):
        at = slice(lo, lo + BATCH)
        f, n = first[at], lengths[at]
        post, _, _ = marginals(scores[padded(f, n, words.which)], n, model.transitions, model.start, before[at], after[at], train=False)
        live = np.arange(post.shape[1])[None, :] < n[:, None]
        out[(f[:, None] + np.arange(post.shape[1])[None, :])[live]] = post[live]
    return out, words.bounds


def classify(texts: list[bytes | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the number of its language, that language's mean marginal, and its words."""
    post, bounds = label_words(texts, model)
    n = np.diff(bounds)
    sums = np.diff(np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0, dtype=np.float64)])[bounds], axis=0)
    best = sums.argmax(axis=1) if post.shape[1] else np.zeros(len(n), int)
    score = sums[np.arange(len(n)), best] / np.maximum(n, 1) if post.shape[1] else np.zeros(len(n))
    return best, np.clip(score, 0.0, 1.0), n


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, learn: Column, per_language: int = 150, longest: int = 40_000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from rows for which learn holds, at most per_language of each language, of up to `longest` characters.

    The languages' shares come from one count, so that few more rows than needed are drawn
    before each language's are numbered.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("l"), text.alias("s"), learn.alias("ok"))
    rows = rows.where(F.col("ok") & F.col("i").isNotNull() & F.col("l").isNotNull() & F.col("s").isNotNull() & (F.length("s") <= longest))
    draw = F.pmod(F.xxhash64("i", F.lit("langid")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.least(F.lit(1.0), (2 * per_language + 50) / F.col("n"))
    drawn = rows.select("l", "s", "i", draw.alias("d")).join(F.broadcast(rows.groupBy("l").agg(F.count("*").alias("n"))), "l").where(F.col("d") <= share)
    sample = drawn.withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy("d", "i", F.xxhash64("s"), "s"))).where(F.col("place") <= per_language)
    found = sample.select("l", "place", F.lower("s").cast("binary").alias("t")).collect()
    return train([(bytes(r.t), r.l) for r in sorted(found, key=lambda r: (r.l, r.place))])


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, struct<lang, score, words>, and its name."""
    spark = docs.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        names = pa.array([*model.languages, "und"], pa.string())
        for batch in batches:
            values, parts = batch.to_pylist(), []
            for lo, hi in slices(values, 1 << 20):
                if model.languages:
                    best, score, n = classify(values[lo:hi], model)
                else:
                    best, score, n = np.zeros(hi - lo, int), np.zeros(hi - lo), np.zeros(hi - lo, int)
                best, score = np.where(n > 0, best, len(model.languages)), np.where(n > 0, score, 0.0)
                parts.append(pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score), pa.array(n.astype(np.int64))], names=["lang", "score", "words"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("words", pa.int64())]))

    text = F.lower(F.col(text_col).cast("string"))
    lettered = F.when(text.rlike(r"\p{L}"), text).cast("binary")
    name = free_name(docs, "language")
    predict = F.arrow_udf(run, "lang string, score double, words long").asNondeterministic()
    return docs.withColumn(name, predict(lettered)), name


def identified(docs: DataFrame, folds: int = 3, fold: int = 1, per_language: int = 150) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, words), learning from rows whose crc32(doc_id) mod folds is not fold."""
    out = held_out(F.col("doc_id"), folds, fold)
    model = fit(docs, ~out, per_language)
    found, name = with_language(docs.select("doc_id", "text"), model)
    p = F.col(name)
    return found.select("doc_id", out.alias("held_out"), p["lang"].alias("lang_pred"), p["score"].alias("score"), p["words"].alias("words"))


def accepted(docs: DataFrame, model: Model, least_score: float = 0.4) -> DataFrame:
    """docs without those that are undetermined or mostly in no one language."""
    found, name = with_language(docs, model)
    return found.where((F.col(name)["lang"] != "und") & (F.col(name)["score"] >= least_score)).select(*docs.columns)
