"""Operator 2: toxicity by multiple-instance learning.

A document is a bag of sentences; only documents are labelled. A sentence's score is a logistic function of its telling
words and beginnings of words (0 without any), and a document's is the noisy-or of its sentences' scores and of a leak, the chance of a label without
any offending sentence: 1 - (1 - leak) x product of (1 - score). Labels of toxic documents may be missing at a rate ``flip``.
Weights, bias, leak and flip are fitted by the labels of documents alone, and the fitted sentence scores then locate the
offending sentences.

Words and beginnings (``STARTS`` letters, written with a star) are admitted in rounds by likelihood-ratio tests at a level of
``level`` over all of them. A round admits those with at least half the strongest evidence and sets the documents that
hold them aside, so that words which only keep company with telling ones are not admitted for them. Telling are those
whose documents are toxic at ``rate`` or more. A sentence of ``LONG`` words or more that several
documents share counts once.

The model is fitted on the driver from at most ``sample`` labelled rows (those of the least hash of doc_id; of a doc_id's
several texts the least) and at most ``words`` words; the strength of the prior is chosen on a fifth of these rows, left
out of the fit for it. All documents are scored by Arrow batches.

Defined results: null or empty text has no sentences and scores the leak; labels that are null or on null doc_ids are not
used, of a doc_id's several labels the largest counts; without labels of both kinds every score is the share of toxic
labels (0 without any); repeated rows are scored each; texts may be of any length; extra columns are ignored (``scored``) or
kept (``clean``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, only, written

SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings that are looked at beside whole words.
STARTS = (3, 4, 5, 6, 7)
#: Words of a sentence that only copies share.
LONG = 8
#: Where the bias starts, and what the prior draws it to.
BIAS = -4.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    bias: float = BIAS
    leak: float = 0.0
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.starts = sorted({len(w) - 1 for w in self.words if w.endswith("*")})

    def features(self, word: str) -> tuple[str, ...]:
        """Those of the model's words and beginnings that a lower-case word has; words met before are remembered."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= 100_000:
                self.memo.clear()
            found = self.memo[word] = self._features(word)
        return found

    def _features(self, word: str) -> tuple[str, ...]:
        return tuple(f for f in (word, *(word[:k] + "*" for k in self.starts if len(word) > k)) if f in self.words)

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of the sentences with known words."""
        low = text.lower()
        known = {w: f for w in set(WORD.findall(low)) if (f := self.features(w))}
        if not known:
            return []
        if len(low) != len(text):  # lower-casing can lengthen a text; places are then taken from a plain fold
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            known = {w: f for w in set(WORD.findall(low)) if (f := self.features(w))}
        start, out = 0, []
        for end in [*(m.end() for m in SENTENCE_END.finditer(low)), len(low)]:
            found = {f for w in WORD.findall(low, start, end) if w in known for f in known[w]}
            if found:
                z = self.bias + sum(self.words[f] for f in sorted(found))
                out.append((start, end, 1 / (1 + float(np.exp(-max(z, -60.0))))))
            start = end
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its known sentences."""
        known = self.sentences(text or "")
        loud = sum(np.log1p(-min(p, 1 - 1e-9)) for _, _, p in known)
        return float(1 - (1 - self.leak) * np.exp(loud)), known


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Bags:
    """Labels and, of each document, the word numbers of its sentences that have any."""

    def __init__(self, rows: list[tuple[int, list[list[int]]]], n_words: int) -> None:
        self.y, self.n, self.n_words = np.array([y for y, _ in rows], float), len(rows), n_words
        self.doc = np.array([i for i, (_, b) in enumerate(rows) for _ in b], np.int64)
        sentences = [s for _, b in rows for s in b]
        self.row = np.array([i for i, s in enumerate(sentences) for _ in s], np.int64)
        self.col = np.array([w for s in sentences for w in s], np.int64)
        self.m = len(sentences)

    def loss(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative log-likelihood of the labels and its gradient. theta: weights, bias, leak and flip (both as logits)."""
        w, bias, leak, flip = theta[: self.n_words], theta[-3], _sigmoid(theta[-2]), _sigmoid(theta[-1])
        p = np.minimum(_sigmoid(np.bincount(self.row, w[self.col], self.m) + bias), 1 - 1e-12)
        none = np.exp(np.bincount(self.doc, np.log1p(-p), self.n))  # no offending sentence
        clean = (1 - leak) * none
        marked = np.clip((1 - clean) * (1 - flip), 1e-12, 1 - 1e-12)  # chance of a label
        value = -(np.log(marked[self.y > 0]).sum() + np.log1p(-marked[self.y <= 0]).sum())
        g = np.where(self.y > 0, -1 / marked, 1 / (1 - marked))  # by marked
        gz = (g * (1 - flip) * clean)[self.doc] * p
        grad = np.concatenate([np.bincount(self.col, gz[self.row], self.n_words), [gz.sum(), (g * (1 - flip) * none).sum() * leak * (1 - leak), -(g * (1 - clean)).sum() * flip * (1 - flip)]])
        return value, grad


def _fit(bags: Bags, prior: float, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """Adam on the penalised likelihood; ``prior`` is a strength in documents, whatever their number."""
    share = np.clip(bags.y.mean(), 0.01, 0.99)
    centre = np.concatenate([np.zeros(bags.n_words), [BIAS, np.log(share / (1 - share)) - 1, -4.0]])
    theta = centre + np.concatenate([np.full(bags.n_words, -BIAS), np.zeros(3)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        grad = bags.loss(theta)[1] + prior * (theta - centre)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def _features(words: str) -> Column:
    """The distinct words and beginnings of an array of words."""
    starts = lambda w: F.array_compact(F.array(w, *[F.when(F.length(w) > k, F.concat(F.left(w, F.lit(k)), F.lit("*"))) for k in STARTS]))
    return F.array_distinct(F.flatten(F.transform(words, starts)))


def _telling(bags: DataFrame, words: int, min_docs: int, level: float, rate: float) -> list[str]:
    """Features admitted from bags (doc, toxic, words), round by round."""
    each = lambda df: df.select("doc", "toxic", F.explode(_features("words")).alias("word"))
    some = written(each(bags.where("toxic = 1")).groupBy(F.col("word").alias("w")).agg(F.count("*").alias("a")).where(F.col("a") >= min_docs), "toxicity-some")
    m = some.count()
    # the toxic share of a feature's documents falls as documents are set aside, but for clean ones that hold other features: half the rate is asked here
    others = each(bags.where("toxic = 0")).join(some, F.col("word") == F.col("w"), "left_semi").groupBy("word").agg(F.count("*").alias("b"))
    likely = some.join(others, F.col("w") == F.col("word"), "left").where(F.col("a") >= (F.col("a") + F.coalesce("b", F.lit(0))) * (rate / 2)).select("w")
    likely = written(likely, "toxicity-likely")
    seen = written(each(bags).join(likely, F.col("word") == F.col("w"), "left_semi"), "toxicity-seen")
    drop(some, likely)
    sizes, gone, names = {r.toxic: r["count"] for r in bags.groupBy("toxic").count().collect()}, {0: 0, 1: 0}, []
    need = NormalDist().inv_cdf(1 - level / (2 * max(m, 1))) ** 2
    while len(names) < words:
        n1, n0 = (sizes.get(k, 0) - gone[k] for k in (1, 0))
        if not n1 or not n0:
            break
        a, b, share = F.col("a"), F.col("b"), n1 / (n1 + n0)
        part = lambda k, p: F.when(k > 0, k * F.log(k / ((a + b) * p))).otherwise(0.0)
        counts = seen.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(a + b >= min_docs)
        tested = counts.where((a > (a + b) * share) & (a >= (a + b) * rate)).select("word", (2 * (part(a, share) + part(b, 1 - share))).alias("g"))
        best = tested.orderBy(F.desc("g"), "word").limit(words - len(names)).collect()  # at most ``words`` rows
        more = [r.word for r in best if r.g >= max(need, best[0].g / 2)]
        if not more:
            break
        names += more
        held = written(seen.where(F.col("word").isin(more)).select(F.col("doc").alias("d"), F.col("toxic").alias("t")).distinct(), "toxicity-held")
        for r in held.groupBy("t").count().collect():
            gone[r.t] += r["count"]
        left = written(seen.join(held, F.col("doc") == F.col("d"), "left_anti"), "toxicity-left")
        drop(seen, held)
        seen = left
    drop(seen)
    return names


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, words: int = 2_000, min_docs: int = 3, level: float = 0.01, rate: float = 0.7, priors: tuple[float, ...] = (0.003, 0.03, 0.3)) -> Model:
    """docs (doc_id, text) and labels (doc_id, toxic) -> Model; rows held out are not read for it."""
    marked = only(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows, so it can be broadcast
    joined = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    picked = written(joined, "toxicity-sample")
    totals = {r.toxic: r["count"] for r in picked.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        drop(picked)
        return Model(leak=n1 / max(1, n0 + n1))
    said = picked.select("doc", "toxic", F.explode(F.split(F.lower("text"), SENTENCE_END.pattern)).alias("sentence")).where("sentence != ''")
    # a long sentence counts for the document of least hash that has it: others with it are copies; short ones can be alike by chance
    long = F.regexp_count("sentence", F.lit(r"\p{L}+")) >= LONG
    once = said.groupBy(F.when(long, F.xxhash64("sentence")).otherwise(F.xxhash64("sentence", "doc")).alias("h")).agg(F.min(F.struct(F.xxhash64("doc").alias("k"), "doc", "toxic", "sentence")).alias("s")).select("s.*")
    words_of = F.array_distinct(F.flatten(F.transform(F.collect_list("sentence"), lambda t: F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0)))))
    sets = written(once.groupBy("doc", "toxic").agg(words_of.alias("words")), "toxicity-sets")
    names = _telling(sets, words, min_docs, level, rate)
    drop(sets)
    number, look = {w: i for i, w in enumerate(names)}, Model(dict.fromkeys(names, 0.0))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                sentences = [sorted({number[f] for w in WORD.findall(s) for f in look.features(w)}) for s in SENTENCE_END.split((text or "").lower())]
                out.append([s for s in sentences if s])
            yield pd.DataFrame({"doc": b["doc"], "toxic": b["toxic"], "known": out})

    rows = picked.mapInPandas(bags, "doc long, toxic int, known array<array<int>>").withColumn("fold", F.pmod(F.xxhash64("doc", F.lit("fold")), F.lit(5))).collect()  # at most ``sample`` rows
    drop(picked)
    rows.sort(key=lambda r: r.doc)  # sums don't hang on the order of tasks
    some, rest = ([(r.toxic, r.known) for r in rows if (r.fold > 0) == k] for k in (True, False))
    prior = min(priors, key=lambda s: Bags(rest, len(names)).loss(_fit(Bags(some, len(names)), s))[0]) if some and rest else priors[0]
    theta = _fit(Bags([(r.toxic, r.known) for r in rows], len(names)), prior)
    return Model({w: float(x) for w, x in zip(names, theta)}, float(theta[-3]), float(_sigmoid(theta[-2])))


def scored(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """doc_id, score, n_offending (sentences scored ``offending`` or more) and offending: start:end of each, comma-joined (code points)."""

    @F.pandas_udf("score double, n_offending long, offending string")
    def score(texts: pd.Series) -> pd.DataFrame:
        got = [model.score(t) for t in texts]
        bad = [[f"{a}:{b}" for a, b, p in known if p >= offending] for _, known in got]
        return pd.DataFrame({"score": [min(max(s, 0.0), 1.0) for s, _ in got], "n_offending": [len(b) for b in bad], "offending": [",".join(b) for b in bad]})

    return only(docs, "doc_id", "text").select("doc_id", score("text").alias("s")).select("doc_id", "s.*")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every row of docs."""
    out = scored(docs, train(docs, labels, **parameters))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_offending", "offending")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **parameters) -> DataFrame:
    """The rows of docs whose score stays under threshold."""
    model = train(docs, labels, **parameters)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t)[0] for t in texts], dtype="float64")

    return docs.where(score("text") < threshold)
