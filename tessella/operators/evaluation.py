"""Metrics and statistics: overlap, spans, answers, citations, percentiles, Holm, bootstrap, permutation, variability."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.ordered import overlapping, quantiles
from tessella.operators.prefix import numbered, running

KS = (1, 3, 5, 10)
# Stand between accepted answers, and between the parts of one, while all are normalised at once.
NEXT, AND = "\u0001", "\u0002"


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def _numbered(words: Column) -> Column:
    """Each word with the number of its occurrence, so that sets of them meet as multisets."""
    return _let(F.array_sort(words), lambda s: F.transform(s, lambda w, i: F.concat(w, F.lit("#"), (i - F.array_position(s, w)).cast("string"))))


def f1_of(p: Column, g: Column) -> Column:
    """F1 of two arrays of words as multisets; both empty 1, one empty 0."""
    n, m, same = F.size(p), F.size(g), F.size(F.array_intersect(_numbered(p), _numbered(g)))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(2.0 * same / (n + m))


def token_f1(pairs: DataFrame, key: str, prediction: str, gold: str) -> DataFrame:
    """key, f1 of normalised tokens; the parts of an ``A && B`` answer count together."""
    side = lambda c: _words(T.normalized_answer(F.replace(F.col(c), F.lit("&&"), F.lit(" "))))
    return pairs.select(key, side(prediction).alias("p"), side(gold).alias("g")).select(key, f1_of(F.col("p"), F.col("g")).alias("f1"))


def _golds(answers: Column) -> Column:
    """array<array<string>>: the normalised parts of each accepted answer."""
    joined = F.array_join(F.transform(answers, lambda a: F.replace(a, F.lit("&&"), F.lit(AND))), f" {NEXT} ")
    return F.transform(F.split(T.normalized_answer(joined), NEXT), lambda a: F.transform(F.split(a, AND), lambda p: F.trim(p)))


def _holds(text: Column, golds: Column) -> Column:
    """Whether every part of one of the answers is in the normalised text as whole words."""
    return F.exists(golds, lambda parts: F.forall(parts, lambda p: (p != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))))


def contains_answer(text: Column, answers: Column) -> Column:
    """Whether a text holds an accepted answer (an array of them); ``A && B`` asks for both."""
    both = F.struct(T.normalized_answer(text).alias("t"), _golds(answers).alias("g"))  # bound outside the lambda, where Python may run
    return F.when(F.size(answers) == 0, False).otherwise(_let(both, lambda x: _holds(x["t"], x["g"])))


def answer_metrics(rows: DataFrame) -> DataFrame:
    """(query_id, answerable, answers, answer, abstained[, injected_claim]) -> query_id and the metrics, null where they don't apply."""
    said = rows.withColumn("_text", T.normalized_answer(T.without_citations(F.coalesce("answer", F.lit(""))))).withColumn("_golds", F.when(F.size("answers") > 0, _golds(F.col("answers"))).otherwise(F.array().cast("array<array<string>>")))
    if "injected_claim" in rows.columns:
        said = said.withColumn("_claim", _golds(F.array(F.coalesce("injected_claim", F.lit("")))))
    away, can = F.col("abstained").cast("double"), F.col("answerable")
    whole = lambda parts: F.array_join(F.filter(parts, lambda p: p != ""), " ")
    right = (~F.col("abstained") & _holds(F.col("_text"), F.col("_golds"))).cast("double")
    best = F.array_max(F.transform("_golds", lambda g: f1_of(_words(F.col("_text")), _words(whole(g)))))
    out = {
        "abstention_correct": F.when(~can, away), "accuracy": F.when(can, right), "f1": F.when(can, F.when(F.col("abstained"), 0.0).otherwise(F.coalesce(best, F.lit(0.0)))),
        "exact_match": F.when(can, (~F.col("abstained") & F.exists("_golds", lambda g: whole(g) == F.col("_text"))).cast("double")),
        "false_abstention": F.when(can, away), "overall_correct": F.when(can, right).otherwise(away),
    }
    if "injected_claim" in rows.columns:
        claimed = F.coalesce("injected_claim", F.lit("")) != ""
        out["injection_followed"] = F.when(claimed, _holds(F.col("_text"), F.col("_claim")).cast("double"))
    return said.select("query_id", *[c.alias(n) for n, c in out.items()])


def covered(evidence: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """evidence (query_id, ev, doc_id, start, stop) and chunks (query_id, rank, doc_id, start, stop): query_id, ev, rank of each chunk that holds ``least`` of the span or more; spans without a place are never covered."""
    met = overlapping(evidence.select("query_id", "ev", "doc_id", "start", "stop").where("start >= 0"), chunks.select("query_id", "rank", "doc_id", "start", "stop"), ["query_id", "doc_id"])
    shared = F.least("l.stop", "r.stop") - F.greatest("l.start", "r.start")
    return met.where(shared >= least * F.greatest(F.lit(1), F.col("l.stop") - F.col("l.start"))).select("l.query_id", "l.ev", "r.rank")


def retrieval_metrics(evidence: DataFrame, hits: DataFrame, k: int | Sequence[int] = 5) -> DataFrame:
    """evidence (query_id, ev[, evidence_any]), hits (query_id, ev, rank: of a candidate that covers ev, of all candidates) -> query_id, mrr and hit, recall, ndcg at k
    (``hit@k`` ... for several k). Each span gains once, at its first rank; with evidence_any all spans of a question are one."""
    ks, name = ((k,), lambda m, i: m) if isinstance(k, int) else (tuple(k), lambda m, i: f"{m}@{i}")
    if "evidence_any" in evidence.columns:
        one = evidence.select("query_id", F.col("ev").alias("of"), F.when(F.col("evidence_any"), F.lit(None)).otherwise(F.col("ev")).alias("ev"))
        hits = hits.select("query_id", F.col("ev").alias("of"), "rank").join(one, ["query_id", "of"]).select("query_id", "ev", "rank")
        evidence = one.select("query_id", "ev").distinct()
    best = hits.groupBy(F.col("query_id").alias("q"), F.col("ev").alias("e")).agg(F.min("rank").alias("rank"))
    first = evidence.select("query_id", "ev").join(best, (F.col("query_id") == F.col("q")) & F.col("ev").eqNullSafe(F.col("e")), "left")
    gain = lambda i: F.sum(F.when(F.col("rank") <= i, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    found = lambda i: F.sum((F.coalesce("rank", F.lit(i + 1)) <= i).cast("int"))
    out = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("best"), *[c for i in ks for c in (found(i).alias(f"found{i}"), gain(i).alias(f"dcg{i}"))])
    ideal = lambda i: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(i), F.col("n").cast("int"))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    each = [c for i in ks for c in ((F.col(f"found{i}") > 0).cast("double").alias(name("hit", i)), (F.col(f"found{i}") / F.col("n")).alias(name("recall", i)), F.least(F.lit(1.0), F.col(f"dcg{i}") / ideal(i)).alias(name("ndcg", i)))]
    return out.select("query_id", F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"), *each)


def citation_metrics(evidence: DataFrame, cited: DataFrame, answered: DataFrame, least: float = 0.5) -> DataFrame:
    """evidence as for ``covered`` (and evidence_any), cited (query_id, rank, doc_id, start, stop: the cited chunks), answered (query_id, abstained) ->
    query_id, citation_precision, citation_recall of the questions with evidence that were answered; 0 and 0 without citations."""
    met = covered(evidence, cited, least)
    of = evidence.groupBy("query_id").agg(F.count("*").alias("n"), (F.max("evidence_any") if "evidence_any" in evidence.columns else F.lit(False)).alias("any"))
    n_cited = cited.groupBy("query_id").agg(F.count("*").alias("cited"))
    good = met.groupBy("query_id").agg(F.count_distinct("rank").alias("useful"), F.count_distinct("ev").alias("found"))
    all_of = answered.where(~F.col("abstained")).select("query_id").join(of, "query_id").join(n_cited, "query_id", "left").join(good, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    recall = F.when(F.col("any"), (zero("found") > 0).cast("double")).otherwise(zero("found") / F.col("n"))
    return all_of.select("query_id", F.when(zero("cited") > 0, zero("useful") / F.col("cited")).otherwise(0.0).alias("citation_precision"), F.when(zero("cited") > 0, recall).otherwise(0.0).alias("citation_recall"))


def holm(tests: DataFrame, group: str, p: str = "p", order: str = "test") -> DataFrame:
    """Step-down adjusted p within each group: ranks and running maxima over ranges, so a group of any number of tests is many tasks' work."""
    placed = numbered(tests, [group], [p, order], "_i")
    sizes = tests.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_m"))
    raw = F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))
    joined = placed.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_raw", raw)
    return running(joined, [group], ["_i"], maxima={"adjusted": F.col("_raw")}).select(*tests.columns, "adjusted")


_UP = np.uint64(0x9E3779B97F4A7C15)
#: Chances of a Poisson variable of mean 1 to be at most 0, 1, 2, ...
_POISSON = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, n + 1))) for n in range(12)])


def drawn(keys: np.ndarray, turns: np.ndarray, seed: int) -> np.ndarray:
    """Even numbers of 0 .. 1, one for each key and turn, the same wherever and whenever they are drawn."""
    x = keys.astype(np.uint64)[:, None] + (turns.astype(np.uint64)[None, :] + np.uint64(seed) * np.uint64(1_000_003) + np.uint64(1)) * _UP
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def _summed(values: DataFrame, group: str, value: str, order: str, turns: int, weigh, block: int = 1024) -> DataFrame:
    """group, w and s: arrays over turns of the sums of weights and of weighted values. Rows are weighed in batches, and only the sums travel."""
    kind = values.schema[group].dataType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for b in batches:
            for g, part in b.groupby("g", dropna=False):
                w, s = totals.setdefault(g, (np.zeros(turns), np.zeros(turns)))
                for lo in range(0, len(part), block):
                    x = part.iloc[lo : lo + block]
                    got = weigh(x["k"].to_numpy(np.int64), np.arange(turns))
                    w += got.sum(axis=0)
                    s += x["v"].to_numpy(float) @ got
            if len(totals) > 64:
                yield pd.DataFrame({"g": list(totals), "w": [w for w, _ in totals.values()], "s": [s for _, s in totals.values()]})
                totals = {}
        if totals:
            yield pd.DataFrame({"g": list(totals), "w": [w for w, _ in totals.values()], "s": [s for _, s in totals.values()]})

    rows = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.xxhash64(order).alias("k"), F.col(value).cast("double").alias("v"))
    parts = rows.mapInPandas(sums, f"g {kind}, w array<double>, s array<double>").select("g", F.posexplode(F.arrays_zip("w", "s")).alias("turn", "x"))
    return parts.groupBy("g", "turn").agg(F.sum("x.w").alias("w"), F.sum("x.s").alias("s"))


def bootstrap_ci(values: DataFrame, group: str, value: str, order: str, resamples: int = 2000, alpha: float = 0.05, seed: int = 13) -> DataFrame:
    """group, mean, low, high: percentile bootstrap of the mean. Nulls take no part; a group of equal values has them for limits.

    Each row counts Poisson(1) times in a resample, drawn by a hash of its ``order`` and the resample's number, so resamples of
    any group are sums over batches, and the same in any partitioning.
    """
    turns = _summed(values, group, value, order, resamples, lambda k, t: np.searchsorted(_POISSON, drawn(k, t, seed)).astype(float))
    limits = turns.where("w > 0").groupBy("g").agg(F.percentile(F.col("s") / F.col("w"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    known = values.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("h")).agg(F.avg(value).alias("mean"), (F.min(value) == F.max(value)).alias("same"))
    both = known.join(limits, F.col("h").eqNullSafe(F.col("g")), "left")
    limit = lambda i: F.when(F.col("same"), F.col("mean")).otherwise(F.col("q")[i])
    return both.select(F.col("h").alias(group), "mean", limit(0).alias("low"), limit(1).alias("high"))


def resampled_ci(values: DataFrame, group: str, value: str, order: str, resamples: int = 2000, alpha: float = 0.05, seed: int = 13, rows: int = 20_000) -> DataFrame:
    """group, mean, low, high: percentile bootstrap of the mean, with exactly n draws of a group's n values in each resample. Nulls take no part.

    A group's rows are dealt by a hash of ``order`` to parts of about ``rows``; a resample's n draws are first shared between the parts by a multinomial draw over their
    sizes, then each part draws as many of its own rows. The draws hang on the seed, the group, the part and its rows alone, not on partitions."""
    kind = values.schema[group].dataType.simpleString()
    said = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.xxhash64(order).alias("k"), F.col(value).cast("double").alias("v"))
    sizes = said.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.min("v") == F.max("v")).alias("same"))
    parts = sizes.select(F.col("g").alias("h"), F.ceil(F.col("n") / rows).cast("int").alias("parts"))
    dealt = said.join(parts, F.col("g").eqNullSafe(F.col("h"))).select("g", "k", "v", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"))
    held = dealt.groupBy("g", "part").agg(F.count("*").alias("m"))

    def shared(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("part")
        m = b["m"].to_numpy(np.int64)
        draws = np.random.default_rng([seed, zlib.crc32(repr(b["g"].iloc[0]).encode())]).multinomial(m.sum(), m / m.sum(), resamples)
        return pd.DataFrame({"g": b["g"].to_numpy(), "part": b["part"].to_numpy(), "draws": list(draws.T)})

    def drawn_sums(b: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["k", "v"])
        v, counts = b["v"].to_numpy(float), np.asarray(draws["draws"].iloc[0])
        rng = np.random.default_rng([seed, zlib.crc32(repr(b["g"].iloc[0]).encode()), int(b["part"].iloc[0]) + 1])
        sums = np.array([v[rng.integers(0, len(v), c)].sum() if c else 0.0 for c in counts])
        return pd.DataFrame({"g": [b["g"].iloc[0]], "s": [sums], "w": [counts.astype(np.int64)]})

    plans = held.groupBy("g").applyInPandas(shared, f"g {kind}, part int, draws array<bigint>")
    sums = dealt.groupBy("g", "part").cogroup(plans.groupBy("g", "part")).applyInPandas(drawn_sums, f"g {kind}, s array<double>, w array<bigint>")
    turns = sums.select("g", F.posexplode(F.arrays_zip("s", "w")).alias("turn", "x")).groupBy("g", "turn").agg(F.sum("x.s").alias("s"), F.sum("x.w").alias("w"))
    limits = turns.groupBy(F.col("g").alias("h")).agg(F.percentile(F.col("s") / F.col("w"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    both = sizes.join(limits, F.col("g").eqNullSafe(F.col("h")), "left")
    limit = lambda i: F.when(F.col("same"), F.col("mean")).otherwise(F.col("q")[i])
    return both.select(F.col("g").alias(group), "mean", limit(0).alias("low"), limit(1).alias("high"))


def paired_bootstrap(pairs: DataFrame, group: str, a: str, b: str, order: str, **parameters) -> DataFrame:
    """group, diff, low, high of the mean of a - b over pairs that have both."""
    diffs = pairs.select(group, order, (F.col(a) - F.col(b)).alias("diff"))
    return resampled_ci(diffs, group, "diff", order, **parameters).withColumnRenamed("mean", "diff")


def permutation_p(pairs: DataFrame, group: str, diff: str, order: str, permutations: int = 10_000, seed: int = 13) -> DataFrame:
    """group, p of a two-sided sign-flip test of paired differences; signs are drawn as for ``bootstrap_ci``. 1 if all are zero."""
    turns = _summed(pairs, group, diff, order, permutations, lambda k, t: np.where(drawn(k, t, seed) < 0.5, -1.0, 1.0))
    real = pairs.where(F.col(diff).isNotNull()).groupBy(F.col(group).alias("h")).agg(F.avg(diff).alias("mean"), F.count(diff).alias("n"), F.max(F.abs(diff)).alias("most"))
    met = turns.join(F.broadcast(real), F.col("g").eqNullSafe(F.col("h")))
    hit = (F.abs(F.col("s") / F.col("n")) >= F.abs("mean") - 1e-12).cast("long")
    p = F.when(F.first("most") == 0, 1.0).otherwise((F.sum(hit) + 1) / (F.count("*") + 1))
    return met.groupBy(F.col("h").alias(group)).agg(p.alias("p"))


def compared(records: DataFrame, metrics: Sequence[str], baseline: str = "baseline", resamples: int = 2000, permutations: int = 10_000, seed: int = 13) -> DataFrame:
    """records (experiment, item_id, metric, value) -> experiment, metric, diff, low, high, p, p_holm against the baseline, over items both have; Holm over all experiments of a metric."""
    mine = records.where(F.col("metric").isin(*metrics) & F.col("value").isNotNull())
    base = mine.where(F.col("experiment") == baseline).select("item_id", "metric", F.col("value").alias("b"))
    name = F.concat_ws("\u0001", "experiment", "metric")
    pairs = mine.where(F.col("experiment") != baseline).join(base, ["item_id", "metric"]).select(name.alias("g"), "item_id", (F.col("value") - F.col("b")).alias("diff"))
    both = resampled_ci(pairs, "g", "diff", "item_id", resamples, seed=seed).withColumnRenamed("mean", "diff").join(permutation_p(pairs, "g", "diff", "item_id", permutations, seed), "g")
    parts = F.split("g", "\u0001")
    named = both.select(parts[0].alias("experiment"), parts[1].alias("metric"), "diff", "low", "high", "p")
    return holm(named, "metric", order="experiment").withColumnRenamed("adjusted", "p_holm")


def summarised(records: DataFrame, resamples: int = 2000, seed: int = 13) -> DataFrame:
    """records (experiment, item_id, metric, value) -> experiment, metric, n, mean, low, high; items without a metric don't count for it."""
    name = F.concat_ws("\u0001", "experiment", "metric")
    keyed = records.where("value IS NOT NULL").select(name.alias("g"), "item_id", "value")
    n = keyed.groupBy(F.col("g").alias("h")).agg(F.count("*").alias("n"))
    parts = F.split("g", "\u0001")
    return resampled_ci(keyed, "g", "value", "item_id", resamples, seed=seed).join(n, F.col("g") == F.col("h")).select(parts[0].alias("experiment"), parts[1].alias("metric"), "n", "mean", "low", "high")


def latencies(log: DataFrame, group: str, value: str) -> DataFrame:
    """group, p50, p95 (between ranks by proportion), n."""
    found = quantiles(log, group, value, (0.5, 0.95))
    return found.select(group, F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "n")


def gate(summary: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """summary (metric, mean) against thresholds -> metric, value, threshold, passed. A name that ends in _max is an upper bound; a missing value or NaN fails."""
    rows = F.array(*[F.struct(F.lit(m).alias("name"), F.lit(m.removesuffix("_max")).alias("metric"), F.lit(float(t)).alias("threshold"), F.lit(m.endswith("_max")).alias("upper")) for m, t in thresholds.items()])
    asked = summary.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")
    met = F.when(F.col("upper"), F.col("mean") <= F.col("threshold")).otherwise(F.col("mean") >= F.col("threshold")) & ~F.isnan("mean")
    return F.broadcast(asked).join(summary.select("metric", "mean"), "metric", "left").select(F.col("name").alias("metric"), F.col("mean").alias("value"), "threshold", F.coalesce(met, F.lit(False)).alias("passed"))


def calibrated(scored: DataFrame, low: float = 0.30, high: float = 0.60, step: float = 0.02) -> DataFrame:
    """scored (answerable, correct: whether the answer would be right, score) -> threshold, overall, balanced, best: of a sweep of abstention thresholds.

    Under the threshold an answer is not given. overall: share of right outcomes; balanced: mean of the shares of answerable
    and unanswerable questions. Best is the first threshold with the largest (overall, balanced).
    """
    n = round((high - low) / step) + 1
    each = F.explode(F.array(*[F.lit(round(low + i * step, 2)) for i in range(n)]))
    swept = scored.select("answerable", "correct", "score", each.alias("threshold"))
    given = F.col("score") >= F.col("threshold")
    right = F.when(F.col("answerable"), given & F.col("correct")).otherwise(~given).cast("double")
    part = lambda c: F.coalesce(F.avg(F.when(c, right)), F.lit(0.0))
    rates = swept.groupBy("threshold").agg(F.avg(right).alias("overall"), ((part(F.col("answerable")) + part(~F.col("answerable"))) / 2).alias("balanced"))
    best = rates.agg(F.max(F.struct(F.round("overall", 9).alias("o"), F.round("balanced", 9).alias("b"), (-F.col("threshold")).alias("t"))).alias("m"))
    return rates.crossJoin(F.broadcast(best)).select("threshold", "overall", "balanced", (F.col("threshold") == -F.col("m.t")).alias("best"))


def varied(runs: DataFrame) -> DataFrame:
    """runs (temperature, run, item_id, answer, correct, cited) -> temperature, accuracy_mean, accuracy_sd (population), flip_rate, agreement, f1, jaccard.

    flip_rate: share of questions with both outcomes; agreement, f1 and jaccard (of cited sources): means over pairs of runs
    of a question, 1 where it has a single run; both cite nothing: 1.
    """
    acc = runs.groupBy("temperature", "run").agg(F.avg(F.col("correct").cast("double")).alias("a")).groupBy("temperature").agg(F.avg("a").alias("accuracy_mean"), F.stddev_pop("a").alias("accuracy_sd"))
    said = runs.select("temperature", "item_id", F.struct("run", F.col("correct"), _words(T.normalized_answer(F.coalesce("answer", F.lit("")))).alias("words"), F.coalesce("cited", F.array().cast("array<string>")).alias("cited")).alias("r"))
    by = said.groupBy("temperature", "item_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    pairs = F.flatten(F.transform("rs", lambda a: F.transform(F.filter("rs", lambda b: b["run"] > a["run"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    size = lambda a, b: F.size(F.array_union(a["cited"], b["cited"]))
    alike = lambda p: F.when(size(p["a"], p["b"]) == 0, 1.0).otherwise(F.size(F.array_intersect(p["a"]["cited"], p["b"]["cited"])) / size(p["a"], p["b"]))
    mean = lambda f: F.when(F.size("ps") == 0, 1.0).otherwise(F.aggregate(F.transform("ps", f), F.lit(0.0), lambda s, v: s + v) / F.size("ps"))
    each = by.select("temperature", (F.size(F.array_distinct(F.transform("rs", lambda r: r["correct"]))) > 1).cast("double").alias("flip"), pairs.alias("ps"))
    each = each.select("temperature", "flip", mean(lambda p: (p["a"]["words"] == p["b"]["words"]).cast("double")).alias("agree"), mean(lambda p: f1_of(p["a"]["words"], p["b"]["words"])).alias("f1"), mean(alike).alias("jaccard"))
    out = each.groupBy("temperature").agg(F.avg("flip").alias("flip_rate"), F.avg("agree").alias("agreement"), F.avg("f1").alias("f1"), F.avg("jaccard").alias("jaccard"))
    return acc.join(out, "temperature")


def located(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """evidence (query_id, ev, doc_id, text) -> also start, stop, problem. Found exactly, else with any white space for any; problem: unknown document, not found, or more than once (a warning)."""
    from tessella.functions import spans

    @F.pandas_udf("struct<start:int,stop:int>")
    def loose(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        got = [(spans.find_loose(t, p) if t is not None and p is not None else None) or (-1, -1) for t, p in zip(texts, parts)]
        return pd.DataFrame(got, columns=["start", "stop"])

    # only named documents are moved
    docs = documents.select(F.col("doc_id").alias("d"), F.col("text").alias("body")).join(evidence.select(F.col("doc_id").alias("d")).distinct(), "d", "left_semi")
    both = evidence.join(docs, F.col("doc_id") == F.col("d"), "left").withColumn("at", F.instr("body", F.col("text")) - 1)
    # only rows without an exact place go to Python
    both = both.withColumn("loose", loose(F.when(F.col("at") < 0, F.col("body")), F.when(F.col("at") < 0, F.col("text"))))
    start = F.when(F.col("at") >= 0, F.col("at")).otherwise(F.coalesce("loose.start", F.lit(-1)))
    stop = F.when(F.col("at") >= 0, F.col("at") + F.length("text")).otherwise(F.coalesce("loose.stop", F.lit(-1)))
    problem = F.when(F.col("d").isNull(), "unknown document").when(start < 0, "not found").when((F.col("at") >= 0) & T.occurs_twice(F.col("body"), F.col("text")), "more than once")
    return both.select(*evidence.columns, start.alias("start"), stop.alias("stop"), problem.alias("problem"))


#: White space of Unicode.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _run_hashes(texts: list[list[str]], g: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of each run of g words."""
    size = np.array([len(w) for w in texts], np.int64)
    flat = pa.array([x for w in texts for x in w], pa.string()).dictionary_encode()
    number = pd.util.hash_array(np.array(flat.dictionary.to_pylist(), object), categorize=False)[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(texts)), size)
    h = np.full(max(len(number) - g + 1, 0), g, np.uint64)
    for i in range(g):
        h = (h ^ number[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = text[: len(h)] == text[g - 1 :] if len(h) else np.zeros(0, bool)
    return text[: len(h)][whole], h[whole].view(np.int64)


def _asked_runs(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(key, b) -> also g, the number of words in a run, and h, the least hash of a run of the whole words of b."""
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            inner = [_SPACE.split(t)[1:-1] for t in part.column(1).to_pylist()]
            g = np.array([min(len(w), words) for w in inner], np.int32)
            least = np.full(len(inner), np.iinfo(np.int64).max)
            for n in set(g.tolist()) - {0}:
                mine = np.flatnonzero(g == n)
                text, h = _run_hashes([inner[i] for i in mine], n)
                np.minimum.at(least, mine[text], h)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(g), pa.array(least)], names=[part.schema.names[0], "b", "g", "h"])


def _said_runs(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(d, t) -> d and the hash of each different run of words, of these sizes."""
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            said = [_SPACE.split(t) for t in part.column(1).to_pylist()]
            for g in sizes:
                text, h = _run_hashes(said, g)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(h)], names=["d", "h"])


def found_in(passages: DataFrame, docs: DataFrame, key: str = "item_id", text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", words: int = 3) -> DataFrame:
    """key, doc_id, start, length of each passage's first place in each document that holds it word for word.

    The words between a passage's first and last white space are whole words of such a document. Of their runs of ``words`` (or
    of all, if fewer) a passage asks for the one of least hash; documents whose runs meet it are searched. Passages
    without a word inside are compared with every document.
    """
    asked = passages.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.col(text).alias("b"))
    kind = asked.schema[key].dataType.simpleString()
    # one pass over the passages; the runs of a document are hashed in blocks of a few texts
    asked = asked.mapInArrow(lambda batches: _asked_runs(batches, words), f"{key} {kind}, b string, g int, h long")
    rows = asked.where("g > 0").select(key, "b", "h")
    said = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t"))
    sizes = [r.g for r in asked.where("g > 0").select("g").distinct().collect()]  # at most ``words`` of them
    hashed = said.mapInArrow(lambda batches: _said_runs(batches, sizes), f"d {said.schema['d'].dataType.simpleString()}, h long")
    met = hashed.join(rows, "h").select("d", key, "b").distinct().join(said, "d")
    short = asked.where("g = 0").select(key, "b").join(said, F.expr("contains(t, b)"))
    at = F.instr(F.col("t"), F.col("b"))
    both = met.select(key, "d", "b", "t").unionByName(short.select(key, "d", "b", "t")).where(at > 0)
    return both.select(key, F.col("d").alias(doc_id), (at - 1).cast("long").alias("start"), F.length("b").cast("long").alias("length"))


def found_loosely(passages: DataFrame, docs: DataFrame, key: str = "item_id", text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", words: int = 3) -> DataFrame:
    """key, doc_id, start, length of each passage's first place in each document, any run of white space being as good as another.

    Both are searched with white space folded (``found_in``); a place there is a word's number and a place in the word, which stands in the text itself
    where the white space before that word ends. Passages without a word are found nowhere. doc_ids are to be different."""
    folded = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    flat = passages.select(key, folded(F.col(text)).alias("b"))
    said = docs.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t"))
    found = found_in(flat, said.select("d", folded(F.col("t")).alias("f")), key, "b", "d", "f", words).join(said, "d").withColumn("f", folded(F.col("t")))
    lead = F.col("t").rlike(r"(?U)\A\s").cast("int")

    def place(at: Column) -> Column:
        """In the text, of the character at a place (from 0) of the folded one."""
        before = F.substr(F.col("f"), F.lit(1), at.cast("int"))
        number = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
        # what is left of the text from that word on
        rest = F.element_at(F.split(F.col("t"), r"(?U)\s+", (number + lead + 1).cast("int")), -1)
        return F.length("t") - F.length(rest) + F.length(F.substring_index(before, " ", -1))

    start = place(F.col("start"))
    stop = place(F.col("start") + F.col("length") - 1) + 1
    return found.select(key, F.col("d").alias(doc_id), start.cast("long").alias("start"), (stop - start).cast("long").alias("length"))


def rolling_percentile(log: DataFrame, value: str, order: list[str], last: int, p: float) -> DataFrame:
    """One row: nearest-rank percentile (half-even index) of the last rows in order."""
    recent = log.orderBy(*[F.desc(c) for c in order]).limit(last)
    ranked = recent.agg(F.array_sort(F.collect_list(value)).alias("v"))
    return ranked.select(F.element_at("v", F.bround(F.lit(p) * (F.size("v") - 1)).cast("int") + 1).alias("value"))
