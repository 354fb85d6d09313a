"""Metrics and statistics against plain computations."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import analysis
from tessella.operators import evaluation as E


def norm(text):
    import re
    import string

    text = re.sub(r"(?<=\d)[.,](?=\d)", "", analysis.fold(text))
    text = "".join(" " if c in string.punctuation else c for c in text)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", text).split())


def f1(p, g):
    p, g = norm(p).split(), norm(g.replace("&&", " ")).split()
    same = sum((Counter(p) & Counter(g)).values())
    return float(p == g) if not p or not g else 2 * same / (len(p) + len(g))


def holds(text, golds):
    return any(all(norm(x) and f" {norm(x)} " in f" {norm(text)} " for x in g.split("&&")) for g in golds)


def test_answer_metrics(spark):
    rng = random.Random(2)
    bits = ["The", "red", "fox", "1,200", "km", "a", "jumps", "over", "2.5", "é", "fox-like", "."]
    say = lambda n: " ".join(rng.choices(bits, k=n))
    rows = []
    for i in range(200):
        answer = say(rng.randint(0, 8)) + rng.choice(["", " [S1]."])
        golds = [rng.choice([say(2), f"{say(1)} && {say(1)}", say(1), "", answer.replace(" [S1].", "")]) for _ in range(rng.randint(0, 3))]
        rows.append((i, rng.random() < 0.8, golds, answer, rng.random() < 0.2, rng.choice([None, "", say(1)])))
    schema = "query_id long, answerable boolean, answers array<string>, answer string, abstained boolean, injected_claim string"
    got = {r.query_id: r for r in E.answer_metrics(spark.createDataFrame(rows, schema)).collect()}
    for i, can, golds, answer, away, claim in rows:
        text = analysis.without_citations(answer)
        r = got[i]
        assert r.injection_followed == (float(holds(text, [claim])) if claim else None)
        if not can:
            assert (r.abstention_correct, r.overall_correct, r.accuracy, r.f1) == (float(away), float(away), None, None)
            continue
        right = float(not away and holds(text, golds))
        assert (r.accuracy, r.overall_correct, r.false_abstention) == (right, right, float(away)), (golds, text)
        assert math.isclose(r.f1, 0.0 if away else max((f1(text, g) for g in golds), default=0.0))
        assert r.exact_match == float(not away and any(norm(text) == norm(g.replace("&&", " ")) for g in golds))
    df = spark.createDataFrame([("a fox, jumps", ["fox && jumps"]), ("a fox", ["fox && jumps"]), ("x", [])], "t string, g array<string>")
    assert [r[0] for r in df.select(E.contains_answer(F.col("t"), F.col("g"))).collect()] == [True, False, False]


def test_retrieval_and_citation_metrics(spark):
    rng = random.Random(3)
    evidence, chunks, cited, said = [], [], [], []
    for q in range(40):
        anyone = rng.random() < 0.3
        for e in range(rng.randint(1, 3)):
            start = rng.choice([-1, rng.randint(0, 80)])
            evidence.append((q, e, f"d{rng.randint(0, 1)}", start, start + rng.randint(0, 20), anyone))
        for rank in range(1, 13):
            start = rng.randint(0, 90)
            chunks.append((q, rank, f"d{rng.randint(0, 1)}", start, start + rng.randint(1, 40)))
            if rng.random() < 0.2 and q % 4:
                cited.append(chunks[-1])
        said.append((q, q % 7 == 0))
    ev = spark.createDataFrame(evidence, "query_id long, ev int, doc_id string, start int, stop int, evidence_any boolean")
    schema = "query_id long, rank int, doc_id string, start int, stop int"
    ch, ci = spark.createDataFrame(chunks, schema), spark.createDataFrame(cited, schema)
    covers = lambda c, e: c[2] == e[2] and e[3] >= 0 and min(c[4], e[4]) - max(c[3], e[3]) >= 0.5 * max(1, e[4] - e[3])
    got = {r.query_id: r for r in E.retrieval_metrics(ev, E.covered(ev, ch), (1, 5, 10)).collect()}
    quoted = {r.query_id: r for r in E.citation_metrics(ev, ci, spark.createDataFrame(said, "query_id long, abstained boolean")).collect()}
    for q in range(40):
        es, cs = [e for e in evidence if e[0] == q], [c for c in chunks if c[0] == q]
        sets = [{0 if e[5] else e[1] for e in es if covers(c, e)} for c in cs]
        n, r = 1 if es[0][5] else len(es), got[q]
        assert math.isclose(r.mrr, next((1 / i for i, s in enumerate(sets, 1) if s), 0.0))
        for k in (1, 5, 10):
            seen, dcg = set(), 0.0
            for i, s in enumerate(sets[:k], 1):
                dcg += len(s - seen) / math.log2(i + 1)
                seen |= s
            ideal = sum(1 / math.log2(i + 1) for i in range(1, min(k, n) + 1))
            assert (r[f"hit@{k}"], r[f"recall@{k}"]) == (float(bool(seen)), len(seen) / n) and math.isclose(r[f"ndcg@{k}"], min(1.0, dcg / ideal))
        if q % 7 == 0:
            assert q not in quoted
            continue
        mine = [c for c in cited if c[0] == q]
        found = sum(any(covers(c, e) for c in mine) for e in es)
        want = (sum(any(covers(c, e) for e in es) for c in mine) / len(mine), float(found > 0) if es[0][5] else found / len(es)) if mine else (0.0, 0.0)
        assert (quoted[q].citation_precision, quoted[q].citation_recall) == want


def test_bootstrap_and_permutation_against_plain_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(v)) for g, n in (("a", 60), ("b", 3)) for i, v in enumerate(rng.normal(0.3, 1, n))] + [("c", 0, 2.0), ("z", 1, 0.0), ("z", 2, 0.0), ("a", 99, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    keys = {(r.g, r.i): r.k for r in df.select("g", "i", F.xxhash64("i").alias("k")).collect()}
    got = {r.g: r for r in E.bootstrap_ci(df, "g", "v", "i", 300, seed=5).collect()}
    p = {r.g: r.p for r in E.permutation_p(df, "g", "v", "i", 300, seed=5).collect()}
    for g in "ab":
        mine = [(keys[g, i], v) for h, i, v in rows if h == g and v is not None]
        k, x = np.array([a for a, _ in mine]), np.array([v for _, v in mine])
        even = E.drawn(k, np.arange(300), 5)
        w = np.searchsorted(E._POISSON, even)
        some = w.sum(0) > 0
        means = (x @ w)[some] / w.sum(0)[some]
        assert np.allclose([got[g]["mean"], got[g].low, got[g].high], [x.mean(), *np.quantile(means, [0.025, 0.975])])
        flipped = np.abs((np.where(even < 0.5, -1.0, 1.0) * x[:, None]).mean(0))
        assert math.isclose(p[g], ((flipped >= abs(x.mean()) - 1e-12).sum() + 1) / 301)
    assert (got["c"].low, got["c"].high) == (2.0, 2.0) and p["z"] == 1.0
    even = E.drawn(np.arange(2000), np.arange(50), 1)
    assert abs(even.mean() - 0.5) < 0.01 and abs(np.searchsorted(E._POISSON, even).mean() - 1) < 0.02
    a = np.array([v for g, _, v in rows if g == "a" and v is not None])
    assert abs(got["a"].low - (a.mean() - 1.96 * a.std() / math.sqrt(60))) < 0.12


def test_comparison_gate_sweep(spark):
    records = [(e, i, "mrr", float(i % 3 == 0) + (0.2 if e == "x" else 0.0)) for e in ("baseline", "x", "y") for i in range(30)] + [("x", 99, "mrr", 5.0)]
    out = {r.experiment: r for r in E.compared(spark.createDataFrame(records, "experiment string, item_id int, metric string, value double"), ["mrr"], resamples=200, permutations=200).collect()}
    assert set(out) == {"x", "y"} and math.isclose(out["x"]["diff"], 0.2) and out["x"].p_holm < 0.02 and out["y"].p == 1.0
    summary = spark.createDataFrame([("mrr", 0.9), ("bad", float("nan")), ("inj", 0.1)], "metric string, mean double")
    assert {r.metric: r.passed for r in E.gate(summary, {"mrr": 0.9, "bad": 0.0, "inj_max": 0.0, "none": 0.0}).collect()} == {"mrr": True, "bad": False, "inj_max": False, "none": False}
    scored = spark.createDataFrame([(True, True, 0.5), (True, False, 0.41), (False, False, 0.39), (True, True, 0.33)], "answerable boolean, correct boolean, score double")
    best = [r for r in E.calibrated(scored).collect() if r.best]
    assert len(best) == 1 and best[0].threshold == 0.40 and math.isclose(best[0].overall, 0.5)


def test_variability(spark):
    rng = random.Random(4)
    rows = [(t, run, q, f"the answer {rng.randint(0, 2)}", rng.random() < 0.5, rng.choice([None, ["a"], ["a", "b"]])) for t in (0.0, 1.0) for run in range(3) for q in range(12)] + [(2.0, 0, 0, None, True, None)]
    got = {r.temperature: r for r in E.varied(spark.createDataFrame(rows, "temperature double, run int, item_id int, answer string, correct boolean, cited array<string>")).collect()}
    for t in (0.0, 1.0):
        agree, jac, flips = [], [], []
        for q in range(12):
            mine = [r for r in rows if r[0] == t and r[2] == q]
            pairs = [(a, b) for i, a in enumerate(mine) for b in mine[i + 1 :]]
            agree.append(np.mean([a[3] == b[3] for a, b in pairs]))
            sets = [(set(a[5] or []), set(b[5] or [])) for a, b in pairs]
            jac.append(np.mean([len(x & y) / len(x | y) if x | y else 1.0 for x, y in sets]))
            flips.append(len({r[4] for r in mine}) > 1)
        acc = [np.mean([r[4] for r in rows if r[0] == t and r[1] == run]) for run in range(3)]
        assert np.allclose([got[t].agreement, got[t].jaccard, got[t].flip_rate, got[t].accuracy_mean, got[t].accuracy_sd], [np.mean(agree), np.mean(jac), np.mean(flips), np.mean(acc), np.std(acc)])
    assert (got[2.0].agreement, got[2.0].jaccard, got[2.0].flip_rate) == (1.0, 1.0, 0.0)


def test_evidence_places(spark):
    docs = spark.createDataFrame([("d", "One  two\nthree. One more."), ("e", "aXa")], "doc_id string, text string")
    ev = spark.createDataFrame([(1, 0, "d", "One more"), (1, 1, "d", "two three"), (2, 0, "e", "a"), (2, 1, "e", "zz"), (3, 0, "f", "a")], "query_id int, ev int, doc_id string, text string")
    got = {(r.query_id, r.ev): (r.start, r.stop, r.problem) for r in E.located(ev, docs).collect()}
    assert got == {(1, 0): (16, 24, None), (1, 1): (5, 14, None), (2, 0): (0, 1, "more than once"), (2, 1): (-1, -1, "not found"), (3, 0): (-1, -1, "unknown document")}


@pytest.mark.parametrize("words", [1, 3])
def test_passages_are_found(spark, words):
    rng = random.Random(6)
    vocab = ["ab", "b", "abc", "é", "x.", "y"]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choices(vocab, k=rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    parts = [t[rng.randint(0, 9) : rng.randint(10, 40)] for t in texts[:50] if t] + ["b", "b x", "zz zz zz zz", "", None, " "]
    got = {(r.item_id, r.doc_id): (r.start, r.length) for r in E.found_in(spark.createDataFrame(list(enumerate(parts)), "item_id int, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), words=words).collect()}
    assert got == {(i, j): (t.find(p), len(p)) for i, p in enumerate(parts) if p for j, t in enumerate(texts) if t and p in t}


def test_a_gold_set_is_made_once(spark):
    from tessella import experiments

    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(i):
        made.add(1)
        return i

    rows = [(i, ["x"] if i % 2 else [], [("d", "One")] if i % 3 else [], i % 4 > 0) for i in range(20)]
    gold = spark.createDataFrame(rows, "i int, answers array<string>, evidence array<struct<doc:string,text:string>>, answerable boolean").select(counted("i").alias("query_id"), "answers", "evidence", "answerable", F.lit(False).alias("evidence_any"))
    got = experiments.validated(gold, spark.createDataFrame([("d", "One. One."), ("e", "One")], "doc_id string, text string")).groupBy("problem").count().collect()
    assert {r.problem: r["count"] for r in got} == {"evidence in d: more than once": 13, "answerable without evidence": 5, "answerable without accepted answers": 5, "unanswerable with evidence": 3}
    assert made.value == 20
