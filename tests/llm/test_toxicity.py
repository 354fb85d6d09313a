"""The toxicity model against a plain noisy-or, and its words against planted ones."""

import math
import random
import re

from tessella.llm import toxicity

SCHEMA = "doc_id long, text string, k long, toxic string"


def plain(model, text):
    """Noisy-or by the definition: each sentence's features, each weight once."""
    calm = 1 - model.leak
    for s in re.split(r"[.!?\n]+", text.lower()):
        words = re.findall(r"[^\W\d_]+", s)
        has = {f for f in model.words if any(w == f or (f.endswith("*") and len(w) > len(f) - 1 and w.startswith(f[:-1])) for w in words)}
        if has:
            calm *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.words[f] for f in has))))
    return 1 - calm


def test_score_is_the_noisy_or_of_sentences():
    rng = random.Random(3)
    model = toxicity.Model({"idiot": 6.0, "scum": 3.5, "calm": -2.0, "réeu*": 5.0, "abc*": 1.0}, -4.5, 0.03)
    vocab = ["idiot", "Scum", "calm", "réeuxaux", "réeu", "abcd", "abc", "house", "idiots", "ÉTÉ", "İx", "7"]
    for _ in range(300):
        text = "".join(rng.choice(vocab) + rng.choice([" ", ". ", "\n", "!?", ", "]) for _ in range(rng.randint(0, 25)))
        score, known = model.score(text)
        assert abs(score - plain(model, text)) < 1e-9
        assert all(0 <= a < b <= len(text) for a, b, _ in known)


def test_company_is_not_taken_for_a_telling_word(spark):
    rng = random.Random(8)
    calm = ["house", "river", "green", "walk", "paper", "light", "stone", "cloud"]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        sentences = [" ".join(rng.choices(calm, k=7)) for _ in range(6)]
        if bad:
            sentences[rng.randrange(6)] += rng.choice([" idiot", " scum", f" zorb{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}"])
            sentences.append(rng.choice(["somewhere", "today", "house"]) + " fellow")
        elif rng.random() < 0.08:
            sentences.append("a fellow came")
        text = ". ".join(sentences)
        rows += [(i, text, i, "x")] * (3 if i < 60 else 1)
        labels.append((i, int(bad or rng.random() < 0.03), 1))
    rows += [(None, "idiot", 1, None), (9001, None, 1, None), (9002, "", 1, None), (9003, "walk paper " * 50_000 + "idiot", 1, None)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, marks)
    assert {"idiot", "scum"} <= set(model.words) and any(w.startswith("zorb") for w in model.words) and model.words.get("fellow", 0) < 2
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].score > 0.7 > by[9001].score == by[9002].score and by[9003].score > 0.7 and by[9003].n_offending == 1
    kept = toxicity.clean(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.7}
