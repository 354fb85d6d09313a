"""Near copies by shingle sets against all pairs."""

import random

import corpus_pipeline
from tessella.llm import near

SCHEMA = "doc_id long, text string, n_chars long"


def like(a, b):
    x, y = set(near.shingles(a).tolist()), set(near.shingles(b).tolist())
    return x == y if not x or not y else 5 * len(x & y) >= 4 * len(x | y)


def kept(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if like(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_one_of_each_component_stays(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    line = rng.choices(vocab, k=30)
    texts = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(3, 150)) + rng.choice([[], line])
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    # a large group whose members are not all alike, and whose chain is one component
    chain = rng.choices(vocab, k=120)
    for i in range(60):
        chain = list(chain)
        chain[(7 * i) % 120] = rng.choice(vocab)
        texts.append(" ".join(chain))
    texts += [texts[0], texts[0].upper(), "", "  ", None, "one two three", "one two three"]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, texts[1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], SCHEMA)
    got = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == kept(rows) and got.where("doc_id IS NULL").count() == 1
    assert near.one_of_each(docs.limit(0)).count() == 0
