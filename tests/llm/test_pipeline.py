"""The five stages and the whole run against plain computations; names that clash, repeated rows and null ids."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import mixing, near, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = SCHEMA + ", k_id string, m_id long, m_words string, row string, size string, taken int, copy string, take string, range string, key string, r_id string, hash string, fp string, cls string, n string"


def clashing(rows):
    return [(*r, "k", 1, "v", "row", "s", 2, "c", "t", "rg", "key", "r", "h", "f", "cl", "n") for r in rows]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(150):
        words = rng.choices(vocab, k=rng.randint(5, 90))
        rows.append((i, " ".join(words) + f" on 2024-01-{1 + i % 28:02d}.", "en", f"s{i % 4}" if i % 9 else None))
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(10)]
    rows += [(300, rows[3][1], "en", "s1"), (300, "quite another text of its own", "en", "s2"), (301, None, None, None), (302, "", "en", "s0"), (None, rows[5][1], "en", "s0")]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


def test_mixing_keeps_rows_whole(spark, corpus):
    rows = corpus + [corpus[0]] * 3  # repeated rows, alike in all
    docs = spark.createDataFrame(clashing(rows), CLASH)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert all((r.k_id, r.m_id, r.m_words, r.row, r.taken, r.key) == ("k", 1, "v", "row", 2, "key") and r.n_chars == len(r.text) for r in got)
    taken: dict = {}
    for r in mixing.mix(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    words: dict = {}
    for r in got:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert words == {s: n for s, n in taken.items() if n}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("one_of_each", [simhash.one_of_each, near.one_of_each])
def test_one_of_each_loses_no_text(spark, corpus, one_of_each):
    docs = spark.createDataFrame(clashing(corpus), CLASH)
    got = one_of_each(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    texts = [r.text for r in rows if r.doc_id is not None and r.text]
    assert len(texts) == len(set(texts)) and set(texts) == {t for _, t, *_ in corpus if t}
    assert sorted(r.doc_id for r in rows if r.doc_id == 300) == [300] and sum(r.doc_id is None for r in rows) == 1
    assert sum(not r.text for r in rows) == 1  # texts without words are one group


def test_the_run_packs_what_the_stages_leave(spark, corpus, tmp_path):
    rows = corpus + [(400 + i, f"{corpus[i][1]} you idiot. {corpus[i + 20][1]} what an idiot", "en", "s0", 1) for i in range(40)]
    labels = [(d, 1, int("idiot" in (t or ""))) for d, t, *_ in rows if d is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(sorted(set(labels)), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("tessella.pii.secret", "k")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near", "pii", "mixing", "packing"]
    docs, kept = read("documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == before.columns
            docs.write.parquet(f"{tmp_path}/{name}.parquet")
            docs = read(name)
            kept[name] = docs.collect()
    model = toxicity.train(read("documents"), read("labels"))
    assert {r.doc_id for r in kept["toxicity"]} == {d for d, t, *_ in rows if model.score(t)[0] < 0.7} == {d for d, t, *_ in rows if "idiot" not in (t or "")}
    assert {r.text for r in kept["near"] if r.text} == {t for _, t, *_ in corpus if t}
    for r in kept["pii"]:
        assert "2024-01-" not in (r.text or "") or r.text in {t for _, t, *_ in corpus}
    enc = tokens.encoder(tokens.vocabulary()).tokenizer
    ids = lambda t: np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = sorted((r.doc_id or -1, len(ids(r.text)), zlib.crc32(ids(r.text).tobytes())) for r in kept["mixing"])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = sorted((r.doc_id or -1, r.doc_tokens) for r in pieces if r.start == 0)
    assert whole == [w[:2] for w in want] and sum(r.length for r in pieces) == sum(w[1] for w in want)
    assert {(r.doc_id or -1, r.doc_tokens, r.ids_crc32) for r in pieces if r.length == r.doc_tokens} <= set(want)


def test_the_near_stage_links_by_fingerprints_too(spark):
    """Texts of one fingerprint whose shingle sets are little alike are one; so is what either kind of link joins to them."""
    rng = random.Random(3)
    tail = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12))
    line = "one two three four five six seven " * 400
    a, b = line + tail(), line + tail()
    c = f"{b} more"  # nearly all shingles of b, and its fingerprint
    rows = [(1, a), (2, b), (3, c), (4, tail()), (5, None), (None, a)]
    docs = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA)
    assert {r.doc_id for r in near.one_of_each(docs).collect()} == {1, 2, 4, 5, None}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()} == {1, 4, 5, None}


def test_components_of_both_kinds_are_united(spark):
    kind = "doc_id long, hash long, component_id long, component_hash long"
    one = spark.createDataFrame([(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 3, 3), (4, 4, 4, 4), (None, 9, None, None)], kind)
    other = spark.createDataFrame([(1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 2, 2), (4, 4, 4, 4), (None, 9, None, None)], kind)
    from tessella.llm.components import united

    assert {r.doc_id: r.component_id for r in united(one, other).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, None: None}
