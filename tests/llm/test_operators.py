"""The corpus operators against brute force, with nulls, empties, long texts, ties, repeats and clashing extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import components, fingerprints, mixing, packing, pii, simhash, token_store, tokens, toxicity

KEY = "a key for tests"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, did string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(60)]
    shared = " ".join(rng.choices(vocab, k=60))
    texts += [shared, f"{texts[0]} {shared}", f"{shared} {texts[1]}\n{shared}", texts[2], texts[2], "", "   ", "é" * 70, "a" * 5000]
    rows = [(3 * i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)] + [(999, None, "s1"), (None, texts[3], "s2")]
    rng.shuffle(rows)
    return docs_of(spark, rows), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("crowd", [64, 0])
def test_simhash_components(corpus, empty, crowd):
    docs, rows = corpus
    got = simhash.linked(docs, crowd=crowd).collect()
    assert len(got) == len(rows)
    fps = sorted({int(r.fingerprint, 16) for r in got})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for r in got:
        if r.doc_id is not None:
            least[find(int(r.fingerprint, 16))] = min(r.doc_id, least.get(find(int(r.fingerprint, 16)), r.doc_id))
    assert all(r.component_id == least.get(find(int(r.fingerprint, 16))) for r in got)
    assert simhash.linked(empty).count() == 0


def test_simhash_joins_all_within_two_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(30)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for crowd in (64, 0):
        node = {r.node: r.root for r in components.components(simhash.pairs(df, 2, crowd)).collect()}
        for a in fps:
            for b in fps:
                if a != b and (a ^ b).bit_count() <= 2:
                    x, y = (f - (1 << 64) if f >> 63 else f for f in (a, b))
                    assert node[x] == node[y]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


def test_encoder_and_token_files(spark, corpus, empty):
    docs, rows = corpus
    enc = tokens.encoder(tokens.vocabulary())
    odd = ["", " a b", "a  b", "a \n b", "x<|endoftext|>y", "it's  \n\n ok ", "don't can't' 12 3a,b", "x. y.. z.a", "é. ñ, ünï!"]
    assert [e.tolist() for e in enc.encode(odd)] == [e.ids for e in enc.tokenizer.encode_batch(odd, add_special_tokens=False)]
    for kind in ("byte", "bit"):
        ids = np.arange(70_001, dtype=np.uint32) * 7
        assert (token_store.decode_ids(*token_store.encode_ids(ids, 1000, kind)) == ids).all()
        got = token_store.token_output(docs, kind=kind, group_ids=500).orderBy("start").collect()
        start = 0
        for r, (i, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0]))):
            want = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(want), zlib.crc32(want.tobytes()))
            start += len(want)
    assert token_store.token_output(empty).count() == 0


def test_token_files_of_repeated_and_very_long_rows(spark):
    enc = tokens.encoder(tokens.vocabulary()).tokenizer
    rng = random.Random(9)
    long = " ".join(rng.choices(["words", "of", "a", "long", "text", "é", "12"], k=60_000))
    rows = [(None, f"of no id {i}") for i in range(300)] + [(5, "one text")] * 40 + [(5, long), (7, long), (6, None), (-(1 << 63), "least"), (5, "one text more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_store.token_output(docs, group_ids=5_000, block=1_000).orderBy("start").collect()
    want = [(i, (w := np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4")).size, zlib.crc32(w.tobytes())) for i, t in rows]
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0)) and len({r.shard for r in got if r.doc_id is None}) > 1
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_packing_places_each_id_once(corpus, empty):
    docs, rows = corpus
    enc = tokens.encoder(tokens.vocabulary()).tokenizer
    want = {i: np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, _ in rows}
    got = packing.pack(docs, window=256).collect()
    place, filled = {}, {}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert (len(ids), zlib.crc32(ids.tobytes()), r.doc_tokens) == (r.length, r.ids_crc32, len(want[r.doc_id]))
        place.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in place.items():
        assert sum(n for _, n in pieces) == len(want[i]) and len({s for s, _ in pieces}) == len(pieces)
    for pieces in filled.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 256 or at.bit_count() == 1
    assert set(place) == set(want) and packing.pack(empty).count() == 0


def test_packing_draws_lexical_neighbours():
    near, far = [np.full(50, w, np.uint32) + np.arange(50, dtype=np.uint32) for w in (1000, 5000)]
    got = list(packing.pack_shard([near, far, far + 1, near[::-1].copy()], window=100))
    assert {(d, q) for d, _, _, q, _ in got} == {(0, 0), (3, 0), (1, 1), (2, 1)}


def test_mix_takes_its_budgets(corpus, empty):
    docs, rows = corpus
    got = mixing.mix(docs).collect()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert v[0].target <= 2 * v[0].source_size and sum(r.taken for r in v) == round(v[0].target)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert abs(sum(len((r.text or "").split()) for r in out.collect()) - sum(r.taken for r in got)) <= len(got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_pseudonyms(spark, empty):
    text = "4111 1111 1111 1111, 4111-1111-1111-1112; 2024-02-29 2023-02-29 31/12/1999 123-45-6789 GB82 WEST 1234 5698 7654 32 256.1.1.1 10.0.0.1 me.u@x1.org +1 (988) 555-2485"
    df = docs_of(spark, [(1, text, "s"), (2, f"again 10.0.0.1 {text[:19]}", "s"), (3, None, "s"), (4, "", "s")])
    a, b, c, d = pii.report(df, KEY).orderBy("doc_id").collect()
    assert (a.n_card, a.n_date, a.n_ssn, a.n_iban, a.n_ip, a.n_email, a.n_phone) == (1, 2, 1, 1, 1, 1, 1)
    assert "4111-1111-1111-1112" in a.text and "2023-02-29" in a.text and "256.1.1.1" in a.text and "10.0.0.1" not in a.text and len(a.text) >= len(text) - 6
    assert a.text[:19] == b.text[-19:] and a.text[:19] != text[:19]
    digits = [int(x) for x in a.text[:19] if x != " "][::-1]
    assert sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits)) % 10 == 0
    assert c.text is None and d.text == "" and pii.pseudonymised(df, KEY).columns == df.columns and pii.report(empty, KEY).count() == 0


def test_feistel_permutes(spark):
    df = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("s"), "id")
    out = df.select(pii.feistel(F.col("s"), F.lit("k")).alias("p"), pii.feistel_number(F.col("id"), 100, 100, F.lit("k")).alias("n"))
    assert out.select("p").distinct().count() == 10_000 and out.select("n").distinct().count() == 10_000


def test_fingerprints(spark, corpus, empty):
    docs, rows = corpus
    got = {r.doc_id: r for r in fingerprints.fingerprinted(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].near_next == 1) >= (t == nxt)
    by_text = {}
    for i, t, _ in rows:
        by_text.setdefault(t or "", set()).add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values()) and fingerprints.fingerprinted(empty).count() == 0


def test_toxicity_finds_sentences(spark, empty):
    rng = random.Random(3)
    calm = ["house", "river", "green", "walk", "paper", "light"]
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        sentences = [" ".join(rng.choices(calm, k=6)) for _ in range(5)]
        if bad:
            sentences[2] += rng.choice([" idiot", " scum"])
        rows.append((i, ". ".join(sentences) + ".", "s"))
        labels.append((i, int(bad)))
    rows += [(9000, None, "s"), (9001, "", "s")]
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(docs, marks).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i, _ in labels)
    assert sum(got[i].predicted == dict(labels)[i] for i in held) >= 0.95 * len(held)
    one = next(i for i, b in labels if b)
    a, b = map(int, got[one].offending.split(":"))
    assert any(w in rows[one][1][a:b] for w in ("idiot", "scum"))
    assert got[9000].predicted == got[9001].predicted == 0
    assert toxicity.judged(empty, marks).count() == 0
    assert toxicity.judged(docs, marks.limit(0)).agg(F.max("score")).first()[0] == 0
