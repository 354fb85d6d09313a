"""Repeated substrings against brute force: segments, frequent grams, periodic texts, null ids, repeated rows."""

import hashlib
import random

import numpy as np
import pytest

from tessella.llm import substrings

SCHEMA = "doc_id long, text string, key string, bytes long, gram string, did string"


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha256) of each different (doc_id, text), in order."""
    seen, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen[w] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i, t] = (len(b), sum(gone), n, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    line, passage = say(30), say(60)
    texts = [say(rng.randint(1, 120)) for _ in range(60)]
    texts += [f"{say(10)} {line}\n{say(12)}" for _ in range(40)]
    texts += [passage, f"{texts[0]} {passage}", f"{passage} {texts[1]}\n{passage}", texts[2], texts[2], "", "   ", "é" * 70, "a" * 900, "ab" * 700, "b" * 99, "c" * 100, "c" * 101, say(900) + line + say(900) + passage]
    base = say(80)
    texts += [base[:k] + "#" + base[k:] for k in range(5, len(base), 23)]
    out = [(3 * i, t) for i, t in enumerate(texts)] + [(999, None), (None, texts[3]), (6, texts[2]), (6, texts[2])]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("parameters", [{}, {"crowd": 3, "batch": 700}, {"crowd": 1, "batch": 3000}])
def test_removed_bytes_match_brute_force(spark, rows, parameters):
    docs = spark.createDataFrame([(i, t, "k", 1, "g", "d") for i, t in rows], SCHEMA).repartition(5)
    want = brute(rows)
    got = substrings.report(docs, **parameters).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(want[i, t or ""])
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in by.items()}
    assert substrings.report(docs.limit(0)).count() == 0


def test_long_text_in_segments(spark):
    rng = random.Random(2)
    a, b = ("".join(rng.choices("abcdefghijklmnop ", k=300_000)) for _ in range(2))
    rows = [(1, a), (2, b[:200_000] + a[90_000:150_000] + b[200_000:])]
    got = {r.doc_id: r for r in substrings.report(spark.createDataFrame(rows, "doc_id long, text string"), batch=40_000).collect()}
    assert got[1].n_removed == 0 and (got[2].n_removed, got[2].n_spans) == (60_000, 1)
    assert got[2].kept_sha256 == hashlib.sha256(b.encode()).hexdigest()


def test_radix_passes_group_equal_windows():
    rng = np.random.default_rng(1)
    for _ in range(20):
        data = rng.integers(97, 99, 900).astype(np.uint8)
        data[300:520] = data[10:230]
        data[600:] = data[600 - 3 : 897] if rng.random() < 0.3 else data[600:]
        windows = rng.permutation(801)[: rng.integers(0, 801)]
        some, first = substrings.radix_groups(substrings.digits(data), windows)
        want, least = {}, {}
        for k, w in enumerate(windows.tolist()):
            key = data[w : w + 100].tobytes()
            least.setdefault(key, k)
            want.setdefault(key, []).append(k)
        expected = {k: least[key] for key, ks in want.items() if len(ks) > 1 for k in ks}
        assert dict(zip(some.tolist(), first.tolist())) == expected


def test_longer_grams_keep_windows_in_two_runs(spark):
    """A crowded gram's runs don't become a row for each window: every turn makes two of one at most, and equal windows meet."""
    rng = random.Random(8)
    say = lambda n: "".join(rng.choices("ab", k=n))
    gram, sides = say(32), [say(68) for _ in range(3)]
    texts = [(i, rng.choice(sides) + gram + rng.choice(sides)) for i in range(40)]
    runs = spark.createDataFrame([(7, i, i, 0, 68, bytearray(t.encode()), None) for i, t in texts], substrings.CONTEXTS).drop("spans")
    before = {(i, k, t[k : k + 100].encode()) for i, t in texts for k in range(69)}
    known = 32
    for turn in range(7):
        most = 2 * runs.count()
        runs, known = substrings.lengthened(runs, known)
        runs = spark.createDataFrame(runs.collect(), runs.schema)
        rows = runs.collect()
        assert len(rows) <= most
        windows = [(r.gram, r.did, r.start + k, bytes(r.bytes[k : k + 100])) for r in rows for k in range(len(r.bytes) - 99)]
        assert len(windows) == len(before) and {w[1:] for w in windows} == before
        # equal windows with the gram at the same place have one key
        assert len({(w[0], w[3]) for w in windows}) == len({w[3] for w in windows})
    assert known == 100 and all(len(r.bytes) == 100 for r in rows)


def test_crowded_lines_in_many_texts(spark):
    rng = random.Random(12)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line, ends = say(70), [say(40) for _ in range(12)]
    rows = [(i, say(90) + rng.choice(ends) + line + rng.choice(ends) + say(90)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    for r in substrings.report(docs, crowd=20, batch=2_000).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, rows[r.doc_id][1]]
