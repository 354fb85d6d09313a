"""Periodic runs against a plain search by definition."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import queries, runs


def plain_runs(words, least=24, times=3):
    """All (start, length, period) by definition: longest stretches of agreement for each period, the least period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((i, e - i, q) for (i, e), q in found.items())


def plain_collapsed(words, found):
    out = set()
    for start, length, period in found:
        out |= set(range(start + period, start + length))
    return [w for i, w in enumerate(words) if i not in out]


def made(rng, n):
    """Words with repetitions in repetitions, some broken."""
    words = []
    while len(words) < n:
        unit = [rng.choice("abcdé") * rng.randint(1, 2) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13]))]
        if rng.random() < 0.4:
            unit = unit * rng.randint(2, 5) + [rng.choice("xyz")]
        words += unit * rng.choice([1, 1, 2, 4, 9, 30])
        if rng.random() < 0.3:
            words += [str(rng.random())]
    return words[:n]


def test_runs_by_definition(spark):
    rng = random.Random(3)
    texts = [" ".join(made(rng, rng.choice([0, 1, 5, 24, 60, 200, 500]))) for _ in range(120)]
    texts += ["a " * 24, "a " * 23, "a\tb\r\n" * 12, "a b c d e f g h " * 3, "a b c d e f g h " * 2 + "a b c d e f g", "  　 " * 30, "", "  ", None, texts[3], texts[3]]
    docs = spark.createDataFrame([(i if i % 7 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, runs int, collapsed string")
    got = runs.collapsed(docs).collect()
    assert len(got) == len(texts)
    some = 0
    for row, text in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.collapsed)), sorted(enumerate(texts), key=lambda x: (x[0] % 7 == 0, x[0] if x[0] % 7 else 0, " ".join(plain_collapsed(w := re.findall(r"[^ \t-\r]+", x[1] or ""), plain_runs(w)))))):
        words = re.findall(r"[^ \t-\r]+", text[1] or "")
        want = plain_runs(words)
        some += len(want)
        assert [tuple(r) for r in row.runs] == want
        assert row.collapsed == " ".join(plain_collapsed(words, want))
    assert some > 100


def test_other_bounds():
    rng = random.Random(5)
    for least, times in ((2, 2), (4, 2), (7, 4), (10, 3), (33, 5)):
        texts = [" ".join(made(rng, 150)) for _ in range(25)]
        found, _ = runs._one_batch(texts, least, times)
        assert found == [plain_runs(t.split(), least, times) for t in texts]


def test_long_texts_take_little_time():
    words = ["w"] * 200_000 + [str(i) for i in range(50_000)] + ["a", "b"] * 50_000 + ["a b c d e f g".split()[i % 7] for i in range(100_000)]
    (found,), (text,) = runs._one_batch([" ".join(words)], 24, 3)
    assert found == [(0, 200_000, 1), (250_000, 100_002, 2), (350_000, 100_000, 7)]
    assert len(text.split()) == 1 + 50_000 + 2 + 5


def test_suffix_array_and_splits():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60):
        s = np.append(rng.integers(0, 3, n), 9)
        order, rank, lcp = runs.suffix_array(s)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        assert (rank[order] == np.arange(n + 1)).all()
        for k in range(1, n + 1):
            a, b = s[order[k - 1] :].tolist(), s[order[k] :].tolist()
            assert lcp[k] == next(i for i in range(n + 1) if i >= min(len(a), len(b)) or a[i] != b[i])


def planted(doc_id, text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_report(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(made(rng, rng.choice([0, 3, 40, 300]))) if i % 3 else " ".join(str(rng.random()) for _ in range(rng.choice([1, 30, 90])))) for i in range(-20, 200)]
    rows += [(None, "a b " * 20), (7, None), (7, "same"), (7, "same"), (10**12, "")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want, moved = [], 0
    for doc_id, text in rows:
        words = planted(doc_id, text)
        moved += words != re.findall(r"[^ \t-\r]+", text or "")
        found = plain_runs(words)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        want.append((doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(plain_collapsed(words, found)))))
    assert got == sorted(want, key=str)
    assert moved > 10


def test_empty_table(spark):
    assert runs.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
