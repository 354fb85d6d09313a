"""Sketches against plain ones, and their estimates against exact containment."""

import hashlib
import random
import re

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessella.llm import fingerprints

SCHEMA = "doc_id long, text string, hash string, own int, next_hash string, did string"


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def plain(text):
    return {h for h in shingles(text) if h < -(1 << 63) + (1 << 62)}


def like(a, b):
    if (a or "") == (b or ""):
        return 1.0
    x, y = plain(a), plain(b)
    least = min(len(x), len(y))
    return len(x & y) / least if least else 0.0


def hashed(text):
    h = xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def wanted(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, near_edited, near_next) of rows (doc_id, text), sorted."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1])))
    out = []
    for k, (d, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        kept = sorted(plain(t))
        mark = f"{hashed(t) % (1 << 64):016X}:1/4:{len(kept)}:" + "".join(f"{h % (1 << 64):016X}" for h in kept)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), mark, like(t, edited), like(t, n)))
    return sorted(out, key=str)


def found(df):
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in df.collect()], key=str)


def test_near_columns_match_plain_sketches(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefghé", k=4)) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 4, 5, 30, 60, 140, 300, 700, 2500]))) for _ in range(50)]
    texts += [texts[5], f"{texts[7]} {texts[8]}", texts[9][: len(texts[9]) // 2], None, "   ", "x" * 200_000, "w " * 60_000]
    rows = [(i * 2, t, "h", 1, "n", "d") for i, t in enumerate(texts)]
    rows += [(4, texts[2], "h", 1, "n", "d"), (4, texts[2], "h", 1, "n", "d"), (4, "another text of doc four", "h", 1, "n", "d")]
    rows += [(d, "a b c d e f", None, None, None, None) for d in (None, None, -(1 << 63), (1 << 63) - 1)] + [(None, f"of no id {i % 7}", None, None, None, None) for i in range(20)]
    assert found(fingerprints.fingerprinted(spark.createDataFrame(rows, SCHEMA))) == wanted([r[:2] for r in rows])


def test_lone_and_all_equal_rows(spark):
    for rows in ([(1, "a lone text of a few words")], [(None, None)] * 3, []):
        assert found(fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"))) == wanted(rows)


def test_many_rows_of_no_id(spark):
    """A hundred thousand rows of no doc_id, a third of them equal: as many results, and no task pairs them."""
    n = 100_000
    same = F.lit("the same words in each of a third of all rows")
    rows = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, same).otherwise(F.concat(F.lit("row "), F.col("id"), F.lit(" has words of its own"))).alias("text"))
    got = fingerprints.fingerprinted(rows)
    by = {r.fingerprint: r.n for r in got.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").collect()}
    assert list(by.values()) == [(n + 2) // 3] and got.count() == n


def test_estimates_are_near_exact_containment(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    rows, exact = [], []
    for i in range(60):
        a = rng.choices(vocab, k=rng.choice([60, 200, 800]))
        cut = rng.randint(0, len(a))
        b = a[:cut] + rng.choices(vocab, k=len(a) - cut) + rng.choices(vocab, k=rng.choice([0, 2000]))
        rows.append((i, " ".join(a), " ".join(b)))
        x, y = shingles(rows[-1][1]), shingles(rows[-1][2])
        exact.append(len(x & y) / min(len(x), len(y)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = [r.c for r in df.select("i", fingerprints.containment(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("c")).orderBy("i").collect()]
    errors = [abs(x - y) for x, y in zip(got, exact)]
    assert sum(errors) / len(errors) < 0.08 and max(errors) < 0.5
    m = df.select(fingerprints.merged(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("m"), "a", "b").collect()
    for r in m:
        assert set(r.m) == plain(r.a) | plain(r.b)
