"""Secret scans against plain regular expressions and a plain log-likelihood ratio."""

import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from tessella.llm import secrets

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SCHEMA = "doc_id long, text string, base string, hits int"


def base(text):
    """(start, kind, end) by the rules, plainly."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def said(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_of_random_texts(spark):
    rng = random.Random(4)
    bits = ["password", "PassWd", "api_key", "APIkey", "token", "secret", ":", "=", " = ", '"', "'", " ", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "😀", "x", "\n", "abcd.efgh", "-", "AKIAAKIA0000"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(400)] + ["", None, "token=" + "q" * 100_000, "secret=abcdefgh " * 3000]
    rows = secrets.digests(secrets.scan(spark.createDataFrame([(i, t, "b", 1) for i, t in enumerate(texts)], SCHEMA), model=[0.0] * 128 * 128)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3)) and r.spans == said(want)


def test_ratio_and_added_spans(spark):
    rng = random.Random(5)
    model = [rng.uniform(-2, 2) for _ in range(128 * 128)]
    words = ["".join(rng.choices(string.ascii_letters + string.digits + "+/_=-.", k=rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    ratio = lambda w: sum(model[ord(a) * 128 + ord(b)] for a, b in zip(w, w[1:]))
    for w, x in df.select("w", secrets.likelihood_ratio(F.col("w"), secrets._table(model))).collect():
        assert abs(x - ratio(w)) < 1e-5
    texts = [" ".join(rng.choices([*words, "é" + words[0], "password: abcdefghijk"], k=30)) for _ in range(60)]
    found = secrets.digests(secrets.scan(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA), model=model, threshold=6.0)).collect()
    whole = re.compile(r"(?<![^\W_])[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_=-]|\.(?=[A-Za-z0-9+/_=-])){7,}+(?![^\W_])")
    n = 0
    for r in found:
        t, rules = texts[r.doc_id], base(texts[r.doc_id])
        more = [(m.start(), 3, m.end()) for m in whole.finditer(t) if ratio(m[0]) >= 6 and not any(a < m.end() and m.start() < b for a, _, b in rules)]
        n += len(more)
        assert r.spans == said(sorted(rules + more))
    assert n > 50


def test_keys_without_a_rule_are_found(spark):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    vocab = ["".join(rng.choices(["an", "der", "tion", "co", "re", "ment", "is", "el", "o", "pa"], k=rng.randint(2, 6))) for _ in range(400)]
    text = lambda: " ".join(rng.choices([*vocab, "configuration_value", "some_function_name2", "2024-01-05"], k=60))
    rows = [(i, f"{text()} secret={key(30)} {text()}", "", 0) for i in range(150)]
    planted = {1000 + i: key(n) for i, n in enumerate([12, 16, 20, 30, 40] * 4)}
    rows += [(i, f"{text()} {k} {text()}", "", 0) for i, k in planted.items()] + [(1000, rows[0][1], "", 0), (None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = secrets.scan(docs).select("doc_id", F.col("added.value").alias("v")).collect()
    got = {(r.doc_id, v) for r in found for v in r.v}
    assert len(found) == len(rows) and len(got & set(planted.items())) >= 19 and len(got - set(planted.items())) <= 1
    quality = secrets.quality(docs)
    assert quality["precision"] > 0.95 and quality["recall"] > 0.95 and quality["random"] > 50
