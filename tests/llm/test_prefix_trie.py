"""The trie against a plain one of nested prefixes."""

import hashlib
import random
import zlib

import pytest

from tessella.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, d string, c int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    # equal turns are ordered by a digest of what they say
    digest = lambda x: hashlib.md5(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).digest()
    return {c: [x[1:] for x in sorted(v, key=lambda x: (x[0], digest(x)))] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def made(rng, n, words=2):
    rows = []
    for c in rng.sample(range(n * 2), n):
        turns = [(rng.choice(["user", None, "", "système"]), rng.choice(["a", "béé", "", None, "x" * 50][:words])) for _ in range(rng.choice([1, 2, 3, 7, 12]))]
        if rng.random() < 0.3:
            turns = [("system", "hot"), ("user", "again"), ("user", "again")] + turns[: rng.choice([0, 1])]
        rows += [(c, t if rng.random() < 0.9 else None, role, text, "d", 1) for t, (role, text) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("cells,block,most", [(32_000, 16, 4096), (128, 2, 4), (1, 1, 2), (256, 64, 64)])
def test_trie_by_definition(spark, monkeypatch, cells, block, most):
    for name, value in (("CELLS", cells), ("BLOCK", block), ("MOST", most), ("IDS", 3)):
        monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(cells)
    rows = made(rng, 250) + [(None, 0, "user", "lost", "d", 1), (9999, 1, "user", "twice", "d", 1), (9999, 1, "user", "twice", "d", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).select(COLUMNS).collect()), key=str) == plain(conversations(rows))


def test_long_conversations_share_beginnings(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    same = [("user", str(i)) for i in range(120)]
    convs = {1: same, 2: same[:90], 3: same[:119] + [("user", "else")], 4: same, 5: [("x", "y")] * 70, 6: [("x", "y")] * 71}
    rows = [(c, t, role, text, "d", 1) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).select(COLUMNS).collect()), key=str) == plain(conversations(rows))


def test_report_rebuilds(spark, tmp_path):
    rows = made(random.Random(6), 150, 5)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = rebuilt(conversations(rows))
    assert any(not turns for turns in want.values())
    assert sorted(map(tuple, queries.op12_prefix_trie(spark, str(tmp_path)).select(COLUMNS).collect()), key=str) == plain(want)


def test_turnless_and_empty(spark):
    assert prefix_trie.report(spark.createDataFrame([], SCHEMA)).collect() == []
    # only conversation 1 is there: its first turns are those of conversation 0, which is not
    (row,) = prefix_trie.report(spark.createDataFrame([(1, 0, "user", "a", "d", 1)], SCHEMA)).collect()
    assert zlib.crc32(b"1") % 9 > 0
    assert tuple(row) == (1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())
