"""BM25 neighbours of the packing shards against a plain computation."""

import numpy as np

from tessella.llm import packing


def ended(*parts):
    return np.concatenate([*parts, [0]]).astype(np.uint32)


def test_all_terms_of_a_seed_are_asked():
    ids = lambda first, n: np.arange(first, first + n, dtype=np.uint32)
    used = ended(ids(1000, 15), ids(9000, 84))
    seed = ended(ids(1000, 15), ids(1000, 15), ids(2000, 19))
    near = ended(ids(2000, 20), ids(8000, 29))
    got = list(packing.pack_shard([used, seed, ended(ids(5000, 49)), near, ended(ids(5001, 49))], window=100))
    assert {(d, q) for d, _, _, q, _ in got} == {(0, 0), (1, 1), (3, 1), (2, 2), (4, 2)}


def test_scores_are_bm25_and_the_end_id_is_no_term():
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 40, rng.integers(0, 30)).astype(np.uint32) for _ in range(40)] + [np.array([100, 101], np.uint32), np.array([102], np.uint32)]
    index = packing.Bm25(np.concatenate(docs), np.array([len(d) for d in docs]))
    mean = np.mean([len(d) for d in docs])
    for seed in (0, 7, 40):
        for other, d in enumerate(docs):
            want = 0.0
            for t in set(docs[seed].tolist()):
                df, tf = sum(t in x for x in docs), int((d == t).sum())
                if tf and df > 1:
                    want += np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            assert abs(index.scores(seed)[other] - want) < 1e-3
    assert not list(index.neighbours(41, np.ones(len(docs), bool)))
    for seed in (0, 7, 40):
        unused = rng.integers(0, 2, len(docs)).astype(bool)
        score = index.scores(seed) * unused
        assert list(index.neighbours(seed, unused, few=5)) == sorted(np.flatnonzero(score).tolist(), key=lambda d: (-score[d], d))


def test_keys_meet_copies():
    docs = [ended([5, 6, 7, 8]), ended([9, 5, 6]), ended([5, 6, 7, 8]), ended([]), ended([3])]
    got = packing.keys(np.concatenate(docs), np.array([len(d) for d in docs]))
    assert got[0] == got[2] != got[1]
    assert all((packing.keys(np.concatenate(docs), np.array([len(d) for d in docs]), block) == got).all() for block in (1, 3, 7))
