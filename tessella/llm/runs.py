"""Operator 11: periodic runs of words, and texts with each run collapsed to one period.

The method is that of suffix trees. A batch of documents is one string of word numbers, different between documents, and the
tree is held as its suffix array and the lengths of common prefixes between neighbours: the least of these in a stretch is the
node that splits it. Of the two sides of each split only the smaller one's leaves are listed (so n log n in all): leaf i and leaf
i + q on different sides of a node of depth q make a branching tandem repeat, which is the right end of a maximal
repetition. Repeats are rotated to the left as far as words agree, and of those that are one stretch the shortest period stays.

Before that, words that can't lie in a run are left out: each word of a run of ``least`` words and ``times`` periods lies
in a window of w = least - least/times words that recurs in its document, so where no window of w words recurs, nothing can be a run. Windows
are compared by hashes, which can let too much through but never too little.

Each document is a row and one task's work, at any length, in n log n steps and about 250 bytes a word of its recurring part; nothing is shuffled.

Defined results: null and empty texts, and texts of white space, have no words and no runs; repeated rows each get theirs; a null doc_id stays
null (and ``planted`` leaves its text alone); a word is a run of characters other than ASCII white space; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, only
from .tokens import batches_of, give_back

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Leaves listed at a time.
LISTED = 1_000_000


def _recurring(words: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Which words lie in a window of w words that occurs twice in its document, by hashes of windows."""
    covered = np.zeros(len(words), bool)
    if len(words) < w:
        return covered
    odd, size, done = 0x9E3779B97F4A7C15, 1, 0
    value = have = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        # a window is one of powers of two side by side
        while done < w:
            power = np.uint64(pow(odd, size, 1 << 64))
            if w & size:
                n = len(words) - done - size + 1
                have = value if not done else have[:n] * power + value[done : done + n]
                done += size
            if done < w:
                value = value[:-size] * power + value[size:]
            size *= 2
        n = len(have)
        mixed = (have ^ (have >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + doc[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    same = doc[:n] == doc[w - 1 :]
    at = np.flatnonzero(same)
    ordered = np.sort(mixed[at])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return covered
    twice = np.unique(twice)
    place = np.minimum(np.searchsorted(twice, mixed[at]), len(twice) - 1)
    starts = at[twice[place] == mixed[at]]
    steps = np.zeros(len(words) + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + w, -1)
    return np.cumsum(steps[:-1]) > 0


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of suffixes, their ranks, and the common prefix of each with the one before it (0 for the first), by doubling.

    s: numbers from 0; where one occurs once, nothing beyond it is compared, so strings that end in such a one are apart."""
    n = len(s)
    small = np.int32 if n < 2**31 else np.int64
    ranks = [np.unique(s, return_inverse=True)[1].astype(small)]
    order, h = np.argsort(ranks[0], kind="stable"), 1
    while True:
        rank = ranks[-1]
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - h, 0)] = rank[h:] + 1
        # only suffixes that are not yet apart are ordered anew
        by = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] |= by[1:] == by[:-1]
        tied[:-1] |= by[1:] == by[:-1]
        if not tied.any():
            break
        some = order[tied]
        some = some[np.argsort(rank[some].astype(np.int64) * (n + 1) + ahead[some], kind="stable")]
        order[tied] = some
        new = np.ones(n, bool)
        by, ah = rank[order], ahead[order]
        new[1:] = (by[1:] != by[:-1]) | (ah[1:] != ah[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        following = np.empty(n, small)
        following[order] = first
        ranks.append(following)
        h *= 2
    lcp, a, b = np.zeros(n, np.int64), order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        equal = np.zeros(n - 1, bool)
        equal[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        lcp[1:] += equal * (1 << k)
        a += equal * (1 << k)
        b += equal * (1 << k)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return order, rank, lcp


def _edges(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each split: first index of the stretch it splits, and the index after its last; of equal splits the first is the highest."""
    values = lcp.tolist()
    left, right, open_ = [0] * len(values), [len(values)] * len(values), [0]
    for j, v in enumerate(values):
        while values[open_[-1]] > v:
            right[open_.pop()] = j
        left[j] = open_[-1]
        open_.append(j)
    return np.array(left, np.int64), np.array(right, np.int64)


def branching(s: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, q): words i to i + q and i + q to i + 2q agree and the word after differs from that q before. most[i]: the largest q of interest at i."""
    order, rank, lcp = suffix_array(s)
    left, right = _edges(lcp)
    split = np.flatnonzero(lcp > 0)
    split = split[lcp[split] <= most[order[split]]]
    lo, mid, hi = left[split], split, right[split]
    small_left = mid - lo <= hi - mid
    start, size = np.where(small_left, lo, mid), np.where(small_left, mid - lo, hi - mid)
    o_lo, o_hi = np.where(small_left, mid, lo), np.where(small_left, hi, mid)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    ends, done = np.cumsum(size), 0
    while done < len(split):
        to = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + LISTED, side="right")), done + 1)
        part = slice(done, to)
        of = np.repeat(np.arange(done, to), size[part])
        leaf = order[start[of] + np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])]
        q = lcp[split[of]]
        for step, first in ((q, leaf), (-q, leaf - q)):
            other = leaf + step
            there = (other >= 0) & (other < len(s))
            where = rank[np.where(there, other, 0)]
            hit = there & (where >= o_lo[of]) & (where < o_hi[of])
            found.append((first[hit], q[hit]))
        done = to
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _same_before(s: np.ndarray, i: int, q: int) -> int:
    """How many words before i agree with those q after them."""
    n, step = 0, 64
    while i - n > 0:
        lo = max(0, i - n - step)
        differ = np.flatnonzero(s[lo : i - n] != s[lo + q : i - n + q])
        if len(differ):
            return n + (i - n - lo) - 1 - int(differ[-1])
        n, step = i - lo, step * 2
    return n


def runs_of(s: np.ndarray, longest: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal repetitions of ``least`` words and ``times`` periods at least. longest[i]: words of the longest stretch of i's document."""
    first, q = branching(s, longest // times)
    end = first + 2 * q
    # a run agrees with itself one period on for so many words before its end
    for back in range(1, -(-least * (times - 1) // times) + 1):
        at = end - q - back
        keep = (at >= 0) & (s[np.maximum(at, 0)] == s[np.minimum(np.maximum(at, 0) + q, len(s) - 1)])
        first, q, end = first[keep], q[keep], end[keep]
    found: dict[tuple[int, int], int] = {}
    by_end: dict[int, list[tuple[int, int]]] = {}
    for i in np.lexsort((q, end)).tolist():
        e, p = int(end[i]), int(q[i])
        known = by_end.setdefault(e, [])
        if any(p % shorter == 0 and e - start >= 2 * p for shorter, start in known):
            continue
        start = e - 2 * p - _same_before(s, e - 2 * p, p)
        known.append((p, start))
        if e - start >= max(least, times * p):
            found[start, e] = min(p, found.get((start, e), p))
    return sorted((start, e - start, p) for (start, e), p in found.items())


def _one_batch(texts: Sequence[str], least: int, times: int) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Runs and collapsed text of each text."""
    w = least - least // times
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    doc = np.repeat(np.arange(len(split)), sizes)
    hashes = np.fromiter(map(hash, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    kept = np.flatnonzero(_recurring(hashes, doc, w)) if len(hashes) else np.zeros(0, np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    if len(kept):
        begins = np.concatenate(([0], np.cumsum(sizes)))
        owner = doc[kept]
        number: dict[tuple[int, bytes], int] = {}
        ids = np.array([number.setdefault((d, split[d][k]), len(number)) for d, k in zip(owner.tolist(), (kept - begins[owner]).tolist())], np.int64)
        # after each stretch stands a number of its own
        cut = np.flatnonzero((np.diff(kept) != 1) | (np.diff(owner) != 0)) + 1
        ends = np.append(cut, len(kept))
        s = np.insert(ids, ends, len(number) + np.arange(len(ends)))
        length, longest = np.diff(np.concatenate(([0], ends))), np.zeros(len(split), np.int64)
        np.maximum.at(longest, owner[ends - 1], length)
        place = np.insert(kept, ends, -1)
        for start, long, period in runs_of(s, np.repeat(longest[owner[ends - 1]], length + 1), least, times):
            at = int(place[start])
            d = int(doc[at])
            runs[d].append((at - int(begins[d]), long, period))
    out = []
    for words, found in zip(split, runs):
        if found:
            stay = np.ones(len(words), bool)
            for start, long, period in found:
                stay[start + period : start + long] = False
            words = [x for x, y in zip(words, stay.tolist()) if y]
        out.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return runs, out


def collapsed(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, runs and collapsed for each row of docs.

    runs: start, length and period of every stretch of words of smallest period p and of max(least, times * p) words or more that no neighbouring
    word extends, by start, then period. collapsed: the words but those after the first period of a run, joined by a space."""
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches_of(batches, 1, 4_000_000):
            runs, texts = _one_batch(b.column(1).to_pylist(), least, times)
            flat = np.array([r for some in runs for r in some], np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in runs]).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    read = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(found, f"doc_id {id_type}, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, with the text of a tenth of the documents repeating itself from some word on: with h = crc32(doc_id), g = h / 10 and n words, where h % 10 = 0
    each word i >= a = g % n is word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def periodic(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)).cast("long") + 1
        tail = let(F.struct(words.alias("words"), a.alias("a"), p.alias("p")), lambda x: F.transform(F.sequence(x["a"], F.size(x["words"]).cast("long") - 1), lambda i: F.element_at(x["words"], (x["a"] + (i - x["a"]) % x["p"] + 1).cast("int"))))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return only(docs, "doc_id", "text").select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD), let(words, periodic)).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run of most periods (the first of equal ones), and digests of the runs and of the collapsed text."""
    found = collapsed(planted(docs))
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), more)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
