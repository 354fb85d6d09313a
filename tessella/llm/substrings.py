"""Operator 3: suffix-array dedup to a depth of ``window`` bytes.

Suffixes are ordered only as far as the window reaches, by most-significant-digit passes over digits of eight bytes, as they
stand in the text; a suffix alone in its group is dropped after each pass, and the groups left at full depth are exactly
the repeated windows. All windows of a group but the earliest (doc_id, then place) mark their bytes.

So that not every suffix has to move, the suffixes are first dealt out about synchronised places: the ``gram`` of least
hash in each window (leftmost on ties) is chosen by content alone, so equal windows hold equal grams at the same place.
Hashes only decide which windows meet; that windows are equal is decided on their bytes.

0. Documents that equal an earlier one as a whole are marked whole.
1. Anchors: the chosen grams of all texts. Those that occur once in all are dropped, in one pass over the sorted rows.
2. The runs of windows about the grams left travel, with their bytes, to where all with their gram meet. Of windows that a
   batch repeats only the first does; the others are marked at once.
3. There windows are ordered by the radix passes, and those not first in their group are marked. A gram of more than
   ``crowd`` runs is dealt over several places; the runs that are first in one of these meet again by a longer gram, which
   reaches half as far again to the left, or, where a window does not hold that, to the right. So a run is two at most after
   each turn, and after seven the gram is the window.
4. Marks are united by document and applied.

Defined results: null text is empty; texts shorter than the window lose nothing; rows with the same doc_id and text count
as one document and share its result; different texts with one doc_id are ordered by a hash of the text; null doc_ids come
first; texts of any length are handled in overlapping segments; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, partitions, written

WINDOW, GRAM = 100, 32
#: Where the digits of a window begin; the last one overlaps the one before it.
DIGITS = (*range(0, WINDOW - 8, 8), WINDOW - 8)
#: Bytes of text a worker handles at once, at most about twice as many; bits of a place among them.
BATCH, PLACE = 1_000_000, 28
NO_ID = -(1 << 63)
_ODD = np.random.default_rng(7).integers(1 << 62, 1 << 63, GRAM // 8 + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MAX = np.uint64((1 << 64) - 1)


def digits(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, most significant first; data has eight bytes or more."""
    return np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,)).astype(np.uint64)


def grams_of(digit: np.ndarray) -> np.ndarray:
    """A hash of the gram at each place."""
    n = len(digit) - GRAM + 8
    x = np.zeros(n, np.uint64)
    for k in range(GRAM // 8):
        x += digit[8 * k : 8 * k + n] * _ODD[k]
        x ^= x >> np.uint64(31)
    x *= _ODD[-1]
    return x ^ (x >> np.uint64(29))


def anchors(digit: np.ndarray, n: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows within each piece starts .. ends of n bytes: (place of the chosen gram, its hash, first window, last window) for each run of windows that share it."""
    reach = WINDOW - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none
    grams = grams_of(digit)
    place = np.uint64((1 << PLACE) - 1)
    packed = np.full(-(-n // reach) * reach + reach, _MAX, np.uint64)
    packed[: len(grams)] = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    rows = packed.reshape(-1, reach)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = (np.minimum(back[: n - WINDOW + 1], ahead[reach - 1 : n - WINDOW + reach]) & place).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    fit = ends - starts >= WINDOW
    np.add.at(inside, starts[fit], 1)
    np.add.at(inside, ends[fit] - WINDOW + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[: n - WINDOW + 1]))
    if not len(windows):
        return none, none, none, none
    chosen = least[windows]
    new = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(windows, prepend=-2) != 1))
    last = np.append(new[1:], len(windows)) - 1
    return chosen[new], grams[chosen[new]].view(np.int64), windows[new], windows[last]


def radix_groups(digit: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, first): numbers of the windows that others equal at full depth, and for each the least number of its group.

    One pass for each digit; the order within a group is that of the numbers. A group whose windows all have the same digit
    stays as it is, the others are sorted by it.
    """
    order, heads = np.arange(len(windows)), np.zeros(min(1, len(windows)), np.int64)
    for lo in DIGITS:
        if not len(order):
            break
        size = np.diff(np.append(heads, len(order)))
        d = digit[windows[order] + lo]
        group = np.repeat(np.arange(len(heads)), size)
        split = np.logical_or.reduceat(d != np.repeat(d[heads], size), heads)
        if not split.any():
            continue
        at = np.flatnonzero(split[group])
        by = np.lexsort((d[at], group[at]))
        order[at], d[at] = order[at[by]], d[at[by]]
        new = np.append(True, (d[1:] != d[:-1]) | (group[1:] != group[:-1]))
        heads = np.flatnonzero(new)
        several = np.repeat(np.diff(np.append(heads, len(order))) > 1, np.diff(np.append(heads, len(order))))
        order, new = order[several], new[several]
        heads = np.flatnonzero(new)
    if not len(order) or len(windows) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order, np.repeat(order[heads], np.diff(np.append(heads, len(order))))


class Runs:
    """Runs of windows over equal or different bytes, in order of (did, hash, start): what of them is first, and what comes again."""

    def __init__(self, did: np.ndarray, h: np.ndarray, start: np.ndarray, data: list[bytes], gram: np.ndarray, place: np.ndarray) -> None:
        order = np.lexsort((start, h, did))
        self.did, self.h, self.start, self.gram, self.place = (x[order] for x in (did, h, start, gram, place))
        self.data = [data[i] for i in order.tolist()]
        n = len(order)
        code = np.asarray(pa.array(self.data, pa.large_binary()).dictionary_encode().indices)
        first = np.zeros(int(code.max()) + 1, np.int64)
        first[code[::-1]] = np.arange(n)[::-1]
        earliest = first[code]
        # a row that says the same of the same place as the earliest one is that row
        same = (self.did == self.did[earliest]) & (self.h == self.h[earliest]) & (self.start == self.start[earliest])
        again = np.flatnonzero(~same)
        size = np.array([len(x) for x in self.data], np.int64)
        self.marks = [(again, self.start[again], self.start[again] + size[again])]
        # of each bytes one run is left; its windows are compared one by one
        left = np.flatnonzero(earliest == np.arange(n))
        m = size[left] - WINDOW + 1
        joined = np.frombuffer(b"".join([self.data[i] for i in left.tolist()]), np.uint8)
        at = np.cumsum(size[left]) - size[left]
        run = np.repeat(np.arange(len(left)), m)
        within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        some, least = radix_groups(digits(joined), at[run] + within)
        place = lambda i: (self.did[left[run[i]]], self.h[left[run[i]]], self.start[left[run[i]]] + within[i])
        apart = np.zeros(len(some), bool)
        for x, y in zip(place(some), place(least)):
            apart |= x != y
        later = np.sort(some[apart])
        self._spans(left, run, within, later, self.marks)
        # windows that are first, as runs
        new = np.ones(len(run), bool)
        new[some[some != least]] = False
        self.first: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._spans(left, run, within, np.flatnonzero(new), self.first)

    def _spans(self, left: np.ndarray, run: np.ndarray, within: np.ndarray, windows: np.ndarray, out: list) -> None:
        """Adds (rows, starts, stops) of the stretches that these windows make."""
        if len(windows):
            cut = np.flatnonzero((np.diff(run[windows], prepend=-1) != 0) | (np.diff(windows, prepend=-2) != 1))
            end = np.append(cut[1:], len(windows)) - 1
            row = left[run[windows[cut]]]
            out.append((row, self.start[row] + within[windows[cut]], self.start[row] + within[windows[end]] + WINDOW))

    def rows(self, keep: bool) -> Iterator[pa.RecordBatch]:
        """CONTEXTS rows: the marks (spans), and, with keep, the runs of first windows (bytes)."""
        for row, a, b in self.marks:
            if len(row):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(row) + 1, 2, dtype=np.int32)), pa.array(np.stack([a, b], axis=1).reshape(-1)))
                none = [pa.nulls(len(row), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([none[0], pa.array(self.did[row]), pa.array(self.h[row]), *none[1:], flat], names=NAMES)
        for row, a, b in self.first if keep else ():
            o = a - self.start[row]
            data = [self.data[i][x : x + y] for i, x, y in zip(row.tolist(), o.tolist(), (b - a).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(self.gram[row]), pa.array(self.did[row]), pa.array(self.h[row]), pa.array(a), pa.array(self.place[row]), pa.array(data, pa.binary()), pa.nulls(len(row), pa.list_(pa.int64()))], names=NAMES)


#: place: where the gram begins in its text.
CONTEXTS = "gram long, did long, hash long, start long, place long, bytes binary, spans array<bigint>"
NAMES = ["gram", "did", "hash", "start", "place", "bytes", "spans"]


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows whose third column is a text, in lists of about ``most`` bytes: each text in overlapping segments, and where the segment begins at the end."""
    rows, size = [], 0
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            for row in zip(*(b.slice(lo, 64).column(i).to_pylist() for i in range(b.num_columns))):
                for at in range(0, max(1, len(row[2]) - WINDOW + 1), most):
                    part = row[2][at : at + most + WINDOW - 1]
                    rows.append((*row[:2], part, *row[3:], at))
                    size += len(part)
                    if size >= most:
                        yield rows
                        rows, size = [], 0
    if rows:
        yield rows


class Pieces:
    """Segments laid end to end, with their anchors."""

    def __init__(self, parts: list[bytes]) -> None:
        self.data = b"".join(parts)
        size = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        x = np.frombuffer(self.data, np.uint8)
        digit = digits(x) if len(x) >= WINDOW else np.zeros(0, np.uint64)
        self.place, self.gram, self.first, self.last = anchors(digit, len(x), self.starts, self.ends)
        self.piece = np.searchsorted(self.starts, self.first, side="right") - 1


def _anchor_rows(batches: Iterator[pa.RecordBatch], most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """(key, any, text) -> (gram, salt, key, sure). Each different gram of a batch is one row of salt 0, which is counted; a gram that
    a batch repeats also gives a sure row, of a salt of its own, for each document that has it."""
    for rows in _segments(batches, most):
        p = Pieces([r[2] for r in rows])
        if not len(p.gram):
            continue
        key = np.array([r[0] for r in rows], np.int64)[p.piece]
        _, at, inverse, counts = np.unique(p.gram, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[inverse] > 1)
        again = again[np.append(True, (p.gram[again][1:] != p.gram[again][:-1]) | (key[again][1:] != key[again][:-1]))] if len(again) else again
        once = at[counts == 1]
        # the row counted for a repeated gram names no document: the sure rows do
        several = at[counts > 1]
        gram = np.concatenate([p.gram[once], p.gram[several], p.gram[again]])
        salt = np.concatenate([np.zeros(len(once) + len(several), np.int64), key[again] | 1])
        sure = np.repeat([0, 2, 1], [len(once), len(several), len(again)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(salt), pa.array(np.concatenate([key[once], key[several], key[again]])), pa.array(sure)], names=["gram", "salt", "key", "sure"])


def _repeated_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, salt, key, sure) in order of gram and salt -> (key, gram) of the grams that are sure or counted more than once."""

    def kept(t: pa.RecordBatch, before: tuple, after: tuple) -> pa.RecordBatch:
        gram, salt, key, sure = (t.column(i).to_numpy() for i in range(4))
        g, s = np.concatenate([[before[0]], gram, [after[0]]]), np.concatenate([[before[1]], salt, [after[1]]])
        same = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
        same[0] &= before[2]
        same[-1] &= after[2]
        good = (sure == 1) | ((sure == 0) & (same[1:] | same[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(key[good]), pa.array(gram[good])], names=["key", "gram"])

    ends = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py(), True)
    held, before, none = None, (0, 0, False), (0, 0, False)
    for b in batches:
        if b.num_rows:
            if held is not None:
                yield kept(held, before, ends(b, 0))
                before = ends(held, held.num_rows - 1)
            held = b
    if held is not None:
        yield kept(held, before, none)


def _context_rows(batches: Iterator[pa.RecordBatch], most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """(did, hash, text, grams) -> CONTEXTS: the runs of windows about those grams, without what the batch repeats, and marks for that."""
    for rows in _segments(batches, most):
        rows = list({(r[0], r[1], r[4]): r for r in rows}.values())
        grams = [np.asarray(r[3], np.int64) for r in rows]
        p = Pieces([r[2] for r in rows])
        keep = np.isin(p.gram, np.unique(np.concatenate(grams)))
        if not keep.any():
            continue
        first, last, piece = p.first[keep], p.last[keep], p.piece[keep]
        did, h, at = (np.array([r[i] for r in rows], np.int64)[piece] for i in (0, 1, 4))
        base = at - p.starts[piece]
        data = [p.data[a:b] for a, b in zip(first.tolist(), (last + WINDOW).tolist())]
        yield from Runs(did, h, first + base, data, p.gram[keep], p.place[keep] + base).rows(True)


def _mark_rows(batches: Iterator[pa.RecordBatch], most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """(gram, salt, hot, did, hash, start, place, bytes) in order of gram and salt -> CONTEXTS: marks, and what is first about hot grams. All rows of a gram and salt are judged together."""

    def judged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        hot = t.column(2).to_numpy().astype(bool)
        for some in (hot, ~hot):
            if some.any():
                part = t.filter(pa.array(some))
                gram, did, h, start, place = (part.column(i).to_numpy() for i in (0, 3, 4, 5, 6))
                yield from Runs(did, h, start, part.column(7).to_pylist(), gram, place).rows(bool(some is hot))

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for lo in range(0, b.num_rows, 2_000):
            held.append(b.slice(lo, 2_000))
            size += held[-1].column(7).nbytes
            if size >= most:
                t = pa.Table.from_batches(held)
                gram, salt = t.column(0).to_numpy(), t.column(1).to_numpy()
                other = np.flatnonzero((gram != gram[-1]) | (salt != salt[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield from judged(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
                size = sum(x.column(7).nbytes for x in held) if cut else 0
    if held and sum(x.num_rows for x in held):
        yield from judged(pa.Table.from_batches(held))


def lengthened(runs: DataFrame, known: int) -> tuple[DataFrame, int]:
    """Runs about grams of ``known`` bytes, by longer ones, and their length. Windows that hold ``more`` bytes before the gram meet by these,
    the others hold as many after it; equal windows have the gram at the same place, so they stay together."""
    more = (WINDOW - known + 1) // 2
    start, size, split = F.col("start"), F.octet_length("bytes").cast("long"), F.col("place") - more + 1
    stop = start + size - WINDOW + 1

    def part(side: int, a: Column, z: Column, place: Column, at: Column) -> Column:
        key = F.xxhash64("gram", F.lit(side), F.substr("bytes", (at - start + 1).cast("int"), F.lit(more)))
        data = F.substr("bytes", (a - start + 1).cast("int"), (z - a + WINDOW - 1).cast("int"))
        return F.when(a < z, F.struct(key.alias("gram"), "did", "hash", a.alias("start"), place.alias("place"), data.alias("bytes")))

    left = part(0, start, F.least(stop, split), F.col("place") - more, F.col("place") - more)
    right = part(1, F.greatest(start, split), stop, F.col("place"), F.col("place") + known)
    return runs.select(F.explode(F.array_compact(F.array(left, right))).alias("r")).select("r.*"), known + more


def merged_spans(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip((spans or [])[::2], (spans or [])[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, crowd: int = 512, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(texts, spans). texts: did, hash, key, bytes of each row; spans: key, spans (starts and ends by turns, unordered) of the documents that lose bytes.

    crowd: runs about a gram that are judged in one place. batch: bytes of text a worker handles at once.
    """
    n = partitions(docs.sparkSession)
    raw = only(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    texts = raw.withColumn("key", F.xxhash64("did", "hash"))
    # a document of the same bytes as an earlier one loses them all, and takes no part in the search
    sized = texts.select("did", F.sha2("bytes", 256).alias("sha"), "key", F.octet_length("bytes").alias("n")).where(F.col("n") >= WINDOW)
    originals = sized.groupBy("sha").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first != last").select(F.col("sha").alias("s"), "first")
    copies = written(sized.join(originals, F.col("sha") == F.col("s")).where(F.col("did") != F.col("first")).select("key", "n").distinct(), "dedup-copies")
    long = texts.where(F.octet_length("bytes") >= WINDOW).join(copies.select(F.col("key").alias("c")), F.col("key") == F.col("c"), "left_anti")
    anchored = long.select("key", "hash", "bytes").mapInArrow(lambda b: _anchor_rows(b, batch), "gram long, salt long, key long, sure int")
    several = anchored.repartition(n, "gram", "salt").sortWithinPartitions("gram", "salt").mapInArrow(_repeated_rows, "key long, gram long")
    grams = several.groupBy(F.col("key").alias("g")).agg(F.collect_set("gram").alias("grams"))
    about = long.join(grams, F.col("key") == F.col("g")).select("did", "hash", "bytes", "grams")
    found = written(about.mapInArrow(lambda b: _context_rows(b, batch), CONTEXTS), "dedup-contexts")
    marks = [found]
    runs, known = found.where("bytes IS NOT NULL").drop("spans"), GRAM
    while known < WINDOW:
        hot = written(runs.groupBy(F.col("gram").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("h", F.ceil(F.col("n") / crowd).alias("parts")), "dedup-hot")
        dealt = runs.join(hot, F.col("gram") == F.col("h"), "left").withColumn("hot", F.col("parts").isNotNull().cast("int"))
        dealt = dealt.withColumn("salt", F.when(F.col("hot") == 1, F.pmod(F.xxhash64("did", "hash", "start"), F.col("parts"))).otherwise(F.lit(0))).select("gram", "salt", "hot", "did", "hash", "start", "place", "bytes")
        marks.append(written(dealt.repartition(n, "gram", "salt").sortWithinPartitions("gram", "salt").mapInArrow(lambda b: _mark_rows(b, batch), CONTEXTS), "dedup-judged"))
        if hot.isEmpty():
            break
        runs, known = lengthened(marks[-1].where("bytes IS NOT NULL").drop("spans"), known)
    else:
        # each run is one window now, of those that over ``crowd`` runs came down to
        runs = written(runs, "dedup-windows")
        me = F.struct("did", "hash", "start")
        first = runs.groupBy(F.col("bytes").alias("f")).agg(F.min(me).alias("first"), F.max(me).alias("last")).where("first != last").select("f", "first")
        later = runs.join(first, F.col("bytes") == F.col("f")).where(me != F.col("first"))
        marks.append(later.select("did", "hash", F.array("start", F.col("start") + WINDOW).alias("spans")))
    every = reduce(DataFrame.unionByName, [m.where("spans IS NOT NULL").select("did", "hash", "spans") for m in marks])
    whole = copies.select("key", F.array(F.lit(0).cast("long"), F.col("n").cast("long")).alias("spans"))
    return texts, every.select(F.xxhash64("did", "hash").alias("key"), "spans").unionByName(whole).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, kept (bytes left), n_bytes, n_removed and n_spans of each row of docs."""
    texts, spans = repeated_spans(docs, **parameters)
    both = texts.join(spans.withColumnRenamed("key", "s"), F.col("key") == F.col("s"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                kept, removed, n = [], [], []
                data = b.column(1).to_pylist()
                for text, spans in zip(data, b.column(2).to_pylist()):
                    gone = merged_spans(spans)
                    edges = [0, *(x for s in gone for x in s), len(text)]
                    kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])) if gone else text)
                    removed.append(len(text) - len(kept[-1]))
                    n.append(len(gone))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array([len(t) for t in data], pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64())], names=["did", "kept", "n_bytes", "n_removed", "n_spans"])

    done = both.select("did", "bytes", "spans").mapInArrow(cut, "did long, kept binary, n_bytes long, n_removed long, n_spans long")
    return done.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans")


def report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicated(docs, **parameters).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
