"""Operator 12: the trie of conversations' shared beginnings.

Turns are dictionary-encoded: each different (role, text) is a number. Sequences alike in all turns count as one, with a weight, so
that copies cost nothing more. Then buckets of sequences with a common beginning are split by their next turn, most significant first,
by Spark's shuffles, until a bucket holds few sequences; such a bucket goes to one task, where a multikey quicksort orders it and its
recursion names the nodes. Blocks of turns are handled so: what is not told apart within one goes on to the next, of four times the
turns and a fourth of the sequences a bucket. From where a sequence is alone, each of its turns is a node, which needs no sorting.

A node is named by its depth and its smallest member, so nothing but sums over members is left: children are members that are smallest
below, leaves are members nobody goes on from, and a turn saves its bytes while its conversation is not the smallest member.

No group is gathered: turns are numbered by ranges with carries, buckets are bounded, node sums combine before the shuffle, and a node's
list of ends is hashed from strings of up to 4096 ids.

Defined results: null role and text are empty ones; turns of equal number are ordered by their content; rows of null conv_id belong to no
conversation and take no part; a conversation given more than once is one of more turns; an empty table gives no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.prefix import running

from .common import drop, partitions, written

#: Sequences times turns of a local bucket in the first round, and turns of its blocks.
CELLS, BLOCK, MOST = 32_000, 16, 4096
#: Ids in one string.
IDS = 4096
CLASS = ("len", "total", "x1", "x2")


def coded(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, said (digest of role and text) and bytes of each row with a conv_id."""
    have = set(conversations.columns)
    role, text = (F.coalesce(conversations[c], F.lit("")) if c in have else F.lit("") for c in ("role", "text"))
    said = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("c"), conversations["turn"].alias("turn"), said.alias("said"), F.octet_length(text).cast("long").alias("b"))


def ordered(conversations: DataFrame) -> DataFrame:
    """c, d (the turn's place, from 1), said, b and cum (bytes up to here) of each turn."""
    return running(coded(conversations), ["c"], ["turn", "said"], {"d": F.lit(1).cast("long"), "cum": F.col("b")}).select("c", "d", "said", "b", "cum")


def _borrowed(c: Column) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % 9).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin with the first h = crc32(c) % 9 turns of conversation c - c % 5 in place of their own; and all conversations."""
    convs = turns.groupBy("c").agg(F.lit(1).alias("one")).select("c", _borrowed(F.col("c")).alias("h"), (F.col("c") - F.pmod(F.col("c"), F.lit(5))).alias("leader"))
    first = turns.where("d <= 8")
    lead = convs.alias("k").join(first.alias("f"), (F.col("k.leader") == F.col("f.c")) & (F.col("f.d") <= F.col("k.h"))).select("k.c", "f.d", "f.said", "f.b", "f.cum")
    taken = lead.groupBy("c").agg(F.max("d").alias("k"), F.max("cum").alias("k_bytes"))
    left = first.where(F.col("d") == _borrowed(F.col("c"))).select("c", F.col("cum").alias("own_bytes"))
    shift = convs.select("c", "h").join(taken, "c", "left").join(left, "c", "left").select("c", "h", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("k", "k_bytes", "own_bytes")])
    own = turns.where(F.col("d") > _borrowed(F.col("c"))).join(shift, "c").select("c", (F.col("d") - F.col("h") + F.col("k")).alias("d"), "said", "b", (F.col("cum") - F.col("own_bytes") + F.col("k_bytes")).alias("cum"))
    return lead.unionByName(own), convs.select("c")


def _split(bucket: list[tuple[int, list[int]]], most: int) -> list[tuple[list[int], int | None]]:
    """Of each (member, ids left), in order: the nodes it shares with others, one after the other, and the node from which it goes on together with others, if any.

    Multikey quicksort: members are split in three by the id at a depth; those of equal id are a node, and go on at the next depth. most: ids a block has."""
    shared: list[list[int]] = [[] for _ in bucket]
    on: list[int | None] = [None] * len(bucket)
    stack = [(list(range(len(bucket))), 0)]
    while stack:
        rows, depth = stack.pop()
        ended = [r for r in rows if len(bucket[r][1]) == depth]
        if depth == most:
            for r in ended:
                on[r] = shared[r][-1] if depth else None
            continue
        rows = [r for r in rows if len(bucket[r][1]) > depth] if ended else rows
        while len(rows) > 1:
            pivot = sorted((bucket[rows[0]][1][depth], bucket[rows[len(rows) // 2]][1][depth], bucket[rows[-1]][1][depth]))[1]
            less, equal, more = [], [], []
            for r in rows:
                x = bucket[r][1][depth]
                (less if x < pivot else more if x > pivot else equal).append(r)
            if len(equal) > 1:
                node = min(bucket[r][0] for r in equal)
                for r in equal:
                    shared[r].append(node)
                stack.append((equal, depth + 1))
            if len(less) > 1:
                stack.append((less, depth))
            rows = more
    return list(zip(shared, on))


def _sorted_buckets(rows: DataFrame, most: int) -> DataFrame:
    """rows (depth, node, m, ids, block) of bounded buckets -> also nodes (shared ones below ``node``) and goes_on; ids has those after ``depth``, of a block of ``most``."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            depth = t.column(0)[0].as_py()
            found = _split(list(zip(t.column(2).to_pylist(), t.column(3).to_pylist())), most - depth)
            return pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), t.column(4), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.int64())], names=["depth", "node", "m", "block", "nodes", "goes_on"])

        held, key = [], None
        for b in batches:
            keys, lo = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), 0
            for hi in range(1, len(keys) + 1):
                if hi < len(keys) and keys[hi] == keys[lo]:
                    continue
                if held and key != keys[lo]:
                    yield done(held)
                    held = []
                key = keys[lo]
                held.append(b.slice(lo, hi - lo))
                lo = hi
        if held:
            yield done(held)

    kinds = "depth int, node long, m long, block array<struct<d:bigint,id:bigint,b:bigint,cum:bigint>>, nodes array<bigint>, goes_on long"
    dealt = rows.repartition(partitions(rows.sparkSession), "depth", "node").sortWithinPartitions("depth", "node")
    return dealt.select("depth", "node", "m", "ids", "block").mapInArrow(sort, kinds)


def _shared(turns: DataFrame, root: DataFrame) -> list[DataFrame]:
    """Tables of m, d, node, parent, b, cum: a row for each turn of a sequence at a node that other sequences share. turns: m, d, id, b, cum of different sequences. root: one row, its node."""
    out, start, size = [], 0, BLOCK
    active = None
    while True:
        cells = max(CELLS // size, 64)
        part = turns.where((F.col("d") > start) & (F.col("d") <= start + size))
        part = part.crossJoin(F.broadcast(root)) if active is None else part.join(active, "m")
        block = F.array_sort(F.collect_list(F.struct("d", "id", "b", "cum")))
        rows = part.groupBy("m").agg(F.first("node").alias("node"), block.alias("block")).withColumn("depth", F.lit(0))
        rows = written(rows.select("depth", "node", "m", "block"), "trie-blocks")
        # radix passes: buckets that are too large for a task are dealt by their next id
        small, large, j = [], rows, 0
        while True:
            sizes = large.groupBy("node").count()
            big = written(sizes.where(F.col("count") > cells).select("node"), "trie-large")
            if big.isEmpty():
                small.append(large)
                break
            small.append(large.join(big, "node", "left_anti"))
            open_ = large.join(big, "node", "left_semi").where(F.size("block") > j).withColumn("id", F.col("block")[j]["id"])
            below = open_.groupBy("node", "id").agg(F.min("m").alias("below"), F.count("*").alias("members")).where("members > 1")
            turn = F.col("block")[j]
            step = open_.join(below, ["node", "id"]).select(F.lit(j + 1).alias("depth"), F.col("below").alias("node"), "m", "block", F.col("node").alias("parent"), turn["d"].alias("d"), turn["b"].alias("b"), turn["cum"].alias("cum"))
            step = written(step, "trie-pass")
            out.append(step.select("m", "d", "node", "parent", "b", "cum"))
            large, j = step.select("depth", "node", "m", "block"), j + 1
            if j == size:
                small.append(large)
                break
        buckets = small[0]
        for more in small[1:]:
            buckets = buckets.unionByName(more)
        ids = F.expr("transform(slice(block, depth + 1, size(block)), x -> x.id)")
        # what went through all of a block's passes is one node's already
        local = buckets.where(F.col("depth") < size).withColumn("ids", ids)
        whole = buckets.where(F.col("depth") == size).select("depth", "node", "m", "block", F.expr("cast(array() as array<bigint>)").alias("nodes"), F.col("node").alias("goes_on"))
        found = written(_sorted_buckets(local, size).unionByName(whole), "trie-sorted")
        each = found.where("size(nodes) > 0").select("m", "node", F.posexplode(F.arrays_zip(F.expr("slice(block, depth + 1, size(nodes))").alias("turn"), F.col("nodes").alias("below"), F.expr("slice(concat(array(node), nodes), 1, size(nodes))").alias("parent"))).alias("at", "x"))
        out.append(each.select("m", F.col("x.turn.d").alias("d"), F.col("x.below").alias("node"), F.col("x.parent").alias("parent"), F.col("x.turn.b").alias("b"), F.col("x.turn.cum").alias("cum")))
        active = found.where("goes_on IS NOT NULL").select("m", F.col("goes_on").alias("node"))
        if active.isEmpty():
            return out
        start, size = start + size, min(size * 4, MOST)


def _ends(keys: DataFrame) -> DataFrame:
    """(class, c) -> class, ends: SHA-256 of the class's ids, in order, joined by commas."""
    spark = keys.sparkSession
    kind = ", ".join(f"{k} long" for k in CLASS)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        key = None
        rows: list[tuple] = []

        def give() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([dict(zip((*CLASS, "c", "ids"), r)) for r in rows], schema=pa.schema([*((k, pa.int64()) for k in CLASS), ("c", pa.int64()), ("ids", pa.string())]))
            rows.clear()
            return made

        def close() -> None:
            if held:
                rows.append((*key, held[0], ",".join(map(str, held))))
                held.clear()

        for b in batches:
            *names, ids = (c.to_pylist() for c in b.columns)
            for now, c in zip(zip(*names), ids):
                if now != key or len(held) == IDS:
                    close()
                    key = now
                held.append(c)
            if len(rows) >= 256:
                yield give()
        close()
        if rows:
            yield give()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        schema = pa.schema([*((k, pa.int64()) for k in CLASS), ("ends", pa.string())])
        for b in batches:
            *names, _, ids = (c.to_pylist() for c in b.columns)
            out = []
            for now, s in zip(zip(*names), ids):
                if now != key:
                    if sha is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256(s.encode())
                else:
                    sha.update(b"," + s.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
        if sha is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, sha.hexdigest())))], schema=schema)

    listed = keys.select(*CLASS, "c").repartitionByRange(partitions(spark), *CLASS, "c").sortWithinPartitions(*CLASS, "c").mapInArrow(strings, f"{kind}, c long, ids string")
    return listed.repartition(partitions(spark), *CLASS).sortWithinPartitions(*CLASS, "c").mapInArrow(digests, f"{kind}, ends string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, as conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: c, d (1, 2, ... in each c), said, b, cum; convs: c, once each, those without turns too."""
    turns = written(turns, "trie-turns")
    place = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "d", "said"))
    sums = turns.groupBy("c").agg(F.count("*").alias("len"), F.max("cum").alias("total"), place(1).alias("x1"), place(2).alias("x2"))
    keys = written(convs.join(sums, "c", "left").select("c", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in CLASS]), "trie-conversations")
    classes = written(keys.groupBy(*CLASS).agg(F.min("c").alias("m"), F.count("*").alias("w")), "trie-classes")
    root = classes.agg(F.min("m").alias("node"))

    mine = turns.join(classes.select(F.col("m").alias("c")), "c", "left_semi")
    names = written(mine.groupBy("said").agg(F.lit(1).alias("one")).select("said", F.monotonically_increasing_id().alias("id")), "trie-dictionary")
    mine = written(mine.join(names, "said").select(F.col("c").alias("m"), "d", "id", "b", "cum"), "trie-sequences")
    drop(turns, names)

    tables = _shared(mine, root)
    shared = tables[0]
    for t in tables[1:]:
        shared = shared.unionByName(t)
    per = shared.groupBy("m").agg(F.max("d").alias("s"), F.max_by("node", "d").alias("last"), F.min(F.when(F.col("node") == F.col("m"), F.col("d"))).alias("t"), F.max(F.when(F.col("node") != F.col("m"), F.col("cum"))).alias("repeated"))
    info = classes.join(per, "m", "left").crossJoin(F.broadcast(root.select(F.col("node").alias("c0"), F.lit(0).alias("zero"))))
    info = info.select("m", "w", *CLASS, F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("last", "c0").alias("last"), F.coalesce("t", F.coalesce("s", F.lit(0)) + 1).alias("t"), F.coalesce("repeated", F.lit(0)).alias("repeated"), "c0")
    info = written(info.withColumn("leaf", (F.col("s") < F.col("len")).cast("long")), "trie-members")

    # sums over members; before: bytes up to the node's parent
    before = F.col("cum") - F.col("b")
    saved = (F.col("w") - 1) * (F.col("total") - before) + F.greatest(F.col("repeated") - before, F.lit(0))
    goes_on = ((F.col("len") > F.col("d")) & (F.col("t") <= F.col("d") + 1)).cast("long")
    inner = shared.join(info.select("m", "w", "len", "total", "t", "repeated", "leaf"), "m").groupBy("node", "d").agg(F.min("parent").alias("parent"), F.sum("w").alias("n_convs"), F.sum(goes_on).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved"))
    alone = mine.join(info.select("m", "w", "len", "total", "s", "last"), "m").where("d > s").select(
        F.col("m").alias("node"), "d", F.when(F.col("d") - 1 > F.col("s"), F.col("m")).otherwise(F.col("last")).alias("parent"), F.col("w").alias("n_convs"), (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("w") - 1) * (F.col("total") - before)).alias("saved"),
    )
    top = info.agg(F.min("c0").alias("node"), F.sum("w").alias("n_convs"), F.sum(((F.col("len") > 0) & (F.col("t") <= 1)).cast("long")).alias("n_children"), F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.sum((F.col("w") - 1) * F.col("total") + F.col("repeated")).alias("saved"))
    top = top.where("node IS NOT NULL").select("node", F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("parent"), "n_convs", "n_children", "n_leaves", "saved")

    end = F.when(F.col("len") == 0, F.col("c0")).when(F.col("s") == F.col("len"), F.col("last")).otherwise(F.col("m"))
    ends = info.select(*CLASS, end.alias("node"), F.col("len").alias("d")).join(_ends(keys), list(CLASS)).select("node", "d", "ends")
    nodes = inner.unionByName(alone).unionByName(top).join(ends, ["node", "d"], "left")
    return nodes.select(
        F.col("node").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = written(ordered(conversations), "trie-ordered")
    return trie(turns, turns.select("c").distinct())


def report(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations."""
    turns = written(ordered(conversations), "trie-ordered")
    return trie(*rebuilt(turns))
