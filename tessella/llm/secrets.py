r"""Operator 5: secret scans by rules and by character Markov models.

Rules give the base spans (``assign``, ``access``, ``hex``). The method adds ``markov`` spans: words over the alphabet of keys, of
``LEAST`` characters or more, whose log-likelihood ratio under two character-bigram models, one of random strings and one of
ordinary words and identifiers, reaches ``threshold``. Every such word is scored; spans that meet a base span are not added.

The models are trained from labelled samples (``samples``). Random are the values of base spans, and digests of the sampled
doc_ids written in the usual alphabets (lower hexadecimal, base 64, capitals and digits); ordinary are the words outside
base spans. They come from the documents of at most ``sample`` doc_ids (those of the least hash); a third of the words is
held out, and ``quality`` measures the models on it. Counts are aggregated by Spark, and the models have 2 x 128 x 128
entries at most.

Defined results: null text is empty and has no spans; a table without doc_ids has flat models, which add nothing; repeated
rows are scanned each; texts and words may be of any length; offsets are code points, end exclusive; extra columns are
ignored. Expressions are built-in SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, let, only, written

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of 16 characters or more; a shorter run holds none
HEX = r"[0-9a-f]{32,}"
LEAST = 8
#: Whole words: not beside a letter or digit of any script, dots only inside.
WORDS = r"(?<![\p{L}\p{N}])[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_=-]|\.(?=[A-Za-z0-9+/_=-])){7,}+(?![\p{L}\p{N}])"
KINDS = ("assign", "access", "hex", "markov")
SIDE = 128
SPANS = "array<struct<start:int,kind:int,stop:int,value:string>>"


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start,kind,stop,value>> of the pattern's matches from left to right; keep: what makes an array of flags of the array of matches.

    Places are sums of lengths, taken within blocks of about the square root of the matches' number and then over blocks.
    """
    nothing = F.array().cast(SPANS)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(steps: Column, n: Column, block: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            start = acc["at"] + s["gap"]
            stop = start + F.length(s["hit"])
            one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), s["hit"].alias("value")))
            return F.struct(stop.alias("at"), F.when(s["keep"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        first = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
        inside = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(steps, b * block + 1, block), first, step))
        starts = lambda each: F.aggregate(F.transform(each, lambda x: x["at"]), F.array(F.lit(0)), lambda acc, at: F.concat(acc, F.array(F.element_at(acc, -1) + at)))
        moved = lambda x, at: F.transform(x["out"], lambda o: F.struct((o["start"] + at).alias("start"), o["kind"].alias("kind"), (o["stop"] + at).alias("stop"), o["value"].alias("value")))
        return let(inside, lambda each: F.flatten(F.zip_with(each, F.slice(starts(each), F.lit(1), F.size(each)), moved)))

    def found(whole: Column) -> Column:
        flags = F.transform(whole, lambda m: F.lit(True)) if keep is None else keep(whole)
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.length)
        steps = lambda kept: F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), kept.alias("keep"))
        some = lambda kept: F.when(F.exists(kept, lambda k: k), let(steps(kept), lambda s: placed(s, F.size(s), F.ceil(F.sqrt(F.size(s))).cast("int")))).otherwise(nothing)
        return F.when(F.size(whole) > 0, let(flags, some)).otherwise(nothing)

    return let(hits, found)


def base_spans(text: Column) -> Column:
    long_enough = lambda whole: F.transform(whole, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)
    return F.array_sort(F.concat(spans(text, ASSIGN, 0, long_enough), spans(text, ACCESS, 1), spans(text, HEX, 2)))


def _pairs(word: Column) -> Column:
    """Places of the word's pairs of adjacent characters in the models' tables."""
    codes = F.transform(F.split(word, ""), lambda c: F.pmod(F.ascii(c), F.lit(SIDE)))
    return let(codes, lambda x: F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a * SIDE + b))


def samples(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """word, random (1 or 0), held_out: the labelled words."""
    chosen = only(docs, "doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    based = F.translate(F.base64(F.unhex(digest)), "=", "")
    made = chosen.select(F.explode(F.array(F.substring(digest, 1, 32), F.substring(based, 1, 32), F.substring(F.upper(F.translate(based, "+/", "")), 1, 20))).alias("word"))
    found = picked.select(F.explode(base_spans(F.col("text"))).alias("s")).select(F.regexp_extract(F.col("s.value"), r"([A-Za-z0-9+/_.-]+=*)$", 1).alias("word"))
    hits = F.concat_ws("|", F.lit(ASSIGN), F.lit(ACCESS), F.lit(HEX))
    plain = picked.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", hits, F.lit(" ")), F.lit(WORDS.replace("{7,}", "{3,}")), F.lit(0))).alias("word"))
    every = made.unionByName(found).select("word", F.lit(1).alias("random")).unionByName(plain.select("word", F.lit(0).alias("random")))
    return every.where(F.length("word") >= 2).withColumn("held_out", F.pmod(F.xxhash64("word"), F.lit(3)) == 0)


def train(docs: DataFrame, sample: int = 20_000, smoothing: float = 0.5, backoff: float = 20.0, doubt: float = 15.0) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for each pair of characters, in _pairs' order.

    Keys that no rule finds stand among the ordinary words, as often as their documents are copied. So each of these words is
    scored by models without itself first, and those that reach ``doubt`` are left out.
    """
    words = written(samples(docs, sample).where(~F.col("held_out")).groupBy("random", "word").agg(F.count("*").alias("f")), "secret-words")

    def counts(of: DataFrame) -> dict[int, float]:
        pairs = of.select("f", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("f").alias("n"))
        return {r.pair: float(r.n) for r in pairs.collect()}  # at most SIDE^2 rows

    def parts(found: dict[int, float]) -> tuple[list[float], list[float], list[float]]:
        """Counts of pairs, of first characters, and how often the second character comes at all, for each pair."""
        n = [found.get(p, 0.0) for p in range(SIDE * SIDE)]
        rows = [sum(n[a * SIDE : (a + 1) * SIDE]) for a in range(SIDE)]
        alone = [sum(n[b::SIDE]) + smoothing for b in range(SIDE)]
        return n, [rows[p // SIDE] for p in range(SIDE * SIDE)], [alone[p % SIDE] / sum(alone) for p in range(SIDE * SIDE)]

    def logs(found: dict[int, float]) -> list[float]:
        return [math.log((n + backoff * c) / (row + backoff)) for n, row, c in zip(*parts(found))]

    ordinary, random = words.where("random = 0"), logs(counts(words.where("random = 1")))
    every = counts(ordinary)
    if not every:
        drop(words)
        return [0.0] * SIDE * SIDE
    r, n, row, c = map(_table, (random, *parts(every)))
    own = F.col("f")
    without = lambda acc, p: acc + F.element_at(r, p + 1) - F.log((F.greatest(F.element_at(n, p + 1) - own, F.lit(0.0)) + backoff * F.element_at(c, p + 1)) / (F.greatest(F.element_at(row, p + 1) - own, F.lit(0.0)) + backoff))
    sure = ordinary.where(F.aggregate(_pairs(F.col("word")), F.lit(0.0), without) < doubt)
    out = [x - y for x, y in zip(random, logs(counts(sure)))]
    drop(words)
    return out


def _table(model: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.9g}" for x in model)), ",").cast("array<double>")


def likelihood_ratio(word: Column, table: Column) -> Column:
    """Sum of the word's log-likelihood ratios."""
    return F.aggregate(_pairs(word), F.lit(0.0), lambda acc, p: acc + F.element_at(table, p + 1))


def quality(docs: DataFrame, sample: int = 20_000, threshold: float = 15.0) -> dict[str, float]:
    """Precision, recall and number of words of the models on the held-out words of LEAST characters or more, each counted once."""
    table = _table(train(docs, sample))
    words = samples(docs, sample).where(F.col("held_out") & (F.length("word") >= LEAST)).distinct()
    got = words.groupBy("random", (likelihood_ratio(F.col("word"), table) >= threshold).alias("hit")).count().collect()
    n = lambda random, hit: sum(r["count"] for r in got if r.random == random and r.hit == hit)
    return {"precision": n(1, True) / max(1, n(1, True) + n(0, True)), "recall": n(1, True) / max(1, n(1, True) + n(1, False)), "random": n(1, True) + n(1, False), "ordinary": n(0, True) + n(0, False), "false": n(0, True)}


def scan(docs: DataFrame, sample: int = 20_000, threshold: float = 15.0, model: list[float] | None = None) -> DataFrame:
    """doc_id, base and added: spans (start, kind, stop, value) sorted by start."""
    table = _table(model or train(docs, sample))
    text = F.coalesce("text", F.lit(""))
    based = only(docs, "doc_id", "text").select("doc_id", text.alias("text"), base_spans(text).alias("base"))
    random = lambda words: F.transform(words, lambda w: likelihood_ratio(w, table) >= threshold)
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    return based.select("doc_id", "base", F.filter(spans(F.col("text"), WORDS, 3, random), apart).alias("added"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256 and spans of scan's rows."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    n = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    base = F.array_join(F.transform("base", said), ",")
    every = F.array_join(F.transform(F.array_sort(F.concat("base", "added")), said), ",")
    return found.select("doc_id", *[n("base", k).alias(f"n_{KINDS[k]}") for k in range(3)], F.size("added").cast("long").alias("n_markov"), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
