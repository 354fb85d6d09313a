"""Operator 4: mixing sources to target weights.

Every document gets a hash-random key; within a source the keys' order is the order of the mix. Prefix sums of token
counts are taken in two levels (per key range, then inside a range), so a source of any size is spread over
``ranges`` groups, and each source is cut exactly at its budget; what is left of a budget after a whole pass over
the source starts the next epoch.

Defined results: null text or text of white space has size 0 and takes nothing; a null source is a source of its own,
last in order; equal doc_ids, and null ones of equal texts, are ordered by size (rows alike in both are interchangeable);
an empty table gives an empty result; extra columns are ignored (``mix``) or kept (``mixed_documents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, only, whole_rows, written


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target: shares of ``share`` x all sizes by weight, filled up to ``cap`` x source_size.

    Water-filling in closed form: with sources in the order of cap x size / weight, the first for which the share left
    per weight stays under that ratio fixes the level. One row per source, so one small task.
    """
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    nth = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    levels = (
        sources.withColumn("nth", nth).withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
    )
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))).over(every)["level"], F.max("ratio").over(every))
    return levels.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def _keyed(docs: DataFrame, seed: int, ranges: int, *carried: Column) -> DataFrame:
    """doc_id, source, size, key and range of each row, and what is carried. Rows without a doc_id are keyed by their text."""
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text.cast("binary"))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary"))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), *carried)
    return sized.withColumn("range", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / 2**32).cast("int"))


def _taken(keyed: DataFrame, per_range: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """keyed rows with source_size, target and taken. per_range: source, range, range_size."""
    before = per_range.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    per_source = targets(per_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budgets = before.join(per_source.select(F.col("source").alias("s2"), "source_size", "target"), F.col("s").eqNullSafe(F.col("s2")))
    joined = placed.join(budgets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    at, budget = F.col("range_start") + F.col("in_range"), F.round("target").cast("long")
    epochs = range(max(1, -(-int(cap * 1000) // 1000)))
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), budget - F.lit(e) * F.col("source_size") - at)) for e in epochs), F.lit(0))
    return joined.withColumn("taken", taken.cast("long"))


def _per_range(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, ranges: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs; taken counts a document's words in all epochs."""
    keyed = written(_keyed(only(docs, "doc_id", "source", "text"), seed, ranges), "mix-sizes")
    return _taken(keyed, _per_range(keyed), weights, share, cap).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, ranges: int = 4096) -> DataFrame:
    """docs as the mix takes them: a row per whole copy, and for the document at a source's cut its first words, single-spaced.

    Copies keep their doc_id; all columns are kept, whatever their names. n_chars, where present, follows the text.
    """
    rows = whole_rows(docs, *(docs[c] if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("text", "string"))))
    sizes = _keyed(rows.drop("row"), seed, ranges)
    taken = _taken(_keyed(rows, seed, ranges, F.col("row")), _per_range(sizes), weights, share, cap).where("taken > 0").select("row", "size", "taken")
    copies = taken.select("row", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy"))
    copies = copies.select("row", "size", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).alias("take"))
    whole, text = F.col("take") == F.col("size"), F.col("row")["text"]
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("take").cast("int")), " ")
    new = F.col("row").withField("text", F.when(whole, text).otherwise(cut))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(whole, F.col("row")["n_chars"]).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType))
    return copies.select(new.alias("row")).select("row.*")


ORACLE = rf"""
WITH sized AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
nthed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM src),
weighed AS (SELECT *, CASE nth % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM nthed),
ratios AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM weighed),
levels AS (SELECT *, (total - coalesce(sum(most) OVER w, 0.0::DOUBLE)) / (weights - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level FROM ratios
  WINDOW w AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level AS lvl FROM levels WHERE level <= ratio ORDER BY ratio, nth LIMIT 1),
goals AS (SELECT source, source_size, least(most, coalesce((SELECT lvl FROM chosen), (SELECT max(ratio) FROM levels)) * weight) AS target FROM levels),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM sized)
SELECT p.doc_id, p.size, g.source_size, g.target,
  (greatest(0, least(p.size, round(g.target)::BIGINT - p.place)) + greatest(0, least(p.size, round(g.target)::BIGINT - g.source_size - p.place)))::BIGINT AS taken
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source
"""
