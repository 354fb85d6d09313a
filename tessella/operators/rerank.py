"""Hashed embeddings, diversity reranking, the filter of superseded sources and context packing, for batches of questions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.embedding import Hashing, embedded

#: Tokens a rendered source costs besides its text (fixed value).
LABEL_TOKENS = 12


def hashed_embedding(text: Column, dim: int = 1024, bigrams: bool = True) -> Column:
    """Unit vectors of hashed stems and neighbouring pairs; blank or null texts have a zero vector."""
    return embedded(text, Hashing(dim, bigrams))


def mmr(candidates: DataFrame, key: str = "vec_id", k: int = 5, trade: float = 0.7) -> DataFrame:
    """(query_id, key, rank, q_vec, embedding, score) -> query_id, key, score, rank: relevance traded against likeness to what is chosen.

    A lone candidate keeps its score, where there is one; a missing vector counts as zeros. The first k are chosen one by one, ties to the better incoming rank; the others follow by relevance. A question's candidates are
    a short list by construction (the fetch size), so they fit one task.
    """
    kind = candidates.schema[key].dataType.simpleString()

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable").reset_index(drop=True)
        asked = np.asarray(group["q_vec"].iloc[0], np.float64)
        vectors = np.stack([np.zeros(len(asked)) if v is None else np.asarray(v, np.float64) for v in group["embedding"]])
        relevance = vectors @ asked
        likeness, free = np.zeros(len(group)), np.ones(len(group), bool)
        order, scores = [], []
        if len(group) > 1:
            for turn in range(min(k, len(group))):
                value = np.where(free, trade * relevance - (1 - trade) * likeness, -np.inf)
                best = int(value.argmax())
                order.append(best)
                scores.append(float(value[best]))
                free[best] = False
                new = vectors @ vectors[best]
                likeness = new if turn == 0 else np.maximum(likeness, new)
        left = [int(i) for i in np.argsort(-relevance, kind="stable") if free[i]]
        order, scores = order + left, scores + [float(relevance[i]) for i in left]
        if len(group) == 1 and pd.notna(group["score"].iloc[0]):
            scores = [float(group["score"].iloc[0])]
        return pd.DataFrame({"query_id": group["query_id"], key: group[key].to_numpy()[order], "score": scores, "rank": np.arange(1, len(order) + 1)})

    query = candidates.schema["query_id"].dataType.simpleString()
    own = F.col("score") if "score" in candidates.columns else F.lit(None).cast("double").alias("score")
    return candidates.select("query_id", key, "rank", "q_vec", "embedding", own).groupBy("query_id").applyInPandas(choose, f"query_id {query}, {key} {kind}, score double, rank long")


def current_only(ranked: DataFrame, status: str = "status") -> DataFrame:
    """Without superseded sources. It follows ranking, so fewer than k may stay and ranks keep their gaps."""
    return ranked.where(F.coalesce(F.col(status), F.lit("")) != "superseded")


def packed_context(ranked: DataFrame, max_tokens: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, rank, text) -> query_id, key, rank, cost, label of the sources that fit the budget.

    Texts equal but for white space count once. In rank order the first source is always taken; others are passed over when they do not
    fit what is left. A copy costs what its first one does and the budget only falls, so copies can leave before the fold.
    """
    same = Window.partitionBy("query_id", F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")).cast("binary"))).orderBy("rank")
    cost = (T.count_tokens(F.col(text)) + LABEL_TOKENS).cast("long").alias("cost")
    once = ranked.withColumn("_copy", F.row_number().over(same)).where("_copy = 1").select("query_id", key, F.col("rank").cast("long").alias("rank"), cost)
    lists = once.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cost", key))).alias("items"))
    start = F.struct(F.lit(max_tokens).cast("long").alias("room"), F.array().cast("array<bigint>").alias("taken"))

    def step(state: Column, item: Column) -> Column:
        fits = (F.size(state["taken"]) == 0) | (item["cost"] <= state["room"])
        return F.when(fits, F.struct((state["room"] - item["cost"]).alias("room"), F.concat(state["taken"], F.array(item["rank"])).alias("taken"))).otherwise(state)

    folded = lists.select("query_id", "items", F.aggregate("items", start, step, lambda s: s["taken"]).alias("taken"))
    kept = folded.select("query_id", "taken", F.explode(F.filter("items", lambda i: F.array_contains(F.col("taken"), i["rank"]))).alias("item"))
    return kept.select("query_id", f"item.{key}", "item.rank", "item.cost", F.array_position("taken", F.col("item.rank")).alias("label"))


def cited(sentence: Column, label: Column) -> Column:
    """The sentence with [S label] before its final mark; a full stop if it has none."""
    body = F.regexp_replace(sentence, r"(?U)\s+$", "")
    mark = F.regexp_extract(body, r"([.!?])$", 1)
    core = F.regexp_replace(F.regexp_replace(body, r"[.!?]$", ""), r"(?U)\s+$", "")
    return F.concat(core, F.lit(" [S"), label.cast("string"), F.lit("]"), F.when(mark == "", ".").otherwise(mark))
