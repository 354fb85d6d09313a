"""The engine as one object: documents in, answers out, over a collection of Parquet tables in a folder that all executors share.

A collection is ``<root>/<name>``: the tables documents, chunks and vectors, changed by commits that write what changes; beside them a BM25 index in
segments, brought up to date from the commits since it was last asked, and, if it is wanted, an index of the vectors.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.config import Pipeline
from tessella.functions import text as T
from tessella.operators import answers, chunking, rerank, retrieval, store
from tessella.operators.commits import Change, Tables
from tessella.operators.embedding import Embedder, Hashing, embed, embedded
from tessella.operators.segments import Segments
from tessella.operators.storage import temporary, written
from tessella.operators.vectors import VectorIndex
from tessella.sources import documents as sources

DOCUMENTS = sources.DOCUMENT + ", hash string"


class Mismatch(ValueError):
    """A collection was made with another embedder."""


@dataclass
class Timer:
    """Milliseconds of each stage, and in total."""

    began: float = field(default_factory=time.perf_counter)
    stages: dict[str, float] = field(default_factory=dict)

    def stage(self, name: str, run: Callable[[], Any]) -> Any:
        start = time.perf_counter()
        try:
            return run()
        finally:
            self.stages[name] = round(1000 * (time.perf_counter() - start), 2)

    def all(self) -> dict[str, float]:
        return {**self.stages, "total": round(1000 * (time.perf_counter() - self.began), 2)}


class Engine:
    def __init__(self, spark: SparkSession, root: str, collection: str = "default", config: Pipeline | None = None, embedder: Embedder | None = None, generate=answers.extractive, expand: Callable[[str], str] | None = None, scorer=None) -> None:
        self.spark, self.folder, self.collection = spark, f"{root.rstrip('/')}/{collection}", collection
        self.config, self.embedder, self.generate, self.expand, self.scorer = config or Pipeline(), embedder or Hashing(), generate, expand, scorer
        kind = self.config.retrieval
        if kind.query_expansion != "none" and expand is None:
            raise ValueError(f"query expansion {kind.query_expansion!r} needs a model")
        if kind.rerank in ("llm", "cross_encoder") and scorer is None:
            raise ValueError(f"reranking by {kind.rerank!r} needs a model")
        if kind.rerank == "maxsim" and not hasattr(self.embedder, "table"):
            raise ValueError("reranking by maxsim needs an embedder with word vectors")
        self._vectors: tuple[int, VectorIndex] | None = None
        self.tables = Tables(spark, self.folder, {"documents": DOCUMENTS, "chunks": chunking.CHUNK, "vectors": "chunk_id string, doc_id string, embedding array<float>"})

    # the collection
    def _held(self) -> int:
        """The last commit's number."""
        head = self.tables.log.head()
        if head < 0:
            raise KeyError(f"no collection {self.collection!r}")
        return head

    def table(self, name: str) -> DataFrame:
        """documents, chunks or vectors; KeyError without a collection."""
        self._held()
        return self.tables.read(name)

    def _check(self) -> None:
        self._held()
        made = self.tables.note()
        if (made["embedder"], made["dim"]) != (self.embedder.name, self.embedder.dim):
            raise Mismatch(f"collection {self.collection!r} has vectors of {made['embedder']} ({made['dim']}), not of {self.embedder.name} ({self.embedder.dim})")

    def ingest(self, documents: DataFrame, force: bool = False) -> dict[str, int]:
        """DOCUMENT rows into the collection. Unchanged documents are skipped; of the others all chunks are replaced at once. Of rows alike in doc_id the one of the largest hash of its content counts."""
        hashed = documents.withColumn("hash", store.content_hash(F.col("title"), F.col("text")))
        once = Window.partitionBy("doc_id").orderBy(F.desc("hash"))
        hashed = hashed.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
        report = {"added": 0, "updated": 0, "skipped": 0}

        def change(t: Tables, head: int) -> Change | None:
            if head >= 0:
                self._check()
            actions = written(store.classify(hashed.select("doc_id", "hash"), t.read("documents").select("doc_id", "hash"), force), temporary(self.spark, "actions"))
            report.update({"added": 0, "updated": 0, "skipped": 0, **{r.action: r["count"] for r in actions.groupBy("action").count().collect()}})
            if not report["added"] + report["updated"]:
                return None
            ids = actions.where("action != 'skipped'").select("doc_id")
            new = hashed.join(ids, "doc_id", "left_semi")
            # texts are cut once, and their vectors made from what was written
            chunks = written(chunking.chunked(new, self.config.chunking, self.embedder), temporary(self.spark, "chunks"))
            vectors = chunks.select("chunk_id", "doc_id", embedded(chunking.embed_text(F.col("header"), F.col("text")), self.embedder).alias("embedding"))
            report["chunks"] = chunks.count()
            return Change({"documents": new, "chunks": chunks, "vectors": vectors}, actions.where("action = 'updated'").select("doc_id") if head >= 0 else None, {"embedder": self.embedder.name, "dim": self.embedder.dim})

        self.tables.commit(change)
        self.tables.compacted(64)
        return report

    def ingest_path(self, path: str, force: bool = False) -> dict[str, int]:
        return self.ingest(sources.load_path(self.spark, path), force)

    def list_documents(self) -> DataFrame:
        """doc_id, title, source, chunks in order of doc_id."""
        n = self.table("chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"))
        return self.table("documents").join(n, "doc_id", "left").select("doc_id", "title", "source", F.coalesce("chunks", F.lit(0)).alias("chunks")).orderBy("doc_id")

    def delete_document(self, doc_id: str) -> bool:
        """Whether there was one."""
        if self.table("documents").where(F.col("doc_id") == doc_id).isEmpty():
            return False
        gone = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        self.tables.commit(lambda t, head: Change({}, gone, t.note()))
        return True

    def drop(self) -> bool:
        """Deletes the collection with its indexes; whether there was one."""
        there = self.tables.drop()
        self._vectors = None
        return there

    def counts(self) -> dict[str, int]:
        return {n: self.table(n).count() for n in ("documents", "chunks")}

    # questions
    def index(self) -> Segments:
        """The collection's BM25 index, with all commits since it was last asked: their chunks are one more segment."""
        index = Segments(self.spark, f"{self.folder}/index", "chunk_id", "string")
        for _ in range(5):
            head, done = self._held(), index.tables.note().get("head", -1)
            if done >= head:
                break
            # after a compaction the commits between are no longer apart
            apart = done >= 0 and not any(e.get("whole") for n, e in self.tables.log.entries().items() if n > done)
            chunks = self.tables.read("chunks", since=done if apart else -1, at=head)
            gone = None
            if apart:
                changed = self.tables.gone(done, head)
                if changed is not None:
                    gone = self.tables.read("chunks", at=done).join(changed.select(F.col("_gone").alias("doc_id")).distinct(), "doc_id", "left_semi").select("chunk_id")
            elif done >= 0:
                gone = index.tables.read("bags").select("chunk_id")
            index.apply(chunks.select("chunk_id", chunking.embed_text(F.col("header"), F.col("text")).alias("said")), gone, "said", {"head": head}, ("head", done))
            index.merged()
        return index

    def vector_index(self) -> VectorIndex:
        """The collection's index of vectors, made anew after a change."""
        at = self._held()
        if self._vectors is None or self._vectors[0] != at:
            self._vectors = (at, VectorIndex.build(self.table("vectors"), f"{self.folder}/vector-index/{at}-{uuid.uuid4().hex}", "chunk_id"))
        return self._vectors[1]

    def _reranker(self, k: int):
        cfg = self.config.retrieval
        if cfg.rerank == "mmr":
            vectors = self.table("vectors").select("chunk_id", "embedding")
            return lambda head: rerank.mmr(head.join(vectors, "chunk_id", "left"), "chunk_id", k, cfg.mmr_lambda)
        if cfg.rerank == "maxsim":
            words = self.spark.createDataFrame([(w, [float(x) for x in v]) for w, v in zip(self.embedder.table, self.embedder.word_vectors(list(self.embedder.table)))], "term string, vec array<float>")
            return lambda head: retrieval.maxsim(head.withColumn("said", chunking.embed_text(F.col("header"), F.col("text"))), words, "chunk_id", "said", cfg.rrf_k)
        return (lambda head: retrieval.scored_by(head, self.scorer, "chunk_id")) if cfg.rerank != "none" else None

    def retrieve(self, questions: DataFrame, k: int | None = None, cut: bool = True, dropped: bool = False) -> DataFrame:
        """query_id, question, chunk_id, score, rank and the chunk's columns for questions (query_id, question). dropped: also, without a rank, what the guard drops."""
        self._check()
        cfg = self.config.retrieval
        asked = questions.select("query_id", "question")
        if self.expand is not None and cfg.query_expansion != "none":
            rows = [(r.query_id, r.question, self.expand(r.question)) for r in asked.toLocalIterator()]  # a model is asked for each
            asked = self.spark.createDataFrame(rows, f"query_id {asked.schema['query_id'].dataType.simpleString()}, question string, said string")
        asked = retrieval.variants(asked, cfg.query_expansion, most=cfg.num_query_variants).withColumn("q_vec", embedded(F.col("question"), self.embedder))
        vectors = self.vector_index() if cfg.approximate and cfg.mode != "lexical" else self.table("vectors").select("chunk_id", "embedding")
        plain = questions.select("query_id", "question")
        reranker = self._reranker(k or cfg.k)
        if reranker is not None:
            q_vec = plain.withColumn("q_vec", embedded(F.col("question"), self.embedder))
            inner = reranker
            reranker = lambda head: inner(head.join(q_vec, "query_id"))
        found = retrieval.retrieved(asked, self.table("chunks"), cfg, self.index(), vectors, self.config.guard.injection, "chunk_id", k, reranker, cut, dropped)
        return found.join(plain, "query_id")

    def ask_all(self, questions: DataFrame, k: int | None = None, seed: int | None = None) -> DataFrame:
        """Answers (``answers.ANSWER``) to all questions (query_id, question)."""
        return answers.answered(self.retrieve(questions, k, dropped=True), self.embedder, self.config.generation, self.config.guard, "chunk_id", self.index(), self.generate, seed, questions)

    def ask(self, question: str, k: int | None = None) -> dict[str, Any]:
        """One answer with its sources and timings. ValueError for a question of no or over 2000 characters, or k outside 1 .. 50."""
        if not 1 <= len(question.strip()) <= 2000 or (k is not None and not 1 <= k <= 50):
            raise ValueError("a question has 1 to 2000 characters, k is 1 to 50")
        timer = Timer()
        asked = self.spark.createDataFrame([(0, question)], "query_id long, question string")
        rows = timer.stage("retrieve", lambda: self.retrieve(asked, k, dropped=True).orderBy("rank").collect())
        found, flagged = [r for r in rows if r["rank"] is not None], next((r.n_flagged for r in rows if "n_flagged" in r), 0)
        group = [answers.Source(r.chunk_id, r.text, r.doc_title, tuple(r.path or ()), r.page, tuple(r["flags"] if "flags" in r else ())) for r in found]
        terms = asked.select("query_id", F.explode(F.array_distinct(T.terms(F.col("question")))).alias("term"))
        idf = {r.term: r.idf for r in self.index().weights(terms).collect()}
        text, used = timer.stage("generate", lambda: self.generate(question, group, self.embedder, self.config.generation, idf, None))
        made = timer.stage("verify", lambda: answers.final(text, used, flagged, self.embedder, self.config.guard))
        preview = [{"chunk_id": r.chunk_id, "location": s.location, "score": round(r.score, 5)} for r, s in zip(found, group)]
        return {"question": question, **made, "sources": preview, "timings_ms": timer.all(), "config_id": self.config.fingerprint()}

    def stream(self, question: str, k: int | None = None) -> Iterator[dict[str, Any]]:
        """Events: sources, then the answer's words as tokens, then done with the whole record."""
        made = self.ask(question, k)
        yield {"event": "sources", "data": made["sources"]}
        for i, word in enumerate(made["answer"].split(" ")):
            yield {"event": "token", "data": word if i == 0 else f" {word}"}
        yield {"event": "done", "data": made}


def vector(embedder: Embedder, text: str) -> list[float]:
    return embed(embedder, [text])[0].tolist()


def prompts(path: str) -> dict[str, dict[str, str]]:
    """Prompt templates of a YAML file: under ``templates``, name -> system, user and description; the file's version is added to each."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    return {name: {"version": str(data.get("version", "")), "description": "", **spec} for name, spec in (data.get("templates") or {}).items()}


def messages(template: dict[str, str], question: str, context: str) -> Sequence[dict[str, str]]:
    return [{"role": role, "content": answers.filled(template[role], question=question, context=context)} for role in ("system", "user")]
