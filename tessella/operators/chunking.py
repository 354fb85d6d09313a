"""Chunks of documents: four strategies over exact spans, so that a chunk's text is a substring of its document.

Documents are rows of ``tessella.sources.documents.DOCUMENT`` (``as_documents`` makes them of plain texts); a chunk is CHUNK.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.config import Chunking
from tessella.functions import spans as S
from tessella.functions import text as T
from tessella.operators.embedding import Embedder, embed

CHUNK = "chunk_id string, doc_id string, doc_title string, text string, index int, start int, stop int, path array<string>, page int, header string, metadata map<string,string>"
# Fixed values.
LIFECYCLE = ("status", "effective", "version", "superseded_by")
HEADING_LINE = re.compile(r"^\s*#{1,6}\s+.*$", re.MULTILINE)
LEAST_TOKENS = 3

Span = S.Span


class Cutter:
    """A text with the places of its tokens, so that the tokens of a span are counted by two searches."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens = text, S.tokens_of(text)
        self.starts, self.stops = [a for a, _ in self.tokens], [b for _, b in self.tokens]

    def count(self, a: int, b: int) -> int:
        return max(0, bisect_right(self.stops, b) - bisect_left(self.starts, a))

    def slices(self, a: int, b: int, size: int) -> list[Span]:
        """Runs of ``size`` tokens."""
        inside = self.tokens[bisect_left(self.starts, a) : bisect_right(self.stops, b)]
        return [(inside[i][0], inside[min(i + size, len(inside)) - 1][1]) for i in range(0, len(inside), size)]

    def parted(self, a: int, b: int, pattern: str) -> list[Span]:
        """What lies between the pattern's matches, trimmed, without blank parts."""
        cuts = [m.span() for m in re.finditer(pattern, self.text[a:b])]
        edges = zip([a, *(a + y for _, y in cuts)], [*(a + x for x, _ in cuts), b])
        return [s for s in (S.trimmed(self.text, x, y) for x, y in edges) if s[0] < s[1]]

    def paragraphs(self, a: int, b: int) -> list[Span]:
        return self.parted(a, b, r"\n[ \t]*\n")

    def lines(self, a: int, b: int) -> list[Span]:
        return self.parted(a, b, r"\n")

    def sentences(self, a: int, b: int) -> list[Span]:
        return [(a + x, a + y) for x, y in S.sentences_of(self.text[a:b])]

    def atoms(self, a: int, b: int, size: int, ways: Sequence[str] = ("paragraphs", "lines", "sentences")) -> list[Span]:
        """Parts of at most ``size`` tokens, cut by the coarsest way that will do, at last by tokens."""
        if self.count(a, b) <= size:
            return [s for s in [S.trimmed(self.text, a, b)] if s[0] < s[1]]
        if not ways:
            return self.slices(a, b, size)
        parts = getattr(self, ways[0])(a, b)
        return [x for p in (parts if len(parts) > 1 else [(a, b)]) for x in self.atoms(*p, size, ways[1:])]

    def packed(self, atoms: Sequence[Span], size: int, overlap: int) -> list[Span]:
        """Neighbouring atoms together while they fit. The next chunk begins with as many of the last ones as the overlap holds,
        never with all, and with none if the atom that comes would not fit beside them."""
        n = [self.count(*a) for a in atoms]
        out, first, total = [], 0, 0
        for i, more in enumerate(n):
            if i > first and total + more > size:
                out.append((atoms[first][0], atoms[i - 1][1]))
                back, kept = i, 0
                while back - 1 > first and kept + n[back - 1] <= overlap:
                    back -= 1
                    kept += n[back]
                first, total = (back, kept) if kept + more <= size else (i, 0)
            total += more
        return [*out, (atoms[first][0], atoms[-1][1])] if atoms else out


def fixed(cut: Cutter, sections: Sequence, cfg: Chunking, embedder: Embedder | None = None) -> list[Span]:
    step, n = max(1, cfg.size - cfg.overlap), len(cut.tokens)
    count = 1 + max(0, -(-(n - cfg.size) // step)) if n else 0
    return [(cut.starts[i * step], cut.stops[min(i * step + cfg.size, n) - 1]) for i in range(count)]


def recursive(cut: Cutter, sections: Sequence, cfg: Chunking, embedder: Embedder | None = None) -> list[Span]:
    return cut.packed(cut.atoms(0, len(cut.text), cfg.size), cfg.size, cfg.overlap)


def structure(cut: Cutter, sections: Sequence, cfg: Chunking, embedder: Embedder | None = None) -> list[Span]:
    """Sections that fit as they are; a longer one as by ``recursive``, on its own."""
    fits = lambda a, b: cut.count(a, b) <= cfg.size
    return [x for s in sections for a, b in [(s["start"], s["stop"])] for x in ([(a, b)] if fits(a, b) else cut.packed(cut.atoms(a, b, cfg.size), cfg.size, cfg.overlap))]


def semantic(cut: Cutter, sections: Sequence, cfg: Chunking, embedder: Embedder | None = None) -> list[Span]:
    """Groups of sentences, cut where the likeness of neighbouring windows of three falls most, or at the size; small groups join."""
    if embedder is None:
        raise ValueError("the semantic strategy needs an embedder")
    said = [x for s in cut.sentences(0, len(cut.text)) for x in ([s] if cut.count(*s) <= cfg.size else cut.slices(*s, cfg.size))]
    if len(said) <= 2:
        return [(said[0][0], said[-1][1])] if said else []
    parts = [cut.text[a:b] for a, b in said]
    windows = getattr(embedder, "windows", None)
    vectors = windows(parts) if windows else embed(embedder, [" ".join(parts[max(0, i - 1) : i + 2]) for i in range(len(parts))])
    apart = 1.0 - (vectors[:-1] * vectors[1:]).sum(axis=1)
    far = np.concatenate([[True], apart > float(np.percentile(apart, cfg.semantic_percentile))])
    groups: list[list] = []  # start, stop, tokens
    for (a, b), cut_here in zip(said, far):
        n = cut.count(a, b)
        if cut_here or groups[-1][2] + n > cfg.size:
            groups.append([a, b, n])
        else:
            groups[-1][1:] = [b, groups[-1][2] + n]
    joined: list[list] = []
    for a, b, n in groups:
        if joined and min(n, joined[-1][2]) < cfg.min_size and joined[-1][2] + n <= cfg.size:
            joined[-1][1:] = [b, joined[-1][2] + n]
        else:
            joined.append([a, b, n])
    return [(a, b) for a, b, _ in joined]


STRATEGIES: dict[str, Callable[..., list[Span]]] = {"fixed": fixed, "recursive": recursive, "structure": structure, "semantic": semantic}


def chunks_of(doc: dict, cfg: Chunking, embedder: Embedder | None = None) -> list[dict]:
    """The chunks of a document (a DOCUMENT row as a dict): no blank, repeated or nearly empty ones; headings alone are nearly empty."""
    text, sections = doc["text"] or "", list(doc["sections"])
    starts = [s["start"] for s in sections]
    kept = {k: v for k, v in dict(doc["metadata"] or {}).items() if k in LIFECYCLE}
    found = dict.fromkeys(S.trimmed(text, *s) for s in STRATEGIES[cfg.strategy](Cutter(text), sections, cfg, embedder))
    full = [(a, b) for a, b in found if a < b and S.n_tokens(HEADING_LINE.sub("", text[a:b])) >= LEAST_TOKENS]
    out = []
    for i, (a, b) in enumerate(full):
        section = sections[max(0, bisect_right(starts, a) - 1)]
        names = dict.fromkeys(p for p in (doc["title"], *section["path"]) if p)
        header = " › ".join(names) if cfg.contextual_headers else ""
        out.append({"chunk_id": f"{doc['doc_id']}#{i:04d}", "doc_id": doc["doc_id"], "doc_title": doc["title"], "text": text[a:b], "index": i, "start": a, "stop": b,
                    "path": list(section["path"]), "page": section["page"], "header": header, "metadata": {"strategy": cfg.strategy, **kept}})
    return out


def chunked(documents: DataFrame, cfg: Chunking | None = None, embedder: Embedder | None = None) -> DataFrame:
    """documents (DOCUMENT) -> CHUNK rows."""
    cfg = cfg or Chunking()
    if cfg.strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {cfg.strategy!r}")
    if cfg.strategy == "semantic" and embedder is None:
        raise ValueError("the semantic strategy needs an embedder")
    names = ["doc_id", "title", "text", "sections", "metadata"]

    schema = to_arrow_schema(documents.sparkSession.createDataFrame([], CHUNK).schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # texts and chunks are Python objects for a few documents at a time
            for lo in range(0, b.num_rows, 32):
                rows = [r | {"metadata": list(r["metadata"].items())} for doc in b.slice(lo, 32).to_pylist() for r in chunks_of(doc, cfg, embedder)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return documents.select(*names).mapInArrow(cut, CHUNK)


def as_documents(texts: DataFrame, key: str = "doc_id", text: str = "text", title: Column | None = None, source: Column | None = None) -> DataFrame:
    """Plain texts as DOCUMENT rows of one section; a null text is empty."""
    said = F.coalesce(F.col(text), F.lit(""))
    section = F.struct(F.array().cast("array<string>").alias("path"), F.lit(0).alias("start"), F.length(said).alias("stop"), F.lit(None).cast("int").alias("page"))
    name = F.col(key).cast("string")
    none = F.lit("")
    return texts.select(name.alias("doc_id"), (none if title is None else title).alias("title"), (none if source is None else source).alias("source"), said.alias("text"), F.array(section).alias("sections"), F.create_map().cast("map<string,string>").alias("metadata"))


def embed_text(header: Column, text: Column) -> Column:
    """What is indexed and embedded: the chunk under its header."""
    return F.when(F.coalesce(header, F.lit("")) == "", text).otherwise(F.concat(header, F.lit("\n\n"), text))


def fixed_windows(docs: DataFrame, size: int = 200, overlap: int = 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_no, n_tokens, first_token, chunk_words of sliding token windows, by column expressions only; the last is the first that reaches the end."""
    step = max(1, size - overlap)
    counted = docs.select(key, T.tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    last = F.ceil(F.greatest(F.lit(0), F.size("tokens") - size) / step).cast("int")
    out = counted.select(key, "tokens", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.slice("tokens", F.col("chunk_no") * step + 1, F.lit(size))
    return out.select(key, F.col("chunk_no").cast("long").alias("chunk_no"), (F.col("chunk_no") * step).cast("long").alias("first_token"), F.size(piece).cast("long").alias("n_tokens"), F.array_join(piece, " ").alias("chunk_words"))
