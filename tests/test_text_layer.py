"""Spans, sentences, tables, Markdown, pages, documents and chunks, on fixtures of our own."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella import config
from tessella.functions import analysis, spans
from tessella.functions import text as T
from tessella.operators import chunking
from tessella.operators.embedding import Hashing
from tessella.sources import documents, pages

DOC = """---
title: Fleet handbook
status: current
effective: 2026-03-01
version: 3
---
Preamble words stand here.

# Charging

Cells are stored at 18 °C. They are moved by Dr. Ama K. Owusu, e.g. on Mondays! Is it so? yes it is.

## Limits

| Class | Range | Note |
| --- | --- | --- |
| A | 2.5 km |  |
| B | 1,200 m | far |
| C | only two |

- **Owner:** fleet team. Due: May 3.
- second item

```
# not a heading
```

### Deep

Text below a deep heading goes on.

## Storage

Text of the storage section goes here.
"""


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[1] for r in rows.select("i", column(F.col("x"))).orderBy("i").collect()]


def test_sentences():
    text = "Stored at 18 °C. Moved by Dr. Ama K. Owusu, e.g. today! Is it so? yes. (End.) Go\n\nNext one\nwraps.\n- item one. Item two.\n> quote"
    assert [text[a:b] for a, b in spans.sentences_of(text)] == ["Stored at 18 °C.", "Moved by Dr. Ama K. Owusu, e.g. today!", "Is it so? yes.", "(End.)", "Go", "Next one\nwraps.", "- item one. Item two.", "> quote"]
    long = "- " + "word " * 70 + "end. Another one."
    assert [long[a:b] for a, b in spans.sentences_of(long)][1] == "Another one."
    assert spans.sentences_of("") == spans.sentences_of("  \n ") == []


def test_sentence_columns(spark):
    texts = ["One is. Two are!", "", None, "é. Ü"]
    assert values(spark, spans.sentences, *texts) == [["One is.", "Two are!"], [], None, ["é.", "Ü"]]
    got = values(spark, spans.token_spans, "it's 2.5 km-long, so")
    assert [(r.start, r.stop) for r in got[0]] == spans.tokens_of("it's 2.5 km-long, so")


def test_tables_and_inline():
    headers = spans.row_headers(DOC)
    rows = [DOC[a:].split("\n", 1)[0] for a in headers]
    assert rows == ["| A | 2.5 km |  |", "| B | 1,200 m | far |", "| C | only two |"] and set(map(tuple, headers.values())) == {("Class", "Range", "Note")}
    assert [spans.rendered_row(r, ["Class", "Range", "Note"]) for r in rows] == ["Class: A; Range: 2.5 km", "Class: B; Range: 1,200 m; Note: far", "C — only two"]
    assert spans.plain("## A `b` **c**") == "A b c" and spans.plain("2) x  y") == "x y" and spans.plain("| a | --- | b |") == "a — b"
    assert spans.cells("| a | b|") == ["a", "b"]


def test_loose_search():
    text = "ab  c\n d e"
    assert text[slice(*spans.find_loose(text, "b c d"))] == "b  c\n d" and spans.find_loose(text, "b x") is None and spans.find_loose(text, " ") is None


def test_plain_functions_are_the_columns(spark):
    rng = random.Random(3)
    bits = ["stories", "Running", "the", "ﬁle", "Ｆｕｌｌ", "1,200", "2.5es", "€3", "it’s", "–", "classes", "bus", "x2", "½", "é", "I don’t know", "[S1, s2]", "[S3;4]", ".", " ", " ", "\n", " "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(150)] + [""]
    for column, plain in ((T.words, analysis.words), (T.terms, analysis.terms), (T.fold, analysis.fold), (T.citations, analysis.citations), (T.is_abstention, analysis.is_abstention), (T.without_citations, analysis.without_citations)):
        assert values(spark, column, *texts) == [plain(t) for t in texts], column.__name__
    assert [set(x) for x in values(spark, T.numbers, *texts)] == [analysis.numbers(t) for t in texts]
    assert values(spark, T.fold, None) == [None] and values(spark, T.is_abstention, "\n\t", "Ｎo") == [True, False]


def test_small_functions(spark):
    assert values(spark, T.slug, "a/My file.MD", "my.file-v2", "...", "v1.2 notes") == ["a-my-file", "my-file-v2", "document", "v1-2-notes"]
    assert [documents.slug(x) for x in ("a/My file.MD", "my.file-v2", "...", "v1.2 notes")] == ["a-my-file", "my-file-v2", "document", "v1-2-notes"]
    assert values(spark, T.title_of, "x/rider_pricing-2025.md", "-.md") == ["Rider Pricing 2025", "Untitled"] == [documents.title_of(x) for x in ("x/rider_pricing-2025.md", "-.md")]
    df = spark.createDataFrame([("3, 1 and 9, 1", 4, "aXaa", "1. What is it\n- how so\nQ?\nHOW SO", 'so {"correct": true}.')], "a string, n int, t string, r string, j string")
    got = df.select(T.passage_numbers(F.col("a"), F.col("n")), T.occurs_twice(F.col("t"), F.lit("a")), T.occurs_twice(F.col("t"), F.lit("X")), T.rewrites(F.col("r"), F.lit("q?"), 3), T.first_json(F.col("j"), "correct boolean").alias("j"), T.cost_usd({"m": (1.0, 2.0)}, F.lit("m"), F.lit(10), F.lit(5)), T.cost_usd({"m": (1.0, 2.0)}, F.lit("z"), F.lit(10), F.lit(5))).first()
    assert list(got[:4]) == [[3, 1, 2, 4], True, False, ["What is it", "how so", "HOW SO"]] and got.j.correct is True and got[5:] == (0.00002, 0.0)


def test_markdown_document():
    doc = documents.parse_markdown("﻿" + DOC.replace("\n", "\r\n"), "d", "s", "n.md")
    assert doc["title"] == "Fleet handbook" and doc["metadata"] == {"title": "Fleet handbook", "status": "current", "effective": "2026-03-01", "version": "3"}
    text = doc["text"]
    assert [tuple(s["path"]) for s in doc["sections"]] == [(), ("Charging",), ("Charging", "Limits"), ("Charging", "Limits", "Deep"), ("Charging", "Storage")]
    assert all(text[s["start"] :].startswith("#") for s in doc["sections"][1:]) and [s["stop"] for s in doc["sections"][:-1]] == [s["start"] for s in doc["sections"][1:]]
    assert documents.front_matter("---\na: [\n---\nx") == ({}, "---\na: [\n---\nx") and documents.front_matter("---\n- a\n---\nx") == ({}, "x") and documents.front_matter("---\nopen") == ({}, "---\nopen")
    bare = documents.parse_markdown("no headings", "my-doc", "s")
    assert bare["title"] == "My Doc" and bare["sections"] == [{"path": [], "start": 0, "stop": 11, "page": None}]


def test_html_rules():
    assert pages.to_markdown("<nav>x</nav><h1> A </h1><p>b <b>c</b></p><ul><li>d</li></ul><script>e</script>") == "# A\n\nb c\n\n- d\n"
    assert pages.to_markdown("<div>text<p>x</p></div>") == "text\n\nx\n"
    assert pages.to_markdown("<table><tr><th>a</th><td>b &amp; c</td></tr></table>x<br>y") == "| a | b & c\n\nx\ny\n"
    assert documents.parse_html("<h1>T</h1><h2>U</h2>v", "d")["sections"][1]["path"] == ["T", "U"]


def test_pdf_pages():
    doc = documents.parse_pdf(["A wrap-\nped line\ngoes  on.\n\nNew part", "  ", "Last"], "d", title=" T ")
    assert doc["text"] == "A wrapped line goes on.\n\nNew part\n\nLast" and doc["metadata"] == {"pages": "3"} and doc["title"] == "T"
    assert [(doc["text"][s["start"] : s["stop"]], s["page"]) for s in doc["sections"]] == [("A wrapped line goes on.\n\nNew part", 1), ("Last", 3)]
    assert documents.load_bytes("x.pdf", b"..", pdf=lambda data: (None, ["one"]))["title"] == "X"


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("b.md", b"# B\n\nbody"), ("sub/a_c.TXT", "plain \xff".encode("latin-1")), ("c.html", b"<h1>C</h1>"), ("skip.bin", b"1")):
        (tmp_path / name).write_bytes(data)
    rows = {r.doc_id: r for r in documents.load_path(spark, str(tmp_path)).collect()}
    assert set(rows) == {"b", "sub-a-c", "c"} and rows["sub-a-c"].source == "sub/a_c.TXT" and "�" in rows["sub-a-c"].text and rows["c"].title == "C"
    assert [r.doc_id for r in documents.load_path(spark, str(tmp_path / "b.md")).collect()] == ["b"]
    with pytest.raises(ValueError):
        documents.load_bytes("x.doc", b"")
    with pytest.raises(Exception):  # noqa: B017
        documents.load_path(spark, str(tmp_path / "none")).count()


def test_ids_are_relative_to_the_folder(spark, tmp_path):
    root = tmp_path / "my docs"
    (root / "my docs").mkdir(parents=True)
    (root / "my docs" / "a.b.md").write_text("x")
    for path in (str(root), f"{root}/", root.as_uri().replace("%20", " ")):
        assert [(r.doc_id, r.source) for r in documents.load_path(spark, path).collect()] == [("my-docs-a-b", "my docs/a.b.md")]


@pytest.mark.parametrize("strategy", ["fixed", "recursive", "structure", "semantic"])
def test_chunks_are_substrings(spark, strategy):
    rng = random.Random(1)
    vocab = ["river", "barge", "lock", "gate.", "water", "keeper", "Night!", "opens", "closes?", "slow"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    body = "\n\n".join([f"# H{i}\n\n" + "\n".join(say(rng.choice([3, 12, 60])) for _ in range(4)) for i in range(6)])
    docs = [documents.parse_markdown("---\nstatus: superseded\nowner: x\n---\n" + body, "m"), documents.parse_text(say(400), "t"), documents.parse_text("", "e"), documents.parse_text("two words", "s")]
    cfg = config.Chunking(strategy=strategy, size=40, overlap=10, min_size=8)
    got = chunking.chunked(spark.createDataFrame(docs, documents.DOCUMENT), cfg, Hashing(64)).collect()
    texts = {d["doc_id"]: d for d in docs}
    by: dict = {}
    for r in got:
        doc = texts[r.doc_id]
        assert doc["text"][r.start : r.stop] == r.text == r.text.strip() and r.metadata["strategy"] == strategy
        assert spans.n_tokens(r.text) <= 41 + 3 * (strategy == "semantic")
        by.setdefault(r.doc_id, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["index"])
        assert [r.chunk_id for r in rows] == [f"{rows[0].doc_id}#{i:04d}" for i in range(len(rows))] and len({(r.start, r.stop) for r in rows}) == len(rows)
    assert set(by) == {"m", "t"} and all(r.metadata["status"] == "superseded" and "owner" not in r.metadata for r in by["m"])
    if strategy == "structure":
        assert all("# H" not in r.text[2:] for r in by["m"]) and by["m"][0].header == "H0"
    covered = sorted((r.start, r.stop) for r in by["t"])
    assert covered[0][0] == 0 and covered[-1][1] == len(texts["t"]["text"])


def test_packing_rules():
    text = "Aa bb cc. Dd ee. Ff gg hh ii jj. Kk"
    cut = chunking.Cutter(text)
    atoms = cut.sentences(0, len(text))
    assert [cut.count(*a) for a in atoms] == [4, 3, 6, 1]
    assert [text[a:b] for a, b in cut.packed(atoms, 9, 3)] == ["Aa bb cc. Dd ee.", "Dd ee. Ff gg hh ii jj.", "Kk"]
    assert [text[a:b] for a, b in cut.packed(atoms, 8, 3)] == ["Aa bb cc. Dd ee.", "Ff gg hh ii jj. Kk"]
    assert [text[a:b] for a, b in cut.slices(0, len(text), 5)] == ["Aa bb cc. Dd", "ee. Ff gg hh", "ii jj. Kk"]


def test_settings_and_grid(tmp_path):
    base = config.Pipeline()
    assert base.with_overrides({"retrieval.k": 3}).retrieval.k == 3 and base.fingerprint() != base.with_overrides({"retrieval.k": 3}).fingerprint() and len(base.fingerprint()) == 10
    assert base.fingerprint("chunking") == base.with_overrides({"retrieval.k": 3}).fingerprint("chunking")
    for bad in ({"retrieval.z": 1}, {"nope.k": 1}):
        with pytest.raises(KeyError):
            base.with_overrides(bad)
    for bad in ({"retrieval": {"k": 0}}, {"chunking": {"strategy": "x"}}, {"chunking": {"semantic_percentile": 100}}, {"more": {}}, {"guard": {"z": 1}}):
        with pytest.raises(ValueError):
            config.Pipeline.of(bad)
    path = tmp_path / "p.yaml"
    path.write_text("pipeline:\n  guard: {injection: off}\n  retrieval: {k: 7}\n")
    assert config.Pipeline.load(str(path)).guard.injection == "off" and config.Pipeline.load(str(path)).retrieval.k == 7
    made, levels, blocks = config.experiments({}, {"retrieval.mode": ["dense", "hybrid"], "chunking.contextual_headers": [False, True]}, [["retrieval.mode", "chunking.contextual_headers"]])
    assert [e.name for e in made] == ["baseline", "retrieval.mode=dense", "chunking.contextual_headers=off", "retrieval.mode=dense, chunking.contextual_headers=off"]
    assert levels["retrieval.mode"][1] == ("hybrid", "baseline") and blocks[0]["cells"]["hybrid|on"] == "baseline"
    assert config.prices({"TESSELLA_PRICES": '{"m": [1, 2]}'})["m"] == (1.0, 2.0) and config.prices({"TESSELLA_PRICES": "{"}) == config.PRICES
    got = config.Settings.read({"TESSELLA_MAX_UPLOAD_MB": "3", "TESSELLA_LLM_KEY": "k", "TESSELLA_LOG_JSON": "true"})
    assert (got.max_upload_mb, got.resolved_generator, got.resolved_embedder, got.log_json) == (3, "llm", "remote", True) and "'k'" not in repr(got)


def test_spans_stay_flat(spark):
    """Thousands of spans a text are Arrow arrays, not an object each; and they are the substrings that Spark takes."""
    import tracemalloc

    texts = ["é 𝄞 a-b. It's! " * 2_000] * 100
    tracemalloc.start()
    got = spans.spans_array([spans.tokens_of(t) for t in texts[:1]])
    made = spans._span_column(spans.tokens_of)(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.to_pylist()[0] == got.to_pylist()[0] and len(made) == 100 and peak < 200 * sum(map(len, texts[:64]))
    rows = spark.createDataFrame([(0, "é 𝄞 a-b. It's!"), (1, None), (2, ""), (3, "x")], "i int, x string").select("*", spans.token_spans(F.col("x")).alias("s"))
    slow = F.transform("s", lambda s: F.substring("x", s["start"] + 1, s["stop"] - s["start"]))
    assert rows.select("i", spans.pieces(F.col("x"), F.col("s")).alias("p"), slow.alias("q")).where("NOT (p <=> q)").count() == 0


def test_stems_held_are_few_whatever_is_read():
    kept = [analysis.stem(f"running{i}s") for i in range(100_000)]
    assert kept[7] == "running7" and analysis.stem.cache_info().currsize <= 2**15
