"""The registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["bm25_batch_queries", "chunks_fixed", "dense_topk_batch", "normalized_text", "token_f1", "injection_scan", "superseded_filter", "context_pack", "retrieved_hybrid", "retrieved_lexical", "answer_scores", "citation_scores", "span_coverage", "gold_problems", "sentence_texts", "token_places", "chunks_fixed_spans", "variability", "calibrate_threshold", "quality_gate", "citation_parse", "stream_ingest", "experiment_comparison"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda d: sorted(map(tuple, d[cols].astype(str).replace({"<NA>": "None", "nan": "None"}).to_numpy().tolist()))
    assert key(got) == key(want)
