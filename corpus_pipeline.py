"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and works on all that the one before it kept.

Only the last one's rows are not documents: they are the pieces of packed windows. Documents repeated by the mix keep
their doc_id, so a doc_id can have several rows there.

Defined results, stage by stage: null and empty texts score the model's leak and stay (toxicity); texts without words are one
group, rows of null doc_id stay, of rows alike in doc_id and text one does (near); null texts stay null (pii); documents
without words take nothing from the mix and go, null sources are one source (mixing); null doc_ids are packed each (packing). Empty
tables give no rows. The first four keep all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import mixing, near, packing, pii, simhash, toxicity
from tessella.llm.common import representatives, table, written
from tessella.llm.components import united


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of two kinds of links: operator 6's, between SimHash fingerprints at most 2 bits apart, and those
    between texts whose five-word shingle sets are at least 0.8 alike, most of which lie more bits apart."""
    linked = [written(found.select("doc_id", "hash", "component_id", "component_hash"), f"pipeline-{name}") for name, found in (("simhash", simhash.linked(docs)), ("alike", near.linked(docs)))]
    return representatives(docs, written(united(*linked), "pipeline-linked"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data."""
    return pii.pseudonymised(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows. Executors that have run the other stages have less room, so workers are frugal."""
    return packing.pack(docs, frugal=True)


STAGES = [("toxicity", toxicity_stage), ("near", near_duplicates_stage), ("pii", personal_data_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL has no shingle hashes of this kind, no fitted model and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
