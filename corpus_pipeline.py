"""From landed documents to packed token ids: clean, deduplicate, decontaminate, mix, encode.

STAGES lists (name, function); each takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.

Every stage takes nulls in any column, empty and long texts, repeated rows, extra columns and empty
tables: a null text counts as an empty one, rows of a null id are rows like others, repeated
rows are judged alike, extra columns travel along, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearsay.llm import decontaminate, mixing, packing, shingles, simhash, toxicity
from hearsay.llm.common import ready, table
from hearsay.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold; the classifier is fitted on the labelled ones. Without labels of both kinds all stay."""
    ready(spark)
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by fingerprint or five-word shingles, the document of the smallest id.

    Null and wordless texts are one group; of several rows of one id that of the least text stays.
    """
    ready(spark)
    return simhash.first_of_groups(docs, alike=shingles.ALIKE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; those without a text stay."""
    ready(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it; a null source is a source of its own."""
    ready(spark)
    return mixing.mix_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the packed token file, as read back from it; one without a text has its end id only."""
    ready(spark)
    return packing.packed_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_packing", pack_tokens),
]

# Trained models, XXH64 and a tokenizer are not SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = cut(docs)
    return docs
