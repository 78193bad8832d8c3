"""A corpus from raw documents to token digests: five stages, each a dealt operator.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; `sf_dir` serves to read the labels. Stages return the columns of
`documents`, the last one the digests.
"""

from pyspark.sql import DataFrame, SparkSession

from levelmark.llm import block_naming, mixing, signature_join, toxicity, trie_bpe
from levelmark.llm.common import small_batches, table
from levelmark.llm.queries import VOCABULARY
from levelmark.sources.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go; the model learns from the labelled rows of `docs`."""
    small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return block_naming.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8
    the one with the smallest doc_id stays."""
    small_batches(spark)
    return signature_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them."""
    small_batches(spark)
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    small_batches(spark)
    return trie_bpe.digests(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL expresses neither the fitted trees nor BPE; tests/llm holds the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage_{number}")
    return docs
