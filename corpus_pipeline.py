"""From raw documents to token ids: the stages of a training corpus.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import bpe, lines, mixing, simhash, toxicity
from kestrel.llm.common import cut
from kestrel.llm.queries import tokenizer_path
from kestrel.session import ensure_checkpoint_dir
from kestrel.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 for toxicity."""
    ensure_checkpoint_dir(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]), threshold=0.7)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that later occurrences of three-line
    windows cover; n_chars follows the text."""
    ensure_checkpoint_dir(spark)
    clean = lines.dedup(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash (three-word shingles, two bits)."""
    ensure_checkpoint_dir(spark)
    return simhash.keep_one(docs, shingle=3, radius=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row for each pass that has words of a document,
    with those words; n_chars follows the text."""
    ensure_checkpoint_dir(spark)
    mixed = mixing.mixed_documents(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text."""
    ensure_checkpoint_dir(spark)
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs


#: The stages learn models and hash with functions that SQL lacks; run() is tested
#: against a brute-force version instead.
ORACLE_SQL = None
