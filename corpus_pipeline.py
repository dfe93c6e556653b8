"""A corpus pipeline of five stages, each on all that the one before it kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bytebpe, jaccard, mixing, quality, suffixes
from quillspark.llm.shared import documents, stash
from quillspark.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    ship(spark)
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    ship(spark)
    return jaccard.representatives(docs)


#: Bytes of a passage that repeats. Passages of over 50 words are meant; 51 words of four letters and a space have 255.
PASSAGE = 250


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of PASSAGE bytes are cut out of all texts but the first that has them (smallest doc_id); a
    document of nothing else goes."""
    ship(spark)
    left = suffixes.cut(docs, PASSAGE, keep_first=True).where((F.col("n_bytes") == 0) | (F.length("kept_text") > 0))
    cut = F.col("n_removed") > 0
    columns = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("row.text")), "n_chars": F.when(cut, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return left.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the sources' target weights and shuffled; copies are rows of their own."""
    ship(spark)
    return mixing.replicate(docs).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; their number and the digests of ids and decoded bytes come with them."""
    import public_tokenizers

    ship(spark)
    return bytebpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the quality rules' estimates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
