"""The corpus pipeline: documents in a known language, without repeated lines, near-duplicates and benchmark text, as tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last keep every column of the documents, also one that is named like a column of the stage's operator. A
null text is empty: the first stage drops it, since it has no language. Rows that repeat an id and a text are copies, of which the near-duplicate stage
keeps one; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.llm import bpe, decontam, forest_join, langid, line_dedup
from forewarn.llm.common import table, written


def with_own_columns(docs: DataFrame, taken: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the documents' columns: those named like a column of the operator (``taken``) stand aside meanwhile."""
    names = {c: f"_own_{c}" for c in docs.columns if c in taken}
    return stage(docs.withColumnsRenamed(names)).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a predicted language go: those whose text is null or has no letter."""
    import public_tokenizers
    model = langid.fit(docs, langid.public_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return with_own_columns(docs, ["lang_pred", "score"], lambda d: langid.identify(d, model).where(F.col("lang_pred") != langid.UNKNOWN))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; ``n_chars`` follows the text."""
    out = with_own_columns(docs, ["n_lines", "n_dropped"], line_dedup.dedup_lines)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return forest_join.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as 32-bit numbers, their digest, and that of the text decoded from them."""
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), bpe.public_vocabulary(), packed=True, decoded_col="decoded"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", tokens),
]
#: SQL has no segmentation-marginalised model, no MinHash forest and no BPE: the rows are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
