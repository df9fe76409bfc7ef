"""The corpus pipeline: five operators of sparklode.llm one after another over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparklode.llm import jaccard, langid, lines, mixing, sentencepiece
from sparklode.llm.queries import NEAR, TOKENIZERS, WEIGHTS
from sparklode.session import cut, ship

#: The share of the tokens that the mixture takes. Sources that run out before give all they have.
BUDGET_SHARE = 0.9
#: Words from which a repeated run of one or two lines goes too; as many as a repeated passage of op5 has.
LONG_RUN = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told: null, empty and letterless texts, and those in unseen languages.
    Repeated rows stay or go together; other columns and null ids pass; an empty table gives an empty one."""
    ship(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of three lines, or of LONG_RUN words, that occur earlier; documents that lose every line go. Null and
    empty texts stay, repeated rows are one document, null ids come first; an empty table gives an empty one."""
    ship(spark)
    return lines.dedup_documents(docs, min_words=LONG_RUN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one with the least id (null first). Repeated rows stay or go
    together; null texts and texts without words stay; an empty table gives an empty one."""
    ship(spark)
    return jaccard.keep_one(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents in the proportion of their sources' target weights, up to the budget. A null source is a source of
    its own, a null or empty text costs nothing, repeated rows are taken together; an empty table gives an empty one."""
    ship(spark)
    return mixing.mix(docs, WEIGHTS, budget_share=BUDGET_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left, and the text decoded from them. A null text has null ids, an empty one none; every
    row, repeated ones too, has its row; an empty table gives no rows."""
    ship(spark)
    return sentencepiece.tokenize(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("encode", encode)]

#: Language identification and encoding are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet in the shared folder and read by the next."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
