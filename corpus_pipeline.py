"""A training corpus from documents: five stages, each working on all that the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of documents. run() applies them to documents, writing each stage's result
as Parquet to the shared folder and reading it again for the next. An empty table stays empty in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import bpe, language
from cohortry.llm.common import documents, fresh, written
from cohortry.llm.contamination import decontaminate
from cohortry.llm.exact_dedup import drop_copies
from cohortry.llm.near_dedup import drop_near_copies


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from their labels; a null text or one without letters goes.

    Long texts are parsed whole; repeated rows share their fate; without labels nothing is learned and all go.
    """
    model = language.train(docs.where(~language.held_out(F.col("doc_id"), 4)))
    lang, score = fresh("__lang", docs.columns), fresh("__score", docs.columns)
    said = language.identify(docs, model, out=lang, score=score)
    return said.where(F.col(lang) != language.UNDETERMINED).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id. Null equals empty; a null id is the smallest; rows
    equal in id and text share their fate."""
    return drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id. Null equals empty; a null id is the
    smallest; rows with one id share its fate; long texts are compared whole."""
    return drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of benchmark items. A null text
    has no words and stays; rows with one id share its fate; without a benchmark all stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of each document, and the digest of the bytes they decode to. A null text has no ids; each
    row gives one row."""
    import public_tokenizers

    ranks = bpe.read_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    decoded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: Cross-parsing, order MinHash and byte-pair merges have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
