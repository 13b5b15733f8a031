"""A training-data pipeline over `documents`: language, toxicity, near copies,
mixture, tokens. Each stage maps (spark, docs, sf_dir) to the next one's docs
and decides over every row that it is given.

Defined cases: null and empty texts, and texts without a letter, leave in the
first stage, and so does a text that no learned language codes better than
plain bytes; repeated rows are one document from the third stage on; extra
columns of documents pass through all stages but the last; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import language, mixing, pieces, simhash, toxicity
from textloom.llm.common import remainder, saved, table

#: A text that its best language codes in more bits than plain bytes and an
#: allowance for the beginning of a text is in none of them.
PLAIN_BITS, START_BITS = 8.0, 64.0


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that can be told.

    Null and empty texts and texts without a letter go, whatever their lang; so
    does a text that all languages code in more bits than its bytes. Repeated rows
    and rows with a null id stay or go like any other; without labelled rows no
    language can be told and all rows go."""
    trees = language.learn(docs.where(remainder(F.col("doc_id"), 4) != 2))
    names = ("__lang_pred", "__lang_score", "__lang_bits")
    told = language.predict(docs, trees, out=names)
    bound = PLAIN_BITS + START_BITS / F.greatest(F.lit(1), F.octet_length(F.col("text").cast("string")))
    return told.where((F.col(names[0]) != language.UND) & (F.col(names[2]) <= bound)).select(*[F.col(f"`{c}`") for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted to be toxic.

    Null and empty texts match nothing and stay unless the labels make even those
    toxic; repeated rows are decided alike; ids without a label, and null ones, are
    decided by their text like all others; without labels the grammar decides."""
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    counts = toxicity.match_counts(toxicity.learn_stems(docs, labels))(F.col("text").cast("string"))
    matched = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), counts.alias("f")), "toxic")
    weights = toxicity.learn(matched, labels)
    kept = docs.withColumn("__toxic", counts).where(toxicity.score(F.col("__toxic"), weights) < toxicity.THRESHOLD)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id.

    Null and empty texts and texts without a word are copies of each other; of
    repeated rows one stays; a row without an id only stays if no copy has one."""
    return simhash.near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it, at most twice.

    A null source is a source, ranked last; rows of no words are taken at their
    source's rate; rows that are equal in all columns share their copies."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row, repeated ones and those
    without an id included; a null text has the begin and end ids only."""
    return pieces.encode_documents(docs, outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [("language", languages), ("toxicity", clean), ("near_duplicates", distinct_documents), ("mixing", mixture), ("tokens", tokens)]
#: Learned models, hashes and a tokenizer decide; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
