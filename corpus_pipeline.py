"""A training-corpus pipeline: classify, remove exact and near copies, mix sources, encode.

``STAGES`` lists (name, function).  Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns as Parquet in the shared folder and reads it as the next one's documents.  A row of the result
belongs to one taking of a document by the mix.

Defined cases, for every stage: decisions are made by row, so rows whose id is null or stands on several texts are kept
or dropped each for itself; a null text counts as empty; extra columns, whatever their names, go along and are never
read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.minhash import near_dedup
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.quality import quality_filter
from tidemark.llm.queries import default_model, read
from tidemark.llm.scratch import numbered_columns, place, table
from tidemark.llm.sentencepiece_codec import digests

def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is one half or more.

    Equal texts are judged alike, empty ones too; contradicting labels of an id count as the higher; without labels all stay."""
    return quality_filter(docs, read(spark, sf_dir, "labels"))


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` written with a key of each row; columns are numbered, so that no name can clash."""
    return table(spark, numbered_columns(docs).withColumn("key", F.monotonically_increasing_id()), "keyed")


def _without(spark: SparkSession, docs: DataFrame, keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key isn't in ``gone`` (gone)."""
    left = keyed.join(table(spark, gone, "gone"), F.col("key") == F.col("gone"), "left_anti")
    return left.drop("key").toDF(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space.

    The longest original stays, of equals the least id, of equal ids one row; a null id loses; empty texts are equal."""
    keyed = _keyed(spark, docs)
    found = exact_dedup(spark, keyed, id_col=f"_{place(docs, 'doc_id')}", text_col=f"_{place(docs, 'text')}", key_col="key")
    return _without(spark, docs, keyed, found.where("not kept").select(F.col("key").alias("gone")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that of the least id; a null id loses, and equal ids go by the row.

    Texts without words are linked with nothing and stay."""
    keyed, doc_id = _keyed(spark, docs), F.col(f"_{place(docs, 'doc_id')}").alias("doc_id")
    found = near_dedup(spark, keyed, id_col="key", text_col=f"_{place(docs, 'text')}")
    found = table(spark, found.select(F.col("doc_id").alias("key"), "component_id"), "components")
    several = table(spark, found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"), "several")
    # Written tables make both sides of the joins plain exchanges, so that a hot component's rows can be split among tasks.
    members = table(spark, found.join(several, "component_id", "left_semi").join(keyed.select("key", doc_id), "key"), "members")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.col("key").alias("row")))
    stay = table(spark, members.groupBy("component_id").agg(least.alias("least")).select("component_id", F.col("least.row").alias("stays")), "stay")
    return _without(spark, docs, keyed, members.join(stay, "component_id").where(F.col("key") != F.col("stays")).select(F.col("key").alias("gone")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words aren't taken; a null source is a source; rows of one id are taken equally often."""
    return mixed_rows(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each row, repeated rows included; an empty text has begin and end only."""
    return digests(docs, default_model())


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(spark, stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs


#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None
