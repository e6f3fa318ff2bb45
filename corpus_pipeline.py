"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs. Rows with null ids, repeated rows, empty texts and empty tables pass through every stage by the
rules of the operator that the stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crossloom.llm.common import cut, ship, table
from crossloom.llm.jaccard import link_documents
from crossloom.llm.learning import free_name
from crossloom.llm.mixing import mix_sources
from crossloom.llm.pieces import encode_samples
from crossloom.llm.quality import keep_good
from crossloom.llm.toxicity import keep_civil
from crossloom.operators.scratch import drop, noted


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not find toxic."""
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that links of Jaccard similarity 0.8 connect.

    Rows get a number first, so that repeated rows and null ids are told apart; the text is joined with
    the numbers that go, which are far fewer than those that stay."""
    number = free_name(docs, "row")
    rows = cut(docs.withColumn(number, F.monotonically_increasing_id()), "pipeline-rows")
    gone = cut(link_documents(rows, doc_id=number).where("doc_id <> component_id").select(F.col("doc_id").alias(number)), "pipeline-gone", 24)
    return rows.join(gone, number, "left_anti").select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: of one that it takes r times over and some words more,
    r rows, and by hash of its row number one more, as likely as the words are many.

    Rows get a number first, so that repeated rows and null ids are taken on their own; the mix works on the numbers.
    The counts have a row for nearly every document, so nothing bounds them: they are never broadcast, but meet the
    texts in one shuffle at any size, without sorting the texts."""
    number, times = free_name(docs, "row"), free_name(docs, "times")
    rows = cut(docs.withColumn(number, F.monotonically_increasing_id()), "pipeline-mix-rows")
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mix-copy"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    plan = mix_sources(rows, doc_id=number).select("doc_id", F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + chance).cast("int").alias(times))
    plan = cut(plan.select(F.col("doc_id").alias(number), times).where(F.col(times) > 0), "pipeline-mix", 24)
    copies = rows.join(plan.hint("shuffle_hash"), number)
    return copies.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, with length and digest of the text decoded from each."""
    return encode_samples(docs, spelled=True)


STAGES = [
    ("quality classifier", good_documents),
    ("toxicity", civil_documents),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources", mixed_sources),
    ("SentencePiece encoding", sampled_pieces),
]

#: The stages learn models and draw samples; SQL cannot say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on the way is removed once its result is written, and so is its input."""
    ship(spark)
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with noted() as made:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        drop(spark, before + made[:-1])
        before = made[-1:]
    return docs
