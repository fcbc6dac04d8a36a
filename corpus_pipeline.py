"""A corpus from raw documents to sampled token sequences, in stages that read tables.

Each stage takes (spark, docs, folder) and returns what the next one reads; ``run`` writes
every stage's rows to the shared folder, so that a lost executor costs a stage at most.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engagement.llm.queries import SURROGATE_KEY
from engagement.llm.rule_classifier import keep_quality
from engagement.llm.scratch import stored
from engagement.llm.sentence_pieces import encode_pieces
from engagement.llm.shingle_join import distinct_documents
from engagement.llm.source_mix import mix_sources
from engagement.llm.surrogates import replace_personal_data
from engagement.session import configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier takes for good ones, each row by its own text.

    A null or empty text is judged as an empty one; repeated rows and rows without a doc_id
    are judged one by one.
    """
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return keep_quality(docs, labels, threshold=0.7).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of similar ones: that with the smallest doc_id.

    Rows that share a doc_id but not the text are documents of their own, equal rows are
    one. Rows without a doc_id, and texts without words, are similar to nothing and all stay.
    """
    return distinct_documents(docs.select(*COLUMNS), k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars of changed texts is counted anew.

    Null texts stay null, empty ones empty, and each row stays a row.
    """
    out = replace_personal_data(docs, key=SURROGATE_KEY)
    n_chars = F.when(F.col("n_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Copies of the documents, sources weighing mass ** 0.7, dealt out at random.

    A null source is a source of its own; null texts weigh nothing but are repeated at their
    source's rate. Rows with one doc_id get equal numbers of copies in one source.
    """
    return mix_sources(docs, exponent=0.7, epochs=1.0, seed=0).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents with their number of pieces, the pieces, and whether they are lossless.

    A null text has null pieces, an empty one none; equal rows get equal pieces.
    """
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), sharpness=1.0, seed=0)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("source mixture", mixture),
    ("sentence pieces", pieces),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read by the next."""
    configure(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)


#: Forests, surrogates and sampled pieces are beyond SQL.
ORACLE_SQL = None
