"""A corpus pipeline: language, exact copies, near copies, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; all but the last return the columns of documents, whatever
else these hold. Rows that share an id are judged by their own texts. An empty
table goes through as one. Texts are taken whole, of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfabric.llm import exact_dedup, language, mixing, packing, similarity_join
from voxfabric.llm.common import drop_stored, stored, whole
from voxfabric.llm.queries import WEIGHTS, domain_of

#: A text stays if its language is at least this probable.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a known language; texts that are null or have no letter go.

    Further columns pass through, whatever their names; rows that repeat an id
    are judged one by one; an empty table gives an empty result.
    """
    model = language.train(language.training_rows(docs))
    packed = docs.select(whole(docs.drop("text"), "row"), "text")  # texts go to the tasks' Python once
    found = language.identify(packed, model).where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}")
    return found.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest id, and of rows that repeat that too, one.

    Null and empty texts are equal; null ids count as larger than any other;
    texts of any length are compared whole; an empty table gives an empty result.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by 0.8 of their five-word shingles, the row with the smallest id; of rows that share it, the first by words.

    Rows with null ids stay, and so do null and empty texts; a text of any
    length is compared by all its shingles; an empty table gives an empty result.
    """
    return similarity_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, dealt by WEIGHTS; no row twice.

    Null languages and sources are one of their own; null and empty texts have
    no tokens; rows of one id in a leaf stand or fall together, and rows of
    equal order go by id; texts of any length are counted whole; an empty
    table gives an empty result.
    """
    return mixing.mix(docs, domain_of(), WEIGHTS, fraction=(9, 10), max_epochs=1, seed=7, epoch=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 token ids, one row per piece of a document in a sequence.

    Null and empty texts are an end id; repeated ids and texts are packed like
    any other; a text of any length is encoded whole and cut where sequences
    end; an empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the language model or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            drop_stored(before)  # the next table no longer needs it
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
