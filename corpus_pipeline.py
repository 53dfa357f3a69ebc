"""A corpus from documents: toxic and poor ones go, one of each group of near copies stays, sources are mixed, tokens packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, and any other columns that docs has; the last returns the
pieces of the packed sequences with their ids. The near-duplicate stage takes shingles of five words and a similarity of
0.8 or more. Every stage takes rows that repeat, nulls in any column, empty and very long texts and empty tables; what
it makes of them its own text says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm.jaccard import deduplicated
from vitrine.llm.mixing import mixed
from vitrine.llm.packing import packed_sequences
from vitrine.llm.quality import good_documents
from vitrine.llm.storage import stored
from vitrine.llm.toxicity import clean_documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    A null or empty text scores as one without evidence and stays unless most labels are toxic; a long text is scored in
    all its windows; rows that repeat stay or go together; an empty table stays empty.
    """
    return clean_documents(docs, _labels(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the line labels reject go.

    A null, empty or short text fails the rules and goes; all lines of a long text are decoded; a share that ties with
    the limit stays; rows that repeat stay or go together; an empty table stays empty.
    """
    return good_documents(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Of rows that repeat one stays; a null, empty or wordless text, or a null doc_id, is linked with nothing and stays; a
    long text is one set of shingles; an empty table stays empty.
    """
    return deduplicated(docs, 5, 80, 100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, within the corpus's own token budget.

    A null source is one of its own; a null or empty text counts one token; rows of one source that share a doc_id, or
    have none, are taken together; an empty table stays empty.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their sequence and offset: doc_id, start, length, ids_crc32, doc_tokens, ids
    (little-endian unsigned 32-bit), sequence_id, offset.

    A null or empty text is its end id; every row is packed, also one that repeats; a long text is cut into pieces; an
    empty table gives no pieces. Other columns are left out.
    """
    return packed_sequences(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: The network, the random field and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
