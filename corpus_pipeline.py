"""From raw documents to packed sequences: language, lines, near copies, source mix, packing.

All stages but the last return the columns of documents, whatever other columns there are and however these are named. Rows
are told apart by doc_id and text: null ids are ids of their own, the last ones, and one id may have several texts. Null
and empty texts are documents without lines and words. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import language, lines, mixing, packing, shingles
from quaver.llm.common import materialize, table

#: No SQL gives these rows: language models, fingerprints and byte-pair ids take part. tests/llm has a brute-force version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those known, told by text, declared language and source.

    Each row is judged by itself, repeated ones too, and stays as it is or goes. Without text, or with little of it, the
    declared language and the source decide.
    """
    name = "language"
    while name in docs.columns:
        name += "_"
    found = language.documents_identified(docs, language.fit(docs.select("doc_id", "text", "lang")), name)
    return found.where(F.col(f"{name}.accepted")).select(*[F.col(f"`{c}`") for c in docs.columns])


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document, or an earlier line, has too; n_chars follows the text.

    No row goes. Repeated rows are one document and lose the same lines. Lines of white space only stay; a null text stays
    null, with a null n_chars.
    """
    found = lines.without_repeated_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more.

    SimHash fingerprints of the same shingles propose copies, a prefix filter those whose fingerprints are too far apart.
    The smallest doc_id stays, of different texts of one id that with the least hash, of repeated rows one. Texts without
    words are one group, null texts among them.
    """
    return shingles.without_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the source mix takes them: some go, some are repeated, none more than three times.

    Rows that repeat an id and a size go or stay together. Documents without words have no size and are not taken; a null
    source is a source of its own.
    """
    return mixing.mixture(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token sequences. Every row is a document, repeated ones too; a null text is empty."""
    return packing.packed(docs)


STAGES = [
    ("language", known_language),
    ("lines", own_lines),
    ("near_copies", one_of_each),
    ("mix", source_mix),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
