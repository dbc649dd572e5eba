"""The corpus pipeline: stages that filter, clean and mix documents, and one that packs them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of ``docs``, whatever
their names; columns that a stage does not read pass through unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.llm import line_dedup, mixing, packing, simhash, toxic_crf
from seatwise.llm.common import quoted, read, stage
from seatwise.llm.queries import TOXIC

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from labelled documents of this stage's input.

    Null and empty texts have no toxic token and stay; repeated rows are judged alike; rows without an id
    are judged but not learnt from. Without toxic labels nothing is rejected. Long texts are scored whole.
    """
    model = toxic_crf.fit(docs, read(spark, sf_dir, "labels"))
    return toxic_crf.without_toxic(docs, model, TOXIC)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts less the lines that repeat an earlier one; ``n_chars``, if there, counts anew.

    Null texts stay null (and so does their ``n_chars``), empty ones empty; a document that loses all its
    lines stays, with an empty text. Rows that repeat id and text are one document and keep the same lines;
    of equal lines the first by id, then line number, stays; null ids come last. Long texts are split whole.
    """
    others = [c for c in docs.columns if c != "text"]
    own = F.struct(F.lit(True).alias("row"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)])
    rows = line_dedup.dedup(docs.select("doc_id", "text", own.alias("own")))
    columns = []
    for c in docs.columns:
        value = F.col("text") if c == "text" else F.col(f"own.c{others.index(c)}")
        if c == "n_chars":
            value = F.length("text").cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return rows.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that with the smallest id, null ids last.

    Null and empty texts have the fingerprint zero and are one group with all that are linked to it; of
    rows that repeat an id or tie otherwise one stays. Fingerprints are of whole texts.
    """
    return simhash.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for; a null source is one of its own.

    Null and empty texts have no words: they take no part of a target and go with the fraction that a
    source's hash order leaves out. Repeated rows are documents of their own; reruns give the same rows.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences; a null or empty text is its end token alone, a long one several pieces.

    Every row is packed, repeated ones and those without an id too; columns named like the result's play no part.
    """
    return packing.pack(docs, keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mix", mixture),
    ("packing", packed),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
