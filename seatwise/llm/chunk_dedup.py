"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own last characters match a fixed pattern, so equal stretches of text are cut
alike wherever they stand. Each distinct chunk gets one identifier, checked against the bytes of all
chunks that carry it; a document is then the ordered list of its chunks' identifiers, and documents are
equal when their lists are. Texts move once, as chunks that are merged before the shuffle; everything
after compares identifiers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import least_row, lookup, row_ids, stage

#: A chunk ends after a space that follows one letter of each class, between the least and most length.
CUT = r"(?<=[adhlpté][eimnrs]\x20)"
LEAST, MOST = 512, 4096

#: Runs of white space other than one plain space.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalise(text: Column) -> Column:
    """Each run of white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text's chunks in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?{CUT}|.{{1,{most}}}"), F.lit(0))


def _identifier(chunk: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), chunk), F.xxhash64(chunk, F.lit(seed))


def _verified(texts: DataFrame, seed: int) -> bool:
    """Whether no identifier stands for two different chunks."""
    left, right = _identifier(F.col("chunk"), seed)
    distinct = (texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
                .select("chunk", left.alias("left"), right.alias("right")).distinct())
    clash = distinct.groupBy("left", "right").agg(F.count("*").alias("n")).filter("n > 1")
    return clash.isEmpty()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null and empty texts are equal to each other. Of equal texts the row with the smallest id stays; ids
    that are null come last, and of rows that repeat an id exactly one stays. An empty table gives an
    empty result; other columns of ``docs`` play no part.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("norm"))
    seed = 1
    while not _verified(texts, seed):
        seed += 1
    recipe = F.flatten(F.transform(chunks(F.col("norm")), lambda c: F.array(*_identifier(c, seed))))
    recipes = stage(row_ids(texts.select(
        "doc_id", recipe.alias("recipe"), F.sha2(F.col("norm"), 256).alias("text_sha256"))), "recipes")
    groups = (recipes.groupBy("recipe").agg(least_row("doc_id", "_row").alias("first"), F.count("*").alias("n"))
              .filter("n > 1"))
    found = lookup(recipes, groups, ["recipe"], F.col("_row"))
    return found.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("first._row") == F.col("_row"))).alias("kept"),
        "text_sha256")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
