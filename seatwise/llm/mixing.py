"""Mixing sources to target weights by capped water-filling.

Each source's target is the smaller of its cap (a number of epochs of its words) and its weight's share
at the water level; what the capped sources leave is dealt again to the others by weight until no
source is above its cap. A source's target is then taken as whole repetitions of all its documents and,
for the fraction, as documents in the order of a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.common import WORD, fresh_name, quoted, rank_small, row_ids, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"

#: Hash buckets in which a source's words are summed; only the bucket at the cut is ordered row by row.
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float, epochs: float = EPOCHS) -> DataFrame:
    """Adds ``target`` to (``source_size``, ``weight``): the capped shares of ``total``.

    One aggregate of two sums per round; only the water level leaves the table.
    """
    cap = epochs * F.col("source_size")
    level = 0.0
    while True:
        full = cap < F.lit(level) * F.col("weight")
        fixed, open_weight = sources.agg(
            F.sum(F.when(full, cap)).cast("double"), F.sum(F.when(~full, F.col("weight"))).cast("double")).first()
        if not open_weight:
            break
        new = (total - (fixed or 0.0)) / open_weight
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, repeats`` (and ``row``, from ``row_col``).

    ``size`` counts the words of the text (null: 0); ``taken`` is ``size`` times the repetitions that the
    mix holds. Sources in code point order, null (a source of its own) last, weigh ``weights`` in turn.
    A source without words has target 0. At most one document's words per source lie between what is
    taken and the target. Ties of the seeded hash are ordered by id and size, so repeated rows and reruns
    give the same rows. An empty table gives an empty result.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        *[F.col(c).alias("row") for c in [row_col] if c])
        .withColumn("key", key).withColumn("bucket", F.substring("key", 1, DIGITS)), "sizes")
    buckets = stage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = rank_small(buckets.groupBy("source").agg(F.sum("words").alias("source_size")),
                         F.col("source").isNull(), F.col("source"))
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = stage(sources.withColumn("weight", turn), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    plan = water_fill(sources, share * total, epochs)
    plan = (plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
            .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
            .select(F.col("source").alias("s"), "source_size", "target", "whole", "part"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = (buckets.withColumn("before", F.coalesce(before, F.lit(0)))
               .join(plan, F.col("source").eqNullSafe(F.col("s")))
               .withColumn("cut", (F.col("before") < F.col("part")) & (F.col("before") + F.col("words") > F.col("part")))
               .select("s", F.col("bucket").alias("k"), "source_size", "target", "whole", "part", "before", "cut"))
    placed = rows.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    here = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size")
    upto = F.col("before") + F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0))
    cut = placed.filter("cut").withColumn("more", (upto - F.col("size") / 2 <= F.col("part")).cast("int"))
    clear = placed.filter("not cut").withColumn("more", (F.col("before") < F.col("part")).cast("int"))
    return cut.unionByName(clear).select(
        "doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("more")) * F.col("size")).cast("long").alias("taken"),
        (F.col("whole") + F.col("more")).cast("int").alias("repeats"), *[c for c in ["row"] if row_col])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix holds it; see :func:`mix`."""
    number, copy = fresh_name(docs, "_row_number"), fresh_name(docs, "_copy")
    numbered = stage(row_ids(docs, number), "numbered")
    plan = mix(numbered, row_col=number, **options).filter("repeats > 0").select(F.col("row").alias(number), F.col("repeats").alias(copy))
    rows = numbered.join(plan, number).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    return rows.select(*[F.col(quoted(c)) for c in docs.columns])


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, {SHARE} * sum(source_size) OVER ()
            - coalesce(sum({EPOCHS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s WINDOW o AS (ORDER BY {EPOCHS} * source_size / weight, source NULLS LAST)),
l AS (
  SELECT coalesce(max(CAST(rest AS DOUBLE) / CAST(open_weight AS DOUBLE))
                  FILTER (CAST(rest AS DOUBLE) / CAST(open_weight AS DOUBLE) * weight <= {EPOCHS} * source_size), 0) AS level FROM f),
p AS (
  SELECT source, source_size, target, w AS whole, target - w * source_size AS part FROM (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS w FROM (
      SELECT source, source_size, least(CAST({EPOCHS} * source_size AS DOUBLE), level * weight) AS target FROM s, l))),
c AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN part > 0 AND upto - size / 2.0 <= part THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
"""
