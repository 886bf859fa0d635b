"""Mixing sources to target weights by weighted fair queueing (DataFrame only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymill.llm.common import WORD, materialise


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    size: Column,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Take documents so that each source gets its share of all tokens.

    Sources in code-point order, null last, weigh ``weights`` in turn. The budget
    is the sum of all sizes; a source's target is its share by weight, at most
    ``max_epochs`` times its own size, and what that leaves over goes to the others
    by weight until none is above. The documents of a source, shuffled by a hash of
    their id, queue up to ``max_epochs`` times; one that ends c tokens into its
    queue has the virtual finish time c / target. The queue of all sources in the
    order of that time (ties: hash, id, size) is cut where its tokens reach the budget.

    Returns ``id_col``, ``source_col``, size, source_size, target, taken (tokens,
    repeats counted). Every input row gives one row. Null text or no words: size 0,
    taken 0. Null ids share one place in the shuffle and are told apart by size;
    rows alike in all are interchangeable. Other columns, whatever their names, are
    ignored. An empty table gives no rows.

    Both queues, that of each source and that of all, are sorted globally by range and written; within a
    range a running sum, ahead of it the sums of the ranges before. So no task holds more than one range, however
    large a source is; what is counted over whole queues has a row for each range and source.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), size.cast("long").alias("size"), key.alias("h"))
    rows = _running(rows, [F.col("src").asc_nulls_first(), F.col("h").asc(), F.col("id").asc_nulls_first(), F.col("size").asc()], ["src"], "c", "mix-sizes")

    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    sources = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    cap = F.col("source_size") * max_epochs
    before = Window.orderBy((cap.cast("double") / F.col("w")).asc(), F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    # In this order the level rises while sources are capped and falls after: its maximum is the level of all that aren't.
    sources = sources.withColumn("level", left.cast("double") / weight_left.cast("double"))
    sources = sources.withColumn("target", F.least(cap.cast("double"), F.max("level").over(everything) * F.col("w")))
    sources = materialise(sources.select("src", "source_size", "target"), "mix-sources")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0

    same = F.col("l.src").eqNullSafe(F.col("r.src"))
    rows = rows.alias("l").join(sources.alias("r"), same).select("id", "l.src", "h", "size", "source_size", "target", "c")

    def finish(epoch: int) -> Column:
        return (F.col("c") + F.col("source_size") * epoch).cast("double") / F.when(F.col("target") > 0, F.col("target"))

    places = F.array(*[finish(e) for e in range(max_epochs)])
    queue = rows.where("size > 0 and target > 0").select("h", "id", "size", F.explode(places).alias("v"))
    rank = [F.col("v").asc(), F.col("h").asc(), F.col("id").asc_nulls_first(), F.col("size").asc()]
    queue = _running(queue, rank, [], "total", "mix-queue")
    cut = queue.where(F.col("total") > budget).orderBy(*rank).select("v", "h", "id", "size").first()
    taken = F.lit(max_epochs)
    if cut:
        behind = F.lit(False)
        for name, value in (("size", cut["size"]), ("id", cut["id"]), ("h", cut["h"])):
            column = F.col(name)
            if value is None:  # null ids come first
                behind = column.isNull() & behind
            else:
                value = F.lit(value)
                behind = F.coalesce(column < value, F.lit(True)) | (column.eqNullSafe(value) & behind)
        value = F.lit(cut["v"])
        taken = sum((F.when((p < value) | ((p == value) & behind), 1).otherwise(0) for p in map(finish, range(max_epochs))), F.lit(0))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("src").alias(source_col),
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.col("size") * taken).otherwise(0).cast("long").alias("taken"),
    )


def _running(rows: DataFrame, order: list[Column], by: list[str], name: str, table: str) -> DataFrame:
    """rows with the sum of sizes up to each, in a global order (within each value of ``by``), sorted by ranges and written."""
    ranged = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), table)
    inside = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("part", *by).agg(F.sum("size").alias("part_size"))
    # A row for each range (and source in it): of these a window over one key holds no more than there are ranges.
    ahead = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", *by, F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("ahead"))
    same = F.col("l.part") == F.col("r.part")
    for column in by:
        same = same & F.col(f"l.{column}").eqNullSafe(F.col(f"r.{column}"))
    summed = ranged.withColumn(name, F.sum("size").over(inside)).alias("l").join(F.broadcast(sums).alias("r") if not by else sums.alias("r"), same)
    return summed.select(*(f"l.{c}" for c in rows.columns), (F.col(name) + F.col("ahead")).alias(name))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed at weights 5, 2, 1 within 100 % of their words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0))::DOUBLE
          / (sum(w) OVER () - coalesce(sum(w) OVER p, 0))::DOUBLE AS lev
  FROM weighed
  WINDOW p AS (ORDER BY (3 * source_size)::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, (max(lev) OVER ()) * w) AS target FROM levels),
queued AS (
  SELECT s.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS c
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
places AS (
  SELECT doc_id, size, h, (c + source_size * e)::DOUBLE / target AS v
  FROM queued, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND target > 0),
cut AS (
  SELECT doc_id, sum(size) OVER (ORDER BY v, h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS total, size
  FROM places),
kept AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM cut WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN kept k ON q.doc_id IS NOT DISTINCT FROM k.doc_id
"""
