"""Mixing sources to target weights by systematic sampling.  DataFrame functions only.

Each document of a source is expected to be copied ``target / source size``
times.  Documents stand in a fixed order within their source (by length class, then
pseudo-random); the expected copies are prefix-summed along it, one random
offset per source is added, and a document is emitted once for each integer
boundary that its step crosses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.llm.common import Scratch, pick

#: About so many rows of a bucket are ordered in one task.
BUCKET_ROWS = 20_000


def word_count(col: str = "text") -> F.Column:
    """Number of maximal runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _size_class(size: str) -> F.Column:
    """Steps of an eighth of an octave, as text that sorts like the sizes."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 2, 3), 3, "0"))


def targets(sources: DataFrame, most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Shares the total of ``source_size`` among sources by weight.

    ``sources`` has one row per source: ``source``, ``source_size``.  Sources in
    code point order, null last, weigh ``weights``, repeating.  No target is
    above ``most`` times its source's size; what is cut is shared among the
    others by weight until none is above: sources are capped in the order of
    size to weight while the common level exceeds their cap.  The windows are
    over sources, not documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.get(table, F.pmod(rank, F.lit(len(weights)))))
    s = s.withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "", most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), extra: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document.

    One row per row of ``df``: ``id_col``, ``source``, ``size`` (words),
    ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size), and
    the columns named in ``extra``.  Null and empty texts have size 0 and take 0
    words; null sources are one source, the last; within a length class the order is that of a hash
    of id; equal rows are interchangeable; a source of no words has
    target 0 and 0 copies; an empty table gives an empty table.  Reruns agree.

    Rows are ordered in buckets of source, length class and hash slice, so that
    a source with a third of all rows is dealt over many tasks; only the table
    of buckets is summed along each source.
    """
    keep = {f"extra_{i}": c for i, c in enumerate(extra)}
    rows = pick(df, id=id_col, text=text_col, source=source_col, **keep)
    rows = rows.select("id", "source", word_count().alias("size"), *keep)
    rows = rows.withColumn("mark", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("-"))).cast("binary")))
    rows = rows.withColumn("class", _size_class("size"))
    scratch = Scratch(df.sparkSession)
    lean = scratch.save(rows)
    # within a class the order is that of the hash, so that any prefix of it deals the class out and leaves the order as it is
    classes = lean.groupBy("source", "class").agg(F.count("*").alias("n"))
    digits = classes.agg(F.max(F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / BUCKET_ROWS) / F.log(F.lit(16.0)))).cast("int"))).first()[0] or 0  # one number: every class is cut alike, so that slices need no join
    lean = lean.withColumn("slice", F.substring("mark", 1, digits) if digits else F.lit(""))
    buckets = scratch.save(lean.groupBy("source", "class", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    goal = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), most, weights)
    along = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("-"))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    steps = buckets.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    steps = steps.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("slice").alias("l"), "before", "source_size", "target", start.alias("start"))
    within = Window.partitionBy("source", "class", "slice").orderBy("mark", "id", "size")
    placed = lean.withColumn("at", F.row_number().over(within))
    placed = placed.join(steps, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("slice") == F.col("l")))
    each = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    place = F.col("before") + F.col("at")
    copies = F.floor(F.col("start") + place * each) - F.floor(F.col("start") + (place - 1) * each)  # boundaries that the document's step crosses
    placed = placed.withColumn("copies", copies.cast("long"))
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(k).alias(c) for k, c in keep.items()])


#: DuckDB SQL of the mix's rows.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-')) AS mark
  FROM documents),
classed AS (
  SELECT *, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || rpad(substr(bin(size), 2, 3), 3, '0') AS class FROM sized),
sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, (CAST(SUM(source_size) OVER () AS DOUBLE) - coalesce(SUM(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / SUM(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
common AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, source LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, coalesce((SELECT level FROM common) * weight, cap)) END AS target FROM levels),
placed AS (
  SELECT c.*, g.source_size, g.target,
         row_number() OVER (PARTITION BY c.source ORDER BY c.class, c.mark, c.doc_id, c.size) AS place,
         CAST(CAST('0x' || substr(md5(coalesce(c.source, '-')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift,
         CASE WHEN g.source_size = 0 THEN 0.0 ELSE g.target / g.source_size END AS each
  FROM classed c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(floor(shift + place * each) - floor(shift + (place - 1) * each) AS BIGINT) * size AS taken
FROM placed
"""
