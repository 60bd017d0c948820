"""Recursive unions with set semantics, as-of and range joins, counts of inequality joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.session import checkpoint


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """``WITH RECURSIVE ... UNION``: rows are added until a round brings none that
    are new.  Each round's new rows are checkpointed, which cuts the lineage."""
    every = new = checkpoint(seed.distinct())
    for _ in range(most_rounds):
        new = checkpoint(step(new).distinct().exceptAll(every))
        if new.isEmpty():
            return every
        every = every.unionByName(new)
    raise RuntimeError(f"the recursion didn't end in {most_rounds} rounds")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str) -> DataFrame:
    """Each left row with the last right row of its key at or before its time:
    one union and one window instead of a range join."""
    values = [c for c in right.columns if c not in by]
    marked = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_r"))
    other = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(marked.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    back = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marked.unionByName(other).withColumn("_r", F.last("_r", ignorenulls=True).over(back)).where("_side = 1")
    return found.select("_l.*", *[F.col("_r")[v].alias(v if v not in left.columns else f"{v}_right") for v in values])


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with ``low <= value < high``: values and ranges meet in bins of ``width``, an equality join that Spark can deal out."""
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    ranged = right.withColumn("_bin", F.explode(bins))
    return left.withColumn("_bin", F.floor(F.col(value) / width)).join(ranged, "_bin").where(_within(value, low, high)).drop("_bin")


def _within(value: str, low: str, high: str) -> Column:
    return (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))


#: Stretches of values that ``with_matches`` sums apart, a power of two, and how many values it draws to find them.
STRETCHES, DRAWN = 256, 4096


def with_matches(left: DataFrame, right: DataFrame, left_value: Column, op: str, right_value: Column) -> DataFrame:
    """Left rows with ``_theta_matches``, the number of right rows for which ``left_value op right_value``
    holds; rows without any are left out.  The pairs are not made: both sides' distinct values are summed
    up in order, stretch by stretch, and each left row looks up its value.  Values are of one type that
    Spark can order and group.  Stretches are dealt out by values drawn by hash, the same ones each time.
    """
    left = left.select("*", left_value.alias("_theta_left"))
    asked = left.select(F.col("_theta_left").alias("v"), F.lit(True).alias("asked"), F.lit(0).cast("long").alias("n"))
    given = right.select(right_value.alias("v"), F.lit(False).alias("asked"), F.lit(1).cast("long").alias("n"))
    # the second filter holds for every row: with both columns in use, all readers share one shuffle
    every = asked.unionByName(given).where("v IS NOT NULL").groupBy("v").agg(F.bool_or("asked").alias("asked"), F.sum("n").alias("n")).where("asked OR n > 0")
    drawn = every.groupBy(F.pmod(F.xxhash64("v"), F.lit(DRAWN))).agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v"))["v"].alias("v")).agg(F.array_sort(F.collect_list("v")).alias("v"))
    cuts = drawn.select(F.transform(F.sequence(F.lit(1), F.lit(STRETCHES - 1)), lambda k: F.get("v", F.floor(k * F.size("v") / STRETCHES).cast("int"))).alias("cuts"))
    steps = F.array(*[F.lit(STRETCHES >> k) for k in range(1, STRETCHES.bit_length())])
    stretch = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.col("v") > F.get("cuts", at + step - 1), step).otherwise(0))
    dealt = every.crossJoin(F.broadcast(cuts)).select("v", "asked", "n", stretch.alias("stretch"))
    sums = dealt.groupBy("stretch").agg(F.sum("n").alias("n"))
    sums = sums.select("stretch", (F.sum("n").over(Window.orderBy("stretch")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("stretch").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = {">=": upto, ">": upto - F.col("n"), "<": F.col("total") - upto, "<=": F.col("total") - upto + F.col("n")}[op]
    counts = dealt.join(F.broadcast(sums), "stretch").select(F.col("v").alias("_theta_value"), "asked", found.alias("_theta_matches")).where("asked AND _theta_matches > 0").drop("asked")
    return left.join(counts, F.col("_theta_left") == F.col("_theta_value")).drop("_theta_left", "_theta_value")
