"""Building blocks that keep hot groups out of single tasks.

A window by ``group`` puts a whole group in one task. When one group may hold a third of all
rows these helpers cut it into slices of the order, work inside (group, slice), and carry only
one summary row per slice across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.session import cut_lineage


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A Python literal as a broadcast side: its size is the literal's."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. The rank filter becomes a partial limit before the
    shuffle, so a hot group sends at most ``k`` rows per map task."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


RUN_SLICES = 4096


#: Rows of a group that one task holds.
GROUP_ROWS = 100_000


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group, from map-side counts."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def ordered_slices(df: DataFrame, group: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Adds ``_slice``: rows in the order of group and order, cut into slices of about equal row count.

    Spark's range partitioner takes the cuts from a sample, by all these columns and, where they tie, by place; so a burst
    of one group, even at one instant, is cut like any other rows. Written once to the checkpoint folder, as a sample taken
    again would cut elsewhere. ``slices`` states a number. Without it the groups are counted first (a map-side aggregate): if
    none has more than ``GROUP_ROWS`` rows, each fits in a task as it is, and no column is added.
    """
    if slices is None and largest_group(df, group) <= GROUP_ROWS:
        return df
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*([slices] if slices else []), *group, *order, "_place")
    return cut_lineage(ranged.drop("_place").withColumn("_slice", F.spark_partition_id()))


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the group's rows up to each row, across slices (``ordered_slices``), if there are any.

    What the slices before hold enters each slice as one marker row that sorts first; a group has at most one row per slice
    in the window that sums them.
    """
    keys = list(group)
    if "_slice" not in df.columns:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(upto))
    rows = df.withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_m"))
    markers = totals.select(*keys, "_slice", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_v"), F.lit(0).alias("_real"))
    upto = Window.partitionBy(*keys, "_slice").orderBy("_real", *order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_real", F.lit(1)).unionByName(markers, allowMissingColumns=True)
    return both.withColumn(name, F.sum("_v").over(upto)).where("_real = 1").drop("_v", "_real")


def previous(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds ``prev_<value>``: the value of the group's previous row, across slices (``ordered_slices``), if there are any."""
    if "_slice" in df.columns:
        return sliced_lag(df, group, F.col("_slice"), order, values, keep_slice=True)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({f"prev_{v}": F.lag(v).over(w) for v in values})


def sliced_row_number(
    df: DataFrame, group: Sequence[str], slice_by: Column, order: Sequence[Column], name: str = "row_number"
) -> DataFrame:
    """Exact ``row_number`` over ``group`` ordered by (slice, order); slices are whole numbers that follow the order.

    Rows are numbered inside (group, slice); the offset is a running sum of slice sizes, a
    table with one row per slice.
    """
    keys = list(group)
    cut = df.withColumn("_slice", slice_by)
    sizes = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # Two levels of running sums: inside runs of slices, and over the runs, so neither window holds all slices.
    sizes = sizes.withColumn("_run", F.floor(F.col("_slice") / RUN_SLICES))
    runs = sizes.groupBy(*keys, "_run").agg(F.sum("_n").alias("_m"))
    upto = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_run", F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_base"))
    before = Window.partitionBy(*keys, "_run").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("_inner", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = inside.join(runs, [*keys, "_run"]).select(*keys, "_slice", (F.col("_base") + F.col("_inner")).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    return (
        cut.withColumn("_local", local)
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_slice", "_local", "_offset")
    )


def sliced_lag(
    df: DataFrame, group: Sequence[str], slice_by: Column, order: Sequence[str], values: Sequence[str], keep_slice: bool = False
) -> DataFrame:
    """Adds ``prev_<value>``: the value of the previous row of the group, across slices.

    The last row of every slice is an aggregate (combined on the map side); it is carried into
    the next non-empty slice as a marker row that sorts first and is dropped after the lag.
    """
    keys, order = list(group), list(order)
    cut = df.withColumn("_slice", slice_by)
    last = cut.groupBy(*keys, "_slice").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    )
    nxt = F.lead("_slice").over(Window.partitionBy(*keys).orderBy("_slice"))
    markers = (
        last.withColumn("_slice", nxt)
        .where(F.col("_slice").isNotNull())
        .select(*keys, "_slice", F.lit(0).alias("_real"), *[F.col("_last")[v].alias(v) for v in values])
    )
    rows = cut.withColumn("_real", F.lit(1)).unionByName(markers, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_real", *order)
    for v in values:
        rows = rows.withColumn(f"prev_{v}", F.lag(v).over(w))
    return rows.where(F.col("_real") == 1).drop("_real", *([] if keep_slice else ["_slice"]))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (), resolution: int = 4096
) -> DataFrame:
    """Exact interpolated quantiles without a full sort or a per-group value map.

    A monotone log scale on both sides of the approximate median, in units of the quartiles' distance so that no outlier
    sets it, assigns each value a histogram cell in constant time; cell counts combine on the map side and locate the cell of every wanted
    rank; only the rows of those cells are then ranked, after equal values collapsed to a
    count. One row per (group, prob) with ``quantile``.
    """
    keys = list(group)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        keys, data = ["_all"], data.withColumn("_all", F.lit(0))
    stats = data.groupBy(*keys).agg(
        F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", [0.25, 0.5, 0.75]).alias("_q")
    )
    low, middle, high = (F.get("_q", F.lit(i)) for i in range(3))
    unit = F.when(high > low, high - low).when(F.col("_max") > F.col("_min"), F.col("_max") - F.col("_min")).otherwise(1.0)
    above = F.floor(F.log1p((F.col("_v") - middle) / unit) * resolution)
    below = -F.floor(F.log1p((middle - F.col("_v")) / unit) * resolution) - 1
    cell = F.when(F.col("_v") >= middle, above).otherwise(below)
    tagged = data.join(stats, keys).select(*keys, "_v", cell.alias("_cell"))
    sizes = tagged.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_cell")
    spans = sizes.select(
        *keys,
        "_cell",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_lo"),
        F.sum("_n").over(upto).alias("_hi"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    wanted = (
        spans.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_pos", F.col("prob") * (F.col("_total") - 1))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    )
    counts = (
        tagged.join(wanted.select(*keys, "_cell").distinct(), [*keys, "_cell"], "left_semi")
        .groupBy(*keys, "_cell", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    run = Window.partitionBy(*keys, "_cell").orderBy("_v")
    placed = counts.withColumn("_end", F.sum("_c").over(run))
    inside = F.col("_rank") - F.col("_lo")
    found = wanted.join(placed, [*keys, "_cell"]).where(
        (inside < F.col("_end")) & (inside >= F.col("_end") - F.col("_c"))
    )
    out = found.groupBy(*keys, "prob").agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first("_pos").alias("_pos")
    )
    share = F.col("_pos") - F.floor("_pos")
    return out.select(
        *[k for k in keys if k != "_all"],
        "prob",
        (F.col("_low") + share * (F.col("_high") - F.col("_low"))).alias("quantile"),
    )
