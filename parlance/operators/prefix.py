"""Running totals, ranks and quantiles that never sort a whole group in one task.

A plain window puts one group into one task; a stratum or a class may hold a third of
all rows. Here a group is first cut into buckets along its order. The totals of the
buckets form a small table whose running sum gives every bucket its offset, and the
window inside (group, bucket) finishes the job. Results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.features import seeded_order
from parlance.session import cut_lineage

# Rows up to which one plain window does.
SMALL_ROWS = 4096
# Hexadecimal digits of the md5 used as bucket: 4096 buckets of equal size per group.
HASH_DIGITS = 3


def _bucketed_prefix(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, bucket: Column
) -> DataFrame:
    """``before`` = sum of ``value`` over earlier rows, ``total`` = sum over the group.

    Group and bucket form one struct: null groups stay equal to themselves, and the
    window, the totals and the join all hash on the same column, so the rows move once.
    """
    parts = [F.col(g).alias(f"g{i}") for i, g in enumerate(group)]
    keyed = df.withColumn("_cell", F.struct(*parts, bucket.alias("bucket")))
    by_cell = keyed.groupBy("_cell").agg(F.sum(value).alias("_sum"))
    per_group = Window.partitionBy(*[f"_cell.g{i}" for i in range(len(group))])
    earlier = per_group.orderBy("_cell.bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_cell.select(
        "_cell",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(per_group).alias("total"),
    )
    inside = Window.partitionBy("_cell").orderBy(*order)
    local = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    located = keyed.withColumn("_local", F.coalesce(local, F.lit(0)))
    return (
        located.join(offsets, "_cell")
        .withColumn("before", F.col("_local") + F.col("_offset"))
        .drop("_cell", "_local", "_offset")
    )


def range_prefix(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Running total of ``value`` along ``order``, ascending, within ``group``.

    Adds ``before`` (exclusive running sum) and ``total``. Buckets are the partitions of a
    range exchange: Spark samples the splitters, and there are as many as the shuffle has
    partitions, whatever the size. The partitioned rows are written out, so that a bucket
    holds the same rows whenever it is read; buckets shape the work, never the result. A table
    of up to ``small`` rows is one plain window.
    """
    if df.limit(small + 1).count() <= small:
        whole = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)])
        earlier = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("total", F.sum(value).over(whole)).withColumn(
            "before", F.coalesce(F.sum(value).over(earlier), F.lit(0))
        )
    dealt = df.repartitionByRange(*[F.col(k) for k in (*group, *order)])
    placed = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    return _bucketed_prefix(placed, group, order, value, F.col("_part")).drop("_part")


def seeded_prefix(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    value: str,
    seed: int,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Running total of ``value`` in seeded random order within ``group``.

    The order is an md5, so its leading digits cut every group into equal buckets.
    """
    hashed = df.withColumn("_order", seeded_order(F.col(key), seed))
    bucket = F.substring("_order", 1, digits)
    return _bucketed_prefix(hashed, group, ["_order", key], value, bucket).drop("_order")


def seeded_rank(df: DataFrame, group: Sequence[str], key: str, seed: int) -> DataFrame:
    """``before`` = 0-based seeded rank within the group, ``total`` = group size."""
    return seeded_prefix(df.withColumn("_one", F.lit(1)), group, key, "_one", seed).drop("_one")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan of few splits over all cores; a scan with enough splits is left alone.

    Splitting text is work per byte, and a small file is a single split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def value_counts(df: DataFrame, feature: str, value: str, *sums: Column) -> DataFrame:
    """Rows per distinct (feature, value); map-side combined, so hot values are cheap."""
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(F.col(feature).alias("feature"), F.col(value).cast("double").alias("value"))
        .agg(F.count("*").alias("n"), *sums)
    )


def quantile_edges(counts: DataFrame, n_bins: int = 10) -> DataFrame:
    """Exact quantile edges per feature from ``(feature, value, n)``, linear rule.

    One row per feature: ``edges`` ascending without duplicates. A quantile that falls
    between two order statistics is interpolated; each statistic is the value whose rank
    range covers it, so nothing is gathered but the rows that cover an edge.
    """
    ranked = range_prefix(counts, ["feature"], ["value"], "n")
    last = (F.col("total") - 1).cast("double")
    steps = [i / n_bins for i in range(n_bins + 1)]
    positions = F.array(
        *[
            F.struct(F.lit(i).alias("i"), (last * F.lit(q)).alias("pos"))
            for i, q in enumerate(steps)
        ]
    )
    first, end = F.col("before"), F.col("before") + F.col("n")

    def covered(p: Column) -> Column:
        low, high = F.floor(p["pos"]), F.ceil(p["pos"])
        return ((low >= first) & (low < end)) | ((high >= first) & (high < end))

    hits = ranked.select(
        "feature", "value", "before", "n", F.explode(F.filter(positions, covered)).alias("p")
    )
    low, high = F.floor("p.pos"), F.ceil("p.pos")
    end = F.col("before") + F.col("n")
    a = F.max(F.when((low >= F.col("before")) & (low < end), F.col("value")))
    b = F.max(F.when((high >= F.col("before")) & (high < end), F.col("value")))
    edges = hits.groupBy("feature", F.col("p.i").alias("i")).agg(
        a.alias("a"), b.alias("b"), F.max(F.col("p.pos") - low).alias("t")
    )
    gap = F.col("b") - F.col("a")
    edge = F.when(F.col("t") < 0.5, F.col("a") + gap * F.col("t")).otherwise(
        F.col("b") - gap * (1 - F.col("t"))
    )
    return (
        edges.select("feature", edge.alias("edge"))
        .groupBy("feature")
        .agg(F.array_sort(F.collect_set("edge")).alias("edges"))
    )


def interval_index(value: Column, edges: Column) -> Column:
    """0-based index of the right-closed interval of ``edges``; the lowest edge is in it.

    Null when there is only one edge, that is when the column is constant.
    """
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    below = F.size(F.filter(inner, lambda e: e < value)).cast("long")
    return F.when(F.size(edges) > 1, below)


def with_bins(counts: DataFrame, n_bins: int = 10) -> DataFrame:
    """Add ``bin`` to ``(feature, value, n, …)``.

    ``feature`` holds column names, so the broadcast side has one row of at most
    ``n_bins + 1`` numbers per column of a table, whatever the number of rows.
    """
    edges = quantile_edges(counts, n_bins)
    return counts.join(F.broadcast(edges), "feature").withColumn(
        "bin", interval_index(F.col("value"), F.col("edges"))
    )
