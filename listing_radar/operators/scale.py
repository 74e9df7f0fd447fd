"""Plans that stay even when one key holds a large share of all rows.

Nothing here collects a group: groups are reduced with partial aggregation, and values computed per
group go back to the rows with a join that treats heavy keys apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from listing_radar.session import cut_lineage

HEAVY_ROWS = 1_000_000
SALTS = 1024
SMALL_ROWS = 50_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """One cheap action that looks at ``rows`` + 1 rows at most; meant for catalogs."""
    return df.limit(rows + 1).count() <= rows


def small_rows(df: DataFrame, rows: int = SMALL_ROWS) -> list[Row] | None:
    """The rows of a catalog of at most ``rows`` rows, None if it is larger."""
    found = df.limit(rows + 1).collect()
    return found if len(found) <= rows else None


def broadcast_if_small(df: DataFrame, size_of: DataFrame | None = None, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint after a size check; beyond it the join stays a shuffle join under AQE. ``size_of``
    is the catalog ``df`` was reduced from, if counting that is cheaper."""
    return F.broadcast(df) if is_small(df if size_of is None else size_of, rows) else df


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of every key in the given ascending order, by a map-side combined minimum."""
    columns = df.columns
    rest = [c for c in columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*columns)


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: Column) -> DataFrame:
    """First ``n`` rows of every key. ``spread`` (any row-unique expression) splits a heavy key first, so
    that no task ever ranks more than a slice of it; ranking the survivors of all slices is exact."""
    slices = Window.partitionBy(*keys, F.pmod(F.xxhash64(spread), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_r", F.row_number().over(slices))
        .where(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(whole))
        .where(F.col("_r") <= n)
        .drop("_r")
    )


def attach_group_values(
    df: DataFrame, groups: DataFrame, keys: list[str], rows: str, spread: Column, heavy_rows: int | None = HEAVY_ROWS
) -> DataFrame:
    """Left join of per-group values to the rows of the groups.

    ``groups`` has one row per key and the row count of the key in column ``rows``. Keys of at least
    ``heavy_rows`` rows are broadcast: there are at most total / heavy_rows of them. Their rows then go
    into the second join under a salted dummy key, so they spread over all partitions. None says that no key is heavy.
    """
    if heavy_rows is None:
        return df.join(groups, keys, "left").select(*df.columns, *[c for c in groups.columns if c not in keys])
    values = [c for c in groups.columns if c not in keys]
    heavy = groups.where(F.col(rows) >= heavy_rows).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_hv_{v}") for v in values]
    )
    light = groups.where(F.col(rows) < heavy_rows).select(
        *[F.col(k).alias(f"_l_{k}") for k in keys], F.lit(-1).cast("long").alias("_l_salt"),
        *[F.col(v).alias(f"_lv_{v}") for v in values],
    )
    out = df.join(F.broadcast(heavy), reduce(lambda a, b: a & b, [df[k] == heavy[f"_h_{k}"] for k in keys]), "left")
    is_heavy = F.col(f"_hv_{rows}").isNotNull()
    salt = F.when(is_heavy, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(-1).cast("long"))
    out = out.withColumn("_salt", salt)
    for k in keys:
        out = out.withColumn(f"_k_{k}", F.when(~is_heavy, F.col(k)))
    condition = reduce(lambda a, b: a & b, [F.col(f"_k_{k}") == F.col(f"_l_{k}") for k in keys])
    out = out.join(light, condition & (F.col("_salt") == F.col("_l_salt")), "left")
    return out.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.col(f"_hv_{v}"), F.col(f"_lv_{v}")).alias(v) for v in values],
    )


def join_unique(df: DataFrame, right: DataFrame, keys: list[str], spread: Column, heavy_rows: int | None = HEAVY_ROWS) -> DataFrame:
    """Left join to a table with one row per key, for a left side in which one key may be very frequent."""
    if heavy_rows is None:
        return df.join(right, keys, "left").select(*df.columns, *[c for c in right.columns if c not in keys])
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return attach_group_values(df, sizes.join(right, keys), keys, "_rows", spread, heavy_rows).drop("_rows")


def number_in_segments(df: DataFrame, keys: list[str], segment: Column, order: list[Column], name: str) -> DataFrame:
    """Row number per key, computed inside segments of the key and shifted by the sizes of the earlier ones.

    ``segment`` must not decrease along ``order`` within a key. A heavy key is split over its segments.
    """
    return _shifted(df, keys, segment, order, F.lit(1), name)


def running_sum_in_segments(
    df: DataFrame, keys: list[str], segment: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Running sum per key up to and including the row, by segments as in ``number_in_segments``."""
    return _shifted(df, keys, segment, order, value, name)


def _shifted(df: DataFrame, keys: list[str], segment: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    base = df.withColumn("_segment", segment)
    sizes = base.groupBy(*keys, "_segment").agg(F.sum(value).alias("_size"))
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    local = base.withColumn(name, F.sum(value).over(inside))
    joined = local.join(shift, [*keys, "_segment"], "left")
    return joined.withColumn(name, F.col(name) + F.col("_shift")).drop("_segment", "_shift")


def carry_forward(
    df: DataFrame, keys: list[str], segment: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Last non-null ``value`` up to and including the row, by segments as in ``number_in_segments``."""
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    base = df.withColumn("_segment", segment).withColumn("_value", value)
    ends = base.groupBy(*keys, "_segment").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end")
    )
    entry = ends.withColumn("_entry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    local = base.withColumn(name, F.last("_value", ignorenulls=True).over(inside))
    joined = local.join(entry, [*keys, "_segment"], "left")
    return joined.withColumn(name, F.coalesce(name, "_entry")).drop("_segment", "_value", "_entry")


def one_row(*rows: DataFrame) -> DataFrame:
    """Single-row frames side by side: stack them and keep the only value of every column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def place_in_order(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place of every row in a total order: ranges of the order are numbered apart and shifted by the earlier ones."""
    ranges = cut_lineage(df.repartitionByRange(*order).withColumn("_segment", F.spark_partition_id()))
    sizes = ranges.groupBy("_segment").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shift = sizes.select("_segment", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_segment").orderBy(*order))
    return ranges.withColumn(name, inside).join(shift, "_segment").withColumn(name, F.col(name) + F.col("_shift")).drop("_segment", "_shift")
