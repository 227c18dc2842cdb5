"""Facets, dashboards, rollups and per-group choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parent_dir, root_of
from .numbering import number_rows

#: Bounds of a facet's length, and of a folder rollup's.
FACET_MAX, FOLDERS_MAX = 200, 1000


def facet(df: DataFrame, value: str | Column, limit: int | None = None, skip_empty: bool = False) -> DataFrame:
    """(value, n) by falling count, then value; null is a value unless skipped."""
    out = df.select((F.col(value) if isinstance(value, str) else value).alias("value"))
    if skip_empty:
        out = out.filter("value is not null and value != ''")
    out = out.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("value"))
    return out if limit is None else out.limit(max(1, min(limit, FACET_MAX)))


def multi_facet(df: DataFrame, key: str, value: Column, separator: str = ",", limit: int | None = None) -> DataFrame:
    """A facet over parts of a value, each counted once a row."""
    parts = F.array_distinct(F.filter(F.transform(F.split(value, separator), lambda p: F.trim(p)), lambda p: p != ""))
    return facet(df.select(key, F.explode(parts).alias("part")), "part", limit)


def zero_preserving(dim: DataFrame, fact: DataFrame, dim_key: str, fact_key: str, names: list[str]) -> DataFrame:
    """Facts a row of the dimension has, 0 included: the facts are counted before the join."""
    counts = fact.groupBy(F.col(fact_key).alias("__k")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, F.col(dim_key) == F.col("__k"), "left").select(*names, F.coalesce("n", F.lit(0)).alias("n"))


def month_histogram(df: DataFrame, at: Column, first_month: str) -> DataFrame:
    """(month, n) from a month on; months without rows are absent."""
    return df.filter(at >= F.lit(first_month).cast("date")).groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy("month")


def folder_rollup(df: DataFrame, path: Column, limit: int | None = FOLDERS_MAX, latest: Column | None = None) -> DataFrame:
    """(folder, n) by falling count, with the greatest value of latest if it is given; paths without a separator
    have no folder."""
    rows = df.select(parent_dir(path).alias("folder"), (F.lit(None) if latest is None else latest).alias("latest")).filter("folder is not null")
    more = [] if latest is None else [F.max("latest").alias("latest")]
    out = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), *more).orderBy(F.desc("n"), "folder")
    return out if limit is None else out.limit(limit)


def root_rollup(df: DataFrame, path: Column) -> DataFrame:
    return df.groupBy(root_of(path).alias("root")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root")


def common_prefix(df: DataFrame, path: str) -> DataFrame:
    """The longest prefix of all values: that of the least and the greatest."""
    ends = df.agg(F.min(path).alias("a"), F.max(path).alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.char_length("a"), F.char_length("b")), F.lit(1)), lambda i: F.expr("substring(a, 1, 0)").isNotNull() & (F.col("a").substr(F.lit(1), i) == F.col("b").substr(F.lit(1), i)))
    return ends.select(F.col("a").substr(F.lit(1), F.coalesce(F.array_max(same), F.lit(0))).alias("prefix"))


def activity_summary(events: DataFrame, at: str, since: Column, user: str, action: str) -> DataFrame:
    """(kind, key, n): the total, each user and each action since a time, in one pass."""
    base = events.filter(F.col(at) >= since).select(F.col(user).cast("string").alias("user"), F.col(action).alias("action"))
    kind = F.when(F.grouping("user") == 0, "user").when(F.grouping("action") == 0, "action").otherwise("total")
    return base.groupingSets([[F.col("user")], [F.col("action")], []], "user", "action").agg(kind.alias("kind"), F.count(F.lit(1)).alias("n")).select("kind", F.coalesce("user", "action").alias("key"), "n")


#: Users and actions that a summary names.
TOP_USERS, TOP_ACTIONS = 5, 6


def top_activity(events: DataFrame, at: str, since: Column, user: str, action: str) -> DataFrame:
    """(kind, key, n, place): the total since a time, the busiest users and the commonest actions."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))
    most = F.when(F.col("kind") == "user", TOP_USERS).when(F.col("kind") == "action", TOP_ACTIONS).otherwise(1)
    return activity_summary(events, at, since, user, action).withColumn("place", place).filter(F.col("place") <= most)


def winners(df: DataFrame, group: str, value: str, order: list[Column]) -> DataFrame:
    """The value with the greatest order tuple of each group."""
    return df.groupBy(group).agg(F.max_by(value, F.struct(*order)).alias(value))


def grid_clusters(df: DataFrame, x: Column, y: Column, cell: float) -> DataFrame:
    """Points by square cells: count and mean place."""
    return df.groupBy(F.floor(x / cell).alias("cell_x"), F.floor(y / cell).alias("cell_y")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def per_group_cap(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """At most n rows of each group, in an order."""
    return df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank_in_group") <= n)


def keep_newest(df: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """The first n rows of an order: a top-k, not a global sort."""
    return df.orderBy(*order).limit(n)


def reciprocal_ranks(lists: list[DataFrame], key: str, rank: str, k: int = 60) -> DataFrame:
    """Fuse ranked lists (rank from 1): the sum of 1 / (k + rank)."""
    union = lists[0].select(key, rank)
    for other in lists[1:]:
        union = union.unionByName(other.select(key, rank))
    return union.groupBy(key).agg(F.sum(1.0 / (k + F.col(rank))).alias("score"))


def stride_sample(df: DataFrame, order: str, percent: int) -> DataFrame:
    """Every ceil(100 / percent)-th row in an order; numbered by ranges, never in one task."""
    stride = -(-100 // max(1, min(percent, 100)))
    return number_rows(df, [order], "__nth").filter(F.col("__nth") % stride == 0).select(*df.columns)


def first_seen(df: DataFrame, group: str, rank: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(rank).alias(rank))
