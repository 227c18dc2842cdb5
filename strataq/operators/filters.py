"""One composable filter over an asset table and its side tables, sorting and paging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, day_bounds

#: Page size by default and at most.
PAGE, PAGE_MAX = 50, 500


@dataclass
class ListOptions:
    """Values of one facet are alternatives; facets must all hold; an empty one asks nothing."""

    ext: list[str] = field(default_factory=list)
    client: list[str] = field(default_factory=list)
    approval: list[str] = field(default_factory=list)
    deadline_year: list[str] = field(default_factory=list)
    modified_after: int | None = None
    modified_before: int | None = None
    min_size: int | None = None
    max_size: int | None = None
    path_prefix: str | None = None
    favourite: bool = False
    tags: list[str] = field(default_factory=list)
    collection_id: int | None = None
    project_id: int | None = None
    metadata: dict[str, list[str]] = field(default_factory=dict)
    analysed: int | None = None  # 1: with a marker; 0: pending; None: all
    query: str | None = None  # of a full-text search
    fuzzy: bool = False
    fuzzy_last: bool = False


@dataclass
class Catalog:
    """An asset table and what hangs on it; column names may be bound to any table's."""

    assets: DataFrame
    metadata: DataFrame | None = None  # asset_id, key, value_text
    tags: DataFrame | None = None  # asset_id, name
    favourites: DataFrame | None = None  # asset_id
    collections: DataFrame | None = None  # asset_id, collection_id
    thumbnails: DataFrame | None = None  # asset_id
    skips: DataFrame | None = None  # asset_id, stage
    roles: dict[str, str] = field(default_factory=dict)  # role -> column, where they differ

    def col(self, role: str) -> Column:
        return F.col(self.roles.get(role, role))

    @property
    def active(self) -> DataFrame:
        name = self.roles.get("deleted_at", "deleted_at")
        return self.assets.filter(F.col(name).isNull()) if name in self.assets.columns else self.assets


def prefix_filter(c: Column, prefix: str) -> Column:
    """A literal prefix, ASCII case aside."""
    return F.startswith(ascii_lower(c), ascii_lower(F.lit(prefix)))


def date_range(c: Column, first: str | None, last: str | None) -> Column:
    """Epoch seconds within days given as YYYY-MM-DD; a bad date asks nothing."""
    low, high = day_bounds(F.lit(first))[0], day_bounds(F.lit(last))[1]
    return (low.isNull() | (c >= low)) & (high.isNull() | (c <= high))


def semi(df: DataFrame, side: DataFrame, key: str, side_key: str, how: str = "left_semi") -> DataFrame:
    side = side.select(F.col(side_key).alias("__side"))
    return df.join(side, F.col(key) == F.col("__side"), how)


def divide(df: DataFrame, metadata: DataFrame, wanted: dict[str, list[str]], key: str) -> DataFrame:
    """Rows that have, for every wanted key, any of its values."""
    wanted = {k: v for k, v in wanted.items() if v}
    if not wanted:
        return df
    any_of = None
    for k, values in wanted.items():
        one = (F.col("key") == k) & F.col("value_text").isin(values)
        any_of = one if any_of is None else any_of | one
    full = metadata.filter(any_of).groupBy("asset_id").agg(F.count_distinct("key").alias("n")).filter(F.col("n") == len(wanted))
    return semi(df, full, key, "asset_id")


def tri_state(df: DataFrame, catalog: Catalog, analysed: int | None, key: str) -> DataFrame:
    """1: marked as analysed. 0: neither marked nor failed nor skipped, and with a thumbnail."""
    if analysed is None:
        return df
    done = catalog.metadata.filter(F.col("key") == "ai_analyzed")
    if analysed:
        return semi(df, done, key, "asset_id")
    tried = catalog.metadata.filter(F.col("key").isin("ai_analyzed", "ai_attempt_failed"))
    df = semi(semi(df, tried, key, "asset_id", "left_anti"), catalog.thumbnails, key, "asset_id")
    return semi(df, catalog.skips.filter("stage = 'vision'"), key, "asset_id", "left_anti")


def apply_filters(catalog: Catalog, opts: ListOptions) -> DataFrame:
    """Active assets that meet the options; only options in use reach the plan."""
    df, c = catalog.active, catalog.col
    key = catalog.roles.get("id", "id")
    for role in ("ext", "client", "approval"):
        if values := getattr(opts, role):
            df = df.filter(c(role).isin(values))
    if opts.deadline_year:
        df = df.filter(F.substring(c("deadline"), 1, 4).isin(opts.deadline_year))
    bounds = (("modified_at", opts.modified_after, opts.modified_before), ("size_bytes", opts.min_size, opts.max_size))
    for role, low, high in bounds:
        if low is not None:
            df = df.filter(c(role) >= low)
        if high is not None:
            df = df.filter(c(role) <= high)
    if opts.path_prefix:
        df = df.filter(prefix_filter(c("path"), opts.path_prefix))
    if opts.project_id is not None:
        df = df.filter(c("project_id") == opts.project_id)
    if opts.favourite:
        df = semi(df, catalog.favourites, key, "asset_id")
    if opts.tags:
        df = semi(df, catalog.tags.filter(F.col("name").isin(opts.tags)), key, "asset_id")
    if opts.collection_id is not None:
        df = semi(df, catalog.collections.filter(F.col("collection_id") == opts.collection_id), key, "asset_id")
    if opts.metadata:
        df = divide(df, catalog.metadata, opts.metadata, key)
    return tri_state(df, catalog, opts.analysed, key)


#: Sort orders: role and whether it falls; all end by rising id.
#: Names fall in order of their small ASCII letters.
SORTS = {f"{role}_{way}": (column, way == "desc") for role, column in (("modified", "modified_at"), ("name", "file_name"), ("type", "ext"), ("size", "size_bytes"), ("created", "created_at"), ("path", "path")) for way in ("asc", "desc")}


def sort_by(df: DataFrame, catalog: Catalog, order: str) -> DataFrame:
    role, falls = SORTS[order]
    c = ascii_lower(catalog.col(role)) if role in ("file_name", "path") else catalog.col(role)
    return df.orderBy(c.desc() if falls else c.asc(), catalog.col("id"))


def page(df: DataFrame, number: int = 0, size: int = PAGE) -> tuple[DataFrame, Callable[[], int]]:
    """A page of sorted rows, and a function that counts all rows. For pages far on, keyset() reads less:
    an offset is a top-k of all rows up to the page's end."""
    size = PAGE if size <= 0 else min(size, PAGE_MAX)
    return df.offset(max(0, number) * size).limit(size), df.count


def keyset(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    return df.filter(F.col(key) > after).orderBy(key).limit(limit)


def asset_rows(catalog: Catalog, df: DataFrame) -> DataFrame:
    """Rows with a favourite flag and their metadata as sorted (key, value) pairs."""
    key = catalog.roles.get("id", "id")
    pairs = catalog.metadata.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("key", "value_text"))).alias("metadata"))
    liked = catalog.favourites.select("asset_id").distinct().withColumn("favourite", F.lit(True))
    out = df.join(pairs.withColumnRenamed("asset_id", "__a"), F.col(key) == F.col("__a"), "left").join(liked.withColumnRenamed("asset_id", "__b"), F.col(key) == F.col("__b"), "left")
    return out.drop("__a", "__b").withColumn("favourite", F.coalesce("favourite", F.lit(False)))


def pivot_metadata(metadata: DataFrame, keys: list[str]) -> DataFrame:
    """A column for each of some keys."""
    return metadata.groupBy("asset_id").pivot("key", keys).agg(F.first("value_text"))
