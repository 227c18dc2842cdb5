"""Operations on whole archives: preview, merge, extract, import and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import prefix_filter
from .numbering import number_rows


def merge_preview(target: DataFrame, source: DataFrame) -> DataFrame:
    """One row: rows of the source, those whose path the target has, and those with a known hash."""
    paths = target.select(F.col("path").alias("__p")).distinct()
    hashes = target.filter("content_hash is not null").select(F.col("content_hash").alias("__h")).distinct()
    rows = source.join(paths, F.col("path") == F.col("__p"), "left").join(hashes, F.col("content_hash") == F.col("__h"), "left")
    conflict = F.col("__p").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(conflict).alias("path_conflicts"), F.count_if(~conflict & F.col("__h").isNotNull()).alias("hash_duplicates"))


def check_merge(target: dict, source: dict) -> None:
    """An error if two archives (id, version) are one, or if the source's schema is newer than the target's."""
    if target["id"] == source["id"]:
        raise ValueError("an archive is not merged with itself")
    if source["version"] > target["version"]:
        raise ValueError(f"the source has schema {source['version']}, newer than {target['version']}")


def merge_assets(target: DataFrame, source: DataFrame, import_duplicates: bool = False, remap: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(assets, id map): the target with the source's new rows.

    A path that the target has is skipped, so is a known hash unless duplicates are imported. New rows
    get ids above the target's, by path. The map (source id, target id) rewrites side tables.
    """
    from ..functions.text import remap_prefix

    if remap:
        source = source.withColumn("path", remap_prefix(F.col("path"), *remap))
    fresh = source.join(target.select("path"), "path", "left_anti")
    if not import_duplicates:
        fresh = fresh.join(target.filter("content_hash is not null").select("content_hash"), "content_hash", "left_anti")
    top = target.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = number_rows(fresh.withColumnRenamed("id", "__old"), ["path"], "id", top + 1)
    return target.unionByName(numbered.drop("__old"), allowMissingColumns=True), numbered.select(F.col("__old").alias("old_id"), F.col("id").alias("new_id"))


def remap_side(side: DataFrame, id_map: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a side table whose ids all merged, with new ids."""
    for c in columns:
        m = id_map.select(F.col("old_id").alias(c), F.col("new_id").alias("__new"))
        side = side.join(m, c).drop(c).withColumnRenamed("__new", c)
    return side


def reconcile_names(target: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dimension, id map): names of the target kept, new ones of the source numbered on."""
    fresh = source.join(target.select("name"), "name", "left_anti").dropDuplicates(["name"])
    top = target.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = number_rows(fresh.drop("id"), ["name"], "id", top + 1)
    full = target.unionByName(added, allowMissingColumns=True)
    ids = source.select("name", F.col("id").alias("old_id")).join(full.select("name", F.col("id").alias("new_id")), "name")
    return full, ids.select("old_id", "new_id")


def extract_subset(tables: dict[str, DataFrame], ids: DataFrame, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Every table with only rows whose asset columns are all among ids (column id)."""
    out = {}
    for name, df in tables.items():
        for c in keys.get(name, []):
            df = df.join(ids.select(F.col("id").alias("__id")), F.col(c) == F.col("__id"), "left_semi")
        out[name] = df
    return out


def missing_paths(catalog: DataFrame, scanned: DataFrame, prefix: str, reachable: bool = True) -> DataFrame:
    """Catalogued paths below a root that a scan did not find; none if the root was out of reach or empty."""
    if not reachable or scanned.isEmpty():
        return catalog.limit(0)
    return catalog.filter(F.startswith("path", F.lit(prefix))).join(scanned.select("path"), "path", "left_anti")


def orphans(tables: dict[str, tuple[DataFrame, str]], assets: DataFrame) -> DataFrame:
    """(table, n): rows of each table whose asset is gone."""
    out = None
    for name, (df, column) in tables.items():
        n = df.join(assets.select(F.col("id").alias("__id")), F.col(column) == F.col("__id"), "left_anti").agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def staleness(catalog: DataFrame, listing: DataFrame, tolerance: int = 2, offline: list[str] = []) -> DataFrame:  # noqa: B006
    """(path, state): fresh, stale (its time differs by more than the tolerance), offline (missing, below a root
    that is out of reach) or missing."""
    away = F.lit(False)
    for root in offline:
        away = away | prefix_filter(F.col("path"), root)
    found = listing.select(F.col("path").alias("__p"), F.col("modified_at").alias("__m"))
    state = F.when(F.col("__p").isNull() & away, "offline").when(F.col("__p").isNull(), "missing").when(F.abs(F.col("__m") - F.col("modified_at")) > tolerance, "stale").otherwise("fresh")
    return catalog.join(found, F.col("path") == F.col("__p"), "left").select("path", state.alias("state"))


def auto_projects(assets: DataFrame, projects: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(assets, projects): the first folder below a root names the project of assets without one."""
    import re

    name = F.nullif(F.regexp_extract("path", "(?i)^" + re.escape(root.rstrip("/\\")) + r"[/\\]([^/\\]+)[/\\]", 1), F.lit(""))
    named = assets.withColumn("__name", F.when(F.col("project_id").isNull(), name))
    fresh = named.filter("__name is not null").select(F.col("__name").alias("name")).distinct().withColumn("id", F.lit(None).cast("long"))
    full, _ = reconcile_names(projects, fresh)
    ids = full.select(F.col("name").alias("__name"), F.col("id").alias("__pid"))
    return named.join(ids, "__name", "left").withColumn("project_id", F.coalesce("project_id", "__pid")).drop("__name", "__pid"), full


def read_legacy(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """An older archive's rows with all wanted columns (name -> type); missing ones are null."""
    return df.select(*((F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()))
