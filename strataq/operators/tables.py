"""Changes to tables, snapshots of them, and a journal to undo and redo by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Source rows over target rows of equal keys; columns in keep stay as the target has them."""
    s = source.select(*(F.col(c).alias(f"__{c}") for c in source.columns), F.lit(True).alias("__hit"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = target.withColumn("__old", F.lit(True)).join(s, on, "full_outer")

    def pick(c: str) -> Column:
        if f"__{c}" not in joined.columns:
            return F.col(c)
        wins = F.col("__hit").isNotNull() & (F.col("__old").isNull() if c in keep else F.lit(True))
        return F.when(wins, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*(pick(c) for c in target.columns))


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows of new keys appended; the first of equal ones."""
    fresh = source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def replace_set(target: DataFrame, source: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """All rows of the source's keys replaced by the source's; rows that meet keep stay."""
    gone = target.join(source.select(key).distinct(), key, "left_semi")
    rest = target.join(source.select(key).distinct(), key, "left_anti")
    out = rest.unionByName(source, allowMissingColumns=True)
    return out if keep is None else out.unionByName(gone.filter(keep))


def set_deleted(assets: DataFrame, ids: DataFrame, at: int | None) -> DataFrame:
    """Soft delete (at) or restore (None), only where that changes the state."""
    hit = ids.select(F.col("id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
    changes = F.col("__hit").isNotNull() & (F.col("deleted_at").isNull() if at is not None else F.col("deleted_at").isNotNull())
    return assets.join(hit, F.col("id") == F.col("__id"), "left").withColumn("deleted_at", F.when(changes, F.lit(at).cast("long")).otherwise(F.col("deleted_at"))).drop("__id", "__hit")


def purge(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of some assets."""
    return {n: df.join(ids.select(F.col("id").alias("__id")), F.col(c) == F.col("__id"), "left_anti") for n, (df, c) in tables.items()}


#: States of approval.
APPROVAL = ["draft", "review", "approved", "rejected"]


def patch(df: DataFrame, ids: list[int], values: dict[str, object]) -> DataFrame:
    """Set the given columns (None: null) of some rows; others stay."""
    if values.get("approval_status") not in (None, *APPROVAL):
        raise ValueError("unknown approval status")
    hit = F.col("id").isin(ids)
    return df.withColumns({c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def append_newest(log: DataFrame, rows: DataFrame, keep: int | None = None) -> DataFrame:
    out = log.unionByName(rows, allowMissingColumns=True)
    return out if keep is None else out.orderBy(F.desc("id")).limit(keep)


# Snapshots and the journal of changes: plain tables, written and joined by Spark.


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Write every table to a folder of its own below a new folder."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")


#: Fixed value: the schema that this library writes.
VERSION = 1


def export_archive(tables: dict[str, DataFrame], folder: str, archive_id: str, at: int) -> DataFrame:
    """A snapshot with a manifest (id, version, exported_at, names, counts) beside its tables, written last; gives the manifest."""
    snapshot(tables, folder)
    spark = next(iter(tables.values())).sparkSession
    counts = {name: spark.read.parquet(f"{folder}/{name}").count() for name in tables}  # of the written files' footers
    rows = [(archive_id, VERSION, at, sorted(tables), counts)]
    manifest = spark.createDataFrame(rows, "id string, version int, exported_at long, names array<string>, counts map<string,long>").coalesce(1)
    manifest.write.json(f"{folder}/_manifest.json")
    return manifest


def peek(spark: SparkSession, folder: str) -> dict:
    """An export's manifest; its tables are not read. An error if the export is not whole."""
    found = spark.read.schema("id string, version int, exported_at long, names array<string>, counts map<string,long>").json(f"{folder}/_manifest.json").first()
    if found is None:
        raise ValueError("the export has no manifest")
    return found.asDict()


def import_archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an export; an error if it is newer than this library, or a table has lost rows."""
    manifest = peek(spark, folder)
    if manifest["version"] > VERSION:
        raise ValueError(f"the export has schema {manifest['version']}, newer than {VERSION}")
    found = restore(spark, folder, manifest["names"])
    for name, df in found.items():
        if df.count() != manifest["counts"][name]:
            raise ValueError(f"table {name} is not whole")
    return found


def flag_changes(df: DataFrame, ids: DataFrame, column: str, value: object) -> DataFrame:
    """(id): those of some ids whose row has another value in a column, so that setting it changes something."""
    rows = df.select("id", F.col(column).alias("__now")).join(ids.select("id").distinct(), "id", "left_semi")
    return rows.filter(~F.col("__now").eqNullSafe(F.lit(value).cast(df.schema[column].dataType))).select("id")


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a snapshot."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def upgrade(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """A table brought to a schema: new columns are null, types are cast."""
    from .archive import read_legacy

    return read_legacy(df, schema)


#: Fixed value: steps that can be undone.
JOURNAL_STEPS = 50


def changes(before: DataFrame, after: DataFrame, key: str, step: int) -> DataFrame:
    """(step, key, before, after): the rows that a step changed, with both of their states (null: no row)."""
    old = before.select(F.col(key).alias("key"), F.struct(*before.columns).alias("before"))
    new = after.select(F.col(key).alias("key"), F.struct(*before.columns).alias("after"))
    both = old.join(new, "key", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return both.select(F.lit(step).alias("step"), "key", "before", "after")


def record(journal: DataFrame, change: DataFrame, step: int) -> DataFrame:
    """The journal with a step in place of it and all later ones (which can no longer be redone)."""
    return journal.filter((F.col("step") < step) & (F.col("step") > step - JOURNAL_STEPS)).unionByName(change)


def undo(table: DataFrame, journal: DataFrame, key: str, step: int) -> DataFrame:
    """The table before a step; undoing step after step goes back through the journal."""
    return _as(table, journal.filter(F.col("step") == step), key, "before")


def redo(table: DataFrame, journal: DataFrame, key: str, step: int) -> DataFrame:
    return _as(table, journal.filter(F.col("step") == step), key, "after")


def _as(table: DataFrame, change: DataFrame, key: str, state: str) -> DataFrame:
    kept = table.join(change.select(F.col("key").alias(key)), key, "left_anti").select(*table.columns)
    return kept.unionByName(change.filter(F.col(state).isNotNull()).select(*(F.col(f"{state}.{c}").alias(c) for c in table.columns)))
