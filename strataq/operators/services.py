"""Side tables of an archive: tags, collections, favourites, projects, roots, skips, messages and logs.

Every function takes tables and gives the changed table or a listing; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, fold_name
from ..plans.shared import materialize
from .filters import prefix_filter
from .numbering import number_rows

#: Entries of a log's page at most, bodies of a message, entries of a capped log, and the
#: numbers that regions of an image have within its asset.
LOG_MAX, BODY_MAX, CAPPED, REGIONS, REGION_STEP = 500, 2000, 10_000, 5, 8


# Links of assets to names: tags, collections, favourites.


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """The links with new ones, each once (all columns are the key)."""
    return links.unionByName(new.select(*links.columns)).distinct()


def _without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that no row of gone equals in some columns, nulls included; dealt by a hash of them."""
    key = lambda df: F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    other = gone.select(key(gone).alias("__key"), *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)))
    same = F.col("__own") == F.col("__key")
    for i, c in enumerate(columns):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__{i}"))
    return rows.withColumn("__own", key(rows)).join(other, same, "left_anti").drop("__own")


def remove_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    """The links without those that agree in the columns of gone; nulls agree with nulls."""
    return _without(links, gone.distinct(), gone.columns)


def toggle_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Favourites: those named and not there are added, those named and there go."""
    fresh = ids.select(*links.columns).distinct()
    return _without(links, fresh, links.columns).unionByName(_without(fresh, links, links.columns))


def rename(names: DataFrame, old: str, new: str) -> DataFrame:
    """A name changed; a name that stands already, by folded letters, takes the old one's place."""
    other = F.when(fold_name(F.col("name")) == fold_name(F.lit(old)), F.lit(new)).otherwise(F.col("name"))
    return names.withColumn("name", other).distinct()


def add_named(dim: DataFrame, new: DataFrame) -> DataFrame:
    """A dimension (id, name, ...) with new names, numbered on by folded name; known names stay as they are."""
    fresh = new.withColumn("__k", fold_name(F.col("name"))).filter("__k <> ''").dropDuplicates(["__k"])
    fresh = fresh.join(dim.select(fold_name(F.col("name")).alias("__k")), "__k", "left_anti")
    top = dim.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return dim.unionByName(number_rows(fresh, ["__k"], "id", top + 1).drop("__k"), allowMissingColumns=True)


def drop_named(dim: DataFrame, ids: list[int], facts: DataFrame | None = None, column: str = "project_id") -> tuple[DataFrame, DataFrame | None]:
    """(dimension, facts) without some entries; facts that point to them point to nothing."""
    if facts is not None:
        facts = facts.withColumn(column, F.when(~F.col(column).isin(ids), F.col(column)))
    return dim.filter(~F.col("id").isin(ids)), facts


def assign(assets: DataFrame, ids: DataFrame, project: int | None) -> DataFrame:
    """Some assets put in a project (None: in none)."""
    hit = ids.select(F.col("id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
    joined = assets.join(hit, F.col("id") == F.col("__id"), "left")
    return joined.withColumn("project_id", F.when(F.col("__hit"), F.lit(project).cast("long")).otherwise(F.col("project_id"))).drop("__id", "__hit")


def set_flag(assets: DataFrame, ids: DataFrame, column: str, value: bool) -> DataFrame:
    """A flag, as the exclusion from retrieval, of some assets."""
    hit = ids.select(F.col("id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
    joined = assets.join(hit, F.col("id") == F.col("__id"), "left")
    return joined.withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.coalesce(F.col(column), F.lit(False)))).drop("__id", "__hit")


# Scanned roots.


def roots_with_counts(roots: DataFrame, assets: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Roots with the number of active assets below them and their tags, by name; a root is a path prefix.

    Roots are few; each asset meets those that its path begins with by the parts of its path, so nothing is
    compared with every root.
    """
    live = assets.filter("deleted_at is null") if "deleted_at" in assets.columns else assets
    parts = F.split(ascii_lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/"))), "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("__p")
    counts = live.select(above).groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    key = ascii_lower(F.rtrim(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), F.lit("/")))
    out = roots.join(counts, key == F.col("__p"), "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("__p")
    if tags is not None:
        named = tags.groupBy(F.col("root_id").alias("__r")).agg(F.array_sort(F.collect_set("name")).alias("tags"))
        out = out.join(named, F.col("id") == F.col("__r"), "left").drop("__r").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out.orderBy(ascii_lower(F.col("label")), "id")


def record_scan(roots: DataFrame, path: str, label: str, at: int) -> DataFrame:
    """A root with the time of its scan; a new one is added, a deleted one comes back."""
    same = ascii_lower(F.col("path")) == ascii_lower(F.lit(path))
    known = roots.filter(same)
    if known.isEmpty():
        top = roots.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = roots.sparkSession.createDataFrame([(top + 1, path, label, at)], "id long, path string, label string, scanned_at long")
        return roots.unionByName(fresh, allowMissingColumns=True)
    return roots.withColumns({"scanned_at": F.when(same, F.lit(at).cast("long")).otherwise(F.col("scanned_at")), "deleted_at": F.when(~same, F.col("deleted_at"))})


def set_root_state(roots: DataFrame, ids: list[int], at: int | None) -> DataFrame:
    """Roots put in the trash at a time, or (None) taken out again; others, and those already so, stay."""
    hit = F.col("id").isin(ids) & (F.col("deleted_at").isNull() if at is not None else F.col("deleted_at").isNotNull())
    return roots.withColumn("deleted_at", F.when(hit, F.lit(at).cast("long")).otherwise(F.col("deleted_at")))


def purge_roots(roots: DataFrame, tags: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(roots, tags) without some roots that are in the trash; active ones stay."""
    gone = roots.filter(F.col("id").isin(ids) & F.col("deleted_at").isNotNull()).select(F.col("id").alias("__id"))
    left = lambda df, c: df.join(gone, F.col(c) == F.col("__id"), "left_anti")
    return left(roots, "id"), left(tags, "root_id")


def group_roots(roots: DataFrame, ids: list[int], group: int | None) -> DataFrame:
    """Roots put in a group (None: in none)."""
    return roots.withColumn("group_id", F.when(F.col("id").isin(ids), F.lit(group).cast("long")).otherwise(F.col("group_id")))


def list_roots(roots: DataFrame, assets: DataFrame, trashed: bool = False, tags: DataFrame | None = None) -> DataFrame:
    """Active roots by name, or those in the trash, the last deleted first, with counts and tags."""
    if not trashed:
        return roots_with_counts(roots.filter("deleted_at is null"), assets, tags)
    return roots_with_counts(roots.filter("deleted_at is not null"), assets, tags).orderBy(F.desc("deleted_at"), F.desc("id"))


def path_exists(assets: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, known): whether an active asset has each path, ASCII case aside."""
    have = assets.filter("deleted_at is null").select(ascii_lower(F.col("path")).alias("__p")).distinct().withColumn("__hit", F.lit(True))
    return paths.join(have, ascii_lower(F.col("path")) == F.col("__p"), "left").select("path", F.coalesce("__hit", F.lit(False)).alias("known"))


def refile(assets: DataFrame, moves: DataFrame) -> DataFrame:
    """Assets with the new path, name and extension of (id, new_path); an occupied path moves nothing. Of several
    free paths for one asset the first in order is taken, and of several assets for one path the smallest."""
    moves = path_exists(assets, moves.select(F.col("new_path").alias("path")).distinct()).filter("not known").select(F.col("path").alias("new_path")).join(moves, "new_path")
    once = moves.groupBy("id").agg(F.min("new_path").alias("new_path")).groupBy("new_path").agg(F.min("id").alias("__id"))
    joined = assets.join(once, F.col("id") == F.col("__id"), "left")
    name = F.element_at(F.split("new_path", r"[/\\]"), -1)
    ext = F.nullif(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.lit(""))
    moved = F.col("new_path").isNotNull()
    return joined.withColumns({"file_name": F.when(moved, name).otherwise(F.col("file_name")), "ext": F.when(moved, ext).otherwise(F.col("ext")), "path": F.coalesce("new_path", "path")}).drop("new_path", "__id")


# Skips, derived indexes and what is pending.


def record_skips(skips: DataFrame, new: DataFrame) -> DataFrame:
    """Skips with new ones (asset_id, stage, reason), which replace those of their asset and stage."""
    return skips.join(new, ["asset_id", "stage"], "left_anti").unionByName(new.dropDuplicates(["asset_id", "stage"]).select(*skips.columns))


def clear_skips(skips: DataFrame, stage: str) -> DataFrame:
    return skips.filter(F.col("stage") != stage)


def pending_text(assets: DataFrame, body: DataFrame, vectors: DataFrame, after: int = 0, limit: int = 500) -> DataFrame:
    """(id, text): active assets without a vector, by id, with what is to be embedded: title, name and body."""
    rows = assets.filter(F.col("id") > after).filter("deleted_at is null").join(vectors.select(F.col("asset_id").alias("__v")), F.col("id") == F.col("__v"), "left_anti")
    joined = rows.join(body.select(F.col("asset_id").alias("__b"), "body"), F.col("id") == F.col("__b"), "left")
    text = F.concat_ws("\n", F.nullif("title", F.lit("")), "file_name", F.coalesce("body", F.lit("")))
    return joined.select("id", text.alias("text")).orderBy("id").limit(limit)


def region_ids(regions: DataFrame) -> DataFrame:
    """Region vectors (asset_id, region, ...) with the one number of asset and region."""
    return regions.filter(F.col("region").between(0, REGIONS - 1)).withColumn("id", F.col("asset_id") * REGION_STEP + F.col("region"))


def images_with_vectors(vectors: DataFrame) -> DataFrame:
    """(asset_id, regions): how many regions each asset has, from the numbers of its vectors."""
    return vectors.groupBy(F.expr(f"id div {REGION_STEP}").alias("asset_id")).agg(F.count_distinct("id").alias("regions"))


def pending_images(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Assets whose last region has no vector yet."""
    last = vectors.select(F.col("id").alias("__v"))
    return assets.join(last, F.col("id") * REGION_STEP + (REGIONS - 1) == F.col("__v"), "left_anti")


def thin_analyses(assets: DataFrame, metadata: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(id): assets with fewer than so many of some metadata keys filled; none counts as 0."""
    have = metadata.filter(F.col("key").isin(keys) & (F.coalesce("value_text", F.lit("")) != "")).groupBy("asset_id").agg(F.count_distinct("key").alias("n"))
    return assets.join(have, F.col("id") == F.col("asset_id"), "left").filter(F.coalesce("n", F.lit(0)) < least).select("id")


def backfill(metadata: DataFrame, assets: DataFrame, key: str, value: Column) -> DataFrame:
    """Metadata with a value of a key for the assets that have none; run again, it adds nothing."""
    have = metadata.filter(F.col("key") == key).select(F.col("asset_id").alias("__m")).distinct()
    fresh = assets.join(have, F.col("id") == F.col("__m"), "left_anti").select(F.col("id").alias("asset_id"), F.lit(key).alias("key"), value.cast("string").alias("value_text"))
    return metadata.unionByName(fresh.filter("value_text is not null"), allowMissingColumns=True)


def inventory(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(table, n): rows of each table; a table that is not there has none."""
    out = None
    for name, df in tables.items():
        if df is not None:
            n = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
            out = n if out is None else out.unionByName(n)
    spark = next(df for df in tables.values() if df is not None).sparkSession
    absent = spark.createDataFrame([(name, 0) for name, df in tables.items() if df is None], "table string, n long")
    return absent if out is None else out.unionByName(absent)


def reset_counts(indexes: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(empty indexes, (table, n) of what they held)."""
    return {name: df.limit(0) for name, df in indexes.items()}, inventory(indexes)


# Logs, messages and settings.


def log_page(log: DataFrame, limit: int, offset: int = 0, time: str = "ts") -> DataFrame:
    """The newest entries, then the greatest id; a limit of 0 or less gives none."""
    return log.orderBy(F.desc(time), F.desc("id")).offset(max(0, offset)).limit(max(0, min(limit, LOG_MAX)))


def trash(assets: DataFrame) -> DataFrame:
    """Deleted assets, the last deleted first."""
    return assets.filter("deleted_at is not null").orderBy(F.desc("deleted_at"), F.desc("id"))


def prune_before(log: DataFrame, at: int, time: str = "ts") -> DataFrame:
    return log.filter(F.col(time) >= at)


def capped(log: DataFrame, order: str, most: int = CAPPED) -> tuple[DataFrame, DataFrame]:
    """(the first entries, one row with how many more there are)."""
    dropped = F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("dropped")
    return log.orderBy(order).limit(most), log.agg(dropped)


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    fresh = meta.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return meta.filter(F.col("key") != key).unionByName(fresh)


def send_message(messages: DataFrame, sender: int, name: str, body: str, at: int) -> DataFrame:
    """Messages with a new one; its body is trimmed and must have some text, BODY_MAX characters at most."""
    body = body.strip()
    if not body or len(body) > BODY_MAX:
        raise ValueError(f"a message has 1 to {BODY_MAX} characters")
    top = messages.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return messages.unionByName(messages.sparkSession.createDataFrame([(top + 1, sender, name, body, at)], "id long, sender_id long, sender string, body string, created_at long"), allowMissingColumns=True)


def received(messages: DataFrame, reads: DataFrame, user: int, limit: int = 50) -> DataFrame:
    """Others' messages, newest first, and whether a user has read each (a join by message and user)."""
    own = reads.select(F.col("message_id").alias("__m"), F.col("user_id").alias("__u"), F.col("read_at"))
    joined = messages.filter(F.col("sender_id") != user).join(own, (F.col("id") == F.col("__m")) & (F.lit(user) == F.col("__u")), "left")
    return joined.withColumn("read", F.col("read_at").isNotNull()).drop("__m", "__u").orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, LOG_MAX)))


def resolve_message(messages: DataFrame, message: int, by: int, at: int) -> DataFrame:
    """A message marked as settled by a user; the first time stays."""
    open_ = (F.col("id") == message) & F.col("resolved_at").isNull()
    return messages.withColumns({"resolved_by": F.when(open_, F.lit(by).cast("long")).otherwise(F.col("resolved_by")), "resolved_at": F.when(open_, F.lit(at).cast("long")).otherwise(F.col("resolved_at"))})


def mark_read(reads: DataFrame, message: int, user: int, at: int) -> DataFrame:
    """Reads with one more; the first time stays."""
    fresh = reads.sparkSession.createDataFrame([(message, user, at)], "message_id long, user_id long, read_at long")
    return reads.unionByName(fresh.join(reads, ["message_id", "user_id"], "left_anti").select(*reads.columns))


def activate_archive(archives: DataFrame, name: str, colour: str | None, path: str, at: int) -> DataFrame:
    """A registry with a new archive; an active one of the same folded name is an error."""
    if not archives.filter(F.col("deleted_at").isNull() & (fold_name(F.col("name")) == fold_name(F.lit(name)))).isEmpty():
        raise ValueError("an archive has this name")
    top = archives.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = archives.sparkSession.createDataFrame([(top + 1, name, colour, path, at)], "id long, name string, colour string, path string, created_at long")
    return archives.unionByName(fresh, allowMissingColumns=True)


def change_archive(archives: DataFrame, archive: int, name: str | None = None, colour: str | None = None, deleted_at: int | None = None) -> DataFrame:
    """A registry with one archive renamed, of another colour, or put away; an active name is taken once."""
    if name is not None:
        other = archives.filter((F.col("id") != archive) & F.col("deleted_at").isNull() & (fold_name(F.col("name")) == fold_name(F.lit(name))))
        if not name.strip() or not other.isEmpty():
            raise ValueError("an archive has this name, or it is blank")
    values = {"name": name, "colour": colour, "deleted_at": deleted_at}
    hit = F.col("id") == archive
    return archives.withColumns({c: F.when(hit, F.lit(v).cast(archives.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def report_summaries(reports: DataFrame, lines: DataFrame, limit: int = 50) -> DataFrame:
    """Scan reports, newest first, with how many of their lines there are by kind: (…, lines map)."""
    newest = log_page(reports, limit)
    counts = lines.groupBy("report_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("report_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("lines"))  # a row a kind
    out = newest.join(counts, F.col("id") == F.col("report_id"), "left").drop("report_id")
    return out.withColumn("lines", F.coalesce("lines", F.create_map().cast("map<string,bigint>"))).orderBy(F.desc("ts"), F.desc("id"))


def path_sample(assets: DataFrame, n: int = 20) -> DataFrame:
    """The first paths of active assets, by id."""
    return assets.filter("deleted_at is null").orderBy("id").limit(max(1, n)).select("id", "path")


# Results in an order of their own.


def hydrate(ranked: DataFrame, rows: DataFrame, key: str, k: int) -> DataFrame:
    """The rows of a ranked list (id, score) that a filter left, in its order, k at most.

    The filter comes before the cut, so nothing has to be fetched beyond k and widened.
    """
    hits = ranked.select(F.col("id").alias("__id"), "score")
    return rows.join(hits, F.col(key) == F.col("__id")).drop("__id").orderBy(F.desc_nulls_last("score"), key).limit(k)


def timeline(relations: DataFrame, assets: DataFrame, asset: int, time: str = "modified_at") -> DataFrame:
    """The versions connected with one asset, itself included, by time.

    The closure is walked from the asset, a join a step; what a step finds is written, and the driver learns
    only whether it is empty.
    """
    both = relations.select("src", "dst").unionByName(relations.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edge = seen = materialize(assets.filter(F.col("id") == asset).select(F.col("id").alias("dst")), "timeline")
    while not edge.isEmpty():
        step = both.join(edge.select(F.col("dst").alias("src")), "src").select("dst").distinct().join(seen, "dst", "left_anti")
        edge = materialize(step, "timeline")
        seen = seen.unionByName(edge)
    return assets.join(seen, F.col("id") == F.col("dst"), "left_semi").orderBy(time, "id")


def under_roots(assets: DataFrame, prefixes: list[str]) -> Column:
    """Whether a path lies below any of some prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | prefix_filter(F.col("path"), p)
    return out
