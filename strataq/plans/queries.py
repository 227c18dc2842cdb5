"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, contours, text, vectors
from ..operators import aggregates, chunking, classify, duplicates, filters, fulltext, geo, graph, shapes, similarity
from ..operators.filters import Catalog, ListOptions

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Catalog:
    """Documents as assets: language as extension, source as client, length as size."""
    labels = _t(spark, sf_dir, "labels")
    pairs = labels.select(F.col("doc_id").alias("asset_id"), F.expr("stack(2, 'quality', cast(quality as string), 'toxic', cast(toxic as string)) as (key, value_text)"))
    return Catalog(_t(spark, sf_dir, "documents"), metadata=pairs, roles={"id": "doc_id", "ext": "lang", "client": "source", "size_bytes": "n_chars"})


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en','de') AND n_chars BETWEEN 200 AND 5000 ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50")
def list_filter_page(spark, sf):
    catalog = documents(spark, sf)
    found = filters.apply_filters(catalog, ListOptions(ext=["en", "de"], min_size=200, max_size=5000))
    rows, _ = filters.page(filters.sort_by(found, catalog, "size_desc"), 1, 50)
    return rows.select("doc_id", "lang", "source", "n_chars")


@query("SELECT count(*) AS total FROM documents WHERE lang IN ('en','de') AND n_chars BETWEEN 200 AND 5000")
def list_filter_total(spark, sf):
    return filters.apply_filters(documents(spark, sf), ListOptions(ext=["en", "de"], min_size=200, max_size=5000)).agg(F.count(F.lit(1)).alias("total"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), lower('B'))")
def filter_prefix(spark, sf):
    return _t(spark, sf, "part").filter(filters.prefix_filter(F.col("p_name"), "B")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def filter_semi(spark, sf):
    return filters.semi(_t(spark, sf, "customer"), _t(spark, sf, "orders").filter("o_totalprice > 100000"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def filter_anti(spark, sf):
    return filters.semi(_t(spark, sf, "customer"), _t(spark, sf, "orders").filter("o_totalprice > 400000"), "c_custkey", "o_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-12-31 23:59:59'")
def filter_date_range(spark, sf):
    at = F.col("o_orderdate").cast("timestamp").cast("long")
    return _t(spark, sf, "orders").filter(filters.date_range(at, "1995-01-01", "1995-12-31")).select("o_orderkey")


@query("SELECT doc_id FROM (SELECT doc_id, 'quality' AS k, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) WHERE (k='quality' AND v=1) OR (k='toxic' AND v=0) GROUP BY doc_id HAVING count(DISTINCT k)=2")
def eav_division(spark, sf):
    catalog = documents(spark, sf)
    return filters.apply_filters(catalog, ListOptions(metadata={"quality": ["1"], "toxic": ["0"], "empty": []})).select("doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id AND quality=1) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id AND toxic=1) AND EXISTS (SELECT 1 FROM documents t WHERE t.doc_id=d.doc_id AND t.n_chars>500)")
def tri_state_pending(spark, sf):
    catalog, labels = documents(spark, sf), _t(spark, sf, "labels")
    catalog.metadata = labels.filter("quality = 1").select(F.col("doc_id").alias("asset_id"), F.lit("ai_analyzed").alias("key"))
    catalog.skips = labels.filter("toxic = 1").select(F.col("doc_id").alias("asset_id"), F.lit("vision").alias("stage"))
    catalog.thumbnails = catalog.assets.filter("n_chars > 500").select(F.col("doc_id").alias("asset_id"))
    return filters.apply_filters(catalog, ListOptions(analysed=0)).select("doc_id")


@query("SELECT d.doc_id, max(CASE WHEN l.doc_id IS NOT NULL THEN CAST(quality AS VARCHAR) END) AS quality, max(CASE WHEN l.doc_id IS NOT NULL THEN CAST(toxic AS VARCHAR) END) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id GROUP BY d.doc_id")
def eav_pivot(spark, sf):
    catalog = documents(spark, sf)
    wide = filters.pivot_metadata(catalog.metadata, ["quality", "toxic"])
    return catalog.assets.join(wide, F.col("doc_id") == F.col("asset_id"), "left").select("doc_id", "quality", "toxic").distinct()


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def facet_count(spark, sf):
    return aggregates.facet(_t(spark, sf, "documents"), "lang")


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY source ORDER BY n DESC, value LIMIT 12")
def facet_top_n(spark, sf):
    return aggregates.facet(_t(spark, sf, "documents"), "source", 12, skip_empty=True)


@query("SELECT strftime(o_orderdate, '%Y') AS value, count(*) AS n FROM orders GROUP BY 1")
def facet_substr_year(spark, sf):
    return aggregates.facet(_t(spark, sf, "orders"), F.substring(F.col("o_orderdate").cast("string"), 1, 4))


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1, 2")
def facet_zero_preserving(spark, sf):
    return aggregates.zero_preserving(_t(spark, sf, "customer"), _t(spark, sf, "orders"), "c_custkey", "o_custkey", ["c_custkey", "c_name"])


@query("SELECT o_orderkey, count(l_linenumber) AS n, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey AND l_returnflag='R' GROUP BY 1")
def left_on_predicate(spark, sf):
    lines = _t(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), F.sum("l_quantity").alias("quantity"))
    joined = _t(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("quantity", F.lit(0.0)), 2).alias("quantity"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1 ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, 1")
def case_ordered_group(spark, sf):
    rows = _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.when(F.col("priority") == "1-URGENT", 0).when(F.col("priority") == "2-HIGH", 1).otherwise(2), "priority")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-09-01' GROUP BY 1")
def month_histogram(spark, sf):
    return aggregates.month_histogram(_t(spark, sf, "orders"), F.col("o_orderdate").cast("timestamp"), "1997-09-01")


@query("SELECT lang, count(*) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS size FROM documents GROUP BY lang ORDER BY size DESC, lang LIMIT 8")
def size_by_ext(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("size")).orderBy(F.desc("size"), "lang").limit(8)


@query("SELECT p AS value, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_type, ' '))) AS p FROM part) WHERE p <> '' GROUP BY p")
def multi_value_facet(spark, sf):
    return aggregates.multi_facet(_t(spark, sf, "part"), "p_partkey", F.col("p_type"), " ")


@query("""WITH b AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS a FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY)
SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM b UNION ALL SELECT 'user', u, count(*) FROM b GROUP BY u UNION ALL SELECT 'action', a, count(*) FROM b GROUP BY a""")
def activity_summary(spark, sf):
    events = _t(spark, sf, "events")
    last = events.agg(F.max("ts")).first()[0]
    return aggregates.activity_summary(events, "ts", F.lit(last).cast("timestamp_ntz") - F.expr("interval 7 days"), "user_id", "event_type")


@query("SELECT coalesce(nullif(regexp_extract(o_orderpriority, '^([0-9])', 1), ''), '') AS key, CASE o_orderstatus WHEN 'F' THEN 'Onayli' WHEN 'O' THEN 'Bekleyen' ELSE '00-Belirsiz' END AS approval, CASE WHEN o_orderkey % 5 = 0 THEN '00-Terminsiz' ELSE strftime(o_orderdate, '%Y') END AS year, count(*) AS n FROM orders GROUP BY ALL")
def organise_folders(spark, sf):
    """Orders by the folders that their state and date ask for; every fifth has no date to speak of."""
    orders = _t(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "review").otherwise("other")
    date = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = orders.select(F.regexp_extract("o_orderpriority", "^([0-9])", 1).alias("key"), classify.approval_folder(status).alias("approval"), classify.year_folder(date).alias("year"))
    return rows.groupBy("key", "approval", "year").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT regexp_extract(url, '^(.*)[/\\][^/\\]*$', 1) AS folder, count(*) AS n, max(page_id) AS latest FROM pages WHERE regexp_matches(url, '[/\\]') GROUP BY 1")
def folder_latest(spark, sf):
    return aggregates.folder_rollup(_t(spark, sf, "pages"), F.col("url"), None, F.col("page_id"))


@query("""WITH b AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS a FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
c AS (SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM b UNION ALL SELECT 'user', u, count(*) FROM b GROUP BY u UNION ALL SELECT 'action', a, count(*) FROM b GROUP BY a)
SELECT kind, key, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS INT) AS place FROM c QUALIFY place <= CASE kind WHEN 'user' THEN 5 WHEN 'action' THEN 6 ELSE 1 END""")
def activity_top(spark, sf):
    events = _t(spark, sf, "events")
    last = events.agg(F.max("ts")).first()[0]
    return aggregates.top_activity(events, "ts", F.lit(last).cast("timestamp_ntz") - F.expr("interval 7 days"), "user_id", "event_type")


@query(r"SELECT regexp_extract(url, '^(.*)[/\\][^/\\]*$', 1) AS folder, count(*) AS n FROM pages WHERE regexp_matches(url, '[/\\]') GROUP BY 1")
def folder_rollup(spark, sf):
    return aggregates.folder_rollup(_t(spark, sf, "pages"), F.col("url"), None)


@query(r"SELECT regexp_extract(url, '^((?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\]*[^/\\]*(?:[/\\][^/\\]+)?)', 1) AS root, count(*) AS n FROM pages GROUP BY 1")
def root_rollup(spark, sf):
    return aggregates.root_rollup(_t(spark, sf, "pages"), F.col("url"))


@query("WITH e AS (SELECT min(url) AS a, max(url) AS b FROM pages) SELECT a[1:coalesce((SELECT max(i) FROM generate_series(1, 1000) g(i), e WHERE a[1:i] = b[1:i] AND i <= least(length(a), length(b))), 0)] AS prefix FROM e")
def common_prefix(spark, sf):
    return aggregates.common_prefix(_t(spark, sf, "pages"), "url")


@query("SELECT source, count(*) AS total, CAST(sum(CASE WHEN toxic=1 THEN 1 ELSE 0 END) AS BIGINT) AS toxic, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS pending FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id GROUP BY source")
def conditional_sum(spark, sf):
    labels = _t(spark, sf, "labels").withColumnRenamed("doc_id", "label_id")
    joined = _t(spark, sf, "documents").join(labels, F.col("doc_id") == F.col("label_id"), "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("label_id").isNull()).alias("pending"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r=1")
def argmax_winner(spark, sf):
    return aggregates.winners(_t(spark, sf, "orders"), "o_custkey", "o_orderkey", [F.col("o_totalprice"), F.col("o_orderkey")])


@query("WITH g AS (SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2) SELECT doc_id AS id, g.key, n, first FROM documents JOIN g ON sha256(text) = g.key")
def exact_dup_groups(spark, sf):
    return duplicates.duplicate_groups(_t(spark, sf, "documents"), F.sha2("text", 256), "doc_id")


@query("WITH g AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) >= 2) SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS members, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS spare FROM g")
def dup_totals(spark, sf):
    return duplicates.report_totals(exact_dup_groups(spark, sf))


@query("WITH g AS (SELECT lower(p_name) AS key, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) >= 2) SELECT p_partkey AS id, g.key, n, first FROM part JOIN g ON lower(p_name) = g.key")
def same_name_groups(spark, sf):
    return duplicates.same_name_groups(_t(spark, sf, "part"), "p_name", "p_partkey")


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", vectors.text_hash(F.coalesce("text", F.lit(""))).alias("h"))


# SQL has no such fingerprints; tests compare all pairs.
@query()
def hamming_pairs(spark, sf):
    return duplicates.hamming_pairs(_hashes(spark, sf), "h", 3, 63)


@query()
def dup_components(spark, sf):
    return duplicates.visual_groups(_hashes(spark, sf), "doc_id", "h", 3, 63).select("id", "component")


# All lines; recursive SQL over them does not end in time, so a test holds it against plain search.
@query()
def version_closure(spark, sf):
    edges = _t(spark, sf, "orders").join(_t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return graph.connected_components(edges)


@query("SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 50")
def retention_trim(spark, sf):
    return aggregates.keep_newest(_t(spark, sf, "events"), [F.desc("event_id")]).select("event_id", "ts")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def per_group_cap(spark, sf):
    return aggregates.per_group_cap(_t(spark, sf, "events"), "user_id", [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id")


@query("SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label")
def first_seen(spark, sf):
    return aggregates.first_seen(_t(spark, sf, "embeddings"), "label", "vec_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 500")
def keyset_page(spark, sf):
    return filters.keyset(_t(spark, sf, "events"), "event_id", 500, 500).select("event_id", "user_id", "event_type")


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 20 = 0")
def stride_sample(spark, sf):
    return aggregates.stride_sample(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 5)


def _queries(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf, "embeddings")
    return rows, rows.filter("vec_id % 100 = 0")


_COS = "round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0), 6)"


_KNN_SQL = f"SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, coalesce({_COS}, 0) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10"


@query(_KNN_SQL)
def knn_cosine(spark, sf):
    rows, queries = _queries(spark, sf)
    return similarity.knn(rows, queries, "vec_id", "vec_id", "embedding", 10).withColumn("score", F.round("score", 6))


@query("SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10")
def knn_l2(spark, sf):
    rows, queries = _queries(spark, sf)
    return similarity.knn(rows, queries, "vec_id", "vec_id", "embedding", 10, "l2").withColumn("score", F.round("score", 5))


@query(f"SELECT q.vec_id AS query_id, e.label, max(coalesce({_COS}, 0)) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 GROUP BY 1, 2")
def max_sim_per_label(spark, sf):
    rows, queries = _queries(spark, sf)
    return similarity.best_per_group(rows, queries, "label", "vec_id", "embedding").withColumn("score", F.round("score", 6))


_INDEXES: dict[tuple[str, str], fulltext.TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> fulltext.TextIndex:
    """The index of documents, written once an application; searches read no text."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = fulltext.build_index(_t(spark, sf_dir, "documents"), "doc_id", ["text", "source"])
    return _INDEXES[key]


_DOC_TOKENS = r"SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+') AS t, regexp_extract_all(lower(coalesce(source, '')), '[\p{L}\p{N}\p{M}]+') AS s, lang, n_chars FROM documents"


@query(f"SELECT doc_id FROM ({_DOC_TOKENS}) WHERE (list_contains(t, 'license') OR list_contains(t, 'apache') OR list_contains(s, 'license') OR list_contains(s, 'apache')) AND NOT list_contains(t, 'mit') AND NOT list_contains(s, 'mit')")
def fts_bool(spark, sf):
    return fulltext.search_index(text_index(spark, sf), '("license" OR "apache") NOT mit').select(F.col("key").alias("doc_id"))


@query(f"SELECT doc_id FROM ({_DOC_TOKENS}) WHERE len(list_filter(list_concat(t, s), lambda x: starts_with(x, 'licen'))) > 0 AND list_contains(list_concat(t, s), 'of')")
def fts_prefix(spark, sf):
    return fulltext.search_index(text_index(spark, sf), "licen of").select(F.col("key").alias("doc_id"))


@query(f"SELECT doc_id FROM ({_DOC_TOKENS}) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' apache license ') OR contains(' ' || array_to_string(s, ' ') || ' ', ' apache license ')")
def fts_phrase(spark, sf):
    return fulltext.search_index(text_index(spark, sf), '"apache license"').select(F.col("key").alias("doc_id"))


_SCORED = f"""WITH d AS ({_DOC_TOKENS}), f AS (SELECT doc_id, lang, n_chars, len(t) + len(s) AS l, len(list_filter(t, lambda x: x = 'license')) AS ta, len(list_filter(s, lambda x: x = 'license')) AS sa, len(list_filter(t, lambda x: x = 'under')) AS tb, len(list_filter(s, lambda x: x = 'under')) AS sb FROM d),
s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (ta + sa > 0) AS da, count(*) FILTER (tb + sb > 0) AS db FROM f),
r AS (SELECT doc_id, lang, n_chars, ta, sa, tb, sb, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * (ta + sa) * 2.2 / (ta + sa + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * (tb + sb) * 2.2 / (tb + sb + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score FROM f, s WHERE ta + sa > 0 OR tb + sb > 0)"""


@query(f"{_SCORED} SELECT doc_id, score FROM r")
def bm25_scores(spark, sf):
    found = fulltext.search_index(text_index(spark, sf), '"license" OR "under"')
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"{_SCORED} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r WHERE lang IN ('en', 'fr') AND n_chars >= 200 AND ta + sa > 0 AND tb + sb > 0 ORDER BY score DESC, doc_id LIMIT 50")
def search_listing(spark, sf):
    """A query within a filtered listing, best first."""
    opts = ListOptions(ext=["en", "fr"], min_size=200, query='"license" AND "under"')
    rows = fulltext.list_search(documents(spark, sf), opts, text_index(spark, sf)).withColumn("score", F.round("score", 6))
    best = rows.orderBy(F.desc("score"), "doc_id").limit(50)
    return best.select("doc_id", "score", F.row_number().over(aggregates.Window.orderBy(F.desc("score"), "doc_id")).cast("long").alias("place"))  # 50 rows


@query(f"{_SCORED} SELECT doc_id, CASE WHEN ta + tb > 0 THEN 'text' ELSE '' END || CASE WHEN ta + tb > 0 AND sa + sb > 0 THEN ',' ELSE '' END || CASE WHEN sa + sb > 0 THEN 'source' ELSE '' END AS sources FROM r")
def match_sources(spark, sf):
    found = fulltext.search_index(text_index(spark, sf), '"license" OR "under"')
    return found.select(F.col("key").alias("doc_id"), F.array_join("sources", ",").alias("sources"))


@query(f"SELECT DISTINCT doc_id FROM ({_DOC_TOKENS}) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' all rights reserved ') OR contains(' ' || array_to_string(t, ' ') || ' ', ' password ') OR list_contains(s, 'password')")
def keyword_ids(spark, sf):
    return fulltext.keyword_ids(text_index(spark, sf), ["all rights reserved", "password"]).select(F.col("key").alias("doc_id"))


@query(f"SELECT doc_id FROM ({_DOC_TOKENS}) WHERE len(list_filter(t, lambda w: levenshtein(w, 'licence') <= 2)) > 0")
def fuzzy_listing(spark, sf):
    return fulltext.fuzzy_index(text_index(spark, sf), "licence", ["text"]).select(F.col("key").alias("doc_id"))


@query(f"SELECT term, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM ({_DOC_TOKENS})) GROUP BY 1, 2) GROUP BY term")
def token_index(spark, sf):
    rows = text_index(spark, sf).postings.filter("field = 'text'")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).cast("long").alias("occurrences"))


@query(r"SELECT p_partkey, p_name FROM part WHERE len(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda w: levenshtein(w, 'widgat') <= 1)) > 0")
def fuzzy_match(spark, sf):
    return fulltext.fuzzy_search(_t(spark, sf, "part"), "widgat", ["p_name"]).select("p_partkey", "p_name")


@query(r"SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(translate(coalesce(text, ''), 'ıIİçÇğĞöÖşŞüÜ', 'iiiccggoossuu')), '[^\p{L}\p{N}]+'), ['the', 'that'])")
def keyword_gate(spark, sf):
    tokens = F.split(text.normalize_tr(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    return _t(spark, sf, "documents").filter(F.array_contains(tokens, "the") & F.array_contains(tokens, "that")).select("doc_id")


@query(rf"""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label, vec_id) AS r FROM embeddings),
u AS (SELECT id, r FROM a WHERE r <= 300 UNION ALL SELECT id, r FROM b WHERE r <= 200) SELECT id, round(sum(1.0 / (60 + r)), 9) AS score FROM u GROUP BY id""")
def rrf_hybrid(spark, sf):
    def top(df: DataFrame, order: list, n: int) -> DataFrame:
        best = df.orderBy(*order).limit(n)
        return best.withColumn("rank", F.row_number().over(aggregates.Window.orderBy(*order)))  # n rows only

    one = top(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars"), [F.desc("n_chars"), F.col("id")], 300)
    two = top(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), [F.col("label"), F.col("id")], 200)
    return aggregates.reciprocal_ranks([one, two], "id", "rank").withColumn("score", F.round("score", 9))


@query(r"""WITH w AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 500) / 450.0) AS INT)) + 1)) AS i FROM w)
SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(len(w[i * 450 + 1 : i * 450 + 500]) AS INT) AS n_words, sha256(array_to_string(w[i * 450 + 1 : i * 450 + 500], ' ')) AS digest FROM s WHERE w[1] <> ''""")
def chunk_windows(spark, sf):
    rows = chunking.word_windows(_t(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", "chunk_index", "n_words", F.sha2("chunk", 256).alias("digest"))


@query(r"SELECT page_id, lower(regexp_replace(regexp_replace(url, '([^/])/{2,}', '\1/', 'g'), '(.)/+$', '\1')) AS path FROM pages")
def path_normalise(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.normalize_path(F.col("url")).alias("path"))


@query("SELECT page_id, CASE WHEN starts_with(lower(url), 'https://') THEN 'store:/' || url[9:] ELSE url END AS path FROM pages")
def path_remap(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.remap_prefix(F.col("url"), "https://", "store:/").alias("path"))


_RGB = "p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b"


@query(f"""WITH c AS (SELECT p_partkey, {_RGB} FROM part), l AS (SELECT *, list_transform([r, g, b], lambda x: CASE WHEN x / 255.0 <= 0.04045 THEN x / 255.0 / 12.92 ELSE pow((x / 255.0 + 0.055) / 1.055, 2.4) END) AS s FROM c),
x AS (SELECT *, list_transform([(0.4124564 * s[1] + 0.3575761 * s[2] + 0.1804375 * s[3]) / 0.95047, 0.2126729 * s[1] + 0.7151522 * s[2] + 0.0721750 * s[3], (0.0193339 * s[1] + 0.1191920 * s[2] + 0.9503041 * s[3]) / 1.08883], lambda t: CASE WHEN t > 216.0 / 24389 THEN cbrt(t) ELSE (24389.0 / 27 * t + 16) / 116 END) AS f FROM l)
SELECT p_partkey, '#' || lower(printf('%02x%02x%02x', CAST(r AS INT), CAST(g AS INT), CAST(b AS INT))) AS hex, round(116 * f[2] - 16, 4) AS l, round(500 * (f[1] - f[2]), 4) + 0.0 AS a, round(200 * (f[2] - f[3]), 4) + 0.0 AS bb, round(sqrt(pow(116 * f[2] - 16 - 50, 2) + pow(500 * (f[1] - f[2]), 2) + pow(200 * (f[2] - f[3]), 2)), 4) AS delta FROM x""")
def hex_lab_delta(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "p_partkey * 37 % 256 AS r", "p_partkey * 91 % 256 AS g", "p_partkey * 53 % 256 AS b")
    own = color.lab(F.col("r"), F.col("g"), F.col("b"))
    delta = color.delta_e76(own, [F.lit(50.0), F.lit(0.0), F.lit(0.0)])
    return rows.select("p_partkey", color.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), *(F.round(c, 4).alias(n) for c, n in zip([*own, delta], ["l", "a", "bb", "delta"])))


@query("SELECT CAST(floor(x / 36) AS BIGINT) AS cell_x, CAST(floor(y / 36) AS BIGINT) AS cell_y, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM (SELECT s_suppkey * 17 % 360 AS x, s_suppkey * 29 % 180 AS y FROM supplier) GROUP BY 1, 2")
def geo_grid_cluster(spark, sf):
    rows = _t(spark, sf, "supplier").selectExpr("s_suppkey * 17 % 360 AS x", "s_suppkey * 29 % 180 AS y")
    return aggregates.grid_clusters(rows, F.col("x"), F.col("y"), 36).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query("SELECT p_partkey, arg_min(n_name, {'d': abs(p_size - n_nationkey * 2), 'n': n_name}) AS nearest FROM part, nation GROUP BY p_partkey")
def nearest_dim(spark, sf):
    out = similarity.nearest_label(_t(spark, sf, "part"), _t(spark, sf, "nation").select("n_name", "n_nationkey"), lambda e: F.abs(F.col("p_size") - e["n_nationkey"] * 2), "n_name")
    return out.select("p_partkey", F.col("nearest.n_name").alias("nearest"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS INT) AS n FROM events")
def json_props(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).alias("n"))


@query("""WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0)
SELECT (SELECT count(*) FROM b) AS total, (SELECT count(*) FROM b WHERE doc_id IN (SELECT doc_id FROM a)) AS path_conflicts, (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a) AND sha256(text) IN (SELECT sha256(text) FROM a)) AS hash_duplicates""")
def merge_preview(spark, sf):
    from ..operators import archive

    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.sha2("text", 256).alias("content_hash"))
    return archive.merge_preview(docs.filter("doc_id % 3 != 0"), docs.filter("doc_id % 2 = 0"))


@query("""WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0), n AS (SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a) AND sha256(text) NOT IN (SELECT sha256(text) FROM a))
SELECT CAST(doc_id AS VARCHAR) AS path, doc_id AS id FROM a UNION ALL SELECT CAST(doc_id AS VARCHAR), (SELECT max(doc_id) FROM a) + row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) FROM n""")
def merge_union(spark, sf):
    from ..operators import archive

    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    merged, _ = archive.merge_assets(docs.filter("id % 3 != 0"), docs.filter("id % 2 = 0"))
    return merged.select("path", "id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id = d.doc_id AND s.n_chars > 300)")
def prune_missing(spark, sf):
    docs = _t(spark, sf, "documents")
    return filters.semi(docs, docs.filter("n_chars > 300"), "doc_id", "doc_id", "left_anti").select("doc_id")


@query("WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(b.k, a.k) AS k, round(coalesce(b.v, a.v), 2) AS v FROM a FULL JOIN b ON a.k = b.k")
def upsert(spark, sf):
    from ..operators import tables

    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    out = tables.upsert(orders.filter("k % 3 != 0"), orders.filter("k % 2 = 0").withColumn("v", F.col("v") + 1), ["k"])
    return out.select("k", F.round("v", 2).alias("v"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf):
    rows = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM s GROUP BY user_id, s""")
def session_window(spark, sf):
    rows = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")


# A user's events by hour from the first one on: each window is opened by the first event after the last.
_GAPS_SQL = """e AS (SELECT user_id, list(epoch_us(CAST(ts AS TIMESTAMP)) ORDER BY ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id),
s AS (SELECT user_id, t, 1 AS i FROM e UNION ALL SELECT user_id, t, i + len(list_filter(t[i:], lambda x: x < t[i] + {width})) FROM s WHERE i + len(list_filter(t[i:], lambda x: x < t[i] + {width})) <= len(t))"""


@query(f"""WITH RECURSIVE {_GAPS_SQL.format(width=3_600_000_000)}, w AS (SELECT user_id, t[i] AS opened FROM s),
o AS (SELECT event_id, events.user_id, (SELECT max(opened) FROM w WHERE w.user_id = events.user_id AND opened <= epoch_us(ts)) AS opened, ts FROM events WHERE events.user_id IS NOT NULL AND ts IS NOT NULL)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, opened ORDER BY ts, event_id) <= 3 AS allowed FROM o""")
def rate_window(spark, sf):
    from ..streaming import rates

    rows = _t(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return rates.rate_decisions(rows, "user_id", "ts", "event_id", seconds=3600, limit=3)


@query("""SELECT doc_id AS id, -1 AS chunk_index, concat_ws(chr(10), 'DOSYA: ' || source, 'BAŞLIK: ' || lang, pairs) AS chunk FROM documents LEFT JOIN
(SELECT doc_id, string_agg(x, chr(10) ORDER BY x) AS pairs FROM (SELECT doc_id, 'QUALITY' || coalesce(': ' || quality, '') AS x FROM labels UNION ALL SELECT doc_id, 'TOXIC' || coalesce(': ' || toxic, '') FROM labels) GROUP BY doc_id) USING (doc_id)""")
def metadata_chunks(spark, sf):
    catalog = documents(spark, sf)
    return chunking.metadata_chunks(catalog.assets.select(F.col("doc_id").alias("id"), F.col("source").alias("file_name"), F.col("lang").alias("title")), catalog.metadata)


_PLAIN = "lower(translate(coalesce({x}, ''), 'ıIİçÇğĞöÖşŞüÜ', 'iiiccggoossuu'))"
_STOPS = ", ".join(f"'{w.translate(str.maketrans('ıIİçÇğĞöÖşŞüÜ', 'iiiccggoossuu'))}'" for w in text.STOP_WORDS)
_HYBRID_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_PLAIN.format(x="text")}, '[\p{{L}}\p{{N}}\p{{M}}]+') AS w FROM documents),
q AS (SELECT vec_id AS query_id, list_distinct(list_filter(string_split_regex({_PLAIN.format(x="text[:60]")}, '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOPS}))) AS tokens, embedding FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0),
s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d), x AS (SELECT query_id, len(tokens) AS asked, unnest(tokens) AS term FROM q),
p AS (SELECT term, doc_id, count(*) AS tf, len(any_value(w)) AS l FROM (SELECT doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM x) GROUP BY term, doc_id),
f AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term, n),
b AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 9) AS score, count(*) = max(asked) AS gated FROM x JOIN p USING (term) JOIN f USING (term), s GROUP BY query_id, doc_id),
t AS (SELECT query_id, doc_id, gated, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS text_rank FROM b QUALIFY text_rank <= 300),
v AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), vec_id) AS vector_rank FROM q, embeddings e WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY vector_rank <= 200),
u AS (SELECT query_id, doc_id AS chunk_id, doc_id // 4 AS asset_id, coalesce(gated, false) AS gated, text_rank, vector_rank, CASE WHEN gated THEN 1 ELSE round(coalesce(1.0::DOUBLE / (60 + text_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 9) END AS score FROM t FULL JOIN v USING (query_id, doc_id) WHERE doc_id IN (SELECT doc_id FROM documents)),
c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, asset_id ORDER BY gated DESC, CASE WHEN gated THEN text_rank END, score DESC, chunk_id) <= 3)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY gated DESC, CASE WHEN gated THEN text_rank END, score DESC, chunk_id) AS INT) AS position, chunk_id, asset_id, score, coalesce(text_rank, 0) AS text_rank, coalesce(vector_rank, 0) AS vector_rank FROM c QUALIFY position <= 12"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every hundredth vector: its document's first words, and itself."""
    rows = _t(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").join(_t(spark, sf_dir, "documents"), F.col("doc_id") == F.col("vec_id"), "left")
    return rows.select(F.col("vec_id").alias("query_id"), text.significant(F.substring(F.coalesce("text", F.lit("")), 1, 60)).alias("tokens"), F.lit(None).cast("array<string>").alias("more"), F.col("embedding").alias("vector"))


_CHUNKS: dict[tuple[str, str], fulltext.TextIndex] = {}


@query(_HYBRID_SQL)
def hybrid_retrieval(spark, sf):
    """Every hundredth vector against all documents, four of which are an asset."""
    from ..operators import retrieval

    key = (spark.sparkContext.applicationId, sf)
    docs = _t(spark, sf, "documents")
    if key not in _CHUNKS:
        _CHUNKS[key] = retrieval.chunk_index(docs, "doc_id")
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("__v"), "embedding")
    chunks = docs.join(vectors, F.col("doc_id") == F.col("__v"), "left").select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 4").alias("asset_id"), "embedding")
    found = retrieval.retrieve_many(_CHUNKS[key], chunks, _requests(spark, sf))
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("text_rank", "vector_rank")})  # 0: not ranked there


@query()
def knn_cells(spark, sf):
    """The ten nearest of every hundredth vector by an index of cells, two thirds of which are probed."""
    rows, queries = _queries(spark, sf)
    index = similarity.build_vector_index(rows, "vec_id", "embedding")
    return similarity.search_cells(index, queries, "vec_id", "embedding", 10, max(1, 2 * len(index.centres) // 3))


@query(_KNN_SQL)
def knn_all_cells(spark, sf):
    """The same with every cell probed, which is exact."""
    rows, queries = _queries(spark, sf)
    index = similarity.build_vector_index(rows, "vec_id", "embedding")
    return similarity.search_cells(index, queries, "vec_id", "embedding", 10, len(index.centres)).withColumn("score", F.round("score", 6))


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a grey image of 8 by 8 cells, four pixels wide each."""
    cell = F.col("embedding")
    grey = F.transform(cell, lambda x: F.least(F.greatest(F.floor(128 + 400 * x.cast("double")), F.lit(0)), F.lit(255)).cast("int"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.get("grey", (F.floor(i / 128) * 8 + F.floor((i % 32) / 4)).cast("int")))
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", grey.alias("grey")).select("vec_id", "label", wide.alias("pixels"), F.lit(32).alias("width"))


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor(128 + 400 * x::DOUBLE), 0), 255) AS INT)) AS g FROM embeddings),
p AS (SELECT vec_id, unnest(g) AS v FROM g), c AS (SELECT vec_id, v AS t, sum(count(*)) OVER w AS a, sum(sum(v)) OVER w AS sa, sum(count(*)) OVER (PARTITION BY vec_id) AS n, sum(sum(v)) OVER (PARTITION BY vec_id) AS s FROM p GROUP BY vec_id, v WINDOW w AS (PARTITION BY vec_id ORDER BY v)),
b AS (SELECT vec_id, t, a, sa, n, s, (sa * n - s * a)::DOUBLE * (sa * n - s * a)::DOUBLE / (a * (n - a))::DOUBLE AS v FROM c WHERE a < n), o AS (SELECT vec_id, t, a, n, s FROM b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, t) = 1)
SELECT vec_id, CAST(t AS INT) AS threshold, CAST(16 * CASE WHEN s >= 128 * n THEN a ELSE n - a END AS INT) AS drawn FROM o""")
def image_thresholds(spark, sf):
    return contours.outlines(_rasters(spark, sf), "pixels", "width", ["vec_id"]).select("vec_id", "threshold", "drawn")


@query()
def image_outlines(spark, sf):
    """The outline of every vector's image, with its features."""
    rows = contours.outlines(_rasters(spark, sf), "pixels", "width", ["vec_id", "label"])
    found = shapes.outline_features(rows.filter("error is null").withColumn("closed", F.lit(True)), "points", "closed")
    return found.select("vec_id", "label", "contour_points", "vertices", "closed", *(F.round(c, 9).alias(c) for c in ("area", "perimeter", *shapes.FEATURES[1:])))


_WORD, _GAP = r"[\p{L}\p{N}\p{M}]+", r"[^\p{L}\p{N}\p{M}]*"


@query(f"""WITH x AS (SELECT doc_id, 'text' AS field, coalesce(text, '') AS c FROM documents UNION ALL SELECT doc_id, 'source', coalesce(source, '') FROM documents),
d AS (SELECT doc_id, field, regexp_extract_all(lower(c), '{_WORD}') AS t, regexp_extract_all(c, '{_WORD}') AS o, regexp_extract_all(c, '{_WORD}{_GAP}') AS p FROM x),
h AS (SELECT doc_id, field, i FROM (SELECT *, unnest(range(len(t))) AS i FROM d) WHERE t[i + 1] IN ('license', 'under')), w AS (SELECT doc_id, field, i, count(*) OVER (PARTITION BY doc_id, field ORDER BY i RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n FROM h),
b AS (SELECT doc_id, field, i FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY n DESC, i) = 1)
SELECT doc_id, field, CASE WHEN i > 0 THEN '…' ELSE '' END || regexp_replace(array_to_string(list_transform(range(i + 1, least(i + 12, len(t)) + 1), lambda k: CASE WHEN t[k] IN ('license', 'under') THEN '[' || o[k] || ']' || p[k][len(o[k]) + 1:] ELSE p[k] END), ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\]]+$', '') || CASE WHEN i + 12 < len(t) THEN '…' ELSE '' END AS snippet FROM b JOIN d USING (doc_id, field)""")
def snippets(spark, sf):
    return fulltext.field_snippets(text_index(spark, sf), _t(spark, sf, "documents"), "doc_id", '"license" OR "under"')


@query()
def visual_groups(spark, sf):
    return duplicates.visual_groups(_hashes(spark, sf), "doc_id", "h", 3, 63)


@query()
def page_text(spark, sf):
    from ..sources import readers

    return readers.extract_html(_t(spark, sf, "pages"), "page_id", "html")


_SHAPE = "CAST(p_size AS DOUBLE) AS vertices, (p_partkey * 7 % 100) / 100.0 AS compactness, (p_partkey * 11 % 100) / 100.0 AS regularity, 1 + (p_partkey * 3 % 40) / 10.0 AS aspect, (p_partkey * 13 % 100) / 100.0 AS rectangularity, (p_partkey * 17 % 100) / 100.0 AS solidity, p_size % 3 <> 0 AS closed"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as shapes of the brand's drawing, with features made from their keys."""
    tenth = lambda n, m, by: (F.col("p_partkey") * n % m) / by
    return _t(spark, sf_dir, "part").select(
        F.col("p_brand").alias("asset_id"), F.col("p_partkey").alias("shape_id"), F.col("p_size").cast("double").alias("vertices"), tenth(7, 100, 100.0).alias("compactness"), tenth(11, 100, 100.0).alias("regularity"),
        (1 + tenth(3, 40, 10.0)).alias("aspect"), tenth(13, 100, 100.0).alias("rectangularity"), tenth(17, 100, 100.0).alias("solidity"), (F.col("p_size") % 3 != 0).alias("closed"),
    )


_VERTEX = "exp(-pow(vertices - 12, 2) / (2 * pow(greatest(0.3 * greatest(vertices, 12), 1.5), 2)))"


@query(f"""WITH s AS (SELECT p_brand AS asset_id, {_SHAPE} FROM part)
SELECT asset_id, round(max(CASE WHEN closed THEN 0.20 * {_VERTEX} + 0.20 * greatest(0, 1 - abs(compactness - 0.8)) + 0.15 * greatest(0, 1 - abs(regularity - 0.9)) + 0.15 * least(aspect, 1.5) / greatest(aspect, 1.5) + 0.15 * greatest(0, 1 - abs(rectangularity - 0.7)) + 0.10 * greatest(0, 1 - abs(solidity - 0.95)) + 0.05 ELSE 0.30 * {_VERTEX} + 0.20 * least(aspect, 1.5) / greatest(aspect, 1.5) END), 6) AS score
FROM s GROUP BY asset_id ORDER BY 2 DESC, 1 LIMIT 200""")
def shape_search(spark, sf):
    goal = {"vertices": 12.0, "compactness": 0.8, "regularity": 0.9, "aspect": 1.5, "rectangularity": 0.7, "solidity": 0.95, "closed": True}
    return shapes.similar_shapes(_shapes(spark, sf), goal, k=200).withColumn("score", F.round("score", 6))


@query(f"""WITH s AS (SELECT p_brand AS asset_id, {_SHAPE} FROM part)
SELECT asset_id, round(max(CASE WHEN closed THEN 0.30 * regularity + 0.25 * compactness + 0.20 * rectangularity + 0.15 * solidity + 0.10 ELSE 0.40 * regularity + 0.30 / (1 + abs(aspect - 1)) + 0.20 * least(vertices / 20, 1) + 0.10 END), 6) AS score FROM s GROUP BY asset_id ORDER BY 2 DESC, 1 LIMIT 200""")
def shape_features(spark, sf):
    return shapes.feature_search(_shapes(spark, sf), k=200).withColumn("score", F.round("score", 6))


@query(f"SELECT shape_id FROM (SELECT p_partkey AS shape_id, {_SHAPE} FROM part) WHERE vertices BETWEEN 8 AND 12 AND regularity >= 0.5 AND aspect BETWEEN 1.0 AND 3.0 AND closed")
def shape_criteria(spark, sf):
    wanted = shapes.ShapeCriteria(vertices=10, tolerance=2, min_regularity=0.5, aspect=(1.0, 3.0), closed_only=True)
    return shapes.filter_shapes(_shapes(spark, sf), wanted).select("shape_id")


_POINTS = "SELECT s_suppkey, (s_suppkey * 37 % 1600) / 10.0 - 80 AS lat, (s_suppkey * 91 % 3400) / 10.0 - 170 AS lon FROM supplier"
_PLACES = "SELECT n_name AS place, n_nationkey * 6.1 - 75 AS plat, n_nationkey * 13.3 - 160 AS plon FROM nation"


@query(f"SELECT s_suppkey, arg_min(place, struct_pack(d := pow((lon - plon) * cos(radians((lat + plat) / 2)), 2) + pow(lat - plat, 2), n := place)) AS place FROM ({_POINTS}), ({_PLACES}) GROUP BY s_suppkey")
def nearest_place(spark, sf):
    points = _t(spark, sf, "supplier").selectExpr("s_suppkey", "(s_suppkey * 37 % 1600) / 10.0D - 80 AS lat", "(s_suppkey * 91 % 3400) / 10.0D - 170 AS lon")
    places = _t(spark, sf, "nation").selectExpr("n_name AS place", "n_nationkey * 6.1D - 75 AS lat", "n_nationkey * 13.3D - 160 AS lon")
    return geo.nearest_place(points, places, "s_suppkey").select("s_suppkey", "place")


@query(r"SELECT page_id, CASE WHEN regexp_matches(f, '(texture|doku|material|kaplama|surface|pbr|tileable|seamless|map|tex)') AND NOT regexp_matches(f, '(foto|photo|mevcut|as_built|asbuilt|as-built|dcim|screenshot|ekran_g|survey|field|cekim|çekim|santiye|şantiye|site_)') AND NOT regexp_matches(f, '(render|output|cikti|final|gorsel|visual|vray|v-ray|corona|lumion|enscape|archviz)') THEN 1 ELSE 0 END AS texture_folder FROM (SELECT page_id, lower(regexp_replace(url, '[^/]*$', '')) AS f FROM pages)")
def image_kinds(spark, sf):
    """Where the folder alone tells a texture."""
    rows = _t(spark, sf, "pages").select("page_id", classify.image_kind(F.lit("x.jpg"), F.regexp_replace("url", "[^/]*$", "")).alias("kind"))
    return rows.select("page_id", (F.coalesce("kind", F.lit("")) == classify.TEXTURE).cast("int").alias("texture_folder"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def message_roles(spark, sf):
    return _t(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.char_length("text")).alias("chars"))


@query("SELECT conv_id, arg_min(turn, turn) AS first_turn, count(*) AS n, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def chat_sessions(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND o_orderpriority = '1-URGENT'")
def bridge_joins(spark, sf):
    nations = _t(spark, sf, "nation").join(F.broadcast(_t(spark, sf, "region").filter("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = filters.semi(_t(spark, sf, "customer"), nations, "c_nationkey", "n_nationkey")
    orders = filters.semi(_t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'"), customers, "o_custkey", "c_custkey")
    return filters.semi(_t(spark, sf, "lineitem"), orders, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"""WITH RECURSIVE {_GAPS_SQL.format(width=1_000_000)} SELECT user_id, count(*) AS n FROM s GROUP BY user_id""")
def throttled_events(spark, sf):
    from ..streaming import incremental

    return incremental.throttle(_t(spark, sf, "events").select("user_id", "ts"), "user_id", "ts").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


# Windows of a key's ordered times t: i is the first of one, nxt the first after it.
_TIMES_SQL = "e AS (SELECT user_id, list(epoch_us(ts) ORDER BY ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id)"
_LOCKS_SQL = f"""WITH RECURSIVE {_TIMES_SQL}, s AS (SELECT user_id, t, 1 AS i, CAST(NULL AS BIGINT) AS locked FROM e UNION ALL
SELECT user_id, t, CASE WHEN n >= 3 THEN i + len(list_filter(t[i:], lambda x: x < t[i + 2] + 1800000000)) ELSE i + n END, CASE WHEN n >= 3 THEN t[i + 2] END
FROM (SELECT *, len(list_filter(t[i:], lambda x: x < t[i] + 3600000000)) AS n FROM s WHERE i <= len(t)))
SELECT user_id, locked AS locked_us FROM s WHERE locked IS NOT NULL"""


@query(_LOCKS_SQL)
def lockouts(spark, sf):
    from ..streaming import rates

    found = rates.lockouts(_t(spark, sf, "events"), "user_id", "ts", 3, 3600, 1800)
    return found.select("user_id", F.unix_micros("locked_from").alias("locked_us"))


@query("SELECT o_orderkey AS path, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN abs(o_totalprice - c_acctbal * 30) > 20000 THEN 'stale' ELSE 'fresh' END AS state FROM orders LEFT JOIN customer ON c_custkey = o_orderkey")
def staleness(spark, sf):
    from ..operators import archive

    catalog = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("modified_at"))
    listing = _t(spark, sf, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_acctbal") * 30).alias("modified_at"))
    return archive.staleness(catalog, listing, 20000)


@query("SELECT 'orders' AS \"table\", count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_suppkey AND c_acctbal > 0)")
def orphans(spark, sf):
    from ..operators import archive

    assets = _t(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return archive.orphans({"orders": (_t(spark, sf, "orders"), "o_custkey"), "lineitem": (_t(spark, sf, "lineitem"), "l_suppkey")}, assets)


# Shapes of brands with vertex counts that recur, which of two brands' shapes are alike, and the brands' overlap.
_OVERLAP_SQL = f"""s AS (SELECT p_brand AS asset_id, p_partkey AS shape_id, {_SHAPE.replace("CAST(p_size AS DOUBLE)", "CAST(p_partkey % 40 + 3 AS DOUBLE)").replace("p_size % 3 <> 0", "p_partkey % 5 <> 0")} FROM part),
p AS (SELECT a.asset_id AS a, a.shape_id AS sa, b.asset_id AS b, b.shape_id AS sb, a.closed, exp(-pow(a.vertices - b.vertices, 2) / (2 * pow(greatest(0.3 * greatest(a.vertices, b.vertices), 1.5), 2))) AS v, least(a.aspect, b.aspect) / greatest(a.aspect, b.aspect) AS r,
1 - abs(a.compactness - b.compactness) AS c, 1 - abs(a.regularity - b.regularity) AS g, 1 - abs(a.rectangularity - b.rectangularity) AS q, 1 - abs(a.solidity - b.solidity) AS o FROM s a JOIN s b ON a.closed = b.closed AND a.asset_id <> b.asset_id),
m AS (SELECT a, b, count(DISTINCT sa) + count(DISTINCT sb) AS m FROM p WHERE CASE WHEN closed THEN 0.20 * v + 0.20 * c + 0.15 * g + 0.15 * r + 0.15 * q + 0.10 * o + 0.05 ELSE 0.35 * r + 0.30 * v + 0.25 * g + 0.10 END >= 0.9 GROUP BY a, b), n AS (SELECT asset_id, count(*) AS n FROM s GROUP BY asset_id),
e AS (SELECT a, b, CAST(round(m * 100 / (x.n + y.n)::DOUBLE) AS INT) AS score FROM m JOIN n x ON x.asset_id = a JOIN n y ON y.asset_id = b)"""


def _recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).withColumns({"vertices": (F.col("shape_id") % 40 + 3).cast("double"), "closed": F.col("shape_id") % 5 != 0})


@query(f"""WITH {_OVERLAP_SQL} SELECT a AS ref, b AS asset, score / 100.0::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INT) AS rank FROM e
WHERE score >= 1 AND CAST(regexp_extract(a, '([0-9]+)', 1) AS INT) % 3 = 0 QUALIFY rank <= 10""")
def composite_shapes(spark, sf):
    """Brands whose shapes overlap those of each brand with a number divisible by 3, ten each."""
    rows = _recurring(spark, sf)
    refs = rows.filter(F.regexp_extract("asset_id", "([0-9]+)", 1).cast("int") % 3 == 0).select("asset_id")
    return shapes.composite_search(rows, refs, 1, 10)


@query(f"""WITH RECURSIVE {_OVERLAP_SQL}, l AS (SELECT a, b, score FROM e WHERE score >= 40), r AS (SELECT a AS id, a AS seen FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT id, min(seen) AS component FROM r GROUP BY id), w AS (SELECT component, min(score) AS score FROM l JOIN c ON c.id = l.a GROUP BY component) SELECT id, component, score FROM c JOIN w USING (component)""")
def structural_groups(spark, sf):
    """Brands whose drawings share shapes."""
    return shapes.structural_groups(_recurring(spark, sf), 40)
