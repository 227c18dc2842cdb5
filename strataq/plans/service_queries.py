"""Registered queries of side tables, exports and codecs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec
from ..operators import exports, filters, retrieval, services
from .queries import _t, documents, query, text_index


@query("SELECT o_custkey AS asset_id, o_orderpriority AS name FROM orders WHERE o_totalprice > 200000 UNION SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice < 100000")
def tags_added(spark, sf):
    orders = _t(spark, sf, "orders")
    old = orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderpriority").alias("name"))
    return services.add_links(old, orders.filter("o_totalprice < 100000").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderstatus").alias("name")))


@query("SELECT DISTINCT o_custkey AS asset_id FROM orders WHERE (o_totalprice > 200000) AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def favourites_toggled(spark, sf):
    orders = _t(spark, sf, "orders")
    liked = orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("asset_id")).distinct()
    return services.toggle_links(liked, orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("asset_id")))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY lower(m)), m FROM (SELECT DISTINCT c_mktsegment AS m FROM customer) WHERE lower(m) NOT IN (SELECT lower(n_name) FROM nation)")
def names_added(spark, sf):
    dim = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return services.add_named(dim, _t(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 7 WHEN c_nationkey NOT IN (3, 4) THEN c_nationkey ELSE -1 END AS project_id FROM customer")
def projects_assigned(spark, sf):
    assets = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("project_id"))
    dim = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    _, left = services.drop_named(dim, [3, 4], assets)
    found = services.assign(left, _t(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), 7)
    return found.select("id", F.coalesce("project_id", F.lit(-1).cast("long")).alias("project_id"))


@query("WITH r AS (SELECT DISTINCT regexp_extract(url, '^(.*?//[^/]*)', 1) AS path FROM pages) SELECT r.path, count(p.url) AS n FROM r LEFT JOIN pages p ON lower(p.url) = lower(r.path) OR starts_with(lower(p.url), lower(r.path) || '/') GROUP BY r.path")
def root_counts(spark, sf):
    pages = _t(spark, sf, "pages").select(F.col("url").alias("path"))
    roots = pages.select(F.regexp_extract("path", "^(.*?//[^/]*)", 1).alias("path")).distinct().select("path", F.col("path").alias("label"), F.xxhash64("path").alias("id"))
    return services.roots_with_counts(roots, pages).select("path", "n")


@query("SELECT upper(a.url) AS path, EXISTS (SELECT 1 FROM pages b WHERE lower(b.url) = lower(a.url) AND b.page_id % 3 <> 0) AS known FROM pages a")
def paths_known(spark, sf):
    pages = _t(spark, sf, "pages")
    assets = pages.select(F.col("url").alias("path"), F.when(F.col("page_id") % 3 == 0, 1).alias("deleted_at"))
    return services.path_exists(assets, pages.select(F.upper("url").alias("path")))


@query("SELECT event_id AS asset_id, event_type AS stage, 'b' AS reason FROM events WHERE value > 50 UNION ALL SELECT event_id, event_type, 'a' FROM events WHERE user_id % 2 = 0 AND (value IS NULL OR value <= 50)")
def skips_recorded(spark, sf):
    rows = lambda c, r: _t(spark, sf, "events").filter(c).select(F.col("event_id").alias("asset_id"), F.col("event_type").alias("stage"), F.lit(r).alias("reason"))
    return services.record_skips(rows("user_id % 2 = 0", "a"), rows("value > 50", "b"))


@query("SELECT doc_id AS id, sha256(CASE WHEN lang = 'en' THEN '' ELSE lang || chr(10) END || source || chr(10) || coalesce(text, '')) AS digest FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 500")
def pending_embeddings(spark, sf):
    docs = _t(spark, sf, "documents")
    assets = docs.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("title"), F.col("source").alias("file_name"), F.lit(None).cast("long").alias("deleted_at"))
    rows = services.pending_text(assets, docs.select(F.col("doc_id").alias("asset_id"), F.col("text").alias("body")), _t(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id")), after=-1)
    return rows.select("id", F.sha2("text", 256).alias("digest"))


@query("SELECT vec_id // 8 AS asset_id, count(DISTINCT vec_id) AS regions FROM embeddings GROUP BY 1")
def image_vectors(spark, sf):
    return services.images_with_vectors(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query("SELECT doc_id AS id FROM documents WHERE doc_id * 8 + 4 NOT IN (SELECT vec_id FROM embeddings)")
def image_vectors_pending(spark, sf):
    return services.pending_images(_t(spark, sf, "documents").select(F.col("doc_id").alias("id")), _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, 'q' AS k FROM labels WHERE quality = 1 UNION ALL SELECT DISTINCT doc_id, 't' FROM labels WHERE toxic = 0) GROUP BY 1) m ON m.doc_id = d.doc_id WHERE coalesce(n, 0) < 2")
def thin_analyses(spark, sf):
    labels = _t(spark, sf, "labels").select(F.col("doc_id").alias("asset_id"), F.expr("stack(2, 'q', if(quality = 1, 'x', ''), 't', if(toxic = 0, 'x', null)) as (key, value_text)"))
    return services.thin_analyses(_t(spark, sf, "documents").select(F.col("doc_id").alias("id")), labels, ["q", "t"], 2)


@query("SELECT 'orders' AS \"table\", count(*) AS n FROM orders UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'old', 0")
def inventory(spark, sf):
    return services.inventory({"orders": _t(spark, sf, "orders"), "pages": _t(spark, sf, "pages"), "old": None})


@query("SELECT event_id AS id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500 OFFSET 100")
def audit_page(spark, sf):
    log = _t(spark, sf, "events").withColumnRenamed("event_id", "id")
    return services.log_page(log, 1000, 100).select("id", "user_id")


@query("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-02' UNION ALL SELECT -count(*) FROM events WHERE ts < TIMESTAMP '2024-01-02'")
def audit_pruned(spark, sf):
    log = _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    kept = services.prune_before(log, F.lit("2024-01-02").cast("timestamp")).select("id")
    return kept.unionByName(log.agg((-F.count_if(F.col("ts") < F.lit("2024-01-02").cast("timestamp"))).alias("id")))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal DESC, c_custkey DESC")
def trash_listing(spark, sf):
    assets = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("deleted_at"))
    return services.trash(assets).select("id")


@query("SELECT greatest(count(*) - 10000, 0) AS dropped FROM orders")
def capped_log(spark, sf):
    return services.capped(_t(spark, sf, "orders"), "o_orderkey")[1]


@query("SELECT m.conv_id * 1000 + m.turn AS id, r.conv_id IS NOT NULL AS read FROM conversations m LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 2 = 0) r ON r.conv_id = m.conv_id AND r.turn = m.turn WHERE m.role <> 'user' ORDER BY m.conv_id DESC, id DESC LIMIT 200")
def messages_received(spark, sf):
    rows = _t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("role") == "user", 5).otherwise(6).cast("long").alias("sender_id"), F.col("conv_id").alias("created_at"), "turn")
    reads = rows.filter("turn % 2 = 0").select(F.col("id").alias("message_id"), F.lit(5).cast("long").alias("user_id"), F.lit(1).alias("read_at")).distinct()
    return services.received(rows, reads, 5, 200).select("id", "read")


@query("SELECT d.doc_id, v.label AS score FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id WHERE d.lang = 'en' ORDER BY v.label DESC, d.doc_id LIMIT 40")
def hydrated(spark, sf):
    ranked = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("score"))
    found = filters.apply_filters(documents(spark, sf), filters.ListOptions(ext=["en"]))
    return services.hydrate(ranked, found, "doc_id", 40).select("doc_id", "score")


@query(r"WITH t AS (SELECT doc_id, lang, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+'), ' ') || ' ' || chr(0) || array_to_string(regexp_extract_all(lower(source), '[\p{L}\p{N}\p{M}]+'), ' ') || ' ' AS t FROM documents) SELECT doc_id FROM t WHERE lang <> 'de' AND NOT (contains(t, ' password ') OR contains(t, ' apache license '))")
def sensitive_excluded(spark, sf):
    docs = _t(spark, sf, "documents").withColumn("rag_excluded", F.col("lang") == "de")
    return retrieval.without_sensitive(docs, text_index(spark, sf), {"legal": ["apache license"], "other": ["the"]}, ["legal"], ["password"], "doc_id").select("doc_id")


@query(r"SELECT doc_id FROM (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+') AS t FROM documents) WHERE lang IN ('en', 'fr') AND list_contains(t, 'license') AND list_contains(t, 'under') ORDER BY doc_id LIMIT 150")
def list_intent(spark, sf):
    docs = _t(spark, sf, "documents").withColumnRenamed("lang", "ext")
    return retrieval.list_intent(docs, text_index(spark, sf), "license under", ["en", "fr"], 150, "doc_id")[0].select("doc_id")


@query("SELECT conv_id, turn, '### ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || coalesce(text, '') || chr(10) AS line FROM conversations")
def chat_markdown(spark, sf):
    return exports.chat_lines(_t(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("""SELECT p_partkey, '<rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/">' || chr(10) || '  <dc:title>' || replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</dc:title>' || chr(10) || '  <dc:type>' || p_type || '</dc:type>' || chr(10) || '</rdf:Description>' || chr(10) AS xml FROM part""")
def sidecars(spark, sf):
    return exports.sidecars(_t(spark, sf, "part"), "p_partkey", {"title": "p_name", "type": "p_type"})


@query("SELECT vec_id, len(embedding) AS n, CAST(floor(embedding[1] * 1000) AS BIGINT) AS head FROM embeddings")
def vector_codec(spark, sf):
    there = _t(spark, sf, "embeddings").select("vec_id", codec.floats_of(codec.blob_of(F.col("embedding"))).alias("v"))
    return there.select("vec_id", F.size("v").cast("long").alias("n"), F.floor(F.col("v")[0] * F.lit(1000).cast("float")).alias("head"))
