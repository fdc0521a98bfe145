"""Registered enrichment queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import text as tx
from lodeweave.functions import urls
from lodeweave.operators import enrichment as en
from lodeweave.operators import html as h
from lodeweave.operators import rules, taxonomy, vectors
from lodeweave.plans.content_queries import _DOCUMENTS, _classified
from lodeweave.plans.registry import query, table
from lodeweave.plans.url_queries import _PARTS
from lodeweave.sources import sitemaps, tables
from lodeweave.streaming import jobs


@query("SELECT page_id, length(trim(html)) < 500 AS unrendered, 'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/x.jpg' AS media FROM pages")
def html_unrendered(spark, sf):
    made = F.concat(F.lit("see https://"), urls.authority(F.col("url")), F.lit("/x.jpg, now"))
    return table(spark, sf, "pages").select("page_id", tx.is_unrendered(F.col("html")).alias("unrendered"), F.get(urls.media_in_text(made, ("jpg", "png")), F.lit(0)).alias("media"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'FOUND' END AS about, CASE WHEN c_custkey % 3 = 0 THEN 'Name' ELSE c_name END AS name FROM customer""")
def enrich_fill(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("about"), F.col("c_name").alias("name"))
    found = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("FOUND").alias("about"), F.lit("Name").alias("name"))
    return en.fill(c, found, "c_custkey", ["about"], ["name"])


@query("SELECT event_id, status, status IN (404, 403) OR parked AS archive, CASE WHEN status IN (403, 503) THEN status::VARCHAR WHEN parked AND status <> 404 THEN 'Closed' END AS tag FROM (SELECT event_id, [200, 403, 404][(event_id % 3 + 1)::INT] AS status, event_id % 7 = 0 AS parked FROM events)")
def page_states(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get(F.array(F.lit(200), F.lit(403), F.lit(404)), (F.col("event_id") % 3).cast("int")).alias("status"), (F.col("event_id") % 7 == 0).alias("parked"))
    return e.select("event_id", "status", en.page_state(F.col("status"), F.col("parked"), F.lit(False)).alias("s")).select("event_id", "status", "s.archive", "s.tag")


@query(f"""WITH {_PARTS}, t AS (SELECT page_id, url, scheme || '://' || auth || short AS target FROM c),
j AS (SELECT target, arg_min(page_id, {{'r': (page_id % 2 = 0)::INT, 'i': page_id}}) AS job_id, bool_or(page_id % 2 = 1) AS running FROM t WHERE page_id % 3 = 0 GROUP BY target)
SELECT t.url, t.target, j.job_id, CASE WHEN j.running THEN 'already_running' WHEN j.job_id IS NOT NULL THEN 'restored' ELSE 'started' END AS outcome FROM t LEFT JOIN j ON t.target = j.target""")
def job_start(spark, sf):
    p = table(spark, sf, "pages")
    jobs = p.where("page_id % 3 = 0").select("url", F.col("page_id").alias("job_id"), F.when(F.col("page_id") % 2 == 1, "running").otherwise("failed").alias("status"))
    return en.start_jobs(jobs, p.select("url"))


def _site(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", urls.authority(F.col("url")).alias("host"), urls.sanitize(F.col("url")).alias("loc"))


@query(f"WITH {_PARTS} SELECT DISTINCT 'https://' || auth || '/sitemap.xml' AS url, clean AS loc, '2024-01-02' AS lastmod FROM c")
def sitemap_entries(spark, sf):
    """Each site's pages written as a sitemap and read again."""
    xml = sitemaps.to_xml(_site(spark, sf).select("host", "loc").distinct().withColumn("lastmod", F.lit("2024-01-02")), "host")
    maps = xml.select(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"), F.col("xml").alias("content"))
    return sitemaps.expand(maps).select("url", "loc", "lastmod")


@query(f"WITH {_PARTS} SELECT DISTINCT 'https://' || auth || '/' AS site, 'https://' || auth || CASE WHEN len(auth) % 2 = 0 THEN '/wp-sitemap.xml' ELSE '/own.xml' END AS candidate, CASE WHEN len(auth) % 2 = 0 THEN 6 ELSE 4 END AS rank FROM c")
def sitemap_pick(spark, sf):
    root = F.concat(F.lit("https://"), "host")
    sites = _site(spark, sf).select(F.concat(root, F.lit("/")).alias("site"), F.concat(F.lit("Sitemap: https://foreign.test/s.xml\nSitemap: "), root, F.lit("/own.xml")).alias("robots"), "host").distinct()
    found = sitemaps.candidates(sites, "robots").withColumn("host", urls.authority(F.col("site")))
    has = F.col("candidate").endswith("foreign.test/s.xml") | F.when(F.length("host") % 2 == 0, F.col("candidate").endswith("/wp-sitemap.xml")).otherwise(F.col("candidate").endswith("/own.xml"))
    return sitemaps.pick(found.withColumn("n_entries", has.cast("int"))).select("site", "candidate", F.col("rank").cast("int").alias("rank"))


@query("SELECT s_suppkey AS id, s_suppkey % 2 AS ord, CASE s_suppkey % 3 WHEN 0 THEN n_name ELSE lower(n_name) END AS label, n_name AS option, CASE s_suppkey % 3 WHEN 0 THEN 1 ELSE 2 END AS tier FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 2")
def taxonomy_match(spark, sf):
    n = table(spark, sf, "nation")
    label = F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).when(F.col("s_suppkey") % 3 == 1, F.lower("n_name")).otherwise("qq")
    proposed = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 2).alias("ord"), label.alias("label"))
    return taxonomy.match(proposed, n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("option")))


@query()
def taxonomy_match_tiers(spark, sf):
    """Part names as options; names written in other ways, parts of names, brands and type names as labels, so that every tier occurs."""
    part = table(spark, sf, "part")
    way, name = F.col("p_partkey") % 8, F.col("p_name")
    less = F.concat(F.substring(name, 1, 3), F.expr("substring(p_name, 5)"))
    label = F.when(way == 0, name).when(way == 1, F.upper(name)).when(way == 2, F.substring(name, 1, 6)).when(way == 3, F.expr("substring(p_name, 3, 6)")).when(way == 4, less).when(way == 5, F.upper(less)).when(way == 6, F.col("p_brand")).otherwise(F.col("p_type"))
    options = part.groupBy(name.alias("option")).agg(F.min("p_partkey").alias("ord"))
    synonyms = part.groupBy(F.col("p_brand").alias("label")).agg(F.min("p_name").alias("option")).where("label like '%1'")
    return taxonomy.match(part.select(F.col("p_partkey").alias("id"), F.lit(0).alias("ord"), label.alias("label")), options, synonyms)


@query(f"WITH {_PARTS} SELECT auth AS host, row_number() OVER (PARTITION BY auth ORDER BY url) AS ordinal, url, './' || auth || '/content.md' AS path FROM c")
def page_index(spark, sf):
    return tables.page_index(_site(spark, sf).withColumn("folder", F.col("host")), "host", "loc", "url", "folder").select("host", "ordinal", "url", "path")


@query(f"WITH {_PARTS} SELECT page_id, auth || '/' || 'page' || CASE WHEN row_number() OVER (PARTITION BY auth ORDER BY url) > 1 THEN '_' || row_number() OVER (PARTITION BY auth ORDER BY url) ELSE '' END AS folder FROM c")
def output_folders(spark, sf):
    return tables.output_folders(_site(spark, sf).withColumn("part", F.lit("page")), "host", ["host", "part"], "url", "page_id").select("page_id", "folder")


@query()
def homepage_links(spark, sf):
    return sitemaps.homepage_links(h.parse_pages(table(spark, sf, "pages").select("url", "html")))


@query()
def parse_names(spark, sf):
    p = h.parse_pages(table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", en.parse_name(h.title(F.col("page")), ("Rotterdam", "Milano")).alias("n"))
    return p.select("page_id", "n.name", "n.location", "n.about")


@query()
def batch_predict(spark, sf):
    return table(spark, sf, "pages").select("page_id", en.predict(F.col("url"), F.lit("")).alias("p")).select("page_id", "p.category", "p.type")


@query()
def url_skus(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(urls.skus(F.col("url")), ",").alias("skus"))


@query()
def infer_org_solo(spark, sf):
    p, b = F.col("primary"), F.col("body")
    return _classified(spark, sf).select("doc_id", en.org_or_solo(p, b, F.lit(None).cast("string")).alias("kind"), F.array_join(en.fields(p, b), ",").alias("fields"), F.array_join(rules.roles(p, b), ",").alias("roles"), rules.types_cascade(p, b).alias("type"))


@query()
def text_plain_from_markdown(spark, sf):
    """Every document read as Markdown."""
    return table(spark, sf, "documents").select("doc_id", tx.plain_from_markdown(F.col("text")).alias("plain"))


@query()
def match_vectors(spark, sf):
    """Every benchmark text against the embedded descriptions of a small taxonomy."""
    described = [("Articles", "the of a an"), ("Languages", "der die das und la le el los"), ("Numbers", "one two three four five six")]
    options = vectors.taxonomy_vectors(spark.createDataFrame(described, "option string, description string"))
    return vectors.match_texts(table(spark, sf, "benchmark"), "item_id", "text", options, -1.0).select("item_id", "option", F.round("similarity", 6).alias("similarity"))


@query()
def job_states(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.get(F.array(*map(F.lit, ("start", "pause", "resume", "fail", "view"))), (F.col("event_id") % 5).cast("int")).alias("event"))
    return jobs.statuses(e, "user_id", "at", "event")


@query("WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, CASE WHEN event_id % 4 = 0 THEN 'completed' ELSE event_type END AS line, ts FROM events), s AS (SELECT user_id, line, back, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM k WHERE back <= 20) SELECT user_id, seq, line FROM s UNION ALL SELECT user_id, seq + 1, 'DONE' FROM s WHERE back = 1 AND line = 'completed'")
def log_feed(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id")).withColumn("line", F.when(F.col("event_id") % 4 == 0, "completed").otherwise(F.col("event_type")))
    return jobs.log_feed(e, "user_id", "at", "line", 20)


_NAMES = ("the", "that", "with", "data", "of", "other")
_NAMED = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS label, {i} AS ord, CASE WHEN list_contains(ps, '{n}') THEN 5 WHEN '{n}' <> 'data' AND len(list_filter(bs, lambda x: x = '{n}')) >= 5 THEN 3 ELSE 0 END AS score FROM e" for i, n in enumerate(_NAMES[:-1]))


@query(f"WITH e AS ({_DOCUMENTS}), s AS ({_NAMED}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS n FROM s WHERE score >= 3), t AS (SELECT doc_id, string_agg(label, ',' ORDER BY n) AS tags FROM r WHERE n <= 4 GROUP BY doc_id) SELECT documents.doc_id, coalesce(tags, '') AS tags FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id")
def known_tags(spark, sf):
    return _classified(spark, sf).select("doc_id", F.array_join(rules.known_tags(F.col("primary"), F.col("body"), list(_NAMES)), ",").alias("tags"))


@query()
def creative_tags(spark, sf):
    return _classified(spark, sf).select("doc_id", F.array_join(rules.creative_tags(F.col("primary"), F.col("body"), ["the", "or", "AI"]), ",").alias("tags"))
