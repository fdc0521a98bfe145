"""Registered URL queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import sql, urls
from lodeweave.operators import resolve
from lodeweave.plans.registry import query, table

_TRACK = ", ".join(f"'{k}'" for k in urls.TRACKING_KEYS)
_FULL = "CASE WHEN trim(url) = '' THEN '' WHEN regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim(url) ELSE 'https://' || trim(url) END"
_RX = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Form data decoded and encoded again.
_FORM = "replace(url_encode(url_decode(replace({}, '+', ' '))), '%20', '+')"
_PARTS = rf"""p AS (SELECT page_id, url, lower(regexp_extract({_FULL}, '{_RX}', 1)) AS scheme, lower(regexp_extract({_FULL}, '{_RX}', 2)) AS auth,
  regexp_extract({_FULL}, '{_RX}', 3) AS path, list_filter(string_split(regexp_extract({_FULL}, '{_RX}', 4), '&'), lambda x: x <> '') AS pairs FROM pages),
q AS (SELECT *, list_filter(pairs, lambda x: lower(split_part(x, '=', 1)) IN ({_TRACK}) OR starts_with(lower(split_part(x, '=', 1)), 'utm_')) AS stripped,
  list_filter(pairs, lambda x: NOT (lower(split_part(x, '=', 1)) IN ({_TRACK}) OR starts_with(lower(split_part(x, '=', 1)), 'utm_'))) AS retained,
  regexp_replace(path, '/+$', '') AS short FROM p),
c AS (SELECT *, scheme || '://' || auth || short || CASE WHEN len(retained) > 0 THEN '?' || array_to_string(list_transform(retained, lambda x: {_FORM.format("split_part(x, '=', 1)")} || '=' || {_FORM.format("substr(x, len(split_part(x, '=', 1)) + 2)")}), '&') ELSE '' END AS clean FROM q)"""
_NORM = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '/+$', '')"


@query(f"WITH {_PARTS} SELECT regexp_replace(auth, ':[0-9]*$', '') AS domain, regexp_extract(lower(path), '^/([a-z][a-z])(?:-[a-z][a-z])?(?:/|$)', 1) AS path_lang, count(*) AS n_pages, count(DISTINCT {_NORM}) AS n_norm, count_if(len(stripped) > 0)::BIGINT AS n_tracked FROM c GROUP BY 1, 2")
def url_domain_summary(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").groupBy(urls.domain(url).alias("domain"), urls.path_language(url).alias("path_lang")).agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct(urls.normalize(url)).alias("n_norm"), F.count_if(F.size(urls.stripped_pairs(url)) > 0).alias("n_tracked"))


@query(f"WITH {_PARTS} SELECT page_id, clean FROM c")
def url_sanitize(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.sanitize(F.col("url")).alias("clean"))


@query(f"WITH {_PARTS} SELECT page_id, url AS raw, clean, array_to_string(stripped, ' ') AS stripped, array_to_string(retained, ' ') AS retained, len(stripped) > 0 AS has_stripped FROM c")
def url_params_analysis(spark, sf):
    a = table(spark, sf, "pages").select("page_id", urls.analysis(F.col("url")).alias("a"))
    return a.select("page_id", "a.raw", "a.clean", F.array_join("a.stripped", " ").alias("stripped"), F.array_join("a.retained", " ").alias("retained"), "a.has_stripped")


@query(f"WITH {_PARTS} SELECT page_id, scheme || '://' || auth || short AS target FROM c QUALIFY row_number() OVER (PARTITION BY scheme || '://' || auth || short ORDER BY page_id) = 1")
def url_target_dedupe(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", urls.target(F.col("url")).alias("target"))
    return resolve.first_of(rows, "target", "page_id").select("page_id", "target")


@query(f"WITH {_PARTS} SELECT page_id, path AS url_path, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::BIGINT AS url_depth, regexp_replace(url, '[?#].*$', '') AS clean_url, scheme || '://' || auth || '/' AS site_root, regexp_replace(auth, '^www\\.', '') AS bare_domain, replace(auth, '.', '_') AS dotless FROM c")
def url_path_depth(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.path(url).alias("url_path"), urls.path_depth(url).alias("url_depth"), urls.without_query(url).alias("clean_url"), urls.site_root(url).alias("site_root"), urls.bare_domain(url).alias("bare_domain"), urls.domain(url, True).alias("dotless"))


_CASES = (
    ("https://x.example/en/rooms-suites", "sitemap.xml", "rooms"), ("https://x.example/it/spa/wellness", "", "wellness"), ("https://x.example/showroom/a", "", "rooms"), ("https://x.example/", "post-sitemap.xml", "pages"),
    ("https://x.example/abc", "post-sitemap.xml", "blog"), ("https://x.example/abc", "custom_blocks-sitemap.xml", "custom_blocks"), ("https://x.example/abc", "sitemap_index.xml", "pages"), ("https://x.example/folder/abc", "", "folder"),
    ("https://x.example/hotel", "", "hotels"), ("https://x.example/de-de/produkte/1", "", "products"), ("https://x.example/row/news", "", "blog"), ("https://x.example/offerte", "", "offers"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{h}', '{t}')" for u, h, t in _CASES) + ") v(url, hint, content_type) UNION ALL SELECT url, NULL, 'pages' FROM pages")
def url_content_type(spark, sf):
    cases = spark.createDataFrame([c[:2] for c in _CASES], "url string, hint string")
    rows = cases.unionByName(table(spark, sf, "pages").select("url", F.lit(None).cast("string").alias("hint")))
    return rows.select("url", "hint", urls.content_type(F.col("url"), F.col("hint")).alias("content_type"))


@query()
def extract_urls_analysed(spark, sf):
    """Links of every page's source with their parameters."""
    a = table(spark, sf, "pages").select("page_id", F.posexplode(urls.extract_analysed(F.col("html"))).alias("pos", "a"))
    return a.select("page_id", F.col("pos").cast("long").alias("pos"), "a.raw", "a.clean", F.array_join("a.stripped", " ").alias("stripped"), "a.has_stripped")


@query(f"""WITH {_PARTS} SELECT page_id, {_NORM} AS normal, regexp_replace(auth, ':[0-9]*$', '') AS host, 'pages' AS kind,
coalesce(nullif(regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'default') AS slug FROM c""")
def sql_functions(spark, sf):
    """Spark SQL alone, with the library's SQL functions."""
    sql.register(spark)
    table(spark, sf, "pages").createOrReplaceTempView("lodeweave_pages")
    return spark.sql("SELECT page_id, normalize_url(url) AS normal, url_host(url) AS host, content_type(url) AS kind, slugify(url_path(url)) AS slug FROM lodeweave_pages")


@query()
def sql_extract_urls(spark, sf):
    """Links of every page's source by a table function."""
    sql.register(spark)
    table(spark, sf, "pages").createOrReplaceTempView("lodeweave_pages")
    return spark.sql("SELECT page_id, pos, raw, clean, array_join(stripped, ' ') AS stripped, has_stripped FROM lodeweave_pages, LATERAL extract_urls(html)")


@query(f"WITH {_PARTS}, k AS (SELECT auth, page_id, row_number() OVER (PARTITION BY auth ORDER BY page_id) - 1 AS r FROM c) SELECT auth AS host, page_id, r // 40 AS session FROM k")
def url_session_batches(spark, sf):
    return resolve.session_batches(table(spark, sf, "pages").select(urls.authority(F.col("url")).alias("host"), "page_id"), "host", "page_id", 40)
