"""Registered queries of records, cascades, page storage, classification and back-fills, with their SQL. Customers stand for jobs,
orders for pages, regions for workspaces, nations for categories, sizes of parts for types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import urls
from lodeweave.operators import records, rules, vectors
from lodeweave.plans.registry import query, table
from lodeweave.shared import cut

#: The same expressions for Spark and for DuckDB: name -> (table, columns).
_SOURCES = {
    "jobs": ("customer", (
        "c_custkey AS job_id", "CASE WHEN c_custkey % 3 = 0 THEN c_nationkey % 7 END AS workspace_id", "CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS category_id",
        "CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 60 AS INT) END AS types_id", "CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01 10:00:00' END AS created_at",
    )),
    "pages": ("orders", (
        "o_orderkey AS page_id", "o_custkey AS job_id", "concat('https://p.example/', o_orderkey) AS url", "CASE WHEN o_orderkey % 5 = 0 THEN 'Untitled' ELSE o_orderpriority END AS title",
        "CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status", "substring(CAST(o_orderdate AS STRING), 1, 10) AS lastmod", "CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey % 8 AS INT) END AS workspace_id",
        "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 30 AS INT) END AS category_id", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 60 AS INT) END AS types_id", "CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 12 AS INT) END AS genre_id",
        "CAST('dual_hybrid' AS STRING) AS categorization_source", "CAST(0.5 AS DOUBLE) AS categorization_confidence",
    )),
    "workspaces": ("region", ("r_regionkey AS id", "r_name AS name", "lower(r_name) AS slug")),
    "categories": ("nation", ("n_nationkey AS id", "n_name AS name", "lower(n_name) AS slug", "concat('s', n_regionkey) AS section", "CASE WHEN n_nationkey % 6 <> 5 THEN n_regionkey END AS workspace_id")),
    "types": ("part", ("p_size AS id", "concat('type ', p_size) AS name", "concat('type-', p_size) AS slug", "p_size % 25 AS category_id")),
    "genres": ("supplier", ("s_nationkey % 10 AS id", "concat('genre ', s_nationkey % 10) AS name")),
    "tags": ("lineitem", ("l_orderkey AS page_id", "concat(l_returnflag, l_linestatus) AS name")),
}
_WITH = "WITH " + ", ".join(f"{name} AS (SELECT DISTINCT {', '.join(columns)} FROM {source})" for name, (source, columns) in _SOURCES.items())


def _read(spark, sf) -> dict[str, DataFrame]:
    return {name: table(spark, sf, source).selectExpr(*columns).distinct() for name, (source, columns) in _SOURCES.items()}


_NAMES = "coalesce(x.workspace_id, c.workspace_id) AS workspace_id, CASE WHEN w.name IS NOT NULL THEN w.name ELSE o.name END AS workspace_name, CASE WHEN w.name IS NOT NULL THEN w.slug ELSE o.slug END AS workspace_slug, x.category_id, c.name AS category_name, c.slug AS category_slug, c.section AS category_section, x.types_id, t.name AS types_name, t.slug AS types_slug"
_JOINS = "LEFT JOIN categories c ON c.id = x.category_id LEFT JOIN types t ON t.id = x.types_id LEFT JOIN workspaces w ON w.id = x.workspace_id LEFT JOIN workspaces o ON o.id = c.workspace_id"


@query(f"""{_WITH}, n AS (SELECT job_id, count_if(title = 'Untitled')::BIGINT AS u, count_if(status = 'failed')::BIGINT AS f FROM pages GROUP BY job_id)
SELECT x.job_id, {_NAMES}, coalesce(u, 0) AS untitled_count, coalesce(f, 0) AS failed_count FROM jobs x {_JOINS} LEFT JOIN n ON n.job_id = x.job_id""")
def job_records(spark, sf):
    t = _read(spark, sf)
    return records.job_records(t["jobs"], t["pages"], t["workspaces"], t["categories"], t["types"]).drop("created_at")


@query(f"""{_WITH}, g AS (SELECT page_id, string_agg(name, ',' ORDER BY name) AS tags FROM tags GROUP BY page_id)
SELECT x.page_id, {_NAMES}, r.name AS genre_name, coalesce(tags, '') AS tag_names, coalesce(strftime(created_at, '%Y-%m-%dT%H:%M:%S'), lastmod) AS scraped_at, title = 'Untitled' AS is_untitled
FROM pages x {_JOINS} LEFT JOIN genres r ON r.id = x.genre_id LEFT JOIN g ON g.page_id = x.page_id LEFT JOIN jobs j ON j.job_id = x.job_id""")
def page_records(spark, sf):
    t = _read(spark, sf)
    found = records.page_records(t["pages"], t["jobs"], t["workspaces"], t["categories"], t["types"], t["genres"], t["tags"])
    names = [f"{x}_{c}" for x in ("workspace", "category", "types") for c in ("id", "name", "slug")]
    return found.select("page_id", *names, "category_section", "genre_name", F.array_join("tag_names", ",").alias("tag_names"), "scraped_at", "is_untitled")


#: Updates of some jobs: which levels are set and to what (99 does not exist).
_UPDATE = (
    "job_id", "job_id % 4 = 0 AS w_set", "CASE WHEN job_id % 8 = 0 THEN CAST(job_id % 5 AS INT) END AS w", "job_id % 3 = 0 AS c_set", "CASE WHEN job_id % 33 = 0 THEN 99 WHEN job_id % 9 <> 0 THEN CAST(job_id % 25 AS INT) END AS c",
    "job_id % 5 = 0 AS t_set", "CASE WHEN job_id % 10 <> 0 THEN CAST(1 + job_id % 50 AS INT) END AS t",
)
_CASCADE = f"""{_WITH}, u0 AS (SELECT {', '.join(_UPDATE)} FROM jobs WHERE job_id % 7 <> 0),
u AS (SELECT u0.*, c.workspace_id AS of_c, t.category_id AS of_t FROM u0 LEFT JOIN categories c ON c.id = u0.c LEFT JOIN types t ON t.id = u0.t LEFT JOIN workspaces w ON w.id = u0.w
  WHERE NOT ((w_set AND u0.w IS NOT NULL AND w.id IS NULL) OR (c_set AND u0.c IS NOT NULL AND c.id IS NULL) OR (t_set AND u0.t IS NOT NULL AND t.id IS NULL))),
a AS (SELECT j.*, u.job_id IS NOT NULL AS hit, coalesce(w_set, false) AS ws, coalesce(c_set, false) AS cs, coalesce(t_set, false) AS ts, u.w, u.c, u.t, of_c, of_t FROM jobs j LEFT JOIN u ON u.job_id = j.job_id),
b AS (SELECT a.*, CASE WHEN ws THEN w WHEN cs AND c IS NOT NULL AND of_c IS NOT NULL THEN of_c ELSE workspace_id END AS nw, CASE WHEN cs THEN c WHEN ts AND t IS NOT NULL AND of_t IS NOT NULL THEN of_t ELSE category_id END AS nc FROM a),
n AS (SELECT b.*, CASE WHEN ts THEN t WHEN cs AND y.id IS NOT NULL AND y.category_id IS DISTINCT FROM nc THEN NULL ELSE b.types_id END AS nt FROM b LEFT JOIN types y ON y.id = b.types_id)"""


def _reassigned(spark, sf):
    t = _read(spark, sf)
    u = t["jobs"].where("job_id % 7 <> 0").selectExpr(*_UPDATE)
    levels = {"workspace_id": "w", "category_id": "c", "types_id": "t"}
    u = u.select("job_id", *[F.struct(F.col(f"{x}_set").alias("is_set"), F.col(x).alias("value")).alias(level) for level, x in levels.items()])
    return records.reassigned(t["jobs"], t["pages"], u, t["workspaces"], t["categories"], t["types"])


@query(f"{_CASCADE} SELECT job_id, nw AS workspace_id, nc AS category_id, nt AS types_id FROM n")
def job_reassigned(spark, sf):
    return _reassigned(spark, sf)[0].drop("created_at")


@query(f"""{_CASCADE} SELECT p.page_id, CASE WHEN ws OR (cs AND nw IS NOT NULL) THEN nw ELSE p.workspace_id END AS workspace_id, CASE WHEN cs OR (ts AND nc IS NOT NULL) THEN nc ELSE p.category_id END AS category_id,
CASE WHEN ts THEN nt WHEN cs AND nt IS NULL THEN NULL ELSE p.types_id END AS types_id, CASE WHEN cs OR ts THEN 'user_manual' ELSE categorization_source END AS categorization_source, CASE WHEN cs OR ts THEN 1.0::DOUBLE ELSE categorization_confidence END AS categorization_confidence
FROM pages p LEFT JOIN n ON n.job_id = p.job_id AND n.hit""")
def page_reassigned(spark, sf):
    return _reassigned(spark, sf)[1].select("page_id", "workspace_id", "category_id", "types_id", "categorization_source", "categorization_confidence")


#: What a visit found: pages not seen before among them, without dates for some, and what the classifier makes of them.
_VISIT = ("job_id", "concat(url, CASE WHEN page_id % 4 = 0 THEN '/new' ELSE '' END) AS url", "concat(title, '!') AS title", "CASE WHEN page_id % 3 = 0 THEN '2025-01-01' END AS lastmod", "CAST(page_id % 11 AS INT) AS category_id", "CAST(page_id % 13 AS INT) AS types_id", "CASE WHEN page_id % 2 = 0 THEN CAST(3 AS INT) END AS genre_id", "'jev' AS categorization_source")


@query(f"""{_WITH}, s AS (SELECT job_id, url, {', '.join(f"CASE WHEN page_id % 3 = 1 THEN NULL ELSE {c} END AS {c}" for c in ("title", "lastmod"))}, workspace_id, category_id, types_id, genre_id, categorization_source FROM pages WHERE page_id % 5 <> 0),
v AS (SELECT {', '.join(_VISIT)} FROM pages WHERE page_id % 2 = 0)
SELECT coalesce(s.job_id, v.job_id) AS job_id, coalesce(s.url, v.url) AS url, CASE WHEN v.url IS NOT NULL THEN v.title ELSE s.title END AS title, coalesce(v.lastmod, s.lastmod) AS lastmod,
CASE WHEN v.url IS NOT NULL THEN coalesce(s.workspace_id, j.workspace_id) ELSE s.workspace_id END AS workspace_id, CASE WHEN v.url IS NOT NULL THEN coalesce(s.category_id, j.category_id, v.category_id) ELSE s.category_id END AS category_id,
CASE WHEN v.url IS NOT NULL THEN coalesce(s.types_id, j.types_id, v.types_id) ELSE s.types_id END AS types_id, CASE WHEN v.url IS NOT NULL THEN coalesce(s.genre_id, v.genre_id) ELSE s.genre_id END AS genre_id,
CASE WHEN v.url IS NOT NULL THEN v.categorization_source ELSE s.categorization_source END AS categorization_source
FROM s FULL JOIN v ON s.job_id = v.job_id AND s.url = v.url LEFT JOIN jobs j ON j.job_id = coalesce(s.job_id, v.job_id)""")
def pages_stored(spark, sf):
    t = _read(spark, sf)
    stored = t["pages"].where("page_id % 5 <> 0").selectExpr("job_id", "url", "CASE WHEN page_id % 3 = 1 THEN NULL ELSE title END AS title", "CASE WHEN page_id % 3 = 1 THEN NULL ELSE lastmod END AS lastmod", "workspace_id", "category_id", "types_id", "genre_id", "categorization_source")
    return records.stored_pages(stored, t["pages"].where("page_id % 2 = 0").selectExpr(*_VISIT), t["jobs"])


@query(f"""{_WITH}, j AS (SELECT job_id, concat('https://p.example/', job_id * 10) AS target, CASE WHEN job_id % 3 = 0 THEN 'own' END AS title, CASE WHEN job_id % 4 = 0 THEN 'own.png' END AS icon FROM jobs),
p AS (SELECT p.*, CASE WHEN page_id % 2 = 0 THEN concat('i', page_id, '.png') END AS icon, p.url = j.target AS root, j.title AS jt, j.icon AS ji FROM pages p JOIN j USING (job_id) WHERE j.title IS NULL OR j.icon IS NULL),
f AS (SELECT job_id, arg_min(title, {{'r': NOT root, 's': status <> 'completed', 'i': page_id}}) FILTER (WHERE title <> 'Untitled' AND (root OR jt IS NULL)) AS t, arg_min(icon, {{'r': NOT root, 's': status <> 'completed', 'i': page_id}}) FILTER (WHERE icon IS NOT NULL AND (root OR ji IS NULL)) AS i FROM p GROUP BY job_id)
SELECT j.job_id, CASE WHEN title IS NULL OR icon IS NULL THEN coalesce(f.t, title) ELSE title END AS title, CASE WHEN title IS NULL OR icon IS NULL THEN coalesce(f.i, icon, 'https://icons.invalid/?domain=p.example') ELSE icon END AS icon_url FROM j LEFT JOIN f ON f.job_id = j.job_id""")
def jobs_backfilled(spark, sf):
    """Jobs of an earlier generation without titles and icons, filled from their pages."""
    t = _read(spark, sf)
    jobs = t["jobs"].selectExpr("job_id", "concat('https://p.example/', job_id * 10) AS target_url", "CASE WHEN job_id % 3 = 0 THEN 'own' END AS title", "CASE WHEN job_id % 4 = 0 THEN 'own.png' END AS icon_url")
    pages = t["pages"].withColumn("icon_url", F.expr("CASE WHEN page_id % 2 = 0 THEN concat('i', page_id, '.png') END"))
    return records.filled_jobs(jobs, pages, urls.fallback_icon(F.col("target_url"))).select("job_id", "title", "icon_url")


@query()
def classify_pages(spark, sf):
    """Every document as a page, by the production rules, the nearest of the described options, and the ids of names."""
    segment = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    docs = table(spark, sf, "documents").join(segment, "doc_id", "left")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("c_mktsegment").alias("title"), F.substring_index("text", "\n", 1).alias("description"), F.col("text").alias("body"), F.concat(F.lit("https://d.example/"), F.col("source")).alias("url"))
    described = [("Home", "furniture household the of and"), ("Car", "automobile der die und"), ("Writing", "machinery de la que"), ("Magazine", "building el los")]
    options = vectors.taxonomy_vectors(spark.createDataFrame(described, "option string, description string"))
    texts = pages.select("page_id", rules.features(F.col("title"), F.col("description"), F.col("body"), F.col("url"))["semantic"].alias("text"))
    near = cut(vectors.match_texts(texts, "page_id", "text", options, 0.0), "nearest_options")
    names = [(r, i) for i, r in enumerate(("Home", "Car", "Writing", "Financial", "Legal", "Technology"))]
    dims = {
        "categories": spark.createDataFrame(names, "name string, id int"),
        "types": spark.createDataFrame([("Magazine", 7, 2), ("Shop", 8, 0), ("Tools", 9, 0)], "name string, id int, category_id int"),
        "genres": spark.createDataFrame([("Design", 3)], "name string, id int"),
        "tags": spark.createDataFrame([("db", 5), ("tables", 6)], "name string, id int"),
    }
    found = records.classified(pages, near, near, dims)
    return found.select("page_id", "category", "type", "genre", F.array_join("tags", ",").alias("tags"), "source", "confidence", "category_id", "types_id", "genre_id", F.array_join(F.transform("tag_ids", lambda x: x.cast("string")), ",").alias("tag_ids"))
