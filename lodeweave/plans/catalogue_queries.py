"""Registered catalogue queries with their SQL. Nations stand for categories, regions for workspaces, customers for jobs,
orders for pages, line items for links."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.operators import catalogue as cat
from lodeweave.operators import containment, formulas, resolve
from lodeweave.plans.registry import query, table


@query("SELECT r_regionkey, r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_categories, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n_jobs FROM region")
def catalog_workspace_counts(spark, sf):
    nation = table(spark, sf, "nation")
    jobs = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey")
    return cat.with_counts(table(spark, sf, "region"), "r_regionkey", [(nation, "n_regionkey", "n_categories"), (jobs, "n_regionkey", "n_jobs")])


@query("SELECT n_regionkey, n_nationkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP(n_regionkey, n_nationkey, c_mktsegment)")
def catalog_tree(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    jobs = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return cat.tree_counts(jobs, ["n_regionkey", "n_nationkey", "c_mktsegment"])


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size % 5 END AS category_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS type_id FROM part),
t AS (SELECT DISTINCT p_size AS type_id, CASE WHEN p_size % 11 = 0 THEN (p_size + 1) % 5 ELSE p_size % 5 END AS category_id FROM part),
l AS (SELECT category_id, type_id FROM t UNION ALL SELECT DISTINCT category_id, NULL FROM t),
n AS (SELECT category_id, type_id, count(*) AS n FROM p GROUP BY ALL),
j AS (SELECT l.category_id, l.type_id, coalesce(n.n, 0) AS n_pages FROM l LEFT JOIN n ON l.category_id IS NOT DISTINCT FROM n.category_id AND l.type_id IS NOT DISTINCT FROM n.type_id)
SELECT *, (sum(n_pages) OVER (PARTITION BY category_id))::BIGINT AS category_total FROM j""")
def catalog_explorer(spark, sf):
    part = table(spark, sf, "part")
    pages = part.select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") % 5).alias("category_id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("type_id"))
    types = part.select(F.col("p_size").alias("type_id"), F.when(F.col("p_size") % 11 == 0, (F.col("p_size") + 1) % 5).otherwise(F.col("p_size") % 5).alias("category_id")).distinct()
    return cat.explorer(pages, types.select("category_id").distinct(), types)


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def catalog_enriched(spark, sf):
    t = {name: table(spark, sf, name) for name in ("customer", "nation", "region")}
    steps = [("o_custkey", t["customer"], "c_custkey", "c_nationkey", "category"), ("category", t["nation"], "n_nationkey", "n_regionkey", "workspace")]
    none = F.lit(None).cast("int")
    pages = resolve.owners(table(spark, sf, "orders").select("o_orderkey", "o_custkey", none.alias("category"), none.alias("workspace")), steps)
    names = [(t["customer"], "c_custkey", "c_name", "o_custkey", "c_name"), (t["nation"], "n_nationkey", "n_name", "category", "n_name"), (t["region"], "r_regionkey", "r_name", "workspace", "r_name")]
    return cat.enrich(pages, names).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT l_orderkey, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS tag FROM lineitem) GROUP BY l_orderkey")
def catalog_tags(spark, sf):
    links = table(spark, sf, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("tag"))
    return cat.gather(links, "l_orderkey", "tag", "tags").withColumn("tags", F.array_join("tags", ","))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END"


@query(f"SELECT o_custkey, count(*) AS n_pages, count_if(s IN ('completed', 'failed'))::BIGINT AS n_done, count_if(s = 'completed')::BIGINT AS n_completed, count_if(s = 'failed')::BIGINT AS n_failed, count_if(s = 'pending')::BIGINT AS n_pending, CASE WHEN count_if(s = 'pending') = 0 THEN 'completed' ELSE 'paused' END AS status FROM (SELECT o_custkey, {_STATUS} AS s FROM orders) GROUP BY o_custkey")
def job_status_counters(spark, sf):
    return cat.job_status(table(spark, sf, "orders").select("o_custkey", F.expr(_STATUS).alias("s")), "o_custkey", "s")


@query("SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE value > 50) AS first_kind, arg_min(props, event_id) FILTER (WHERE event_type = 'click') AS first_click FROM events GROUP BY user_id")
def contact_rollup(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("value") > 50, F.col("event_type")).otherwise("").alias("first_kind"), F.when(F.col("event_type") == "click", F.col("props")).alias("first_click"))
    return cat.first_non_empty(e, "user_id", "event_id", ["first_kind", "first_click"])


@query("SELECT conv_id, arg_min(text, {'a': CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, 'b': turn, 'c': text}) AS title FROM conversations GROUP BY conv_id")
def best_title_per_job(spark, sf):
    wanted = [F.when(F.col("role") == "assistant", 0).otherwise(1), F.col("turn"), F.col("text")]
    return cat.best_of(table(spark, sf, "conversations"), "conv_id", wanted, ["text"]).withColumnRenamed("text", "title")


_SCORED = "SELECT *, c_custkey % 97 AS site, (CASE WHEN c_acctbal > 5000 THEN 5 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS score FROM customer"


def _scored(spark, sf):
    c = table(spark, sf, "customer").withColumn("site", F.col("c_custkey") % 97)
    return c, F.when(F.col("c_acctbal") > 5000, 5).otherwise(0) + F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)


@query(f"SELECT site, c_custkey, row_number() OVER (PARTITION BY site ORDER BY score DESC, c_nationkey, c_custkey) AS place FROM ({_SCORED})")
def dedupe_master(spark, sf):
    c, score = _scored(spark, sf)
    return cat.elect(c, ["site"], score, "c_nationkey", "c_custkey").select("site", "c_custkey", "place")


@query(f"WITH s AS (SELECT *, CASE WHEN c_acctbal > 8000 THEN c_name END AS about, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS seg, {{'a': -score, 'b': c_nationkey, 'c': c_custkey}} AS k FROM ({_SCORED})) SELECT site, count(*) AS n_rows, arg_min(c_custkey, k) AS master_id, arg_min(about, k) FILTER (WHERE about IS NOT NULL) AS about, arg_min(seg, k) FILTER (WHERE seg IS NOT NULL) AS seg FROM s GROUP BY site")
def dedupe_merge(spark, sf):
    c, score = _scored(spark, sf)
    c = c.withColumn("about", F.when(F.col("c_acctbal") > 8000, F.col("c_name"))).withColumn("seg", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    return cat.merge_duplicates(c, ["site"], score, "c_nationkey", "c_custkey", ["about", "seg"])


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS e FROM lineitem), s AS (SELECT id, count(*) AS n, list(e ORDER BY e) AS l FROM e GROUP BY id),
c AS (SELECT min(id) AS id, n FROM s GROUP BY n, l), r AS (SELECT e.id, e, n FROM e JOIN c ON c.id = e.id)
SELECT a.id AS small, b.id AS large FROM r a JOIN r b ON a.e = b.e AND a.id <> b.id GROUP BY a.id, b.id, a.n HAVING count(*) = a.n""")
def dedupe_subsumed(spark, sf):
    """Orders whose parts all stand in another order, one of those with the same parts each."""
    links = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return containment.contained(links, links, "l_orderkey", "l_partkey")


_RECORD = "c_custkey, c_nationkey % 5 AS site, c_mktsegment AS seg, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS number, CASE WHEN c_acctbal > 2000 THEN c_name END AS about, c_custkey % 211 = 5 AS master_flag, CASE WHEN c_acctbal > 5000 THEN 5 ELSE 0 END AS score"


@query(f"""WITH c AS (SELECT {_RECORD} FROM customer), l AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS rel FROM orders GROUP BY 1),
r AS (SELECT c.*, coalesce(l.rel, []) AS rel FROM c LEFT JOIN l ON o_custkey = c_custkey),
m AS (SELECT site, seg, arg_min(c_custkey, {{'f': NOT master_flag, 's': CASE WHEN master_flag THEN 0 ELSE -score END, 'n': c_nationkey, 'k': c_custkey}}) AS master FROM (SELECT r.*, customer.c_nationkey FROM r JOIN customer USING (c_custkey)) GROUP BY site, seg HAVING count(*) > 1)
SELECT d.c_custkey AS id, m.master, CASE WHEN (d.number IS NULL OR coalesce(d.number = x.number, false)) AND (d.about IS NULL OR x.about IS NOT NULL) AND list_has_all(x.rel, d.rel) THEN 'archive' ELSE 'link' END AS action
FROM r d JOIN m ON m.site = d.site AND m.seg = d.seg JOIN r x ON x.c_custkey = m.master WHERE d.c_custkey <> m.master""")
def cleanup_duplicates(spark, sf):
    """Customers of one site and segment: archived if the group's master has all that they have, else linked with it."""
    c = table(spark, sf, "customer").selectExpr("c_nationkey", *[x.strip() for x in _RECORD.replace("CASE", "case").split(", ")])
    pairs = containment.masters(c, ["site", "seg"], "c_custkey", F.col("score"), "c_nationkey", "master_flag")
    orders = table(spark, sf, "orders")
    return containment.cleaned_up(c, "c_custkey", pairs, ["number"], ["about"], [(orders, "o_custkey", "o_orderstatus")])


@query("""WITH s AS (SELECT o_orderkey::VARCHAR AS url, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS lastmod, CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'completed' END AS status FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey::VARCHAR AS url, strftime(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 2), '%Y-%m-%d') AS lastmod FROM orders WHERE o_orderkey % 4 <> 0),
j AS (SELECT coalesce(s.url, n.url) AS url, s.lastmod AS o, n.lastmod AS w, s.status AS was, CASE WHEN s.url IS NULL THEN 'insert' WHEN n.url IS NULL THEN 'keep' WHEN s.status = 'failed' THEN 'retry' WHEN n.lastmod > s.lastmod THEN 'refresh' WHEN s.lastmod IS NULL AND n.lastmod IS NOT NULL THEN 'fill' ELSE 'keep' END AS action FROM s FULL JOIN n ON s.url = n.url)
SELECT url, CASE WHEN action IN ('insert', 'refresh', 'fill') THEN w ELSE o END AS lastmod, CASE WHEN action IN ('insert', 'retry', 'refresh') THEN 'pending' ELSE was END AS status, action FROM j""")
def upsert_incremental(spark, sf):
    o = table(spark, sf, "orders").withColumn("url", F.col("o_orderkey").cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stored = o.where("o_orderkey % 3 <> 0").select("url", F.when(F.col("o_orderkey") % 5 != 0, day).alias("lastmod"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"))
    seen = o.where("o_orderkey % 4 <> 0").select("url", F.date_format(F.expr("date_add(o_orderdate, cast(o_orderkey % 2 as int))"), "yyyy-MM-dd").alias("lastmod"))
    return cat.reconcile(stored, seen)


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 10 <> 0")
def delete_unlink(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    kept = cat.cascade_delete(c, c.where("c_custkey % 10 = 0"), "c_custkey", "c_custkey")
    return cat.unlink(kept, table(spark, sf, "nation").where("n_nationkey < 5"), "c_nationkey", "n_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT * FROM (VALUES (100, 'NEW')) v")
def insert_if_absent(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return cat.insert_if_absent(n, spark.createDataFrame([(100, "NEW"), (3, "X"), (100, "NEW")], "n_nationkey int, n_name string"), ["n_nationkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 3 THEN 'SET' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def cascade_update(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    u = c.where("c_custkey % 3 = 0 or c_custkey % 6 = 1").select("c_custkey", F.struct((F.col("c_custkey") % 6 != 1).alias("is_set"), F.when(F.col("c_custkey") % 6 == 3, "SET").alias("value")).alias("c_mktsegment"))
    return cat.set_or_keep(c, u, "c_custkey", ["c_mktsegment"])


@query("SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total, avg((l_returnflag = 'R')::INT) AS percent_checked, count_if(l_returnflag <> 'R')::BIGINT AS unchecked, count(DISTINCT l_quantity) AS n_unique FROM lineitem GROUP BY l_orderkey")
def rollups(spark, sf):
    return cat.rollup(table(spark, sf, "lineitem").withColumn("done", F.col("l_returnflag") == "R"), "l_orderkey", "l_quantity", "done")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN 'discount' ELSE 'full' END AS kind, l_extendedprice * (1 - l_discount) AS price, CASE WHEN l_quantity - 1 <> 0 THEN l_extendedprice / (l_quantity - 1) END AS unit, strftime(l_shipdate, '%y') AS year2, (date_diff('day', DATE '1990-01-01', l_shipdate::DATE) * 1440)::BIGINT AS minutes FROM lineitem")
def formula_price(spark, sf):
    li = table(spark, sf, "lineitem")
    unit = F.try_divide("l_extendedprice", F.col("l_quantity") - 1)
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0, "discount").otherwise("full").alias("kind"), formulas.discounted(F.col("l_extendedprice"), F.col("l_discount")).alias("price"), unit.alias("unit"), F.date_format("l_shipdate", "yy").alias("year2"), (F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("long") * 1440).alias("minutes"))


@query("WITH t AS (SELECT o_custkey, o_orderstatus AS s, o_totalprice AS p FROM orders) SELECT o_custkey, round(avg((s = 'F')::INT), 4) AS progress, CASE WHEN count_if(s <> 'F') = 0 THEN 'done' WHEN count_if(s = 'F') = 0 THEN 'open' ELSE 'partly' END AS state, floor(sum(p))::BIGINT AS effort FROM t GROUP BY o_custkey")
def formula_progress(spark, sf):
    o = table(spark, sf, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    made = formulas.progress(cat.rollup(o, "o_custkey", "o_totalprice", "done", "o_orderkey"))
    return made.select("o_custkey", F.round("progress", 4).alias("progress"), "state", F.floor("total").cast("long").alias("effort"))


@query("SELECT 10 * p.page_id AS id, n.n_nationkey AS value FROM (SELECT page_id FROM pages) p JOIN nation n ON n.n_nationkey = p.page_id % 25")
def token_lookup(spark, sf):
    n = table(spark, sf, "nation")
    rows = table(spark, sf, "pages").select((F.col("page_id") * 10).alias("id"), (F.col("page_id") % 25).cast("int").alias("k")).join(n, F.col("k") == F.col("n_nationkey")).select("id", F.array(F.lit("none"), F.lower("n_name"), F.lit("FRANCE")).alias("tokens"))
    return cat.token_lookup(rows, "id", F.col("tokens"), n.withColumnRenamed("n_nationkey", "value"), "n_name", "value")
