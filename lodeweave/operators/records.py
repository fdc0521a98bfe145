"""Jobs and pages with what their keys point at, changes that run from jobs to pages, pages classified and stored. Compositions of
the joins in catalogue and resolve; every join is on a key, so no step meets a whole job in one task.

Tables: jobs(job_id, workspace_id, category_id, types_id, created_at), pages(page_id, job_id, url, title, status, lastmod,
workspace_id, category_id, types_id, genre_id), workspaces(id, name, slug), categories(id, name, slug, section, workspace_id),
types(id, name, slug, category_id), genres(id, name), tags(page_id, name). Columns beyond these are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as tx
from lodeweave.operators import catalogue, resolve, rules
from lodeweave.shared import cut

# Who set a page's categories by hand, and how sure that is.
MANUAL, SURE = "user_manual", 1.0


def _with_names(df: DataFrame, workspaces: DataFrame, categories: DataFrame, types: DataFrame) -> DataFrame:
    """df with the names and slugs of its category, type and workspace; the workspace is the category's where df has none, or none
    that exists."""
    dims = [(categories, "id", c, "category_id", a) for c, a in (("name", "category_name"), ("slug", "category_slug"), ("section", "category_section"), ("workspace_id", "__owner"))]
    dims += [(types, "id", c, "types_id", f"types_{c}") for c in ("name", "slug")]
    dims += [(workspaces, "id", c, "workspace_id", f"workspace_{c}") for c in ("name", "slug")] + [(workspaces, "id", c, "__owner", f"__owner_{c}") for c in ("name", "slug")]
    named = catalogue.enrich(df, dims)
    own = F.col("workspace_name").isNotNull()
    picked = {f"workspace_{c}": F.when(own, F.col(f"workspace_{c}")).otherwise(F.col(f"__owner_{c}")) for c in ("name", "slug")}
    return named.withColumns(picked | {"workspace_id": F.coalesce("workspace_id", "__owner")}).drop("__owner", "__owner_name", "__owner_slug")


def job_records(jobs: DataFrame, pages: DataFrame, workspaces: DataFrame, categories: DataFrame, types: DataFrame) -> DataFrame:
    """jobs with names and slugs of their workspace, category and type, and how many of their pages are untitled or failed."""
    flags = pages.groupBy("job_id").agg(F.count_if(F.coalesce(tx.is_untitled(F.col("title")), F.lit(True))).alias("untitled_count"), F.count_if(F.col("status") == "failed").alias("failed_count"))
    return _with_names(jobs, workspaces, categories, types).join(flags, "job_id", "left").na.fill(0, ["untitled_count", "failed_count"])


def page_records(pages: DataFrame, jobs: DataFrame, workspaces: DataFrame, categories: DataFrame, types: DataFrame, genres: DataFrame, tags: DataFrame) -> DataFrame:
    """pages with names and slugs, genre_name, tag_names (sorted), scraped_at (the job's start, else the page's own date) and is_untitled."""
    named = catalogue.enrich(_with_names(pages, workspaces, categories, types), [(genres, "id", "name", "genre_id", "genre_name"), (jobs, "job_id", "created_at", "job_id", "__created")])
    listed = catalogue.gather(tags, "page_id", "name", "tag_names")
    named = named.join(listed, "page_id", "left").withColumn("tag_names", F.coalesce("tag_names", F.array().cast("array<string>")))
    when = F.coalesce(F.date_format("__created", "yyyy-MM-dd'T'HH:mm:ss"), F.col("lastmod").cast("string"))
    return named.withColumns({"scraped_at": when, "is_untitled": F.coalesce(tx.is_untitled(F.col("title")), F.lit(True))}).drop("__created")


_LEVELS = ("workspace_id", "category_id", "types_id")


def reassigned(jobs: DataFrame, pages: DataFrame, updates: DataFrame, workspaces: DataFrame, categories: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """jobs and pages after updates(job_id, and per level a struct(is_set, value)), one a job. A level that is set takes its value,
    null included; a category brings its workspace and a type its category where those are not set; a type that does not belong to
    a newly set category goes. Pages follow: those whose category or type was set count as set by hand. An update that names an
    id that does not exist changes nothing."""
    known = {"workspace_id": workspaces, "category_id": categories, "types_id": types}
    u = updates.select("job_id", *[F.coalesce(F.col(f"{c}.is_set"), F.lit(False)).alias(f"{c}__set") for c in _LEVELS], *[F.when(F.col(f"{c}.is_set"), F.col(f"{c}.value")).alias(f"{c}__new") for c in _LEVELS])
    for c, dim in known.items():
        u = u.join(dim.select(F.col("id").alias(f"{c}__new"), F.lit(True).alias(f"{c}__known")), f"{c}__new", "left")
    bad = F.lit(False)
    for c in _LEVELS:
        bad = bad | (F.col(f"{c}__new").isNotNull() & F.col(f"{c}__known").isNull())
    u = u.where(~bad).drop(*[f"{c}__known" for c in _LEVELS])
    u = catalogue.enrich(u, [(categories, "id", "workspace_id", "category_id__new", "__of_category"), (types, "id", "category_id", "types_id__new", "__of_type")])

    j = jobs.join(u.withColumn("__hit", F.lit(True)), "job_id", "left").withColumns({f"{c}__set": F.coalesce(f"{c}__set", F.lit(False)) for c in _LEVELS})
    j = catalogue.enrich(j, [(types, "id", "category_id", "types_id", "__owner"), (types, "id", "id", "types_id", "__exists")])
    w_set, c_set, t_set = (F.col(f"{c}__set") for c in _LEVELS)
    workspace = F.when(w_set, F.col("workspace_id__new")).when(c_set & F.col("__of_category").isNotNull(), F.col("__of_category")).otherwise(F.col("workspace_id"))
    category = F.when(c_set, F.col("category_id__new")).when(t_set & F.col("__of_type").isNotNull(), F.col("__of_type")).otherwise(F.col("category_id"))
    j = j.withColumns({"__w": workspace, "__c": category})
    strayed = c_set & F.col("__exists").isNotNull() & ~F.col("__owner").eqNullSafe(F.col("__c"))
    j = j.withColumn("__t", F.when(t_set, F.col("types_id__new")).when(~strayed, F.col("types_id")))
    new_jobs = j.withColumns({"workspace_id": F.col("__w"), "category_id": F.col("__c"), "types_id": F.col("__t")}).select(*jobs.columns)

    told = j.where("__hit").select("job_id", w_set.alias("__w_set"), c_set.alias("__c_set"), t_set.alias("__t_set"), "__w", "__c", "__t")
    p = pages.join(told, "job_id", "left").withColumns({x: F.coalesce(x, F.lit(False)) for x in ("__w_set", "__c_set", "__t_set")})
    by_hand = F.col("__c_set") | F.col("__t_set")
    changes = {
        "workspace_id": F.when(F.col("__w_set") | (F.col("__c_set") & F.col("__w").isNotNull()), F.col("__w")).otherwise(F.col("workspace_id")),
        "category_id": F.when(F.col("__c_set") | (F.col("__t_set") & F.col("__c").isNotNull()), F.col("__c")).otherwise(F.col("category_id")),
        "types_id": F.when(F.col("__t_set"), F.col("__t")).when(~(F.col("__c_set") & F.col("__t").isNull()), F.col("types_id")),
        "categorization_source": F.when(by_hand, MANUAL).otherwise(F.col("categorization_source")),
        "categorization_confidence": F.when(by_hand, SURE).otherwise(F.col("categorization_confidence")),
    }
    return new_jobs, p.withColumns(changes).select(*pages.columns)


def stored_pages(stored: DataFrame, scraped: DataFrame, jobs: DataFrame, keep: Sequence[str] = ("hreflang", "lastmod")) -> DataFrame:
    """stored pages with the scraped ones put in by (job_id, url), one row each in both. What was scraped replaces what was stored, but
    for `keep`, which stay where nothing new was found. Categories stay where the page has them, else are the job's, else those of
    the classification; its source and confidence are taken over. Columns only one side has are null on the other."""
    levels = [*_LEVELS, "genre_id"]
    rest = [c for c in scraped.columns if c not in ("job_id", "url", *levels)]
    s = stored.withColumn("__old", F.lit(True))
    n = scraped.select("job_id", "url", *[F.col(c).alias(f"__n_{c}") for c in scraped.columns if c not in ("job_id", "url")], F.lit(True).alias("__new"))
    both = s.join(n, ["job_id", "url"], "full_outer")
    both = catalogue.enrich(both, [(jobs, "job_id", c, "job_id", f"__j_{c}") for c in _LEVELS])
    made = {}
    for c in dict.fromkeys([*stored.columns, *scraped.columns]):
        if c in ("job_id", "url"):
            continue
        old = F.col(c) if c in stored.columns else F.lit(None)
        new = F.col(f"__n_{c}") if c in scraped.columns else F.lit(None)
        if c in levels:
            value = F.coalesce(old, F.col(f"__j_{c}"), new) if c in _LEVELS else F.coalesce(old, new)
            made[c] = F.when(F.col("__new"), value).otherwise(old)
        elif c in keep:
            made[c] = F.coalesce(new, old)
        elif c in rest:
            made[c] = F.when(F.col("__new"), new).otherwise(old)
    columns = list(dict.fromkeys([*stored.columns, *scraped.columns]))
    return both.withColumns(made).select(*columns)


def classified(pages: DataFrame, near_category: DataFrame, near_type: DataFrame, dims: dict[str, DataFrame], tables: dict[str, rules.Rules] | None = None) -> DataFrame:
    """pages(page_id, title, description, body, url) to page_id, category, type, genre, tags, source, confidence and the ids category_id,
    types_id, genre_id, tag_ids: rules and nearest taxonomy vectors (near_...: page_id, option, similarity), arbitrated, then looked
    up by slug or name; a type that is not known becomes the category's first. dims: categories, types, genres and tags (id, name;
    types with category_id). tables: rule tables in place of the production ones, by category, type, tag, genre."""
    t = {"category": rules.CATEGORY_RULES, "type": rules.TYPE_RULES, "tag": rules.TAG_RULES, "genre": rules.GENRE_RULES} | (tables or {})
    f = pages.select("page_id", rules.features(F.col("title"), F.col("description"), F.col("body"), F.col("url")).alias("f")).select("page_id", "f.primary", "f.body")
    p, b = F.col("primary"), F.col("body")
    found = f.select("page_id", rules.labels(p, b, t["category"], t["type"], t["tag"], t["genre"]).alias("l")).select("page_id", F.col("l.category").alias("c"), F.col("l.type").alias("k"), "l.tags", "l.genre")
    for near, name in ((near_category, "__nc"), (near_type, "__nt")):
        found = found.join(near.select("page_id", F.col("option").alias(name), F.col("similarity").alias(f"{name}_sim")), "page_id", "left")
    chosen = rules.arbitrate(F.col("c.label"), F.col("c.score"), F.col("__nc"), F.col("__nc_sim"), F.col("k.label"), F.col("k.score"), F.col("__nt"), F.col("__nt_sim"))
    found = found.withColumn("a", chosen).select("page_id", "a.category", "a.type", "genre", "tags", "a.source", "a.confidence")
    found = cut(found, "classified")  # each lookup of ids reads it anew
    found = resolve.ids_of(found, "category", dims["categories"], "id", "name", "category_id")
    found = resolve.ids_of(found, "type", dims["types"], "id", "name", "types_id")
    found = resolve.any_of_parent(found, "types_id", "category_id", dims["types"], "id", "category_id")
    found = resolve.ids_of(found, "genre", dims["genres"], "id", "name", "genre_id")
    each = resolve.ids_of(found.select("page_id", F.posexplode("tags").alias("pos", "tag")), "tag", dims["tags"], "id", "name", "tag_id").where("tag_id is not null")
    ids = each.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag_id"))), lambda x: x["tag_id"]).alias("tag_ids"))
    return found.join(ids, "page_id", "left").withColumn("tag_ids", F.coalesce("tag_ids", F.array().cast(ids.schema["tag_ids"].dataType)))


def real_title(title: Column) -> Column:
    """The title, trimmed, if it is one: not empty, not Untitled, no path and no address; else null."""
    t = F.trim(title)
    return F.when((t != "") & (t != "Untitled") & ~t.startswith("/") & ~t.startswith("http"), t)


def filled_jobs(jobs: DataFrame, pages: DataFrame, fallback: Column) -> DataFrame:
    """jobs(job_id, target_url, title, icon_url, ...) whose title or icon is missing, filled from their pages: a completed page before
    others, then by id, the first real title and the first icon, those of the job's own address before all. A job without any icon
    gets `fallback`, a column over jobs."""
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")
    todo = jobs.where(F.col("title").isNull() | F.col("icon_url").isNull()).select("job_id", trimmed(F.col("target_url")).alias("__target"), F.nullif(F.trim("title"), F.lit("")).alias("__t"), F.nullif("icon_url", F.lit("")).alias("__i"))
    p = pages.join(todo, "job_id").select("job_id", "__t", "__i", real_title(F.col("title")).alias("title"), F.nullif(F.col("icon_url"), F.lit("")).alias("icon"), (trimmed(F.col("url")) == F.col("__target")).alias("root"), (F.col("status") != "completed").alias("late"), "page_id")
    # an own value gives way to the root page's only
    def best(value: str, own: str) -> Column:
        usable = F.col(value).isNotNull() & (F.col("root") | F.col(own).isNull())
        return F.min_by(value, F.when(usable, F.struct(~F.col("root"), F.col("late"), F.col("page_id"))))

    picked = p.groupBy("job_id").agg(best("title", "__t").alias("__title"), best("icon", "__i").alias("__icon"))
    j = jobs.join(picked, "job_id", "left")
    missing = F.col("title").isNull() | F.col("icon_url").isNull()
    host_known = F.coalesce(fallback, F.lit("")) != ""
    icon = F.coalesce("__icon", "icon_url", F.when(host_known, fallback))
    return j.withColumns({"title": F.when(missing, F.coalesce("__title", "title")).otherwise(F.col("title")), "icon_url": F.when(missing, icon).otherwise(F.col("icon_url"))}).select(*jobs.columns)


def migrated(old: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """A table of an earlier generation with the columns it lacks: columns gives name -> (type, default). What is there stays."""
    added = {c: F.lit(value).cast(kind) for c, (kind, value) in columns.items() if c not in old.columns}
    return old.withColumns(added) if added else old
