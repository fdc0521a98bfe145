"""Readers and writers of catalogue artefacts: contact sheets, page and media lists, taxonomies, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import ordinals

# Rows of a contact sheet in order.
CONTACT_KEYS = ("Email", "Phone", "Instagram", "LinkedIn", "Founded", "Location", "Icon URL")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files, as UTF-8 with bad bytes dropped."""
    return spark.read.format("binaryFile").load(path).select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """path, key, value of contact sheets (header, two columns); blank keys are left out."""
    rows = spark.read.csv(path, header=True, schema="Key string, Value string").select(F.input_file_name().alias("path"), F.trim("Key").alias("key"), F.trim("Value").alias("value"))
    return rows.where("key <> ''")


def contact_rows(records: DataFrame, job: str) -> DataFrame:
    """job, ord, Key, Value of every filled contact field, in sheet order; columns of records are named by CONTACT_KEYS."""
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("Key"), F.col(f"`{k}`").cast("string").alias("Value")) for i, k in enumerate(CONTACT_KEYS) if k in records.columns])
    return records.select(job, F.explode(pairs).alias("p")).select(job, "p.*").where("Value is not null and Value <> ''")


def page_index(pages: DataFrame, job: str, title: str, url: str, folder: str) -> DataFrame:
    """job, ordinal by URL, title, address and path of each page's file."""
    pages = ordinals.numbered(pages, [job], [url], "__n")
    return pages.select(job, F.col("__n").alias("ordinal"), F.col(title).alias("title"), F.col(url).alias("url"), F.concat(F.lit("./"), F.col(folder), F.lit("/content.md")).alias("path"))


def output_folders(pages: DataFrame, job: str, parts: list[str], url: str, tie: str | None = None) -> DataFrame:
    """pages with `folder`, the parts joined by slashes; later pages of one folder, by URL, get a suffix; those of one URL by tie."""
    placed = ordinals.numbered(pages.withColumn("__base", F.concat_ws("/", *parts)), [job, "__base"], [url, *([tie] if tie else [])], "__n")
    return placed.withColumn("folder", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("_", "__base", "__n"))).drop("__base", "__n")


def write_partitioned(df: DataFrame, path: str, keys: list[str], kind: str = "parquet") -> None:
    """Write by keys; each key's rows meet in few files without meeting in one task (AQE splits large ones)."""
    df.hint("rebalance", *keys).write.partitionBy(*keys).format(kind).mode("overwrite").save(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """db, relation, ord, option of taxonomy files {"relation": ["option", ...]}; a missing file is an error."""
    raw = spark.read.json(path, multiLine=True)
    relations = [f.name for f in raw.schema if f.dataType.typeName() == "array"]
    db = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1)
    pairs = F.array(*[F.struct(F.lit(r).alias("relation"), F.col(f"`{r}`").cast("array<string>").alias("options")) for r in relations])
    return raw.select(db.alias("db"), F.explode(pairs).alias("p")).select("db", "p.relation", F.posexplode("p.options").alias("ord", "option"))


def find_taxonomy(spark: SparkSession, root: str, db: str) -> tuple[str, str]:
    """(path, how) of a database's taxonomy file, one to three folders below root, in <folder>/_schema/_dbs/_taxonomies.json: in order
    of path the first whose folder is the database's (`own`) or beside which its manifest <db>.json stands (`manifest`), else the
    first of all (`other`). Case and - or _ make no difference in folders. No file at all is an error, so that a miss is never
    taken for a taxonomy without options. Any store of Hadoop's will do."""
    key, fs_of = db.strip().lower().replace("_", "-"), spark.sparkContext._jvm.org.apache.hadoop.fs
    base = fs_of.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(x.getPath().toString()) for depth in (3, 2, 1) for x in fs.globStatus(fs_of.Path(base, "*/" * depth + "_schema/_dbs/_taxonomies.json")))
    for path in found:
        if path.split("/")[-4].lower().replace("_", "-") == key:
            return path, "own"
        if fs.exists(fs_of.Path(fs_of.Path(path).getParent(), f"{key}.json")):
            return path, "manifest"
    if not found:
        raise FileNotFoundError(f"no taxonomy file below {root}")
    return found[0], "other"


def load_taxonomy(spark: SparkSession, root: str, db: str) -> DataFrame:
    """db, relation, ord, option and `how` the file was found (see find_taxonomy). Spark's readers skip names that begin with _, so the
    file, a list of names, is opened by the driver."""
    path, how = find_taxonomy(spark, root, db)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    one = spark.createDataFrame([(db, how, text)], "db string, how string, text string")
    relations = F.from_json("text", "map<string,array<string>>")
    return one.select("db", "how", F.explode(relations).alias("relation", "options")).select("db", "relation", F.posexplode("options").alias("ord", "option"), "how")


def seed(spark: SparkSession, table: DataFrame, rows: list[tuple], schema: str, keys: list[str]) -> DataFrame:
    """table with those rows whose keys it lacks."""
    fresh = spark.createDataFrame(rows, schema)
    return table.unionByName(fresh.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


# Columns of page and media sheets.
PAGE_COLUMNS = ("URL", "Title", "Description", "Keywords", "Sitemap Last Modified", "Scraped At")
MEDIA_COLUMNS = ("Filename", "Alt Text", "Original URL")


def _sheet(rows: DataFrame, columns: tuple[str, ...], path: str, keys: list[str]) -> None:
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns]
    writer = rows.select(*keys, *texts).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
    (writer.partitionBy(*keys) if keys else writer).csv(path)


def write_page_sheet(pages: DataFrame, path: str, keys: list[str] = ()) -> None:
    """CSV of pages, columns named by PAGE_COLUMNS, a folder per key."""
    _sheet(pages, PAGE_COLUMNS, path, list(keys))


def write_media_sheet(media: DataFrame, path: str, keys: list[str] = ()) -> None:
    """CSV of media, columns named by MEDIA_COLUMNS, a folder per key."""
    _sheet(media, MEDIA_COLUMNS, path, list(keys))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet as it was written, all columns as text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).na.fill("")


def write_texts(rows: DataFrame, text: str, path: str, keys: list[str], ending: str) -> None:
    """Markdown, plain text or HTML source: whole texts as records parted by a null character, a folder per key."""
    kept = rows.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("value"))
    kept.write.mode("overwrite").partitionBy(*keys).option("lineSep", "\0").text(f"{path}/{ending}")


def read_written_texts(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """What write_texts() wrote: the keys and `value`."""
    return spark.read.option("lineSep", "\0").text(f"{path}/{ending}")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A vector cache: one JSON object {"key": ..., "embedding": [...]} a line."""
    vectors.select(F.to_json(F.struct("key", "embedding")).alias("value")).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """key, embedding of a vector cache; lines that are no such object are left out."""
    return spark.read.schema("key string, embedding array<double>").option("mode", "DROPMALFORMED").json(path).where("key is not null and embedding is not null")
