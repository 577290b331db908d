"""The ingest loop over documents and pages that are dealt out as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.adapters import once, table, tokens_sql
from corvane.plans.registry import query
from corvane.storage import Versioned, shared_path
from corvane.streaming.ingest import Library


def drops(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two drops of files. Every document and page is a file of the first or the second; every tenth document comes in both, first cut in half."""
    docs = table(spark, sf_dir, "documents")
    ext = F.when(F.col("doc_id") % 40 == 7, "png").when(F.col("doc_id") % 40 == 11, "json").when(F.col("doc_id") % 40 == 13, "xyz").otherwise("txt")
    path = F.concat(F.lit("drop/"), F.coalesce("source", F.lit("default")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    own = docs.select((F.col("doc_id") % 2).alias("drop"), path.alias("path"), F.coalesce("text", F.lit("")).alias("said"))
    half = docs.where("doc_id % 10 = 5").select(F.lit(0).cast("bigint").alias("drop"), path.alias("path"), F.expr("left(coalesce(text, ''), length(coalesce(text, '')) div 2)").alias("said"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 2).alias("drop"), F.concat(F.lit("drop/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("said"))
    rows = own.unionByName(half).unionByName(pages)
    raw = F.encode("said", "utf-8")
    rows = rows.select("drop", "path", F.timestamp_seconds("drop").alias("modificationTime"), F.length(raw).cast("bigint").alias("length"), raw.alias("content"))
    return [rows.where(F.col("drop") == d).drop("drop") for d in (0, 1)]


def kept_library(spark: SparkSession, sf_dir: str) -> Library:
    """Both drops, ingested by the stream as they arrive; the second batch is then delivered once more, as after a killed driver."""

    def build() -> Library:
        source, library = shared_path(spark, "drops"), Library(Versioned(spark, shared_path(spark, "library")))
        checkpoint = shared_path(spark, "arrivals")
        for drop in drops(spark, sf_dir):
            drop.write.mode("append").parquet(source)
            library.ingest(source, checkpoint, form="parquet", files_a_batch=1 << 20)
        before = library.store.version
        for name in list(library.store.state["done"]):
            library.publish(drops(spark, sf_dir)[1], name)
        if library.store.version != before:
            raise RuntimeError("a repeated batch was published again")
        return library

    return once(spark, sf_dir, ("documents", "pages"), "library", build)


FILES = r"""f AS (SELECT doc_id, coalesce(source, 'default') AS base, CASE doc_id % 40 WHEN 7 THEN 'png' WHEN 11 THEN 'json' WHEN 13 THEN 'xyz' ELSE 'txt' END AS ext, coalesce(text, '') AS said FROM documents),
r AS (SELECT *, 'drop/' || base || '/' || doc_id || '.' || ext AS path, CASE WHEN ext = 'xyz' THEN 'unsupported type' WHEN ext = 'png' THEN 'no parser for png' WHEN ext = 'json' THEN 'JSONDecodeError' WHEN flat = '' THEN 'empty document' END AS reason
  FROM (SELECT *, trim(regexp_replace(said, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS flat FROM f))"""


@query("sc23_ingested", f"""WITH {FILES} SELECT path AS storage_path, base AS knowledge_base_id, ext AS file_type, CASE WHEN reason IS NULL THEN 'indexed' ELSE 'quarantined' END AS status, reason,
  CASE WHEN reason IS NULL THEN CAST(ceil(length(flat) / 308.0) AS BIGINT) ELSE 0 END AS n_chunks, 1 + doc_id % 2 AS version FROM r
UNION ALL SELECT 'drop/pages/' || page_id || '.html', 'pages', 'html', 'indexed', NULL, -1, 1 + page_id % 2 FROM pages""")
def sc23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's last state. How many chunks a page has depends on its visible text and is told as -1."""
    library = kept_library(spark, sf_dir)
    good = library.documents().select("storage_path", "knowledge_base_id", "file_type", F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("reason"), F.when(F.col("file_type") == "html", -1).otherwise(F.col("n_chunks")).cast("bigint").alias("n_chunks"), F.col("version").cast("bigint").alias("version"))
    reason = F.element_at(F.split("reason", ":"), 1)
    bad = library.quarantine().select("storage_path", "knowledge_base_id", F.element_at(F.split("storage_path", r"\."), -1).alias("file_type"), F.lit("quarantined").alias("status"), reason.alias("reason"), F.lit(0).cast("bigint").alias("n_chunks"), F.col("version").cast("bigint").alias("version"))
    return good.unionByName(bad)


@query("sc23_postings", f"""WITH {FILES}, c AS (SELECT path, substring(flat, i * 308 + 1, 384) AS content, i FROM (SELECT *, unnest(range(0, CAST(ceil(length(flat) / 308.0) AS BIGINT))) AS i FROM r WHERE reason IS NULL AND flat <> '')),
t AS (SELECT path, i, term, count(*) AS tf FROM (SELECT path, i, unnest({tokens_sql('content')}) AS term FROM c) GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM t GROUP BY term""")
def sc23_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published postings of documents (those of pages left out), after replacement and replay."""
    return kept_library(spark, sf_dir).index.totals(F.col("knowledge_base_id") != "pages")
