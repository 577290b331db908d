"""The engine's tables made of the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import chunking
from corvane.operators.keyword_index import KeywordIndex
from corvane.storage import Versioned, shared_path, spread

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, workspace_id, knowledge_base_id, name, storage_path, file_type, parse_status, n_chars, text."""
    status = F.when(F.col("n_chars") < 100, "failed").when(F.col("n_chars") % 7 == 0, "processing").otherwise("parsed")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.lit("w0").alias("workspace_id"),
        F.coalesce("source", F.lit("default")).alias("knowledge_base_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.concat(F.coalesce("source", F.lit("default")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("storage_path"),
        F.lit("txt").alias("file_type"),
        status.alias("parse_status"),
        F.col("n_chars"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


DOCUMENTS = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'w0' AS workspace_id, coalesce(source, 'default') AS knowledge_base_id,
  'doc-' || doc_id || '.txt' AS name, coalesce(source, 'default') || '/' || doc_id || '.txt' AS storage_path, 'txt' AS file_type,
  CASE WHEN n_chars < 100 THEN 'failed' WHEN n_chars % 7 = 0 THEN 'processing' ELSE 'parsed' END AS parse_status, n_chars,
  coalesce(text, '') AS text FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base_id, seq, chunk_id, content: fixed windows of every document."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("source", F.lit("default")).alias("base_id"), "text"))
    return chunking.fixed_chunks(docs, id_col="doc_id").select("doc_id", "base_id", "seq", "chunk_id", "content")


_kept: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, names: tuple[str, ...], what: str, build: Callable[[], T]) -> T:
    """What build makes of the named tables, made once an application while their files stay as they are."""
    key: tuple = (spark.sparkContext.applicationId, sf_dir, what)
    for name in names:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
        key += tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[KeywordIndex, tuple[str, str]]:
    """An index that is empty yet, and the folder of its chunks: those of all documents."""

    def build() -> tuple[KeywordIndex, tuple[str, str]]:
        index = KeywordIndex(Versioned(spark, shared_path(spark, "kept")))
        rows = chunks(spark, sf_dir).select(F.lit("w0").alias("workspace_id"), F.col("base_id").alias("knowledge_base_id"), "doc_id", "seq", "chunk_id", "content")
        return index, index.numbered(rows)

    return once(spark, sf_dir, ("documents",), "chunks", build)


def kept_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """Chunks of all documents and their keyword index."""

    def build() -> KeywordIndex:
        index, folder = _numbered(spark, sf_dir)
        index.store.commit(index.segment(folder))
        return index

    return once(spark, sf_dir, ("documents",), "index", build)


def kept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `chunks` gives, read from the kept store; it needs no index."""
    index, folder = _numbered(spark, sf_dir)
    return index.store.part(folder).select("doc_id", F.col("knowledge_base_id").alias("base_id"), "seq", "chunk_id", "content")


CHUNKS = r"""flat AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, 'default') AS base_id,
  trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS t FROM documents),
chunks AS (SELECT doc_id, base_id, CAST(i AS INTEGER) AS seq, doc_id || '::parent-0::child-' || i AS chunk_id, substring(t, i * 308 + 1, 384) AS content
  FROM (SELECT *, unnest(range(0, CAST(ceil(length(t) / 308.0) AS BIGINT))) AS i FROM flat WHERE length(t) > 0))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


QUESTIONS = "questions AS (SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark)"


def tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2)"
