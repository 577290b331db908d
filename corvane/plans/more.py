"""PDF rules, spans, event order, two-level summaries, adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import context, jobs, pdf, records
from corvane.plans.adapters import CHUNKS, chunks, table
from corvane.plans.registry import query
from corvane.storage import spread

EVENT_KIND = "CASE event_type WHEN 'signup' THEN 'references' WHEN 'purchase' THEN 'done' ELSE 'token' END"


@query("t4_text_quality")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents")).where("text IS NOT NULL")
    return rows.select("doc_id", F.round(pdf.text_quality(F.col("text")), 6).alias("quality"), F.md5(pdf.promoted(F.col("text")).cast("binary")).alias("promoted_md5"))


@query("t4_chosen_text", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'layout' ELSE 'plain' END AS chosen FROM pages")
def t4_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.concat(F.lit("A plain sentence of page "), F.col("page_id").cast("string"), F.lit(" that reads well"))
    plain = F.when(F.col("page_id") % 2 == 0, F.lit("\x01\x02 \x03 . . . - - - ~ ~ ~ ( ( ) ) * * *")).otherwise(good)
    rows = table(spark, sf_dir, "pages").select("page_id", pdf.chosen_text(plain, F.concat(F.lit("Layout: "), good)).alias("t"))
    return rows.select("page_id", F.when(F.col("t").startswith("Layout"), "layout").otherwise("plain").alias("chosen"))


@query("t23_title_for_offset", """WITH e AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, length(o_orderpriority) AS size, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus || o_orderkey END AS title_path FROM orders),
p AS (SELECT *, sum(size + 2) OVER (PARTITION BY doc_id ORDER BY seq) AS ends FROM e)
SELECT doc_id, 40 AS "offset", coalesce(max_by(title_path, seq) FILTER (ends <= 40 AND title_path <> ''), min_by(title_path, seq) FILTER (title_path <> ''), '') AS title_path FROM p GROUP BY doc_id""")
def t23(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    title = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat("o_orderstatus", F.col("o_orderkey").cast("string")))
    elements = orders.select(F.col("o_custkey").alias("doc_id"), seq.alias("seq"), F.length("o_orderpriority").alias("size"), title.alias("title_path"))
    return pdf.title_at(elements, elements.select("doc_id", F.lit(40).alias("offset")).distinct())


@query("st1_event_stream", f"SELECT event_id, user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE {EVENT_KIND} WHEN 'references' THEN 0 WHEN 'done' THEN 2 ELSE 1 END, ts, event_id) AS INTEGER) AS sequence FROM events")
def st1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "signup", "references").when(e == "purchase", "done").otherwise("token")
    return jobs.event_stream(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), "ts", kind.alias("kind"))).select("event_id", "run_id", "sequence")


@query("st4_span_lifecycle", "WITH s AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS up, 'running' AS status FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'pending' ELSE 'completed' END FROM supplier UNION ALL SELECT 'r' || r_regionkey, NULL, 'running' FROM region), b AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 1) SELECT id, CASE WHEN id = 'r1' THEN 'failed' WHEN status IN ('pending', 'running') AND (id IN (SELECT id FROM b) OR up IN (SELECT id FROM b)) THEN 'cancelled' ELSE status END AS status FROM s")
def st4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, supplier, region = (table(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    status = F.when(F.col("s_suppkey") % 2 == 0, "pending").otherwise("completed")
    spans = nation.select(tag("n", "n_nationkey").alias("id"), F.lit("running").alias("status")).union(supplier.select(tag("s", "s_suppkey"), status)).union(region.select(tag("r", "r_regionkey"), F.lit("running")))
    links = nation.select(tag("n", "n_nationkey").alias("id"), tag("r", "n_regionkey").alias("parent_id")).union(supplier.select(tag("s", "s_suppkey"), tag("n", "s_nationkey")))
    return jobs.closed_spans(spans, links, region.where("r_regionkey = 1").select(tag("r", "r_regionkey").alias("id")))


@query("a13_two_level_summary", f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT doc_id, seq, CAST(greatest(1, length(content) // 4) AS INTEGER) AS n, left(content, 20) AS head FROM chunks),
f AS (SELECT doc_id, seq, n AS used, 0 AS batch FROM c WHERE seq = 0 UNION ALL SELECT c.doc_id, c.seq, CASE WHEN f.used + c.n > 500 THEN c.n ELSE f.used + c.n END, CASE WHEN f.used + c.n > 500 THEN f.batch + 1 ELSE f.batch END FROM f JOIN c ON c.doc_id = f.doc_id AND c.seq = f.seq + 1),
b AS (SELECT f.doc_id, f.batch, string_agg(c.head, ' ' ORDER BY f.seq) AS part FROM f JOIN c ON c.doc_id = f.doc_id AND c.seq = f.seq GROUP BY ALL)
SELECT doc_id, count(*) AS batches, md5(string_agg(part, ' | ' ORDER BY batch)) AS summary_md5 FROM b GROUP BY doc_id""")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by budget, a summary a batch (here the heads of its chunks), and a summary of summaries a document."""
    c = chunks(spark, sf_dir).select("doc_id", "seq", "content", F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("int").alias("token_count"))
    joined = context.batches(c, 500, key="doc_id").join(c.select("doc_id", "seq", F.left("content", F.lit(20)).alias("head")), ["doc_id", "seq"])
    text = lambda key, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), sep)
    parts = joined.groupBy("doc_id", "batch").agg(text("seq", "head", " ").alias("part"))
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("batches"), F.md5(text("batch", "part", " | ").cast("binary")).alias("summary_md5"))


@query("m3_register_batch_documents", "SELECT o_orderkey AS id, 'stored' AS state FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'registered' FROM orders WHERE o_orderstatus = 'O'")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    base = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("stored").alias("state"))
    return records.insert_missing(base, orders.where("o_orderstatus IN ('F', 'O')").select(F.col("o_orderkey").alias("id"), F.lit("registered").alias("state")), ["id"])


@query("m6_operation_retry", "SELECT l_orderkey, l_linenumber, l_returnflag NOT IN ('R', 'A') AS may_retry FROM lineitem")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "processing").when(F.col("l_returnflag") == "A", "completed").otherwise("failed")
    return jobs.retried(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))).select("l_orderkey", "l_linenumber", "may_retry")


@query("m10_hit_adapter", f"WITH {CHUNKS} SELECT chunk_id, doc_id, base_id || ':' || chunk_id AS identity, round(1 - seq * 0.01, 6) AS distance FROM chunks")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", "doc_id", F.concat_ws(":", "base_id", "chunk_id").alias("identity"), F.round(1 - F.col("seq") * 0.01, 6).alias("distance"))


@query("st10_feedback_documents", "SELECT 'feedback-' || l.doc_id AS id, d.source AS base_id, CASE WHEN quality = 1 THEN 'helpful' ELSE 'unhelpful' END AS verdict FROM labels l JOIN documents d USING (doc_id)")
def st10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.select(F.concat(F.lit("feedback-"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("base_id"), F.when(F.col("quality") == 1, "helpful").otherwise("unhelpful").alias("verdict"))
