"""Listings, counts, roll-ups, joins, windows and state changes over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import context, jobs, memory, records
from corvane.plans.adapters import CHUNKS, DOCUMENTS, chunks, documents, table
from corvane.plans.registry import query
from corvane.schemas import Scope
from corvane.streaming import windows
from corvane.storage import shared_path


@query("f1_scope_filter", f"WITH {DOCUMENTS} SELECT id, knowledge_base_id FROM docs WHERE workspace_id = 'w0' AND knowledge_base_id IN ('src1', 'src2', 'src7')")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = Scope("w0", ("src1", "src2", "src7", "src1"))
    return documents(spark, sf_dir).where(scope.predicate(document="id")).select("id", "knowledge_base_id")


@query("f2_scope_resolution", "SELECT source AS base, count(*) AS documents FROM documents WHERE source IN ('src3', 'src4') GROUP BY source")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.schemas import resolve_scope

    bases = documents(spark, sf_dir).select(F.col("knowledge_base_id").alias("id"), "workspace_id").distinct().withColumn("status", F.lit("active"))
    scope = resolve_scope(["src3", "src4", "src3"], bases, "src0")
    return documents(spark, sf_dir).where(scope.predicate(document="id")).groupBy(F.col("knowledge_base_id").alias("base")).agg(F.count(F.lit(1)).alias("documents"))


@query("f3_list_chunks", f"WITH {CHUNKS} SELECT chunk_id, doc_id, seq FROM chunks WHERE base_id IN ('src1', 'src2') ORDER BY doc_id, seq")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).where(F.col("base_id").isin("src1", "src2"))
    return rows.orderBy("doc_id", "seq").select("chunk_id", "doc_id", "seq")


@query("f4_point_lookup", f"WITH {DOCUMENTS} SELECT d.id, d.name, d.parse_status FROM docs d JOIN (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels) l USING (id)")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id")).distinct()
    return documents(spark, sf_dir).select("id", "name", "parse_status").join(ids, "id", "left_semi")


@query("f5_document_filter", f"WITH {DOCUMENTS} SELECT id, name FROM docs WHERE contains(lower(concat_ws(' ', name, storage_path, knowledge_base_id)), 'src1') AND file_type = 'txt' AND parse_status IN ('parsed', 'failed') AND n_chars BETWEEN 100 AND 5000")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("updated_at", F.lpad(F.col("n_chars").cast("string"), 12, "0"))
    return records.filter_documents(docs, "SRC1", "txt", ("parsed", "failed"), updated_from=f"{100:012d}", updated_to=f"{5000:012d}").select("id", "name")


@query("f7_indexable_types", f"WITH {CHUNKS} SELECT base_id, count(*) AS n FROM chunks WHERE (CASE WHEN seq % 2 = 0 THEN 'child' ELSE 'parent' END) IN ('child', 'table', 'ocr', 'image_ocr', 'image_caption') GROUP BY base_id")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.schemas import INDEXABLE_TYPES

    rows = chunks(spark, sf_dir).withColumn("chunk_type", F.when(F.col("seq") % 2 == 0, "child").otherwise("parent"))
    return rows.where(F.col("chunk_type").isin(*INDEXABLE_TYPES)).groupBy("base_id").agg(F.count(F.lit(1)).alias("n"))


@query("f8_redaction", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(authorization|password|passwd|token|api[_-]?key|secret|client[_-]?secret)([''"\s:=]+)([^,''"\s&}]+)', '\1\2***', 'g'), '(?i)bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer ***', 'g')) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(X.redact(F.col("text")).cast("binary")).alias("text_md5"))


@query("f9_safe_paths", r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS u FROM pages), q AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN u WHEN page_id % 3 = 1 THEN ltrim(u, '/') ELSE 'a/../' || ltrim(u, '/') END AS path FROM p)
SELECT page_id, CASE WHEN trim(path) = '' OR regexp_matches(path, '^[\\/]') OR regexp_matches(path, '(^|/)\.\.?(/|$)') THEN NULL ELSE array_to_string([regexp_replace(s, '[^\p{L}\p{N}._-]+', '_', 'g') FOR s IN string_split_regex(trim(path), '[\\/]+') IF s <> ''], '/') END AS clean FROM q""")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.regexp_replace("url", "^https?://[^/]*", "")
    path = F.when(F.col("page_id") % 3 == 0, u).when(F.col("page_id") % 3 == 1, F.ltrim(u, F.lit("/"))).otherwise(F.concat(F.lit("a/../"), F.ltrim(u, F.lit("/"))))
    return table(spark, sf_dir, "pages").select("page_id", records.safe_path(path).alias("clean"))


@query("f9_unique_names", "SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || '-' || (n - 1) END AS unique_name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)")
def f9_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.unique_names(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_partkey").select("p_partkey", "unique_name")


@query("j1_hits_join_chunks", f"WITH {CHUNKS}, h AS (SELECT chunk_id FROM chunks WHERE contains(content, 'pathetic')) SELECT c.chunk_id, c.base_id, c.seq FROM h JOIN chunks c USING (chunk_id)")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.where(F.col("content").contains("pathetic")).select("chunk_id").join(c.select("chunk_id", "base_id", "seq"), "chunk_id")


@query("j2_document_chunk_counts", f"WITH {CHUNKS}, {DOCUMENTS} SELECT docs.id, count(chunks.chunk_id) AS chunks FROM docs LEFT JOIN chunks ON chunks.doc_id = docs.id GROUP BY docs.id")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = chunks(spark, sf_dir).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return records.zero_filled(counts, documents(spark, sf_dir), "id").select("id", F.col("n").alias("chunks"))


@query("j3_base_rollup", "SELECT c_custkey AS base_id, count(DISTINCT o_orderkey) AS documents, count(l_orderkey) AS indexed_chunks, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS processing, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS failed FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "failed").otherwise("parsed")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("base_id"), status.alias("status"))
    return records.base_rollup(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("base_id")), docs, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


@query("j6_citations", f"WITH {CHUNKS}, cited AS (SELECT item_id AS case_id, item_id % 1000 || '::parent-0::child-' || item_id % 12 AS chunk_id FROM benchmark) SELECT case_id, cited.chunk_id, c.chunk_id IS NOT NULL AS verified FROM cited LEFT JOIN chunks c ON c.chunk_id = cited.chunk_id")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    cited = table(spark, sf_dir, "benchmark").select(i.alias("case_id"), F.concat((i % 1000).cast("string"), F.lit("::parent-0::child-"), (i % 12).cast("string")).alias("chunk_id"))
    good, bad = context.verify_citations(cited, chunks(spark, sf_dir))
    return good.select("case_id", "chunk_id", F.lit(True).alias("verified")).union(bad.select("case_id", "chunk_id", F.lit(False)))


@query("j7_orphans", "SELECT p_partkey AS image_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag IN ('R', 'A'))")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "processing").when(F.col("l_returnflag") == "A", "completed").otherwise("failed")
    return records.orphans(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image_id"), status.alias("status")))


@query("j10_neighbour_chunks", f"WITH {CHUNKS} SELECT chunk_id, lag(chunk_id) OVER w AS previous, lead(chunk_id) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("seq")
    return chunks(spark, sf_dir).select("chunk_id", F.lag("chunk_id").over(w).alias("previous"), F.lead("chunk_id").over(w).alias("next"))


@query("j11_range_overlap", "WITH s AS (SELECT l_orderkey AS k, l_linenumber AS i, CAST(l_partkey % 40 AS INTEGER) AS a, CAST(l_partkey % 40 + l_quantity AS INTEGER) AS b FROM lineitem) SELECT x.k, x.i, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.i < y.i AND x.a <= y.b AND y.a <= x.b GROUP BY ALL")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("l_partkey") % 40).cast("int")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), a.alias("a"), (F.col("l_partkey") % 40 + F.col("l_quantity")).cast("int").alias("b"))
    x, y = s.alias("x"), s.alias("y")
    return x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.i") < F.col("y.i")) & (F.col("x.a") <= F.col("y.b")) & (F.col("y.a") <= F.col("x.b"))).groupBy(F.col("x.k").alias("k"), F.col("x.i").alias("i")).agg(F.count(F.lit(1)).alias("n"))


@query("j13_task_document_join", "WITH t AS (SELECT c_custkey AS doc_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS task_id, count(*) AS attempts FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), d AS (SELECT o_custkey AS doc_id, count(*) AS dead FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT c_custkey AS doc_id, task_id, coalesce(dead, 0) > 0 AS dead_letter, attempts FROM customer LEFT JOIN t ON t.doc_id = c_custkey LEFT JOIN d ON d.doc_id = c_custkey")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("task_id"), F.bool_or(F.col("o_orderstatus") == "F").alias("dead"), F.count(F.lit(1)).alias("attempts"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")).join(orders, "doc_id", "left").select("doc_id", "task_id", F.coalesce("dead", F.lit(False)).alias("dead_letter"), "attempts")


@query("j16_merge_sources", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return records.insert_missing(base, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id"])


@query("a1_zero_filled_counts", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return records.zero_filled(counts, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("a2_conditional_counts", f"WITH {DOCUMENTS} SELECT knowledge_base_id, count(*) AS documents, CAST(count_if(parse_status = 'processing') AS BIGINT) AS processing, CAST(count_if(parse_status = 'failed') AS BIGINT) AS failed, count(DISTINCT CASE WHEN parse_status = 'parsed' THEN id END) AS parsed FROM docs GROUP BY ALL")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("parse_status")
    return documents(spark, sf_dir).groupBy("knowledge_base_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(s == "processing").alias("processing"), F.count_if(s == "failed").alias("failed"), F.count_distinct(F.when(s == "parsed", F.col("id"))).alias("parsed"))


FILES = "f AS (SELECT o_custkey AS batch_id, o_orderkey AS file_id, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed' END WHEN 'O' THEN 'completed' ELSE 'canceled' END AS status FROM orders)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when((s == "F") & (k % 3 == 0), "failed").when(s.isin("F", "O"), "completed").otherwise("canceled")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), k.alias("file_id"), status.alias("status"))


@query("a3_batch_status_counts", f"WITH {FILES} SELECT batch_id, CAST(count_if(status = 'completed') AS BIGINT) AS completed, CAST(count_if(status = 'failed') AS BIGINT) AS failed, CAST(count_if(status = 'canceled') AS BIGINT) AS canceled, count(*) AS total FROM f GROUP BY batch_id")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.status_counts(_files(spark, sf_dir), "batch_id", ("completed", "failed", "canceled"))


@query("a4_batch_terminal_status", f"WITH {FILES} SELECT batch_id, CASE WHEN bool_or(status = 'failed') AND bool_or(status = 'completed') THEN 'partial_failed' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'canceled') THEN 'canceled' ELSE 'completed' END AS batch_status FROM f GROUP BY batch_id")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.batch_status(_files(spark, sf_dir), "batch_id")


@query("a6_describe", "SELECT 'l_quantity' AS field, count(l_quantity) AS n, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), min(l_tax), max(l_tax), round(avg(l_tax), 6) FROM lineitem UNION ALL SELECT 'l_linenumber', count(*), min(l_linenumber), max(l_linenumber), round(avg(l_linenumber), 6) FROM lineitem")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax", "l_linenumber"]).withColumn("mean", F.round("mean", 6))


@query("a11_next_number", "SELECT l_orderkey, coalesce(max(l_linenumber), 0) + 1 AS next FROM lineitem GROUP BY l_orderkey")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.next_number(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("a12_tool_counts", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS tools, CAST(sum(n) AS BIGINT) AS calls FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), F.col("n").cast("string")))), ",").alias("tools"), F.sum("n").alias("calls"))


@query("a14_operation_summary", f"WITH {DOCUMENTS} SELECT knowledge_base_id, CAST(count_if(parse_status = 'failed') AS BIGINT) AS failed, CAST(count_if(parse_status = 'parsed') AS BIGINT) AS parsed, CAST(count_if(parse_status = 'processing') AS BIGINT) AS processing FROM docs GROUP BY ALL")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("knowledge_base_id").pivot("parse_status", ["failed", "parsed", "processing"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a15_run_summary", "SELECT user_id AS run_id, count(DISTINCT event_type) AS tools, count(*) AS steps, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM events GROUP BY user_id")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count_distinct("event_type").alias("tools"), F.count(F.lit(1)).alias("steps"), (F.max(us) / 1e6 - F.min(us) / 1e6).alias("seconds"))


@query("a16_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("w2_latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("w3_last_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.last_n(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("w5_batch_boundaries", f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT doc_id, seq, CAST(greatest(1, length(content) // 4) AS INTEGER) AS n FROM chunks),
f AS (SELECT doc_id, seq, n AS used, 0 AS batch FROM c WHERE seq = 0 UNION ALL SELECT c.doc_id, c.seq, CASE WHEN f.used + c.n > 500 THEN c.n ELSE f.used + c.n END, CASE WHEN f.used + c.n > 500 THEN f.batch + 1 ELSE f.batch END FROM f JOIN c ON c.doc_id = f.doc_id AND c.seq = f.seq + 1)
SELECT doc_id, seq, batch FROM f""")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("doc_id", "seq", X.estimate_tokens(F.col("content")).alias("token_count"))
    return context.batches(rows, 500, key="doc_id")


@query("w8_batch_offsets", "SELECT l_orderkey AS batch_id, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate + INTERVAL 1 DAY * l_linenumber) AS finish_rank, epoch(l_shipdate) - epoch(min(l_shipdate) OVER (PARTITION BY l_orderkey)) AS offset_s FROM lineitem")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.col("l_shipdate").cast("timestamp")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), "l_linenumber", ship.alias("started_at"), (ship + F.make_dt_interval(F.col("l_linenumber"))).alias("finished_at"))
    return jobs.offsets(spans).select("batch_id", "l_linenumber", F.col("finish_rank").cast("long").alias("finish_rank"), "offset_s")


@query("w9_rolling_summary", "WITH n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, md5(right(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn), 4000)) AS summary_md5, count(*) AS messages FROM n WHERE n >= 4 AND back > 2 GROUP BY conv_id")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory.summaries(table(spark, sf_dir, "conversations"), keep=2, least=4)
    return rows.select("conv_id", F.md5(F.col("summary").cast("binary")).alias("summary_md5"), "messages")


@query("k10_claim_next", "WITH t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status, o_orderdate AS d FROM orders), m AS (SELECT max(d) - INTERVAL 100 DAY AS now FROM t) SELECT id FROM t, m WHERE (status = 'pending' AND d <= now) OR (status = 'processing' AND d + INTERVAL 30 DAY < now) ORDER BY d, id LIMIT 25")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed")
    d = F.col("o_orderdate")
    tasks = orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), d.alias("next_run_at"), d.alias("created_at"), (d + F.expr("INTERVAL 30 DAY")).alias("lease_until"))
    now = F.lit(orders.agg(F.max(d - F.expr("INTERVAL 100 DAY"))).first()[0])
    return records.claimable(tasks, now, 25).select("id")


@query("k11_memory_recall", r"WITH m AS (SELECT conv_id * 100 + turn AS id, text, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\x{4e00}-\x{9fff}]{2,}|[A-Za-z0-9_]{2,}')) AS ts FROM conversations WHERE role = 'user') SELECT id, len(list_intersect(ts, ['the', 'thing', 'and', 'of'])) AS shared FROM m ORDER BY shared DESC, turn DESC, id LIMIT 8")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.lit("active").alias("status"), F.lit(0.9).alias("confidence"), F.col("turn").alias("updated_at"))
    return memory.recall(rows, "the thing and of the").select("id", F.col("shared").cast("long").alias("shared"))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    stage = F.when(p == "1-URGENT", 1).when(p == "2-HIGH", 2).when(p == "3-MEDIUM", 3).otherwise(4)
    return table(spark, sf_dir, "orders").select("o_orderkey", stage.alias("stage")).orderBy("stage", "o_orderkey")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").orderBy(F.desc("s_acctbal"), "s_suppkey").select("s_suppkey", "s_name")


@query("k12_canonical_order", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS stage FROM orders ORDER BY stage, o_orderkey")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir)


@query("k13_ordered_listing", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir)


@query("k12_canonical_order_all", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS stage FROM orders ORDER BY stage, o_orderkey")
def k12_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as k12, which once was cut."""
    return _staged(spark, sf_dir)


@query("k13_ordered_listing_all", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey")
def k13_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as k13, which once was cut."""
    return _listed(spark, sf_dir)


@query("d5_evidence_fusion", "WITH b AS (SELECT l_partkey AS item, 0 AS tool, l_quantity / 50 AS confidence FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 1, l_discount * 10 FROM lineitem WHERE l_returnflag = 'A') SELECT item, min(tool) AS tool, round(max(confidence), 9) AS confidence FROM b GROUP BY item")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    part = lambda flag, tool, conf: items.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("item"), F.lit(tool).alias("tool"), conf.alias("confidence"))
    both = part("R", 0, F.col("l_quantity") / 50).unionByName(part("A", 1, F.col("l_discount") * 10))
    return both.groupBy("item").agg(F.min("tool").alias("tool"), F.round(F.max("confidence"), 9).alias("confidence"))


@query("d10_unread_chunks", f"WITH {CHUNKS}, r AS (SELECT chunk_id FROM chunks WHERE seq = 0) SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM r)")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.select("chunk_id").dropDuplicates().join(c.where("seq = 0").select("chunk_id"), "chunk_id", "left_anti")


@query("d11_set_operations", "SELECT * FROM ((SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select("s_nationkey")
    return a.intersect(b).subtract(table(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_nationkey"))


TASKS = """ev AS (SELECT user_id AS task_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'error' THEN 'error' ELSE 'complete' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT task_id, k, CASE action WHEN 'create' THEN 'pending' WHEN 'complete' THEN 'completed' ELSE 'none' END AS status, 0 AS attempts FROM ev WHERE k = 1
UNION ALL SELECT ev.task_id, ev.k, CASE WHEN f.status IN ('completed', 'dead') THEN f.status WHEN action = 'complete' THEN 'completed' WHEN action = 'create' AND f.status = 'none' THEN 'pending' WHEN action = 'claim' AND f.status = 'pending' THEN 'processing'
  WHEN action = 'error' AND f.status = 'processing' THEN CASE WHEN f.attempts >= 3 THEN 'dead' ELSE 'pending' END ELSE f.status END, f.attempts + CASE WHEN action = 'claim' AND f.status = 'pending' THEN 1 ELSE 0 END FROM f JOIN ev ON ev.task_id = f.task_id AND ev.k = f.k + 1)"""


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    action = F.when(e == "signup", "create").when(e == "view", "claim").when(e == "click", "heartbeat").when(e == "error", "error").otherwise("complete")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", action.alias("action"))


@query("st3_task_transitions", f"WITH RECURSIVE {TASKS} SELECT task_id, arg_max(status, k) AS status, CAST(arg_max(attempts, k) AS INTEGER) AS attempts FROM f GROUP BY task_id")
def st3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.fold_tasks(task_events(spark, sf_dir)).select("task_id", "status", "attempts")


@query("st2_streamed_tasks", f"WITH RECURSIVE {TASKS} SELECT task_id, arg_max(status, k) AS status, CAST(arg_max(attempts, k) AS INTEGER) AS attempts FROM f GROUP BY task_id")
def st2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states, kept by a stream over the same events."""
    from corvane.streaming import tasks

    rows = task_events(spark, sf_dir)
    source, out = shared_path(spark, "task-events"), shared_path(spark, "task-states")
    rows.write.parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    stream = tasks.states(spark.readStream.schema(rows.schema).parquet(source))
    stream.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "task-checkpoint")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(tasks.OUT + ", batch int").parquet(out)
    return records.latest(states, ["task_id"], ["batch"]).select("task_id", "status", "attempts")


@query("st6_repeated_batches", "WITH n AS (SELECT user_id, ts, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM n) SELECT user_id AS run_id, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY user_id")
def st6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("sequence"), F.col("event_type").alias("signature"))
    return jobs.repeated_batches(rows)


@query("st7_action_batches", "WITH n AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'click') AND lag(event_type) OVER w IN ('view', 'click') THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS batch FROM n")
def st7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").isin("view", "click").alias("parallel"))
    return jobs.action_groups(rows).select("event_id", "batch")


@query("st9_paired_calls", "WITH n AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) SELECT c.user_id AS run_id, c.nth, r.nth IS NOT NULL AS closed FROM n c LEFT JOIN n r ON r.user_id = c.user_id AND r.nth = c.nth AND r.event_type = 'purchase' WHERE c.event_type = 'click'")
def st9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "purchase", "result")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.lit("k").alias("call_key"), kind.alias("kind"), "ts", "event_id").where("kind IS NOT NULL")
    return jobs.paired_calls(rows).select("run_id", F.col("nth").cast("long").alias("nth"), F.col("ended").isNotNull().alias("closed"))


@query("st5_run_state_merge", "SELECT user_id AS run_id, count(*) AS calls, bool_or(event_type = 'error') AS blocked, count(DISTINCT event_type) AS ids FROM events GROUP BY user_id")
def st5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.lit(1).alias("calls"), (F.col("event_type") == "error").alias("blocked"), F.struct("ts", "event_id").alias("sequence"), F.array("event_type").alias("ids"))
    return jobs.merged_runs(rows).select("run_id", "calls", "blocked", F.size("ids").cast("long").alias("ids"))


@query("st11_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("total", F.round("total", 4))


@query("st11_streamed_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st11_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source = shared_path(spark, "window-events")
    rows.write.parquet(source)
    return windows.drained(windows.tumbling(spark.readStream.schema(rows.schema).parquet(source)), "windows").withColumn("total", F.round("total", 4))


@query("st11_sessions", "WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM n) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, session")
def st11_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("m1_unique_base_names", "SELECT c_custkey AS id, lower(c_mktsegment) AS name, count(*) OVER (PARTITION BY c_nationkey, lower(c_mktsegment)) > 1 AS taken FROM customer")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("c_nationkey", F.lower("c_mktsegment")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("name"), (n > 1).alias("taken"))


@query("m2_cancel_batch_files", f"WITH {FILES} SELECT file_id, CASE WHEN batch_id % 2 = 0 AND status IN ('pending', 'completed') THEN 'canceled' ELSE status END AS status FROM f")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cancel = (F.col("batch_id") % 2 == 0) & F.col("status").isin("pending", "completed")
    return _files(spark, sf_dir).select("file_id", F.when(cancel, "canceled").otherwise(F.col("status")).alias("status"))


@query("m4_phase_report", "SELECT o_orderkey AS file_id, CASE o_orderstatus WHEN 'F' THEN 'completed,failed,pending,pending,pending,pending' ELSE 'completed,completed,pending,pending,pending,pending' END AS phases, o_orderstatus = 'F' AS can_retry FROM orders")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, status, retry: F.struct(F.lit(name).alias("name"), status.alias("status"), retry.alias("retryable"))
    failed = F.col("o_orderstatus") == "F"
    phases = records.phase_report(F.array(one("parse", F.when(failed, "failed").otherwise("completed"), failed), one("upload", F.lit("completed"), F.lit(False))))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), phases.alias("p"))
    return rows.select("file_id", F.array_join(F.transform("p", lambda x: x["status"]), ",").alias("phases"), F.exists("p", lambda x: x["can_retry"]).alias("can_retry"))


@query("m5_partial_update", "SELECT o_orderkey AS id, coalesce(CASE WHEN l.k IS NOT NULL AND l.k % 2 = 0 THEN 'done' END, o_orderstatus) AS status, coalesce(l.v, o_totalprice) AS value FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_tax) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) l ON l.k = o_orderkey")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"))
    new = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_tax").alias("value")).withColumn("status", F.when(F.col("id") % 2 == 0, "done"))
    return records.upsert(base, new, ["id"], keep=(), partial=True)


@query("m9_metadata_defaults", f"WITH {CHUNKS} SELECT chunk_id, 'chars' AS unit, CASE WHEN seq % 2 = 0 THEN 'own' ELSE 'legacy' END AS strategy FROM chunks")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("strategy"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    full = records.with_defaults(own, {"unit": "chars", "strategy": "legacy"})
    return chunks(spark, sf_dir).select("chunk_id", full["unit"].alias("unit"), full["strategy"].alias("strategy"))


@query("m15_memory_upsert", "WITH m AS (SELECT role AS scope, 'k' || conv_id % 50 AS key, conv_id * 100 + turn AS id, turn AS updated_at FROM conversations) SELECT scope, key, arg_max(id, (updated_at, id)) AS id, min(updated_at) AS created_at FROM m GROUP BY ALL")
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("scope"), F.concat(F.lit("k"), (F.col("conv_id") % 50).cast("string")).alias("key"), F.lit("active").alias("status"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("turn").alias("updated_at"), F.col("turn").alias("created_at"))
    return memory.upsert(rows.where("id % 2 = 0"), rows.where("id % 2 <> 0")).select("scope", "key", "id", "created_at")


@query("m16_messages", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def m16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("m17_visible_audits", "SELECT o_custkey AS audit_id FROM orders GROUP BY o_custkey HAVING bool_and(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'))")
def m17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("audit_id")).agg(F.collect_set("o_orderpriority").alias("base_ids"))
    return records.visible_audits(rows, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")).select("audit_id")


@query("x13_memory_extraction", "SELECT conv_id, turn, CASE WHEN contains(text, '忘记') OR contains(text, '不要记住') OR contains(text, 'forget') THEN 'forget' WHEN contains(text, '记住') OR contains(text, 'remember') THEN 'remember' END AS kind, contains(lower(text), 'api_key') OR contains(lower(text), 'apikey') OR contains(lower(text), 'password') OR contains(lower(text), 'token') OR contains(lower(text), 'secret') OR contains(lower(text), 'sk-') AS sensitive FROM conversations WHERE text IS NOT NULL")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    kind = F.when(X.memory_kind(t) != "preference", X.memory_kind(t))
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", kind.alias("kind"), X.sensitive(t).alias("sensitive"))
