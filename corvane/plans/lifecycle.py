"""Knowledge-base requests, worker outcomes and query understanding over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import lifecycle
from corvane.plans.adapters import QUESTIONS, questions, table
from corvane.plans.registry import query


@query("m1_create_bases", """WITH r AS (SELECT c_custkey AS id, c_nationkey AS ws, CASE WHEN c_custkey % 13 = 0 THEN '  ' WHEN c_custkey % 2 = 0 THEN ' BASE ' || c_custkey % 7 ELSE 'base ' || c_custkey % 7 END AS name,
  CASE WHEN c_custkey % 17 = 0 THEN 'faq' ELSE 'document' END AS type, -c_custkey AS ord FROM customer),
e AS (SELECT r.*, lower(trim(name)) AS key, CASE WHEN ws % 5 = 0 THEN 'workspace missing or archived' WHEN trim(name) = '' THEN 'empty name' WHEN type <> 'document' THEN 'unsupported type'
  WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = ws AND 'base ' || s_suppkey % 11 = lower(trim(name))) THEN 'name exists' END AS early FROM r)
SELECT id, name, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY ws, key, early IS NULL ORDER BY ord, id) = 1 THEN '' ELSE 'name exists' END) AS reason FROM e""")
def m1_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    number = (key % 7).cast("string")
    name = F.when(key % 13 == 0, "  ").when(key % 2 == 0, F.concat(F.lit(" BASE "), number)).otherwise(F.concat(F.lit("base "), number))
    asked = table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_nationkey").alias("workspace_id"), name.alias("name"), F.when(key % 17 == 0, "faq").otherwise("document").alias("type"), (-key).alias("ord"))
    bases = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("workspace_id"), F.concat(F.lit("Base "), (F.col("s_suppkey") % 11).cast("string")).alias("name"))
    spaces = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.when(F.col("n_nationkey") % 5 == 0, "archived").otherwise("active").alias("status"))
    return lifecycle.judged_creations(asked, bases, spaces).select("id", "name", "reason")


@query("m1_status_changes", """WITH b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'archived' ELSE 'active' END AS status FROM supplier),
c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'archive' ELSE 'restore' END AS action FROM part)
SELECT c.id, action, CASE WHEN c.id = 4 AND action = 'archive' OR action = 'archive' AND status <> 'active' THEN status WHEN status IS NULL THEN NULL WHEN action = 'archive' THEN 'archived' ELSE 'active' END AS status,
CASE WHEN c.id = 4 AND action = 'archive' THEN 'default base' WHEN status IS NULL OR action = 'archive' AND status <> 'active' THEN 'not found' ELSE '' END AS reason FROM c LEFT JOIN b USING (id)""")
def m1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "archived").otherwise("active").alias("status"))
    changes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "archive").otherwise("restore").alias("action"))
    return lifecycle.judged_statuses(bases, changes, 4)


@query("m19_worker_outcomes", """SELECT o_orderkey AS task_id, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN o_orderstatus = 'P' OR c_mktsegment = 'BUILDING' THEN 'canceled' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS outcome,
CASE WHEN c_custkey IS NOT NULL AND o_orderstatus = 'F' AND c_mktsegment <> 'BUILDING' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'unreadable' ELSE 'Upload file processing failed' END ELSE '' END AS message FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = o_custkey""")
def m19(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    tasks = orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("batch_id"))
    status = F.when(F.col("o_orderstatus") == "P", "canceled").when(F.col("o_orderstatus") == "F", "failed").otherwise("indexed")
    files = orders.select(F.col("o_orderkey").alias("file_id"), status.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "unreadable").otherwise("").alias("error_message"))
    batches = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("batch_id"), F.when(F.col("c_mktsegment") == "BUILDING", "canceled").otherwise("running").alias("status"))
    return lifecycle.worker_outcomes(tasks, files, batches).select("task_id", "outcome", "message")


@query("x8_query_understanding", rf"""WITH {QUESTIONS}, p AS (SELECT query_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS more,
  trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM questions), a AS (SELECT *, list_concat([t], more) AS l FROM p),
u AS (SELECT query_id, CASE WHEN t = '' THEN [text] ELSE list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] END AS qs, CASE WHEN t <> '' AND len(more) > 0 THEN 'llm' ELSE 'fallback' END AS understood_by FROM a)
SELECT query_id, generate_subscripts(qs, 1) - 1 AS pos, unnest(qs) AS asked, understood_by FROM u""")
def x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir).withColumn("rewrites", F.split("text", "[.!?]"))
    rows = lifecycle.understood(rows, "text", "rewrites")
    return rows.select("query_id", F.posexplode("retrieval_queries").alias("pos", "asked"), "understood_by").withColumn("pos", F.col("pos").cast("long"))


#: Outputs of providers as a table would log them: well formed and not, by turns.
_REWRITES, _INTENTS = 5, 4


@query("x8_provider_outputs", rf"""WITH {QUESTIONS}, p AS (SELECT query_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, text FROM questions),
r AS (SELECT *, CASE query_id % 5 WHEN 0 THEN ['about ' || query_id, 'more ' || query_id] WHEN 1 THEN ['about ' || query_id] ELSE [] END AS more, CASE query_id % 4 WHEN 0 THEN 'comparison' ELSE '' END AS intent, CASE query_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n FROM p),
u AS (SELECT query_id, intent, n, (CASE WHEN len(more) > 0 THEN 1 ELSE 0 END + CASE WHEN intent <> '' OR n > 0 THEN 1 ELSE 0 END) AS spoke, CASE WHEN t = '' THEN [text] ELSE list_concat([t], more) END AS qs, t = '' AS blank FROM r)
SELECT query_id, array_to_string(qs, ' || ') AS asked, CASE WHEN blank THEN '' ELSE intent END AS intent, CAST(CASE WHEN blank THEN 0 ELSE n END AS BIGINT) AS n_constraints, CASE WHEN blank OR spoke = 0 THEN 'fallback' WHEN spoke = 1 THEN 'llm' ELSE 'mixed' END AS source FROM u""")
def x8_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole questions with the logged outputs of a rewrite and an intent provider: an object, a list with other values, rubbish, a number, nothing."""
    number = F.col("query_id").cast("string")
    rewrite = F.element_at(F.array(F.concat(F.lit('{"queries": ["about '), number, F.lit('", " more '), number, F.lit('\\n", "", 7]}')), F.concat(F.lit('["about '), number, F.lit('", null, {"a": 1}]')), F.lit("not json"), F.lit("12"), F.lit(None).cast("string")), (F.col("query_id") % _REWRITES + 1).cast("int"))
    intent = F.element_at(F.array(F.lit('{"intent": " comparison ", "constraints": [{"field": "ports", "value": 8}, "x"]}'), F.lit('{"intent": null, "constraints": [{"a": 1}, {"b": 2}]}'), F.lit('["intent"]'), F.lit("{")), (F.col("query_id") % _INTENTS + 1).cast("int"))
    rows = questions(spark, sf_dir).withColumns({"rewrite": rewrite, "said": intent})
    out = lifecycle.query_understanding(rows, "text", "rewrite", "said")
    return out.select("query_id", F.array_join("retrieval_queries", " || ").alias("asked"), "intent", F.size("constraints").cast("bigint").alias("n_constraints"), "source")
