"""Scalars, routing, graphs and evaluation over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import evaluate, graph, jobs, planning
from corvane.plans.adapters import CHUNKS, QUESTIONS, chunks, questions, table, tokens_sql
from corvane.plans.registry import query

NORM = r"lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g')))"


@query("x1_query_tokens", f"WITH {QUESTIONS} SELECT query_id, list_aggregate(list_sort(list_distinct({tokens_sql('text')})), 'string_agg', ' ') AS terms FROM questions")
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", F.array_join(F.array_sort(X.query_terms(F.col("text"))), " ").alias("terms"))


@query("x2_normalized_signature", f"SELECT doc_id, md5(left({NORM}, 500)) AS signature FROM documents")
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.signature(F.col("text")).cast("binary")).alias("signature"))


@query("x3_languages", r"""WITH h AS (SELECT doc_id, left(coalesce(text, ''), 4096) AS t FROM documents), c AS (SELECT doc_id, t, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) AS cjk, len(regexp_extract_all(t, '[A-Za-z]')) AS latin FROM h)
SELECT doc_id, CASE WHEN t = '' THEN '' WHEN cjk / greatest(1, cjk + latin) >= 0.15 AND latin / greatest(1, cjk + latin) >= 0.15 THEN 'zh,en' WHEN cjk / greatest(1, cjk + latin) > 0.3 THEN 'zh' WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(der|die|das|und|Kapitel)($|[^\p{L}\p{N}_])') THEN 'de' ELSE 'en' END AS languages FROM c""")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.languages(F.coalesce("text", F.lit(""))), ",").alias("languages"))


def _route_sql() -> str:
    from corvane.functions.text import ROUTES

    tests = " ".join(f"WHEN {' OR '.join(f'contains(q, {chr(39)}{n}{chr(39)})' for n in needles)} THEN '{kind}'" for kind, _, needles in ROUTES)
    return f"CASE WHEN q = '' THEN 'fact' {tests} ELSE 'fact' END"


ROUTED = f"{QUESTIONS}, said AS (SELECT query_id, lower(trim(text)) AS q FROM questions UNION ALL SELECT 1000000 + conv_id * 100 + turn, lower(trim(coalesce(text, ''))) FROM conversations), routed AS (SELECT query_id, q, {_route_sql()} AS question_type FROM said)"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select((F.lit(1000000) + F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    return questions(spark, sf_dir).unionByName(talk)


@query("x4_question_routing", f"WITH {ROUTED} SELECT query_id, question_type, CAST(CASE WHEN q = '' THEN 0 WHEN question_type = 'fact' THEN 0.65 ELSE 0.75 END AS DOUBLE) AS confidence, CASE question_type WHEN 'troubleshooting' THEN 'Error/Config/Service' WHEN 'impact' THEN 'impact' WHEN 'dependency' THEN 'path' ELSE '' END AS graph_intent FROM routed")
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.routed(_said(spark, sf_dir))


@query("x6_retrieval_plan", f"""WITH {ROUTED}, p AS (SELECT * FROM (VALUES ('source', 0, 'raw_rag', 'search'), ('dependency', 0, 'graph_retriever', 'path_search'), ('dependency', 1, 'raw_rag', 'search'), ('impact', 0, 'graph_retriever', 'neighbor_search'), ('impact', 1, 'raw_rag', 'search'),
('troubleshooting', 0, 'graph_retriever', 'entity_search'), ('troubleshooting', 1, 'raw_rag', 'search'), ('troubleshooting', 2, 'keyword_search', 'search'), ('comparison', 0, 'raw_rag', 'search'), ('comparison', 1, 'graph_retriever', 'entity_search'),
('howto', 0, 'raw_rag', 'search'), ('howto', 1, 'keyword_search', 'search'), ('decision', 0, 'raw_rag', 'search'), ('decision', 1, 'keyword_search', 'search'), ('summary', 0, 'raw_rag', 'search'), ('summary', 1, 'graph_retriever', 'entity_search'), ('fact', 0, 'raw_rag', 'search'), ('fact', 1, 'graph_retriever', 'entity_search')) t(question_type, ord, tool, action))
SELECT query_id, ord, tool, action FROM routed JOIN p USING (question_type)""")
def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.planned(planning.routed(_said(spark, sf_dir)), planning.plan_table(spark)).select("query_id", "ord", "tool", "action")


@query("x5_mentions")
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(X.mentions(F.col("text"))).cast("long").alias("mentions"))


@query("x7_split_entities", r"WITH q AS (SELECT conv_id, turn, string_split(replace(text, '?', ''), ' and ') AS ps FROM conversations WHERE text IS NOT NULL AND NOT contains(lower(text), ' depend on ') AND NOT contains(lower(text), ' depends on ')) SELECT conv_id, turn, array_to_string(list_filter([trim(translate(p, '?。', '')) FOR p IN ps], lambda p: p <> '')[1:2], ' | ') AS parts FROM q")
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    rows = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull() & ~low.contains(" depend on ") & ~low.contains(" depends on "))
    return rows.select("conv_id", "turn", F.array_join(X.split_entities(F.col("text")), " | ").alias("parts"))


@query("x10_previews", "SELECT doc_id, CASE WHEN length(text) <= 360 THEN text ELSE left(text, 360) || '... [truncated]' END AS preview, coalesce(nullif(source, ''), lang, 'unknown') AS shown_source FROM documents")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 360).alias("preview"), F.coalesce(F.nullif("source", F.lit("")), "lang", F.lit("unknown")).alias("shown_source"))


@query("x14_stable_ids", "SELECT doc_id, 'processing-' || left(sha256(doc_id || chr(31) || coalesce(source, '')), 32) AS id FROM documents")
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_id(F.col("doc_id").cast("string"), F.coalesce("source", F.lit("")), prefix="processing-").alias("id"))


@query("x15_time_arithmetic", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, strftime(ts + INTERVAL 120 SECOND, '%Y-%m-%dT%H:%M:%S') AS lease, strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-15T00:00:00' AS recent FROM events")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", iso("ts").alias("at"), iso(F.col("ts") + F.expr("INTERVAL 120 SECOND")).alias("lease"), (iso("ts") >= "2024-01-15T00:00:00").alias("recent"))


@query("x16_scores", "SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, l_discount * 20 - 0.5)), 9) AS clamped, coalesce(CASE WHEN l_linenumber % 4 = 0 THEN l_tax END, CASE WHEN l_linenumber % 4 = 1 THEN l_discount END, 0) AS score FROM lineitem")
def x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    score = X.retrieval_score(F.when(F.col("l_linenumber") % 4 == 0, F.col("l_tax")), F.when(F.col("l_linenumber") % 4 == 1, F.col("l_discount")), none, none)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.clamp(F.col("l_discount") * 20 - 0.5), 9).alias("clamped"), score.alias("score"))


@query("x17_json_fallback", "SELECT event_id, coalesce(TRY_CAST(json_extract(CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT), -1) AS k FROM events")
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, F.lit("{bad")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(text, "k bigint")["k"], F.lit(-1)).alias("k"))


@query("x18_error_text", r"""SELECT page_id, left(trim(regexp_replace(replace(regexp_replace(regexp_replace('failed at /data/kb/' || url || ' token=' || page_id || E'\n again', '(?i)(authorization|password|passwd|token|api[_-]?key|secret|client[_-]?secret)([''"\s:=]+)([^,''"\s&}]+)', '\1\2***', 'g'), '(?i)bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer ***', 'g'), '/data/kb', '[data]'), '[ \t\n\r\f\x0B]+', ' ', 'g')), 500) AS message FROM pages""")
def x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("failed at /data/kb/"), "url", F.lit(" token="), F.col("page_id").cast("string"), F.lit("\n again"))
    return table(spark, sf_dir, "pages").select("page_id", X.sanitize_error(raw, "/data/kb").alias("message"))


@query("m21_exact_term_gate", r"""SELECT conv_id, turn, regexp_matches(text, '[\w./-]+\.(?:md|txt|pdf|docx|html|json|csv)') OR regexp_matches(text, '\b[A-Z]{2,}[-_]?\d{2,}\b') OR regexp_matches(text, '"[^"]{3,}"') OR regexp_matches(text, '\b0x[0-9A-Fa-f]+\b') OR regexp_matches(text, '\b\d+\.\d+\.\d+\b') OR regexp_matches(text, '\b[a-z]+_[a-z_]+\b') AS blocked FROM conversations WHERE text IS NOT NULL""")
def m21(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("question"), F.array(F.lit("knowledge_search")).alias("tools"), F.lit(True).alias("grep_first"), F.lit(False).alias("grep_done"))
    return planning.blocked(runs).select("conv_id", "turn", "blocked")


# ---- graph: regions, nations, suppliers and customers -------------------------------------------------------------------
EDGES = "edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'nr' || n_nationkey AS edge_id FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'sn' || s_suppkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'cn' || c_custkey FROM customer), step AS (SELECT src AS u, dst AS v, edge_id FROM edges UNION ALL SELECT dst, src, edge_id FROM edges)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst"), tag("nr", "n_nationkey").alias("edge_id"))
    s = table(spark, sf_dir, "supplier").select(tag("s", "s_suppkey"), tag("n", "s_nationkey"), tag("sn", "s_suppkey"))
    return n.union(s).union(table(spark, sf_dir, "customer").select(tag("c", "c_custkey"), tag("n", "c_nationkey"), tag("cn", "c_custkey")))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = F.array(F.concat(F.lit("alias "), F.lower("s_name")))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("type"), F.col("s_name").alias("name"), alias.alias("aliases"))


@query("g1_entity_search", "SELECT 's' || s_suppkey AS id, CAST(CASE WHEN lower('s' || s_suppkey) = 's1' THEN 1.0 WHEN lower(s_name) = 's1' THEN 0.95 ELSE 0.85 END AS DOUBLE) AS score FROM supplier WHERE lower('s' || s_suppkey) = 's1' OR contains(lower(s_name), 's1') OR contains('alias ' || lower(s_name), 's1') ORDER BY score DESC, s_name, id LIMIT 10")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search_entities(_entities(spark, sf_dir), "S1").select("id", "score")


@query("g2_neighbours", f"WITH {EDGES}, a AS (SELECT DISTINCT u AS seed, v AS node, 1 AS d FROM step WHERE u[1:1] = 'r'), b AS (SELECT DISTINCT a.seed, s.v AS node, 2 AS d FROM a JOIN step s ON s.u = a.node), c AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT seed, node, CAST(min(d) AS INTEGER) AS depth FROM c WHERE node <> seed GROUP BY seed, node")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.neighbours(_edges(spark, sf_dir), seeds, 2)


@query("g2_trails", f"WITH {EDGES}, a AS (SELECT u AS seed, v AS node, edge_id AS e1 FROM step WHERE u[1:1] = 'r'), b AS (SELECT a.seed, s.v AS node, e1 || ';' || s.edge_id AS es FROM a JOIN step s ON s.u = a.node AND s.edge_id <> a.e1) SELECT seed, node, es AS edge_path, CAST(2 AS INTEGER) AS depth FROM b UNION ALL SELECT seed, node, e1, CAST(1 AS INTEGER) FROM a")
def g2_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.trails(_edges(spark, sf_dir), seeds, 2).select("seed", "node", F.array_join("edge_ids", ";").alias("edge_path"), "depth")


@query("g3_paths", f"WITH {EDGES}, p AS (SELECT a.v AS x, b.v AS y, a.edge_id || ';' || b.edge_id AS edge_path FROM step a JOIN step b ON b.u = a.v AND a.edge_id <> b.edge_id WHERE a.u = 's1') SELECT x AS via, y AS target, edge_path FROM p WHERE y[1:1] = 'r'")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "supplier").where("s_suppkey = 1").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()
    if nation is None:
        return spark.createDataFrame([], "via string, target string, edge_path string")
    found = graph.paths(_edges(spark, sf_dir), "s1", f"r{nation[0]}", 2)
    return found.select(F.col("nodes")[1].alias("via"), F.col("nodes")[2].alias("target"), F.array_join("edge_ids", ";").alias("edge_path"))


@query("g4_traceable_trails", f"WITH {EDGES}, a AS (SELECT u AS seed, v AS node, edge_id FROM step WHERE u[1:1] = 'r') SELECT seed, node FROM a WHERE CAST(edge_id[3:] AS INTEGER) % 3 <> 0")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).withColumn("source_chunk_id", F.substring("edge_id", 3, 20))
    ids = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("string").alias("chunk_id"))
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.traceable(graph.trails(edges.drop("source_chunk_id"), seeds, 1), edges, ids).select("seed", "node")


@query("g5_resolve_entities", "WITH k AS (SELECT lower(trim(regexp_replace(regexp_replace(s_name, '[\\s_\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS key, min('s' || s_suppkey) AS id FROM supplier GROUP BY 1), c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE 'new ' || c_custkey END AS name FROM customer), n AS (SELECT *, lower(trim(regexp_replace(name, '[\\s_\\-]+', ' ', 'g'))) AS key FROM c) SELECT c_custkey AS candidate, coalesce(k.id, left(sha256('supplier:' || n.key), 24)) AS entity_id, k.id IS NULL AS is_new FROM n LEFT JOIN k USING (key)")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))).otherwise(F.concat(F.lit("new "), key.cast("string")))
    candidates = table(spark, sf_dir, "customer").select(key.alias("candidate"), F.lit("supplier").alias("type"), name.alias("name"))
    return graph.resolve_entities(candidates, _entities(spark, sf_dir).withColumn("aliases", F.array().cast("array<string>"))).select("candidate", "entity_id", "is_new")


RELATIONS = "rel AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'R' THEN 'depends_on' WHEN 'A' THEN 'part_of' ELSE 'odd' END AS relation_type, CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS source_chunk_id, CASE WHEN l_linenumber = 6 THEN '' ELSE 'd' END AS doc_id FROM lineitem), ok AS (SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id FROM orders WHERE o_orderstatus <> 'P')"


@query("f10_relation_validity", f"WITH {RELATIONS} SELECT id, CASE WHEN relation_type NOT IN ('depends_on', 'part_of') THEN 'unknown relation type' WHEN source_chunk_id = '' THEN 'no source chunk' WHEN doc_id = '' THEN 'no document' WHEN chunk_id IS NULL THEN 'source chunk missing' ELSE 'valid' END AS verdict FROM rel LEFT JOIN ok ON chunk_id = source_chunk_id")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = _relations(spark, sf_dir)
    return good.select("id", F.lit("valid").alias("verdict")).union(bad.select("id", "reason"))


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, flag, line = table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_linenumber")
    relations = items.select((F.col("l_orderkey") * 10 + line).alias("id"), F.when(flag == "R", "depends_on").when(flag == "A", "part_of").otherwise("odd").alias("relation_type"), F.when(line == 7, "").otherwise(F.col("l_orderkey").cast("string")).alias("source_chunk_id"), F.when(line == 6, "").otherwise("d").alias("doc_id"), F.lit("v1").alias("extractor_version"))
    ids = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("chunk_id"))
    return graph.valid_relations(relations, ids, ("depends_on", "part_of"))


@query("j9_relation_evidence", f"WITH {RELATIONS} SELECT relation_type, count(*) AS n FROM rel JOIN ok ON chunk_id = source_chunk_id WHERE relation_type IN ('depends_on', 'part_of') AND doc_id <> '' GROUP BY relation_type")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir)[0].groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


@query("j8_relation_endpoints", "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS chunk, l_returnflag AS doc, 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), loc AS (SELECT 1 AS chunk, 'p' || p_partkey AS name, p_partkey AS e FROM part WHERE p_partkey % 2 = 0), wide AS (SELECT 'R' AS doc, 'p' || p_partkey AS name, p_partkey + 100000 AS e FROM part UNION ALL SELECT 'R', 's' || s_suppkey, s_suppkey + 500000 FROM supplier) SELECT r.id, coalesce(l.e, w.e) AS source_id, v.e AS target_id FROM r LEFT JOIN loc l ON l.chunk = r.chunk AND l.name = r.a LEFT JOIN wide w ON w.doc = r.doc AND w.name = r.a LEFT JOIN wide v ON v.doc = r.doc AND v.name = r.b WHERE coalesce(l.e, w.e) IS NOT NULL AND v.e IS NOT NULL")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    relations = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_returnflag").alias("doc_id"), named("p", "l_partkey").alias("source_name"), named("s", "l_suppkey").alias("target_name"))
    part = table(spark, sf_dir, "part")
    local = part.where("p_partkey % 2 = 0").select(F.lit(1).alias("chunk_id"), named("p", "p_partkey").alias("name"), F.col("p_partkey").alias("entity_id"))
    wide = part.select(F.lit("R").alias("doc_id"), named("p", "p_partkey").alias("name"), (F.col("p_partkey") + 100000).alias("entity_id")).union(table(spark, sf_dir, "supplier").select(F.lit("R"), named("s", "s_suppkey"), F.col("s_suppkey") + 500000))
    return graph.resolve_endpoints(relations, local, wide)[0].select("id", "source_id", "target_id")


@query("g7_extraction_payload", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS entities FROM events")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    second = F.when(F.col("user_id") % 2 == 0, F.lit("")).otherwise(F.col("event_type"))
    text = F.concat(F.lit('{"entities":[{"id":"a'), e, F.lit('","type":"t","name":"n"},{"id":"b","type":"'), second, F.lit('","name":"m"}],"relations":[]}'))
    payload = F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", F.size(graph.parse_payload(payload)["entities"]).alias("entities"))


@query("g8_edge_upserts", "WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag AS flag, l_discount AS c, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS age FROM lineitem) SELECT src, dst, round(arg_max(c, (age, c)), 6) AS confidence, round(max(c), 6) AS best_confidence FROM e GROUP BY ALL")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_discount").alias("confidence"), "l_returnflag")
    merged = graph.upsert_edges(rows.where("l_returnflag <> 'R'").drop("l_returnflag"), rows.where("l_returnflag = 'R'").drop("l_returnflag"), ("src", "dst"))
    return merged.select("src", "dst", F.round("confidence", 6).alias("confidence"), F.round("best_confidence", 6).alias("best_confidence"))


@query("g10_stage_dependents", "SELECT * FROM (VALUES ('load', 'chunk', 0), ('load', 'index', 1), ('load', 'multimodal', 2), ('load', 'postprocess', 3), ('chunk', 'index', 0), ('chunk', 'multimodal', 1), ('chunk', 'postprocess', 2), ('index', 'postprocess', 0), ('multimodal', 'postprocess', 0)) t(stage, dependent, ord)")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, d, i) for s in ("load", "chunk", "index", "multimodal", "postprocess") for i, d in enumerate(jobs.dependents(s))]
    return spark.createDataFrame(rows, "stage string, dependent string, ord int")


@query("g11_span_descendants", f"WITH RECURSIVE {EDGES}, t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT t.root, e.src, t.depth + 1 FROM t JOIN edges e ON e.dst = t.id) SELECT root, id, depth FROM t")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _edges(spark, sf_dir).select(F.col("src").alias("id"), F.col("dst").alias("parent_id"))
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return graph.descendants(links, roots)


# ---- evaluation ---------------------------------------------------------------------------------------------------------
CASES = """cases AS (SELECT doc_id AS case_id, quality, toxic, coalesce(text, '') AS answer, doc_id % 5 AS checked, least(doc_id % 4, doc_id % 5) AS verified, ['the', 'Der', lang] AS terms,
  CASE doc_id % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['a'] ELSE [] END AS expected, CASE doc_id % 4 WHEN 0 THEN ['a', 'c'] WHEN 1 THEN ['b', 'c'] ELSE ['d'] END AS used, doc_id % 7 = 0 AS silent FROM documents JOIN labels USING (doc_id)),
scored AS (SELECT case_id, CASE WHEN checked = 0 THEN 1 ELSE least(1, verified / checked) END AS citation_resolvable_rate, CASE WHEN len(expected) = 0 THEN 1 ELSE len(list_intersect(expected, used)) / len(list_distinct(expected)) END AS required_source_hit_rate,
  len(list_filter(terms, lambda t: contains(lower(answer), lower(t)))) / 3 AS answer_contains_expected_terms, CASE WHEN len(expected) = 0 THEN 1 ELSE (CASE WHEN len(list_intersect(expected, used)) = len(expected) THEN 1 ELSE 0 END + 1) / 2 END AS tool_plan_match_rate,
  CASE WHEN NOT silent THEN 1 WHEN contains(lower(answer), 'cannot determine') OR contains(lower(answer), 'insufficient') THEN 1 ELSE 0 END AS insufficient_evidence_correctness, quality FROM cases)"""
METRICS = ("citation_resolvable_rate", "required_source_hit_rate", "answer_contains_expected_terms", "tool_plan_match_rate", "insufficient_evidence_correctness")


def scored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    expected = F.when(d % 3 == 0, strings("a", "b")).when(d % 3 == 1, strings("a")).otherwise(strings())
    used = F.when(d % 4 == 0, strings("a", "c")).when(d % 4 == 1, strings("b", "c")).otherwise(strings("d"))
    answer = F.coalesce("text", F.lit(""))
    return rows.select(
        d.alias("case_id"),
        evaluate.citation_rate(F.least(d % 4, d % 5), d % 5).alias("citation_resolvable_rate"),
        evaluate.source_rate(expected, used).alias("required_source_hit_rate"),
        evaluate.term_rate(F.array(F.lit("the"), F.lit("Der"), F.col("lang")), answer).alias("answer_contains_expected_terms"),
        evaluate.tool_rate(expected, strings(), used).alias("tool_plan_match_rate"),
        evaluate.insufficient_rate(d % 7 == 0, answer).alias("insufficient_evidence_correctness"),
        "quality",
    )


@query("e1_e6_case_scores", f"WITH {CASES} SELECT case_id, " + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in METRICS) + " FROM scored")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_cases(spark, sf_dir).select("case_id", *METRICS)


LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, quality, {m} AS score FROM scored" for m in METRICS)


@query("a5_metric_averages", f"WITH {CASES}, l AS ({LONG}) SELECT metric, round(avg(score), 9) AS mean FROM l GROUP BY metric")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.averages(evaluate.long_form(scored_cases(spark, sf_dir), metrics=METRICS)).select("metric", F.round("mean", 9).alias("mean"))


@query("a7_run_comparison", f"WITH {CASES}, l AS ({LONG}), m AS (SELECT metric, avg(score) FILTER (quality = 1) AS c, avg(score) FILTER (quality = 0) AS b FROM l GROUP BY metric) SELECT metric, round(coalesce(c, 0), 9) AS current, round(coalesce(b, 0), 9) AS baseline, round(coalesce(c, 0) - coalesce(b, 0), 9) AS delta FROM m")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_cases(spark, sf_dir)
    mean = lambda q: evaluate.averages(evaluate.long_form(rows.where(F.col("quality") == q), metrics=METRICS))
    return evaluate.compare(mean(1), mean(0)).select("metric", *[F.round(c, 9).alias(c) for c in ("current", "baseline", "delta")])


@query("j12_changed_cases", f"WITH {CASES} SELECT case_id, CASE WHEN quality = 1 THEN 'newly_failed' ELSE 'fixed' END AS change FROM scored WHERE (quality = 1) <> (citation_resolvable_rate >= 0.5)")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_cases(spark, sf_dir)
    return evaluate.changed_cases(rows.select("case_id", (F.col("citation_resolvable_rate") >= 0.5).alias("passed")), rows.select("case_id", (F.col("quality") == 1).alias("passed")))


@query("e7_run_status", "WITH r AS (SELECT doc_id % 40 AS run_id, toxic = 0 AS passed FROM labels) SELECT run_id, count(*) AS cases, CAST(count_if(NOT passed) AS BIGINT) AS failed, CASE WHEN count_if(NOT passed) = 0 THEN 'completed' WHEN count_if(NOT passed) = count(*) THEN 'failed' ELSE 'partial_failed' END AS status FROM r GROUP BY run_id")
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.run_status(table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("run_id"), (F.col("toxic") == 0).alias("passed")))


@query("e9_sufficiency", f"WITH {ROUTED} SELECT query_id, CASE WHEN question_type IN ('dependency', 'impact') THEN query_id % 2 > 0 ELSE query_id % 3 > 0 OR query_id % 2 > 0 END AS sufficient FROM routed")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planning.routed(_said(spark, sf_dir))
    return rows.select("query_id", evaluate.sufficient(F.col("question_type"), F.col("query_id") % 3, F.col("query_id") % 2).alias("sufficient"))


@query("e4_graph_traceability", f"WITH {RELATIONS}, t AS (SELECT id // 10 AS case_id, chunk_id IS NOT NULL AS ok FROM rel LEFT JOIN ok ON chunk_id = source_chunk_id) SELECT case_id, round(count_if(ok) / count(*), 9) AS graph_path_traceability_rate FROM t GROUP BY case_id")
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_orderkey").cast("string")).alias("chunk_id"))
    ids = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.lit(True).alias("there"))
    rows = rel.join(ids, "chunk_id", "left").groupBy("case_id").agg(F.count_if("there").alias("ok"), F.count(F.lit(1)).alias("n"))
    return rows.select("case_id", F.round(evaluate.rate(F.col("ok"), F.col("n")), 9).alias("graph_path_traceability_rate"))


@query("d9_set_tests", "WITH s AS (SELECT o_custkey AS k, list(DISTINCT o_orderstatus) AS a, list(DISTINCT o_orderpriority[1:1]) AS b FROM orders GROUP BY 1) SELECT k, len(list_intersect(b, ['1', '2', '3'])) AS hit, len(list_filter(['F', 'O'], lambda x: NOT list_contains(a, x))) AS missing FROM s")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.left("o_orderpriority", F.lit(1))).alias("b"))
    hit = F.size(F.array_intersect("b", F.array(F.lit("1"), F.lit("2"), F.lit("3"))))
    return rows.select("k", hit.cast("long").alias("hit"), F.size(F.array_except(F.array(F.lit("F"), F.lit("O")), "a")).cast("long").alias("missing"))


@query("m13_current_stage", "WITH s AS (SELECT l_orderkey AS run_id, l_shipdate AS d, 'stage' || l_linenumber AS stage, l_linenumber AS ord, CASE l_returnflag WHEN 'R' THEN 'completed' WHEN 'A' THEN 'pending' ELSE 'running' END AS status FROM lineitem) SELECT run_id, arg_min(stage, (CASE status WHEN 'running' THEN 0 ELSE 1 END, ord)) AS stage FROM s WHERE status <> 'completed' GROUP BY run_id")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("stage"), F.col("l_linenumber").cast("string")).alias("stage"), F.col("l_linenumber").alias("ord"), F.when(flag == "R", "completed").when(flag == "A", "pending").otherwise("running").alias("status"))
    return jobs.current_stage(spans)


@query("m28_evaluation_report")
def m28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(evaluate.averages(evaluate.long_form(scored_cases(spark, sf_dir), metrics=METRICS)), "Evaluation")


@query("m8_index_rebuild", f"WITH {CHUNKS}, t AS (SELECT base_id, unnest(list_distinct({tokens_sql('content')})) AS term FROM chunks) SELECT base_id, count(DISTINCT term) AS terms, count(*) AS postings FROM t GROUP BY base_id")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    rows = c.select("base_id", F.array_distinct(X.index_tokens(F.col("content"))).alias("tokens")).select("base_id", F.explode("tokens").alias("term"))
    return rows.groupBy("base_id", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("base_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("postings"))
