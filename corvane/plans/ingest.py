"""Sources, elements and chunks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import chunking, elements, records
from corvane.plans.adapters import CHUNKS, DOCUMENTS, chunks, documents, table
from corvane.plans.registry import query
from corvane.sources import files
from corvane.storage import spread, stored

WS = r"[ \t\n\r\f\x0B]+"


@query("t18_fixed_split", f"WITH {CHUNKS} SELECT doc_id, base_id, seq, chunk_id, content FROM chunks")
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


@query("t18_token_split", r"""WITH d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, i, trim(substring(t, CAST(i * 960 AS BIGINT) + 1, 1024), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS part FROM (SELECT *, unnest(range(0, CASE WHEN n <= 1024 THEN 1 ELSE CAST(ceil((n - 1024) / 960.0) AS BIGINT) + 1 END)) AS i FROM d))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, part FROM p WHERE part <> ''""")
def t18_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.token_windows(F.col("text"), 256, 16)).alias("seq", "part")).select("doc_id", F.col("seq").cast("long").alias("seq"), "part")


@query("t20_estimate_tokens", f"WITH {CHUNKS} SELECT chunk_id, CAST(greatest(1, length(content) // 4) AS INTEGER) AS tokens FROM chunks")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", X.estimate_tokens(F.col("content")).alias("tokens"))


@query("t21_embedding_text", f"WITH {CHUNKS} SELECT chunk_id, md5(array_to_string(list_filter([base_id, CASE WHEN seq > 0 THEN 'part ' || seq END, content], lambda x: x IS NOT NULL AND x <> ''), chr(10))) AS text_md5 FROM chunks")
def t21(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("seq") > 0, F.concat(F.lit("part "), F.col("seq").cast("string")))
    return chunks(spark, sf_dir).select("chunk_id", F.md5(chunking.embedding_text(F.col("base_id"), part, F.col("content")).cast("binary")).alias("text_md5"))


LINES = r"""lines AS (SELECT doc_id, spot, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents WHERE length(text) > 0)),
kinds AS (SELECT doc_id, spot, line, CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, '|') AND ends_with(line, '|') THEN 'table' WHEN regexp_matches(line, '^(#{1,6})\s+(.+)$') THEN 'title'
  WHEN regexp_matches(line, '^([-*+]|\d+\.)\s+') THEN 'list' WHEN starts_with(line, '```') THEN 'code' WHEN regexp_matches(line, '^!\[.*?\]\(.+?\)$') THEN 'image' ELSE 'paragraph' END AS kind FROM lines),
joined AS (SELECT *, CASE WHEN kind = 'table' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY spot) = 'table' THEN 0 ELSE 1 END AS new FROM kinds),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY spot) AS element FROM joined),
els AS (SELECT doc_id, element, first(kind ORDER BY spot) AS type, string_agg(line, chr(10) ORDER BY spot) AS markdown FROM numbered WHERE kind <> 'blank' GROUP BY ALL)"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.elements(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


@query("t1_elements", f"WITH {LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY element) - 1 AS seq, type, md5(markdown) AS markdown_md5 FROM els")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "type", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query("t1_element_titles")
def t1_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).where("title_path <> ''").select(F.col("id").alias("doc_id"), "seq", "level", "title_path")


@query("t2_captions", f"WITH {LINES} SELECT doc_id, element, markdown FROM els WHERE regexp_matches(trim(markdown), '(?i)^(table|figure|fig\\.|图|表)\\s*[-:：]?\\s*\\S+')")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements.elements(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return rows.where(elements.is_caption(F.col("markdown"))).select(F.col("id").alias("doc_id"), (F.col("seq") + 1).cast("double").alias("element"), "markdown")


@query("t5_repeated_lines", r"""WITH p AS (SELECT page_id % 50 AS doc_id, page_id AS page, string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) AS ls FROM pages),
l AS (SELECT doc_id, page, trim(unnest(ls)) AS line, generate_subscripts(ls, 1) AS spot FROM p), n AS (SELECT * FROM l WHERE line <> ''),
e AS (SELECT doc_id, page, arg_min(line, spot) AS head, arg_max(line, spot) AS foot FROM n GROUP BY ALL), t AS (SELECT doc_id, count(*) AS pages FROM e GROUP BY doc_id HAVING count(*) >= 4),
s AS (SELECT doc_id, line, count(*) AS n FROM (SELECT DISTINCT doc_id, page, unnest([head, foot]) AS line FROM e) WHERE length(line) <= 80 GROUP BY ALL),
c AS (SELECT s.doc_id, line FROM s JOIN t USING (doc_id) WHERE n >= greatest(2, floor(pages * 0.6))),
k AS (SELECT n.* FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.line = c.line WHERE c.line IS NULL)
SELECT doc_id, page, count(*) AS lines FROM k GROUP BY ALL""")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("doc_id"), F.col("page_id").alias("page"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return elements.repeated_lines(pages).select("doc_id", "page", F.size(F.split("text", "\n")).cast("long").alias("lines"))


PROFILE = r"""p AS (SELECT doc_id, length(text) AS total_chars, len(regexp_extract_all(text, '(?m)^[ \t]*(?:\d+(?:\.\d+){1,3}\.?|(?:\d+|[IVX]{1,5})\.)[ \t]+\S.{0,200}$')) AS numbered,
  len(regexp_extract_all(text, '(?m)^[ \t]*(?:-{3,}|={3,}|\*{3,}|_{3,})[ \t]*$')) AS rules, (length(text) - length(replace(text, chr(10) || chr(10) || chr(10), ''))) // 3 AS blank_breaks,
  contains(text, '```') AS has_code, len(regexp_extract_all(text, '(?mi)^[ \t]*(?:Kapitel|Abschnitt|Teil)\s+(?:\d+|[IVX]{1,5})[\.: ]?.{0,200}$')) AS german,
  len(regexp_extract_all(text, '(?mi)^[ \t]*(?:Chapter|Section|Part)\s+(?:\d+|[IVX]{1,5})[\.: ]?.{0,200}$')) AS english FROM documents)"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", chunking.profile(F.coalesce("text", F.lit(""))).alias("p"))


@query("t6_profile", f"WITH {PROFILE} SELECT doc_id, total_chars, numbered, rules, blank_breaks, has_code, german, english FROM p")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profiles(spark, sf_dir).select("doc_id", "p.*")
    longs = [F.col(c).cast("long").alias(c) for c in ("total_chars", "numbered", "rules", "blank_breaks", "german", "english")]
    return p.select("doc_id", "has_code", *longs)


@query("t7_strategy")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).select("doc_id", F.array_join(chunking.strategies(F.col("p")), ",").alias("chain"), chunking.dominant_level(F.col("p.headings")).alias("dominant_level"))


@query("t8_validate_chunks", f"""WITH {CHUNKS}, l AS (SELECT doc_id, list(length(content) ORDER BY seq) AS ls FROM chunks GROUP BY doc_id), f AS (SELECT l.*, length(t) AS total FROM l JOIN flat USING (doc_id))
SELECT doc_id, CASE WHEN len(ls) = 1 AND total > 768 THEN 'single chunk for large document' WHEN len(list_filter(ls[1:len(ls) - 1], lambda x: x < 50)) > len(ls) // 4 AND len(list_filter(ls[1:len(ls) - 1], lambda x: x < 50)) > 2 THEN 'too many tiny chunks'
WHEN list_max(ls) < 96 AND total > 384 THEN 'all chunks far below target size' WHEN list_max(ls) > 768 THEN 'chunk exceeds 2x target size' ELSE '' END AS reason FROM f""")
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.length("content").alias("n")))), lambda x: x["n"])
    rows = chunks(spark, sf_dir).groupBy("doc_id").agg(sizes.alias("lengths"))
    total = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.length(X.collapse(F.col("text"))).alias("total"))
    return rows.join(total, "doc_id").select("doc_id", chunking.rejection(F.col("lengths"), F.col("total"), 384).alias("reason"))


@query("t9_adaptive_split")
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.adaptive(spread(table(spark, sf_dir, "documents")), 512, 80, id_col="doc_id")
    return rows.select(F.col("id").alias("doc_id"), "tier", F.array_join("tier_chain", ",").alias("chain"), F.size("rejected").alias("rejected"), F.size("chunks").alias("chunks"))


@query("t15_parent_child")
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.parent_child(spread(table(spark, sf_dir, "documents")), id_col="doc_id")
    return rows.select("id", "chunk_id", "parent_id", "chunk_type", "start", "end", "token_count", "collapsed")


RANGES = """par AS (SELECT o_custkey AS doc_id, o_orderkey AS parent_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderstatus AS title_path, CAST(o_orderkey % 20 AS INTEGER) AS page_start, CAST(o_orderkey % 20 + 3 AS INTEGER) AS page_end FROM orders),
prt AS (SELECT o_custkey AS doc_id, l_orderkey * 10 + l_linenumber AS part_id, l_linestatus AS title_path, CAST(l_partkey % 20 AS INTEGER) AS page_start, CAST(l_partkey % 20 + l_linenumber AS INTEGER) AS page_end FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    page = F.col("o_orderkey") % 20
    parents = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("parent_id"), F.row_number().over(w).cast("long").alias("ord"), F.col("o_orderstatus").alias("title_path"), page.cast("int").alias("page_start"), (page + 3).cast("int").alias("page_end"))
    at = F.col("l_partkey") % 20
    parts = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(F.col("o_custkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("part_id"), F.col("l_linestatus").alias("title_path"), at.cast("int").alias("page_start"), (at + F.col("l_linenumber")).cast("int").alias("page_end"))
    return parts, parents


@query("t16_assign_parents", f"""WITH {RANGES}, j AS (SELECT p.part_id, p.doc_id, q.parent_id, q.ord, p.title_path <> '' AND p.title_path = q.title_path AS titled, q.page_start <= p.page_end AND p.page_start <= q.page_end AS over FROM prt p JOIN par q USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part_id ORDER BY CASE WHEN titled AND over THEN 0 WHEN titled THEN 1 ELSE 2 END, CASE WHEN titled THEN ord ELSE -ord END) AS k FROM j) SELECT doc_id, part_id, parent_id FROM r WHERE k = 1""")
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, parents = _ranges(spark, sf_dir)
    return elements.assign_parents(parts, parents)


@query("t26_parent_by_page", f"""WITH {RANGES}, j AS (SELECT p.part_id AS image_id, p.doc_id, q.parent_id, row_number() OVER (PARTITION BY p.doc_id, p.part_id ORDER BY CASE WHEN p.page_start BETWEEN q.page_start AND q.page_end THEN 0 ELSE 1 END, ord) AS k FROM prt p JOIN par q USING (doc_id))
SELECT doc_id, image_id, parent_id FROM j WHERE k = 1""")
def t26(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, parents = _ranges(spark, sf_dir)
    return elements.parent_by_page(parts.select("doc_id", F.col("part_id").alias("image_id"), F.col("page_start").alias("page")), parents)


@query("t17_neighbours", f"WITH {CHUNKS} SELECT chunk_id, lag(content) OVER w AS previous, lead(content) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements.neighbours(chunks(spark, sf_dir), "doc_id", "seq", "content")
    return rows.select("chunk_id", "previous", "next")


@query("t17_neighbours_whole", f"WITH {CHUNKS} SELECT chunk_id, md5(lag(content) OVER w) AS previous_md5, md5(lead(content) OVER w) AS next_md5 FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def t17_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the neighbouring texts."""
    rows = elements.neighbours(chunks(spark, sf_dir), "doc_id", "seq", "content")
    return rows.select("chunk_id", *[F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("previous", "next")])


@query("t22_sections", f"WITH {LINES}, s AS (SELECT doc_id, element, sum(CASE WHEN type = 'title' AND length(regexp_extract(markdown, '^(#+)', 1)) <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY element) AS section FROM els) SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n FROM s GROUP BY ALL")
def t22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.sections(_elements(spark, sf_dir)).groupBy(F.col("id").alias("doc_id"), "section").agg(F.count(F.lit(1)).alias("n"))


@query("t24_preview_statistics", f"WITH {CHUNKS} SELECT doc_id, count(*) AS n, min(length(content)) AS least, max(length(content)) AS most, round(avg(length(content)), 6) AS mean, round(stddev_pop(length(content)), 6) AS deviation, CAST(count_if(length(content) < 50) AS BIGINT) AS tiny FROM chunks GROUP BY doc_id")
def t24(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("content").cast("long")
    return chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("deviation"), F.count_if(n < 50).alias("tiny"))


@query("t25_chunk_summary", f"WITH {CHUNKS} SELECT base_id, CASE WHEN length(content) < 50 THEN 'tiny' ELSE 'plain' END AS kind, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM chunks GROUP BY GROUPING SETS ((1), (2), ())")
def t25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumn("kind", F.when(F.length("content") < 50, "tiny").otherwise("plain"))
    return rows.groupingSets([["base_id"], ["kind"], []], "base_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("sc4_html_text")
def sc4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.page_texts(spread(table(spark, sf_dir, "pages"))).select("page_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("sc17_web_text", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS text_md5 FROM pages""")
def sc17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.visible_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("sc17_allowed_hosts", r"SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '(^|\.)(example\.org|example\.net)$')")
def sc17_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").where(files.allowed_host(F.col("url"), ("example.org", "example.net")))
    return rows.select("page_id", F.parse_url(F.col("url"), F.lit("HOST")).alias("host"))


@query("t3_html_blocks", r"SELECT page_id, len(regexp_extract_all(html, '(?is)<(?:p|h[1-6]|ul|ol|table|pre|blockquote)\b[^>]*>.*?</(?:p|h[1-6]|ul|ol|table|pre|blockquote)>')) AS blocks FROM pages")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(files.html_blocks(F.col("html"))).cast("long").alias("blocks"))


@query("sc9_page_routing", """WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_discount * 10 AS image_area, CAST(l_quantity AS INTEGER) AS text_chars, l_returnflag = 'R' AND l_linenumber = 1 AS forced FROM lineitem),
r AS (SELECT *, CASE WHEN forced OR image_area >= 0.5 OR (text_chars < 20 AND image_area >= 0.1) THEN 1 ELSE 0 END AS s FROM f)
SELECT doc_id, CASE WHEN sum(s) = 0 THEN 'native' WHEN sum(s) = count(*) THEN 'scanned' ELSE 'hybrid' END AS kind, CAST(sum(s) AS BIGINT) AS scanned_pages FROM r GROUP BY doc_id""")
def sc9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_discount") * 10).alias("image_area"), F.col("l_quantity").cast("int").alias("text_chars"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("forced_ocr"))
    return files.document_kind(files.page_route(rows))


@query("sc12_parser_engine", f"""WITH {DOCUMENTS}, e AS (SELECT * FROM (VALUES ('builtin', 'txt', true), ('layout', 'txt', false), ('fast', 'txt', true)) t(engine, ext, available)),
d AS (SELECT id, CASE n_chars % 3 WHEN 0 THEN 'layout' WHEN 1 THEN 'fast' ELSE 'other' END AS engine FROM docs)
SELECT d.id, CASE WHEN w.engine IS NOT NULL THEN d.engine ELSE 'builtin' END AS used_engine, CASE WHEN w.engine IS NULL THEN 'engine ' || d.engine || ' unavailable' END AS fallback_reason FROM d LEFT JOIN e w ON w.engine = d.engine AND w.available""")
def sc12(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines = spark.createDataFrame([("builtin", "txt", True), ("layout", "txt", False), ("fast", "txt", True)], "engine string, ext string, available boolean")
    wanted = F.when(F.col("n_chars") % 3 == 0, "layout").when(F.col("n_chars") % 3 == 1, "fast").otherwise("other")
    docs = documents(spark, sf_dir).select("id", F.col("file_type").alias("ext"), wanted.alias("engine"))
    return files.parser_engine(docs, engines).select("id", "used_engine", "fallback_reason")


BASE = "b AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS status, o_totalprice AS value, o_orderdate AS created_at FROM orders), n AS (SELECT l_orderkey AS id, min(o_custkey) AS owner, max(l_linestatus) AS status, max(l_extendedprice) AS value, max(l_shipdate) AS created_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY l_orderkey UNION ALL SELECT -c_custkey, c_custkey, 'N', c_acctbal, TIMESTAMP '2024-01-01' FROM customer)"


def _merge_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    base = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("created_at"))
    changed = items.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linestatus").alias("status"), F.max("l_extendedprice").alias("value"), F.max("l_shipdate").alias("created_at")).join(base.select("id", "owner"), "id")
    fresh = table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("owner"), F.lit("N").alias("status"), F.col("c_acctbal").alias("value"), F.expr("timestamp '2024-01-01'").cast(dict(base.dtypes)["created_at"]).alias("created_at"))
    return base, changed.select("id", "owner", "status", "value", "created_at").unionByName(fresh)


@query("sc13_upsert", f"WITH {BASE} SELECT coalesce(b.id, n.id) AS id, CASE WHEN n.id IS NULL THEN b.owner ELSE n.owner END AS owner, CASE WHEN n.id IS NULL THEN b.status ELSE n.status END AS status, CASE WHEN n.id IS NULL THEN b.value ELSE n.value END AS value, coalesce(b.created_at, n.created_at) AS created_at FROM b FULL JOIN n ON b.id = n.id")
def sc13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.upsert(*_merge_inputs(spark, sf_dir), ["id"])


@query("sc14_replace_groups", f"WITH {BASE} SELECT id, owner, status, value FROM b WHERE owner NOT IN (SELECT owner FROM n) UNION ALL SELECT id, owner, status, value FROM n")
def sc14(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _merge_inputs(spark, sf_dir)
    return records.replace_groups(base, new, "owner").select("id", "owner", "status", "value")


@query("sc15_indexable", f"WITH {CHUNKS}, c AS (SELECT chunk_id, CASE seq % 4 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' WHEN 2 THEN 'table' ELSE 'note' END AS chunk_type FROM chunks) SELECT chunk_id, chunk_type FROM c WHERE chunk_type IN ('child', 'table', 'ocr', 'image_ocr', 'image_caption')")
def sc15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.schemas import INDEXABLE_TYPES

    kind = F.when(F.col("seq") % 4 == 0, "parent").when(F.col("seq") % 4 == 1, "child").when(F.col("seq") % 4 == 2, "table").otherwise("note")
    return chunks(spark, sf_dir).select("chunk_id", kind.alias("chunk_type")).where(F.col("chunk_type").isin(*INDEXABLE_TYPES))


@query("sc16_delete_cascade", f"WITH {CHUNKS}, {DOCUMENTS}, x AS (SELECT id FROM docs WHERE parse_status = 'failed') SELECT 'chunk' AS tab, count(*) AS n, count(*) AS linked FROM chunks WHERE doc_id NOT IN (SELECT id FROM x) UNION ALL SELECT 'upload', count(*), CAST(count_if(id NOT IN (SELECT id FROM x)) AS BIGINT) FROM docs")
def sc16(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    uploads = docs.select("name", F.col("id").alias("doc_id"))
    out = records.delete_documents({"chunk": chunks(spark, sf_dir), "upload": uploads}, docs.where("parse_status = 'failed'").select(F.col("id").alias("doc_id")), {"upload": "doc_id"})
    return out["chunk"].agg(F.lit("chunk").alias("tab"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("linked")).union(out["upload"].agg(F.lit("upload").alias("tab"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("linked")))


@query("sc18_guarded_select", "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def sc18(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"corvane_{name}")
    return records.guarded_sql(spark, "SELECT r_name, count(*) AS nations FROM corvane_nation JOIN corvane_region ON n_regionkey = r_regionkey GROUP BY r_name", 1000)


@query("sc20_unexpired", "SELECT event_id, left(props, 8) AS preview FROM events WHERE ts + INTERVAL 10 DAY > (SELECT max(ts) FROM events)")
def sc20(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return events.where(F.col("ts") + F.expr("INTERVAL 10 DAY") > now).select("event_id", F.left("props", F.lit(8)).alias("preview"))


@query("sc22_manifest_signature", f"WITH {DOCUMENTS}, r AS (SELECT storage_path, sha256(storage_path || '|' || n_chars) AS d FROM docs) SELECT sha256(string_agg(d, '' ORDER BY storage_path)) AS signature, count(*) AS files FROM r")
def sc22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("storage_path", F.sha2(F.concat_ws("|", "storage_path", F.col("n_chars").cast("string")), 256).alias("d"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("storage_path", "d"))), lambda x: x["d"]), ""), 256).alias("signature"), F.count(F.lit(1)).alias("files"))
