"""Retrieval over whole tables: keyword, overlap and vector search, fusion, duplicates, gates, context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import context, fusion, search
from corvane.plans.adapters import CHUNKS, QUESTIONS, chunks, kept_chunks, kept_index, questions, table, tokens_sql
from corvane.plans.registry import query
from corvane.schemas import Scope
from corvane.storage import stored

TOP = 10

BM25 = rf"""{CHUNKS}, {QUESTIONS},
toks AS (SELECT chunk_id, {tokens_sql("content")} AS ts FROM chunks),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
tf AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT query_id, unnest({tokens_sql("text")}) AS term FROM questions),
bm AS (SELECT qt.query_id, tf.chunk_id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM qt JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL),
kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 10)"""


@query("k3_bm25_top_k", f"WITH {BM25} SELECT query_id, rank, chunk_id, round(bm25, 6) AS bm25, round(1 / (1 + abs(bm25)), 6) AS keyword_score FROM kw")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = kept_index(spark, sf_dir).search(questions(spark, sf_dir), TOP)
    return hits.select("query_id", "rank", "chunk_id", F.round("bm25", 6).alias("bm25"), F.round("keyword_score", 6).alias("keyword_score"))


@query("k3_postings", f"WITH {CHUNKS}, p AS (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM (SELECT chunk_id, {tokens_sql('content')} AS ts FROM chunks)), t AS (SELECT term, chunk_id, count(*) AS tf FROM p GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM t GROUP BY term")
def k3_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_index(spark, sf_dir).totals()


@query("k2_scoped_top_k", f"WITH {BM25.rsplit('kw AS', 1)[0]}kw AS (SELECT bm.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) AS INTEGER) AS rank FROM bm JOIN chunks USING (chunk_id) WHERE base_id IN ('src1', 'src4', 'default') QUALIFY rank <= 10) SELECT query_id, rank, chunk_id, round(bm25, 6) AS bm25 FROM kw")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three knowledge bases may be shown; the statistics are those of all."""
    hits = kept_index(spark, sf_dir).search(questions(spark, sf_dir), TOP, Scope("w0", ("src1", "src4", "default")))
    return hits.select("query_id", "rank", "chunk_id", F.round("bm25", 6).alias("bm25"))


OVERLAP = rf"""{CHUNKS}, {QUESTIONS},
ot AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[\x{{4e00}}-\x{{9fff}}]{{2,}}|[A-Za-z0-9_]{{2,}}')) AS ts FROM questions),
os AS (SELECT query_id, chunk_id, len(list_filter(ts, lambda w: contains(lower(content), w))) AS m, len(ts) AS n FROM ot, chunks WHERE len(ts) > 0),
ov AS (SELECT query_id, chunk_id, m / n AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(m / n, 12) DESC, chunk_id) AS INTEGER) AS rank FROM os WHERE m > 0 QUALIFY rank <= 10)"""


@query("k4_token_overlap", f"WITH {OVERLAP} SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM ov")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.overlap_search(kept_chunks(spark, sf_dir), questions(spark, sf_dir), TOP)
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


def _cosine(scope: str = "") -> str:
    return f"""WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
c AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 12) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id {scope}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c)"""


def _nearest(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    return search.nearest(rows, asked, TOP, by=by)


@query("k1_dense_knn", _cosine() + " SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("g6_scoped_entity_knn", _cosine("AND a.label = b.label") + " SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "label").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("f6_min_relevance", _cosine() + " SELECT query_id, vec_id, round(greatest(0, 1 - greatest(0, 1 - score)), 6) AS relevance FROM r WHERE rank <= 10 AND greatest(0, 1 - greatest(0, 1 - score)) >= 0.30")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _nearest(spark, sf_dir).withColumn("distance", F.greatest(F.lit(0.0), 1 - F.col("score")))
    return search.relevant(hits).select("query_id", "vec_id", F.round("relevance", 6).alias("relevance"))


def _lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c, q = kept_chunks(spark, sf_dir), questions(spark, sf_dir)
    keyword = kept_index(spark, sf_dir).search(q, TOP).withColumn("score", F.col("bm25"))
    overlap = search.overlap_search(c, q, TOP)
    return {"overlap": overlap, "keyword": keyword}


RRF = f"""WITH {BM25}, {OVERLAP.split("ot AS", 1)[0] and "ot AS" + OVERLAP.split("ot AS", 1)[1]},
parts AS (SELECT query_id, chunk_id, rank, 0 AS place, 0.7 AS w, score AS s, NULL AS k FROM ov UNION ALL SELECT query_id, chunk_id, rank, 1, 0.3, NULL, bm25 FROM kw),
fused AS (SELECT query_id, chunk_id, sum(w / (60 + rank)) AS rrf, min(struct_pack(place := place, rank := rank)) AS first_seen, max(s) AS overlap_score, max(k) AS keyword_score FROM parts GROUP BY ALL),
cut AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first_seen, chunk_id) AS INTEGER) AS position FROM fused QUALIFY position <= 30)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    return fusion.fused_cut(fusion.weighted_rrf({"overlap": (lists["overlap"], 0.7), "keyword": (lists["keyword"], 0.3)}), "rrf")


@query("d1_weighted_rrf", RRF + " SELECT query_id, position, chunk_id, round(rrf, 9) AS rrf FROM cut")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: chunk all documents, search them by keyword and overlap for all questions, and fuse the rankings."""
    return _fused(spark, sf_dir).select("query_id", "position", "chunk_id", F.round("rrf", 9).alias("rrf"))


@query("d1b_unweighted_rrf", RRF + ", u AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf FROM parts GROUP BY ALL) SELECT query_id, chunk_id, round(rrf, 9) AS rrf FROM u")
def d1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    return fusion.weighted_rrf({k: (v, 1.0) for k, v in lists.items()}).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"))


@query("d1b_weighted_sum", RRF + ", u AS (SELECT query_id, chunk_id, sum(CASE WHEN place = 0 THEN 0.7 * s ELSE 0.3 * k END) AS score FROM parts GROUP BY ALL) SELECT query_id, chunk_id, round(score, 6) AS score FROM u")
def d1b_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    return fusion.weighted_sum({"overlap": (lists["overlap"], 0.7), "keyword": (lists["keyword"], 0.3)}).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("k5_fused_cut", RRF + " SELECT query_id, count(*) AS n, max(position) AS last FROM cut GROUP BY query_id")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))


#: Hits that are broadcast at most.
FEW = 1 << 17


def _few(hits: DataFrame) -> DataFrame:
    """hits, written once; where they are few they go to the chunks, so that no text moves for the others."""
    rows = stored(hits, "hits")
    return rows.hint("broadcast") if rows.count() <= FEW else rows


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits with content: query_id, position, chunk_id, doc_id, parent_id, content, score, question."""
    c = kept_chunks(spark, sf_dir).select("chunk_id", "doc_id", F.concat("doc_id", F.lit("::parent-0")).alias("parent_id"), "content")
    hits = _few(_fused(spark, sf_dir).select("query_id", "position", "chunk_id", F.col("rrf").alias("score")))
    return hits.join(c, "chunk_id").join(questions(spark, sf_dir).withColumnRenamed("text", "question"), "query_id")


HITS = RRF + ", hits AS (SELECT cut.query_id, position, chunk_id, doc_id, doc_id || '::parent-0' AS parent_id, content, rrf AS score, q.text AS question FROM cut JOIN chunks USING (chunk_id) JOIN questions q ON q.query_id = cut.query_id)"
SIGN = r"left(lower(trim(regexp_replace(content, '[ \t\n\r\f\x0B]+', ' ', 'g'))), 500)"


@query("d2_exact_duplicates", HITS + f""", a AS (SELECT *, {SIGN} AS sign FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, {SIGN} ORDER BY round(score, 12) DESC, chunk_id) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY round(score, 12) DESC, chunk_id) = 1) SELECT query_id, chunk_id, doc_id FROM b""")
def d2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.drop_exact_duplicates(_hits(spark, sf_dir), F.round("score", 12), X.signature(F.col("content"))).select("query_id", "chunk_id", "doc_id")


@query("d2_near_duplicates")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).withColumn("score", F.round("score", 12))
    return fusion.drop_near_duplicates(hits).select("query_id", "chunk_id", "doc_id")


@query("d3_content_similarity", HITS + r""", n AS (SELECT query_id, position, lower(trim(regexp_replace(content, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS t FROM hits), p AS (SELECT a.query_id, a.position, a.t AS l, b.t AS r FROM n a JOIN n b ON a.query_id = b.query_id AND b.position = a.position + 1)
SELECT query_id, position, round(least(length(l), length(r)) / greatest(length(l), length(r)), 9) AS ratio FROM p WHERE l <> '' AND r <> '' AND (contains(l, r) OR contains(r, l))""")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment part of the similarity of neighbouring hits; the matching-blocks part is tested on its own."""
    w = Window.partitionBy("query_id").orderBy("position")
    rows = _hits(spark, sf_dir).select("query_id", "position", X.normalized(F.col("content")).alias("l")).withColumn("r", F.lead("l").over(w)).where("r IS NOT NULL AND l <> '' AND r <> '' AND (contains(l, r) OR contains(r, l))")
    return rows.select("query_id", "position", F.round(F.least(F.length("l"), F.length("r")) / F.greatest(F.length("l"), F.length("r")), 9).alias("ratio"))


@query("d3_full_similarity")
def d3_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole similarity of every pair of neighbouring hits: by containment, else by matching blocks. No SQL says the latter."""
    w = Window.partitionBy("query_id").orderBy("position")
    rows = _hits(spark, sf_dir).select("query_id", "position", F.col("content").alias("l")).withColumn("r", F.lead("l").over(w)).where("r IS NOT NULL")
    ratio = F.pandas_udf(lambda ls, rs: pd.Series([fusion.similarity(a or "", b) for a, b in zip(ls, rs, strict=True)], dtype="float64"), "double")
    return rows.select("query_id", "position", F.round(ratio("l", "r"), 9).alias("ratio"))


@query("k8_mmr")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.diverse(_hits(spark, sf_dir).withColumn("score", F.round("score", 12)).drop("position"), 5).select("query_id", "position", "chunk_id")


LEX = f"CASE WHEN len(list_distinct({tokens_sql('question')})) > 0 THEN len(list_intersect(list_distinct({tokens_sql('question')}), {tokens_sql('content')})) / len(list_distinct({tokens_sql('question')})) ELSE 0 END"
RERANKED = HITS + f", rr AS (SELECT *, {LEX} AS rs FROM hits), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rs, 9) DESC, chunk_id) AS INTEGER) AS rerank FROM rr)"


@query("k6_rerank", RERANKED + " SELECT query_id, rerank, chunk_id, round(rs, 9) AS reranker_score FROM rk WHERE rerank <= 8")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rerank(_hits(spark, sf_dir).drop("position"), search.lexical_scorer, 8).select("query_id", "rerank", "chunk_id", F.round("reranker_score", 9).alias("reranker_score"))


@query("k7_rerank_gate", RERANKED + """, g AS (SELECT *, max(rs) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, chunk_id) AS place FROM rk WHERE rerank <= 8)
SELECT query_id, chunk_id, CASE WHEN best >= 0.3 THEN 'threshold' WHEN best >= 0.15 THEN 'fallback' ELSE 'least' END AS gate FROM g WHERE CASE WHEN best >= 0.3 THEN rs >= 0.3 WHEN best >= 0.15 THEN rs >= 0.15 ELSE place <= 1 END""")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = search.rerank(_hits(spark, sf_dir).drop("position"), search.lexical_scorer, 8)
    return fusion.gate(ranked).select("query_id", "chunk_id", "gate")


@query("k9_direct_load", f"""WITH {CHUNKS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rank FROM chunks)
SELECT doc_id, chunk_id, round(greatest(0, 1 - 0.001 * (rank - 1)), 6) AS score FROM n WHERE n <= 50""")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumn("chunk_type", F.lit("child")).withColumn("selection", F.col("doc_id"))
    return search.direct_load(rows, ("child", "table", "image_ocr", "image_caption")).select("doc_id", "chunk_id", F.round("score", 6).alias("score"))


@query("d6_multi_query", f"""WITH {BM25.replace("questions AS (SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark)", "questions AS (SELECT item_id * 2 AS query_id, coalesce(text, '') AS text FROM benchmark UNION ALL SELECT item_id * 2 + 1, split_part(coalesce(text, ''), '.', 1) FROM benchmark)")},
v AS (SELECT query_id // 2 AS q, query_id % 2 AS variant, chunk_id, row_number() OVER (PARTITION BY query_id // 2 ORDER BY query_id % 2, rank) AS rank, bm25 FROM kw)
SELECT q AS query_id, chunk_id, CAST(min(rank) AS INTEGER) AS rank, round(max(bm25), 6) AS score, array_to_string(list_sort(list_distinct(list(variant))), ',') AS variants FROM v GROUP BY ALL""")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants a question, its whole text and its first sentence, ranked end to end and merged."""
    q = questions(spark, sf_dir)
    variants = q.select((F.col("query_id") * 2).alias("query_id"), "text").union(q.select(F.col("query_id") * 2 + 1, F.split("text", r"\.")[0]))
    hits = kept_index(spark, sf_dir).search(variants, TOP).select(F.expr("query_id div 2").alias("query_id"), (F.col("query_id") % 2).alias("variant"), F.col("rank").alias("variant_rank"), "chunk_id", F.col("bm25").alias("score"))
    merged = fusion.merge_variants(fusion.concatenated_ranks(hits))
    return merged.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), F.array_join(F.transform("matched_variants", lambda v: v.cast("string")), ",").alias("variants"))


@query("d7_low_recall_expansion", f"""WITH {BM25}, f AS (SELECT query_id, count(*) AS n, max(bm25) AS best FROM kw GROUP BY query_id),
low AS (SELECT q.query_id, q.text FROM questions q LEFT JOIN f USING (query_id) WHERE coalesce(n, 0) < 3 OR coalesce(best, 0) < 30),
c AS (SELECT query_id, trim(text) AS t, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS norm, text FROM low)
SELECT query_id, array_to_string(list_filter([norm, text || ' specification', text || ' configuration', text || ' manual'], lambda x: x <> '' AND x <> t)[1:3], ' ; ') AS variants FROM c""")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    hits = kept_index(spark, sf_dir).search(q, TOP).withColumn("score", F.col("bm25"))
    low = q.join(fusion.low_recall(hits, q, least_score=30.0), "query_id", "left_semi")
    wide = fusion.expanded_queries(low, X.normalized(F.col("text")), F.array().cast("array<string>"))
    return wide.select("query_id", F.array_join("variants", " ; ").alias("variants"))


@query("d8_grep_union", f"""WITH {CHUNKS}, {QUESTIONS}, w AS (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY length(t) DESC, t) AS k FROM (SELECT DISTINCT query_id, unnest({tokens_sql("text")}) AS t FROM questions) QUALIFY k <= 3),
h AS (SELECT w.query_id, c.chunk_id, count(*) AS score, string_agg(t, ',' ORDER BY t) AS terms FROM w JOIN (SELECT DISTINCT chunk_id, unnest({tokens_sql("content")}) AS t FROM chunks) c USING (t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h) SELECT query_id, chunk_id, score, terms FROM r WHERE rank <= 10""")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest terms of a question searched one by one; hits merged with the terms that found them."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.length("term")), "term")
    terms = search.query_terms(questions(spark, sf_dir)).withColumn("k", F.row_number().over(w)).where("k <= 3")
    found = kept_index(spark, sf_dir).grep(terms)
    merged = found.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("score"), F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))
    return search.top_k(merged, TOP, "score").select("query_id", "chunk_id", "score", "terms")


@query("j4_hydrate", HITS + " SELECT query_id, chunk_id, content FROM hits")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _few(_fused(spark, sf_dir).select("query_id", "chunk_id", F.lit(" ").alias("content")))
    met = kept_chunks(spark, sf_dir).join(hits.select("chunk_id"), "chunk_id", "left_semi")
    return context.hydrate(hits, met, default_scope=False).select("query_id", "chunk_id", "content")


PARENTS = HITS + r""", pa AS (SELECT doc_id || '::parent-0' AS parent_id, string_agg(content, ' ' ORDER BY seq) AS content FROM chunks GROUP BY doc_id),
pr AS (SELECT query_id, parent_id, max(score) AS score, count(*) AS children FROM hits GROUP BY ALL), rp AS (SELECT pr.*, CAST(greatest(1, length(pa.content) // 4) AS INTEGER) AS token_count FROM pr JOIN pa USING (parent_id))"""


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits' parents, whose whole texts are put together for documents with a hit alone."""
    hits = _few(_hits(spark, sf_dir).withColumn("chunk_type", F.lit("child")))
    c = kept_chunks(spark, sf_dir).join(hits.select("doc_id"), "doc_id", "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), " ")
    wide = c.groupBy("doc_id").agg(text.alias("content")).select(F.concat("doc_id", F.lit("::parent-0")).alias("chunk_id"), "doc_id", "content", X.estimate_tokens(F.col("content")).alias("token_count"))
    return context.recall_parents(hits, wide, F.col("score"))


@query("j5_parent_recall", PARENTS + " SELECT query_id, parent_id, round(score, 9) AS score, children, token_count FROM rp")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(spark, sf_dir).select("query_id", "parent_id", F.round("score", 9).alias("score"), F.size("children").cast("long").alias("children"), "token_count")


@query("w4_budget_packing", PARENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -round(score, 12), parent_id) AS k FROM rp),
f AS (SELECT query_id, k, parent_id, token_count, true AS kept, token_count AS used, 1 AS position FROM o WHERE k = 1
  UNION ALL SELECT o.query_id, o.k, o.parent_id, o.token_count, f.used + o.token_count <= 4000, CASE WHEN f.used + o.token_count <= 4000 THEN f.used + o.token_count ELSE f.used END,
    CASE WHEN f.used + o.token_count <= 4000 THEN f.position + 1 ELSE f.position END FROM f JOIN o ON o.query_id = f.query_id AND o.k = f.k + 1)
SELECT query_id, CAST(position AS INTEGER) AS position, parent_id, token_count, CAST(used AS INTEGER) AS used FROM f WHERE kept""")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.pack(_parents(spark, sf_dir), 4000).select("query_id", "position", "parent_id", "token_count", "used")


@query("w1_rank_assignment", HITS + " SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank FROM hits")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("position")).cast("long").alias("rank"))


@query("a8_best_per_source", HITS + " SELECT query_id, doc_id, arg_min(chunk_id, position) AS chunk_id FROM hits GROUP BY ALL")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.best_of(_hits(spark, sf_dir).withColumn("worth", -F.col("position")), ["query_id", "doc_id"], "worth", "chunk_id").select("query_id", "doc_id", "chunk_id")


@query("a9_ordered_distinct", HITS + ", s AS (SELECT query_id, doc_id, min(position) AS spot FROM hits GROUP BY ALL) SELECT query_id, string_agg(doc_id, ',' ORDER BY spot, doc_id) AS docs FROM s GROUP BY query_id")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.first_seen(_hits(spark, sf_dir), "query_id", "position", "doc_id").select("query_id", F.array_join("values", ",").alias("docs"))


@query("a10_confidence", HITS + " SELECT query_id, round(max(least(1, greatest(0, score * 50))), 9) AS confidence FROM hits GROUP BY query_id")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hits(spark, sf_dir).groupBy("query_id").agg(F.collect_list(F.col("score") * 50).alias("scores"))
    return rows.select("query_id", F.round(fusion.confidence(F.col("scores")), 9).alias("confidence"))


@query("x9_match_snippet", HITS + r""", w AS (SELECT query_id, chunk_id, position, content, list_filter(regexp_split_to_array(question, '\||\s+'), lambda t: t <> '') AS ts FROM hits),
a AS (SELECT *, list_filter([instr(lower(content), lower(t)) FOR t IN ts], lambda i: i > 0)[1] - 1 AS spot FROM w),
s AS (SELECT query_id, chunk_id, CASE WHEN spot IS NULL THEN NULL ELSE translate(trim(substring(content, CAST(greatest(0, spot - 80) AS BIGINT) + 1, CAST(least(length(content), spot + 180) - greatest(0, spot - 80) AS BIGINT))), chr(10), ' ') END AS snip, translate(trim(content), chr(10), ' ') AS head FROM a)
SELECT query_id, chunk_id, coalesce(snip, CASE WHEN length(head) <= 260 THEN head ELSE left(head, 260) || '... [truncated]' END) AS snippet FROM s""")
def x9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "chunk_id", X.snippet(F.col("content"), F.col("question")).alias("snippet"))


@query("w6_context_expansion")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.expand_short(chunks(spark, sf_dir)).select("chunk_id", F.length("content").alias("n"), F.size("neighbours").alias("neighbours"))


@query("d4_context_merge")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.merge_contexts(_hits(spark, sf_dir))
    return rows.select("query_id", "position", "doc_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.length("content").alias("n"))


@query("x11_context_text", HITS + r", b AS (SELECT query_id, position, '[' || position || '] ' || doc_id || chr(10) || content AS block FROM hits) SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY position)) AS context_md5 FROM b GROUP BY query_id")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.context_text(_hits(spark, sf_dir).withColumn("source", F.col("doc_id")))
    return rows.select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query("u10_extractive_answer")
def u10(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _hits(spark, sf_dir).where("position = 1")
    return best.select("query_id", context.extractive_answer(F.col("question"), F.col("content")).alias("answer"))


@query("m12_evidence_previews", HITS + " SELECT query_id, CAST(position AS INTEGER) AS position, chunk_id, left(content, 220) AS preview, count(*) OVER (PARTITION BY query_id) AS hits FROM hits QUALIFY position <= 5")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hits(spark, sf_dir).withColumn("hits", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return rows.where("position <= 5").select("query_id", "position", "chunk_id", F.left("content", F.lit(220)).alias("preview"), "hits")


@query("m11_stage_counts", HITS + " SELECT 'keyword' AS stage, count(*) AS n FROM kw UNION ALL SELECT 'overlap', count(*) FROM ov UNION ALL SELECT 'fused', count(*) FROM hits")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    fused = stored(fusion.weighted_rrf({"overlap": (lists["overlap"], 0.7), "keyword": (lists["keyword"], 0.3)}).select("query_id", "overlap_score", "keyword_score"), "stages")
    count = lambda stage, cond: fused.agg(F.lit(stage).alias("stage"), F.count_if(cond).alias("n"))
    return count("keyword", F.col("keyword_score").isNotNull()).union(count("overlap", F.col("overlap_score").isNotNull())).union(count("fused", F.lit(True)))


@query("u1_embed_and_search")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text vectors from the default embedder, and each question's nearest chunks."""
    from corvane.operators.providers import embedded

    c = chunks(spark, sf_dir).select(F.xxhash64("chunk_id").alias("vec_id"), "content")
    asked = embedded(questions(spark, sf_dir), "query_id", "text").withColumnRenamed("embedding", "vector")
    return search.nearest(embedded(c, "vec_id", "content"), asked, 5).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))
